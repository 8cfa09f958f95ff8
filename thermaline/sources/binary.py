"""Binary recordings: pairs of files with counts and with temperatures, in UTC."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thermaline.sources.files import Parsed, Recording, assemble, first_file, instant, parse

# Little-endian header, and codes of the units.
HEADER = "<hh7ifi128sii"
X_UNITS, Y_UNITS = {0: "m", 1: "ft", 2: "n/a"}, {0: "K", 1: "degC", 2: "degF", 3: "counts"}
RAW, TEMPERATURE = "BinaryRawDTS.dat", "BinaryTemp.dat"


def dat_file(name: str, content: bytes) -> Parsed:
    """Counts (survey 2) as ``a, b``; distances and temperatures (survey 0) as ``x`` and ``a``. The number of locations is the file's."""
    h, start = struct.unpack_from(HEADER, content), struct.calcsize(HEADER)
    survey, version, xu, yu, n, pulses, channel, subtraces, skipped, ref, epoch, probe, size, config = h
    if version != 3:
        raise NotImplementedError(f"header version {version}")
    kind = {0: "<f4", 2: "<i4"}.get(survey)
    if kind is None:
        raise ValueError(f"unknown survey type {survey}")
    a = np.frombuffer(content, kind, n, start).astype(float)
    b = np.frombuffer(content, kind, n, start + 4 * n).astype(float)
    meta = {
        "survey_type": survey, "hdr_version": version, "x_units": X_UNITS[xu], "y_units": Y_UNITS[yu], "num_points": n, "num_pulses": pulses, "channel_id": channel, "num_subtraces": subtraces,
        "num_skipped": skipped, "probe_name": probe.decode("utf-16-le", errors="replace").lstrip("﻿").split("\0")[0], "hdr_size": size, "hw_config": config, "isDoubleEnded": "0", "forwardMeasurementChannel": channel - 1, "backwardMeasurementChannel": "N/A",
    }
    stop = datetime.fromtimestamp(epoch, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    columns = {"a": a.tolist(), "b": b.tolist()}
    return Parsed(stop, {"reference": float(ref), "points": float(n)}, {k: str(v) for k, v in meta.items()}, a.tolist() if survey == 0 else list(range(n)), columns, name.rsplit("Binary", 1)[0])


def read_sensortran(spark: SparkSession, folder: str, zone: str = "UTC") -> Recording:
    """Files ``*BinaryRawDTS.dat`` with the ``*BinaryTemp.dat`` of the same name; one without the other is an error.

    Counts are cut to the locations of the temperatures; the mean of the tail behind them is each channel's ``_zero`` count. The
    reference temperature is in degrees Celsius, the acquisition time 1.
    """
    raw, tmp = parse(spark, folder, RAW, dat_file, "sensortran"), parse(spark, folder, TEMPERATURE, dat_file, "sensortran")
    for one, two, what in ((raw, tmp, TEMPERATURE), (tmp, raw, RAW)):
        lone = one.join(two.select("stamp"), "stamp", "left_anti").limit(1).collect()
        if lone:
            raise FileNotFoundError(f"{lone[0]['file']} has no {what}")
    n = F.size("_x")
    zero = lambda c: F.aggregate(F.slice(c, n + F.floor((F.size(c) - n) / 2).cast("int") + 1, F.size(c)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["k"] + 1).alias("k")), lambda a: F.try_divide(a["s"], a["k"]))
    a, b = F.get("columns", F.lit(0)), F.get("columns", F.lit(1))
    other = tmp.select("stamp", F.col("x").alias("_x"), b.alias("_tmp"), F.col("series")["reference"].alias("_ref"))
    both = raw.join(other, "stamp")
    cut = lambda c: F.slice(c, F.lit(1), n)
    series = F.create_map(F.lit("referenceTemperature"), F.col("_ref") - 273.15, F.lit("st_zero"), zero(a), F.lit("ast_zero"), zero(b), F.lit("userAcquisitionTimeFW"), F.lit(1.0))
    rows = both.select("file", "stamp", "stop", series.alias("series"), "meta", F.col("_x").alias("x"), F.array(cut(a), cut(b), cut(F.col("_tmp"))).alias("columns"))
    out = assemble(rows, {"time": F.from_utc_timestamp(instant(F.col("stop"), "UTC"), zone)}, False, ["st", "ast", "tmp"], ["referenceTemperature", "st_zero", "ast_zero", "userAcquisitionTimeFW"])
    return Recording(out.meas.withColumns({c: F.col(c).cast("int") for c in ("st", "ast")}), out.series, out.meta, out.headers)
