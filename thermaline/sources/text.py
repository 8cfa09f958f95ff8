"""Text files: tab-separated ``.ddf`` recordings, and ``.tra`` traces."""

from __future__ import annotations

import re
import warnings
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from thermaline.sources.files import Parsed, Recording, assemble, first_file, instant, parse, time_columns

# Layout of the header and tested versions of the recorders' software.
HEADER_LINES = 26
TESTED = {"Halo DTS v1*": True, "Sentinel DTS v5*": True, "ORYX F/W v1.02 Oryx Data Collector v3*": False, "ORYX F/W v4.00 Oryx Data Collector v3*": False}
SERIES = {
    "T ext. ref 1 (°C)": "probe1Temperature", "T ext. ref 2 (°C)": "probe2Temperature", "T internal ref (°C)": "referenceTemperature", "gamma": "gamma_ddf",
    "k internal": "k_internal", "k external": "k_external", "forward acquisition time": "userAcquisitionTimeFW", "reverse acquisition time": "userAcquisitionTimeBW",
}


def ddf_file(name: str, content: bytes) -> Parsed:
    lines = content.decode("windows-1252").splitlines()
    if len(lines) < HEADER_LINES:
        raise ValueError("the header is cut off")
    meta = {}
    for k, line in enumerate(lines[: HEADER_LINES - 1]):
        key, _, value = line.partition(":\t" if k < 4 else "\t")
        meta[key] = value if k < 4 else value.split("\t")[0].replace(",", ".")
    if "Software version number" not in meta:
        raise ValueError("no software version")
    kind = meta.get("differential loss correction")
    names = {"single-ended": ["tmp", "st", "ast"], "combined": ["tmp", "st", "ast", "rst", "rast"]}.get(kind)
    if names is None:
        raise ValueError(f"unknown differential loss correction: {kind!r}")
    rows = [[float(v) for v in line.replace(",", ".").split("\t")[: len(names) + 1]] for line in lines[HEADER_LINES:] if line.strip()]
    values = list(zip(*rows)) or [()] * (len(names) + 1)
    double = kind == "combined"
    series = {n: float(meta[k]) for k, n in SERIES.items() if k in meta}
    meta |= {"isDoubleEnded": str(int(double)), "forwardMeasurementChannel": meta.get("forward channel", "?")[-1], "backwardMeasurementChannel": meta.get("reverse channel", "?")[-1] if double else "N/A"}
    parts = name.split(" ")
    meta["_channel"] = parts[1] if len(parts) > 3 else ""
    return Parsed(f"{meta['date']} {meta['time']}", series, meta, list(values[0]), {n: list(v) for n, v in zip(names, values[1:])}, "".join(parts[2:4]) if len(parts) > 3 else None)


def read_sensornet(spark: SparkSession, paths: str | list[str], zone_files: str = "UTC", zone: str = "UTC", internal: float = 50.0, fiber_length: float | None = None) -> Recording:
    """Files ``*.ddf`` in all folders below a folder, of one channel; their times are wall times of ``zone_files``.

    The fibre is cut to the ``internal`` length before 0 m up to ``fiber_length``, double-ended with as much behind it. The
    length is, if not given, that of the recording, double-ended less the internal length. Backward channels of recorders
    that store them from the far end are turned round; those of others are cut about the end that the header names.
    """
    rows = parse(spark, paths, ".ddf", ddf_file, "sensornet")
    head = first_file(rows).select("names", "x", "meta", F.map_keys("series").alias("keys")).first()
    meta, x = head["meta"], head["x"]
    if rows.select(F.col("meta")["_channel"].alias("c")).distinct().limit(2).count() > 1:
        raise ValueError("the files are of several channels")
    version = meta["Software version number"]
    flip = next((f for pattern, f in TESTED.items() if fnmatch(version, pattern)), None)
    if flip is None:
        warnings.warn(f"version {version} has not been tested", stacklevel=2)
    double = meta["isDoubleEnded"] == "1"
    fw, bw = trimmed(x, internal, fiber_length, double, bool(flip), float(meta["fibre end"]) if double and not flip else None)
    names = head["names"]
    fw_s = F.coalesce(F.col("series")["userAcquisitionTimeFW"], F.lit(0.0))
    bw_s = F.coalesce(F.col("series")["userAcquisitionTimeBW"], F.lit(0.0)) if double else None
    out = assemble(rows, time_columns(instant(F.col("stop"), zone_files), fw_s, bw_s, zone), double, names, sorted(head["keys"]))
    ahead = out.meas.filter(F.col("ix").between(fw.start, fw.stop - 1)).withColumn("ix", (F.col("ix") - fw.start).cast("int"))
    if double:
        turned = F.col("ix") - bw.start if bw.step > 0 else bw.start - F.col("ix")
        lo, hi = (bw.start, bw.stop - 1) if bw.step > 0 else (bw.stop + 1, bw.start)
        back = out.meas.filter(F.col("ix").between(lo, hi)).select(turned.cast("int").alias("ix"), "time", "rst", "rast")
        ahead = ahead.drop("rst", "rast").join(back, ["ix", "time"], "left").select("ix", "x", "time", *names)
    return Recording(ahead, out.series, out.meta, out.headers, double)


def trimmed(x: list[float], internal: float, length: float | None, double: bool, flip: bool, end: float | None) -> tuple[range, range]:
    """Places of the forward and of the backward channel that are kept; the latter may run downwards."""
    near = lambda v: min(range(len(x)), key=lambda i: (abs(x[i] - v), i))
    if length is None:
        length = max(0.0, x[-1] - internal) if double else x[-1]
    if length <= 0:
        raise ValueError(f"the fibre's length is not positive: {length}")
    start, zero, one = near(-internal), near(0.0), near(length)
    inner = zero - start
    stop = min(len(x), one + inner) if double else one
    if not double:
        return range(start, stop), range(0)
    if flip:
        inner = min(inner, max(0, stop - one))
        start, stop = zero - inner, one + inner
        return range(start, stop), range(stop, start, -1)
    at = near(end)
    back = range(max(0, at - (one - zero) - inner), min(len(x), at + (stop - one)))
    return range(start, stop), back if len(back) == stop - start else range(start, stop)


def sniffed(text: str):
    """Truth value, whole number, number or text of a field."""
    if text in ("True", "False"):
        return text == "True"
    if text.isdigit():
        return int(text)
    try:
        return float(text)
    except ValueError:
        return text


def trace_file(name: str, content: bytes) -> Parsed:
    """Sections in brackets of ``key;value`` and, in the trace, of ``number;distance;temperature;ratio;loss``."""
    section, fields, rows = "", {}, []
    for line in content.decode("utf-8-sig", errors="replace").splitlines():
        if not line.strip():
            continue
        if line.startswith("["):
            section = line.strip().strip("[]")
            continue
        parts = line.split(";")
        if section.startswith("Trace.") and parts[0].isdigit() and len(parts) >= 5:
            rows.append([float(v) for v in parts[1:5]])
        elif len(parts) == 2:
            key = parts[0] if section.startswith("Trace.") else f"{section}:{parts[0]}"
            fields[key] = sniffed(parts[1])
    if not any(k.startswith("Date.") for k in fields):
        raise ValueError("no trace with a date")
    x, tmp, ratio, loss = zip(*rows) if rows else ((), (), (), ())
    when = [int(fields[k]) for k in ("Date.Year", "Date.Month", "Date.Day", "Time.Hour", "Time.Minute", "Time.Second")]
    series = {f"probe{k}Temperature": float(fields[f"Ref.Temperature.Sensor.{k}"]) for k in range(1, 5) if f"Ref.Temperature.Sensor.{k}" in fields}
    meta = {k: str(v) for k, v in fields.items()} | {"isDoubleEnded": "1" if fields.get("Trace:DualEnded") is True else "0"}
    stamp = re.search(r"(\d{14})\.tra$", name, re.I)
    return Parsed("{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*when), series, meta, list(x), {"tmp": list(tmp), "log_ratio_by_dts": list(ratio), "loss_by_dts": list(loss)}, stamp.group(1) if stamp else None)


def read_traces(spark: SparkSession, paths: str | list[str], zone: str = "UTC") -> Recording:
    """Files ``*.tra``, in UTC: ``meas(ix, x, time, tmp, log_ratio_by_dts, loss_by_dts)`` and the reference probes."""
    rows = parse(spark, paths, ".tra", trace_file, "traces")
    head = first_file(rows).select("names", F.map_keys("series").alias("keys"), F.col("meta")["isDoubleEnded"].alias("double")).first()
    return assemble(rows, {"time": F.from_utc_timestamp(instant(F.col("stop"), "UTC"), zone)}, head["double"] == "1", head["names"], sorted(head["keys"]))
