"""What all readers share: finding files, parsing each once on the executors, and laying out what they hold.

A file is one measurement. It is parsed whole by a function of its name and bytes, on the executor that reads it, into one
row of arrays; these rows are written to the shared folder once. Measurements, time series and header fields are then
column-pruned reads of that table. Archives are opened on the executors as well. Nothing of a file passes through the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.session import written

ROW = "file string, stamp string, stop string, series map<string,double>, meta map<string,string>, x array<double>, names array<string>, columns array<array<double>>, error string"
SIGNALS = ("st", "ast", "rst", "rast", "tmp")


@dataclass
class Parsed:
    """One file: the text of its end time, numbers of the measurement, header fields, locations, and columns along the fibre."""

    stop: str
    series: dict[str, float]
    meta: dict[str, str]
    x: list[float]
    columns: dict[str, list[float]]
    stamp: str | None = None


@dataclass
class Recording:
    """``meas(ix, x, time, <columns>)``, ``series(time, ...)``, ``meta(key, value)`` of the first file and ``headers(file, time, key,
    value)`` of all of them."""

    meas: DataFrame
    series: DataFrame
    meta: DataFrame
    headers: DataFrame
    double_ended: bool = False
    extra: dict = field(default_factory=dict)


def members(name: str, content: bytes, suffix: str) -> Iterator[tuple[str, bytes]]:
    """The file itself, or the members of an archive with the suffix; folders and names that begin with ``_`` are passed over."""
    if not name.lower().endswith(".zip"):
        yield name, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in sorted(z.namelist()):
            base = m.rsplit("/", 1)[-1]
            if not m.endswith("/") and not m.startswith("_") and not base.startswith("_") and base.lower().endswith(suffix):
                yield base, z.read(m)


def parse(spark: SparkSession, paths: str | list[str], suffix: str, read: Callable[[str, bytes], Parsed], label: str) -> DataFrame:
    """One row for each file (see ``ROW``), written once. ``paths`` is a folder (searched in all its folders), a list of files, or archives.

    No file at all raises; a file that can't be read raises with its name and what is wrong.
    """
    source = spark.read.format("binaryFile")
    if isinstance(paths, str) and not paths.lower().endswith((suffix, ".zip")):
        source, paths = source.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}"), [paths]
    files = source.load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                for name, raw in members(path.rsplit("/", 1)[-1], bytes(content), suffix):
                    try:
                        p = read(name, raw)
                        row = (name, p.stamp, p.stop, p.series, p.meta, p.x, list(p.columns), list(p.columns.values()), None)
                    except Exception as e:  # noqa: BLE001 - reported with the file's name by the driver
                        row = (name, None, None, {}, {}, [], [], [], f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=[c.split()[0] for c in ROW.split(", ")])

    rows = written(files.mapInPandas(run, ROW), label)
    sizes = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.count_distinct("names").alias("kinds"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "file", "error"))).alias("bad")).first()
    if not sizes["n"]:
        raise FileNotFoundError(f"no *{suffix} file in {paths}")
    if sizes["bad"]:
        raise ValueError(sizes["bad"])
    if sizes["kinds"] > 1:
        raise ValueError("the files hold different columns")
    if sizes["lo"] != sizes["hi"]:
        raise ValueError(f"the files hold between {sizes['lo']} and {sizes['hi']} locations: are they mixed up?")
    return rows


def first_file(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file").limit(1)


def instant(text: Column, zone: str | None) -> Column:
    """UTC time of a text: as it says if it has an offset, else in ``zone``."""
    stamp = F.regexp_replace(F.trim(text), r"^(\d{4})/(\d\d)/(\d\d) ", "$1-$2-$3 ")
    wall = F.to_timestamp(stamp)
    has_zone = stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(has_zone, wall).otherwise(F.to_utc_timestamp(F.to_timestamp(F.concat(stamp, F.lit("Z"))), zone or "UTC"))


def time_columns(stop: Column, fw_s: Column, bw_s: Column | None = None, zone: str = "UTC") -> dict[str, Column]:
    """Start, middle and end of a measurement from the end of its forward part, with both parts' acquisition times in seconds.

    Single-ended, ``time`` is the middle; double-ended, the backward part follows the forward one and ``time`` is where they
    meet. Times are wall times of ``zone``. Acquisition times count in whole seconds.
    """
    us = F.unix_micros(stop)
    at = lambda offset: F.from_utc_timestamp(F.timestamp_micros(us + offset.cast("long")), zone)
    fw = F.floor(fw_s) * 1_000_000
    zero = F.lit(0)
    if bw_s is None:
        return {"timestart": at(-fw), "timeend": at(zero), "time": at(-fw / 2), "acquisitiontimeFW": F.floor(fw_s).cast("double")}
    bw = F.floor(bw_s) * 1_000_000
    return {
        "timeFWstart": at(-fw), "timeFWend": at(zero), "timeFW": at(-fw / 2), "timeBWstart": at(zero), "timeBWend": at(bw), "timeBW": at(bw / 2),
        "timestart": at(-fw), "timeend": at(bw), "time": at(zero), "acquisitiontimeFW": F.floor(fw_s).cast("double"), "acquisitiontimeBW": F.floor(bw_s).cast("double"),
    }


def assemble(rows: DataFrame, times: dict[str, Column], double_ended: bool, names: list[str], series: list[str], strings: list[str] = ()) -> Recording:
    """Lays out parsed files; locations are those of the first file. ``names`` are the columns along the fibre, ``series`` the numbers by time."""
    timed = rows.withColumns(times)
    where = first_file(rows).select(F.posexplode("x").alias("ix", "x"))
    cells = timed.select("time", F.posexplode(F.arrays_zip(*[F.get("columns", F.lit(i)).alias(n) for i, n in enumerate(names)])).alias("ix", "_c")).select("ix", "time", *[F.col("_c")[n].alias(n) for n in names])
    meas = cells.join(F.broadcast(where), "ix").select("ix", "x", "time", *names)  # one file's locations
    others = [k for k in times if k != "time"]
    out = timed.select("time", *others, *[F.col("series")[s].alias(s) for s in series], *[F.col("meta")[s].alias(s) for s in strings], F.col("stamp").alias("filename_tstamp"), F.col("file").alias("filename"))
    meta = first_file(rows).select(F.explode("meta").alias("key", "value"))
    headers = timed.select("file", "time", F.explode("meta").alias("key", "value"))
    return Recording(meas, out, meta, headers, double_ended)


def external_series(spark: SparkSession, paths: str | list[str], time: str, zone: str = "UTC", columns: dict[str, str] | None = None) -> DataFrame:
    """``(time, <columns>)`` of CSV files with a header, with wall times of ``zone`` brought to UTC; ``columns`` renames value columns."""
    raw = spark.read.option("header", "true").option("mode", "FAILFAST").csv(paths)
    names = columns or {c: c for c in raw.columns if c != time}
    return raw.select(instant(F.col(f"`{time}`"), zone).alias("time"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
