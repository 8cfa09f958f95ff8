"""Consolidating far too many small files, each record kept once.

A checkpointed stream discovers each file once and processes what is available in batches. A batch is written under
its number, replacing whatever an interrupted attempt left there, so a retry never duplicates. Records are compared
by value; the first line by file number and line keeps a record. As a record may come again in any later batch, the
batches are merged in the end: each record once over all of them, in as few files as the target size allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.session import filesystem, stream_of, work_dir

RECORD = ["device", "record_no", "time_us", "st", "ast"]
#: Bytes that a consolidated file should have at most.
FILE_BYTES = 64 << 20
_NUMBER = r"[+-]?(?:\d+\.?\d*|\d*[.,]\d+|\d+,\d*)(?:[eE][+-]?\d+)?"
_STAMP = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?\s*(?:Z|UTC|[+-]\d\d(?::?\d\d)?)?"
#: One look at a line decides whether it is a record; only records are split.
_LINE = rf"^[^;]*[^;\s][^;]*;\s*\d+\s*;\s*{_STAMP}\s*;\s*{_NUMBER}\s*;\s*{_NUMBER}\s*;\s*$"
_BLANKS = " \t\r\x0b\f"


def _number(c: Column) -> Column:
    return F.translate(c, ",", ".").try_cast("double") + 0.0  # one zero


def records_of(files: DataFrame, file_id: str, body: str) -> DataFrame:
    """Rows ``(device, record_no, time_us, st, ast, file_id, line_no)``, one for each line that is a record.

    A record has five fields, each closed by a semicolon, with blanks around them: a device, a whole number, a UTC time
    and two numbers with decimal comma or point. Lines end with LF or CRLF; all lines count. Null bodies and other
    lines give nothing.
    """
    lines = files.select(F.col(file_id).cast("long").alias("file_id"), F.posexplode(F.split(F.col(body), "\n")).alias("_n", "_line")).filter(F.col("_line").rlike(_LINE))
    part = lines.select("file_id", (F.col("_n") + 1).cast("long").alias("line_no"), F.split("_line", ";").alias("_p"))
    blank = F.lit(_BLANKS)
    fields = part.select("file_id", "line_no", *[F.trim(F.get("_p", F.lit(k)), blank).alias(f"_{k}") for k in range(5)])
    # a time without a zone is UTC; what stands behind the seconds and their fraction is the zone
    zone = F.translate(F.substring("_2", 20, 64), "0123456789. ", "")
    stamp = F.when(zone == "", F.concat("_2", F.lit("Z"))).when(zone.isin("+", "-"), F.regexp_replace("_2", r"([+-]\d\d)(\d\d)$", "$1:$2")).otherwise(F.col("_2"))
    rows = fields.select(F.col("_0").alias("device"), F.col("_1").try_cast("decimal(38,0)").alias("record_no"), F.unix_micros(stamp.try_cast("timestamp")).alias("time_us"), _number(F.col("_3")).alias("st"), _number(F.col("_4")).alias("ast"), "file_id", "line_no")
    return rows.filter("device <> '' AND record_no IS NOT NULL AND time_us IS NOT NULL AND st IS NOT NULL AND ast IS NOT NULL AND file_id IS NOT NULL")


def first_of_each(records: DataFrame) -> DataFrame:
    """Each record once, with the smallest file number and in it the smallest line."""
    first = records.groupBy(*RECORD).agg(F.min(F.struct("file_id", "line_no")).alias("_at"))
    return first.select(*RECORD, "_at.*")


def compact_stream(files: DataFrame, file_id: str, body: str, out: str, progress: str, parts: int | None = None):
    """Starts a query that consolidates a stream of small files into ``out/batch=N``, each record once a batch; see the module."""

    def write(batch: DataFrame, number: int) -> None:
        rows = first_of_each(records_of(batch, file_id, body))
        (rows.coalesce(parts) if parts else rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def merge_batches(batches: DataFrame, n_bytes: int, out: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes each record of all batches once to ``out``, replacing what is there, in files of about ``file_bytes`` at most.

    ``n_bytes`` is the size of the batches as stored; records repeated between them are taken off it before it is divided
    into files. Records are spread over the files by value, so a file is one task and needs no second exchange.
    """
    n = batches.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64(*RECORD), 0.02).alias("kept")).first()
    parts = max(1, math.ceil(n_bytes * min(1.0, n["kept"] / max(n["rows"], 1)) / file_bytes))
    first_of_each(batches.repartition(parts, *RECORD)).write.mode("overwrite").parquet(out)


def compact_table(spark: SparkSession, path: str, file_id: str, body: str, files_per_batch: int = 64, out: str | None = None, file_bytes: int = FILE_BYTES, state: str | None = None) -> DataFrame:
    """All records of a stored table of small files, each once, after the stream has processed everything available.

    The result is the table written to ``out`` (by default a fresh folder of the shared one) by ``merge_batches``; a
    further call for the same ``out`` replaces it. ``state`` is a folder for batches and progress that later calls go on
    from, reading only files that came since; without it, each call reads everything.
    """
    root = state or work_dir(spark, "compact")
    out = out or f"{work_dir(spark, 'compact') if state else root}/table"
    stored = spark.read.parquet(path)
    stream = stream_of(spark, path, stored.schema, files_per_batch)
    compact_stream(stream, file_id, body, f"{root}/batches", f"{root}/progress").awaitTermination()
    schema = first_of_each(records_of(stored, file_id, body)).schema
    found = _exists(spark, f"{root}/batches")
    batches = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/batches") if found else spark.createDataFrame([], schema)
    merge_batches(batches, _bytes(spark, f"{root}/batches") if found else 0, out, file_bytes)
    return spark.read.schema(schema).parquet(out)


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = filesystem(spark, path)
    return fs.getContentSummary(p).getLength()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)
