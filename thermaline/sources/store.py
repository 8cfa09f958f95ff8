"""Recordings as parquet: measurements by day, series, header fields and the sections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.operators.sections import SCHEMA
from thermaline.sources.files import Recording

#: Places of intensities and temperatures are stored as single numbers of four bytes, counts as whole ones.
SMALL = {"double": "float", "bigint": "int"}


def default_encoding(df: DataFrame, keep: tuple[str, ...] = ("x", "time")) -> dict[str, str]:
    """``{column: type}`` to store a frame compactly: doubles as floats and long numbers as ints, but for the columns to keep."""
    return {f.name: SMALL.get(f.dataType.simpleString(), f.dataType.simpleString()) if f.name not in keep else f.dataType.simpleString() for f in df.schema.fields}


def writer_options(compression: str = "zstd", level: int = 6) -> dict[str, str]:
    """Options of the parquet writer for one compression of all columns."""
    return {"compression": compression} | ({"parquet.compression.codec.zstd.level": str(level)} if compression == "zstd" else {})


def sections_text(sections: DataFrame) -> str:
    """Sections as a JSON text of ``{name: [[start, stop], ...]}``, to be kept as one header field."""
    out: dict[str, list] = {}
    for r in sorted(sections.collect(), key=lambda r: (r.section, r.stretch_id)):
        out.setdefault(r.section, []).append([r.x_start, r.x_stop])
    return json.dumps(out)


def sections_of(spark: SparkSession, text: str) -> DataFrame:
    rows = [(name, k, float(a), float(b)) for name, stretches in json.loads(text).items() for k, (a, b) in enumerate(stretches, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def save(recording: Recording, path: str, sections: DataFrame | None = None, encoding: dict[str, str] | None = None, rows_per_file: int = 20_000_000, compression: str = "zstd") -> None:
    """Writes a recording below ``path``, replacing what is there; measurements by day, sorted by time and location in each file."""
    options = writer_options(compression)
    cast = lambda df: df.select(*[F.col(c).cast((encoding or {}).get(c, df.schema[c].dataType.simpleString())).alias(c) for c in df.columns])
    meas = cast(recording.meas).withColumn("day", F.to_date("time"))
    meas.repartition("day").sortWithinPartitions("day", "time", "ix").write.mode("overwrite").options(**options).option("maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(f"{path}/meas")
    cast(recording.series).write.mode("overwrite").options(**options).parquet(f"{path}/series")
    meta = recording.meta
    if sections is not None:
        one = meta.sparkSession.createDataFrame([("_sections", sections_text(sections))], "key string, value string")
        meta = meta.filter("key <> '_sections'").unionByName(one)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    recording.headers.write.mode("overwrite").options(**options).parquet(f"{path}/headers")


def load(spark: SparkSession, path: str) -> tuple[Recording, DataFrame | None]:
    """A stored recording and its sections, if it has any."""
    meta = spark.read.parquet(f"{path}/meta")
    kept = {r.key: r.value for r in meta.filter("key IN ('_sections', 'isDoubleEnded')").collect()}
    rec = Recording(spark.read.parquet(f"{path}/meas").drop("day"), spark.read.parquet(f"{path}/series"), meta.filter("key <> '_sections'"), spark.read.parquet(f"{path}/headers"), kept.get("isDoubleEnded") == "1")
    return rec, sections_of(spark, kept["_sections"]) if "_sections" in kept else None


def described(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """The frame with a comment on each of the columns named, kept in its schema and in parquet."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": texts[c]}) if c in texts else F.col(c) for c in df.columns])

