"""Queries on the corpus and of the streaming join. Encoding can't be expressed in SQL; tests compare it with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.llm.mixing import mix_corpus
from thermaline.llm.nearest import nearest_join
from thermaline.llm.splitting import split_documents
from thermaline.llm.tokens import encode
from thermaline.session import table

TOLERANCE_US = 20_000_000
READING = "pt100_2 IS NOT NULL AND NOT isnan(pt100_2)"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest_join(f"{sf_dir}/series.parquet", f"{sf_dir}/probe_readings.parquet", spark, "run_id", "time", "trace_id", "reading_id", TOLERANCE_US, READING)
    return pairs.select(F.col("left_id").alias("trace_id"), F.col("right_id").alias("reading_id"))


_SQL_P4 = f"""
WITH l AS (SELECT DISTINCT trace_id, run_id, epoch_us(time) AS t FROM series),
r AS (SELECT DISTINCT reading_id, run_id, epoch_us(time) AS t FROM probe_readings WHERE pt100_2 IS NOT NULL AND NOT isnan(pt100_2)),
p AS (SELECT trace_id, reading_id, row_number() OVER (PARTITION BY trace_id ORDER BY abs(l.t - r.t), reading_id) AS k FROM l JOIN r ON l.run_id = r.run_id AND abs(l.t - r.t) <= {TOLERANCE_US})
SELECT trace_id, reading_id FROM p WHERE k = 1
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).chosen


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p9_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with unequal inclusion: in proportion to the files that a commit touches, one more so that none is left out."""
    documents = table(spark, sf_dir, "documents").withColumn("weight", F.coalesce("n_files", F.lit(0)) + 1)
    return mix_corpus(documents, table(spark, sf_dir, "mix_targets"), weight="weight").chosen


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=False).filter("piece_no = 2").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {"p4_found": p4_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_weighted": p9_weighted, "p10_found": p10_found, "p10_pieces": p10_pieces}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _SQL_P4}
