"""Mixing sources to target weights.

Each source gets its share of the largest total that no source's cap on repeats forbids. Whole copies are certain;
for the rest, documents are drawn by Pareto order sampling: each document has a random number from its id, and
the documents with the smallest ratio of random odds to inclusion odds are taken until the source's remaining tokens are
reached, so the size of the sample is fixed to within one document. The place where that happens is
found over a histogram of the ranks, then among the documents of one bin; no source is ever sorted as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.llm.tokens import DEFAULT, FOLDER, token_counts
from thermaline.session import written

#: More target rows than this are not taken for a list of sources.
MOST_SOURCES = 10_000


@dataclass
class Mix:
    chosen: DataFrame  # source, doc_id, copies, n_tokens
    report: DataFrame  # one row for each target


def _check(targets: DataFrame) -> None:
    if targets.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")


def mix(sizes: DataFrame, targets: DataFrame, weight: str | None = None, seed: int = 42, bins: int = 4096) -> Mix:
    """Combines ``sizes(doc_id, source, n_tokens)`` by ``targets(source, target_share, max_repeats)``.

    ``chosen`` has each document used, with its number of copies (at most ``max_repeats``); ``report`` has for each target
    its share, the documents and tokens available and used, the copies of each and the share reached. ``weight`` is a positive column
    of ``sizes`` that inclusion is proportional to (by default all alike); documents of weight null or not positive are used for
    whole copies only. Sources not listed and null sources take no part; a listed source without tokens
    contributes nothing and the others keep their proportions. Documents without tokens are not used. Repeated targets
    count once.
    """
    _check(targets)
    goal = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("long").alias("max_repeats"))
    docs = sizes.filter("n_tokens > 0 AND source IS NOT NULL").withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("n_tokens"))).alias("_weighted"))
    plan = goal.join(have, "source")
    total = plan.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("_total"))
    each = F.least(F.col("target_share") * F.col("_total") / F.col("tokens"), F.col("max_repeats").cast("double"))
    plan = plan.crossJoin(F.broadcast(total)).withColumn("copies_each", each).withColumn("_whole", F.floor(F.col("copies_each") + 1e-9)).withColumn("_rest", F.greatest(F.lit(0.0), F.col("copies_each") - F.col("_whole")) * F.col("tokens"))

    # inclusion in proportion to the weight so that the expected tokens are the rest; never quite certain
    ranked = docs.join(F.broadcast(plan.select("source", "_whole", "_rest", "_weighted")), "source")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-9), F.col("_rest") * F.col("_w") / F.col("_weighted")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = ranked.withColumn("_rank", F.when((F.col("_w") > 0) & (F.col("_rest") > 0), odds / (1 + odds))).withColumn("_bin", F.floor(F.col("_rank") * bins))
    filled = ranked.filter("_rank IS NOT NULL").groupBy("source", "_bin", "_rest").agg(F.sum("n_tokens").alias("_n"))
    filled = filled.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_bin")) - F.col("_n"))
    edge = filled.filter("_before <= _rest AND _before + _n > _rest").groupBy("source").agg(F.min(F.struct("_bin", "_before")).alias("_edge"))
    placed = ranked.join(F.broadcast(edge), "source", "left")
    inner = placed.filter("_bin = _edge._bin").withColumn("_sum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    inner = inner.withColumn("_more", (F.col("_edge._before") + F.col("_sum") - F.col("n_tokens") / 2 <= F.col("_rest")).cast("int")).drop("_sum")
    # without an edge the rest takes every document of a weight, or none
    outer = placed.filter("NOT coalesce(_bin = _edge._bin, false)").withColumn("_more", F.coalesce(F.when(F.col("_edge").isNull(), F.col("_rank").isNotNull()).otherwise(F.col("_bin") < F.col("_edge._bin")), F.lit(False)).cast("int"))
    chosen = inner.unionByName(outer).select("source", "doc_id", (F.col("_whole") + F.col("_more")).cast("long").alias("copies"), "n_tokens").filter("copies > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    sums = used.agg(F.sum("used_tokens").alias("_all"))
    report = goal.join(have.drop("_weighted"), "source", "left").join(used, "source", "left").join(plan.select("source", "copies_each"), "source", "left").crossJoin(F.broadcast(sums))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select("source", "target_share", "max_repeats", zero("documents"), zero("tokens"), zero("used_documents"), zero("used_tokens"), zero("most_copies"), F.coalesce("copies_each", F.lit(0.0)).alias("copies_each"), F.coalesce(F.try_divide("used_tokens", "_all"), F.lit(0.0)).alias("actual_share"))
    return Mix(chosen, report)


def mix_corpus(documents: DataFrame, targets: DataFrame, seed: int = 42, name: str = DEFAULT, folder: str = FOLDER, weight: str | None = None) -> Mix:
    """``mix`` of a corpus ``(doc_id, text, source)``, sizes in tokens; texts are encoded once and the sizes written.

    ``weight`` is a column of ``documents`` that inclusion within a source is proportional to; by default it is equal.
    """
    _check(targets)
    listed = F.broadcast(targets.filter("source IS NOT NULL").select("source").distinct())
    columns = ["doc_id", "text", "source"] + ([F.col(weight).cast("double").alias("weight")] if weight else [])
    sizes = token_counts(documents.select(*columns).join(listed, "source", "left_semi"), "doc_id", "text", ["source", "weight"], name, folder)
    return mix(written(sizes, "sizes"), targets, "weight" if weight else None, seed)
