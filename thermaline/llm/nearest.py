"""Nearest-in-time matching of two streams by entity, as a stateful streaming join.

Both sides are buffered per entity. A left row is emitted once the watermark has passed its time plus the
tolerance, as no reading that could still be nearer can then arrive; right rows are evicted once the
watermark has passed them by twice the tolerance. An entity's time is cut into sections, so a hot entity is spread over
many tasks; right rows near a section's edge go to the neighbouring section as well. The sections of all entities are
hashed into groups, each with one state, and all rows of a group are paired at once.

Stored tables are played to the stream range by range of time, so that the watermark follows the data, pairs leave as soon
as their horizon has passed, and the state holds no more than a range and what its edges need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from thermaline.session import filesystem, work_dir

OUT = T.StructType([T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType()), T.StructField("gap_us", T.LongType())])
#: Spark's watermark starts at 1970 and drops what lies before, so event times are shifted past it, as far as pandas reaches.
FIRST_US, END_US = -2_208_988_800_000_000, 6_942_585_600_000_000
SHIFT_US = 86_400_000_000 - FIRST_US
FIRST_MS, END_MS = (FIRST_US + SHIFT_US) // 1000, (END_US + SHIFT_US) // 1000
#: Rows of a range for each task of a shuffle: what a task may have to hold as state.
ROWS_PER_TASK = 100_000
STATE = T.StructType([T.StructField(n, T.ArrayType(T.StringType() if n[1] == "e" else T.LongType())) for n in ("le", "lt", "li", "re", "rt", "ri")])
#: Groups of states for each task of a shuffle; a group holds the sections of many entities, so that they are worked on together.
GROUPS_PER_TASK = 8


@dataclass
class Rows:
    """Rows of several entities, each once, in order of entity, time and id; ``code`` numbers the entities."""

    code: np.ndarray
    t: np.ndarray
    id: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, t: np.ndarray, i: np.ndarray) -> Rows:
        order = np.lexsort((i, t, code))
        code, t, i = code[order], t[order], i[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        return cls(code[new], t[new], i[new])

    def part(self, keep: np.ndarray) -> Rows:
        return Rows(self.code[keep], self.t[keep], self.id[keep])


def pair(left: Rows, right: Rows, tolerance_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left ids, right ids and gaps of the left rows that have a right row of their entity near; of equal gaps the smaller id wins."""
    n, m = len(left.t), len(right.t)
    if not n or not m:
        return (np.zeros(0, dtype=np.int64),) * 3
    # entity and time as one number, by the rank of the time
    times = np.unique(np.concatenate([left.t, right.t]))
    key = lambda r: r.code.astype(np.int64) * (len(times) + 1) + np.searchsorted(times, r.t)
    lk, rk = key(left), key(right)
    k = np.searchsorted(rk, lk)
    far = np.int64(1) << 62
    after = np.minimum(k, m - 1)  # the first of its time has the smallest id
    gap_a = np.where((k < m) & (right.code[after] == left.code), right.t[after] - left.t, far)
    last = np.maximum(k - 1, 0)
    before = np.searchsorted(rk, rk[last])
    gap_b = np.where((k > 0) & (right.code[last] == left.code), left.t - right.t[last], far)
    use_b = (gap_b < gap_a) | ((gap_b == gap_a) & (right.id[before] < right.id[after]))
    gap, at = np.where(use_b, gap_b, gap_a), np.where(use_b, before, after)
    near = gap <= tolerance_us
    return left.id[near], right.id[at[near]], gap[near]


def _matcher(tolerance_us: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [], [])
        names, stamps, ids, sides = [np.asarray([*held[0], *held[3]], dtype=object)], [np.asarray([*held[1], *held[4]], dtype=np.int64)], [np.asarray([*held[2], *held[5]], dtype=np.int64)], [np.arange(len(held[0]) + len(held[3])) >= len(held[0])]
        for b in batches:
            names.append(b["_e"].to_numpy(dtype=object))
            stamps.append(b["_us"].to_numpy(dtype=np.int64))
            ids.append(b["_id"].to_numpy(dtype=np.int64))
            sides.append(b["_right"].to_numpy(dtype=bool))
        code, entities = pd.factorize(np.concatenate(names))
        t, i, right = np.concatenate(stamps), np.concatenate(ids), np.concatenate(sides)
        lefts, rights = Rows.of(code[~right], t[~right], i[~right]), Rows.of(code[right], t[right], i[right])
        # nothing older than the watermark arrives any more, and nothing at all after the end; before the first year all may
        mark = state.getCurrentWatermarkMs()
        horizon = 1 << 61 if mark >= END_MS - 86_400_000 else mark * 1000 - SHIFT_US if mark >= FIRST_MS else -(1 << 61)
        done = lefts.t < horizon - tolerance_us
        found = pair(lefts.part(done), rights, tolerance_us)
        lefts = lefts.part(~done)
        oldest = np.full(len(entities), horizon, dtype=np.int64)
        np.minimum.at(oldest, lefts.code, lefts.t)
        rights = rights.part(rights.t >= oldest[rights.code] - 2 * tolerance_us)
        if len(lefts.t) or len(rights.t):
            state.update((list(entities[lefts.code]), lefts.t.tolist(), lefts.id.tolist(), list(entities[rights.code]), rights.t.tolist(), rights.id.tolist()))
            wake = int(lefts.t.min()) + tolerance_us if len(lefts.t) else int(rights.t.max()) + 2 * tolerance_us
            state.setTimeoutTimestamp(max(FIRST_MS, min((wake + SHIFT_US) // 1000 + 1, END_MS - 86_400_000), mark + 1))
        elif state.exists:
            state.remove()
        if len(found[0]):
            yield pd.DataFrame(dict(zip(("left_id", "right_id", "gap_us"), found)))

    return step


def _side(df: DataFrame, entity: str, time: str, row_id: str, is_right: bool) -> DataFrame:
    us = F.unix_micros(F.col(time).cast("timestamp"))
    stamp = F.timestamp_micros(F.least(F.greatest(us, F.lit(FIRST_US)), F.lit(END_US)) + F.lit(SHIFT_US))
    return df.select(F.col(entity).cast("string").alias("_e"), us.alias("_us"), F.col(row_id).cast("long").alias("_id"), F.lit(is_right).alias("_right"), stamp.alias("_ts")).filter("_e IS NOT NULL AND _us IS NOT NULL AND _id IS NOT NULL")


def _matched(both: DataFrame, tolerance_us: int, delay: str, section_us: int) -> DataFrame:
    if section_us < 2 * tolerance_us:
        raise ValueError("a section must be at least twice the tolerance long")
    bucket = lambda d: F.expr(f"floor((_us + {d}) / {section_us})")
    sections = F.when(F.col("_right"), F.array_distinct(F.array(bucket(-tolerance_us), bucket(tolerance_us)))).otherwise(F.array(bucket(0)))
    rows = both.withColumn("_s", F.explode(sections)).withWatermark("_ts", delay)
    groups = GROUPS_PER_TASK * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_g", F.pmod(F.xxhash64("_e", "_s"), F.lit(groups))).groupBy("_g").applyInPandasWithState(_matcher(tolerance_us), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def nearest_join_stream(left: DataFrame, right: DataFrame, entity: str, time: str, left_id: str, right_id: str, tolerance_us: int, delay: str, section_us: int = 6 * 3_600_000_000, latest: str | None = None) -> DataFrame:
    """Streaming rows ``(left_id, right_id, gap_us)``: the nearest right row of each left row of the same entity.

    ``left`` and ``right`` are streaming frames; rows later than ``delay`` behind the newest event are dropped as late by
    the watermark. At most ``tolerance_us`` apart, inclusive; of equally near rows the smaller id wins. Rows whose
    entity, time or id is null match nothing; repeated rows count once; left rows without a partner give no row. ``latest`` is
    a time that no sound clock shows yet: rows after it match nothing, so that a broken clock can't move the watermark
    past everything still to come.
    """
    both = _side(left, entity, time, left_id, False).unionByName(_side(right, entity, time, right_id, True))
    if latest is not None:
        both = both.filter(F.col("_us") <= F.unix_micros(F.lit(latest).cast("timestamp")))
    return _matched(both, tolerance_us, delay, section_us)


def nearest_join(left_path: str, right_path: str, spark, entity: str, time: str, left_id: str, right_id: str, tolerance_us: int, keep: str = "true", delay: str = "1 second", section_us: int = 6 * 3_600_000_000, range_rows: int | None = None) -> DataFrame:
    """All pairs of two stored tables, made by the streaming join run over everything available.

    Both tables are laid out by ranges of time of about ``range_rows`` rows (by default ``ROWS_PER_TASK`` for each task of a
    shuffle, so ranges grow with the cluster) and handed to the stream one range after the other, so no row is late; a last row far ahead then moves the watermark past every horizon. Right rows not fulfilling ``keep`` take
    no part. Ranges, state, progress and output lie in the shared folder, so that a lost executor's work is redone from
    there.
    """
    read = lambda path: spark.read.parquet(path)
    both = _side(read(left_path), entity, time, left_id, False).unionByName(_side(read(right_path).filter(keep), entity, time, right_id, True))
    root = work_dir(spark, "nearest")
    range_rows = range_rows or ROWS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-both.count() // range_rows))
    cuts = sorted({int(c) for c in both.approxQuantile("_us", [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []  # as many as ranges
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col("_us")))
    both.withColumn("_range", at).write.partitionBy("_range").parquet(f"{root}/ranges")
    end = spark.sql(f"SELECT '' AS _e, {END_US} AS _us, CAST(-1 AS BIGINT) AS _id, true AS _right, timestamp_micros({END_US + SHIFT_US}) AS _ts")
    end.coalesce(1).write.parquet(f"{root}/ranges/_range={len(cuts) + 1}")

    fs, inbox = filesystem(spark, f"{root}/inbox")
    fs.mkdirs(inbox)
    schema = both.select("_e", "_us", "_id", "_right", "_ts").schema
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k in range(len(cuts) + 2):
        folder = path(f"{root}/ranges/_range={k}")
        if not fs.exists(folder):
            continue
        fs.rename(folder, path(f"{root}/inbox/{k}"))
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/inbox")
        pairs = _matched(rows, tolerance_us, delay, section_us)
        pairs.writeStream.format("parquet").option("path", f"{root}/pairs").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{root}/pairs")
