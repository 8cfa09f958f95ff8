"""The streaming nearest-time join against brute force, over several batches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from thermaline.llm.nearest import Rows, nearest_join, nearest_join_stream, pair

TIMES = [datetime(1600, 1, 1), datetime(1899, 12, 31), datetime(1969, 12, 31, 23, 59, 50), datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 0, 30), datetime(2023, 5, 1), datetime(2195, 1, 1)]
TOLERANCE = 5_000_000
T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "run long, l long, time timestamp", "run long, r long, time timestamp"


def brute(left, right, tolerance_s):
    out = set()
    for run, i, t in left:
        near = sorted((abs((t - u).total_seconds()), j) for k, j, u in right if k == run and None not in (k, j, u)) if None not in (run, i, t) else []
        if near and near[0][0] <= tolerance_s:
            out.add((i, near[0][1]))
    return out


def stored(spark, tmp_path, left, right):
    paths = [str(tmp_path / f"{n}.parquet") for n in ("left", "right")]
    for rows, schema, p in zip((left, right), (LEFT, RIGHT), paths):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(p)
    return paths


def joined(spark, tmp_path, left, right, **kw):
    return {(r.left_id, r.right_id) for r in nearest_join(*stored(spark, tmp_path, left, right), spark, "run", "time", "l", "r", TOLERANCE, **kw).collect()}


def test_rows_before_1970_keep_their_pairs(spark, tmp_path):
    left, right = [(1, i, t) for i, t in enumerate(TIMES)], [(1, 100 + i, t + timedelta(seconds=2)) for i, t in enumerate(TIMES)]
    assert joined(spark, tmp_path, left, right) == {(i, 100 + i) for i in range(len(TIMES))}


@pytest.mark.parametrize("range_rows", [1_000_000, 60])
def test_ties_repeats_nulls_and_a_hot_entity_over_several_ranges(spark, tmp_path, range_rows):
    rng = random.Random(1)
    moment = lambda: T0 + timedelta(seconds=rng.randrange(0, 900))
    left = [(rng.choice([1, 1, 2]), i, moment()) for i in range(150)] + [(None, 900, T0), (1, 901, None), (3, 902, T0)]
    right = [(rng.choice([1, 1, 2]), i, moment()) for i in range(120)] + [(1, 500, None), (None, 501, T0)]
    want = brute(left, right, 5)
    assert joined(spark, tmp_path, left * 2, right + right[:40], range_rows=range_rows, section_us=60_000_000) == want and len(want) > 50


def test_empty_sides(spark, tmp_path):
    assert joined(spark, tmp_path, [], [(1, 1, T0)]) == set()
    assert joined(spark, tmp_path, [(1, 1, T0)], []) == set()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def play(spark, tmp_path, batches, delay, **kw):
    """One run of the stream for each batch of (left rows, right rows); what each run adds, and the rows held after it."""
    seen, added, held = set(), [], []
    for left, right in batches:
        for name, rows, schema in (("left", left, LEFT), ("right", right, RIGHT)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        pairs = nearest_join_stream(stream(spark, str(tmp_path / "left"), LEFT), stream(spark, str(tmp_path / "right"), RIGHT), "run", "time", "l", "r", TOLERANCE, delay, **kw)
        q = pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        found = {(r.left_id, r.right_id) for r in spark.read.schema("left_id long, right_id long, gap_us long").parquet(str(tmp_path / "out")).collect()}
        added.append(found - seen)
        seen = found
        held.append(q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress else None)
    return added, held


def at(s):
    return T0 + timedelta(seconds=s)


def test_a_row_waits_for_its_horizon_and_expired_candidates_leave(spark, tmp_path):
    batches = [
        ([(1, 1, at(0))], [(1, 10, at(4))]),  # a nearer one may still come
        ([], [(1, 11, at(1))]),
        ([(2, 2, at(100_000))], [(2, 20, at(100_001))]),  # moves the watermark past the first entity
        ([(2, 3, at(200_000))], [(2, 30, at(200_001))]),
    ]
    added, held = play(spark, tmp_path, batches, "10 seconds")
    assert added[:2] == [set(), set()] and added[2] == {(1, 11)} and added[3] == {(2, 20)}
    assert held[-1] <= 2


def test_late_rows_are_dropped_and_a_broken_clock_moves_nothing(spark, tmp_path):
    far = datetime(2300, 1, 1)
    batches = [([(1, 9, far)], [(1, 90, far)]), ([(1, 1, at(1000))], [(1, 10, at(1001))]), ([(1, 2, at(0))], [(1, 20, at(0))]), ([(1, 3, at(90_000))], [(1, 30, at(90_000))]), ([(1, 4, at(180_000))], [])]
    added, _ = play(spark, tmp_path, batches, "10 seconds", latest="2025-01-01 00:00:00")
    assert set().union(*added) == {(1, 10), (3, 30)}


def paired(left, right, tolerance):
    rows = lambda r: Rows.of(*(np.array([x[k] for x in r], dtype=np.int64) for k in range(3)))
    return sorted(zip(*(a.tolist() for a in pair(rows(left), rows(right), tolerance))))


def test_pairing_of_sorted_rows():
    assert paired([(0, 10, 1)], [(0, 5, 7), (0, 15, 3)], 5) == [(1, 3, 5)]
    assert paired([(0, 10, 1)], [(0, 10, 3), (0, 10, 2)], 5) == [(1, 2, 0)]
    assert paired([(0, 10, 1)], [(0, 4, 9), (0, 4, 2), (0, 20, 1)], 6) == [(1, 2, 6)]
    assert paired([(0, 10, 1)], [(1, 10, 3)], 5) == paired([(0, 10, 1)], [], 5) == paired([], [(0, 1, 1)], 5) == []
    assert paired([(0, -(1 << 60), 1), (1, 1 << 60, 2)] * 2, [(1, (1 << 60) - 1, 5), (0, 1 - (1 << 60), 6)], 1) == [(1, 6, 1), (2, 5, 1)]
