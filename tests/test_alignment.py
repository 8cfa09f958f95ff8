from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from physics import fibre
from thermaline.operators import alignment, resampling

T0 = datetime(2024, 1, 1)


def stamps(spark, seconds):
    return spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in seconds], "time timestamp")


def pairs(spark, fw, bw, **kw):
    rows = alignment.pair_times(stamps(spark, fw), stamps(spark, bw), **kw).collect()
    return sorted(((r.time_fw - T0).total_seconds(), (r.time_bw - T0).total_seconds()) for r in rows)


FW, BW = [0, 60, 120, 180, 240, 300], [20, 80, 140, 200, 260, 320]


@pytest.mark.parametrize(
    ("no_fw", "no_bw", "kept"),
    [((), (), range(6)), ((1,), (), (0, 2, 3, 4, 5)), ((), (1,), (0, 2, 3, 4, 5)), ((1,), (1,), (0, 2, 3, 4, 5)), ((0,), (), (1, 2, 3, 4, 5)), ((), (5,), (0, 1, 2, 3, 4)), ((1, 2), (3,), (0, 4, 5)), ((2,), (1,), (0, 3, 4, 5))],
)
def test_measurements_without_a_partner_are_skipped(spark, no_fw, no_bw, kept):
    fw, bw = [t for k, t in enumerate(FW) if k not in no_fw], [t for k, t in enumerate(BW) if k not in no_bw]
    assert pairs(spark, fw, bw) == [(FW[k], BW[k]) for k in kept]


def test_a_pair_with_an_odd_delay_between_two_alike_is_left_out(spark):
    fw, bw = [0, 60, 120, 180], [20, 110, 140, 200]
    assert pairs(spark, fw, bw) == [(0, 20), (120, 140), (180, 200)]
    assert pairs(spark, fw, bw, verify=False) == list(zip(fw, bw))
    assert pairs(spark, fw, bw, tolerance_s=60) == list(zip(fw, bw))


def test_pairs_across_days_repeated_times_and_none(spark):
    fw = [0, 3 * 86_400, 3 * 86_400, 7 * 86_400 + 5]
    bw = [30, 3 * 86_400 + 30, 7 * 86_400 + 35, 9 * 86_400]
    assert pairs(spark, fw, bw) == [(0, 30), (3 * 86_400, 3 * 86_400 + 30), (7 * 86_400 + 5, 7 * 86_400 + 35)]
    assert pairs(spark, [], [1]) == [] and pairs(spark, [1], []) == []


def both(spark, nx=40, nt=3):
    x = np.arange(nx) * 0.5
    temps = np.repeat(288.0 + 3 * np.sin(x / 3)[:, None], nt, axis=1)
    return fibre(spark, temps, x, series={"cold": temps[0]})[0]


def test_a_shift_and_back_is_the_identity_where_both_are(spark):
    meas = both(spark).cache()
    back = alignment.shift_double_ended(alignment.shift_double_ended(meas, -1), 1)
    want = {(r.x, r.time): (r.st, r.ast, r.rst, r.rast) for r in meas.collect()}
    rows = back.collect()
    assert len(rows) == 38 * 3 and all(want[r.x, r.time] == (r.st, r.ast, r.rst, r.rast) for r in rows)
    assert sorted({r.ix for r in rows}) == list(range(38))


@pytest.mark.parametrize("off", [-3, 0, 4])
def test_the_suggested_shift_undoes_one(spark, off):
    moved = alignment.shift_double_ended(both(spark), off) if off else both(spark)
    got = alignment.suggest_shift(moved, range(-6, 7)).first()
    assert (got.shift1, got.shift2) == (-off, -off)


def test_merging_two_single_ended_recordings(spark):
    meas = both(spark)
    fw = meas.select("ix", "x", "time", "st", "ast")
    bw = meas.select((39 - F.col("ix")).alias("ix"), (19.5 - F.col("x") + 0.2).alias("x"), (F.col("time") + F.expr("INTERVAL 0.4 SECONDS")).alias("time"), F.col("rst").alias("st"), F.col("rast").alias("ast"))
    got = {(r.ix, r.time): (r.st, r.rst, r.rast) for r in alignment.merge_double_ended(fw, bw, 19.5, 0.5).collect()}
    assert got == {(r.ix, r.time): (r.st, r.rst, r.rast) for r in meas.collect()}
    gap = bw.withColumn("st", F.when(~((F.col("ix") == 5) & (F.second("time") == 1)), F.col("st")))
    assert {k[0] for k in {(r.ix,) for r in alignment.merge_double_ended(fw, gap, 19.5, 0.5).collect()}} == set(range(40)) - {34}
    with pytest.raises(ValueError, match="cell"):
        alignment.nearest_places(fw, fw, 1.0, 2.0)


def test_resampled_means_start_at_midnight_and_pass_over_gaps(spark):
    rows = [(0, T0 + timedelta(hours=5, seconds=s), v) for s, v in ((0, 1.0), (46, 3.0), (47, 5.0), (48, None), (120, float("nan")))]
    df = spark.createDataFrame(rows, "ix int, time timestamp, v double")
    start = (5 * 3600) // 47 * 47
    got = [((r.time - T0).total_seconds() - start, r.n, r.v) for r in resampling.resample_mean(df, 47, ["v"]).orderBy("time").collect()]
    want = {}
    for _, t, v in rows:
        want.setdefault(((t - T0).total_seconds() - start) // 47 * 47, []).append(v)
    mean = lambda vs: (lambda ok: sum(ok) / len(ok) if ok else None)([v for v in vs if v is not None and v == v])
    assert got == [(k, len(v), mean(v)) for k, v in sorted(want.items())]


@pytest.mark.parametrize("slice_us", [1_000_000, 3_600_000_000])
def test_interpolation_equals_numpy_within_and_is_null_outside(spark, slice_us):
    rng = np.random.default_rng(0)
    t, v = np.sort(rng.choice(500, 40, replace=False)), rng.random(40)
    ask = np.arange(0, 520, 7)
    series = spark.createDataFrame([(T0 + timedelta(seconds=int(a)), float(b)) for a, b in zip(t, v)] + [(T0, None), (None, 1.0), (T0 + timedelta(seconds=600), float("nan"))], "time timestamp, v double")
    rows = resampling.interpolate(series, stamps(spark, [int(a) for a in ask]).withColumn("k", F.lit("x")), "v", slice_us=slice_us).collect()
    got = {(r.time - T0).total_seconds(): r.v for r in rows}
    for a in ask:
        if t[0] <= a <= t[-1]:
            assert got[a] == pytest.approx(np.interp(a, t, v))
        else:
            assert got[a] is None
    assert all(r.k == "x" for r in rows)


def test_interpolation_by_key_and_of_nothing(spark):
    series = spark.createDataFrame([(1, T0, 0.0), (1, T0 + timedelta(seconds=10), 10.0), (None, T0, 5.0)], "p int, time timestamp, v double")
    at = spark.createDataFrame([(1, T0 + timedelta(seconds=4)), (2, T0), (None, T0)], "p int, time timestamp")
    got = {r.p: r.v for r in resampling.interpolate(series, at, "v", ["p"]).collect()}
    assert got == {1: pytest.approx(4.0), 2: None, None: 5.0}
    assert [r.v for r in resampling.interpolate(series.limit(0), at, "v", ["p"]).collect()] == [None] * 3


def test_selections(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)] + [(None, 3.0, float("nan"))], "ix int, x double, v double")
    assert [r.ix for r in df.filter(resampling.between("x", 2.0, 4.0) & F.col("ix").isNotNull()).orderBy("ix").collect()] == [2, 3, 4]
    assert df.filter(resampling.between("x", None, 1.0)).count() == 2 and df.filter(resampling.between("x")).count() == 11
    assert sorted(r.x for r in resampling.select_ordinals(df.filter("ix IS NOT NULL"), "x", [0, -1]).collect()) == [0.0, 9.0]
    assert sorted(r.ix for r in alignment.whole_locations(df.withColumn("v", F.when(F.col("ix") != 4, F.col("v"))).filter("ix IS NOT NULL"), ["v"]).collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    resampling.check_dims(df, v=("ix", "x"))
    with pytest.raises(ValueError, match="time"):
        resampling.check_dims(df, v=("ix", "time"))
