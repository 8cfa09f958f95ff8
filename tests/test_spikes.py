from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from thermaline.operators.spikes import Field, flag_implausible

T0 = datetime(2024, 1, 1)


def test_device_of_mostly_equal_readings_has_a_scatter(spark):
    # one of 40 readings a run is one step of 0.5 up, so less than 15 % of second differences are not zero
    rows, spikes = [], set()
    for run in range(5):
        values = [5.5] * 40
        values[10] = 6.0
        if run < 2:
            values[20] = (14.0, 3.5)[run]
            spikes.add(run * 100 + 20)
        rows += [(run * 100 + i, run, "coarse", T0 + timedelta(seconds=30 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, run long, probe string, time timestamp, v double")
    found = flag_implausible(df, "id", ["run"], "probe", "time", [Field("v", -200.0, 850.0)], 10).collect()
    assert {(r.row_id, r.kind) for r in found} == {(i, "spike") for i in spikes}
    assert all(r.score > 6 for r in found)


def test_device_that_never_changes_has_no_spike(spark):
    rows = [(i, 1, "still", T0 + timedelta(seconds=30 * i), 5.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, run long, probe string, time timestamp, v double")
    assert flag_implausible(df, "id", ["run"], "probe", "time", [Field("v", -200.0, 850.0)], 10).count() == 0


def readings(spark, values, device="d", run=1, start=0, step=30):
    rows = [(start + i, run, device, T0 + timedelta(seconds=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, run long, device string, time timestamp, v double")


def noisy(n, seed=0, scale=0.1):
    return [20 + scale * float(x) for x in np.random.default_rng(seed).standard_normal(n)]


def verdicts(df, stuck=6, **kw):
    return {r.row_id: r.kind for r in flag_implausible(df, "row_id", ["run"], "device", "time", [Field("v", -200.0, 850.0)], stuck, **kw).collect()}


def test_a_level_shift_is_normal_and_hides_no_spike_beside_it(spark):
    v = noisy(200)
    v[100:] = [x + 5 for x in v[100:]]
    assert verdicts(readings(spark, v)) == {}
    v[101] += 4  # one reading after the shift, where the level before it is not calm
    assert verdicts(readings(spark, v)) == {101: "spike"}
    v[99] -= 4
    assert verdicts(readings(spark, v)) == {101: "spike", 99: "spike"}


def test_blocks_of_up_to_three_readings_come_back_and_longer_ones_are_levels(spark):
    v = noisy(200, 1)
    for at, n in ((20, 1), (60, 2), (100, 3), (140, 4)):
        v[at : at + n] = [x + 6 for x in v[at : at + n]]
    assert set(verdicts(readings(spark, v))) == {20, 60, 61, 100, 101, 102}


def test_limits_stuck_runs_repeats_and_missing_readings(spark):
    v = noisy(120, 2)
    v[10], v[20], v[30], v[31] = 850.0, float("nan"), None, 10_000.0
    v[50:56] = [v[50]] * 6
    v[70:75] = [v[70]] * 5
    v[90] = 30.0
    df = readings(spark, v)
    sent_again = df.filter("row_id IN (10, 50, 90)").withColumn("row_id", df.row_id + 1000)
    found = verdicts(df.union(df).union(sent_again))
    want = {10: "limit", 31: "limit", 90: "spike", **dict.fromkeys(range(50, 56), "stuck")}
    assert found == want | {1000 + k: want[k] for k in (10, 50, 90)}


def test_a_hot_series_is_sliced_without_a_change(spark):
    v = noisy(4000, 3)
    rng = np.random.default_rng(4)
    for k in rng.choice(4000, 150, replace=False):
        v[k] += 5
    for k in (500, 1000, 1999, 2500):
        v[k : k + 8] = [v[k]] * 8
    df = readings(spark, v).union(readings(spark, noisy(50, 5), run=2, start=10_000)).withColumn("_slice", F.lit(1)).withColumn("_t", F.lit("x"))
    whole = verdicts(df)
    assert verdicts(df, hot_rows=500) == whole and len(whole) > 150


def test_null_keys_devices_and_times_and_an_empty_table(spark):
    v = noisy(60, 6)
    v[30] = 40.0
    df = readings(spark, v)
    bare = df.withColumns({"run": F.lit(None).cast("long"), "device": F.lit(None).cast("string")})
    assert verdicts(bare) == {30: "spike"}
    assert verdicts(df.withColumn("time", F.when(F.col("row_id") > 5, F.col("time")))) == {30: "spike"}
    assert verdicts(df.limit(0)) == {} and verdicts(df.withColumn("v", F.lit(None).cast("double"))) == {}
