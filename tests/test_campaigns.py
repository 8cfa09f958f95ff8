import numpy as np
import pytest
from pyspark.sql import functions as F

from physics import fibre
from test_calibration import plan
from thermaline.operators.calibration import calibrate_single
from thermaline.operators.campaigns import calibrate_campaigns
from thermaline.operators.sections import sections_frame


@pytest.fixture(scope="module")
def campaigns(spark):
    """Three runs of two devices whose sections lie elsewhere; the third run has a null key."""
    meas = series = None
    single = {}
    for run, seed in ((1, 1), (2, 2), (None, 3)):
        x, temps, baths, sec = plan(nx=40, nt=5, seed=seed)
        m, s = fibre(spark, temps, x, noise=1.0, series=baths, seed=seed)
        device = "b" if run == 2 else "a"
        m = m.select("ix", (F.col("x") + (100.0 if device == "b" else 0.0)).alias("x"), "time", "st", "ast", F.lit(run).cast("long").alias("run"), F.lit(device).alias("device"))
        s = s.withColumn("run", F.lit(run).cast("long"))
        off = 100.0 if device == "b" else 0.0
        cut = sections_frame(spark, {n: [(p + off, q + off) for p, q in v] for n, v in sec.items()})
        result = calibrate_single(m.drop("run", "device"), s.drop("run"), cut, 1.0, 2.0)
        single[run] = (result.params, {(r.ix, r.time): (r.tmpf, r.tmpf_var) for r in result.temperature.collect()}, {r.time: (r.c, r.c_var) for r in result.params_t.collect()})
        meas, series = (m, s) if meas is None else (meas.unionByName(m), series.unionByName(s))
        cuts = cut.withColumn("device", F.lit(device)) if run == 1 else cuts.unionByName(cut.withColumn("device", F.lit(device))) if run == 2 else cuts  # noqa: F821
    return meas.cache(), series.cache(), cuts, single


def test_each_campaign_equals_its_own_calibration(spark, campaigns):
    meas, series, cuts, single = campaigns
    got = calibrate_campaigns(meas, series, cuts, ["run"], 1.0, 2.0, "device")
    params = {r.run: r for r in got.params.collect()}
    assert params.keys() == single.keys()
    for run, (want, _, _) in single.items():
        assert params[run].gamma == pytest.approx(want["gamma"], rel=1e-9) and params[run].dalpha_var == pytest.approx(want["dalpha_var"], rel=1e-6)
        assert params[run].times == 5
    rows = got.temperature.collect()
    assert len(rows) == 600
    for r in rows:
        assert (r.tmpf, r.tmpf_var) == pytest.approx(single[r.run][1][r.ix, r.time], rel=1e-6)
    for r in got.params_t.collect():
        assert (r.c, r.c_var) == pytest.approx(single[r.run][2][r.time], rel=1e-6)


def test_what_is_missing_takes_no_part_and_all_rows_stay(spark, campaigns):
    meas, series, cuts, _ = campaigns
    bad = meas.withColumn("st", F.when(F.col("ix") == 0, None).when(F.col("ix") == 1, float("nan")).when(F.col("ix") == 2, -1.0).otherwise(F.col("st"))).withColumn("_w", F.lit("clash"))
    lost = series.filter("NOT (run <=> 1 AND second(time) = 3)").withColumn("cold", F.when(F.col("run").eqNullSafe(2) & (F.second("time") == 1), 10_000.0).otherwise(F.col("cold")))
    rows = calibrate_campaigns(bad, lost, cuts, ["run"], 1.0, 2.0, "device").temperature.collect()
    assert len(rows) == 600 and all(r._w == "clash" for r in rows)
    assert all((r.tmpf is None) == (r.ix in (0, 1, 2) or (r.run == 1 and r.time.second == 3)) for r in rows)


def test_a_campaign_that_cannot_be_solved_and_an_empty_table(spark, campaigns):
    meas, series, cuts, _ = campaigns
    one = calibrate_campaigns(meas, series, cuts.filter("section = 'warm'").withColumn("x_stop", F.col("x_start") + 0.1), ["run"], 1.0, 2.0, "device")
    assert all(r.gamma is None for r in one.params.collect()) and one.temperature.filter("tmpf IS NOT NULL").count() == 0 and one.temperature.count() == 600
    none = calibrate_campaigns(meas.limit(0), series, cuts, ["run"], 1.0, 2.0, "device")
    assert none.params.count() == none.temperature.count() == 0
    assert np.isfinite([r.gamma for r in calibrate_campaigns(meas.filter("device = 'a'"), series, cuts.filter("device = 'a'").drop("device"), ["run"], 1.0, 2.0).params.collect()]).all()
