"""Monte Carlo against the propagated variance, and averages against numpy on the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from physics import fibre
from test_calibration import plan
from thermaline.operators import reports, sampling
from thermaline.operators.calibration import External, calibrate_double, calibrate_single
from thermaline.operators.sections import sections_frame


@pytest.fixture(scope="module")
def single(spark):
    x, temps, series, sec = plan(nx=30, nt=6, seed=1)
    meas, probes = fibre(spark, temps, x, noise=1.5, series=series, seed=2)
    return calibrate_single(meas, probes, sections_frame(spark, sec), 2.25, 2.25), probes, sections_frame(spark, sec)


@pytest.fixture(scope="module")
def double(spark):
    x, temps, series, _ = plan(nx=30, nt=6, seed=1)
    temps[(x >= 62) & (x <= 72)] = temps[(x >= 8) & (x <= 18)][::-1]
    meas, probes = fibre(spark, temps, x, noise=1.5, series=series, seed=2)
    sec = sections_frame(spark, {"cold": [(0, 20)], "warm": [(30, 45)]})
    return calibrate_double(meas, probes, sec, *[2.25] * 4, matching=[((8, 18), (62, 72), True)], trans_att=[50.0]), probes, sec


def test_single_ended_samples_spread_as_propagated(spark, single):
    result = single[0]
    mc = sampling.monte_carlo_single(result, 400).join(result.temperature.select("ix", "time", "tmpf_var"), ["ix", "time"])
    ratio = [r.tmpf_mc_var / r.tmpf_var for r in mc.collect()]
    assert 0.95 < np.mean(ratio) < 1.05 and len(ratio) == 180
    assert all(r.tmpf_mc[0] < r.tmpf < r.tmpf_mc[1] for r in mc.collect())


def test_double_ended_samples_spread_as_propagated(spark, double):
    result, _, sec = double
    mc = sampling.monte_carlo_double(result, 400, only_sections=sec).join(result.temperature.select("ix", "time", "x", *[f"tmp{c}_var" for c in "fbw"]), ["ix", "time"])
    rows = mc.collect()
    inside = [r for r in rows if r.tmpf_mc_var is not None]
    assert len(rows) == 180 and len(inside) == 66
    for c in "fbw":
        assert 0.9 < np.mean([r[f"tmp{c}_mc_var"] / r[f"tmp{c}_var"] for r in inside]) < 1.1
    assert all(r.tmpw_mc[0] < r.tmpw < r.tmpw_mc[1] for r in rows)


def test_samples_are_the_same_whenever_and_however_they_are_drawn(spark, single):
    take = lambda df: sorted((r.ix, str(r.time), r.mc, r.tmpf_mc) for r in df.collect())
    one = take(sampling.sample_single(single[0], 3, seed=5))
    assert one == take(sampling.sample_single(single[0], 3, seed=5).repartition(5)) and one != take(sampling.sample_single(single[0], 3, seed=6))
    with pytest.raises(ValueError, match="samples"):
        sampling.sample_single(single[0], 0)


def test_without_parameter_uncertainty_only_noise_is_left(spark, single):
    drawn = sampling.single_statistics(sampling.sample_single(single[0], 400, exclude_parameter_uncertainty=True), ())
    rows = drawn.join(single[0].temperature.select("ix", "time", (F.col("dT_dst") + F.col("dT_dast")).alias("v")), ["ix", "time"]).collect()
    assert 0.95 < np.mean([r.tmpf_mc_var / r.v for r in rows]) < 1.05


def test_given_parameters_are_drawn_by_their_variance(spark):
    x, temps, series, sec = plan(nx=20, nt=3)
    meas, probes = fibre(spark, temps, x, series=series, noise=0.5)
    result = calibrate_single(meas, probes, sections_frame(spark, sec), 1.0, 1.0, fix_gamma=(482.6, 4.0), fix_dalpha=(6.46e-5, 1e-10))
    mc = sampling.monte_carlo_single(result, 500, ()).join(result.temperature.select("ix", "time", "tmpf_var"), ["ix", "time"]).collect()
    assert np.mean([r.tmpf_mc_var for r in mc]) > 1.0


@pytest.mark.parametrize("over", ["time", "x"])
def test_averages_equal_numpy_on_the_same_samples(spark, double, over):
    drawn = sampling.sample_double(double[0], 12).cache()
    f = np.full((12, 30, 6), np.nan)
    b, tf, tb = f.copy(), np.full((30, 6), np.nan), np.full((30, 6), np.nan)
    for r in drawn.collect():
        k = (r.ix, r.time.second)
        f[(r.mc, *k)], b[(r.mc, *k)], tf[k], tb[k] = r.tmpf_mc, r.tmpb_mc, r.tmpf, r.tmpb
    axis = 2 if over == "time" else 1
    key = (lambda r: r.ix) if over == "time" else (lambda r: r.time.second)
    qf, qb = (f - tf).var(axis=0, ddof=1), (b - tb).var(axis=0, ddof=1)
    one = {key(r): r for r in sampling.average(drawn, over, 1, exact=True).collect()}
    move = lambda a: np.moveaxis(a, axis, 1).reshape(12 * a.shape[axis], -1)
    for k, want in enumerate(move(f - tf).var(axis=0, ddof=1)):
        assert one[k].tmpf_avg_var == pytest.approx(want) and one[k].tmpf_avg == pytest.approx(tf.mean(axis=axis - 1)[k])
    assert one[0].tmpf_avg_ci == pytest.approx(np.percentile(move(f)[:, 0], [2.5, 97.5]))
    wf = (1 / qf) / (1 / qf + 1 / qb)
    assert one[0].tmpw_avg == pytest.approx((wf * tf + (1 - wf) * tb).mean(axis=axis - 1)[0])
    two = {key(r): r for r in sampling.average(drawn, over, 2).collect()}
    v = [1 / (1 / q).sum(axis=axis - 1) for q in (qf, qb)]
    m = [(s / q).sum(axis=axis) * w for s, q, w in ((f, qf, v[0]), (b, qb, v[1]))]
    assert [two[k].tmpf_avg for k in sorted(two)] == pytest.approx(m[0].mean(axis=0)) and [two[k].tmpb_avg_var for k in sorted(two)] == pytest.approx(v[1])
    w = (m[0] / v[0] + m[1] / v[1]) / (1 / v[0] + 1 / v[1])
    assert two[0].tmpw_avg_ci == pytest.approx(np.percentile(w[:, 0], [2.5, 97.5])) and two[0].tmpw_avg_var == pytest.approx(1 / (1 / v[0][0] + 1 / v[1][0]))
    with pytest.raises(ValueError, match="kind"):
        sampling.average(drawn, over, 3)


def test_precedence_of_selections(spark, single):
    drawn = sampling.sample_single(single[0], 2)
    first = drawn.agg(F.min("time")).first()[0]
    assert sampling.selected(drawn, time_sel=(first, first), x_sel=(0.0, 1.0)).count() == 60
    assert sampling.selected(drawn, time_isel=[0, -1], x_isel=[0]).count() == 120
    assert sampling.selected(drawn, x_sel=(0.0, 10.0), x_isel=[0]).count() == 3 * 6 * 2
    assert sampling.selected(drawn, x_isel=[0]).count() == 12 and sampling.selected(drawn).count() == 360


def test_percentiles_of_arrays(spark):
    rows = spark.createDataFrame([([3.0, 1.0, None, 2.0],), ([],), ([5.0],), (None,)], "v array<double>")
    got = [r[0] for r in rows.select(sampling.percentiles(F.col("v"), (0, 25, 100))).collect()]
    assert got[0] == [1.0, 1.5, 3.0] and got[1] == [None] * 3 and got[2] == [5.0] * 3


def test_parameters_given_from_elsewhere_return_the_same_temperatures(spark, single):
    result, probes, sec = single
    meas = result.temperature.select("ix", "x", "time", "st", "ast")
    given = External({"gamma": result.fit.get("gamma"), "dalpha": result.fit.get("dalpha")}, result.params_t.select("time", "c"))
    again = calibrate_single(meas, probes, sec, 2.25, 2.25, external=given).temperature
    both = again.join(result.temperature.select("ix", "time", F.col("tmpf").alias("was")), ["ix", "time"])
    assert both.count() == 180 and both.filter("abs(tmpf - was) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="lack"):
        calibrate_single(meas, probes, sec, 2.25, 2.25, external=External({}, result.params_t.select("time", "c")))


def test_parameter_tables(spark, double):
    fit = double[0].fit
    val = fit.p_val().collect()
    assert len(val) == len(fit.shared) + 6 * len(fit.own) and {r.name for r in val if r.time is None} == set(fit.shared)
    cov = fit.p_cov().filter("name = other").collect()
    by = {(r.name, r.time): r.var for r in val}
    assert all(r.cov == pytest.approx(by[r.name, r.time], abs=1e-15) for r in cov)


def test_reports(spark, single, double):
    result, probes, sec = single
    res = reports.residuals(result.temperature, probes, sec)
    assert abs(np.mean([r.mean for r in reports.spread(res, "x").collect()])) < 0.2 and reports.spread(res, "time").count() == 6
    sigma = reports.sigma_report(result.temperature, probes, sec).collect()
    assert len(sigma) == 3 and all(0.5 < r.sigma_seen / r.sigma_claimed < 2 for r in sigma)
    assert reports.accuracy(result.temperature, probes, sec).count() == 18
    werr = reports.location_residuals(double[0], double[1], double[2]).collect()
    assert np.std([r.werr_f for r in werr]) == pytest.approx(1.0, abs=0.35)
    limits = reports.colour_limits(result.temperature, "tmpf").first()
    assert limits.low < limits.high
