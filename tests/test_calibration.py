"""Calibration of exact and noisy synthetic fibres, and against the same problem solved as one dense matrix."""

import numpy as np
import pytest

from physics import AM, AP, GAMMA, by_cell, fibre
from thermaline.operators import arrowhead
from thermaline.operators.calibration import Design, _gather, calibrate_double, calibrate_single, geometry, with_variance
from thermaline.operators.sections import sections_frame


def plan(nx=40, nt=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.linspace(0, 100, nx)
    cold, warm = 277 + rng.random(nt), 300 + rng.random(nt)
    temps = np.repeat(288.0 + 3 * np.sin(x / 9)[:, None], nt, axis=1)
    temps[x <= 20] = cold
    temps[(x >= 30) & (x <= 45)] = warm
    temps[(x >= 80)] = cold
    return x, temps, {"cold": cold, "warm": warm}, {"cold": [(0, 20), (80, 100)], "warm": [(30, 45)]}


def check(got, temps, tol):
    assert max(abs(v[0] + 273.15 - temps[i, t]) for (i, t), v in got.items()) < tol and len(got) == temps.size


def test_single_exact(spark):
    x, temps, series, sec = plan()
    meas, probes = fibre(spark, temps, x, series=series)
    r = calibrate_single(meas, probes, sections_frame(spark, sec), 1.0, 1.0)
    assert abs(r.params["gamma"] - GAMMA) < 1e-8 and abs(r.params["dalpha"] - (AP - AM)) < 1e-10
    check(by_cell(r.temperature, "tmpf"), temps, 1e-7)


@pytest.mark.parametrize("fixed", ["gamma", "dalpha", "both", "alpha"])
def test_single_fixed(spark, fixed):
    x, temps, series, sec = plan()
    meas, probes = fibre(spark, temps, x, series=series)
    kw = {"fix_gamma": (GAMMA, 0.0)} if fixed in ("gamma", "both") else {}
    kw |= {"fix_dalpha": (AP - AM, 0.0)} if fixed in ("dalpha", "both") else {}
    if fixed == "alpha":
        kw = {"fix_alpha": spark.createDataFrame([(i, float((AP - AM) * x[i]), 0.0) for i in range(len(x))], "ix int, alpha double, alpha_var double")}
    r = calibrate_single(meas, probes, sections_frame(spark, sec), 1.0, 1.0, **kw)
    check(by_cell(r.temperature, "tmpf"), temps, 1e-7)


def test_single_splices_and_matching(spark):
    x, temps, series, _ = plan()
    nt = temps.shape[1]
    loss = np.ones(temps.shape)
    drop = np.linspace(0.8, 0.95, nt)
    loss[x >= 60] *= drop
    temps[(x >= 62) & (x <= 72)] = temps[(x >= 8) & (x <= 18)][::-1]
    meas, probes = fibre(spark, temps, x, loss_fw=loss, series=series)
    r = calibrate_single(meas, probes, sections_frame(spark, {"cold": [(0, 20)], "warm": [(30, 45)]}), 1.0, 1.0, matching=[((8, 18), (62, 72), True)], trans_att=[60.0])
    check(by_cell(r.temperature, "tmpf"), temps, 1e-7)
    ta = [p.talpha_fw[0] for p in r.params_t.orderBy("time").collect()]
    assert np.allclose(ta, -np.log(drop), atol=1e-9)


@pytest.mark.parametrize("mode", ["free", "gamma", "alpha", "both"])
def test_double_exact(spark, mode):
    x, temps, series, sec = plan()
    meas, probes = fibre(spark, temps, x, series=series)
    kw = {"fix_gamma": (GAMMA, 0.0)} if mode in ("gamma", "both") else {}
    if mode in ("alpha", "both"):
        kw["fix_alpha"] = spark.createDataFrame([(i, float((AP - AM) * x[i]), 0.0) for i in range(len(x))], "ix int, alpha double, alpha_var double")
    r = calibrate_double(meas, probes, sections_frame(spark, sec), 1e-7, 1e-7, 1e-7, 1e-7, **kw)
    assert abs(r.params["gamma"] - GAMMA) < 1e-8
    alpha = {p.ix: p.alpha for p in r.params_x.collect()}
    assert max(abs(a - (AP - AM) * x[i]) for i, a in alpha.items()) < 1e-9
    for c in ("tmpf", "tmpb", "tmpw"):
        check(by_cell(r.temperature, c), temps, 1e-6)


@pytest.mark.parametrize("mode", ["free", "gamma", "alpha", "both"])
def test_double_splice_and_matching(spark, mode):
    x, temps, series, _ = plan()
    nt = temps.shape[1]
    fw, bw = np.ones(temps.shape), np.ones(temps.shape)
    fw[x >= 50] *= np.linspace(0.9, 0.8, nt)
    bw[x < 50] *= np.linspace(0.8, 0.85, nt)
    temps[(x >= 62) & (x <= 72)] = temps[(x >= 8) & (x <= 18)][::-1]
    meas, probes = fibre(spark, temps, x, loss_fw=fw, loss_bw=bw, series=series)
    kw = {"fix_gamma": (GAMMA, 0.0)} if mode in ("gamma", "both") else {}
    if mode in ("alpha", "both"):
        kw["fix_alpha"] = spark.createDataFrame([(i, float((AP - AM) * x[i]), 0.0) for i in range(len(x))], "ix int, alpha double, alpha_var double")
    r = calibrate_double(meas, probes, sections_frame(spark, {"cold": [(0, 20)], "warm": [(30, 45)]}), 1.0, 1.0, 1.0, 1.0, matching=[((8, 18), (62, 72), True)], trans_att=[50.0], **kw)
    for c in ("tmpf", "tmpb", "tmpw"):
        check(by_cell(r.temperature, c), temps, 1e-6)


@pytest.mark.parametrize("double", [False, True])
def test_noisy_fit_equals_the_dense_solution(spark, double):
    x, temps, series, sec = plan(nx=30, nt=5, seed=3)
    meas, probes = fibre(spark, temps, x, noise=2.0, series=series, seed=4)
    sec = sections_frame(spark, sec)
    var = {"st": lambda s: s * 0.01, "ast": 4.0, "rst": 3.0, "rast": 2.0}
    kw = {"trans_att": [60.0], "matching": [((8, 18), (82, 92), True)]}
    rows = meas
    for k, v in var.items():
        rows = with_variance(rows, k, v)
    if double:
        r = calibrate_double(meas, probes, sec, *var.values(), **kw)
    else:
        r = calibrate_single(meas, probes, sec, var["st"], var["ast"], **kw)
    geo = geometry(meas, sec, kw["matching"], kw["trans_att"], double)
    gathered = _gather(rows, probes, geo, double).orderBy("time").toPandas()
    design = Design(geo, r.fit.fixed, double)
    p, cov, err = arrowhead.dense([design.rows(t) for t in gathered.itertuples(index=False)])
    n, m = len(r.fit.shared), len(r.fit.own)
    assert np.allclose(r.fit.value, p[:n], rtol=1e-8, atol=1e-10) and abs(r.fit.err / err - 1) < 1e-7
    assert np.allclose(r.fit.cov, cov[:n, :n], rtol=1e-4, atol=1e-12)
    for k, t in enumerate(r.fit.times.orderBy("time").collect()):
        own = slice(n + k * m, n + (k + 1) * m)
        assert np.allclose(t.p, p[own], rtol=1e-6, atol=1e-8)
        assert np.allclose(np.reshape(t.cov, (m, m)), cov[own, own], rtol=1e-4, atol=1e-12)
        assert np.allclose(np.reshape(t.cross, (m, n)), cov[own, :n], rtol=1e-4, atol=1e-12)
    names = ["tmpf_var", "tmpb_var", "tmpw_var"] if double else ["tmpf_var"]
    assert all(v > 0 for row in by_cell(r.temperature, *names).values() for v in row)


def test_variance_kinds_agree(spark):
    x, temps, series, sec = plan(nx=20, nt=3)
    meas, probes = fibre(spark, temps, x, noise=1.0, series=series)
    sec = sections_frame(spark, sec)
    cells = meas.withColumn("v", meas.st * 0 + 5.0).select("ix", "time", "v")
    kinds = [5.0, lambda s: s * 0 + 5.0, cells, cells.select("ix", "v").distinct(), cells.select("time", "v").distinct()]
    got = [calibrate_single(meas, probes, sec, v, v).params["gamma"] for v in kinds]
    assert np.allclose(got, got[0], rtol=1e-10)


def test_refusals(spark):
    x, temps, series, sec = plan(nx=20, nt=3)
    meas, probes = fibre(spark, temps, x, series=series)
    s = sections_frame(spark, sec)
    with pytest.raises(ValueError, match="positive"):
        calibrate_single(meas, probes, s, -1.0, 1.0)
    with pytest.raises(ValueError, match="positive"):
        calibrate_single(meas.withColumn("st", -meas.st), probes, s, 1.0, 1.0)
    with pytest.raises(ValueError, match="exclude"):
        calibrate_single(meas, probes, s, 1.0, 1.0, fix_dalpha=(0.0, 0.0), fix_alpha=meas)
    with pytest.raises(ValueError, match="different numbers"):
        calibrate_single(meas, probes, s, 1.0, 1.0, matching=[((0, 10), (50, 51), False)])
