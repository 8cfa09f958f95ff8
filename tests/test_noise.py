"""Noise variance of synthetic fibres with a known one."""

import warnings
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaline.operators import noise
from thermaline.operators.sections import sections_frame

T0 = datetime(2024, 1, 1)


def fibre(spark, st, x):
    rows = [(i, float(x[i]), T0 + timedelta(seconds=t), float(st[i, t])) for i in range(st.shape[0]) for t in range(st.shape[1])]
    return spark.createDataFrame(rows, "ix int, x double, time timestamp, st double")


def signal(nx=100, nt=60, low=3000.0, seed=0, var=lambda s: 5.0 + 0 * s):
    x = np.linspace(0, 20, nx)
    clean = np.linspace(low, 4000, nt)[None, :] * np.exp(-0.001 * x)[:, None]
    return x, clean, clean + np.random.default_rng(seed).standard_normal(clean.shape) * np.sqrt(var(clean))


@pytest.mark.parametrize("estimate", [noise.variance_constant, noise.variance_exponential])
def test_constant_variance_is_found(spark, estimate):
    x, _, st = signal()
    found = estimate(fibre(spark, st, x), sections_frame(spark, {"a": [(0, 8)], "b": [(8.05, 20)]}), "st")
    assert abs(found.variance - 5.0) < 0.25 and found.residuals.count() == st.size


def test_product_residuals_equal_those_of_the_leading_singular_vectors(spark):
    x, _, st = signal(20, 15, seed=3)
    u, s, v = np.linalg.svd(st)
    want = s[0] * np.outer(u[:, 0], v[0]) - st
    rows = noise.variance_constant(fibre(spark, st, x), sections_frame(spark, {"a": [(0, 20)]}), "st", rounds=4).residuals.collect()
    assert max(abs(r.resid - want[r.ix, int((r.time - T0).total_seconds())]) for r in rows) < 1e-8


def test_linear_variance_and_its_function(spark):
    x, clean, st = signal(200, 100, 500.0, 1, lambda s: 0.01 * s)
    meas, sections = fibre(spark, st, x), sections_frame(spark, {"a": [(0, 20)]})
    zero = noise.variance_linear(meas, sections, "st", nbin=10, through_zero=True)
    assert abs(zero.slope - 0.01) < 5e-4 and zero.offset == 0.0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        line = noise.variance_linear(meas, sections, "st", nbin=100)
    assert abs(line.slope - 0.01) < 1e-3 and abs(line.offset) < 2.0
    assert [r.n for r in line.bins.collect()] == [200] * 100
    got = meas.select((line.function()(F.col("st"))).alias("v"), "st").first()
    assert got.v == pytest.approx(got.st * line.slope + line.offset)


def test_bins_are_lowered_until_they_divide(spark):
    x, _, st = signal(7, 11)
    found = noise.variance_constant(fibre(spark, st, x), sections_frame(spark, {"a": [(0, 20)]}), "st")
    assert [r.n for r in noise.linear_bins(found, 50).collect()] == [7] * 11


def test_a_negative_offset_warns(spark):
    x, _, st = signal(50, 40, 500.0, 2, lambda s: 1e-5 * s * s)
    with pytest.warns(UserWarning, match="negative"):
        noise.variance_linear(fibre(spark, st, x), sections_frame(spark, {"a": [(0, 20)]}), "st", nbin=20)


def test_missing_readings_are_left_out_and_residuals_are_null_outside(spark):
    x, _, st = signal(30, 20)
    meas = fibre(spark, st, x).withColumn("st", F.when(F.col("ix") == 3, None).when(F.col("ix") == 4, float("nan")).when(F.col("ix") == 5, -1.0).otherwise(F.col("st")))
    found = noise.variance_constant(meas, sections_frame(spark, {"a": [(0, 10)]}), "st")
    every = found.everywhere(meas)
    assert every.count() == 600 and every.filter("resid IS NOT NULL").count() == found.residuals.count() == 12 * 20
    assert noise.variance_exponential(meas.limit(0), sections_frame(spark, {"a": [(0, 10)]}), "st").variance is None


def test_acquisition_times(spark):
    times = lambda *v: spark.createDataFrame([(x,) for x in v], "dt double")
    noise.check_acquisition(times(10.0, 10.4, None), "dt")
    noise.check_acquisition(times(), "dt")
    with pytest.raises(ValueError, match="differ"):
        noise.check_acquisition(times(10.0, 10.6), "dt")


def test_ranks_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.v == r.k for r in noise.ranked(df, ["v"], "k").collect())
    assert noise.ranked(df.limit(0), ["v"], "k").count() == 0
