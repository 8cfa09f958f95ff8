from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thermaline.operators import calibration
from thermaline.operators import sections as sec

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def meas(spark):
    return spark.createDataFrame([(i, float(i), T0 + timedelta(seconds=t), float(10 * i + t), float(i)) for i in range(20) for t in range(3)], "ix int, x double, time timestamp, st double, ast double").cache()


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(T0 + timedelta(seconds=t), 1.0 + t, 2.0 * t, "label") for t in range(3)], "time timestamp, cold double, warm double, note string")


def frame(spark, **kw):
    return sec.sections_frame(spark, kw)


def test_definitions(spark):
    assert frame(spark, b=[(1, 2), (4, 5)], a=[(0, 0)]).count() == 3
    for bad in ({}, [], {"a": []}, {"a": [(2, 1)]}, {"a": [(1,)]}, {1: [(0, 1)]}, {"a": "x"}):
        with pytest.raises((ValueError, TypeError)):
            sec.validate_definition(bad)


def test_overlaps_touching_and_nested(spark):
    assert sec.overlaps(frame(spark, a=[(0, 5)], b=[(5, 8)])).count() == 0
    assert [r.section for r in sec.overlaps(frame(spark, a=[(0, 9)], b=[(5, 6)], c=[(8, 9)])).orderBy("section").collect()] == ["b", "c"]


def test_validation(spark, meas, series):
    where = meas.select("x").distinct()
    sec.validate(frame(spark, cold=[(0, 5)], warm=[(5, 9)]), series, where)
    for bad, text in (({"cold": [(0, 5)], "warm": [(4, 9)]}, "overlap"), ({"other": [(0, 5)]}, "no temperature series"), ({"cold": [(3.2, 3.8)]}, "no location")):
        with pytest.raises(ValueError, match=text):
            sec.validate(frame(spark, **bad), series, where)
        with pytest.raises(ValueError, match=text.replace("no location", "holds no location")):
            calibration.geometry(meas, frame(spark, **bad), None, [], False, series)
    assert calibration.geometry(meas, frame(spark, cold=[(0, 5)], warm=[(4, 9)]), None, [], False, series, check=False).ref


def test_members_are_inclusive_and_a_shared_end_belongs_to_both(spark, meas):
    got = sec.members(meas, frame(spark, cold=[(2, 4)], warm=[(4, 5)])).groupBy("section", "ix").count().collect()
    assert {(r.section, r.ix) for r in got} == {("cold", 2), ("cold", 3), ("cold", 4), ("warm", 4), ("warm", 5)} and {r["count"] for r in got} == {3}


def test_statistics_at_each_level(spark, meas, series):
    s = frame(spark, cold=[(0, 1), (4, 5)], warm=[(8, 9)])
    stat = lambda **kw: sorted(tuple(r) for r in sec.section_statistic(meas, s, "st", **kw).collect())
    assert stat(func=F.count) == [("cold", 1, 6), ("cold", 2, 6), ("warm", 1, 6)]
    assert stat(func=F.min, calc_per="section") == [("cold", 0.0), ("warm", 80.0)]
    assert stat(func=F.max, calc_per="all") == [(92.0,)]
    assert [r[5] for r in stat(subtract="ast") if r[2] == 4] == [36.0, 37.0, 38.0]
    assert [r[5] for r in stat(temp_err=True, series=series) if r[2] == 4] == [39.0, 39.0, 39.0]
    assert [r[5] for r in stat(ref_temp=True, series=series) if r[2] == 8] == [0.0, 2.0, 4.0]
    levels = {(r.section, r.stretch_id): (r.n, r.mean) for r in sec.statistic_at_all_levels(meas, s, "st").collect()}
    assert levels["cold", 1] == (6, 6.0) and levels["cold", None] == (12, 26.0) and levels[None, None][0] == 18


def test_variance_has_n_minus_one(spark, meas):
    got = sec.section_statistic(meas, frame(spark, a=[(3, 3)]), "st", "var").first().value
    assert got == pytest.approx(1.0)


def test_matching(spark, meas):
    where = meas.select("ix", "x").distinct()
    pairs = lambda rows: sorted(tuple(r) for r in sec.match_pairs(where, spark.createDataFrame(rows, "pair_id int, h_start double, h_stop double, t_start double, t_stop double, reverse boolean")).collect())
    assert pairs([(1, 0.0, 2.0, 10.0, 12.0, False), (2, 4.0, 5.0, 15.0, 16.0, True)]) == [(1, 1, 0, 10), (1, 2, 1, 11), (1, 3, 2, 12), (2, 1, 4, 16), (2, 2, 5, 15)]
    with pytest.raises(Exception, match="different numbers"):
        pairs([(1, 0.0, 2.0, 10.0, 11.0, False)])
    got = sec.fitted_locations(where, frame(spark, cold=[(1, 3)]), spark.createDataFrame([(1, 3, 9)], "pair_id int, head_ix int, tail_ix int"))
    assert sorted(r.ix for r in got.collect()) == [2, 3, 9]


def test_description_and_series(spark, meas, series):
    rows = {r.section: r for r in sec.describe(meas, series, frame(spark, cold=[(0, 3)], warm=[(5, 6)])).collect()}
    assert (rows["cold"].locations, rows["cold"].readings, rows["cold"].bath_mean, rows["warm"].x_stop) == (4, 12, 2.0, 6.0)
    assert sec.series_keys(series) == ["cold", "warm"]


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(sec, "MOST_STRETCHES", 1)
    with pytest.raises(ValueError, match="more than 1 stretches"):
        sec.bounded(frame(spark, a=[(0, 1), (2, 3)]))


def test_measurements_without_a_variance_stay_and_raise_only_in_sections(spark, meas, series):
    vs = spark.createDataFrame([(i, 1.0) for i in range(19)], "ix int, v double")
    assert calibration.with_variance(meas, "st", vs).filter("st_v IS NULL").count() == 3
    for bad in (lambda c: c * 0, lambda c: c * float("nan"), lambda c: -c):
        assert calibration.with_variance(meas.filter("st > 0"), "st", bad).filter("st_v IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="variances in the sections"):
        calibration.calibrate_single(meas.filter("st > 0 AND ast > 0"), series, frame(spark, cold=[(10, 19)]), vs, 1.0)
    with pytest.raises(ValueError, match="column ix or time"):
        calibration.with_variance(meas, "st", spark.createDataFrame([(1.0,)], "v double"))
