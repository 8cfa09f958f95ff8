from datetime import datetime, timedelta

import pytest

from thermaline.operators.regrid import regular_grid

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_cells", [1, 4096])
def test_counter_with_reset_and_long_gap(spark, slice_cells):
    # 30 more, a reset to 5, then a gap of 240 s, longer than the bound
    rows = [(1, T0 + timedelta(seconds=s), v, 20_000_000) for s, v in ((0, 10.0), (30, 40.0), (60, 5.0), (300, 10.0))]
    df = spark.createDataFrame(rows, "run long, time timestamp, v double, p long")
    cells = regular_grid(df, "run", "time", "v", "p", kind="counter", longest_us=60_000_000, slice_cells=slice_cells).orderBy("slot_us").collect()
    start = cells[0].slot_us
    assert [(c.slot_us - start) // 1_000_000 for c in cells] == list(range(0, 320, 20))
    assert [c.increment for c in cells[:3]] == pytest.approx([20, 10 + 5 / 3, 10 / 3])
    assert sum(c.increment or 0 for c in cells) == pytest.approx(35)
    assert [c.status for c in cells] == ["measured", "measured", "filled", "measured"] + ["uncovered"] * 11 + ["measured"]


def grid(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, run long, time timestamp, v double, p long")
    cells = regular_grid(df, "run", "time", "v", "p", row_id="id", **kw).orderBy("series", "slot_us").collect()
    return [(c.series, c.slot_us // c.period_us, c.readings, c.mean, c.status) for c in cells]


def reading(i, s, v, run=1, p=10):
    return (i, run, T0 + timedelta(seconds=s), v, None if p is None else p * 1_000_000)


FIRST = 1704067200 // 10


def test_gauge_with_missing_repeated_and_tied_readings(spark):
    rows = [reading(1, 0, 1.0), reading(1, 0, 1.0), reading(2, 5, 3.0), reading(3, 5, 5.0), reading(4, 21, None), reading(5, 22, float("nan")), reading(6, 35, 7.0)]
    assert grid(spark, rows) == [(1, FIRST, 3, 2.5, "measured"), (1, FIRST + 1, 0, None, "filled"), (1, FIRST + 2, 0, None, "filled"), (1, FIRST + 3, 1, 7.0, "measured")]
    assert [c[4] for c in grid(spark, rows, longest_us=20_000_000)] == ["measured", "uncovered", "uncovered", "measured"]


def test_null_keys_times_and_periods_take_no_part_and_a_table_may_be_empty(spark):
    rows = [(1, None, T0, 1.0, 10), (2, 1, None, 1.0, 10), reading(3, 0, 1.0, p=None), reading(4, 0, 1.0, p=-1)]
    assert grid(spark, rows) == [] and grid(spark, []) == []


def test_times_before_1970_and_the_smallest_period_of_a_series(spark):
    rows = [(1, 1, datetime(1969, 12, 31, 23, 59, 55), 1.0, 20_000_000), (2, 1, datetime(1970, 1, 1, 0, 0, 12), 2.0, 10_000_000)]
    assert grid(spark, rows) == [(1, -1, 1, 1.0, "measured"), (1, 0, 0, None, "filled"), (1, 1, 1, 2.0, "measured")]


@pytest.mark.parametrize("slice_cells", [7, 4096])
def test_a_long_gap_and_many_series_are_alike_in_any_slices(spark, slice_cells):
    rows = [reading(1, 3, 1.0), reading(2, 10_003, 2.0)] + [reading(100 + k, k, float(k), run=k % 3 + 2) for k in range(60)]
    cells = grid(spark, rows, slice_cells=slice_cells)
    assert [c[1] - FIRST for c in cells if c[0] == 1] == list(range(1001)) and sum(c[2] for c in cells) == 62


def test_an_unknown_kind_is_refused(spark):
    with pytest.raises(ValueError, match="gauge or counter"):
        grid(spark, [], kind="other")
