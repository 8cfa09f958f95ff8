"""Aligning the two directions of a fibre, in place and in time.

A double-ended set-up may be recorded as two single-ended ones. Their times are paired by order, the backward
locations are mirrored and matched with the nearest forward one, and a remaining shift is found from how straight the
attenuation is. All joins are equi-joins on location number or on a cell of the fibre; the order of times is a
window over time stamps alone, sliced so that no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators.ordered import with_neighbour

#: Time stamps are ordered in slices of this many microseconds.
SLICE_US = 86_400_000_000
SIGNALS = ("st", "ast", "rst", "rast")


def _stamps(meas: DataFrame) -> DataFrame:
    return meas.select(F.unix_micros(F.col("time").cast("timestamp")).alias("us")).filter("us IS NOT NULL").distinct()


def pair_times(forward: DataFrame, backward: DataFrame, verify: bool = True, tolerance_s: float = 1.5) -> DataFrame:
    """``(time_fw, time_bw, dt_s)``: each forward time whose next time of either direction is a backward one.

    With ``verify``, a pair is left out whose delay differs by more than the tolerance from that of the pair before, while the pairs
    before and after agree. If both directions have equally many times and, in order, all backward ones follow their forward
    ones with delays within the tolerance of the first, all are paired in order. A time stamp that both
    directions have counts as backward.
    """
    limit = tolerance_s * 1e6
    both = _stamps(forward).withColumn("is_fw", F.lit(1)).unionByName(_stamps(backward).withColumn("is_fw", F.lit(0))).groupBy("us").agg(F.min("is_fw").alias("is_fw"))
    both = both.withColumn("all", F.lit(0))
    seen = with_neighbour(both, ["all"], "us", ["us", "is_fw"], SLICE_US, ahead=True, suffix="_next")
    pairs = seen.filter("is_fw = 1 AND is_fw_next = 0").select("all", F.col("us").alias("fw"), F.col("us_next").alias("bw"), (F.col("us_next") - F.col("us")).alias("dt"))
    if verify:
        pairs = with_neighbour(pairs, ["all"], "fw", ["dt"], SLICE_US)
        pairs = with_neighbour(pairs, ["all"], "fw", ["dt"], SLICE_US, ahead=True, suffix="_next")
        odd = (F.abs(F.col("dt_prev") - F.col("dt_next")) <= limit) & (F.abs(F.col("dt") - F.col("dt_prev")) > limit)
        pairs = pairs.filter(~F.coalesce(odd, F.lit(False)))
    in_order = _in_order(forward, backward, limit if verify else None)
    out = in_order if in_order is not None else pairs
    return out.select(F.timestamp_micros("fw").alias("time_fw"), F.timestamp_micros("bw").alias("time_bw"), (F.col("dt") / 1e6).alias("dt_s"))


def _in_order(forward: DataFrame, backward: DataFrame, limit: float | None) -> DataFrame | None:
    """The pairs in order of both directions if nothing is missing, else None. Only counts and extremes reach the driver."""
    from thermaline.operators.noise import ranked

    fw, bw = _stamps(forward).withColumnRenamed("us", "fw"), _stamps(backward).withColumnRenamed("us", "bw")
    if fw.count() != bw.count():
        return None
    pairs = ranked(fw, ["fw"], "k").join(ranked(bw, ["bw"], "k"), "k").withColumn("dt", F.col("bw") - F.col("fw"))
    r = pairs.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.min_by("dt", "k").alias("first")).first()
    if r["lo"] is None or r["lo"] <= 0 or (limit is not None and (r["hi"] - r["first"] > limit or r["first"] - r["lo"] > limit)):
        return None
    return pairs


def merge_double_ended(forward: DataFrame, backward: DataFrame, cable_length: float, dx: float, verify: bool = True) -> DataFrame:
    """``(ix, x, time, st, ast, rst, rast)`` of two single-ended recordings ``(ix, x, time, st, ast)`` of one fibre.

    A backward location lies at ``cable_length - x`` and goes to the nearest forward location within ``0.99 dx``, ``dx`` being the
    spacing (of equally near ones to the one further on). Forward locations that lack a value at any paired
    time are left out. ``time`` is the forward time.
    """
    pairs = pair_times(forward, backward, verify)
    where = forward.select("ix", "x").distinct()
    mirrored = backward.select(F.col("ix").alias("ib"), (F.lit(float(cable_length)) - F.col("x")).alias("xb")).distinct()
    places = nearest_places(where, mirrored, dx, 0.99 * dx)
    fw = forward.join(pairs, forward["time"] == pairs["time_fw"]).select("ix", "x", "time", "time_bw", "st", "ast")
    bw = backward.select(F.col("ix").alias("ib"), F.col("time").alias("time_bw"), F.col("st").alias("rst"), F.col("ast").alias("rast")).join(places.select("ix", "ib"), "ib").drop("ib")
    both = fw.join(bw, ["ix", "time_bw"], "left").drop("time_bw")
    return whole_locations(both, SIGNALS)


def nearest_places(targets: DataFrame, others: DataFrame, cell: float, tolerance: float) -> DataFrame:
    """``(ix, x, ib, xb)``: for each target ``(ix, x)`` the nearest of ``others(ib, xb)`` within the tolerance.

    Both are put into cells of ``cell``, at least the tolerance, and each target looks into its own and the two beside it.
    """
    if cell < tolerance:
        raise ValueError("a cell must be at least as long as the tolerance")
    near = targets.withColumn("_c", F.explode(F.array(*[F.floor(F.col("x") / cell) + k for k in (-1, 0, 1)])))
    there = others.withColumn("_c", F.floor(F.col("xb") / cell))
    both = near.join(there, "_c").withColumn("_d", F.abs(F.col("x") - F.col("xb"))).filter(F.col("_d") <= tolerance)
    return both.groupBy("ix", "x").agg(F.min(F.struct("_d", -F.col("xb"), "ib", "xb")).alias("_n")).select("ix", "x", "_n.ib", "_n.xb")


def whole_locations(meas: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows of the locations that have a value in all columns at every time they occur; NaN is no value."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull() | F.isnan(c)
    bad = meas.groupBy("ix").agg(F.max(gap.cast("int")).alias("_gap")).filter("_gap = 1").select("ix")
    return meas.join(bad, "ix", "left_anti")


def shift_double_ended(meas: DataFrame, shift: int) -> DataFrame:
    """``(ix, x, time, st, ast, rst, rast)`` with the backward channel moved by ``shift`` locations; only locations
    that both directions have remain, numbered from 0 again. Other columns along the fibre are dropped.

    A positive shift is for a cable configured too short, a negative one for one configured too long.
    """
    fw = meas.select("ix", "x", "time", "st", "ast")
    bw = meas.select((F.col("ix") + F.lit(int(shift))).alias("ix"), "time", "rst", "rast")
    return fw.join(bw, ["ix", "time"]).withColumn("ix", (F.col("ix") - max(int(shift), 0)).cast("int")).select("ix", "x", "time", *SIGNALS)


def attenuation(fw: tuple[str, str] = ("st", "ast"), bw: tuple[str, str] = ("rst", "rast")) -> Column:
    """Half the difference of the two directions' logarithmic ratios; null unless all intensities are positive."""
    ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))
    return (ratio(*bw) - ratio(*fw)) / 2


def shift_errors(meas: DataFrame, shifts: list[int] | range, low: float = 1.0, high: float = 150.0) -> DataFrame:
    """``(shift, err1, err2)``: sums of the absolute first and second differences of the attenuation along the fibre.

    The logarithms are taken once and handed to every shift; differences count where their middle lies between ``low`` and
    ``high`` metres. Rows are exchanged by shift and time, so each task's window is one course along the fibre.
    """
    ratio = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))
    logs = meas.select("ix", "x", "time", ratio("st", "ast").alias("_f"), ratio("rst", "rast").alias("_b"))
    each = F.explode(F.array(*[F.lit(int(s)) for s in shifts]))
    fw = logs.select("ix", "x", "time", "_f", each.alias("shift"))
    bw = logs.select("ix", "time", "_b", each.alias("shift")).withColumn("ix", F.col("ix") + F.col("shift"))
    att = fw.join(bw, ["shift", "time", "ix"]).withColumn("att", (F.col("_b") - F.col("_f")) / 2)
    w = Window.partitionBy("shift", "time").orderBy("ix")
    steps = att.withColumns({"_a1": F.lag("att").over(w), "_a2": F.lag("att", 2).over(w), "_x1": F.lag("x").over(w), "_x2": F.lag("x", 2).over(w)})
    middle = 0.5 * F.col("x") + 0.5 * F.col("_x1")
    first = F.when((middle > low) & (middle < high), F.abs(F.col("att") - F.col("_a1")))
    second = F.when((F.col("_x1") > low) & (F.col("_x1") < high) & F.col("_x2").isNotNull(), F.abs(F.col("att") - 2 * F.col("_a1") + F.col("_a2")))
    return steps.groupBy("shift").agg(F.coalesce(F.sum(first), F.lit(0.0)).alias("err1"), F.coalesce(F.sum(second), F.lit(0.0)).alias("err2"))


def suggest_shift(meas: DataFrame, shifts: list[int] | range) -> DataFrame:
    """One row ``(shift1, shift2)``: the shifts of the least errors, the first given of equal ones."""
    place = F.array_position(F.array(*[F.lit(int(s)) for s in shifts]), F.col("shift"))
    rows = shift_errors(meas, shifts).withColumn("_p", place)
    return rows.agg(F.min_by("shift", F.struct("err1", "_p")).alias("shift1"), F.min_by("shift", F.struct("err2", "_p")).alias("shift2"))
