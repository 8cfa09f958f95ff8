"""Irregular readings brought onto a regular grid, with uncovered periods marked.

A series is treated as a cumulative counter or as a gauge. For a counter, a fall is a reset: the new
reading itself is then the increment, else the difference. Each increment is spread over the grid cells between the two
readings in proportion to the overlap. For a gauge, the same overlaps weight the mean of the two readings (its time
integral by the trapezium rule). Cells without a reading of their own are marked; intervals longer than a bound leave what
they span uncovered.

A series may be arbitrarily long: readings are cut into slices of ``slice_cells`` cells, and only the last reading of each
slice is handed to the next, so a hot series is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regular_grid(
    readings: DataFrame,
    series: str,
    time: str,
    value: str,
    period_us: str,
    kind: str = "gauge",
    row_id: str | None = None,
    longest_us: int | None = None,
    slice_cells: int = 4096,
) -> DataFrame:
    """Rows ``(series, slot_us, period_us, readings, mean, increment, covered, status)``, one per cell of each series.

    Cells are ``[k p, (k+1) p)`` from the epoch, ``p`` the row's ``period_us`` (the smallest of a series counts), from the
    first to the last cell holding a reading. ``readings`` counts readings in the cell and ``mean`` is theirs. For a counter
    ``increment`` is the part of the increments that overlaps the cell, for a gauge the integral over the cell in value
    times seconds; ``covered`` is the covered share of the cell. ``status`` is ``measured`` (holds a reading), ``filled``
    (none, but covered by an interval between readings) or ``uncovered`` (the interval is longer than
    ``longest_us``; by default no interval is). Null and NaN values, null times, keys and periods take no part. Rows with the same
    ``row_id`` count once; readings at one time are averaged (gauge) or the largest is taken (counter). Further columns are
    ignored; an empty table gives an empty result.
    """
    if kind not in ("gauge", "counter"):
        raise ValueError(f"kind is gauge or counter, not {kind}")
    rows = readings.select(F.col(series).alias("_k"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.col(value).cast("double").alias("_v"), F.col(period_us).cast("long").alias("_p"), *([F.col(row_id).alias("_id")] if row_id else []))
    rows = rows.filter("_k IS NOT NULL AND _t IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v) AND _p > 0")
    if row_id:  # all rows of one id lie at one time, so this needs no exchange of its own
        rows = rows.groupBy("_k", "_t", "_id").agg(F.first("_v").alias("_v"), F.min("_p").alias("_p"))
    at = rows.groupBy("_k", "_t").agg((F.avg if kind == "gauge" else F.max)("_v").alias("_v"), F.count("*").alias("_n"), F.min("_p").alias("_p"))
    period = at.groupBy(F.col("_k").alias("_kp")).agg(F.min("_p").alias("_pp"))
    at = at.join(period, F.col("_k") == F.col("_kp")).drop("_kp", "_p").withColumnRenamed("_pp", "_p")
    at = at.withColumn("_c", F.expr("floor(_t / _p)")).withColumn("_slice", F.expr(f"floor(_c / {slice_cells})"))

    # the previous reading: within the slice, or the last of the nearest earlier slice
    w = Window.partitionBy("_k", "_slice").orderBy("_t")
    inside = at.withColumns({"_t0": F.lag("_t").over(w), "_v0": F.lag("_v").over(w)})
    ends = at.groupBy("_k", "_slice").agg(F.max(F.struct("_t", "_v")).alias("_last"))
    ends = ends.withColumn("_prev", F.lag("_last").over(Window.partitionBy("_k").orderBy("_slice"))).select(F.col("_k").alias("_ke"), F.col("_slice").alias("_se"), "_prev")
    linked = inside.join(ends, (F.col("_k") == F.col("_ke")) & (F.col("_slice") == F.col("_se"))).withColumns({"_t0": F.coalesce("_t0", "_prev._t"), "_v0": F.coalesce("_v0", "_prev._v")}).drop("_ke", "_se", "_prev")

    # each interval gives one piece for every cell that it touches; the first reading gives its own cell only
    step = F.when(F.col("_v") >= F.col("_v0"), F.col("_v") - F.col("_v0")).otherwise(F.col("_v")) if kind == "counter" else None
    pieces = linked.withColumn("_c0", F.expr("floor(coalesce(_t0, _t) / _p)"))
    pieces = pieces.withColumn("_s", F.explode(F.expr(f"sequence(floor(_c0 / {slice_cells}), _slice)")))  # a long gap never is one long array
    pieces = pieces.withColumn("_cell", F.explode(F.expr(f"sequence(greatest(_c0, _s * {slice_cells}), least(_c, _s * {slice_cells} + {slice_cells - 1}))")))
    overlap = F.expr("least(_t, (_cell + 1) * _p) - greatest(_t0, _cell * _p)").cast("double")
    bridged = F.coalesce(F.col("_t") - F.col("_t0") <= F.lit(longest_us), F.lit(False)) if longest_us is not None else F.col("_t0").isNotNull()
    if kind == "counter":
        part = step * overlap / (F.col("_t") - F.col("_t0"))
    else:
        slope = (F.col("_v") - F.col("_v0")) / (F.col("_t") - F.col("_t0"))
        middle = F.expr("(least(_t, (_cell + 1) * _p) + greatest(_t0, _cell * _p)) / 2.0")
        part = (F.col("_v0") + slope * (middle - F.col("_t0"))) * overlap / 1e6
    own = F.col("_cell") == F.col("_c")
    cells = pieces.groupBy("_k", "_p", "_cell").agg(
        F.sum(F.when(own, F.col("_n")).otherwise(0)).alias("readings"), F.avg(F.when(own, F.col("_v"))).alias("mean"),
        F.sum(F.when(bridged, part)).alias("increment"), (F.coalesce(F.sum(F.when(bridged, overlap)), F.lit(0.0)) / F.first("_p")).alias("covered"),
    )
    status = F.when(F.col("readings") > 0, "measured").when(F.col("covered") > 0, "filled").otherwise("uncovered")
    return cells.select(F.col("_k").alias("series"), (F.col("_cell") * F.col("_p")).alias("slot_us"), F.col("_p").alias("period_us"), "readings", "mean", "increment", "covered", status.alias("status"))
