"""Means over periods of time, interpolation in time, and selections along both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000


def resample_mean(meas: DataFrame, seconds: float, columns: list[str], by: list[str] | tuple[str, ...] = ("ix",), time: str = "time") -> DataFrame:
    """Means over periods of ``seconds``, counted from midnight (UTC) of the first day, for each ``by``; ``time`` is the period's start.

    Null and NaN values take no part; a period without rows gives none, one without values a null mean.
    """
    step = round(seconds * 1e6)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    origin = meas.agg((F.floor(F.min(us) / DAY_US) * DAY_US).alias("_origin"))
    cut = meas.join(F.broadcast(origin)).withColumn("_slot", F.floor((us - F.col("_origin")) / step) * step + F.col("_origin"))  # one row
    out = cut.filter("_slot IS NOT NULL").groupBy(*by, "_slot").agg(F.count("*").alias("n"), *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns])
    return out.select(*by, F.timestamp_micros(F.col("_slot").cast("long")).alias(time), "n", *columns)


def interpolate(series: DataFrame, at: DataFrame, value: str, by: list[str] | None = None, time: str = "time", slice_us: int = 3_600_000_000) -> DataFrame:
    """``at`` with ``value`` of the series interpolated linearly in time, null outside the series.

    Null and NaN values are passed over, values at one time are averaged. Both are put on one time axis and cut into
    slices; in a slice a row's neighbours are window values, and the nearest slice with values gives them across its
    ends, over one summary row for each slice.
    """
    keys = by or []
    mark = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    us = F.unix_micros(F.col(time).cast("timestamp"))
    known = series.select(*mark, us.alias("_us"), F.col(value).cast("double").alias("_v")).filter("_us IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v)").groupBy(*ks, "_us").agg(F.avg("_v").alias("_v"))
    known = known.withColumn("_p", F.struct(F.col("_us").alias("t"), F.col("_v").alias("v"))).drop("_v")
    asked = at.withColumn("_row", F.struct(*[F.col(c) for c in at.columns])).select(*mark, us.alias("_us"), "_row")
    slot = F.floor(F.col("_us") / slice_us)
    both = known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked.withColumn("_p", F.lit(None).cast(known.schema["_p"].dataType))).withColumn("_s", slot)
    up, down = (Window.partitionBy(*ks, "_s").orderBy(o("_us")).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    near = both.withColumns({"_b": F.last("_p", ignorenulls=True).over(up), "_a": F.last("_p", ignorenulls=True).over(down)}).filter("_row IS NOT NULL")
    ends = both.groupBy(*ks, "_s").agg(F.max("_p").alias("_hi"), F.min("_p").alias("_lo"))
    w = Window.partitionBy(*ks).orderBy("_s")
    far = ends.select(*[F.col(k).alias(f"{k}e") for k in ks], F.col("_s").alias("_se"), F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_fb"), F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_fa"))
    on = F.col("_s").eqNullSafe(F.col("_se"))
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}e"))
    got = near.join(far, on, "left").withColumns({"_b": F.coalesce("_b", "_fb"), "_a": F.coalesce("_a", "_fa")})
    gap = F.col("_a.t") - F.col("_b.t")
    lerp = F.when(gap == 0, F.col("_b.v")).otherwise(F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * ((F.col("_us") - F.col("_b.t")) / gap))
    return got.select("_row.*", lerp.alias(value))


def between(column: str, start: float | None = None, stop: float | None = None) -> Column:
    """A slice by label, both ends included; None leaves an end open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= start)
    if stop is not None:
        out = out & (F.col(column) <= stop)
    return out


def select_ordinals(meas: DataFrame, column: str, places: list[int]) -> DataFrame:
    """Rows at the given 0-based places (negative from the end) of the sorted distinct values of a column."""
    from thermaline.operators.noise import ranked

    order = ranked(meas.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_place")
    n = order.count() if any(p < 0 for p in places) else 0
    wanted = sorted({p if p >= 0 else n + p for p in places})
    return meas.join(F.broadcast(order.filter(F.col("_place").isin(wanted)).select(column)), column, "left_semi")  # at most as many rows as places


def outside_null(meas: DataFrame, sections: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside the stretches become null."""
    from thermaline.operators.sections import bounded

    inside = meas.select("ix", "x").distinct().join(bounded(sections), F.col("x").between(F.col("x_start"), F.col("x_stop"))).select("ix").distinct().withColumn("_in", F.lit(True))
    return meas.join(inside, "ix", "left").withColumns({c: F.when(F.col("_in"), F.col(c)) for c in columns}).drop("_in")


def scale_where(meas: DataFrame, column: str, condition: Column, factor: float) -> DataFrame:
    """Multiplies a column by a factor where the condition holds."""
    return meas.withColumn(column, F.when(condition, F.col(column) * factor).otherwise(F.col(column)))


def check_dims(df: DataFrame, **columns: tuple[str, ...]) -> None:
    """Raises unless the frame has the columns; ``check_dims(meas, st=("ix", "time"))`` asks for ``st`` and its keys."""
    for value, keys in columns.items():
        missing = [c for c in (value, *keys) if c not in df.columns]
        if missing:
            raise ValueError(f"{value} needs the columns {missing}")
