"""The next or the previous row of a group without reading the group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_neighbour(df: DataFrame, keys: list[str], order: str, values: list[str], width: int, ahead: bool = False, suffix: str = "_prev") -> DataFrame:
    """Adds each value of the previous (or, ``ahead``, the next) row of the group by ``order``, a BIGINT without ties.

    The group is cut into slices of ``width`` order values. The neighbour is found within the slice; only the first or
    last row of a slice takes it from the nearest slice that has rows, over one summary row for each slice.
    """
    cut = df.withColumn("_slice", F.expr(f"floor({order} / {width})"))
    w = Window.partitionBy(*keys, "_slice").orderBy(order)
    pick = F.struct(*[F.col(v) for v in values])
    inside = cut.withColumn("_near", (F.lead if ahead else F.lag)(pick).over(w))
    end = (F.min if ahead else F.max)(F.struct(F.col(order).alias("_o"), pick.alias("_x")))
    ends = cut.groupBy(*keys, "_slice").agg(end.alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    ends = ends.withColumn("_far", (F.lead if ahead else F.lag)(F.col("_end._x")).over(over)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"), "_far")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice").eqNullSafe(F.col("_k_slice"))]
    both = inside.join(ends, on, "left").withColumn("_near", F.coalesce("_near", "_far"))
    return both.select(*df.columns, *[F.col(f"_near.{v}").alias(v + suffix) for v in values])
