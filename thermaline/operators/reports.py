"""The figures behind reports on a calibration, as frames to be drawn by any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.operators.calibration import ZERO_C, Result
from thermaline.operators.sections import members, section_statistic


def residuals(temperature: DataFrame, series: DataFrame, sections: DataFrame, label: str = "tmpf") -> DataFrame:
    """``(section, stretch_id, ix, x, time, value)``: temperature less that of the bath."""
    return section_statistic(temperature, sections, label, temp_err=True, series=series)


def spread(rows: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Mean and deviation (n) by location (``by='x'``: ``ix, x``) or by ``time``."""
    keys = ["ix", "x"] if by == "x" else [by]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def accuracy(temperature: DataFrame, series: DataFrame, sections: DataFrame, label: str = "tmpf") -> DataFrame:
    """By stretch and time: mean error (bias) and its deviation (precision) along the stretch."""
    return residuals(temperature, series, sections, label).groupBy("section", "stretch_id", "time").agg(F.avg("value").alias("bias"), F.stddev_pop("value").alias("precision"))


def sigma_report(temperature: DataFrame, series: DataFrame, sections: DataFrame, label: str = "tmpf", variance: str = "tmpf_var") -> DataFrame:
    """By stretch: the deviation of the temperature errors seen, and the mean of the deviations that the variances claim."""
    seen = residuals(temperature, series, sections, label).groupBy("section", "stretch_id").agg(F.stddev_pop("value").alias("sigma_seen"))
    each = members(temperature.select("ix", "x", "time", F.sqrt(variance).alias("_s")), sections).groupBy("section", "stretch_id", "ix").agg(F.avg("_s").alias("_s"))
    return seen.join(each.groupBy("section", "stretch_id").agg(F.avg("_s").alias("sigma_claimed")), ["section", "stretch_id"])


def location_residuals(result: Result, series: DataFrame, sections: DataFrame) -> DataFrame:
    """Double-ended: ``(section, stretch_id, ix, x, time, werr_f, werr_b, werr_tot)``, the weighted misfit of each reference reading."""
    f = result.fit
    gamma = f.get("gamma")[0]
    names = [r.section for r in sections.select("section").distinct().collect()]  # at most MOST_STRETCHES
    rows = members(result.temperature.select("ix", "x", "time", "tmpf", "tmpb", *[c for a in ("st", "ast", "rst", "rast") for c in (a, f"{a}_v")]), sections)
    bath = F.lit(None).cast("double")
    for n in names:
        bath = F.when(F.col("section") == n, F.col(f"`{n}`").cast("double")).otherwise(bath)
    rows = rows.join(series.select("time", *names), "time").withColumn("_u", gamma / (bath + ZERO_C))
    out = {}
    for d, a, b in (("f", "st", "ast"), ("b", "rst", "rast")):
        spread_ = F.sqrt(F.col(f"{a}_v") / F.col(a) ** 2 + F.col(f"{b}_v") / F.col(b) ** 2)
        out[f"werr_{d}"] = (gamma / (F.col(f"tmp{d}") + ZERO_C) - F.col("_u")) / spread_
    rows = rows.withColumns(out).withColumn("werr_tot", F.col("werr_f") ** 2 + F.col("werr_b") ** 2)
    return rows.select("section", "stretch_id", "ix", "x", "time", "werr_f", "werr_b", "werr_tot")


def colour_limits(rows: DataFrame, value: str, low: float = 2.0, high: float = 98.0, exact: bool = False) -> DataFrame:
    """One row ``(low, high)`` of percentiles for a colour scale; from a sketch with a rank error of 1 in 10,000 unless ``exact``."""
    points = F.array(F.lit(low / 100), F.lit(high / 100))
    q = F.percentile(value, points) if exact else F.percentile_approx(value, points, 10_000)
    return rows.agg(q.alias("_q")).select(F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"))
