"""Noise variance of the intensities, estimated from the stretches of known temperature.

All estimators model the signal of a stretch and take the variance of what is left over. They need no iterative minimiser: the
best product of a profile along the fibre and a course in time is the leading pair of singular vectors, reached by
alternating sums; the exponential decay is a weighted regression in closed form. The rows of a stretch and time form one
group of a window, so the data are exchanged once; profiles have one row for each location and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators.sections import members
from thermaline.session import written

#: A fibre has fewer locations than this, so a profile may be broadcast; counted before it is.
MOST_LOCATIONS = 200_000
KEYS = ["section", "stretch_id"]


@dataclass
class Noise:
    """``residuals(section, stretch_id, ix, x, time, <label>, resid)``: model less measurement of every reference reading."""

    residuals: DataFrame
    label: str

    def frame(self) -> DataFrame:
        """One row: the variance with n - 1, and the number of residuals."""
        return self.residuals.agg(F.var_samp("resid").alias("variance"), F.count("resid").alias("n"))

    @property
    def variance(self) -> float:
        return self.frame().first()["variance"]

    def everywhere(self, meas: DataFrame) -> DataFrame:
        """``meas`` with the column ``resid``, null outside the stretches."""
        return meas.join(self.residuals.select("ix", "time", "resid").dropDuplicates(["ix", "time"]), ["ix", "time"], "left")


def check_acquisition(series: DataFrame, column: str, within: float = 0.05) -> None:
    """Raises unless all acquisition times lie within a share of the middle of their range: noise depends on them."""
    r = series.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if r["lo"] is not None and not (r["hi"] - r["lo"]) / ((r["hi"] + r["lo"]) / 2) < within:
        raise ValueError(f"acquisition times differ, from {r['lo']} to {r['hi']}")


def _inside(meas: DataFrame, sections: DataFrame, label: str) -> DataFrame:
    """Readings in the stretches; null, NaN and non-positive intensities take no part."""
    if meas.select("ix").distinct().limit(MOST_LOCATIONS + 1).count() > MOST_LOCATIONS:
        raise ValueError(f"more than {MOST_LOCATIONS} locations")
    return members(meas.select("ix", "x", "time", F.col(label).cast("double").alias(label)), sections).filter((F.col(label) > 0) & ~F.isnan(label))


def variance_constant(meas: DataFrame, sections: DataFrame, label: str, rounds: int = 3) -> Noise:
    """Residuals from the best product of a profile and a course in time of each stretch.

    Each round replaces the course by its least-squares value for the profile and then the profile by that for the course; it
    converges by the ratio of the two leading singular values, which for measured fibre is below a hundredth.
    """
    rows = _inside(meas, sections, label).withColumn("_h", F.lit(1.0))
    v, at_time = F.col(label), Window.partitionBy(*KEYS, "time")
    for _ in range(rounds):
        rows = rows.withColumn("_g", F.sum(F.col("_h") * v).over(at_time) / F.sum(F.col("_h") * F.col("_h")).over(at_time))
        profile = rows.groupBy(*KEYS, "ix").agg((F.sum(F.col("_g") * v) / F.sum(F.col("_g") * F.col("_g"))).alias("_h"))
        rows = rows.drop("_h").join(F.broadcast(profile), [*KEYS, "ix"])
    return Noise(rows.select(*KEYS, "ix", "x", "time", label, (F.col("_g") * F.col("_h") - v).alias("resid")), label)


def variance_exponential(meas: DataFrame, sections: DataFrame, label: str) -> Noise:
    """Residuals from an exponential decay along each stretch, with one rate for a stretch and an amplitude for each time.

    The logarithm is regressed with the squared intensity as weight, since its variance goes with the inverse square.
    """
    rows = _inside(meas, sections, label)
    v, at_time = F.col(label), Window.partitionBy(*KEYS, "time")
    rows = rows.withColumns({"_w": v * v, "_y": F.log(v)})
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(at_time) / F.sum("_w").over(at_time)
    rows = rows.withColumns({"_x0": mean("x"), "_y0": mean("_y")}).withColumns({"_dx": F.col("x") - F.col("_x0"), "_dy": F.col("_y") - F.col("_y0")})
    rate = rows.groupBy(*KEYS).agg(F.try_divide(F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")), F.sum(F.col("_w") * F.col("_dx") * F.col("_dx"))).alias("_b"))
    rows = rows.join(F.broadcast(rate), KEYS)  # as many rows as stretches, see sections.bounded
    fitted = F.exp(F.col("_y0") + F.coalesce("_b", F.lit(0.0)) * F.col("_dx"))
    return Noise(rows.select(*KEYS, "ix", "x", "time", label, (fitted - v).alias("resid")), label)


@dataclass
class LinearNoise:
    """Variance as a line in the intensity, with the bins it was fitted to: ``bin, mean, variance``."""

    slope: float
    offset: float
    bins: DataFrame
    noise: Noise

    def function(self) -> Callable[[Column], Column]:
        """To be passed as the variance of an intensity to a calibration."""
        return lambda intensity: intensity * self.slope + self.offset


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based rank of each row by ``order`` over all rows, without sorting them in one task.

    Ranges of the order are sorted apart and written once; each range's first rank comes from the counts of those before it, as
    many rows as there are ranges. Rows that tie in ``order`` are ranked arbitrarily.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = written(cut.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return cut.join(F.broadcast(first.drop("_n")), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def linear_bins(noise: Noise, nbin: int = 50) -> DataFrame:
    """``(bin, n, mean, variance)``: equally many readings by order of intensity, with the variance (n) of their residuals.

    ``nbin`` is lowered until it divides the number of readings.
    """
    rows = noise.residuals
    total = rows.count()
    while total and total % nbin:
        nbin -= 1
    order = ranked(rows, [noise.label, "ix", "time", *KEYS], "_rank").withColumn("bin", F.floor(F.col("_rank") / F.lit(max(total // nbin, 1))).cast("int"))
    return order.groupBy("bin").agg(F.count("*").alias("n"), F.avg(noise.label).alias("mean"), F.var_pop("resid").alias("variance"))


def variance_linear(meas: DataFrame, sections: DataFrame, label: str, nbin: int = 50, through_zero: bool = False, rounds: int = 3) -> LinearNoise:
    """Variance proportional to the intensity, or a line in it, fitted to the bins of the residuals of ``variance_constant``."""
    noise = variance_constant(meas, sections, label, rounds)
    bins = written(linear_bins(noise, nbin), "bins")
    x, y = F.col("mean"), F.col("variance")
    r = bins.agg((F.sum(x * y) / F.sum(x * x)).alias("zero"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset")).first()
    slope, offset = (r["zero"], 0.0) if through_zero else (r["slope"], r["offset"])
    if offset is not None and offset < 0:
        import warnings

        warnings.warn("the offset of the variance is negative: intensities vary too little for a line; use through_zero or variance_constant", stacklevel=2)
    return LinearNoise(slope, offset, bins, noise)
