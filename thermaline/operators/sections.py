"""Fibre sections: stretches of known temperature, their members and statistics over them.

Sections are rows ``(section, stretch_id, x_start, x_stop)``, both ends included; a location on a shared end belongs to
both stretches. The name of a section is the column of the time series with its bath temperature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Sections describe one set-up; more rows than this are refused, so a broadcast of them is small.
MOST_STRETCHES = 10_000
SCHEMA = "section string, stretch_id int, x_start double, x_stop double"


def sections_frame(spark: SparkSession, sections: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Sections given as ``{name: [(start, stop), ...]}``."""
    rows = []
    for name, stretches in validate_definition(sections).items():
        rows.extend((name, k, float(a), float(b)) for k, (a, b) in enumerate(stretches, 1))
    return spark.createDataFrame(rows, SCHEMA)


def validate_definition(sections: dict) -> dict:
    """Names to lists of (start, stop) with start <= stop; anything else raises."""
    if not isinstance(sections, dict) or not sections:
        raise ValueError("sections are a dictionary of names to stretches")
    for name, stretches in sections.items():
        if not isinstance(name, str) or not isinstance(stretches, (list, tuple)) or not stretches:
            raise ValueError(f"section {name!r} needs a list of stretches")
        for s in stretches:
            if not isinstance(s, (list, tuple)) or len(s) != 2 or not float(s[0]) <= float(s[1]):
                raise ValueError(f"stretch {s!r} of {name} is not (start, stop)")
    return sections


def overlaps(sections: DataFrame) -> DataFrame:
    """Stretches that begin before an earlier one has ended; touching is allowed. Sections with an overlap are invalid."""
    w = Window.partitionBy().orderBy("x_start", "x_stop").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_STRETCHES rows
    return bounded(sections).withColumn("earlier_stop", F.max("x_stop").over(w)).filter("x_start < earlier_stop")


def bounded(sections: DataFrame) -> DataFrame:
    if sections.count() > MOST_STRETCHES:
        raise ValueError(f"more than {MOST_STRETCHES} stretches")
    return F.broadcast(sections)


def validate(sections: DataFrame, series: DataFrame, locations: DataFrame) -> None:
    """Raises unless stretches don't overlap, each section is a series column and each stretch holds a location."""
    if overlaps(sections).limit(1).count():
        raise ValueError("stretches overlap")
    unknown = {r.section for r in sections.select("section").distinct().collect()} - set(series.columns)
    if unknown:
        raise ValueError(f"no temperature series for {sorted(unknown)}")
    empty = bounded(sections).join(locations.select("x").distinct(), F.col("x").between(F.col("x_start"), F.col("x_stop")), "left").groupBy("section", "stretch_id").agg(F.count("x").alias("n")).filter("n = 0").limit(1).collect()
    if empty:
        raise ValueError(f"stretch {empty[0].stretch_id} of {empty[0].section} holds no location")


def members(meas: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows of ``meas`` in a stretch, with ``section`` and ``stretch_id``; a range join against the broadcast stretches."""
    return meas.join(bounded(sections), F.col("x").between(F.col("x_start"), F.col("x_stop"))).drop("x_start", "x_stop")


def bath(names: list[str]) -> Column:
    """Temperature of the row's section, from the series' columns joined to it."""
    out = F.lit(None).cast("double")
    for n in names:
        out = F.when(F.col("section") == n, F.col(f"`{n}`").cast("double")).otherwise(out)
    return out


def with_bath(rows: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``tref``, the bath temperature of the row's section at its time."""
    return rows.join(series.select("time", *names), "time").withColumn("tref", bath(names)).drop(*names)


def section_statistic(
    meas: DataFrame,
    sections: DataFrame,
    label: str,
    func: str | Callable[[Column], Column] | None = None,
    subtract: str | None = None,
    series: DataFrame | None = None,
    temp_err: bool = False,
    ref_temp: bool = False,
    calc_per: str = "stretch",
) -> DataFrame:
    """Values of a label in the sections, or an aggregate of them.

    The value is the label, less another label (``subtract``), less the bath temperature (``temp_err``), or the bath
    temperature itself (``ref_temp``). ``func`` None gives the rows, ``'var'`` the variance with n-1, a function of a column
    any aggregate; ``calc_per`` groups by ``stretch``, ``section`` or ``all``.
    """
    keys = {"stretch": ["section", "stretch_id"], "section": ["section"], "all": []}[calc_per]
    inside = members(meas, sections)
    value = F.col(label)
    if temp_err or ref_temp:
        names = [r.section for r in sections.select("section").distinct().orderBy("section").collect()]
        inside = with_bath(inside, series, names)
        value = F.col("tref") if ref_temp else value - F.col("tref")
    elif subtract:
        value = value - F.col(subtract)
    inside = inside.withColumn("value", value)
    if func is None:
        return inside.select("section", "stretch_id", "ix", "x", "time", "value")
    agg = F.var_samp("value") if func == "var" else func(F.col("value"))
    return inside.groupBy(*keys).agg(agg.alias("value"))


def statistic_at_all_levels(meas: DataFrame, sections: DataFrame, label: str) -> DataFrame:
    """Count, mean and variance per stretch, per section and over all, in one pass of grouping sets."""
    inside = members(meas, sections)
    sets = inside.groupingSets([["section", "stretch_id"], ["section"], []], "section", "stretch_id")
    return sets.agg(F.count(label).alias("n"), F.avg(label).alias("mean"), F.var_samp(label).alias("var"))


def match_pairs(locations: DataFrame, matching: DataFrame) -> DataFrame:
    """``(pair_id, rank, head_ix, tail_ix)``: the i-th location of each head with the i-th of its tail, or the i-th last.

    ``matching`` has ``(pair_id, h_start, h_stop, t_start, t_stop, reverse)``. Unequal numbers of locations raise when evaluated.
    """
    part = bounded(matching)
    head = locations.join(part, F.col("x").between(F.col("h_start"), F.col("h_stop"))).select("pair_id", "reverse", "x", F.col("ix").alias("head_ix"))
    tail = locations.join(part, F.col("x").between(F.col("t_start"), F.col("t_stop"))).select("pair_id", "reverse", "x", F.col("ix").alias("tail_ix"))
    w = Window.partitionBy("pair_id")
    head = head.withColumn("rank", F.row_number().over(w.orderBy("x"))).drop("x", "reverse")
    tail = tail.withColumn("rank", F.row_number().over(w.orderBy(F.when(F.col("reverse"), -F.col("x")).otherwise(F.col("x"))))).drop("x", "reverse")
    both = head.join(tail, ["pair_id", "rank"], "full")
    whole = F.assert_true(F.col("head_ix").isNotNull() & F.col("tail_ix").isNotNull(), F.lit("head and tail hold different numbers of locations"))
    return both.filter(whole.isNull()).select("pair_id", F.col("rank").cast("int").alias("rank"), "head_ix", "tail_ix")


def describe(meas: DataFrame, series: DataFrame, sections: DataFrame, label: str = "st") -> DataFrame:
    """One line for each stretch: its limits, the mean and deviation of its bath temperature, locations and readings."""
    names = [r.section for r in sections.select("section").distinct().collect()]
    rows = with_bath(members(meas, sections), series, names)
    out = rows.groupBy("section", "stretch_id").agg(F.countDistinct("ix").alias("locations"), F.count(label).alias("readings"), F.avg("tref").alias("bath_mean"), F.stddev_pop("tref").alias("bath_std"))
    return out.join(bounded(sections), ["section", "stretch_id"])


def series_keys(series: DataFrame) -> list[str]:
    """Names of the numeric columns of a time series."""
    return [f.name for f in series.schema.fields if f.name != "time" and isinstance(f.dataType, T.NumericType)]


def fitted_locations(locations: DataFrame, sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(ix)``: locations of the sections and of matched pairs, without the first of the sections."""
    inside = members(locations.select("ix", "x"), sections).select("ix")
    every = inside.unionByName(pairs.select(F.col("head_ix").alias("ix"))).unionByName(pairs.select(F.col("tail_ix").alias("ix"))).distinct()
    first = members(locations.select("ix", "x"), sections).agg(F.min_by("ix", "x").alias("ix"))
    return every.join(F.broadcast(first), "ix", "left_anti")  # one row
