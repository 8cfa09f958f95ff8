"""Queries of the fibre operators on two fixtures, with SQL that works them out independently.

``trace``: each embedding is the temperature along a fibre at one time, fed through the physics of both intensities, with
baths of known temperature in two sections, and noise taken from the same numbers elsewhere. ``grid``: mean prices by
quantity (location) and quarter (time). Both use whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaline.operators import alignment, noise, reports, resampling, sampling
from thermaline.operators import sections as sec
from thermaline.operators.campaigns import calibrate_campaigns
from thermaline.operators.calibration import External, calibrate_double, calibrate_single, with_variance
from thermaline.session import table

# Constants of the fixtures' physics.
GAMMA, CP, CM, AR, AM, AP = 482.6, 15246.0, 2400.0, 5.284e-4, 4.961e-4, 5.607e-4
LENGTH, NOISE, MINUTE = 64.0, 1e-3, 60_000_000
COLD, WARM = [(0.0, 9.0), (50.0, 57.0)], [(20.0, 27.0)]
SECTIONS = {"cold": COLD, "warm": WARM}
GRID_SECTIONS = {"tax": [(2.0, 20.0), (80.0, 96.0)], "discount": [(30.0, 60.0)]}
VAR = {"st": 1e-4, "ast": 2e-4}  # variances as shares of the intensity
ALPHA_VAR = 1e-12
#: Factor of the grid's means, so that none lies on the edge between two rounded values.
SCALE = 1.0471975511965976


def trace(spark: SparkSession, sf_dir: str, noisy: bool = True) -> tuple[DataFrame, DataFrame]:
    """``meas(ix, x, time, st, ast, rst, rast, temp)`` and ``series(time, cold, warm)`` in degrees Celsius."""
    e = table(spark, sf_dir, "embeddings").select(F.timestamp_micros(F.col("vec_id") * MINUTE).alias("time"), "embedding")
    at = lambda k: F.get("embedding", k).cast("double")
    baths = {"cold": 280.0 + 8.0 * at(F.lit(0)), "warm": 300.0 + 8.0 * at(F.lit(1))}
    series = e.select("time", *[(b - 273.15).alias(n) for n, b in baths.items()])
    rows = e.select("time", "embedding", *[b.alias(f"_{n}") for n, b in baths.items()], F.posexplode("embedding").alias("ix", "_e")).withColumn("x", F.col("ix").cast("double"))
    inside = lambda name: sum((F.col("x").between(a, b).cast("int") for a, b in SECTIONS[name]), F.lit(0)) > 0
    rows = rows.withColumn("temp", F.when(inside("cold"), F.col("_cold")).when(inside("warm"), F.col("_warm")).otherwise(288.0 + 12.0 * F.col("_e").cast("double")))
    ex = F.exp(GAMMA / F.col("temp"))
    far = F.lit(LENGTH) - F.col("x")
    shapes = {"st": (CP, AP, F.col("x"), 11), "ast": (CM, AM, F.col("x"), 23), "rst": (CP, AP, far, 31), "rast": (CM, AM, far, 41)}
    out = {}
    for label, (c, a, x, k) in shapes.items():
        v = F.lit(c) * F.exp(F.lit(-(AR + a)) * x) * (ex if label.endswith("rst") or label == "st" else F.lit(1.0)) / (ex - 1.0)
        out[label] = v * (1.0 + NOISE * at((F.col("ix") + k) % F.size("embedding"))) if noisy else v
    return rows.withColumns(out).select("ix", "x", "time", "st", "ast", "rst", "rast", "temp"), series


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``meas(ix, x, time, st, ast, n)`` and ``series(time, tax, discount)``, both by quarter."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("ix"), F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).alias("time"), "l_extendedprice", "l_discount", "l_tax")
    meas = rows.groupBy("ix", "time").agg((F.avg("l_extendedprice") * SCALE).alias("st"), ((F.avg("l_discount") + 1.0) * SCALE).alias("ast"), F.count("*").alias("n"))
    series = rows.groupBy("time").agg((F.avg("l_tax") * (100 * SCALE)).alias("tax"), (F.avg("l_discount") * (100 * SCALE)).alias("discount"))
    return meas.withColumn("x", F.col("ix") * 2.0), series


def no_of(time: str = "time"):
    return (F.unix_micros(time) / MINUTE).cast("long").alias("vec_id")


def quarter(time: str = "time"):
    return (F.year(time) * 10 + F.quarter(time)).cast("long").alias("quarter")


def r(c: str, digits: int, alias: str | None = None):
    return (F.round(c, digits) + 0.0).alias(alias or c)


_TRACE = """
e AS (SELECT vec_id, embedding AS v, 280.0::DOUBLE + 8.0::DOUBLE * embedding[1]::DOUBLE AS cold, 300.0::DOUBLE + 8.0::DOUBLE * embedding[2]::DOUBLE AS warm FROM embeddings),
k AS (SELECT vec_id, v, cold, warm, unnest(range(len(v)))::INT AS ix FROM e),
t AS (SELECT vec_id, v, ix, ix::DOUBLE AS x, CASE WHEN ix BETWEEN 0 AND 9 OR ix BETWEEN 50 AND 57 THEN 'cold' WHEN ix BETWEEN 20 AND 27 THEN 'warm' END AS section,
  CASE WHEN ix BETWEEN 0 AND 9 THEN 1 WHEN ix BETWEEN 50 AND 57 THEN 2 ELSE 1 END AS stretch_id,
  CASE WHEN ix BETWEEN 0 AND 9 OR ix BETWEEN 50 AND 57 THEN cold WHEN ix BETWEEN 20 AND 27 THEN warm ELSE 288.0::DOUBLE + 12.0::DOUBLE * v[ix + 1]::DOUBLE END AS temp FROM k),
f AS (SELECT vec_id, ix, x, section, stretch_id, temp, {st} AS st, {ast} AS ast, {rst} AS rst, {rast} AS rast FROM t)
"""


def _trace_sql(noisy: bool = True) -> str:
    out = {}
    for label, c, a, x, k in (("st", CP, AP, "x", 11), ("ast", CM, AM, "x", 23), ("rst", CP, AP, f"({LENGTH}::DOUBLE - x)", 31), ("rast", CM, AM, f"({LENGTH}::DOUBLE - x)", 41)):
        top = f"exp({GAMMA}::DOUBLE / temp)" if label in ("st", "rst") else "1.0::DOUBLE"
        out[label] = f"{c}::DOUBLE * exp({-(AR + a)!r}::DOUBLE * {x}) * {top} / (exp({GAMMA}::DOUBLE / temp) - 1.0::DOUBLE)"
        if noisy:
            out[label] += f" * (1.0::DOUBLE + {NOISE}::DOUBLE * v[(ix + {k}) % len(v) + 1]::DOUBLE)"
    return _TRACE.format(**out)


_GRID = f"""
l AS (SELECT CAST(l_quantity AS INT) AS ix, year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem),
g AS (SELECT ix, ix * 2.0::DOUBLE AS x, quarter, avg(p) * {SCALE}::DOUBLE AS st, (avg(d) + 1.0) * {SCALE}::DOUBLE AS ast, count(*) AS n FROM l GROUP BY ix, quarter),
s AS (SELECT quarter, avg(t) * {100 * SCALE}::DOUBLE AS tax, avg(d) * {100 * SCALE}::DOUBLE AS discount FROM l GROUP BY quarter),
z AS (SELECT * FROM (VALUES ('tax', 1, 2.0::DOUBLE, 20.0::DOUBLE), ('tax', 2, 80.0, 96.0), ('discount', 1, 30.0, 60.0)) AS z(section, stretch_id, x_start, x_stop)),
m AS (SELECT z.section, z.stretch_id, g.ix, g.x, g.quarter, g.st, g.ast, g.n, CASE WHEN z.section = 'tax' THEN s.tax ELSE s.discount END AS bath
  FROM g JOIN z ON g.x BETWEEN z.x_start AND z.x_stop JOIN s ON g.quarter = s.quarter)
"""

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its SQL if there is any."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# sections


def _grid_sections(spark):
    return sec.sections_frame(spark, GRID_SECTIONS)


@query("sections_members", f"WITH {_GRID} SELECT section, stretch_id, ix, count(*) AS rows FROM m GROUP BY section, stretch_id, ix")
def sections_members(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.members(meas, _grid_sections(spark)).groupBy("section", "stretch_id", "ix").agg(F.count("*").alias("rows"))


@query("sections_values", f"WITH {_GRID} SELECT section, stretch_id, ix, CAST(quarter AS BIGINT) AS quarter, round(st, 4) + 0.0 AS value FROM m")
def sections_values(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st").select("section", "stretch_id", "ix", quarter(), r("value", 4))


@query("sections_temperature_error", f"WITH {_GRID} SELECT section, stretch_id, ix, CAST(quarter AS BIGINT) AS quarter, round(st - bath, 4) + 0.0 AS value FROM m")
def sections_temperature_error(spark, sf_dir):
    meas, series = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", temp_err=True, series=series).select("section", "stretch_id", "ix", quarter(), r("value", 4))


@query("sections_bath", f"WITH {_GRID} SELECT section, stretch_id, ix, CAST(quarter AS BIGINT) AS quarter, round(bath, 6) + 0.0 AS value FROM m")
def sections_bath(spark, sf_dir):
    meas, series = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", ref_temp=True, series=series).select("section", "stretch_id", "ix", quarter(), r("value", 6))


@query("sections_difference", f"WITH {_GRID} SELECT section, stretch_id, ix, CAST(quarter AS BIGINT) AS quarter, round(st - ast, 4) + 0.0 AS value FROM m")
def sections_difference(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", subtract="ast").select("section", "stretch_id", "ix", quarter(), r("value", 4))


@query("sections_variance_by_stretch", f"WITH {_GRID} SELECT section, stretch_id, round(var_samp(st - bath), 1) + 0.0 AS value FROM m GROUP BY section, stretch_id")
def sections_variance_by_stretch(spark, sf_dir):
    meas, series = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", "var", temp_err=True, series=series).select("section", "stretch_id", r("value", 1))


@query("sections_callable", f"WITH {_GRID} SELECT section, round(max(st) - min(st), 4) + 0.0 AS value FROM m GROUP BY section")
def sections_callable(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", lambda c: F.max(c) - F.min(c), calc_per="section").select("section", r("value", 4))


@query("sections_all", f"WITH {_GRID} SELECT round(avg(st), 4) + 0.0 AS value FROM m")
def sections_all(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.section_statistic(meas, _grid_sections(spark), "st", F.avg, calc_per="all").select(r("value", 4))


@query(
    "sections_levels",
    f"WITH {_GRID} SELECT section, stretch_id, count(st) AS n, round(avg(st), 4) + 0.0 AS mean, round(var_samp(st), 1) + 0.0 AS var FROM m GROUP BY GROUPING SETS ((section, stretch_id), (section), ())",
)
def sections_levels(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.statistic_at_all_levels(meas, _grid_sections(spark), "st").select("section", "stretch_id", "n", r("mean", 4), r("var", 1))


@query(
    "sections_describe",
    f"WITH {_GRID} SELECT m.section, m.stretch_id, count(DISTINCT ix) AS locations, count(st) AS readings, round(avg(bath), 6) + 0.0 AS bath_mean, round(stddev_pop(bath), 6) + 0.0 AS bath_std, min(z.x_start) AS x_start, min(z.x_stop) AS x_stop "
    "FROM m JOIN z ON m.section = z.section AND m.stretch_id = z.stretch_id GROUP BY m.section, m.stretch_id",
)
def sections_describe(spark, sf_dir):
    meas, series = grid(spark, sf_dir)
    return sec.describe(meas, series, _grid_sections(spark)).select("section", "stretch_id", "locations", "readings", r("bath_mean", 6), r("bath_std", 6), "x_start", "x_stop")


@query("sections_overlaps", "SELECT section, CAST(stretch_id AS INT) AS stretch_id, x_start FROM (VALUES ('b', 1, 5.0::DOUBLE), ('c', 1, 30.0::DOUBLE)) AS v(section, stretch_id, x_start)")
def sections_overlaps(spark, sf_dir):
    given = sec.sections_frame(spark, {"a": [(0, 10), (40, 50)], "b": [(5, 8), (20, 40)], "c": [(30, 31)]})
    return sec.overlaps(given).select("section", "stretch_id", "x_start")


_PAIRS = "pairs AS (SELECT * FROM (VALUES (1, 10.0::DOUBLE, 20.0::DOUBLE, 60.0::DOUBLE, 70.0::DOUBLE, true), (2, 22.0, 28.0, 72.0, 78.0, false)) AS p(pair_id, h0, h1, t0, t1, reverse))"
_MATCH = f"""
WITH {_GRID}, {_PAIRS}, w AS (SELECT DISTINCT ix, x FROM g),
h AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY x) AS rank, ix AS head_ix FROM w JOIN pairs ON x BETWEEN h0 AND h1),
u AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN reverse THEN -x ELSE x END) AS rank, ix AS tail_ix FROM w JOIN pairs ON x BETWEEN t0 AND t1)
"""


def _matching(spark):
    return spark.createDataFrame([(1, 10.0, 20.0, 60.0, 70.0, True), (2, 22.0, 28.0, 72.0, 78.0, False)], "pair_id int, h_start double, h_stop double, t_start double, t_stop double, reverse boolean")


@query("matching_pairs", _MATCH + "SELECT h.pair_id, CAST(h.rank AS INT) AS rank, head_ix, tail_ix FROM h JOIN u ON h.pair_id = u.pair_id AND h.rank = u.rank")
def matching_pairs(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return sec.match_pairs(meas.select("ix", "x").distinct(), _matching(spark))


@query("matching_locations", _MATCH + "SELECT ix FROM (SELECT ix FROM m UNION SELECT head_ix FROM h UNION SELECT tail_ix FROM u) EXCEPT SELECT min(ix) FROM m")
def matching_locations(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    where = meas.select("ix", "x").distinct()
    return sec.fitted_locations(where, _grid_sections(spark), sec.match_pairs(where, _matching(spark)))


# selections and small operators


@query("slice_inclusive", f"WITH {_GRID} SELECT ix, CAST(quarter AS BIGINT) AS quarter, round(st, 4) + 0.0 AS st FROM g WHERE x BETWEEN 10 AND 24")
def slice_inclusive(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return meas.filter(resampling.between("x", 10.0, 24.0)).select("ix", quarter(), r("st", 4))


@query("select_by_place", f"WITH {_GRID}, o AS (SELECT quarter, row_number() OVER (ORDER BY quarter) AS k, count(*) OVER () AS last FROM s) SELECT ix, CAST(g.quarter AS BIGINT) AS quarter, round(st, 4) + 0.0 AS st FROM g JOIN o ON g.quarter = o.quarter WHERE k IN (1, 4, last)")
def select_by_place(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return resampling.select_ordinals(meas, "time", [0, 3, -1]).select("ix", quarter(), r("st", 4))


@query("outside_sections_null", f"WITH {_GRID} SELECT g.ix, CAST(g.quarter AS BIGINT) AS quarter, CASE WHEN EXISTS (SELECT 1 FROM z WHERE g.x BETWEEN z.x_start AND z.x_stop) THEN round(g.st, 4) + 0.0 END AS st FROM g")
def outside_sections_null(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return resampling.outside_null(meas, _grid_sections(spark), ["st"]).select("ix", quarter(), r("st", 4))


@query("scale_where", f"WITH {_GRID} SELECT ix, CAST(quarter AS BIGINT) AS quarter, round(CASE WHEN x < 50 THEN st * 0.8::DOUBLE ELSE st END, 4) + 0.0 AS st FROM g")
def scale_where(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    return resampling.scale_where(meas, "st", F.col("x") < 50, 0.8).select("ix", quarter(), r("st", 4))


@query("whole_locations", f"WITH {_GRID} SELECT ix, CAST(quarter AS BIGINT) AS quarter, n FROM g WHERE ix NOT IN (SELECT ix FROM g WHERE n < 17)")
def whole_locations(spark, sf_dir):
    meas, _ = grid(spark, sf_dir)
    gaps = meas.withColumn("v", F.when(F.col("n") >= 17, F.col("st")))
    return alignment.whole_locations(gaps, ["v"]).select("ix", quarter(), "n")


@query("percentiles_in_time", "SELECT pos AS ix, round(quantile_cont(v, 0.025), 6) + 0.0 AS low, round(quantile_cont(v, 0.975), 6) + 0.0 AS high FROM (SELECT unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY pos")
def percentiles_in_time(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("ix", "v"))
    q = sampling.percentiles(F.collect_list(F.col("v").cast("double")), (2.5, 97.5))  # as many values as times of this fixture
    return rows.groupBy("ix").agg(q.alias("q")).select("ix", (F.round(F.get("q", F.lit(0)), 6) + 0.0).alias("low"), (F.round(F.get("q", F.lit(1)), 6) + 0.0).alias("high"))


@query("colour_limits", f"WITH {_trace_sql()} SELECT round(quantile_cont(temp, 0.02), 6) + 0.0 AS low, round(quantile_cont(temp, 0.98), 6) + 0.0 AS high FROM f")
def colour_limits(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return reports.colour_limits(meas, "temp", exact=True).select(r("low", 6), r("high", 6))


# noise variance

_STRETCH = "SELECT vec_id, ix, x, section, stretch_id, st, 1.0::DOUBLE AS h FROM f WHERE section IS NOT NULL"


def _constant_sql(rounds: int = 3) -> str:
    out, last = f"{_trace_sql()}, a0 AS ({_STRETCH})", "a0"
    for k in range(1, rounds + 1):
        out += f""",
g{k} AS (SELECT section, stretch_id, vec_id, sum(h * st) / sum(h * h) AS g FROM {last} GROUP BY section, stretch_id, vec_id),
b{k} AS (SELECT a.vec_id, a.ix, a.x, a.section, a.stretch_id, a.st, g{k}.g FROM {last} a JOIN g{k} USING (section, stretch_id, vec_id)),
h{k} AS (SELECT section, stretch_id, ix, sum(g * st) / sum(g * g) AS h FROM b{k} GROUP BY section, stretch_id, ix),
a{k} AS (SELECT b.*, h{k}.h FROM b{k} b JOIN h{k} USING (section, stretch_id, ix))"""
        last = f"a{k}"
    return out + f", resid AS (SELECT vec_id, ix, x, section, stretch_id, st, g * h - st AS resid FROM {last})"


@query("noise_constant", f"WITH {_constant_sql()} SELECT round(var_samp(resid), 6) AS variance, count(resid) AS n FROM resid")
def noise_constant(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return noise.variance_constant(meas, sec.sections_frame(spark, SECTIONS), "st").frame().select(r("variance", 6), "n")


@query("noise_constant_residuals", f"WITH {_constant_sql()} SELECT vec_id, f.ix, round(resid.resid, 6) + 0.0 AS resid FROM f LEFT JOIN resid USING (vec_id, ix)")
def noise_constant_residuals(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return noise.variance_constant(meas, sec.sections_frame(spark, SECTIONS), "st").everywhere(meas).select(no_of(), "ix", r("resid", 6))


_EXPONENTIAL = f"""
WITH {_trace_sql()}, a AS ({_STRETCH}),
c AS (SELECT section, stretch_id, vec_id, sum(st * st * x) / sum(st * st) AS x0, sum(st * st * ln(st)) / sum(st * st) AS y0 FROM a GROUP BY section, stretch_id, vec_id),
d AS (SELECT a.*, x - x0 AS dx, ln(st) - y0 AS dy, y0 FROM a JOIN c USING (section, stretch_id, vec_id)),
b AS (SELECT section, stretch_id, sum(st * st * dx * dy) / sum(st * st * dx * dx) AS b FROM d GROUP BY section, stretch_id),
resid AS (SELECT d.*, exp(y0 + b * dx) - st AS resid FROM d JOIN b USING (section, stretch_id))
"""


@query("noise_exponential", _EXPONENTIAL + "SELECT round(var_samp(resid), 6) AS variance, count(resid) AS n FROM resid")
def noise_exponential(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return noise.variance_exponential(meas, sec.sections_frame(spark, SECTIONS), "st").frame().select(r("variance", 6), "n")


@query("noise_exponential_residuals", _EXPONENTIAL + "SELECT vec_id, ix, section, stretch_id, round(resid, 6) + 0.0 AS resid FROM resid")
def noise_exponential_residuals(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return noise.variance_exponential(meas, sec.sections_frame(spark, SECTIONS), "st").residuals.select(no_of(), "ix", "section", "stretch_id", r("resid", 6))


_BINS = f"""
WITH {_constant_sql()}, o AS (SELECT st, resid, row_number() OVER (ORDER BY st, ix, vec_id, section, stretch_id) - 1 AS k, count(*) OVER () AS n FROM resid),
nb AS (SELECT max(b) AS nb FROM (SELECT unnest(range(1, 51)) AS b), (SELECT count(*) AS n FROM resid) WHERE n % b = 0),
bins AS (SELECT CAST(k // (o.n // nb) AS INT) AS bin, count(*) AS n, avg(st) AS mean, var_pop(resid) AS variance FROM o, nb GROUP BY bin)
"""


@query("noise_bins", _BINS + "SELECT bin, n, round(mean, 4) AS mean, round(variance, 5) AS variance FROM bins")
def noise_bins(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    return noise.variance_linear(meas, sec.sections_frame(spark, SECTIONS), "st").bins.select("bin", "n", r("mean", 4), r("variance", 5))


@query("noise_linear", _BINS + "SELECT round(regr_slope(variance, mean), 8) + 0.0 AS slope, round(regr_intercept(variance, mean), 4) + 0.0 AS intercept, round(sum(mean * variance) / sum(mean * mean), 8) + 0.0 AS through_zero FROM bins")
def noise_linear(spark, sf_dir):
    import warnings

    meas, _ = trace(spark, sf_dir)
    sections = sec.sections_frame(spark, SECTIONS)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        line = noise.variance_linear(meas, sections, "st")
    zero = line.bins.agg((F.sum(F.col("mean") * F.col("variance")) / F.sum(F.col("mean") * F.col("mean"))).alias("through_zero"))
    return zero.select(r(F.lit(line.slope), 8, "slope"), r(F.lit(line.offset), 4, "intercept"), r("through_zero", 8))


@query("noise_function", _BINS + ", line AS (SELECT sum(mean * variance) / sum(mean * mean) AS s FROM bins) SELECT vec_id, ix, round(f.st * line.s, 5) + 0.0 AS st_v FROM f, line")
def noise_function(spark, sf_dir):
    meas, _ = trace(spark, sf_dir)
    line = noise.variance_linear(meas, sec.sections_frame(spark, SECTIONS), "st", through_zero=True)
    return with_variance(meas, "st", line.function()).select(no_of(), "ix", r("st_v", 5))


@query("acquisition_range", "SELECT round(min(useracquisitiontimefw), 6) AS low, round(max(useracquisitiontimefw), 6) AS high, (max(useracquisitiontimefw) - min(useracquisitiontimefw)) / ((max(useracquisitiontimefw) + min(useracquisitiontimefw)) / 2) < 0.05 AS alike FROM series")
def acquisition_range(spark, sf_dir):
    rows = table(spark, sf_dir, "series")
    try:
        noise.check_acquisition(rows, "useracquisitiontimefw")
        alike = True
    except ValueError:
        alike = False
    return rows.agg(F.round(F.min("useracquisitiontimefw"), 6).alias("low"), F.round(F.max("useracquisitiontimefw"), 6).alias("high"), F.lit(alike).alias("alike"))


# single-ended calibration


def _variances() -> tuple:
    return (lambda s: s * VAR["st"]), (lambda s: s * VAR["ast"])


def _single_sql(gamma: tuple | None = None, dalpha: tuple | None = None, alpha: bool = False) -> str:
    """The weighted regression in closed form: what is free is regressed on deviations from each time's weighted means."""
    y, v = "ln(st / ast)", f"{VAR['st']}::DOUBLE / st + {VAR['ast']}::DOUBLE / ast"
    if gamma:
        y, v = f"{y} - {gamma[0]!r}::DOUBLE / temp", f"{v} + {gamma[1]!r}::DOUBLE / temp / temp"
    if dalpha:
        y, v = f"{y} + {dalpha[0]!r}::DOUBLE * x", f"{v} + {dalpha[1]!r}::DOUBLE * x * x"
    if alpha:
        y, v = f"{y} + {AP - AM!r}::DOUBLE * x", f"{v} + {ALPHA_VAR!r}::DOUBLE"
    free_g, free_d = gamma is None, dalpha is None and not alpha
    u, x = ("1 / temp" if free_g else "0.0::DOUBLE"), ("-x" if free_d else "0.0::DOUBLE")
    if free_g and free_d:
        solve = "(c * p - b * q) / (a * c - b * b) AS gamma, (a * q - b * p) / (a * c - b * b) AS dalpha, c / (a * c - b * b) AS gg, a / (a * c - b * b) AS dd, -b / (a * c - b * b) AS gd"
    elif free_g:
        solve = "p / a AS gamma, 0.0::DOUBLE AS dalpha, 1 / a AS gg, 0.0::DOUBLE AS dd, 0.0::DOUBLE AS gd"
    elif free_d:
        solve = "0.0::DOUBLE AS gamma, q / c AS dalpha, 0.0::DOUBLE AS gg, 1 / c AS dd, 0.0::DOUBLE AS gd"
    else:
        solve = "0.0::DOUBLE AS gamma, 0.0::DOUBLE AS dalpha, 0.0::DOUBLE AS gg, 0.0::DOUBLE AS dd, 0.0::DOUBLE AS gd"
    n_free = int(free_g) + int(free_d)
    value = lambda free, name, given: f"p0.{name}" if free else f"{(given or (0.0, 0.0))[0]!r}::DOUBLE"
    var = lambda free, name, given: f"p0.{name} * err" if free else f"{(given or (0.0, 0.0))[1]!r}::DOUBLE"
    return f"""
WITH {_trace_sql()},
r0 AS (SELECT vec_id, {u} AS u, {x} AS x, {y} AS y, 1 / ({v}) AS w FROM f WHERE section IS NOT NULL),
m0 AS (SELECT vec_id, sum(w) AS sw, sum(w * u) / sum(w) AS mu, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r0 GROUP BY vec_id),
d0 AS (SELECT w, u - mu AS u, x - mx AS x, y - my AS y FROM r0 JOIN m0 USING (vec_id)),
s0 AS (SELECT sum(w * u * u) AS a, sum(w * u * x) AS b, sum(w * x * x) AS c, sum(w * u * y) AS p, sum(w * x * y) AS q FROM d0),
p0 AS (SELECT {solve} FROM s0),
e0 AS (SELECT sum(w * (y - gamma * u - dalpha * x) * (y - gamma * u - dalpha * x)) / (count(*) - {n_free} - (SELECT count(*) FROM m0)) AS err FROM d0, p0),
par AS (SELECT {value(free_g, 'gamma', gamma)} AS gamma, {var(free_g, 'gg', gamma)} AS gamma_var, {value(free_d, 'dalpha', dalpha)} AS dalpha, {var(free_d, 'dd', dalpha)} AS dalpha_var, gd * err AS gd, gg * err AS gg, dd * err AS dd, err,
  p0.gamma AS g1, p0.dalpha AS d1 FROM p0, e0),
tim AS (SELECT vec_id, g1 * mu + d1 * mx - my AS c, err / sw + mu * mu * gg + mx * mx * dd + 2 * mu * mx * gd AS c_var, mu * gg + mx * gd AS gamma_c, mu * gd + mx * dd AS dalpha_c FROM m0, par),
tmp AS (SELECT f.*, par.*, tim.c, tim.c_var, tim.gamma_c, tim.dalpha_c, par.gamma / (ln(st / ast) + c + {f'{AP - AM!r}::DOUBLE' if alpha else 'par.dalpha'} * x) AS tk,
  {f'{ALPHA_VAR!r}::DOUBLE' if alpha else 'par.dalpha_var * x * x'} AS alpha_var FROM f JOIN tim USING (vec_id), par),
com AS (SELECT *, tk * tk * tk * tk / gamma / gamma / st * {VAR['st']}::DOUBLE AS dT_dst, tk * tk * tk * tk / gamma / gamma / ast * {VAR['ast']}::DOUBLE AS dT_dast, tk * tk / gamma / gamma * gamma_var AS dT_dgamma,
  tk * tk * tk * tk / gamma / gamma * c_var AS dT_dc, tk * tk * tk * tk / gamma / gamma * alpha_var AS dT_dalpha, -2 * tk * tk * tk / gamma / gamma * gamma_c AS dgamma_dc,
  {'0.0::DOUBLE' if alpha else '-2 * x * tk * tk * tk / gamma / gamma * gd'} AS dgamma_ddalpha, {'0.0::DOUBLE' if alpha else '2 * x * tk * tk * tk * tk / gamma / gamma * dalpha_c'} AS ddalpha_dc FROM tmp)
"""


def _single(spark, sf_dir, noisy=True, **kw):
    meas, series = trace(spark, sf_dir, noisy)
    return calibrate_single(meas.select("ix", "x", "time", "st", "ast", "temp"), series, sec.sections_frame(spark, SECTIONS), *_variances(), **kw)


def _given_alpha(spark):
    return spark.createDataFrame([(i, (AP - AM) * i, ALPHA_VAR) for i in range(64)], "ix int, alpha double, alpha_var double")


_FIXES = {"free": {}, "gamma": {"gamma": (482.0, 0.01)}, "dalpha": {"dalpha": (6.4e-5, 1e-12)}, "both": {"gamma": (482.0, 0.01), "dalpha": (6.4e-5, 1e-12)}, "alpha": {"alpha": True}}


def _fixed(spark, name: str) -> dict:
    return {"alpha": {"fix_alpha": _given_alpha(spark)}}.get(name) or {f"fix_{k}": v for k, v in _FIXES[name].items()}


def _single_queries() -> None:
    for name, fix in _FIXES.items():
        sql = _single_sql(**fix)
        tail = "" if name == "free" else f"_fix_{name}"

        @query(f"single_times{tail}", sql + "SELECT vec_id, round(c, 7) + 0.0 AS c, round(c_var * 1e6, 7) + 0.0 AS c_var_e6, round(gamma_c * 1e3, 6) + 0.0 AS gamma_c_e3 FROM tim")
        def times(spark, sf_dir, name=name):
            p = _single(spark, sf_dir, **_fixed(spark, name)).params_t
            return p.select(no_of(), r("c", 7), r(F.col("c_var") * 1e6, 7, "c_var_e6"), r(F.col("gamma_c") * 1e3, 6, "gamma_c_e3"))

        @query(f"single_temperature{tail}", sql + "SELECT vec_id, ix, round(tk - 273.15, 4) + 0.0 AS tmpf, round(dT_dst + dT_dast + dT_dgamma + dT_dc + dT_dalpha + dgamma_dc + dgamma_ddalpha + ddalpha_dc, 6) + 0.0 AS tmpf_var FROM com")
        def temperature(spark, sf_dir, name=name):
            return _single(spark, sf_dir, **_fixed(spark, name)).temperature.select(no_of(), "ix", r("tmpf", 4), r("tmpf_var", 6))


_single_queries()


@query("single_parameters", _single_sql() + "SELECT round(gamma, 5) AS gamma, round(gamma_var * 1e3, 5) AS gamma_var_e3, round(dalpha * 1e6, 5) AS dalpha_e6, round(dalpha_var * 1e15, 4) AS dalpha_var_e15, round(err, 8) AS err FROM par")
def single_parameters(spark, sf_dir):
    res = _single(spark, sf_dir)
    p = res.params
    return spark.range(1).select(r(F.lit(p["gamma"]), 5, "gamma"), r(F.lit(p["gamma_var"] * 1e3), 5, "gamma_var_e3"), r(F.lit(p["dalpha"] * 1e6), 5, "dalpha_e6"), r(F.lit(p["dalpha_var"] * 1e15), 4, "dalpha_var_e15"), r(F.lit(res.fit.err), 8, "err"))


_PARTS = ("dT_dst", "dT_dast", "dT_dgamma", "dT_dc", "dT_dalpha", "dgamma_dc", "dgamma_ddalpha", "ddalpha_dc")


@query("single_components", _single_sql() + f"SELECT vec_id, ix, {', '.join(f'round({c} * 1e3, 5) + 0.0 AS {c}' for c in _PARTS)} FROM com")
def single_components(spark, sf_dir):
    return _single(spark, sf_dir).temperature.select(no_of(), "ix", *[r(F.col(c) * 1e3, 5, c) for c in _PARTS])


@query("single_exact", f"WITH {_trace_sql(False)} SELECT vec_id, ix, round(temp - 273.15, 4) + 0.0 AS tmpf FROM f")
def single_exact(spark, sf_dir):
    return _single(spark, sf_dir, False).temperature.select(no_of(), "ix", r("tmpf", 4))


@query("single_locations", _single_sql() + f"SELECT DISTINCT ix, round(x * dalpha * 1e6, 4) + 0.0 AS alpha_e6 FROM tmp")
def single_locations(spark, sf_dir):
    return _single(spark, sf_dir).params_x.select("ix", r(F.col("alpha") * 1e6, 4, "alpha_e6"))



# double-ended calibration


def _double_vars() -> list:
    return [lambda s: s * VAR["st"], lambda s: s * VAR["ast"]] * 2


def _double(spark, sf_dir, noisy=True, **kw):
    meas, series = trace(spark, sf_dir, noisy)
    return calibrate_double(meas.drop("temp"), series, sec.sections_frame(spark, SECTIONS), *_double_vars(), **kw)


@query("double_exact", f"WITH {_trace_sql(False)} SELECT vec_id, ix, round(temp - 273.15, 4) + 0.0 AS tmpf, round(temp - 273.15, 4) + 0.0 AS tmpb, round(temp - 273.15, 4) + 0.0 AS tmpw FROM f")
def double_exact(spark, sf_dir):
    """All parameters free; without noise the fit must return the temperatures themselves."""
    return _double(spark, sf_dir, False).temperature.select(no_of(), "ix", r("tmpf", 4), r("tmpb", 4), r("tmpw", 4))


@query("double_exact_locations", f"WITH {_trace_sql(False)} SELECT DISTINCT ix, round(x * {(AP - AM) * 1e6!r}::DOUBLE, 3) + 0.0 AS alpha_e6 FROM f")
def double_exact_locations(spark, sf_dir):
    return _double(spark, sf_dir, False).params_x.select("ix", r(F.col("alpha") * 1e6, 3, "alpha_e6"))


def _double_sql(gamma: tuple | None = None) -> str:
    """Given attenuations: what is left is gamma and an offset of each direction and time, in closed form."""
    a = f"{AP - AM!r}::DOUBLE * x"
    lines = []
    for d, st, ast, sign in (("f", "st", "ast", "+"), ("b", "rst", "rast", "-")):
        y, v = f"ln({st} / {ast}) {sign} {a}", f"{VAR['st']}::DOUBLE / {st} + {VAR['ast']}::DOUBLE / {ast} + {ALPHA_VAR!r}::DOUBLE"
        if gamma:
            y, v = f"{y} - {gamma[0]!r}::DOUBLE / temp", f"{v} + {gamma[1]!r}::DOUBLE / temp / temp"
        lines.append(f"SELECT vec_id, '{d}' AS d, {'0.0::DOUBLE' if gamma else '1 / temp'} AS u, {y} AS y, 1 / ({v}) AS w FROM f WHERE section IS NOT NULL")
    g, gv = (f"{gamma[0]!r}::DOUBLE", f"{gamma[1]!r}::DOUBLE") if gamma else ("g1", "gg")
    return f"""
WITH {_trace_sql()}, r0 AS ({' UNION ALL '.join(lines)}),
m0 AS (SELECT vec_id, d, sum(w) AS sw, sum(w * u) / sum(w) AS mu, sum(w * y) / sum(w) AS my FROM r0 GROUP BY vec_id, d),
d0 AS (SELECT w, u - mu AS u, y - my AS y FROM r0 JOIN m0 USING (vec_id, d)),
p0 AS (SELECT {'max(0.0::DOUBLE)' if gamma else 'sum(w * u * y) / sum(w * u * u)'} AS g1, {'max(0.0::DOUBLE)' if gamma else '1 / sum(w * u * u)'} AS gn FROM d0),
e0 AS (SELECT sum(w * (y - g1 * u) * (y - g1 * u)) / (count(*) - {0 if gamma else 1} - (SELECT count(*) FROM m0)) AS err FROM d0, p0),
par AS (SELECT {g} AS gamma, {gv} AS gamma_var, g1, gg, err FROM (SELECT g1, gn * err AS gg, err FROM p0, e0)),
tim AS (SELECT m.vec_id, g1 * m.mu - m.my AS df, g1 * n.mu - n.my AS db, err / m.sw + m.mu * m.mu * gg AS df_var, err / n.sw + n.mu * n.mu * gg AS db_var, m.mu * gg AS gamma_df, n.mu * gg AS gamma_db, m.mu * n.mu * gg AS df_db
  FROM m0 m JOIN m0 n ON m.vec_id = n.vec_id AND m.d = 'f' AND n.d = 'b', par),
tmp AS (SELECT f.*, gamma, gamma_var, tim.df, tim.db, df_var, db_var, gamma_df, gamma_db, df_db, gamma / (ln(st / ast) + tim.df + {a}) AS tf, gamma / (ln(rst / rast) + tim.db - {a}) AS tb, {ALPHA_VAR!r}::DOUBLE AS av FROM f JOIN tim USING (vec_id), par),
q0 AS (SELECT *, tf * tf / gamma AS ef, tb * tb / gamma AS eb FROM tmp),
q1 AS (SELECT *, ef * ef * ({VAR['st']}::DOUBLE / st + {VAR['ast']}::DOUBLE / ast) AS nf, eb * eb * ({VAR['st']}::DOUBLE / rst + {VAR['ast']}::DOUBLE / rast) AS nb FROM q0),
q2 AS (SELECT *, nf + tf * tf / gamma / gamma * gamma_var + ef * ef * (df_var + av) - 2 * tf / gamma * ef * gamma_df AS vf, nb + tb * tb / gamma / gamma * gamma_var + eb * eb * (db_var + av) - 2 * tb / gamma * eb * gamma_db AS vb FROM q1),
q3 AS (SELECT *, vb / (vf + vb) AS wf, vf / (vf + vb) AS wb, vf * vb / (vf + vb) AS approx, nf * nb / (nf + nb) AS lower_ FROM q2),
q4 AS (SELECT *, (wf * tf + wb * tb) / gamma AS gw, wf * ef AS fw, wb * eb AS bw FROM q3),
com AS (SELECT *, wf * tf + wb * tb AS tw, wf * wf * nf + wb * wb * nb + gw * gw * gamma_var + fw * fw * df_var + bw * bw * db_var + (fw - bw) * (fw - bw) * av - 2 * gw * fw * gamma_df - 2 * gw * bw * gamma_db + 2 * fw * bw * df_db AS vw FROM q4)
"""


for _name, _gamma in (("fix_alpha", None), ("fix_both", (482.0, 0.01))):

    def _kw(spark, gamma=_gamma):
        return {"fix_alpha": _given_alpha(spark)} | ({"fix_gamma": gamma} if gamma else {})

    @query(f"double_times_{_name}", _double_sql(_gamma) + "SELECT vec_id, round(df, 7) + 0.0 AS df, round(db, 7) + 0.0 AS db, round(df_var * 1e6, 6) + 0.0 AS df_var_e6, round(db_var * 1e6, 6) + 0.0 AS db_var_e6, round(df_db * 1e6, 6) + 0.0 AS df_db_e6 FROM tim")
    def _times(spark, sf_dir, kw=_kw):
        p = _double(spark, sf_dir, **kw(spark)).params_t
        return p.select(no_of(), r("df", 7), r("db", 7), *[r(F.col(c) * 1e6, 6, f"{c}_e6") for c in ("df_var", "db_var", "df_db")])

    @query(f"double_temperature_{_name}", _double_sql(_gamma) + "SELECT vec_id, ix, round(tf - 273.15, 4) + 0.0 AS tmpf, round(tb - 273.15, 4) + 0.0 AS tmpb, round(tw - 273.15, 4) + 0.0 AS tmpw FROM com")
    def _temperature(spark, sf_dir, kw=_kw):
        return _double(spark, sf_dir, **kw(spark)).temperature.select(no_of(), "ix", r("tmpf", 4), r("tmpb", 4), r("tmpw", 4))

    @query(f"double_variance_{_name}", _double_sql(_gamma) + "SELECT vec_id, ix, round(vf, 6) + 0.0 AS tmpf_var, round(vb, 6) + 0.0 AS tmpb_var, round(vw, 6) + 0.0 AS tmpw_var, round(approx, 6) + 0.0 AS tmpw_var_approx, round(lower_, 6) + 0.0 AS tmpw_var_lower FROM com")
    def _variance(spark, sf_dir, kw=_kw):
        return _double(spark, sf_dir, **kw(spark)).temperature.select(no_of(), "ix", *[r(f"tmp{c}", 6) for c in ("f_var", "b_var", "w_var", "w_var_approx", "w_var_lower")])


@query("double_external", _double_sql((482.0, 0.01)) + f"SELECT vec_id, ix, round(gamma / (ln(st / ast) + df + {AP - AM!r}::DOUBLE * x) - 273.15, 4) + 0.0 AS tmpf FROM tmp WHERE section IS NOT NULL")
def double_external(spark, sf_dir):
    """The parameters of one calibration given to another; locations of the sections, whose attenuations are given."""
    meas, series = trace(spark, sf_dir)
    sections = sec.sections_frame(spark, SECTIONS)
    first = _double(spark, sf_dir, fix_alpha=_given_alpha(spark), fix_gamma=(482.0, 0.01))
    shared = {"gamma": (482.0, 0.01)} | {f"alpha_{i}": ((AP - AM) * i, ALPHA_VAR) for i in range(64)}
    given = External(shared, first.params_t.select("time", "df", "db", "df_var", "db_var"))
    out = calibrate_double(meas.drop("temp"), series, sections, *_double_vars(), external=given).temperature
    return sec.members(out, sections).select(no_of(), "ix", r("tmpf", 4))


@query("single_external", _single_sql() + "SELECT vec_id, ix, round(tk - 273.15, 4) + 0.0 AS tmpf FROM com")
def single_external(spark, sf_dir):
    meas, series = trace(spark, sf_dir)
    first = _single(spark, sf_dir)
    given = External({"gamma": first.fit.get("gamma"), "dalpha": first.fit.get("dalpha")}, first.params_t.select("time", "c", "c_var"))
    out = calibrate_single(meas.select("ix", "x", "time", "st", "ast"), series, sec.sections_frame(spark, SECTIONS), *_variances(), external=given).temperature
    return out.select(no_of(), "ix", r("tmpf", 4))


@query("single_p_val", _single_sql() + "SELECT name, vec_id, round(value, 5) + 0.0 AS value, round(var * 1e6, 5) + 0.0 AS var_e6 FROM (SELECT 'gamma' AS name, CAST(NULL AS BIGINT) AS vec_id, gamma AS value, gamma_var AS var FROM par UNION ALL SELECT 'dalpha', NULL, dalpha, dalpha_var FROM par UNION ALL SELECT 'c', vec_id, c, c_var FROM tim)")
def single_p_val(spark, sf_dir):
    return _single(spark, sf_dir).fit.p_val().select("name", no_of(), r("value", 5), r(F.col("var") * 1e6, 5, "var_e6"))


@query(
    "single_p_cov",
    _single_sql() + "SELECT name, other, vec_id, round(cov * 1e6, 5) + 0.0 AS cov_e6 FROM (SELECT 'gamma' AS name, 'gamma' AS other, CAST(NULL AS BIGINT) AS vec_id, gg AS cov FROM par UNION ALL SELECT 'gamma', 'dalpha', NULL, gd FROM par UNION ALL SELECT 'dalpha', 'gamma', NULL, gd FROM par "
    "UNION ALL SELECT 'dalpha', 'dalpha', NULL, dd FROM par UNION ALL SELECT 'c', 'c', vec_id, c_var FROM tim UNION ALL SELECT 'c', 'gamma', vec_id, gamma_c FROM tim UNION ALL SELECT 'c', 'dalpha', vec_id, dalpha_c FROM tim)",
)
def single_p_cov(spark, sf_dir):
    return _single(spark, sf_dir).fit.p_cov().select("name", "other", no_of(), r(F.col("cov") * 1e6, 5, "cov_e6"))


# Monte Carlo

SAMPLES, SEED = 20, 7


def _uniform(name: str, *parts: str) -> str:
    text = " || '|' || ".join([f"'{SEED}|{name}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) * {2.0**-52!r}::DOUBLE)"


def _normal(name: str, *parts: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(name + '/u', *parts)})) * cos(2 * pi() * {_uniform(name + '/v', *parts)}))"


_US = f"vec_id * {MINUTE}"
_SAMPLES = _single_sql() + f""",
mcs AS (SELECT unnest(range({SAMPLES})) AS mc),
sh AS (SELECT mc, sqrt(gg) * {_normal('gamma', 'mc')} AS og, gd / sqrt(gg) * {_normal('gamma', 'mc')} + sqrt(dd - gd * gd / gg) * {_normal('dalpha', 'mc')} AS od FROM mcs, par),
ow AS (SELECT vec_id, mc, c + mu * og + mx * od + sqrt(err / sw) * {_normal('c', 'mc', _US)} AS c_mc FROM tim JOIN m0 USING (vec_id), sh, par),
it AS (SELECT tmp.vec_id, ix, x, mc, tk - 273.15 AS tmpf, gamma + og AS g_mc, dalpha + od AS d_mc, st + sqrt(st * {VAR['st']}::DOUBLE) * {_normal('st', 'mc', 'ix', _US)} AS s_mc, ast + sqrt(ast * {VAR['ast']}::DOUBLE) * {_normal('ast', 'mc', 'ix', _US)} AS a_mc FROM tmp, sh),
sam AS (SELECT it.vec_id, ix, x, it.mc, tmpf, g_mc / (ln(s_mc / a_mc) + c_mc + d_mc * x) - 273.15 AS t FROM it JOIN ow ON it.vec_id = ow.vec_id AND it.mc = ow.mc)
"""


def _drawn(spark, sf_dir):
    return sampling.sample_single(_single(spark, sf_dir), SAMPLES, SEED, sampling.digested)


@query("monte_carlo_variance", _SAMPLES + "SELECT vec_id, ix, round(var_samp(t - tmpf), 6) AS tmpf_mc_var, round(quantile_cont(t, 0.025), 4) + 0.0 AS low, round(quantile_cont(t, 0.975), 4) + 0.0 AS high FROM sam GROUP BY vec_id, ix")
def monte_carlo_variance(spark, sf_dir):
    out = sampling.single_statistics(_drawn(spark, sf_dir))
    return out.select(no_of(), "ix", r("tmpf_mc_var", 6), r(F.get("tmpf_mc", F.lit(0)), 4, "low"), r(F.get("tmpf_mc", F.lit(1)), 4, "high"))


_KEYS = {"time": ("ix", "x BETWEEN 0 AND 1e9"), "x": ("vec_id", "x BETWEEN 20 AND 27")}


for _over, (_key, _part) in _KEYS.items():
    _mean = f"""SELECT {_key}, round(avg(tmpf), 4) + 0.0 AS tmpf_avg, round(var_samp(t - tmpf), 6) AS tmpf_avg_var, round(quantile_cont(t, 0.025), 4) + 0.0 AS low, round(quantile_cont(t, 0.975), 4) + 0.0 AS high FROM sam WHERE {_part} GROUP BY {_key}"""
    _weighted = f""", q AS (SELECT vec_id, ix, var_samp(t - tmpf) AS q FROM sam WHERE {_part} GROUP BY vec_id, ix),
    a AS (SELECT {_key}, mc, sum(t / q) / sum(1 / q) AS m, 1 / sum(1 / q) AS v FROM sam JOIN q USING (vec_id, ix) GROUP BY {_key}, mc)
    SELECT {_key}, round(avg(m), 4) + 0.0 AS tmpf_avg, round(min(v), 7) AS tmpf_avg_var, round(quantile_cont(m, 0.025), 4) + 0.0 AS low, round(quantile_cont(m, 0.975), 4) + 0.0 AS high FROM a GROUP BY {_key}"""

    def _average(spark, sf_dir, kind=1, over=_over):
        part = sampling.selected(_drawn(spark, sf_dir), x_sel=None if over == "time" else (20.0, 27.0))
        out = sampling.average(part, over, kind, exact=True)
        return out.select("ix" if over == "time" else no_of(), r("tmpf_avg", 4), r("tmpf_avg_var", 6 if kind == 1 else 7), r(F.get("tmpf_avg_ci", F.lit(0)), 4, "low"), r(F.get("tmpf_avg_ci", F.lit(1)), 4, "high"))

    query(f"average_{_over}_1", _SAMPLES + _mean)(lambda spark, sf_dir, f=_average: f(spark, sf_dir, 1))
    query(f"average_{_over}_2", _SAMPLES + _weighted)(lambda spark, sf_dir, f=_average: f(spark, sf_dir, 2))


_MC2 = _double_sql() + f""",
mcs AS (SELECT unnest(range({SAMPLES})) AS mc), sh AS (SELECT mc, sqrt(gg) * {_normal('gamma', 'mc')} AS og FROM mcs, par),
ow AS (SELECT tim.vec_id, mc, tim.df + m.mu * og + sqrt(err / m.sw) * {_normal('df', 'mc', 'tim.' + _US)} AS f_mc, tim.db + n.mu * og + sqrt(err / n.sw) * {_normal('db', 'mc', 'tim.' + _US)} AS b_mc
  FROM tim JOIN m0 m ON tim.vec_id = m.vec_id AND m.d = 'f' JOIN m0 n ON tim.vec_id = n.vec_id AND n.d = 'b', sh, par),
it AS (SELECT vec_id, ix, x, mc, tf - 273.15 AS tmpf, tb - 273.15 AS tmpb, gamma + og AS g_mc, {AP - AM!r}::DOUBLE * x + sqrt(av) * {_normal('alpha', 'mc', 'ix')} AS a_mc,
  {', '.join(f"{c} + sqrt({c} * {VAR[c[-2:] if c[-3:] != 'ast' else 'ast']}::DOUBLE) * {_normal(c, 'mc', 'ix', _US)} AS {c}_mc" for c in ('st', 'ast', 'rst', 'rast'))} FROM tmp, sh),
sam AS (SELECT it.vec_id, ix, it.mc, tmpf, tmpb, g_mc / (ln(st_mc / ast_mc) + f_mc + a_mc) - 273.15 AS f, g_mc / (ln(rst_mc / rast_mc) + b_mc - a_mc) - 273.15 AS b FROM it JOIN ow ON it.vec_id = ow.vec_id AND it.mc = ow.mc),
v AS (SELECT vec_id, ix, min(tmpf) AS tmpf, min(tmpb) AS tmpb, var_samp(f - tmpf) AS vf, var_samp(b - tmpb) AS vb FROM sam GROUP BY vec_id, ix),
w AS (SELECT vec_id, ix, v.vf, v.vb, (vb * v.tmpf + vf * v.tmpb) / (vf + vb) AS tmpw, (vb * f + vf * b) / (vf + vb) AS t FROM sam JOIN v USING (vec_id, ix))
"""


@query("monte_carlo_double", _MC2 + "SELECT vec_id, ix, round(min(vf), 6) AS tmpf_mc_var, round(min(vb), 6) AS tmpb_mc_var, round(var_samp(t), 6) AS tmpw_mc_var, round(min(tmpw), 4) + 0.0 AS tmpw, round(quantile_cont(t, 0.025), 4) + 0.0 AS low, round(quantile_cont(t, 0.975), 4) + 0.0 AS high FROM w GROUP BY vec_id, ix")
def monte_carlo_double(spark, sf_dir):
    drawn = sampling.sample_double(_double(spark, sf_dir, fix_alpha=_given_alpha(spark)), SAMPLES, SEED, sampling.digested)
    out = sampling.double_statistics(drawn)
    return out.select(no_of(), "ix", *[r(f"tmp{c}_mc_var", 6) for c in "fbw"], r("tmpw", 4), r(F.get("tmpw_mc", F.lit(0)), 4, "low"), r(F.get("tmpw_mc", F.lit(1)), 4, "high"))


@query("monte_carlo_double_free", None)
def monte_carlo_double_free(spark, sf_dir):
    """All parameters free, 100 samples with the faster draws; tested by its mean against the propagated variance."""
    return sampling.monte_carlo_double(_double(spark, sf_dir)).select(no_of(), "ix", "tmpw", "tmpf_mc_var", "tmpb_mc_var", "tmpw_mc_var")


# reports


@query("report_spread_by_location", _single_sql() + "SELECT ix, count(*) AS n, round(avg(tk - temp), 6) + 0.0 AS mean, round(stddev_pop(tk - temp), 6) AS std FROM com WHERE section IS NOT NULL GROUP BY ix")
def report_spread_by_location(spark, sf_dir):
    _, series = trace(spark, sf_dir)
    rows = reports.residuals(_single(spark, sf_dir).temperature, series, sec.sections_frame(spark, SECTIONS))
    return reports.spread(rows, "x").select("ix", "n", r("mean", 6), r("std", 6))


@query("report_spread_by_time", _single_sql() + "SELECT vec_id, count(*) AS n, round(avg(tk - temp), 6) + 0.0 AS mean, round(stddev_pop(tk - temp), 6) AS std FROM com WHERE section IS NOT NULL GROUP BY vec_id")
def report_spread_by_time(spark, sf_dir):
    _, series = trace(spark, sf_dir)
    rows = reports.residuals(_single(spark, sf_dir).temperature, series, sec.sections_frame(spark, SECTIONS))
    return reports.spread(rows, "time").select(no_of(), "n", r("mean", 6), r("std", 6))


@query("report_accuracy", _single_sql() + "SELECT section, stretch_id, vec_id, round(avg(tk - temp), 6) + 0.0 AS bias, round(stddev_pop(tk - temp), 6) AS precision FROM com WHERE section IS NOT NULL GROUP BY section, stretch_id, vec_id")
def report_accuracy(spark, sf_dir):
    _, series = trace(spark, sf_dir)
    return reports.accuracy(_single(spark, sf_dir).temperature, series, sec.sections_frame(spark, SECTIONS)).select("section", "stretch_id", no_of(), r("bias", 6), r("precision", 6))


@query(
    "report_sigma",
    _single_sql() + ", a AS (SELECT section, stretch_id, ix, tk - temp AS d, sqrt(dT_dst + dT_dast + dT_dgamma + dT_dc + dT_dalpha + dgamma_dc + dgamma_ddalpha + ddalpha_dc) AS s FROM com WHERE section IS NOT NULL), "
    "b AS (SELECT section, stretch_id, ix, avg(s) AS s FROM a GROUP BY section, stretch_id, ix), c AS (SELECT section, stretch_id, avg(s) AS s FROM b GROUP BY section, stretch_id) "
    "SELECT a.section, a.stretch_id, round(stddev_pop(d), 6) AS sigma_seen, round(min(c.s), 6) AS sigma_claimed FROM a JOIN c ON a.section = c.section AND a.stretch_id = c.stretch_id GROUP BY a.section, a.stretch_id",
)
def report_sigma(spark, sf_dir):
    _, series = trace(spark, sf_dir)
    return reports.sigma_report(_single(spark, sf_dir).temperature, series, sec.sections_frame(spark, SECTIONS)).select("section", "stretch_id", r("sigma_seen", 6), r("sigma_claimed", 6))


@query(
    "report_location_residuals",
    _double_sql() + f"SELECT vec_id, ix, round((gamma / tf - gamma / temp) / sqrt({VAR['st']}::DOUBLE / st + {VAR['ast']}::DOUBLE / ast), 4) + 0.0 AS werr_f, round((gamma / tb - gamma / temp) / sqrt({VAR['st']}::DOUBLE / rst + {VAR['ast']}::DOUBLE / rast), 4) + 0.0 AS werr_b FROM com WHERE section IS NOT NULL",
)
def report_location_residuals(spark, sf_dir):
    _, series = trace(spark, sf_dir)
    out = reports.location_residuals(_double(spark, sf_dir, fix_alpha=_given_alpha(spark)), series, sec.sections_frame(spark, SECTIONS))
    return out.select(no_of(), "ix", r("werr_f", 4), r("werr_b", 4))


# alignment


@query("shift_forwards", f"WITH {_trace_sql()} SELECT f.vec_id, f.ix - 3 AS ix, f.x, round(f.st, 4) AS st, round(b.rst, 4) AS rst FROM f JOIN f b ON f.vec_id = b.vec_id AND f.ix = b.ix + 3")
def shift_forwards(spark, sf_dir):
    return alignment.shift_double_ended(trace(spark, sf_dir)[0], 3).select(no_of(), "ix", "x", r("st", 4), r("rst", 4))


@query("shift_backwards", f"WITH {_trace_sql()} SELECT f.vec_id, f.ix, f.x, round(f.st, 4) AS st, round(b.rst, 4) AS rst FROM f JOIN f b ON f.vec_id = b.vec_id AND f.ix = b.ix - 5")
def shift_backwards(spark, sf_dir):
    return alignment.shift_double_ended(trace(spark, sf_dir)[0], -5).select(no_of(), "ix", "x", r("st", 4), r("rst", 4))


_ERRORS = f"""
WITH {_trace_sql()}, sh AS (SELECT unnest(range(-4, 5)) AS shift),
att AS (SELECT shift, f.vec_id, f.ix, f.x, (ln(b.rst / b.rast) - ln(f.st / f.ast)) / 2 AS att FROM sh, f JOIN f b ON f.vec_id = b.vec_id AND f.ix = b.ix + shift),
df AS (SELECT shift, x, att, lag(att) OVER w AS a1, lag(att, 2) OVER w AS a2, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM att WINDOW w AS (PARTITION BY shift, vec_id ORDER BY ix)),
er AS (SELECT shift, sum(CASE WHEN (x + x1) / 2 > 1 AND (x + x1) / 2 < 150 THEN abs(att - a1) END) AS err1, sum(CASE WHEN x1 > 1 AND x1 < 150 AND x2 IS NOT NULL THEN abs(att - 2 * a1 + a2) END) AS err2 FROM df GROUP BY shift)
"""


@query("shift_errors", _ERRORS + "SELECT CAST(shift AS INT) AS shift, round(err1, 5) AS err1, round(err2, 5) AS err2 FROM er")
def shift_errors(spark, sf_dir):
    return alignment.shift_errors(trace(spark, sf_dir)[0], range(-4, 5)).select("shift", r("err1", 5), r("err2", 5))


@query("suggest_shift", _ERRORS + "SELECT CAST(arg_min(shift, err1) AS INT) AS shift1, CAST(arg_min(shift, err2) AS INT) AS shift2 FROM er")
def suggest_shift(spark, sf_dir):
    return alignment.suggest_shift(trace(spark, sf_dir)[0], range(-4, 5))


@query("merge_double_ended", f"WITH {_trace_sql()} SELECT f.vec_id, f.ix, round(f.st, 4) AS st, round(f.ast, 4) AS ast, round(b.st, 4) AS rst, round(b.ast, 4) AS rast FROM f JOIN f b ON b.vec_id = f.vec_id AND f.ix + b.ix = 63")
def merge_double_ended(spark, sf_dir):
    """The trace as forward recording, and itself half a minute later and 0.3 m off as backward one."""
    meas, _ = trace(spark, sf_dir)
    fw = meas.select("ix", "x", "time", "st", "ast")
    bw = fw.withColumns({"time": F.timestamp_micros(F.unix_micros("time") + MINUTE // 2), "x": F.col("x") + 0.3})
    return alignment.merge_double_ended(fw, bw, 63.0, 1.0).select(no_of(), "ix", *[r(c, 4) for c in ("st", "ast", "rst", "rast")])


_EVENT_PAIRS = """
WITH u AS (SELECT epoch_us(ts) AS us, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS fw FROM events WHERE event_type IN ('click', 'view')),
d AS (SELECT us, min(fw) AS fw FROM u GROUP BY us),
n AS (SELECT us, fw, lead(us) OVER (ORDER BY us) AS us2, lead(fw) OVER (ORDER BY us) AS fw2 FROM d),
p AS (SELECT us AS f, us2 AS b, us2 - us AS dt FROM n WHERE fw = 1 AND fw2 = 0)
"""


@query("pair_times", _EVENT_PAIRS + ", q AS (SELECT *, lag(dt) OVER (ORDER BY f) AS p, lead(dt) OVER (ORDER BY f) AS s FROM p) SELECT f AS fw_us, b AS bw_us FROM q WHERE NOT coalesce(abs(p - s) <= 90000000 AND abs(dt - p) > 90000000, false)")
def pair_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_type")
    out = alignment.pair_times(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), tolerance_s=90.0)
    return out.select(F.unix_micros("time_fw").alias("fw_us"), F.unix_micros("time_bw").alias("bw_us"))


@query("pair_times_unverified", _EVENT_PAIRS + "SELECT f AS fw_us, b AS bw_us, dt / 1e6 AS dt_s FROM p")
def pair_times_unverified(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_type")
    out = alignment.pair_times(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), verify=False)
    return out.select(F.unix_micros("time_fw").alias("fw_us"), F.unix_micros("time_bw").alias("bw_us"), "dt_s")


@query("nearest_places", f"WITH {_GRID}, a AS (SELECT DISTINCT ix, x FROM g), b AS (SELECT DISTINCT vec_id AS ib, abs(embedding[1]::DOUBLE) * 200 AS xb FROM embeddings), c AS (SELECT ix, ib, row_number() OVER (PARTITION BY ix ORDER BY abs(x - xb), -xb, ib) AS k FROM a JOIN b ON abs(x - xb) <= 1.98) SELECT ix, ib FROM c WHERE k = 1")
def nearest_places(spark, sf_dir):
    a = grid(spark, sf_dir)[0].select("ix", "x").distinct()
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ib"), (F.abs(F.get("embedding", F.lit(0)).cast("double")) * 200).alias("xb"))
    return alignment.nearest_places(a, b, 2.0, 1.98).select("ix", "ib")


# resampling and interpolation


@query(
    "resample_mean",
    "WITH o AS (SELECT epoch_us(date_trunc('day', min(ts))) AS o FROM events) SELECT event_type, o + (epoch_us(ts) - o) // 47000000 * 47000000 AS slot_us, count(*) AS n, round(avg(value), 6) AS value FROM events, o GROUP BY event_type, slot_us",
)
def resample_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("time"), "value")
    return resampling.resample_mean(rows, 47.0, ["value"], ["event_type"]).select("event_type", F.unix_micros("time").alias("slot_us"), "n", r("value", 6))


_LERP = """
WITH k AS (SELECT {key} epoch_us(ts) AS us, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY {key} us),
q AS (SELECT event_id, {key} epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
b AS (SELECT q.event_id, q.us, {qkey} k.us AS bu, k.v AS bv FROM q ASOF LEFT JOIN k ON {on} q.us >= k.us),
c AS (SELECT b.*, k.us AS au, k.v AS av FROM b ASOF LEFT JOIN k ON {onb} b.us <= k.us)
SELECT event_id, round(CASE WHEN au = bu THEN bv ELSE bv + (av - bv) * ((us - bu) / (au - bu)::DOUBLE) END, 6) + 0.0 AS value FROM c
"""


def _lerp(spark, sf_dir, by=None):
    rows = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    keys = by or []
    out = resampling.interpolate(rows.filter("event_type = 'click'").select("time", "value", *keys), rows.filter("event_type = 'view'").select("event_id", "time", *keys), "value", keys)
    return out.select("event_id", r("value", 6))


@query("interpolate", _LERP.format(key="", qkey="", on="", onb=""))
def interpolate(spark, sf_dir):
    return _lerp(spark, sf_dir)


@query("interpolate_by_key", _LERP.format(key="user_id,", qkey="q.user_id,", on="q.user_id = k.user_id AND", onb="b.user_id = k.user_id AND"))
def interpolate_by_key(spark, sf_dir):
    return _lerp(spark, sf_dir, ["user_id"])



# many campaigns in one plan, over the domain tables

_CAMPAIGNS = """
WITH m AS (SELECT meas_id, min(run_id) AS run_id, min(device_id) AS device_id, min(x) AS x, min(time) AS time, min(st) AS st, min(ast) AS ast FROM meas GROUP BY meas_id),
s AS (SELECT run_id, time, max(cold) AS cold, max(warm) AS warm, max(ambient) AS ambient FROM series GROUP BY run_id, time),
r AS (SELECT m.run_id, m.time, m.x, ln(st / ast) AS y, 1 / (0.01::DOUBLE / st + 0.01::DOUBLE / ast) AS w, CASE z.section WHEN 'cold' THEN cold WHEN 'warm' THEN warm ELSE ambient END AS bath
  FROM m JOIN sections z ON m.device_id = z.device_id AND m.x BETWEEN z.x_start AND z.x_stop JOIN s ON m.run_id = s.run_id AND m.time = s.time WHERE st > 0 AND ast > 0),
u AS (SELECT *, 1 / (bath + 273.15) AS u FROM r WHERE bath > -100 AND bath < 200),
t AS (SELECT run_id, time, sum(w) AS sw, sum(w * u) / sum(w) AS mu, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM u GROUP BY run_id, time),
d AS (SELECT u.run_id, w, u.u - mu AS u, mx - u.x AS x, u.y - my AS y FROM u JOIN t ON u.run_id = t.run_id AND u.time = t.time),
g AS (SELECT run_id, sum(w * u * u) AS a, sum(w * u * x) AS b, sum(w * x * x) AS c, sum(w * u * y) AS p, sum(w * x * y) AS q, count(*) AS n FROM d GROUP BY run_id),
par AS (SELECT run_id, (c * p - b * q) / (a * c - b * b) AS gamma, (a * q - b * p) / (a * c - b * b) AS dalpha, n FROM g),
tmp AS (SELECT m.meas_id, par.gamma / (ln(st / ast) + par.gamma * mu - par.dalpha * mx - my + par.dalpha * m.x) - 273.15 AS tmpf FROM m JOIN t ON m.run_id = t.run_id AND m.time = t.time JOIN par ON par.run_id = m.run_id WHERE st > 0 AND ast > 0)
"""


def _campaigns(spark, sf_dir):
    meas = table(spark, sf_dir, "meas").withColumn("time", F.col("time").cast("timestamp")).groupBy("meas_id").agg(*[F.min(c).alias(c) for c in ("run_id", "device_id", "ix", "x", "time", "st", "ast")])
    series = table(spark, sf_dir, "series").withColumn("time", F.col("time").cast("timestamp"))
    share = lambda v: v * 0.01
    return calibrate_campaigns(meas, series, table(spark, sf_dir, "sections"), ["run_id"], share, share, "device_id")


@query("campaign_parameters", _CAMPAIGNS + "SELECT run_id, round(gamma, 4) + 0.0 AS gamma, round(dalpha, 8) + 0.0 AS dalpha, n FROM par")
def campaign_parameters(spark, sf_dir):
    return _campaigns(spark, sf_dir).params.select("run_id", r("gamma", 4), r("dalpha", 8), "n")


@query("campaign_temperature", _CAMPAIGNS + "SELECT meas_id, round(tmpf, 3) + 0.0 AS tmpf FROM tmp WHERE tmpf IS NOT NULL")
def campaign_temperature(spark, sf_dir):
    return _campaigns(spark, sf_dir).temperature.filter("tmpf IS NOT NULL").select("meas_id", r("tmpf", 3))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
