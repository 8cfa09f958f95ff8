"""Single-ended calibration of many campaigns in one plan.

A campaign (a run of one instrument, named by key columns) is fitted from grouped sums alone: deviations from each time's
weighted means are one window over the exchange by campaign and time, the two shared parameters are a two by two system by
campaign, solved in column expressions, and each time's offset follows. Nothing is collected, and a campaign of any length is
spread over tasks by its times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators.calibration import ZERO_C, Variance, log_ratio, with_variance
from thermaline.operators.sections import MOST_STRETCHES


@dataclass
class Campaigns:
    """``params(<by>, gamma, dalpha, their variances and covariance, err, n, times)``, ``params_t(<by>, time, c, c_var)``
    and ``temperature(<meas columns>, tmpf, tmpf_var)``."""

    params: DataFrame
    params_t: DataFrame
    temperature: DataFrame


def calibrate_campaigns(meas: DataFrame, series: DataFrame, sections: DataFrame, by: list[str], st_var: Variance, ast_var: Variance, device: str | None = None, bath_limits: tuple[float, float] = (-100.0, 200.0)) -> Campaigns:
    """Calibrates each campaign of ``meas(<by>, ix, x, time, st, ast, ...)`` with its ``series(<by>, time, <baths>)``.

    ``sections`` has a column ``device`` too if it is named: then a campaign's stretches are those of its device. Rows
    repeated at one place and time must have been joined before. Null, NaN and non-positive intensities, variances that
    are missing, and baths that are null or outside their limits take no part in the fit and give no temperature of
    their own; null keys are a campaign of their own. A campaign that can't be solved (fewer observations than
    parameters, or all of one temperature) has null parameters and temperatures. Times without reference rows give null
    temperatures. All rows of ``meas`` are returned.
    """
    if sections.limit(MOST_STRETCHES + 1).count() > MOST_STRETCHES:
        stretches = sections
    else:
        stretches = F.broadcast(sections)
    names = sorted(r.section for r in sections.select("section").distinct().limit(1000).collect() if r.section in series.columns)
    ks = [f"_by{i}" for i in range(len(by))]
    keyed = lambda df: df.withColumns({k: F.col(b) for k, b in zip(ks, by)})
    rows = keyed(with_variance(with_variance(meas, "st", st_var), "ast", ast_var))
    rows = rows.withColumns({"_y": F.when(~F.isnan("st") & ~F.isnan("ast"), log_ratio("st", "ast")), "_v": F.when((F.col("st") > 0) & (F.col("ast") > 0), F.col("st_v") / F.col("st") ** 2 + F.col("ast_v") / F.col("ast") ** 2)})

    lean = rows.select(*ks, "time", "x", "_y", "_v", *([F.col(device).alias("_dev")] if device else [])).filter("_y IS NOT NULL AND _v > 0")
    cut = stretches.select("section", "x_start", "x_stop", *([F.col(device).alias("_sdev")] if device else []))
    inside = F.col("x").between(F.col("x_start"), F.col("x_stop"))
    ref = lean.join(cut, (F.col("_dev").eqNullSafe(F.col("_sdev")) & inside) if device else inside)
    baths = series.select(*[F.col(b).alias(f"_s{i}") for i, b in enumerate(by)], F.col("time").alias("_st"), *[F.col(n).cast("double").alias(f"_b_{n}") for n in names])
    baths = baths.groupBy(*[f"_s{i}" for i in range(len(by))], "_st").agg(*[F.max(f"_b_{n}").alias(f"_b_{n}") for n in names])
    on = F.col("time") == F.col("_st")
    for i, k in enumerate(ks):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    bath = F.lit(None).cast("double")
    for n in names:
        bath = F.when(F.col("section") == n, F.col(f"_b_{n}")).otherwise(bath)
    ref = ref.join(baths, on).withColumn("_bath", bath).filter((F.col("_bath") > bath_limits[0]) & (F.col("_bath") < bath_limits[1]))
    ref = ref.select(*ks, "time", "x", "_y", (1 / F.col("_v")).alias("_w"), (1 / (F.col("_bath") + ZERO_C)).alias("_u"))

    at = Window.partitionBy(*ks, "time")  # as many rows as reference locations
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(at) / F.sum("_w").over(at)
    ref = ref.withColumns({"_mu": mean("_u"), "_mx": mean("x"), "_my": mean("_y"), "_sw": F.sum("_w").over(at)})
    du, dx, dy, w = F.col("_u") - F.col("_mu"), F.col("_mx") - F.col("x"), F.col("_y") - F.col("_my"), F.col("_w")
    times = ref.groupBy(*ks, "time").agg(
        F.first("_mu").alias("_mu"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.first("_sw").alias("_sw"), F.count("*").alias("_n"),
        F.sum(w * du * du).alias("_a"), F.sum(w * du * dx).alias("_b"), F.sum(w * dx * dx).alias("_c"), F.sum(w * du * dy).alias("_p"), F.sum(w * dx * dy).alias("_q"), F.sum(w * dy * dy).alias("_r"),
    )
    s = times.groupBy(*ks).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in "nabcpqr"], F.count("*").alias("_t"))
    a, b, c, p, q = (F.col(f"_{k}") for k in "abcpq")
    det = F.when(a * c - b * b > 1e-12 * a * c, a * c - b * b)
    s = s.withColumns({"gamma": (c * p - b * q) / det, "dalpha": (a * q - b * p) / det, "_gg": c / det, "_dd": a / det, "_gd": -b / det})
    free = F.col("_n") - 2 - F.col("_t")
    rest = F.col("_r") - F.col("gamma") * p - F.col("dalpha") * q
    s = s.withColumn("err", F.when(free > 0, F.greatest(rest, F.lit(0.0)) / free))
    s = s.withColumns({"gamma_var": F.col("_gg") * F.col("err"), "dalpha_var": F.col("_dd") * F.col("err"), "gamma_dalpha": F.col("_gd") * F.col("err")})
    s = s.select(*ks, "gamma", "gamma_var", "dalpha", "dalpha_var", "gamma_dalpha", "err", F.col("_n").alias("n"), F.col("_t").alias("times"))

    same = lambda names, left: [F.col(k).eqNullSafe(F.col(f"{left}{i}")) for i, k in enumerate(names)]
    other = s.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(ks)], "gamma", "gamma_var", "dalpha", "dalpha_var", "gamma_dalpha", "err")
    mu, mx = F.col("_mu"), F.col("_mx")
    t = times.join(other, same(ks, "_o")).withColumns({
        "c": F.col("gamma") * mu - F.col("dalpha") * mx - F.col("_my"),
        "c_var": F.col("err") / F.col("_sw") + mu * mu * F.col("gamma_var") + mx * mx * F.col("dalpha_var") - 2 * mu * mx * F.col("gamma_dalpha"),
        "gamma_c": mu * F.col("gamma_var") - mx * F.col("gamma_dalpha"), "dalpha_c": mu * F.col("gamma_dalpha") - mx * F.col("dalpha_var"),
    })
    wide = t.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(ks)], F.col("time").alias("_tt"), *[F.col(n).alias(f"_f_{n}") for n in ("gamma", "gamma_var", "dalpha", "dalpha_var", "gamma_dalpha", "c", "c_var", "gamma_c", "dalpha_c")])
    on = F.col("time") == F.col("_tt")
    for cond in same(ks, "_t"):
        on = on & cond
    f = lambda n: F.col(f"_f_{n}")
    out = rows.join(wide, on, "left").withColumn("_k", f("gamma") / (F.col("_y") + f("c") + f("dalpha") * F.col("x")))
    k, x = F.col("_k"), F.col("x")
    d_g, d_c = k / f("gamma"), -k * k / f("gamma")
    var = d_c**2 * (F.col("_v") + f("c_var") + x * x * f("dalpha_var") + 2 * x * f("dalpha_c")) + d_g**2 * f("gamma_var") + 2 * d_g * d_c * (f("gamma_c") + x * f("gamma_dalpha"))
    out = out.withColumns({"tmpf": k - ZERO_C, "tmpf_var": var})
    back = lambda df, *cols: df.select(*[F.col(k).alias(b) for k, b in zip(ks, by)], *cols)
    return Campaigns(back(s, "gamma", "gamma_var", "dalpha", "dalpha_var", "gamma_dalpha", "err", "n", "times"), back(t, "time", "c", "c_var"), out.select(*meas.columns, "tmpf", "tmpf_var"))
