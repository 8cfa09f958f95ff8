"""Uncertainty by Monte Carlo, and averages in time or along the fibre with confidence intervals.

Every draw is a hash of the seed, the sample's number and the place and time it is for, so samples are the same however the data
are partitioned and whenever a task is repeated. The shared parameters are drawn once for each sample (as many rows as
samples, broadcast), each time's own parameters given them (one row for each time and sample), and the intensities at each
measurement. Samples are joined by time, and all statistics by place and time stay in that partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thermaline.operators import arrowhead
from thermaline.operators.calibration import ZERO_C, Result, log_ratio
from thermaline.operators.resampling import between, outside_null, select_ordinals

#: More samples than this are refused: their parameters are broadcast, and one measurement's samples are held together.
MOST_SAMPLES = 100_000
Draw = Callable[..., Column]


def hashed(*parts: Column) -> Column:
    """A number in (0, 1) for the parts, by a 64-bit hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) * 2.0**-53


def digested(*parts: Column) -> Column:
    """The same by the MD5 digest of the parts joined by bars: slower, but other engines can repeat it."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") + 0.5) * 2.0**-52


def normal(draw: Draw, seed: int, name: str, *parts: Column) -> Column:
    """A standard normal number for the parts (Box and Muller)."""
    u, v = draw(F.lit(seed), F.lit(name + "/u"), *parts), draw(F.lit(seed), F.lit(name + "/v"), *parts)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _parameters(result: Result, samples: int, seed: int, draw: Draw, certain: bool) -> tuple[DataFrame, DataFrame]:
    """``(mc, _shared)`` and ``(time, mc, own...)``: drawn parameters; ``certain`` leaves out their uncertainty."""
    if not 0 < samples <= MOST_SAMPLES:
        raise ValueError(f"the number of samples lies between 1 and {MOST_SAMPLES}")
    f = result.fit
    spark, n, m = f.times.sparkSession, len(f.shared), len(f.own)
    mc = spark.range(samples).select(F.col("id").cast("int").alias("mc"))
    numbers = lambda values: F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
    if certain or not n:
        off = F.array_repeat(F.lit(0.0), n)
    else:
        z = F.array(*[normal(draw, seed, s, F.col("mc")) for s in f.shared])
        rows = F.array(*[numbers(r) for r in arrowhead.root(f.cov)])
        mc = mc.withColumn("_z", z)
        off = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, "_z", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    shared = mc.select("mc", off.alias("_off")).withColumn("_shared", F.zip_with("_off", numbers(f.value), lambda a, b: a + b))
    own = f.times.select("time", "p", "follow", "root").join(F.broadcast(shared.select("mc", "_off")))  # one row for each sample
    us = F.unix_micros("time")
    out = []
    for i, a in enumerate(f.own):
        value = F.element_at("p", i + 1)
        if not certain:
            fall = F.aggregate(F.zip_with(F.slice("follow", i * n + 1, n), "_off", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) if n else F.lit(0.0)
            value = value - fall + sum((F.element_at("root", i * m + j + 1) * normal(draw, seed, f.own[j], F.col("mc"), us) for j in range(i + 1)), F.lit(0.0))
        out.append(value.alias(f"_p_{a}"))
    return shared.select("mc", "_shared"), own.select("time", "mc", *out)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows by time over as many tasks as a shuffle has: samples make them many times larger, which their size now doesn't show."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "time")


def _drawn(c: str, seed: int, draw: Draw) -> Column:
    return F.col(c) + F.sqrt(f"{c}_v") * normal(draw, seed, c, F.col("mc"), F.col("ix"), F.unix_micros("time"))


def _losses(result: Result, direction: str) -> Column:
    out = F.lit(0.0)
    for k, p in enumerate(result.fit.geo.splices):
        there = F.col("x") >= p if direction == "f" else F.col("x") < p
        out = out + F.when(there, F.col(f"_p_ta{direction}_{k}")).otherwise(0.0)
    return out


def _gamma(result: Result) -> Column:
    f = result.fit
    return F.element_at("_shared", f.shared.index("gamma") + 1) if "gamma" in f.shared else F.lit(f.get("gamma")[0])


def sample_single(result: Result, samples: int = 100, seed: int = 0, draw: Draw = hashed, exclude_parameter_uncertainty: bool = False) -> DataFrame:
    """``(ix, x, time, mc, tmpf, tmpf_mc)``: temperatures of drawn parameters and intensities. Given parameters are drawn by their variance."""
    f = result.fit
    shared, own = _parameters(result, samples, seed, draw, exclude_parameter_uncertainty)
    rows = _spread(result.temperature.select("ix", "x", "time", "tmpf", *[c for a in ("st", "ast") for c in (a, f"{a}_v")])).join(own, "time").join(F.broadcast(shared), "mc")
    gamma = _gamma(result)
    if "gamma" not in f.shared and not exclude_parameter_uncertainty:
        gamma = gamma + f.get("gamma")[1] ** 0.5 * normal(draw, seed, "gamma", F.col("mc"))
    if f.fixed.alpha is not None:
        rows = rows.join(F.broadcast(result.params_x.select("ix", "alpha", "alpha_var")), "ix")  # at most as many rows as locations
        alpha = F.col("alpha") if exclude_parameter_uncertainty else F.col("alpha") + F.sqrt("alpha_var") * normal(draw, seed, "alpha", F.col("mc"), F.col("ix"))
    elif "dalpha" in f.shared:
        alpha = F.col("x") * F.element_at("_shared", f.shared.index("dalpha") + 1)
    else:
        value, var = f.get("dalpha")
        alpha = F.col("x") * (F.lit(value) if exclude_parameter_uncertainty else value + var**0.5 * normal(draw, seed, "dalpha", F.col("mc")))
    rows = rows.withColumns({"_s": _drawn("st", seed, draw), "_a": _drawn("ast", seed, draw)})
    t = gamma / (log_ratio("_s", "_a") + F.col("_p_c") + alpha + _losses(result, "f")) - ZERO_C
    return rows.select("ix", "x", "time", "mc", "tmpf", t.alias("tmpf_mc"))


def sample_double(result: Result, samples: int = 100, seed: int = 0, draw: Draw = hashed, exclude_parameter_uncertainty: bool = False) -> DataFrame:
    """``(ix, x, time, mc, tmpf, tmpb, tmpw, tmpf_mc, tmpb_mc)``; attenuations outside the fitted locations are drawn one by one."""
    f = result.fit
    shared, own = _parameters(result, samples, seed, draw, exclude_parameter_uncertainty)
    labels = ("st", "ast", "rst", "rast")
    rows = result.temperature.select("ix", "x", "time", "tmpf", "tmpb", "tmpw", *[c for a in labels for c in (a, f"{a}_v")])
    rows = _spread(rows).join(own, "time").join(F.broadcast(shared), "mc")
    where = result.params_x.select("ix", "alpha", "alpha_var")
    if f.fixed.alpha is None and f.geo.columns:
        at = [(ix, f.shared.index(f.geo.alphas[k]) + 1 if k >= 0 else 0) for ix, k in f.geo.columns.items()]
        where = where.join(F.broadcast(rows.sparkSession.createDataFrame(at, "ix int, _at int")), "ix", "left")
    else:
        where = where.withColumn("_at", F.lit(None).cast("int"))
    rows = rows.join(F.broadcast(where), "ix")  # at most as many rows as locations
    lone = F.col("alpha") if exclude_parameter_uncertainty else F.col("alpha") + F.sqrt("alpha_var") * normal(draw, seed, "alpha", F.col("mc"), F.col("ix"))
    alpha = F.when(F.col("_at") > 0, F.element_at("_shared", F.greatest(F.col("_at"), F.lit(1)))).when(F.col("_at") == 0, 0.0).otherwise(lone) if f.shared else lone
    gamma = _gamma(result)
    if "gamma" not in f.shared and not exclude_parameter_uncertainty:
        gamma = gamma + f.get("gamma")[1] ** 0.5 * normal(draw, seed, "gamma", F.col("mc"))
    rows = rows.withColumns({f"_{a}": _drawn(a, seed, draw) for a in labels}).withColumns({"_alpha": alpha, "_gamma": gamma})
    tf = F.col("_gamma") / (log_ratio("_st", "_ast") + F.col("_p_df") + F.col("_alpha") + _losses(result, "f")) - ZERO_C
    tb = F.col("_gamma") / (log_ratio("_rst", "_rast") + F.col("_p_db") - F.col("_alpha") + _losses(result, "b")) - ZERO_C
    return rows.select("ix", "x", "time", "mc", "tmpf", "tmpb", "tmpw", tf.alias("tmpf_mc"), tb.alias("tmpb_mc"))


def percentiles(values: Column, points: tuple[float, ...]) -> Column:
    """Percentiles (0 to 100) of an array, with linear interpolation; nulls are left out, an empty array gives nulls."""

    def of(s: Column) -> Column:
        out, n = [], F.size(s)
        for p in points:
            at = (n - 1) * (p / 100.0)
            lo = F.floor(at).cast("int")
            a, b = F.get(s, lo), F.get(s, F.least(lo + 1, n - 1))
            out.append(F.when(n > 0, a + (b - a) * (at - lo)))
        return F.array(*out)

    # bound as a variable, so that the array is sorted once
    return F.get(F.transform(F.array(F.sort_array(F.array_compact(values))), of), F.lit(0))


def monte_carlo_single(result: Result, samples: int = 100, conf_ints: tuple[float, ...] = (2.5, 97.5), **kw) -> DataFrame:
    """``(ix, x, time, tmpf, tmpf_mc_var, tmpf_mc)``: variance (n - 1) and percentiles of the samples."""
    return single_statistics(sample_single(result, samples, **kw), conf_ints)


def single_statistics(drawn: DataFrame, conf_ints: tuple[float, ...] = (2.5, 97.5)) -> DataFrame:
    ci = [percentiles(F.collect_list("tmpf_mc"), conf_ints).alias("tmpf_mc")] if conf_ints else []
    return drawn.groupBy("ix", "x", "time").agg(F.first("tmpf").alias("tmpf"), F.var_samp(F.col("tmpf_mc") - F.col("tmpf")).alias("tmpf_mc_var"), *ci)


def monte_carlo_double(result: Result, samples: int = 100, conf_ints: tuple[float, ...] = (2.5, 97.5), only_sections: DataFrame | None = None, **kw) -> DataFrame:
    """``(ix, x, time, tmpf, tmpb, tmpw, tmp{f,b,w}_mc_var, tmp{f,b,w}_mc)``; ``tmpw`` is weighted by the variances of the samples.

    ``only_sections`` nulls the variances outside those stretches.
    """
    out = double_statistics(sample_double(result, samples, **kw), conf_ints)
    return outside_null(out, only_sections, ["tmpf_mc_var", "tmpb_mc_var", "tmpw_mc_var"]) if only_sections is not None else out


def double_statistics(drawn: DataFrame, conf_ints: tuple[float, ...] = (2.5, 97.5)) -> DataFrame:
    f, b = F.col("tmpf_mc") - F.col("tmpf"), F.col("tmpb_mc") - F.col("tmpb")
    lists = [F.sort_array(F.collect_list(F.struct("mc", F.col("tmpf_mc").alias("f"), F.col("tmpb_mc").alias("b")))).alias("_s")] if conf_ints else []
    rows = drawn.groupBy("ix", "x", "time").agg(F.first("tmpf").alias("tmpf"), F.first("tmpb").alias("tmpb"), F.var_samp(f).alias("tmpf_mc_var"), F.var_samp(b).alias("tmpb_mc_var"), F.covar_samp(f, b).alias("_fb"), *lists)
    vf, vb = F.col("tmpf_mc_var"), F.col("tmpb_mc_var")
    rows = rows.withColumn("_wf", (1 / vf) / (1 / vf + 1 / vb)).withColumn("_wb", 1 - F.col("_wf"))
    wf, wb = F.col("_wf"), F.col("_wb")
    rows = rows.withColumns({"tmpw": wf * F.col("tmpf") + wb * F.col("tmpb"), "tmpw_mc_var": wf**2 * vf + wb**2 * vb + 2 * wf * wb * F.col("_fb")})
    if conf_ints:
        rows = rows.withColumns({
            "tmpf_mc": percentiles(F.transform("_s", lambda s: s["f"]), conf_ints), "tmpb_mc": percentiles(F.transform("_s", lambda s: s["b"]), conf_ints),
            "tmpw_mc": percentiles(F.transform("_s", lambda s: wf * s["f"] + wb * s["b"]), conf_ints),
        })
    return rows.drop("_wf", "_wb", "_fb", "_s")


def selected(drawn: DataFrame, time_sel: tuple | None = None, time_isel: list[int] | None = None, x_sel: tuple | None = None, x_isel: list[int] | None = None) -> DataFrame:
    """The part of the samples to average: by times, else by their places, else by locations, else by theirs, else all."""
    if time_sel is not None:
        return drawn.filter(between("time", *time_sel))
    if time_isel is not None:
        return select_ordinals(drawn, "time", list(time_isel))
    if x_sel is not None:
        return drawn.filter(between("x", *x_sel))
    return select_ordinals(drawn, "x", list(x_isel)) if x_isel is not None else drawn


def average(drawn: DataFrame, over: str = "time", kind: int = 1, conf_ints: tuple[float, ...] = (2.5, 97.5), exact: bool = False) -> DataFrame:
    """Averages of samples over ``time`` (by ``ix, x``) or over ``x`` (by ``time``), for each of ``tmpf`` and, if there, ``tmpb``
    and their weighted mean ``tmpw``: columns ``<label>_avg``, ``<label>_avg_var`` and percentiles ``<label>_avg_ci``.

    ``kind`` 1 is the plain mean, with the spread of all samples about their measurements: the uncertainty of one measurement. ``kind`` 2
    is the mean weighted by inverse variance, with the spread of its samples: the uncertainty of the mean. For kind 1,
    percentiles of so many values come from a sketch with a rank error of 1 in 10,000, unless ``exact``.
    """
    if over not in ("time", "x") or kind not in (1, 2):
        raise ValueError("average over time or x, of kind 1 or 2")
    keys = ["ix", "x"] if over == "time" else ["time"]
    labels = [c for c in ("tmpf", "tmpb") if f"{c}_mc" in drawn.columns]
    cell = Window.partitionBy("time", "ix", "x")  # as many rows as samples; drawn once, and where they are already partitioned by time
    rows = drawn.withColumns({f"_q_{c}": F.var_samp(F.col(f"{c}_mc") - F.col(c)).over(cell) for c in labels})
    both = len(labels) == 2
    if kind == 1:
        if both:
            w = (1 / F.col("_q_tmpf")) / (1 / F.col("_q_tmpf") + 1 / F.col("_q_tmpb"))
            rows = rows.withColumns({"tmpw": w * F.col("tmpf") + (1 - w) * F.col("tmpb"), "tmpw_mc": w * F.col("tmpf_mc") + (1 - w) * F.col("tmpb_mc")})
        out = []
        for c in [*labels, *(["tmpw"] if both else [])]:
            points = F.array(*[F.lit(p / 100.0) for p in conf_ints])
            ci = F.percentile(f"{c}_mc", points) if exact else F.percentile_approx(f"{c}_mc", points, 10_000)
            off = F.col(f"{c}_mc") - F.col(c) if c != "tmpw" else F.col(f"{c}_mc")
            out += [F.avg(c).alias(f"{c}_avg"), F.var_samp(off).alias(f"{c}_avg_var"), *([ci.alias(f"{c}_avg_ci")] if conf_ints else [])]
        return rows.groupBy(*keys).agg(*out)
    each = rows.groupBy(*keys, "mc").agg(*[e for c in labels for e in ((F.sum(F.col(f"{c}_mc") / F.col(f"_q_{c}")) / F.sum(1 / F.col(f"_q_{c}"))).alias(f"_m_{c}"), (1 / F.sum(1 / F.col(f"_q_{c}"))).alias(f"_v_{c}"))])
    if both:
        w = (1 / F.col("_v_tmpf")) / (1 / F.col("_v_tmpf") + 1 / F.col("_v_tmpb"))
        each = each.withColumns({"_m_tmpw": w * F.col("_m_tmpf") + (1 - w) * F.col("_m_tmpb"), "_v_tmpw": 1 / (1 / F.col("_v_tmpf") + 1 / F.col("_v_tmpb"))})
    out = []
    for c in [*labels, *(["tmpw"] if both else [])]:
        out += [F.avg(f"_m_{c}").alias(f"{c}_avg"), F.first(f"_v_{c}").alias(f"{c}_avg_var"), *([percentiles(F.collect_list(f"_m_{c}"), conf_ints).alias(f"{c}_avg_ci")] if conf_ints else [])]
    return each.groupBy(*keys).agg(*out)
