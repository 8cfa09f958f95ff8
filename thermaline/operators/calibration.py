"""Calibration of single-ended and double-ended set-ups, with propagated variances.

The logarithm of the intensity ratio is linear in the parameters. The rows of the reference locations are gathered
into one row of arrays for each time (a partial aggregation on the executors, bounded by the number of reference locations), the
shared parameters come from one small system summed over all times (see ``arrowhead``), each time's own from a second
map over the gathered rows, and temperatures and variances are projections of the measurements joined to the parameters.
Only the geometry (locations, sections) and the small system reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermaline.operators import arrowhead
from thermaline.operators.sections import bounded
from thermaline.session import written

ZERO_C = 273.15
#: A fibre has fewer locations than this; the geometry is then small enough for the driver and for a broadcast.
MOST_LOCATIONS = 200_000
#: More shared parameters than this are refused: the small system and its inverse are dense on the driver.
MOST_SHARED = 2_000
Variance = float | int | Callable[[Column], Column] | str | DataFrame


def with_variance(meas: DataFrame, label: str, var: Variance) -> DataFrame:
    """Adds ``<label>_v``: one number, a function of the intensity, a column of ``meas``, or rows by ``ix``, ``time`` or both.

    A frame has its value in the one column that is neither key; measurements without a row there keep a null
    variance. Variances that are null, NaN, infinite or not positive become null; in the sections they raise when
    a calibration is fitted.
    """
    name = f"{label}_v"
    if isinstance(var, DataFrame):
        keys = [k for k in ("ix", "time") if k in var.columns]
        value = [c for c in var.columns if c not in ("ix", "time", "x")]
        if not keys or len(value) != 1:
            raise ValueError("variances by location or time need the column ix or time and one value")
        out = meas.join(var.select(*keys, F.col(value[0]).cast("double").alias(name)), keys, "left")
    elif callable(var):
        out = meas.withColumn(name, var(F.col(label)).cast("double"))
    elif isinstance(var, str):
        out = meas.withColumn(name, F.col(var).cast("double"))
    elif not np.isfinite(var) or var <= 0:
        raise ValueError(f"the variance of {label} must be positive and finite")
    else:
        return meas.withColumn(name, F.lit(float(var)))
    return out.withColumn(name, F.when((F.col(name) > 0) & (F.col(name) < float("inf")), F.col(name)))


def log_ratio(a: str, b: str) -> Column:
    """Logarithm of a ratio of intensities; null unless both are positive."""
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))


@dataclass
class Geometry:
    """What the solver needs to know of the fibre, in order of location."""

    ref: list[tuple[int, float, int]]  # ix, x, number of the section
    names: list[str]
    pairs: list[tuple[int, int]]
    x: dict[int, float]
    splices: list[float]
    columns: dict[int, int] = field(default_factory=dict)  # double-ended: column of a fitted location's attenuation, -1 where it is zero
    alphas: list[str] = field(default_factory=list)  # names of those columns

    def needed(self) -> list[int]:
        return sorted({r[0] for r in self.ref} | {i for p in self.pairs for i in p})


def geometry(meas: DataFrame, sections: DataFrame, matching: list | None, splices: list[float], double: bool, series: DataFrame | None = None, check: bool = True) -> Geometry:
    """``matching`` is a list of ``((head start, stop), (tail start, stop), reverse)``; both parts hold equally many locations.

    Unless ``check`` is false, stretches that overlap or hold no location, and sections without a series, raise.

    Double-ended, the attenuation is zero at the first reference location. A constant step of it at a splice can't be told
    from the splice's own losses, so it is defined as zero between the last fitted location before and the first behind it.
    """
    where = sorted({(r.x, r.ix) for r in meas.select("ix", "x").distinct().limit(MOST_LOCATIONS + 1).collect()})
    if len(where) > MOST_LOCATIONS:
        raise ValueError(f"more than {MOST_LOCATIONS} locations")
    stretches = sorted((r.x_start, r.x_stop, r.section) for r in bounded(sections).collect())
    names = sorted({s[2] for s in stretches})
    xs = [x for x, _ in where]
    inside = lambda a, b: where[bisect_left(xs, a) : bisect_right(xs, b)]
    if check:
        if any(one[1] > two[0] for one, two in zip(stretches, stretches[1:])):
            raise ValueError("stretches overlap")
        if series is not None and set(names) - set(series.columns):
            raise ValueError(f"no temperature series for {sorted(set(names) - set(series.columns))}")
        for a, b, s in stretches:
            if not inside(a, b):
                raise ValueError(f"the stretch {a} to {b} of {s} holds no location")
    ref = [(ix, x, names.index(s)) for a, b, s in stretches for x, ix in inside(a, b)]
    pairs = []
    for (h0, h1), (t0, t1), reverse in matching or []:
        head, tail = [ix for _, ix in inside(h0, h1)], [ix for _, ix in inside(t0, t1)]
        if len(head) != len(tail):
            raise ValueError("matching sections hold different numbers of locations")
        pairs.extend(zip(head, tail[::-1] if reverse else tail))
    g = Geometry(ref, names, pairs, {ix: x for x, ix in where}, list(splices))
    if double and ref:
        zero, before = ref[0][0], None
        fitted = sorted(g.needed(), key=lambda i: g.x[i])
        for i in fitted:
            if i == zero:
                g.columns[i] = -1
            elif before is not None and any(g.x[before] < p <= g.x[i] for p in g.splices):
                g.columns[i] = g.columns[before]
            else:
                g.columns[i] = len(g.alphas)
                g.alphas.append(f"alpha_{i}")
            before = i
        if fitted and fitted[0] != zero:  # matched locations before the first section: their steps are counted from the zero location
            _anchor(g, fitted, zero)
    return g


def _anchor(g: Geometry, fitted: list[int], zero: int) -> None:
    """Columns again, outwards from the location of zero attenuation, so that it joins its neighbours across a splice too."""
    g.columns, g.alphas = {zero: -1}, []
    at = fitted.index(zero)
    for order in (fitted[at:], fitted[at::-1]):
        for one, two in zip(order, order[1:]):
            lo, hi = sorted((g.x[one], g.x[two]))
            if any(lo < p <= hi for p in g.splices):
                g.columns[two] = g.columns[one]
            else:
                g.columns[two] = len(g.alphas)
                g.alphas.append(f"alpha_{two}")


@dataclass
class Fixed:
    """Parameters that are given: value and variance; attenuations by location."""

    gamma: tuple[float, float] | None = None
    dalpha: tuple[float, float] | None = None
    alpha: dict[int, tuple[float, float]] | None = None


class Design:
    """The observation equations of one time, which are the same at every time but for what is missing.

    Single-ended, ``I = gamma/T - c - x dalpha - losses``, and differences of matched locations. Double-ended,
    ``F = gamma/T - df - A - losses`` and ``B = gamma/T - db + A - losses``; matched locations give the differences of both
    directions, and those outside the sections half the difference of the directions, with the sum of both variances. Own
    parameters are c, or df and db, then the forward and the backward losses of the splices.
    """

    def __init__(self, geo: Geometry, fixed: Fixed, double: bool):
        self.ix = np.array(geo.needed(), dtype=np.int64)
        self.double, self.fixed = double, fixed
        place = {int(i): k for k, i in enumerate(self.ix)}
        nx, m, n = len(self.ix), len(geo.splices), len(geo.alphas) if double else 2
        own = 2 + 2 * m if double else 1 + m
        terms, shared, mine, alpha, section = [], [], [], [], []

        def part(i: int, channel: int, sign: float):
            """Coefficients of one location's ratio: shared (gamma comes later), own, given attenuation."""
            g, o, a = np.zeros(n), np.zeros(own), np.zeros(nx)
            x = geo.x[i]
            passed = np.array([x >= p if channel == 0 else x < p for p in geo.splices], dtype=float)
            if double:
                o[channel] = -sign
                o[2 + channel * m : 2 + channel * m + m] = -sign * passed
                a[place[i]] = sign * (1 if channel else -1)
                if geo.columns[i] >= 0:
                    g[geo.columns[i]] = a[place[i]]
            else:
                o[0], o[1:] = -sign, -sign * passed
                g[1], a[place[i]] = -sign * x, -sign
            return channel * nx + place[i], sign, g, o, a

        def add(parts, s: int, scale: float = 1.0, alike: float | None = None):
            terms.append([(p[0], p[1] * scale, alike) for p in parts])
            shared.append(sum(p[2] for p in parts) * scale)
            mine.append(sum(p[3] for p in parts) * scale)
            alpha.append(sum(p[4] for p in parts) * scale)
            section.append(s)

        channels = (0, 1) if double else (0,)
        for i, _, s in geo.ref:
            for ch in channels:
                add([part(i, ch, 1.0)], s)
        inside, extra = {r[0] for r in geo.ref}, []
        for h, t in geo.pairs:
            for ch in channels:
                add([part(h, ch, 1.0), part(t, ch, -1.0)], -1)
            extra += [i for i in (h, t) if i not in inside and i not in extra]
        for i in extra if double else []:
            add([part(i, 1, 1.0), part(i, 0, -1.0)], -1, 0.5, 1.0)
        rows = len(terms)
        self.take, self.value, self.spread = np.zeros((2, rows), dtype=np.int64), np.zeros((2, rows)), np.zeros((2, rows))
        for r, parts in enumerate(terms):
            for k, (at, c, alike) in enumerate(parts):
                self.take[k, r], self.value[k, r], self.spread[k, r] = at, c, alike or c * c
        self.shared, self.mine, self.section = np.array(shared).reshape(rows, n), np.array(mine).reshape(rows, own), np.array(section, dtype=np.int64)
        if not double and fixed.alpha is None and fixed.dalpha is not None:
            self.offset, self.extra = self.shared[:, 1] * fixed.dalpha[0], self.shared[:, 1] ** 2 * fixed.dalpha[1]
        elif fixed.alpha is not None:
            given = np.array([fixed.alpha[int(i)] for i in self.ix]).reshape(-1, 2)
            alpha = np.array(alpha).reshape(rows, nx)
            self.offset, self.extra = alpha @ given[:, 0], alpha**2 @ given[:, 1]
        else:
            self.offset = self.extra = np.zeros(rows)
        free = n if double else 1
        self.columns = self.shared[:, -free:] if fixed.alpha is None and fixed.dalpha is None else np.zeros((rows, 0))

    def rows(self, r) -> arrowhead.Rows:
        """The observations of one gathered row; those with anything missing are left out."""
        nan = np.full(len(self.ix), np.nan)
        at = np.searchsorted(self.ix, np.asarray(r.ix, dtype=np.int64))
        values, spreads = [], []
        for k in range(1 + self.double):
            v, s = nan.copy(), nan.copy()
            v[at], s[at] = np.asarray(getattr(r, f"i{k}"), float), np.asarray(getattr(r, f"v{k}"), float)
            values.append(v)
            spreads.append(s)
        v, s = np.concatenate(values), np.concatenate(spreads)
        two = self.value[1] != 0
        y = self.value[0] * v[self.take[0]] + np.where(two, self.value[1] * v[self.take[1]], 0.0)
        var = self.spread[0] * s[self.take[0]] + np.where(two, self.spread[1] * s[self.take[1]], 0.0)
        tref = np.asarray(r.tref, float)
        u = np.where(self.section >= 0, 1 / (tref[self.section] + ZERO_C), 0.0) if len(tref) else np.zeros(len(y))
        y, var = y - self.offset, var + self.extra
        if self.fixed.gamma is not None:
            y, var, g = y - u * self.fixed.gamma[0], var + u**2 * self.fixed.gamma[1], self.columns
        else:
            g = np.column_stack([u, self.columns])
        ok = np.isfinite(y) & np.isfinite(var) & (var > 0)
        return arrowhead.Rows(g[ok], self.mine[ok], y[ok], 1 / var[ok])


@dataclass
class Fit:
    """Shared parameters with covariance, and each time's own.

    ``times`` has ``time, p, v, cov, cross, follow, root``: own parameters, their variances, covariance matrix and covariance
    with the shared ones, row by row; for sampling, how they fall as the shared ones rise and a root of their covariance at given
    shared ones. Names give the places.
    """

    shared: list[str]
    own: list[str]
    value: np.ndarray
    cov: np.ndarray
    err: float
    times: DataFrame
    geo: Geometry
    fixed: Fixed
    double: bool
    n_times: int

    def get(self, name: str) -> tuple[float, float]:
        """Value and variance of a shared parameter, given or fitted."""
        given = {"gamma": self.fixed.gamma, "dalpha": self.fixed.dalpha}.get(name)
        if given is not None:
            return float(given[0]), float(given[1])
        k = self.shared.index(name)
        return float(self.value[k]), float(self.cov[k, k])

    def p_val(self) -> DataFrame:
        """``(name, time, value, var)`` of all fitted parameters; time is null for shared ones."""
        spark = self.times.sparkSession
        rows = [(n, None, float(self.value[k]), float(self.cov[k, k])) for k, n in enumerate(self.shared)]
        shared = spark.createDataFrame(rows, "name string, time timestamp, value double, var double")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), self.own_col(n).alias("value"), self.own_col(n, "v").alias("var")) for n in self.own]))
        return shared.unionByName(self.times.select("time", each.alias("_e")).select("_e.name", "time", "_e.value", "_e.var"))

    def p_cov(self) -> DataFrame:
        """``(name, other, time, cov)`` of the shared parameters, of each time's own, and of own with shared ones; own parameters
        of different times are left out, as no result needs them."""
        spark, n, m = self.times.sparkSession, len(self.shared), len(self.own)
        rows = [(a, b, None, float(self.cov[i, j])) for i, a in enumerate(self.shared) for j, b in enumerate(self.shared)]
        shared = spark.createDataFrame(rows, "name string, other string, time timestamp, cov double")
        names = [(a, b) for a in self.own for b in self.own] + [(a, b) for a in self.own for b in self.shared]
        listed = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("other")) for a, b in names])
        own = self.times.select("time", F.posexplode(F.concat(F.slice("cov", 1, m * m), F.slice("cross", 1, m * n))).alias("_k", "cov"))
        return shared.unionByName(own.select(F.get(listed, F.col("_k")).alias("_n"), "time", "cov").select("_n.name", "_n.other", "time", "cov"))

    def own_col(self, name: str, column: str = "p") -> Column:
        return F.element_at(column, self.own.index(name) + 1)

    def own_cov(self, a: str, b: str) -> Column:
        n = len(self.own)
        return F.element_at("cov", self.own.index(a) * n + self.own.index(b) + 1)

    def cross_cov(self, a: str, shared: str) -> Column:
        """Covariance of an own with a shared parameter, 0 if that is given."""
        if shared not in self.shared:
            return F.lit(0.0)
        return F.element_at("cross", self.own.index(a) * len(self.shared) + self.shared.index(shared) + 1)


def narrow(f: Fit) -> tuple[DataFrame, Callable, Callable, Callable, Callable]:
    """The own parameters as one narrow row for each time, to be joined to measurements, with columns for value, variance,
    covariance of two own parameters and covariance with gamma or dalpha. Covariances with attenuations stay behind."""
    own = f.own
    cols = {f"_p_{a}": f.own_col(a) for a in own} | {f"_v_{a}": f.own_col(a, "v") for a in own}
    cols |= {f"_c_{a}_{b}": f.own_cov(a, b) for i, a in enumerate(own) for b in own[i + 1 :]}
    cols |= {f"_x_{a}_{s}": f.cross_cov(a, s) for a in own for s in ("gamma", "dalpha")}
    times = f.times.select("time", *[c.alias(k) for k, c in cols.items()])

    def cov(a: str, b: str) -> Column:
        i, j = sorted((own.index(a), own.index(b)))
        return F.col(f"_c_{own[i]}_{own[j]}")

    return times, lambda a: F.col(f"_p_{a}"), lambda a: F.col(f"_v_{a}"), cov, lambda a, s: F.col(f"_x_{a}_{s}")


TIMES = "time timestamp, p array<double>, v array<double>, cov array<double>, cross array<double>, follow array<double>, root array<double>"


def _gather(meas: DataFrame, series: DataFrame, geo: Geometry, double: bool) -> DataFrame:
    """One row for each time: arrays over the needed locations, and the bath temperatures by section."""
    spark = meas.sparkSession
    rows = meas.join(F.broadcast(spark.createDataFrame([(i,) for i in geo.needed()], "ix int")), "ix")
    chans = [("st", "ast"), ("rst", "rast")][: 1 + double]
    bad, vague = F.lit(False), F.lit(False)
    cols = {}
    for k, (a, b) in enumerate(chans):
        bad = bad | (F.col(a) <= 0) | (F.col(b) <= 0)
        vague = vague | F.col(f"{a}_v").isNull() | F.col(f"{b}_v").isNull()
        cols |= {f"i{k}": log_ratio(a, b), f"v{k}": F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(f"{a}_v") / F.col(a) ** 2 + F.col(f"{b}_v") / F.col(b) ** 2)}
    item = F.struct("ix", *[F.coalesce(c, F.lit(float("nan"))).alias(n) for n, c in cols.items()])
    rows = rows.withColumns({"_bad": F.coalesce(bad, F.lit(False)), "_vague": vague})
    each = rows.groupBy("time").agg(F.sort_array(F.collect_list(F.when(~F.col("_bad"), item))).alias("_rows"), F.count_if("_bad").alias("bad"), F.count_if("_vague").alias("vague"))
    each = each.join(series.select("time", F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in geo.names]).alias("tref")).dropDuplicates(["time"]), "time")
    pick = lambda n: F.transform("_rows", lambda r: r[n]).alias(n)
    return each.select("time", "bad", "vague", "tref", pick("ix"), *[pick(n) for n in cols])


def fit(meas: DataFrame, series: DataFrame, geo: Geometry, fixed: Fixed, double: bool) -> Fit:
    """Weighted least squares; ``meas`` has the variances as ``st_v`` and so on. In the sections, intensities that are not positive
    and variances that are missing raise; null intensities are left out. At most ``MOST_SHARED`` parameters can be shared."""
    if double:
        shared = [*([] if fixed.gamma else ["gamma"]), *([] if fixed.alpha is not None else geo.alphas)]
        own = ["df", "db", *(f"taf_{k}" for k in range(len(geo.splices))), *(f"tab_{k}" for k in range(len(geo.splices)))]
    else:
        shared = [n for n, given in (("gamma", fixed.gamma), ("dalpha", fixed.dalpha or fixed.alpha)) if given is None]
        own = ["c", *(f"taf_{k}" for k in range(len(geo.splices)))]
    n = len(shared)
    if n > MOST_SHARED:
        raise ValueError(f"{n} shared parameters, more than {MOST_SHARED}: take shorter or coarser sections")
    if fixed.alpha is not None and any(i not in fixed.alpha for i in geo.needed()):
        raise ValueError("the given attenuations lack a location of the sections")
    gathered = written(_gather(meas, series, geo, double), "reference")
    design = Design(geo, fixed, double)

    def sums(p: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, b, rest = np.zeros((n, n)), np.zeros(n), np.zeros(6)
            for batch in batches:
                for r in batch.itertuples(index=False):
                    ds, db, drr, dn, rank = arrowhead.partial(design.rows(r), p)
                    s, b, rest = s + ds, b + db, rest + [drr, dn, dn > 0, rank, r.bad, r.vague]
            if rest.any():
                yield pd.DataFrame({"k": np.arange(n + 1), "v": [*np.column_stack([s, b]), rest]})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": rows["k"].iloc[:1], "v": [np.sum(np.stack(list(rows["v"])), axis=0)]})

        # one row for each row of the small system, summed on the executors
        out = {r.k: r.v for r in gathered.mapInPandas(run, "k int, v array<double>").groupBy("k").applyInPandas(add, "k int, v array<double>").collect()}
        both = np.array([out.get(k, np.zeros(n + 1)) for k in range(n)]).reshape(n, n + 1)
        return both[:, :n], both[:, n], *out.get(n, np.zeros(6))

    p = np.zeros(n)
    for _ in range(2):  # the second round refines the first
        s, b, rr, obs, n_times, ranks, bad, vague = sums(p)
        if bad:
            raise ValueError("intensities in the sections must be positive")
        if vague:
            raise ValueError("variances in the sections must be positive and finite")
        if not obs:
            raise ValueError("no reference observations")
        step, inverse, rank = arrowhead.solve(s, b)
        p, rr = p + step, rr - float(b @ step)
    free = obs - rank - ranks
    err = max(rr, 0.0) / free if free > 0 else float("nan")
    cov = inverse * err

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                value, c, cross, follow, normal = arrowhead.own(design.rows(r), p, cov, err)
                out.append((r.time, value, np.diag(c), c.ravel(), cross.ravel(), follow.ravel(), arrowhead.root(normal).ravel()))
            yield pd.DataFrame(out, columns=["time", "p", "v", "cov", "cross", "follow", "root"])

    times = written(gathered.mapInPandas(local, TIMES), "times")
    return Fit(shared, own, p, cov, err, times, geo, fixed, double, int(n_times))


def _shadow(splices: list[float], column: Callable[[int], Column], forward: bool) -> Column:
    """Sum over the splices that the light has passed: at or after them forwards, before them backwards."""
    out = F.lit(0.0)
    for k, p in enumerate(splices):
        out = out + F.when((F.col("x") >= p) if forward else (F.col("x") < p), column(k)).otherwise(0.0)
    return out


@dataclass
class Result:
    """``temperature`` has the calibrated values; ``params_t`` and ``params_x`` the parameters by time and by location."""

    temperature: DataFrame
    params_t: DataFrame
    params_x: DataFrame
    fit: Fit

    @property
    def params(self) -> dict[str, float]:
        out = {}
        for n in ("gamma", "dalpha"):
            if n in self.fit.shared or getattr(self.fit.fixed, n) is not None:
                out[n], out[f"{n}_var"] = self.fit.get(n)
        return out


def _given(fix_alpha: DataFrame) -> dict:
    rows = fix_alpha.limit(MOST_LOCATIONS + 1).collect()
    if len(rows) > MOST_LOCATIONS:
        raise ValueError(f"more than {MOST_LOCATIONS} given attenuations")
    return {r.ix: (r.alpha, r.alpha_var) for r in rows}


def calibrate_single(meas: DataFrame, series: DataFrame, sections: DataFrame, st_var: Variance, ast_var: Variance, matching: list | None = None, trans_att: list[float] = (), fix_gamma: tuple[float, float] | None = None, fix_dalpha: tuple[float, float] | None = None, fix_alpha: DataFrame | None = None, external: External | None = None, check: bool = True) -> Result:
    """Temperatures ``tmpf`` with ``tmpf_var`` and its components (``dT_*`` and covariances) of a single-ended set-up.

    ``fix_alpha(ix, alpha, alpha_var)`` gives the integrated attenuation of every location and excludes ``fix_dalpha`` and
    matching sections. ``external`` gives all parameters instead of a fit. Rows of ``meas`` whose time has no reference
    rows give no temperature; null or non-positive intensities outside the sections give a null one.
    """
    if fix_alpha is not None and (fix_dalpha is not None or matching):
        raise ValueError("given attenuations exclude a given dalpha and matching sections")
    rows = with_variance(with_variance(meas, "st", st_var), "ast", ast_var)
    geo = geometry(meas, sections, matching, list(trans_att), False, series, check)
    if external is not None:
        return single_temperatures(rows, external.fit(meas.sparkSession, geo, False))
    given = _given(fix_alpha) if fix_alpha is not None else None
    return single_temperatures(rows, fit(rows, series, geo, Fixed(fix_gamma, fix_dalpha, given), False), fix_alpha)


@dataclass
class External:
    """Parameters from elsewhere. ``p`` has each own parameter by time (``time, c, taf_0, ...`` or ``time, df, db, taf_0, ..., tab_0, ...``),
    ``shared`` the value and variance of gamma and dalpha, double-ended also of ``alpha_<ix>`` at the reference locations; ``p``'s
    columns ``<name>_var`` are variances (0 if absent). Covariances between parameters are taken as 0."""

    shared: dict[str, tuple[float, float]]
    p: DataFrame

    def fit(self, spark, geo: Geometry, double: bool) -> Fit:
        m = range(len(geo.splices))
        shared = ["gamma", *geo.alphas] if double else ["gamma", "dalpha"]
        own = ["df", "db", *(f"taf_{k}" for k in m), *(f"tab_{k}" for k in m)] if double else ["c", *(f"taf_{k}" for k in m)]
        missing = [n for n in shared if n not in self.shared] + [n for n in own if n not in self.p.columns]
        if missing:
            raise ValueError(f"the given parameters lack {missing}")
        var = [F.col(f"{n}_var").cast("double") if f"{n}_var" in self.p.columns else F.lit(0.0) for n in own]
        cov = F.array(*[var[i] if i == j else F.lit(0.0) for i in range(len(own)) for j in range(len(own))])
        none = F.array_repeat(F.lit(0.0), len(own) * len(shared))
        times = self.p.select("time", F.array(*[F.col(n).cast("double") for n in own]).alias("p"), F.array(*var).alias("v"), cov.alias("cov"), none.alias("cross"), none.alias("follow"), F.transform(cov, F.sqrt).alias("root"))
        values = np.array([self.shared[n] for n in shared], dtype=float).reshape(-1, 2)
        return Fit(shared, own, values[:, 0], np.diag(values[:, 1]), float("nan"), times, geo, Fixed(), double, times.count())


def single_temperatures(rows: DataFrame, f: Fit, fix_alpha: DataFrame | None = None) -> Result:
    gamma, gamma_var = f.get("gamma")
    times, p, v, own_cov, cross = narrow(f)
    joined = rows.join(times, "time")
    spark = rows.sparkSession
    if fix_alpha is not None:
        given = spark.createDataFrame([(ix, float(a), float(b)) for ix, (a, b) in f.fixed.alpha.items()], "ix int, _a double, _av double")  # at most MOST_LOCATIONS rows
        joined = joined.join(F.broadcast(given), "ix")
    else:
        dalpha, dalpha_var = f.get("dalpha")
        joined = joined.withColumns({"_a": F.col("x") * dalpha, "_av": F.col("x") ** 2 * dalpha_var})
    sp = f.geo.splices
    ta = _shadow(sp, lambda k: p(f"taf_{k}"), True)
    lr = log_ratio("st", "ast")
    joined = joined.withColumn("_t", gamma / (lr + p("c") + F.col("_a") + ta))
    t = F.col("_t")
    d_g, d_c = t / gamma, -(t**2) / gamma
    cov = lambda a, b: float(f.cov[f.shared.index(a), f.shared.index(b)]) if a in f.shared and b in f.shared else 0.0
    parts = {
        "dT_dst": (d_c / F.col("st")) ** 2 * F.col("st_v"), "dT_dast": (d_c / F.col("ast")) ** 2 * F.col("ast_v"), "dT_dgamma": d_g**2 * gamma_var, "dT_dc": d_c**2 * v("c"), "dT_dalpha": d_c**2 * F.col("_av"),
        "dT_dta": d_c**2 * _shadow(sp, lambda k: v(f"taf_{k}"), True), "dgamma_dc": 2 * d_g * d_c * cross("c", "gamma"),
        "dta_dgamma": 2 * d_c * d_g * _shadow(sp, lambda k: cross(f"taf_{k}", "gamma"), True), "dta_dc": 2 * d_c**2 * _shadow(sp, lambda k: own_cov(f"taf_{k}", "c"), True),
    }
    if fix_alpha is None:
        d_d = F.col("x") * d_c
        parts |= {"dgamma_ddalpha": 2 * d_g * d_d * cov("gamma", "dalpha"), "ddalpha_dc": 2 * d_d * d_c * cross("c", "dalpha"), "dta_ddalpha": 2 * d_c * d_d * _shadow(sp, lambda k: cross(f"taf_{k}", "dalpha"), True)}
    joined = joined.withColumn("talpha_fw_full", ta).withColumns(parts).withColumns({"tmpf": t - ZERO_C, "tmpf_var": sum((F.col(k) for k in parts), F.lit(0.0))})
    keep = [c for c in rows.columns if c not in parts]
    losses = F.array(*[p(f"taf_{k}") for k in range(len(sp))]).cast("array<double>"), F.array(*[v(f"taf_{k}") for k in range(len(sp))]).cast("array<double>")
    params_t = times.select("time", p("c").alias("c"), v("c").alias("c_var"), cross("c", "gamma").alias("gamma_c"), cross("c", "dalpha").alias("dalpha_c"), losses[0].alias("talpha_fw"), losses[1].alias("talpha_fw_var"))
    if fix_alpha is not None:
        where = [(ix, x, *map(float, f.fixed.alpha[ix])) for ix, x in f.geo.x.items() if ix in f.fixed.alpha]
    else:
        where = [(ix, x, x * dalpha, x**2 * dalpha_var) for ix, x in f.geo.x.items()]
    params_x = spark.createDataFrame(where, "ix int, x double, alpha double, alpha_var double")
    return Result(joined.select(*keep, "tmpf", "tmpf_var", "talpha_fw_full", *parts), params_t, params_x, f)


def calibrate_double(meas: DataFrame, series: DataFrame, sections: DataFrame, st_var: Variance, ast_var: Variance, rst_var: Variance, rast_var: Variance, matching: list | None = None, trans_att: list[float] = (), fix_gamma: tuple[float, float] | None = None, fix_alpha: DataFrame | None = None, external: External | None = None, check: bool = True) -> Result:
    """Temperatures ``tmpf``, ``tmpb`` and their weighted mean ``tmpw`` with variances of a double-ended set-up.

    Besides ``tmp*_var``: ``tmpw_var_approx`` (from the two variances alone), ``tmpw_var_lower`` (noise only), and all components with
    the prefixes ``fw_``, ``bw_`` and ``w_``. The attenuation ``alpha`` is zero at the first reference location; outside the
    fitted locations it is the inverse-variance mean over time of half the difference of the directions.
    """
    rows = meas
    for label, var in (("st", st_var), ("ast", ast_var), ("rst", rst_var), ("rast", rast_var)):
        rows = with_variance(rows, label, var)
    geo = geometry(meas, sections, matching, list(trans_att), True, series, check)
    if external is not None:
        return double_temperatures(rows, external.fit(meas.sparkSession, geo, True))
    given = _given(fix_alpha) if fix_alpha is not None else None
    f = fit(rows, series, geo, Fixed(fix_gamma, None, given), True)
    return double_temperatures(rows, f, fix_alpha)


def alpha_everywhere(rows: DataFrame, f: Fit) -> DataFrame:
    """``(ix, x, alpha, alpha_var)`` by the inverse-variance mean over time, for any location."""
    sp = f.geo.splices
    times, p, var, _, _ = narrow(f)
    taf, tab = (lambda c: _shadow(sp, lambda k: c(f"taf_{k}"), True)), (lambda c: _shadow(sp, lambda k: c(f"tab_{k}"), False))
    a = (log_ratio("rst", "rast") - log_ratio("st", "ast") + p("db") - p("df") + tab(p) - taf(p)) / 2
    noise = sum((F.col(f"{c}_v") / F.col(c) ** 2 for c in ("st", "ast", "rst", "rast")), F.lit(0.0))
    v = (noise + var("df") + var("db") + taf(var) + tab(var)) / 2
    good = rows.filter("st > 0 AND ast > 0 AND rst > 0 AND rast > 0").join(times, "time").select("ix", "x", a.alias("_a"), v.alias("_v"))
    return good.groupBy("ix", "x").agg((F.sum(F.col("_a") / F.col("_v")) / F.sum(1 / F.col("_v"))).alias("alpha"), (1 / F.sum(1 / F.col("_v"))).alias("alpha_var"))


def _alpha_cross(f: Fit) -> DataFrame:
    """``(time, ix, _k_<own>...)``: covariance of each own parameter with the attenuation of each fitted location."""
    n = len(f.shared)
    fitted = [(ix, f.shared.index(f.geo.alphas[k])) for ix, k in f.geo.columns.items() if k >= 0]
    item = lambda ix, at: F.struct(F.lit(ix).cast("int").alias("ix"), *[F.element_at("cross", i * n + at + 1).alias(f"_k_{a}") for i, a in enumerate(f.own)])
    if len(fitted) <= 200:
        return f.times.select("time", F.explode(F.array(*[item(ix, at) for ix, at in fitted])).alias("_e")).select("time", "_e.*")
    places = f.times.sparkSession.createDataFrame(fitted, "ix int, _at int")  # at most MOST_SHARED columns' locations
    both = f.times.select("time", "cross").join(F.broadcast(places))
    return both.select("time", "ix", *[F.element_at("cross", F.col("_at") + (i * n + 1)).alias(f"_k_{a}") for i, a in enumerate(f.own)])


def double_temperatures(rows: DataFrame, f: Fit, fix_alpha: DataFrame | None = None) -> Result:
    spark, geo = rows.sparkSession, f.geo
    gamma, gamma_var = f.get("gamma")
    if fix_alpha is not None:
        where = [(ix, x, *map(float, f.fixed.alpha[ix]), 0.0) for ix, x in geo.x.items() if ix in f.fixed.alpha]
        params_x = spark.createDataFrame(where, "ix int, x double, alpha double, alpha_var double, gamma_alpha double")
    else:
        known = []
        g = f.shared.index("gamma") if "gamma" in f.shared else None
        for ix, col in geo.columns.items():
            k = f.shared.index(geo.alphas[col]) if col >= 0 else None
            known.append((ix, float(f.value[k]), float(f.cov[k, k]), float(f.cov[g, k]) if g is not None else 0.0) if k is not None else (ix, 0.0, 0.0, 0.0))
        fitted = spark.createDataFrame(known, "ix int, _alpha double, _alpha_var double, gamma_alpha double")
        params_x = alpha_everywhere(rows, f).join(F.broadcast(fitted), "ix", "left").select("ix", "x", F.coalesce("_alpha", "alpha").alias("alpha"), F.coalesce("_alpha_var", "alpha_var").alias("alpha_var"), F.coalesce("gamma_alpha", F.lit(0.0)).alias("gamma_alpha"))
        params_x = written(params_x, "params_x")
    sp = geo.splices
    times, p, v, own_cov, cross = narrow(f)
    joined = rows.join(times, "time").join(F.broadcast(params_x.drop("x")), "ix")  # as many rows as locations, see geometry
    # covariance with the location's attenuation, which only fitted locations have
    if fix_alpha is None and geo.alphas:
        joined = joined.join(_alpha_cross(f), ["time", "ix"], "left")
        with_alpha = lambda name: F.coalesce(F.col(f"_k_{name}"), F.lit(0.0))
    else:
        with_alpha = lambda name: F.lit(0.0)
    fwd, bwd = (lambda c: _shadow(sp, lambda k: c(f"taf_{k}"), True)), (lambda c: _shadow(sp, lambda k: c(f"tab_{k}"), False))
    alpha = F.col("alpha")
    joined = joined.withColumns({
        "_tf": gamma / (log_ratio("st", "ast") + p("df") + alpha + fwd(p)), "_tb": gamma / (log_ratio("rst", "rast") + p("db") - alpha + bwd(p)), "talpha_fw_full": fwd(p), "talpha_bw_full": bwd(p),
        "_df_v": v("df"), "_db_v": v("db"), "_ta_f": fwd(v), "_ta_b": bwd(v),
        "_g_df": cross("df", "gamma"), "_g_db": cross("db", "gamma"), "_a_df": with_alpha("df"), "_a_db": with_alpha("db"), "_df_db": own_cov("df", "db"),
        "_g_taf": fwd(lambda c: cross(c, "gamma")), "_g_tab": bwd(lambda c: cross(c, "gamma")), "_a_taf": fwd(with_alpha), "_a_tab": bwd(with_alpha),
        "_df_taf": fwd(lambda c: own_cov("df", c)), "_db_tab": bwd(lambda c: own_cov("db", c)), "_df_tab": bwd(lambda c: own_cov("df", c)), "_db_taf": fwd(lambda c: own_cov("db", c)),
    })
    c = F.col
    tf, tb = c("_tf"), c("_tb")
    df_, db_ = -(tf**2) / gamma, -(tb**2) / gamma  # derivative to df, forward attenuation and loss; to db and backward loss
    fw = {
        "dT_dst": (df_ / c("st")) ** 2 * c("st_v"), "dT_dast": (df_ / c("ast")) ** 2 * c("ast_v"), "dT_dgamma": (tf / gamma) ** 2 * gamma_var, "dT_ddf": df_**2 * c("_df_v"), "dT_dalpha": df_**2 * c("alpha_var"), "dT_dta": df_**2 * c("_ta_f"),
        "dgamma_ddf": 2 * tf / gamma * df_ * c("_g_df"), "dgamma_dalpha": 2 * tf / gamma * df_ * c("gamma_alpha"), "dalpha_ddf": 2 * df_**2 * c("_a_df"), "dta_dgamma": 2 * tf / gamma * df_ * c("_g_taf"), "dta_ddf": 2 * df_**2 * c("_df_taf"), "dta_dalpha": 2 * df_**2 * c("_a_taf"),
    }
    bw = {
        "dT_drst": (db_ / c("rst")) ** 2 * c("rst_v"), "dT_drast": (db_ / c("rast")) ** 2 * c("rast_v"), "dT_dgamma": (tb / gamma) ** 2 * gamma_var, "dT_ddb": db_**2 * c("_db_v"), "dT_dalpha": db_**2 * c("alpha_var"), "dT_dta": db_**2 * c("_ta_b"),
        "dgamma_ddb": 2 * tb / gamma * db_ * c("_g_db"), "dgamma_dalpha": -2 * tb / gamma * db_ * c("gamma_alpha"), "dalpha_ddb": -2 * db_**2 * c("_a_db"), "dta_dgamma": 2 * tb / gamma * db_ * c("_g_tab"), "dta_ddb": 2 * db_**2 * c("_db_tab"), "dta_dalpha": -2 * db_**2 * c("_a_tab"),
    }
    joined = joined.withColumns({f"fw_{k}": v for k, v in fw.items()} | {f"bw_{k}": v for k, v in bw.items()})
    total = lambda p, names: sum((c(f"{p}_{k}") for k in names), F.lit(0.0))
    joined = joined.withColumns({"tmpf_var": total("fw", fw), "tmpb_var": total("bw", bw), "_nf": total("fw", ["dT_dst", "dT_dast"]), "_nb": total("bw", ["dT_drst", "dT_drast"])})
    joined = joined.withColumns({"tmpw_var_approx": 1 / (1 / c("tmpf_var") + 1 / c("tmpb_var")), "tmpw_var_lower": 1 / (1 / c("_nf") + 1 / c("_nb"))})
    joined = joined.withColumns({"_wf": c("tmpw_var_approx") / c("tmpf_var"), "_wb": c("tmpw_var_approx") / c("tmpb_var")})
    f_, b_ = c("_wf") * df_, c("_wb") * db_
    g_, a_ = c("_wf") * tf / gamma + c("_wb") * tb / gamma, f_ - b_
    w = {
        "dT_dst": (f_ / c("st")) ** 2 * c("st_v"), "dT_dast": (f_ / c("ast")) ** 2 * c("ast_v"), "dT_drst": (b_ / c("rst")) ** 2 * c("rst_v"), "dT_drast": (b_ / c("rast")) ** 2 * c("rast_v"),
        "dT_dgamma": g_**2 * gamma_var, "dT_ddf": f_**2 * c("_df_v"), "dT_ddb": b_**2 * c("_db_v"), "dT_dalpha": a_**2 * c("alpha_var"), "dT_dtaf": f_**2 * c("_ta_f"), "dT_dtab": b_**2 * c("_ta_b"),
        "dgamma_ddf": 2 * g_ * f_ * c("_g_df"), "dgamma_ddb": 2 * g_ * b_ * c("_g_db"), "dgamma_dalpha": 2 * g_ * a_ * c("gamma_alpha"), "dgamma_dtaf": 2 * g_ * f_ * c("_g_taf"), "dgamma_dtab": 2 * g_ * b_ * c("_g_tab"),
        "ddf_ddb": 2 * f_ * b_ * c("_df_db"), "ddf_dalpha": 2 * f_ * a_ * c("_a_df"), "ddf_dtaf": 2 * f_**2 * c("_df_taf"), "ddf_dtab": 2 * f_ * b_ * c("_df_tab"), "ddb_dalpha": 2 * b_ * a_ * c("_a_db"), "ddb_dtaf": 2 * b_ * f_ * c("_db_taf"), "ddb_dtab": 2 * b_**2 * c("_db_tab"),
    }
    joined = joined.withColumns({f"w_{k}": v for k, v in w.items()})
    joined = joined.withColumns({"tmpf": tf - ZERO_C, "tmpb": tb - ZERO_C, "tmpw": c("_wf") * tf + c("_wb") * tb - ZERO_C, "tmpw_var": total("w", w)})
    keep = [*rows.columns, "tmpf", "tmpb", "tmpw", "tmpf_var", "tmpb_var", "tmpw_var", "tmpw_var_approx", "tmpw_var_lower", "talpha_fw_full", "talpha_bw_full"]
    m = range(len(sp))
    listed = lambda of, d: F.array(*[of(f"ta{d}_{k}") for k in m]).cast("array<double>")
    params_t = times.select(
        "time", p("df").alias("df"), p("db").alias("db"), v("df").alias("df_var"), v("db").alias("db_var"), cross("df", "gamma").alias("gamma_df"), cross("db", "gamma").alias("gamma_db"), own_cov("df", "db").alias("df_db"),
        *[listed(p, d[0]).alias(f"talpha_{d}") for d in ("fw", "bw")], *[listed(v, d[0]).alias(f"talpha_{d}_var") for d in ("fw", "bw")],
        *[listed(lambda c: cross(c, "gamma"), d[0]).alias(f"ta{d}_gamma") for d in ("fw", "bw")], *[listed(lambda c, o=o: own_cov(o, c), d[0]).alias(f"ta{d}_{o}") for d in ("fw", "bw") for o in ("df", "db")],
    )
    parts = [*(f"fw_{k}" for k in fw), *(f"bw_{k}" for k in bw), *(f"w_{k}" for k in w)]
    return Result(joined.select(*keep, *parts), params_t, params_x, f)
