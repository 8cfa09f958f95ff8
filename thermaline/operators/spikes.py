"""Implausible readings: additive outliers, stuck runs and values outside physical limits.

Each *source series* (for instance one run and fibre position) is read in time order. The scatter and the
autocorrelation that are usual for its *device* come from robust variogram statistics over all of that
device's series: with ``g1`` and ``g2`` the median squared first and second lag differences of an
autoregressive series of order one, ``g2 / g1 = 1 + phi``.

Two tests then alternate until neither finds anything more. The additive-outlier test compares a reading with the
autoregressive prediction from either side, for blocks of one to three readings; what it flags is left out from then on, so
that neighbouring outliers don't mask each other. The level-shift test looks for a single step far from the drift
around it that lasts; its size is estimated and taken out of the rest of the series, so that it is no outlier itself
and hides none beside it.

The readings are exchanged once by source series. Two passes over that exchange work on Arrow batches of whole series in
numpy: the first counts the differences of each device in logarithmic bins (mergeable, of bounded size), the second
does the tests. A series of more than ``HOT_ROWS`` readings is cut into slices by time first, each with a margin of its
neighbours' readings, so a hot series is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: More sources than this are joined by a shuffle, fewer are broadcast.
BROADCAST_SOURCES = 100_000
#: Series of more rows than this are sliced; a series has at most SLICES slices.
HOT_ROWS, SLICES = 1_000_000, 1024
#: Rows that a slice sees of each neighbour; more than the tests of MOST_ROUNDS rounds can reach, unless most are null or repeated.
MARGIN = 512
#: Rounds of both tests at most; each looks five readings further.
MOST_ROUNDS = 8
#: Readings that are tested at a time, besides the rest of a series.
CHUNK = 100_000
#: Logarithmic bins of differences to an octave: quantiles are right to about one part in a hundred.
BINS = 32
KINDS = ("", "limit", "stuck", "spike")


@dataclass(frozen=True)
class Field:
    """What a quantity can be: open limits, and whether it is compared by ratio."""

    name: str
    low: float
    high: float
    log: bool = False


def flag_implausible(
    readings: DataFrame,
    row_id: str,
    series: list[str],
    device: str,
    time: str,
    fields: list[Field],
    stuck: int = 6,
    z: float = 6.0,
    least_change: float = 0.7,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows ``(row_id, field, kind, score)`` of implausible readings; kind is ``limit``, ``stuck`` or ``spike``, score the
    distance in scatters that the outlier test found.

    ``limit``: not inside the field's open limits. ``stuck``: one of at least ``stuck`` readings in a row of exactly
    one value, in a device whose readings otherwise change in a share of at least ``least_change``. ``spike``: by the
    outlier test, ``z`` times the device's scatter away from both sides.

    Rows with the same ``row_id`` count once. A reading repeated under another id at the same time with the same
    value takes no part in the tests and shares the verdict of the first. Null and NaN readings are never flagged
    and are passed over. A null time sorts first; null keys form a series of their own. Readings at the ends of
    a series have a neighbour on one side only and are never spikes, as they can't be seen to come back.
    Ties in time are ordered by ``row_id``. An empty table gives an empty result; further columns are ignored.
    """
    keys = [f"_k{i}" for i in range(len(series))]
    values = [f"_v{i}" for i in range(len(fields))]
    base = readings.select(
        F.col(row_id).alias("_id"), *[F.col(c).alias(k) for c, k in zip(series, keys)], F.col(device).alias("_dev"), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"),
        *[F.col(f.name).cast("double").alias(v) for f, v in zip(fields, values)], F.lit(True).alias("_mine"),
    )
    few = base.select("_dev").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hot = base.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    base = _sliced(base, hot, keys, hot_rows) if hot.limit(1).count() else base.withColumn("_slice", F.lit(0))
    whole = [*keys, "_slice"]

    by_time = lambda df: df.sortWithinPartitions(*whole, "_t", "_id")
    counted = by_time(base.repartition(*whole)).mapInArrow(_counts(whole, fields, stuck), "_dev string, _f int, _stat string, _bin int, _n long")
    stats = _models(counted, fields).select(F.col("_dev").alias("_dev_s"), *[f"_{n}{i}" for i in range(len(fields)) for n in ("phi", "scale", "change")])
    same = F.col("_dev").cast("string").eqNullSafe(F.col("_dev_s"))
    tested = by_time(base.repartition(*whole).join(F.broadcast(stats), same, "left") if few else base.join(stats, same, "left").repartition(*whole))
    out = T.StructType([T.StructField("row_id", readings.schema[row_id].dataType), T.StructField("_f", T.IntegerType()), T.StructField("_kind", T.IntegerType()), T.StructField("score", T.DoubleType())])
    found = tested.drop("_dev", "_dev_s").mapInArrow(_tests(whole, fields, stuck, z, least_change), out)
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(at) + 1)
    return found.select("row_id", pick([f.name for f in fields], "_f").alias("field"), pick(KINDS, "_kind").alias("kind"), "score").dropDuplicates(["row_id", "field"])


def _sliced(base: DataFrame, hot: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Cuts the hot series into slices by quantiles of time; ``_mine`` is false for the margins that a slice sees of its neighbours."""
    on = [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]
    named = hot.select(*[F.col(k).alias(f"_h{k}") for k in keys], "_n")
    whole = base.join(named, on, "left")
    cold = whole.filter("_n IS NULL").select(*base.columns, F.lit(0).alias("_slice"))
    # every n-th of the quantiles, so that a slice has about hot_rows rows
    every = F.greatest(F.lit(1), F.floor(F.lit(float(SLICES)) * hot_rows / F.first("_n"))).cast("int")
    cuts = F.percentile_approx("_t", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), F.lit(10 * SLICES))
    cuts = whole.filter("_n IS NOT NULL").groupBy(*keys).agg(F.array_distinct(F.filter(cuts, lambda _, i: (i + 1) % every == 0)).alias("_cuts"))
    warm = whole.filter("_n IS NOT NULL").select(*base.columns).join(cuts.select(*[F.col(k).alias(f"_h{k}") for k in keys], "_cuts"), on)
    warm = warm.withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))), F.lit(0))).select(*base.columns, "_slice")
    w = Window.partitionBy(*keys, "_slice")
    ends = [
        warm.withColumn("_r", F.row_number().over(w.orderBy(*order))).filter(F.col("_r") <= MARGIN).drop("_r").withColumns({"_slice": F.col("_slice") + step, "_mine": F.lit(False)})
        for order, step in (((F.asc("_t"), F.asc("_id")), -1), ((F.desc("_t"), F.desc("_id")), 1))
    ]
    return cold.unionByName(warm).unionByName(ends[0]).unionByName(ends[1])


def _series(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series with the number of each row's series; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def numbers(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            null = c.is_null().to_numpy(zero_copy_only=False)
            differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (null[1:] != null[:-1])
        return np.cumsum(new)

    def joined() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= CHUNK:
            t = joined()
            no = numbers(t)
            cut = int(np.searchsorted(no, no[-1]))
            if cut:
                yield t.slice(0, cut), no[:cut]
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        t = joined()
        yield t, numbers(t)


@dataclass
class _Readings:
    """The readings of one field that are there: rows of the table, each row of an id once."""

    row: np.ndarray
    no: np.ndarray
    v: np.ndarray
    first: np.ndarray  # not sent again
    inside: np.ndarray


def _readings(t: pa.Table, no: np.ndarray, i: int, f: Field) -> _Readings:
    v = t.column(f"_v{i}").to_numpy()
    row = np.flatnonzero(~np.isnan(v))
    v, no = v[row], no[row]
    ids = t.column("_id").combine_chunks().take(pa.array(row))
    stamps = t.column("_t").combine_chunks().take(pa.array(row))
    again, resent = np.zeros(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
    if len(row) > 1:
        one = no[1:] == no[:-1]
        equal = lambda c: pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        again[1:] = one & equal(ids)
        resent[1:] = one & equal(stamps) & (v[1:] == v[:-1])
    keep = ~again
    row, no, v, first = row[keep], no[keep], v[keep], ~resent[keep]
    return _Readings(row, no, v, first, (v > f.low) & (v < f.high))


def _lagged(x: np.ndarray, no: np.ndarray, k: int) -> np.ndarray:
    """The k-th value before (k > 0) or after (k < 0) in the same series, NaN where there is none."""
    out = np.full(len(x), np.nan)
    n = abs(k)
    if n < len(x):
        near, far = (slice(n, None), slice(None, -n)) if k > 0 else (slice(None, -n), slice(n, None))
        out[near] = np.where(no[near] == no[far], x[far], np.nan)
    return out


def _runs(r: _Readings) -> tuple[np.ndarray, np.ndarray]:
    """Position of each reading not sent again in its run of equal values, and the length of the run."""
    v, no = r.v[r.first], r.no[r.first]
    start = np.ones(len(v), dtype=bool)
    start[1:] = (v[1:] != v[:-1]) | (no[1:] != no[:-1])
    at = np.flatnonzero(start)
    lengths = np.diff(np.append(at, len(v)))
    which = np.cumsum(start) - 1
    return np.arange(len(v)) - at[which] + 1 if len(v) else np.zeros(0, dtype=int), lengths[which] if len(v) else np.zeros(0, dtype=int)


def _bins(d: np.ndarray) -> np.ndarray:
    """Number of the logarithmic bin of a distance; 0 is for zero."""
    with np.errstate(divide="ignore"):
        return np.where(d > 0, np.floor(np.log2(np.where(d > 0, d, 1.0)) * BINS).astype(np.int64) + 2000 * BINS, 0)


def _counts(keys: list[str], fields: list[Field], stuck: int) -> Callable:
    """First pass: counts of first and second lag differences, of second differences and of changes after equal readings, by device and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for t, no in _series(batches, keys):
            device = pc.cast(t.column("_dev").combine_chunks(), pa.string()).dictionary_encode("encode")
            names, codes = device.dictionary.to_pylist(), device.indices.to_numpy(zero_copy_only=False)
            mine = t.column("_mine").to_numpy()
            for i, f in enumerate(fields):
                r = _readings(t, no, i, f)
                at, _ = _runs(r)
                g = r.first & mine[r.row]
                one, short = np.zeros(len(r.v), dtype=bool), np.zeros(len(r.v), dtype=bool)
                one[r.first], short[r.first] = at == 1, at < stuck
                ok = r.first & r.inside
                y, n, own = np.log(r.v[ok]) if f.log else r.v[ok], r.no[ok], mine[r.row[ok]]
                y1, y2 = _lagged(y, n, 1), _lagged(y, n, 2)
                d1, d2 = np.abs(y - y1), np.abs(y - y2)
                stats = {"d1": d1, "d2": d2, "bend": np.abs(y - 2 * y1 + y2), "step": np.where((y1 == y2) & (d1 > 0), d1, np.nan)}
                for name, d in stats.items():
                    there = ~np.isnan(d) & own
                    _add(total, names, codes[r.row[ok][there]], i, name, _bins(d[there]))
                for name, there in (("new", one & g), ("short", short & g)):
                    _add(total, names, codes[r.row[there]], i, name, np.zeros(int(there.sum()), dtype=np.int64))
        cols = list(zip(*[(*k, n) for k, n in total.items()])) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()))], names=["_dev", "_f", "_stat", "_bin", "_n"])

    return run


def _add(total: dict, names: list, codes: np.ndarray, i: int, stat: str, bins: np.ndarray) -> None:
    width = 4096 * BINS
    pairs, n = np.unique(codes.astype(np.int64) * width + bins, return_counts=True)
    for p, c in zip(pairs.tolist(), n.tolist()):
        key = (names[p // width], i, stat, p % width)
        total[key] = total.get(key, 0) + c


def _models(counted: DataFrame, fields: list[Field]) -> DataFrame:
    """One row for each device with coefficient, scatter and share of changes of each field, from the merged counts."""
    bins = counted.groupBy("_dev", "_f", "_stat", "_bin").agg(F.sum("_n").alias("_n"))
    cells = bins.groupBy("_dev", "_f", "_stat").agg(F.array_sort(F.collect_list(F.struct("_bin", "_n"))).alias("_c"), F.sum("_n").alias("_all"))

    def quantile(q: float) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("b"))
        at = F.aggregate("_c", first, lambda s, c: F.struct((s["n"] + c["_n"]).alias("n"), F.coalesce(s["b"], F.when(s["n"] + c["_n"] >= F.col("_all") * q, c["_bin"])).alias("b")))["b"]
        return F.when(at == 0, 0.0).otherwise(F.pow(F.lit(2.0), (at - 2000 * BINS + 0.5) / BINS))

    of = lambda stat, value, alias: F.max(F.when(F.col("_stat") == stat, value)).alias(alias)
    rows = cells.groupBy("_dev", "_f").agg(of("d1", quantile(0.5), "_d1"), of("d2", quantile(0.5), "_d2"), of("bend", quantile(0.5), "_b50"), of("bend", quantile(0.85), "_b85"), of("step", quantile(0.25), "_step"), of("new", F.col("_all"), "_new"), of("short", F.col("_all"), "_short"))
    rows = rows.select("_dev", "_f", *_model())
    pick = lambda i, n: F.max(F.when(F.col("_f") == i, F.col(f"_{n}"))).alias(f"_{n}{i}")
    return rows.groupBy("_dev").agg(*[pick(i, n) for i in range(len(fields)) for n in ("phi", "scale", "change")])


def _model() -> list[Column]:
    """Autoregressive coefficient and scatter: ``Var(y - lag1) = 2 s^2 (1 - phi)``, ``Var(y - lag2) = 2 s^2 (1 - phi^2)``.

    The scatter is taken from second differences, which ignore drift; their upper part stands in for it where
    coarse resolution makes the median zero. Where that is zero too, the usual change after equal readings, the
    resolution, stands in for the median, so that single steps remain normal.
    """
    ratio = F.try_divide(F.col("_d2") * F.col("_d2"), F.col("_d1") * F.col("_d1"))
    phi = F.greatest(F.lit(0.0), F.least(F.lit(0.9), F.coalesce(ratio - 1, F.lit(0.0))))
    # median and 85 % point of |N(0,1)|; a second difference of independent readings has variance 6 s^2
    s = F.greatest(F.col("_b50") / 0.6745, F.col("_b85") / 1.4395) / 6**0.5
    s = F.when(s > 0, s).otherwise(F.col("_step") / 0.6745 / 6**0.5)
    return [phi.alias("_phi"), s.alias("_scale"), F.try_divide(F.col("_new").cast("double"), F.col("_short")).alias("_change")]


def _tests(keys: list[str], fields: list[Field], stuck: int, z: float, least_change: float) -> Callable:
    """Second pass: the verdict of each reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, no in _series(batches, keys):
            mine = t.column("_mine").to_numpy()
            for i, f in enumerate(fields):
                r = _readings(t, no, i, f)
                of = lambda n: t.column(f"_{n}{i}").to_numpy()[r.row]  # noqa: B023, E731
                ok = r.first & r.inside
                score = np.zeros(len(r.v))
                score[ok] = _outliers(np.log(r.v[ok]) if f.log else r.v[ok].copy(), r.no[ok], of("phi")[ok], of("scale")[ok], z)
                kind = np.where(score > z, 3, 0)
                _, length = _runs(r)
                at = np.flatnonzero(r.first)
                kind[at[(length >= stuck) & (of("change")[at] >= least_change)]] = 2
                kind[~r.inside] = 1
                # what was sent again shares the verdict of the first
                last = np.maximum.accumulate(np.where(r.first, np.arange(len(kind)), 0)) if len(kind) else np.zeros(0, dtype=int)
                kind, score = kind[last], np.where(r.first, score, 0.0)
                hit = np.flatnonzero((kind > 0) & mine[r.row])
                if len(hit):
                    ids = t.column("_id").combine_chunks().take(pa.array(r.row[hit]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(hit), i), pa.int32()), pa.array(kind[hit], pa.int32()), pa.array(score[hit])], names=["row_id", "_f", "_kind", "score"])

    return run


def _outliers(y: np.ndarray, no: np.ndarray, phi: np.ndarray, scale: np.ndarray, z: float) -> np.ndarray:
    """Score of each reading; both tests alternate, and only series in which one of them found something are read again."""
    scale = np.where(scale > 0, scale, np.nan)  # a device that never changes has no scatter to compare with, and no outlier
    phi = np.nan_to_num(phi)
    score, todo = np.zeros(len(y)), np.arange(len(y))
    for _ in range(MOST_ROUNDS):
        todo = todo[score[todo] <= z]
        if not len(todo):
            break
        s = _additive(y[todo], no[todo], phi[todo], scale[todo], z)
        score[todo] = np.maximum(score[todo], s)
        clean = todo[s <= z]
        step = _shifts(y[clean], no[clean], scale[clean], z)
        if step.any():
            # the level of what follows in the series is taken back, flagged readings with it
            full = np.zeros(len(y))
            full[clean] = step
            total = np.cumsum(full)
            start = np.searchsorted(no, no)
            y -= total - np.where(start > 0, total[start - 1], 0.0)
        changed = np.unique(np.concatenate([no[todo[s > z]], no[clean[step != 0]]]))
        if not len(changed):
            break
        todo = clean[np.isin(no[clean], changed)]
    return score


def _median3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Median of up to three values, the nearest first; later ones may be missing."""
    middle = np.fmax(np.fmin(a, b), np.fmin(np.fmax(a, b), c))
    return np.where(np.isnan(c), np.where(np.isnan(b), a, (a + b) / 2), middle)


def _additive(y: np.ndarray, no: np.ndarray, phi: np.ndarray, scale: np.ndarray, z: float) -> np.ndarray:
    """By how many scatters each reading, as part of a block of one to three, leaves both sides' predictions the same way."""
    with np.errstate(invalid="ignore"):
        sides = []
        for sign in (1, -1):
            near = [_lagged(y, no, sign * k) for k in range(1, 6)]
            # prediction from a side: its level, pulled to the nearest reading by the autocorrelation over the gap
            side = []
            for k in range(3):
                level = _median3(*near[k : k + 3])
                gap = near[k] - level
                side.append(np.where(np.abs(gap) <= z * scale, level + phi ** (k + 1) * gap, np.nan))
            sides.append(side)
        best = np.zeros(len(y))
        for length in (1, 2, 3):
            for o in range(length):
                b, a = sides[0][o], sides[1][length - 1 - o]
                best = np.fmax(best, np.maximum(y - np.maximum(b, a), np.minimum(b, a) - y))
        return np.nan_to_num(best / scale)


def _shifts(y: np.ndarray, no: np.ndarray, scale: np.ndarray, z: float) -> np.ndarray:
    """Size of the lasting level shift that begins at each reading, else 0.

    A shift is a single difference far from the drift around it, the median of two differences before and three after;
    the nearest differences on both sides are near that drift, and the third reading after it is still at the new level.
    """
    step = np.zeros(len(y))
    with np.errstate(invalid="ignore"):
        bound = z * 2**0.5 * scale  # a difference of two readings
        jump = y - _lagged(y, no, 1)
        at = np.flatnonzero(np.abs(jump) > bound)
        if len(at):
            steps = [_lagged(jump, no, k)[at] for k in (2, 1, -1, -2, -3)]
            there = ~np.isnan(steps[1]) & ~np.isnan(steps[2]) & ~np.isnan(steps[3])
            at, steps = at[there], np.array(steps)[:, there]
        if len(at):
            drift = np.nanmedian(steps, axis=0)
            size, far = jump[at] - drift, bound[at]
            calm = (np.abs(steps[1] - drift) <= far) & (np.abs(steps[2] - drift) <= far)
            later = steps[2] + steps[3] + steps[4] - 3 * drift
            step[at] = np.where(calm & (np.abs(size) > far) & (np.isnan(later) | (np.abs(later) <= far)), size, 0.0)
    return step
