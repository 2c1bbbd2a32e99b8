"""Robust statistics of a few large groups, from counts by bins.

The rows of a large group are never gathered or dealt. Every task counts the values of each (group, item) by the leading
bits of the number, with the ends and sums of each bin; what a group has is its bins. The driver, which holds these bins of
at most ``MOST_GROUPS`` groups, finds the bin of each wanted rank, and those a median distance can lie in. What the
ends of a bin do not show is counted again on a finer grid between them. So a column is read about three times,
whatever its size, in batches of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.session import local_frame, staged

#: (group, item) pairs the driver holds bins of, and bins or cells it holds at most
MOST_GROUPS, MOST_BINS = 2_000, 2_000_000
#: bits of the number that do not count for a bin: 128 bins for each doubling
LOW_BITS = 45
#: cells of a finer grid, and rows worked on at once
CELLS, CHUNK = 4_096, 200_000
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)
_BINS = "_g long, _i int, _bin long, _c long, _lo double, _hi double, _s1 double, _s2 double"
_CELLS = "_ask int, _cell int, _c long, _lo double, _hi double"


def _bin(v: np.ndarray) -> np.ndarray:
    """Grows with the number."""
    bits = v.view(np.int64)
    return (bits ^ ((bits >> 63) & _SIGN)) >> LOW_BITS


def _edge(at: np.ndarray) -> np.ndarray:
    bits = at << LOW_BITS
    return (bits ^ ((bits >> 63) & _SIGN)).view(np.float64)


def _segments(batches: Iterator[pa.RecordBatch], items: int):
    """(group, item, values) of each group in chunks of the rows; nulls are left out, -0.0 is 0.0."""
    held, rows = [], 0

    def work():
        table = pa.Table.from_batches(held)
        g = table.column(0).to_numpy()
        order = np.argsort(g, kind="stable")
        g = g[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
        for i in range(items):
            column = table.column(i + 1)
            v = column.to_numpy()[order] + 0.0
            known = column.is_valid().to_numpy()[order] if column.null_count else None
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = v[a:b] if known is None else v[a:b][known[a:b]]
                if len(own):
                    yield int(g[a]), i, own

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield from work()
            held, rows = [], 0
    if rows:
        yield from work()


def _runs(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts, least and greatest of the runs of equal ``at`` over ascending x."""
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[start[1:], len(x)]
    return start, end - start, x[start], x[end - 1]


def _binned(items: int):
    def run(batches):
        for g, i, v in _segments(batches, items):
            x = np.sort(v)
            x[np.isnan(x)] = np.nan  # one bit pattern
            at = _bin(x)
            start, c, lo, hi = _runs(x, at)
            with np.errstate(all="ignore"):
                off = x - np.repeat(_edge(at[start]), c)
                s1, s2 = np.add.reduceat(off, start), np.add.reduceat(off * off, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), g)), pa.array(np.full(len(c), i, np.int32)), pa.array(at[start]), pa.array(c), pa.array(lo), pa.array(hi),
                 pa.array(s1), pa.array(s2)], names=["_g", "_i", "_bin", "_c", "_lo", "_hi", "_s1", "_s2"])

    return run


def _celled(asks: Mapping[tuple[int, int], list], items: int, cells: int):
    def run(batches):
        for g, i, v in _segments(batches, items):
            for number, centre, low, high in asks.get((g, i), ()):
                x = v if centre is None else np.abs(v - centre)
                inside = np.sort(x[(x >= low) & (x <= high)])
                cell = np.minimum(((inside - low) / (high - low) * cells).astype(np.int32), cells - 1)
                at, c, lo, hi = _runs(inside, cell) if len(inside) else ([np.zeros(0, t) for t in (np.int64, np.int64, float, float)])
                k = len(c) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, number, np.int32)), pa.array(np.r_[-1, cell[at]].astype(np.int32)), pa.array(np.r_[np.count_nonzero(x < low), c].astype(np.int64)),
                     pa.array(np.r_[low, lo]), pa.array(np.r_[low, hi])], names=["_ask", "_cell", "_c", "_lo", "_hi"])

    return run


def _merged(rows: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(m).alias(m) for m in more])


def _at_rank(c: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: int):
    """(value, None), or (None, (from, to, rank within)) where the ends of the bin do not show it."""
    upto = np.cumsum(c)
    b = int(np.searchsorted(upto, rank, side="right"))
    within = rank - int(upto[b] - c[b])
    if lo[b] == hi[b] or within == 0:
        return float(lo[b]), None
    if within == c[b] - 1:
        return float(hi[b]), None
    return None, (float(lo[b]), float(hi[b]), within)


def _between(lo: float, hi: float, part: float) -> float:
    return lo if lo == hi else lo * (1 - part) + hi * part


def _sides(p: float, n: int) -> tuple[int, int, float]:
    pos = (n - 1) * p
    return int(np.floor(pos)), int(np.ceil(pos)), pos - np.floor(pos)


def _found(rows: DataFrame, items: int, wanted: dict) -> dict:
    """Values of wanted ranks: ``wanted`` maps a name to (group, item, centre, from, to, ranks from the least not below ``from``),
    or, with a centre, ranks of all distances."""
    out: dict = {}
    while wanted:
        numbered = dict(enumerate(wanted.items()))
        asks: dict = {}
        for number, (_, (g, i, centre, low, high, _)) in numbered.items():
            asks.setdefault((g, i), []).append((number, centre, low, high))
        cells = max(2, min(CELLS, MOST_BINS // len(numbered)))
        got = _merged(rows.mapInArrow(_celled(asks, items, cells), _CELLS), ["_ask", "_cell"]).toPandas().sort_values(["_ask", "_cell"])
        left = {}
        for number, own in got.groupby("_ask"):
            name, (g, i, centre, _, _, rank) = numbered[number]
            below = int(own["_c"].iloc[0]) if centre is not None else 0
            c, lo, hi = (own[k].to_numpy()[1:] for k in ("_c", "_lo", "_hi"))
            value, rest = _at_rank(c, lo, hi, rank - below)
            if rest is None:
                out[name] = value
            else:
                # ranks of distances count from the least of all
                inner = int(c[lo < rest[0]].sum())
                left[name] = (g, i, centre, rest[0], rest[1], rest[2] if centre is None else below + inner + rest[2])
        wanted = left
    return out


def profile(shots: DataFrame, keys: Sequence[str], items: Sequence[str], groups: DataFrame, probs: Mapping[str, float], spread_of: str | None = None) -> DataFrame | None:
    """(keys, item, quantiles) of the item columns of a few groups, all of them in ``groups``, exact; with ``spread_of``, one of the
    quantiles, also n, std, v_min, v_max and ``mad``, the median distance from it. None where there are too many groups or
    bins, or a number is not finite. The shots are read about three times and should be stored."""
    from waferlake.functions.ordered import joined

    keys, items, spark = list(keys), list(items), shots.sparkSession
    if groups.count() * len(items) > MOST_GROUPS:
        return None
    names = staged(groups.select(*keys).withColumn("_g", F.monotonically_increasing_id()), "groups")
    rows = joined(shots, names, keys).select("_g", *[F.col(i).cast("double").alias(f"_x{n}") for n, i in enumerate(items)])
    bins = staged(_merged(rows.mapInArrow(_binned(len(items)), _BINS), ["_g", "_i", "_bin"], ["_s1", "_s2"]), "bins")
    if bins.count() > MOST_BINS:
        return None
    every = bins.toPandas().sort_values(["_g", "_i", "_bin"])
    if not np.isfinite(every[["_lo", "_hi", "_s1", "_s2"]].to_numpy()).all():
        return None
    held = {k: tuple(own[c].to_numpy() for c in ("_bin", "_c", "_lo", "_hi", "_s1", "_s2")) for k, own in every.groupby(["_g", "_i"])}
    known, wanted = {}, {}
    for (g, i), (_, c, lo, hi, _, _) in held.items():
        for p in set(probs.values()):
            for rank in set(_sides(p, int(c.sum()))[:2]):
                value, rest = _at_rank(c, lo, hi, rank)
                if rest is None:
                    known[g, i, rank] = value
                else:
                    wanted[g, i, rank] = (g, i, None, *rest)
    known |= _found(rows, len(items), wanted)
    quantile = lambda g, i, p, n: (lambda a, b, part: _between(known[g, i, a], known[g, i, b], part))(*_sides(p, n))
    facts = {(g, i): {name: quantile(g, i, p, int(own[1].sum())) for name, p in probs.items()} for (g, i), own in held.items()}
    if spread_of:
        near, asked = {}, {}
        for (g, i), (at, c, lo, hi, s1, s2) in held.items():
            n, f = int(c.sum()), facts[g, i]
            mean = _edge(at) + s1 / c
            square = float((s2 - s1 * s1 / c + c * (mean - (c * mean).sum() / n) ** 2).sum())
            least, most = float(lo[0]), float(hi[-1])
            std = None if n < 2 else 0.0 if least == most else float(np.sqrt(max(square, 0.0) / (n - 1)))
            f |= {"n": n, "std": std, "v_min": least, "v_max": most}
            # a distance is at least that of the nearer end of its bin and at most that of the farther one
            m = f[spread_of]
            inner = np.maximum(np.maximum(lo - m, m - hi), 0.0)
            outer = np.maximum(np.abs(lo - m), np.abs(hi - m))
            for rank in set(_sides(0.5, n)[:2]):
                low, high = (float(d[o][np.searchsorted(np.cumsum(c[o]), rank, side="right")]) for d in (inner, outer) for o in [np.argsort(d, kind="stable")])
                if low == high:
                    near[g, i, rank] = low
                else:
                    asked[g, i, rank] = (g, i, m, low, high, rank)
        near |= _found(rows, len(items), asked)
        for (g, i), f in facts.items():
            a, b, part = _sides(0.5, f["n"])
            f["mad"] = _between(near[g, i, a], near[g, i, b], part)
    columns = ["n", "std", "v_min", "v_max", "mad"] if spread_of else []
    fields = ", ".join(["_g long, item string"] + [f"{c} {'long' if c == 'n' else 'double'}" for c in [*columns, *probs]])
    table = local_frame(spark, [(g, items[i], *[f[c] for c in [*columns, *probs]]) for (g, i), f in facts.items()], fields)
    return names.join(table, "_g").drop("_g")


def _probe_bins(batches):
    for batch in batches:
        g, v = batch.column(0).to_numpy(), batch.column(1).to_numpy() + 0.0
        v[np.isnan(v)] = np.nan
        pairs = np.unique(np.stack([g, _bin(v)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["_g", "_bin"])


def _weighted(near: Mapping[int, np.ndarray], items: int):
    none = np.zeros(0, np.int64)

    def run(batches):
        for p, i, v in _segments(batches, items):
            g = p * items + i
            x = np.sort(v)
            x[np.isnan(x)] = np.nan
            start, c, x, _ = _runs(x, x)
            at = _bin(x)
            close = np.isin(at, near.get(g, none))
            far, w = at[~close], c[~close]
            first = np.flatnonzero(np.r_[True, far[1:] != far[:-1]]) if len(far) else none
            value, weight = np.r_[x[close], x[~close][first]], np.r_[c[close], np.add.reduceat(w, first) if len(far) else none]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), g)), pa.array(value), pa.array(weight.astype(np.int64))], names=["_g", "_v", "_w"])

    return run


def weighted(shots: DataFrame, keys: Sequence[str], items: Sequence[str], probes: DataFrame, probe: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Values of the item columns with their weights, probes and names of the groups (keys, item) that have probes, each with a
    number ``_g`` for its group. A value in a bin without a probe stands, with the first of its bin, for all of the bin. None
    where the probes are in too many bins."""
    from waferlake.functions.ordered import joined

    keys, items = list(keys), list(items)
    products = staged(probes.select(*keys).distinct().withColumn("_p", F.monotonically_increasing_id()), "groups")
    number = (F.col("_p") * len(items) + F.array_position(F.array(*[F.lit(i) for i in items]), F.col("item")) - 1).alias("_g")
    asked = joined(probes.where(F.col("item").isin(items)).select(*keys, "item", probe).distinct(), products, keys)
    names = asked.select(*keys, "item", number).distinct()
    asked = asked.select(number, F.col(probe).cast("double").alias("_v"))
    bins = staged(asked.mapInArrow(_probe_bins, "_g long, _bin long").distinct(), "asked-bins")
    if bins.count() > MOST_BINS:
        return None
    near = {int(g): np.sort(own["_bin"].to_numpy()) for g, own in bins.toPandas().groupby("_g")}
    rows = joined(shots, products, keys).select("_p", *[F.col(i).cast("double").alias(f"_x{n}") for n, i in enumerate(items)])
    return rows.mapInArrow(_weighted(near, len(items)), "_g long, _v double, _w long"), asked, names
