"""Statistics of groups whose rows stand together, in batches of numbers.

The rows come in an order in which those of a group follow each other within a task, none of them too large for an
array. A batch holds whole groups; sorting and counting go over all groups of a batch and one item at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from waferlake.functions import robust
from waferlake.schema import Item

#: rows worked on at once
CHUNK = 100_000


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a group starts; keys that are null are equal."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        a, b = column[1:], column[:-1]
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        change[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, each with the starts of these."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            first = _starts(table, keys)
            # the last group may go on
            if len(first) > 1:
                yield table.slice(0, first[-1]), first[:-1]
            held = table.slice(first[-1]).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def each_item(batches: Iterator[pa.RecordBatch], keys: Sequence[str], items: Sequence[str], own: Callable) -> Iterator[pa.RecordBatch]:
    """For each item what ``own(item, table, rows, values, starts, sizes)`` gives of the rows on which it is not null, as columns by name and,
    under None, the groups to keep; ahead of them the keys and the item."""
    for table, first in whole_groups(batches, keys):
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))
        named = table.select(list(keys)).take(pa.array(first))
        for k, item in enumerate(items):
            column = table.column(f"_x{k}")
            rows = np.flatnonzero(column.is_valid().to_numpy())
            if not len(rows):
                continue
            at = group[rows]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            with np.errstate(all="ignore"):
                found = own(item, table, rows, column.to_numpy()[rows], start, np.diff(np.r_[start, len(at)]))
            keep = found.pop(None, np.ones(len(start), bool))
            key = named.take(pa.array(at[start][keep]))
            cut = lambda c: c if isinstance(c, pa.Array) else pa.array(c[keep])
            yield pa.RecordBatch.from_arrays(
                [*[key.column(c).combine_chunks() for c in keys], pa.array(np.full(int(keep.sum()), item, object), pa.string()), *[cut(c) for c in found.values()]],
                names=[*keys, "item", *found])


def _in_order(v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the values in ascending order within their groups."""
    group = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int64), sizes)
    order = np.argsort(v)
    return order[np.argsort(group[order], kind="stable")]


def _quantile(x: np.ndarray, start: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    pos = (n - 1) * float(p)
    low = np.floor(pos)
    a, b, part = x[start + low.astype(np.int64)], x[start + np.ceil(pos).astype(np.int64)], pos - low
    return np.where(a == b, a, a * (1 - part) + b * part)


def _profile(item, table, rows, v, start, n):
    x = v[_in_order(v, n)]
    q1, median, q3 = (_quantile(x, start, n, p) for p in robust.QUARTILES.values())
    away = np.abs(x - np.repeat(median, n))
    mad = _quantile(away[_in_order(away, n)], start, n, 0.5)
    least, most = x[start], x[start + n - 1]
    off = x - np.repeat(np.add.reduceat(x, start) / n, n)
    flat = (least == most) | (np.isnan(least) & np.isnan(most))
    std = np.where((n < 2) | flat, 0.0, np.sqrt(np.add.reduceat(off * off, start) / np.maximum(n - 1, 1)))
    over = lambda a: (a > 0) | np.isnan(a)  # as Spark orders NaN
    first, second = robust.MAD_FACTOR * mad, (q3 - q1) / robust.IQR_FACTOR
    spread = np.where(over(first), first, np.where(over(second), second, std))
    some = over(first) | over(second) | over(std)
    return {
        "n": n.astype(np.int64), "median": median, "std": std, "spread": pa.array(spread, mask=~some), "v_min": least, "v_max": most,
        "values": pa.ListArray.from_arrays(pa.array(np.r_[start, len(x)].astype(np.int32)), pa.array(x)),
    }


def _made(rows: DataFrame, keys: Sequence[str], items: Sequence[str], own: Callable, columns: str) -> DataFrame:
    wide = rows.select(*keys, *[rows[i].cast("double").alias(f"_x{k}") for k, i in enumerate(items)])
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.select(*keys).schema)
    keys, items = list(keys), list(items)
    return wide.mapInArrow(lambda batches: each_item(batches, keys, items, own), f"{named}, item string, {columns}")


def profile(rows: DataFrame, keys: Sequence[str], items: Sequence[str], values: bool = False) -> DataFrame:
    """``robust.profile_wide`` of rows that stand together, with the sorted values where these are asked for."""

    def own(*given):
        found = _profile(*given)
        return found if values else {c: found[c] for c in found if c != "values"}

    more = ", values array<double>" if values else ""
    return _made(rows, keys, items, own, "n long, median double, std double, spread double, v_min double, v_max double" + more)


def quantile(rows: DataFrame, keys: Sequence[str], items: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """``ordered.quantiles_wide`` of rows that stand together."""
    probs = dict(probs)

    def own(item, table, rows, v, start, n):
        x = v[_in_order(v, n)]
        return {name: _quantile(x, start, n, p) for name, p in probs.items()}

    return _made(rows, keys, items, own, ", ".join(f"{c} double" for c in probs))


def sequences(rows: DataFrame, keys: Sequence[str], items: Sequence[Item], least: int) -> DataFrame:
    """``order.wafer_sequence`` of rows that stand together in measurement order: of groups of at least so many points, the
    longest run out of spec, the share out, and those of the first and the second half."""
    bounds = {i.alias: (i.spec_low, i.spec_high) for i in items}

    def own(item, table, rows, v, start, n):
        low, high = bounds[item]
        out = np.zeros(len(v), bool)
        if low is not None:
            out |= v < low
        if high is not None:
            out |= (v > high) | np.isnan(v)  # as Spark orders NaN
        half = np.maximum(1, n // 2)
        early = np.arange(len(v)) - np.repeat(start, n) < np.repeat(half, n)
        before = np.r_[False, out[:-1]]
        before[start] = False
        head = out & ~before
        length = np.zeros(len(v), np.int64)
        length[head] = np.bincount(np.cumsum(head)[out] - 1, minlength=int(head.sum()))
        total = lambda a: np.add.reduceat(a.astype(np.int64), start)
        return {
            "n": n.astype(np.int64), "run": np.maximum.reduceat(length, start), "dead": total(out) / n, "front": total(out & early) / half,
            "back": total(out & ~early) / np.maximum(1, n - half), None: n >= least,
        }

    return _made(rows, keys, list(bounds), own, "n long, run long, dead double, front double, back double")
