"""Column expressions shared by the detectors and boards."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def direction(text: str | Column) -> Column:
    """UPPER, LOWER or BOTH; anything else is BOTH."""
    d = F.upper(F.trim(col(text)))
    return F.when(d.isin("UPPER", "LOWER"), d).otherwise("BOTH")


def below(value, low) -> Column:
    return F.coalesce(col(value) < col(low), F.lit(False))


def above(value, high) -> Column:
    return F.coalesce(col(value) > col(high), F.lit(False))


def spec_out(value, low, high) -> Column:
    """Outside either bound; a missing bound or value never counts."""
    return below(value, low) | above(value, high)


def effective_bounds(low, high, direc) -> tuple[Column, Column]:
    """UPPER ignores the low bound, LOWER the high bound."""
    d = col(direc)
    return F.when(d != "UPPER", col(low)), F.when(d != "LOWER", col(high))


def pass_flag(value, low, high, direc) -> Column:
    """1, 0 or NULL. A missing bound fails a both-sided test."""
    v, d = col(value), col(direc)
    low_ok = F.coalesce(v >= col(low), F.lit(False)).cast("int")
    high_ok = F.coalesce(v <= col(high), F.lit(False)).cast("int")
    return (
        F.when(v.isNull(), None).when(d == "UPPER", high_ok).when(d == "LOWER", low_ok).otherwise(low_ok * high_ok)
    )


def number(text: str | Column) -> Column:
    """Text to double; bad text and NaN become NULL."""
    x = col(text).try_cast("double")
    return F.when(~F.isnan(x), x)


def nearest_five(t: str | Column) -> Column:
    """Nearest multiple of five, ties to the even multiple."""
    return (F.bround(col(t) / 5) * 5).cast("int")


def zone(radius: str | Column, center: float = 60.0, middle: float = 100.0) -> Column:
    r = col(radius)
    return F.when(r <= center, "Center").when(r <= middle, "Middle").when(r.isNotNull(), "Edge")


def score_band(percent: str | Column) -> Column:
    p = col(percent)
    return (
        F.when(p.isNull(), "no data").when(p >= 99, "99").when(p >= 95, "95").when(p >= 90, "90").otherwise("below")
    )


def key(*parts) -> Column:
    return F.concat_ws("_", *[col(p).cast("string") for p in parts])


def split_key(k: str | Column) -> tuple[Column, Column, Column]:
    """(vehicle, lot, step) from the right; the vehicle may hold underscores."""
    parts = F.split(col(k), "_")
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return head, F.element_at(parts, -2), F.element_at(parts, -1)


def lot_prefix(lot: str | Column, mark: str) -> Column:
    return F.split_part(col(lot), F.lit(mark), F.lit(1))


def display_name(
    name: str | Column, prefixes: Sequence[str], suffixes: Sequence[str], replacements: Mapping[str, str]
) -> Column:
    """Strip prefixes, then suffixes, then replace, each in list order."""
    out = col(name)
    for p in prefixes:
        out = F.regexp_replace(out, "^" + re.escape(p), "")
    for s in suffixes:
        out = F.regexp_replace(out, re.escape(s) + "$", "")
    for old, new in replacements.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def wildcard(name: str | Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive match of any ``*``/``?`` pattern."""
    if not patterns:
        return F.lit(False)
    body = "|".join(re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in patterns)
    return F.coalesce(col(name).rlike(f"(?is)^(?:{body})$"), F.lit(False))


def truthy(text: str | Column) -> Column:
    t = F.lower(F.trim(col(text).cast("string")))
    return F.coalesce(t.isin("true", "1", "1.0", "y", "yes", "t"), F.lit(False))


def not_negative(x: str | Column) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(col(x), F.lit(0.0)))


def program_label(step_seq, points, dup) -> Column:
    return F.concat(
        col(step_seq), F.lit("("), col(points).cast("string"), F.lit("pt)_"), col(dup).cast("string")
    )


def clean_label(label: str | Column) -> Column:
    return F.regexp_replace(col(label), r"_1(\.0+)?$", "")


def map_label(root, wafer, layer) -> Column:
    return F.concat(
        col(root), F.lit(" #"), col(wafer).cast("string"), F.lit(" ("), F.substring(col(layer), 1, 2), F.lit(")")
    )


def list_cell(text: str | Column) -> Column:
    """Brackets and quotes out; numbers in ascending order, decimals kept. A list with other text stays as it is."""
    bare = F.trim(F.translate(col(text), "[]'\"", ""))
    parts = F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    shown = F.transform(F.array_sort(nums), lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string")))
    return F.when(F.exists(nums, lambda n: n.isNull()), bare).otherwise(F.array_join(shown, ", "))


def in_comma_list(cell: str | Column, value: str | Column) -> Column:
    parts = F.transform(F.split(F.upper(col(cell)), ","), lambda p: F.trim(p))
    return F.array_contains(parts, F.upper(F.trim(col(value))))


def critical_dimension_scale(item: str | Column, x: str | Column) -> Column:
    return F.when(col(item).rlike(r"^CD\d+$"), col(x) * 1000).otherwise(col(x))
