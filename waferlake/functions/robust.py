"""Robust location and spread per group.

Spread is 1.4826 x the median absolute deviation; if that is zero the
interquartile range over 1.349; if that is zero the sample standard deviation;
zero after all counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import histogram, ordered
from waferlake.session import staged

MAD_FACTOR = 1.4826
IQR_FACTOR = 1.349


def spread_of(mad: Column, q1: Column, q3: Column, std: Column) -> Column:
    """The fallback chain; each step is tried only when the one before is zero."""
    first, second = F.lit(MAD_FACTOR) * mad, (q3 - q1) / F.lit(IQR_FACTOR)
    return F.when(first > 0, first).when(second > 0, second).when(std > 0, std)


QUARTILES = {"_q1": 0.25, "median": 0.5, "_q3": 0.75}


def _columns(q: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    return q.select(
        *keys, "n", "median", F.coalesce("std", F.lit(0.0)).alias("std"),
        spread_of(F.col("mad"), F.col("_q1"), F.col("_q3"), F.col("std")).alias("spread"), "v_min", "v_max", *more,
    )


def _small(groups: DataFrame, keys: Sequence[str], values: bool) -> DataFrame:
    q = ordered.of_arrays(groups.where(F.size("_v") > 0), keys, "_v", QUARTILES, spread_of="median")
    return _columns(q, keys, [F.col("values")] if values else [])


def _large(rows: DataFrame, keys: Sequence[str], values: bool) -> DataFrame:
    """Rows are (keys, _v)."""
    q = staged(ordered.narrowed(rows, keys, "_v", QUARTILES, spread_of="median"), "quartiles")
    open_groups = q.where("mad IS NULL").select(*keys, "median")
    if not open_groups.isEmpty():
        away = ordered.joined(rows, open_groups, keys).withColumn("_d", F.abs(F.col("_v") - F.col("median")))
        q = ordered.joined(q, ordered.narrowed(away, keys, "_d", {"_mad": 0.5}), keys, "left")
        q = q.withColumn("mad", F.coalesce("mad", "_mad"))
    return _columns(q, keys, [F.lit(None).cast("array<double>").alias("values")] if values else [])


def profile(df: DataFrame, keys: Sequence[str], value: str, values: bool = False) -> DataFrame:
    """Per group: n, median, std (0 for one value), spread, v_min, v_max.

    With ``values`` also the sorted values, NULL for a group too large for an
    array. ``df`` is read more than once, so a long plan should be stored before.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    large = ordered.large_groups(rows, keys)
    small = rows if large is None else ordered.joined(rows, large, keys, "left_anti")
    out = _small(small.groupBy(*keys).agg(F.collect_list("_v").alias("_v")), keys, values)
    return out if large is None else out.unionByName(_large(ordered.joined(rows, large, keys, "left_semi"), keys, values))


def profile_wide(shots: DataFrame, keys: Sequence[str], items: Sequence[str], values: bool = False) -> DataFrame:
    """``profile`` of every item column, as rows of (keys, item, ...). The shots are read more than once and should be stored."""
    keys, items = list(keys), list(items)
    large = ordered.large_groups(shots.select(*keys), keys)
    few = None if large is None else histogram.profile(shots, keys, items, large, QUARTILES, spread_of="median")
    if few is not None:
        # no row of a large group is dealt
        more = [F.lit(None).cast("array<double>").alias("values")] if values else []
        out = _columns(few, [*keys, "item"], more)
        small = ordered.joined(shots, large, keys, "left_anti")
        if small.select(*keys).isEmpty():
            return out
        return out.unionByName(_small(ordered.arrays_met(small.repartitionByRange(*keys), keys, items), [*keys, "item"], values))
    arrays, rows = ordered.arrays_wide(shots, keys, items)
    out = _small(arrays, [*keys, "item"], values)
    return out if rows is None else out.unionByName(_large(rows, [*keys, "item"], values))


def profile_met(shots: DataFrame, keys: Sequence[str], items: Sequence[str], values: bool = False) -> DataFrame:
    """The same of shots that meet in the task of their group, none of them too large for an array: no row travels again."""
    return _small(ordered.arrays_met(shots, keys, items), [*keys, "item"], values)
