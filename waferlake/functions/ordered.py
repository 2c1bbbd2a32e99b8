"""Exact order statistics of groups of any size.

A group of at most ``ALONE`` rows travels as one array of its values, sorted
where it arrives. Larger groups are counted first and never gathered: their
quantiles are selected by narrowing. Rows are counted per (group, bin) on a
fixed logarithmic grid, with the least and the greatest value of every bin.
Running totals of the counts name the bin of a wanted rank; a bin with equal
ends, or one whose end is the rank itself, gives the value at once. What is
left is counted again on a finer grid between the ends of its bin. Counts are
combined before the shuffle, so a group of any size costs one row per bin and
task, what is gathered of it are its bins, which the grid bounds, and no row
is sorted.

Running sums need an order of all rows: these are range-partitioned, every
range counts on from the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waferlake.session import staged

#: rows a group may have to be gathered as one array; larger ones are counted in bins
ALONE = 10_000
#: first grid: bins per doubling of the magnitude, and the magnitudes it covers
PER_OCTAVE, OCTAVES = 128, 1100
#: later grids: bins between the ends of one bin
FINER = 512


def grid(value: str | Column) -> Column:
    """Bin of a number: grows with it, bins of equal relative width. NaN, as everywhere in Spark, is the greatest."""
    v = F.col(value) if isinstance(value, str) else value
    size = F.abs(v)
    step = F.floor(F.log2(size) * PER_OCTAVE) + F.lit(OCTAVES * PER_OCTAVE)
    step = F.when(size == 0, 0).when(size == F.lit(float("inf")), 2 * OCTAVES * PER_OCTAVE).otherwise(step)
    return F.when(F.isnan(v), 3 * OCTAVES * PER_OCTAVE).otherwise(F.when(v < 0, -step).otherwise(step)).cast("int")


def between(lo: Column, hi: Column, part: Column) -> Column:
    """Interpolate as Spark's own percentile does; equal ends stay exact."""
    return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", on: Column | None = None) -> DataFrame:
    """Join on equal keys, nulls included; the keys stay once."""
    renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    test = F.lit(True) if on is None else on
    for k in keys:
        test = test & a[k].eqNullSafe(F.col(f"_r_{k}"))
    return a.join(renamed, test, how).drop(*[f"_r_{k}" for k in keys])  # semi and anti joins have none to drop


def _counted(rows: DataFrame, keys: Sequence[str], extra: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[c.alias(n) for n, c in extra.items()])


def _let(value: Column, body) -> Column:
    """Bind an expression to a name, so that using it often evaluates it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _position(p: float, n: Column) -> Column:
    return (n - 1) * F.lit(float(p))


def _place(weighted: Column, rank: Column, n: Column) -> Column:
    """(index, before): the entry that holds a rank, and the rows of the entries before it. Entries carry their rows as ``c``."""
    zero = F.lit(0).cast("long")
    walk = F.aggregate(
        weighted, F.struct(zero.alias("seen"), F.lit(0).alias("index"), zero.alias("before")),
        lambda acc, b: F.struct(
            (acc["seen"] + b["c"]).alias("seen"),
            F.when(acc["seen"] + b["c"] <= rank, acc["index"] + 1).otherwise(acc["index"]).alias("index"),
            F.when(acc["seen"] + b["c"] <= rank, acc["seen"] + b["c"]).otherwise(acc["before"]).alias("before"),
        ))
    single = F.struct(n.alias("seen"), rank.cast("int").alias("index"), rank.alias("before"))
    return F.when(F.size(weighted) == n, single).otherwise(walk)


def _held(weighted: Column, p: float, n: Column) -> Column:
    """The two entries a quantile lies between, as an array of (at, e): the rank within the entry, and the entry."""
    low, high = F.floor(_position(p, n)).cast("long"), F.ceil(_position(p, n)).cast("long")

    def both(place: Column) -> Column:
        first = F.get(weighted, place["index"])
        over = high - place["before"] - first["c"]
        # the rank above is in the same entry or at the start of the next
        return F.array(
            F.struct((low - place["before"]).alias("at"), first.alias("e")),
            F.when(over < 0, F.struct((high - place["before"]).alias("at"), first.alias("e"))).otherwise(
                F.struct(over.alias("at"), F.get(weighted, place["index"] + 1).alias("e"))),
        )

    return _let(_place(weighted, low, n), both)


def _explicit(bins: Column) -> Column:
    """Whether the ends of all bins are all values there are."""
    return F.forall(bins, lambda b: b["lo"].eqNullSafe(b["hi"]) | (b["c"] <= 2))


def _away(bins: Column, centre: Column) -> Column:
    """Distances from a centre with their counts, ascending, of bins that are explicit."""
    one = lambda v, c: F.struct(F.abs(v - centre).alias("v"), c.alias("c"))
    return F.sort_array(F.flatten(F.transform(bins, lambda b: F.when(b["lo"].eqNullSafe(b["hi"]), F.array(one(b["lo"], b["c"]))).otherwise(
        F.array(one(b["lo"], F.lit(1).cast("long")), one(b["hi"], F.lit(1).cast("long")))))))


_DONE = "_lo <=> _hi OR _at = 0 OR _at = _c - 1"


def large_groups(rows: DataFrame, keys: Sequence[str], within: Sequence[str] | None = None) -> DataFrame | None:
    """The keys of the groups that are too large for an array, or None.

    ``within`` are some of the keys: groups of these are counted first, and what
    is small there is not counted again.
    """
    if within is not None:
        wide = large_groups(rows, within)
        if wide is None:
            return None
        rows = joined(rows, wide, within, "left_semi")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > ALONE)
    large = staged(sizes.select(*keys), "large")
    return None if large.isEmpty() else large


def _at(s: Column, p: float) -> Column:
    """Quantile of a sorted array."""
    pos = _position(p, F.size(s))
    low, high = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    return between(F.get(s, low), F.get(s, high), pos - F.floor(pos))


def of_arrays(groups: DataFrame, keep: Sequence[str], values: str, probs: Mapping[str, float], spread_of: str | None = None) -> DataFrame:
    """The columns of ``narrowed`` from one array of values for each group, without nulls; ``keep`` are the columns that stay."""
    groups = groups.select(*keep, F.sort_array(values).alias("_s"))
    s, n = F.col("_s"), F.size("_s")
    out = groups.select("*", *[_at(s, p).alias(name) for name, p in probs.items()])
    if not spread_of:
        return out.select(*keep, *probs)
    first, last = F.get(s, F.lit(0)), F.get(s, n - 1)
    mean = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v) / n
    square = _let(mean, lambda m: F.aggregate(s, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)))
    away = F.sort_array(F.transform(s, lambda v: F.abs(v - F.col(spread_of))))
    return out.select(
        *keep, n.cast("long").alias("n"),
        F.when(n > 1, F.when(first == last, 0.0).otherwise(F.sqrt(square / (n - 1)))).alias("std"),
        first.alias("v_min"), last.alias("v_max"), _let(away, lambda d: _at(d, 0.5)).alias("mad"), *probs, F.col("_s").alias("values"))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], more: Mapping[str, Column] | None = None,
    within: Sequence[str] | None = None, empty: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    NULL values do not count; a group without any other is absent, or with
    ``empty`` has NULLs. ``more`` are further aggregates of the same groups,
    ``within`` as for ``large_groups``. ``df`` is read twice, and once for each
    round that large groups need, so a long plan should be stored before.
    """
    keys, more = list(keys), dict(more or {})
    rows = df.withColumn("_v", F.col(value).cast("double"))
    if not empty:
        rows = rows.where(F.col("_v").isNotNull())
    aggs = [c.alias(n) for n, c in more.items()]
    large = large_groups(rows, keys, within)
    small = rows if large is None else joined(rows, large, keys, "left_anti")
    out = of_arrays(small.groupBy(*keys).agg(F.collect_list("_v").alias("_x"), *aggs), [*keys, *more], "_x", probs)
    if large is None:
        return out
    rest = joined(rows, large, keys, "left_semi")
    late = narrowed(rest, keys, "_v", probs)
    if more or empty:
        every = rest.groupBy(*keys).agg(*aggs) if more else large
        late = joined(every, late, keys, "left")
    return out.unionByName(late)


def arrays_met(shots: DataFrame, keys: Sequence[str], items: Sequence[str], name: str = "_v") -> DataFrame:
    """The values of every item column as one array for each (keys, item), in ``name``, of shots that meet in the task of their group."""
    packed = shots.groupBy(*keys).agg(*[F.collect_list(F.col(i).cast("double")).alias(i) for i in items])
    return packed.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).alias(name)) for i in items]))).where(F.size(name) > 0)


def arrays_wide(
    shots: DataFrame, keys: Sequence[str], items: Sequence[str], name: str = "_v",
) -> tuple[DataFrame, DataFrame | None]:
    """The values of every item column as one array for each (keys, item), in ``name``; and, as rows of (keys, item,
    ``name``), those of the groups that are too large for it, or None.

    A shot travels once with all its items, to where its neighbours in the key
    order go, so that what is counted next by a part of the keys meets there.
    """
    keys, items = list(keys), list(items)
    wide = shots.select(*keys, *[F.col(i).cast("double").alias(i) for i in items])
    large = large_groups(wide, keys)
    small = wide if large is None else joined(wide, large, keys, "left_anti")
    arrays = arrays_met(small.repartitionByRange(*keys), keys, items, name)
    if large is None:
        return arrays, None
    return arrays, joined(wide, large, keys, "left_semi").unpivot(keys, items, "item", name).where(F.col(name).isNotNull())


def packs(shots: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The shots of each group as one sorted array of ``fields``, in ``_p``; and the keys of the groups that are too
    large for it, or None.

    Shots of a group are combined where they are read, so its keys travel once. The shots should be stored.
    """
    keys = list(keys)
    rows = shots.select(*keys, *fields)
    large = large_groups(rows, keys)
    small = rows if large is None else joined(rows, large, keys, "left_anti")
    return small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_p")), large


def quantiles_wide(shots: DataFrame, keys: Sequence[str], items: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """``quantiles`` of every item column, as rows of (keys, item, ...). The shots should be stored."""
    arrays, rows = arrays_wide(shots, keys, items)
    out = of_arrays(arrays, [*keys, "item"], "_v", probs)
    return out if rows is None else out.unionByName(narrowed(rows, [*keys, "item"], "_v", probs))


def narrowed(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], spread_of: str | None = None) -> DataFrame:
    """``quantiles`` without gathering the rows of a group.

    With ``spread_of``, one of the quantiles, also n, std (sample, NULL for one
    value), v_min, v_max and ``mad``, the median distance from it, NULL where
    the bins do not show all values: such a distance needs a round of its own.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_bin", grid("_v"))
    extra = {"_mean": F.avg("_v"), "_var": F.var_pop("_v")} if spread_of else {}
    # a hash ahead of the keys makes the sorts below compare numbers and hardly ever texts
    bins = _counted(rows.withColumn("_h", F.xxhash64(*keys)), ["_h", *keys, "_bin"], extra)
    fields = [F.col("_bin").alias("bin"), F.col("_c").alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")]
    facts = [F.sum("_c").alias("_n")]
    if spread_of:
        mean = F.sum(F.col("_c") * F.col("_mean")) / F.sum("_c")
        fields += [F.col("_mean").alias("mean"), F.col("_var").alias("var")]
        facts += [mean.alias("_all"), F.min("_lo").alias("v_min"), F.max("_hi").alias("v_max")]
    # a group has at most as many bins as the grid has in its range
    group = bins.groupBy("_h", *keys).agg(*facts, F.sort_array(F.collect_list(F.struct(*fields))).alias("_b"))
    b, n = F.col("_b"), F.col("_n")
    found = group.withColumn("_w", F.array(*[_held(b, p, n) for p in probs.values()]))
    names = ["_n"]
    if spread_of:
        square = F.aggregate(b, F.lit(0.0), lambda acc, e: acc + e["c"] * (e["var"] + (e["mean"] - F.col("_all")) * (e["mean"] - F.col("_all"))))
        flat = F.col("v_min") == F.col("v_max")
        found = found.withColumn("std", F.when(n > 1, F.when(flat, 0.0).otherwise(F.sqrt(square / (n - 1)))))
        # the quantile the distances are taken from, and theirs, where the bins show all values
        p = probs[spread_of]
        end = lambda h: F.when(h["at"] == 0, h["e"]["lo"]).otherwise(h["e"]["hi"])
        part = lambda q: _position(q, n) - F.floor(_position(q, n))
        centre = _let(F.get("_w", F.lit(list(probs).index(spread_of))), lambda w: between(end(w[0]), end(w[1]), part(p)))
        away = _let(centre, lambda m: _away(b, m))
        middle = _let(away, lambda d: _let(_held(d, 0.5, n), lambda w: between(w[0]["e"]["v"], w[1]["e"]["v"], part(0.5))))
        found = found.withColumn("mad", F.when(_explicit(b), middle))
        names += ["std", "v_min", "v_max", "mad"]
    # one row for each group: the values at ranks that are known, and the ranks that are not
    entry = lambda h, i: F.struct(
        i.alias("_i"), h["at"].alias("_at"), h["e"]["c"].alias("_c"), h["e"]["lo"].alias("_lo"), h["e"]["hi"].alias("_hi"), h["e"]["bin"].alias("_bin"))
    known = lambda w: w["_lo"].eqNullSafe(w["_hi"]) | (w["_at"] == 0) | (w["_at"] == w["_c"] - 1)
    found = found.select(*keys, *names, F.transform(F.flatten("_w"), entry).alias("_w"))
    found = found.select(
        *keys, *names, F.transform("_w", lambda w: F.when(known(w), F.when(w["_at"] == 0, w["_lo"]).otherwise(w["_hi"]))).alias("_x"),
        F.filter("_w", lambda w: ~known(w)).alias("_open"))
    found = staged(found, "ranks")
    x = F.col("_x")
    left, done = found.where(F.size("_open") > 0).select(*keys, F.inline("_open")), []
    while not left.isEmpty():
        finer = staged(_finer(rows, left, keys), "ranks")
        # the end of the bin that is the rank itself
        done.append(finer.where(_DONE).select(*keys, "_i", F.when(F.col("_at") == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("_v")))
        left = finer.where(f"NOT ({_DONE})")
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d)
        late = every.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_late"))
        found = joined(found, late, keys, "left")
        x = F.transform("_x", lambda v, i: F.coalesce(v, F.element_at(F.col("_late"), i)))
    found = found.withColumn("_x", x)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        pos = _position(p, F.col("_n"))
        cols.append(between(F.get("_x", F.lit(2 * i)), F.get("_x", F.lit(2 * i + 1)), pos - F.floor(pos)).alias(name))
    more = [F.col("_n").alias("n"), *names[1:]] if spread_of else []
    return found.select(*keys, *more, *cols)


def _finer(rows: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The ranks left over, each within a bin of the finer grid between the ends of its own."""
    parent = [*keys, "_bin", "_from", "_to"]
    asks = left.groupBy(*keys, "_bin", F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).agg(F.collect_list(F.struct("_i", "_at")).alias("_w"))
    inside = (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))
    own = joined(rows, asks.select(*parent), [*keys, "_bin"], on=inside)
    part = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * FINER)
    bins = _counted(own.withColumn("_sub", F.least(part, F.lit(FINER - 1))), [*parent, "_sub"], {})
    upto = F.sum("_c").over(W.partitionBy(*parent).orderBy("_sub").rowsBetween(W.unboundedPreceding, 0))
    bins = joined(bins.withColumn("_before", upto - F.col("_c")), asks, parent)
    held = F.transform(
        F.filter("_w", lambda w: (w["_at"] >= F.col("_before")) & (w["_at"] < F.col("_before") + F.col("_c"))),
        lambda w: F.struct(w["_i"].alias("_i"), (w["_at"] - F.col("_before")).alias("_at")),
    )
    return bins.withColumn("_w", held).where(F.size("_w") > 0).select(*keys, "_bin", "_c", "_lo", "_hi", F.inline("_w"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column]) -> DataFrame:
    """Add inclusive running sums over ``order`` within ``keys``.

    ``sums`` maps the new column to the summed expression; ``F.lit(1)`` gives
    the row number. ``order`` must be a total order inside a group.
    """
    keys, order, columns = list(keys), list(order), df.columns
    spark = df.sparkSession
    cut = df.select("*", *[(F.col(e) if isinstance(e, str) else e).alias(f"_in_{c}") for c, e in sums.items()])
    cut = cut.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    # range bounds are sampled, so the tags are stored before anything builds on them
    cut = staged(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(f"_in_{c}").alias(f"_t_{c}") for c in sums])
    # one row per range of a group, at most as many as there are ranges
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    within = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = joined(cut, totals, [*keys, "_range"])
    return out.select(*columns, *[(F.sum(f"_in_{c}").over(within) + F.col(f"_b_{c}")).alias(c) for c in sums])


_BELOW = "_g long, _v double, _upto long, _range int, _total boolean"


def _below(batches):
    """Rows of one range, in order: for each probe the weight before it in its group, and the whole weight of each group."""
    group, carry, at = None, 0, 0
    batch = lambda g, v, upto, total: pa.RecordBatch.from_arrays(
        [pa.array(g, pa.int64()), pa.array(v, pa.float64()), pa.array(upto, pa.int64()),
         pa.array(np.full(len(g), at), pa.int32()), pa.array(np.full(len(g), total), pa.bool_())],
        names=["_g", "_v", "_upto", "_range", "_total"])
    for b in batches:
        if not b.num_rows:
            continue
        g, v, w = (b.column(c).to_numpy() for c in ("_g", "_v", "_w"))
        at, upto = b.column("_range")[0].as_py(), np.cumsum(w, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        base = upto[starts] - w[starts]
        if g[0] == group:
            base[0] -= carry
        elif group is not None:
            yield batch([group], [None], [carry], True)
        upto -= np.repeat(base, np.diff(np.r_[starts, len(g)]))
        ask, last = w == 0, starts[1:] - 1
        yield batch(g[ask], v[ask], upto[ask], False)
        yield batch(g[last], np.zeros(len(last)), upto[last], True)
        group, carry = int(g[-1]), int(upto[-1])
    if group is not None:
        yield batch([group], [None], [carry], True)


def share_below(
    population: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, probe: str, wide: tuple[DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """For each distinct probe of a group: share of the population strictly below.

    Values are counted by the bins of the first grid; a bin without a probe
    travels as one row with its weight, so only values near a probe are sorted.
    Probes are sorted in among them with weight zero, so one pass over
    the ranges answers all of them; only the probes and the weight of each
    group in each range are written. ``wide`` is the population as shots and the
    names of their item columns, where the keys end in ``item``; these are
    counted in batches.
    """
    from waferlake.functions import histogram

    keys = list(keys)
    probes = probes.where(F.col(probe).isNotNull())
    counted = wide and histogram.weighted(wide[0], [k for k in keys if k != "item"], wide[1], probes, probe)
    if counted:
        rows, asked, names = counted
        names = staged(names, "groups")
    else:
        known = population.where(F.col(value).isNotNull())
        # a number for each group that is asked for travels with the values, not its names
        names = staged(probes.select(*keys).distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
        pop = joined(known, names, keys).select("_g", F.col(value).cast("double").alias("_v")).withColumn("_bin", grid("_v"))
        asked = joined(probes.select(*keys, probe).distinct(), names, keys).select("_g", F.col(probe).cast("double").alias("_v"))
        near = staged(asked.select("_g", grid("_v").alias("_bin")).distinct(), "asked-bins")
        one = pop.join(near, ["_g", "_bin"], "left_semi").select("_g", "_v", F.lit(1).cast("long").alias("_w"))
        far = pop.join(near, ["_g", "_bin"], "left_anti").groupBy("_g", "_bin").agg(F.min("_v").alias("_v"), F.count("*").alias("_w"))
        rows = one.unionByName(far.drop("_bin"))
    rows = rows.unionByName(asked.withColumn("_w", F.lit(0).cast("long")))
    # equal values of different tasks may part
    rows = rows.withColumn("_part", F.spark_partition_id()).repartitionByRange("_g", "_v", "_w", "_part")
    rows = rows.sortWithinPartitions("_g", "_v", "_w").select("_g", "_v", "_w", F.spark_partition_id().alias("_range"))
    found = staged(rows.mapInArrow(_below, _BELOW), "ranges")
    totals = found.where("_total").select("_g", "_range", F.col("_upto").alias("_n"))
    before = W.partitionBy("_g").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "_g", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("_g")).alias("_n"))
    hits = found.where("NOT _total").join(totals.where("_n > 0"), ["_g", "_range"]).join(names, "_g")
    return hits.select(*keys, F.col("_v").alias(probe), ((F.col("_upto") + F.col("_before")) / F.col("_n") * 100.0).alias("pctile"))
