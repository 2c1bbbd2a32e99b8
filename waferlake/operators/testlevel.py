"""One value per test instead of one per site, and index statistics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import ordered
from waferlake.functions import scalars as S
from waferlake.schema import REPORT, WAFER
from waferlake.session import staged

TEST = [*WAFER, "root_lot_id", "tkout_time"]


def aggregate_spec(name: str, table: Mapping[str, str]) -> str | None:
    """Aggregate of an item, case ignored: the first key that is the name, a wildcard of it, or its owner;
    without one P10 for windows."""
    low = name.lower()
    for key, spec in table.items():
        k = key.lower()
        pattern = re.escape(k).replace(r"\*", ".*").replace(r"\?", ".")
        if re.fullmatch(pattern, low) or low.startswith(f"{k}_"):
            return spec
    return "P10" if "window" in low else None


def aggregate_spec_column(name: str, table: Mapping[str, str]) -> Column:
    """The same lookup for a column of names."""
    low = F.lower(name)
    out = F.when(low.contains("window"), "P10")
    for key, spec in reversed(table.items()):
        k = key.lower()
        out = F.when(S.wildcard(name, [key]) | (low == k) | low.startswith(f"{k}_"), spec).otherwise(out)
    return out


MEAN_WORDS = frozenset({"mean", "avg"})


def quantile_of(spec: str) -> float | None:
    """Which order statistic a name asks for: a `P` number is that percentile, at most 100; a word for the mean
    gives None; every other name the median."""
    name = spec.strip().casefold()
    number = re.match(r"p([0-9]+(?:[.][0-9]+)?)$", name)
    if number:
        return min(float(number[1]), 100.0) / 100
    return None if name in MEAN_WORDS else 0.5


def per_test(points: DataFrame, table: Mapping[str, str]) -> DataFrame:
    """Replace the points of the listed items by one value per test; others pass through.

    The value stands on the first site of the test (in row, then column order)
    where the points have sites. One pass gives every statistic the table asks
    for; each item takes its own.
    """
    keys = [*TEST, "item"]
    sites = [c for c in ("chip_y", "chip_x") if c in points.columns]
    kept = points.where(~F.col("item").isin(*table)).select(*keys, *sites, "value", F.lit(False).alias("aggregated"))
    rows = points.where(F.col("item").isin(*table))
    # a group whose key holds a NULL disappears
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    asked = {item: quantile_of(spec) for item, spec in table.items()}
    probs = {f"_p{n}": p for n, p in enumerate(sorted({p for p in asked.values() if p is not None}))}
    more = {"_mean": F.avg("value"), "_at": F.min(F.struct(*sites)) if sites else F.lit(None)}
    if probs:
        one = ordered.quantiles(rows, keys, "value", probs, more, within=[*WAFER, "item"], empty=True)
    else:
        one = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in more.items()])
    value = F.col("_mean")
    for name, p in probs.items():
        value = F.when(F.col("item").isin(*[i for i, q in asked.items() if q == p]), F.col(name)).otherwise(value)
    out = one.select(*keys, *[F.col(f"_at.{c}").alias(c) for c in sites], value.alias("value"), F.lit(True).alias("aggregated"))
    return kept.unionByName(out)


def index_value(direction: str | Column, p10: str = "p10", med: str = "med", p90: str = "p90") -> Column:
    d = S.col(direction)
    return F.when(d == "UPPER", F.col(p90)).when(d == "LOWER", F.col(p10)).otherwise(F.col(med))


def index_values(points: DataFrame, items: DataFrame) -> DataFrame:
    """P90, P10 or median per wafer by report direction."""
    q = ordered.quantiles(points, [*WAFER, "item"], "value", {"p10": 0.1, "med": 0.5, "p90": 0.9})
    dims = items.select(F.col("alias").alias("item"), S.direction("direction").alias("direction"))
    return q.join(dims, "item").withColumn("index_value", index_value("direction"))


def statistic_table(points: DataFrame, items: DataFrame) -> DataFrame:
    """Four statistics per wafer item, chosen by direction, as rows."""
    keys = [*WAFER, "item"]
    more = {"mx": F.max("value"), "mn": F.min("value"), "sd": F.stddev_samp("value")}
    q = ordered.quantiles(points, keys, "value", {"p10": 0.1, "med": 0.5, "p90": 0.9}, more)
    dims = items.select(F.col("alias").alias("item"), S.direction("direction").alias("d"))
    wide = q.join(dims, "item")
    pair = lambda *ps: F.array(*[F.struct(F.lit(n).alias("stat"), F.col(c).alias("value")) for n, c in ps])
    p90, med, p10 = ("P90", "p90"), ("Med", "med"), ("P10", "p10")
    rows = (
        F.when(F.col("d") == "UPPER", pair(("Max", "mx"), p90, med, p10))
        .when(F.col("d") == "LOWER", pair(p90, med, p10, ("Min", "mn")))
        .otherwise(pair(p90, med, p10, ("Std", "sd")))
    )
    return wide.select(*keys, F.inline(rows))


def first_tests(points: DataFrame, min_points: int) -> DataFrame:
    """Earliest test with enough points per (report, wafer, item)."""
    tests = points.groupBy(*WAFER, "item", "tkout_time").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    return tests.groupBy(*WAFER, "item").agg(
        F.min("tkout_time").alias("tkout_time"), F.min_by("n", "tkout_time").alias("n")
    )


def metrics(points: DataFrame, items: DataFrame) -> DataFrame:
    """Population against target: medians, deviations, out-of-spec counts."""
    more = {"target_std": F.stddev_samp("value"), "spec_out_count": F.count_if(S.spec_out("value", "lo", "hi"))}
    tgt = ordered.quantiles(points.join(_bounds(items), "item"), [*REPORT, "item"], "value", {"target_median": 0.5}, more)
    return _against(points, tgt)


def metrics_wide(shots: DataFrame, names: Sequence[str], items: DataFrame) -> DataFrame:
    """The same from wide shots, which should be stored: a shot travels once with all its items."""
    keys, probs = [*REPORT, "item"], {"target_median": 0.5}
    arrays, rows = ordered.arrays_wide(shots, REPORT, names, "value")
    v, n = F.col("value"), F.size("value")
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    square = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean")))
    known = arrays.join(_bounds(items), "item").withColumn("_mean", mean).select(
        *keys, "value", F.when(n > 1, F.sqrt(square / (n - 1))).alias("target_std"),
        F.size(F.filter(v, lambda x: F.coalesce(S.spec_out(x, "lo", "hi"), F.lit(False)))).cast("long").alias("spec_out_count"))
    tgt = ordered.of_arrays(known, [*keys, "target_std", "spec_out_count"], "value", probs)
    if rows is not None:
        more = [F.stddev_samp("value").alias("target_std"), F.count_if(S.spec_out("value", "lo", "hi")).alias("spec_out_count")]
        rows = rows.join(_bounds(items), "item")
        late = ordered.joined(rows.groupBy(*keys).agg(*more), ordered.narrowed(rows, keys, "value", probs), keys)
        tgt = tgt.unionByName(late)
    return _against(shots.unpivot(["vehicle", "step_id"], list(names), "item", "value"), tgt)


def _bounds(items: DataFrame) -> DataFrame:
    dims = items.select(F.col("alias").alias("item"), "spec_low", "spec_high", S.direction("direction").alias("d"))
    return dims.select("item", *[c.alias(n) for c, n in zip(S.effective_bounds("spec_low", "spec_high", "d"), ("lo", "hi"))])


def _against(points: DataFrame, tgt: DataFrame) -> DataFrame:
    product = ["vehicle", "step_id", "item"]
    pop = ordered.quantiles(points, product, "value", {"pop_median": 0.5}, {"pop_std": F.stddev_samp("value")})
    # a row for each product item: stored, so that its size is known and the targets stay where they are
    out = tgt.join(staged(pop, "population"), product)
    gap = F.abs(F.col("target_median") - F.col("pop_median")) / F.col("pop_std")
    return out.withColumn("deviation", F.when(F.col("pop_std") > 0, F.round(gap, 2)).otherwise(0.0))


def spec_items_added(measured: DataFrame, items: DataFrame) -> DataFrame:
    """Items to look at per report: those with metrics first, then dictionary items that are measured without.

    ``measured`` has a row per (report, item) with ``n`` values and ``has_metrics``; an item of the dictionary
    counts if it has a report order. Both parts keep the dictionary's order.
    """
    dims = items.select(F.col("alias").alias("item"), "report_order", "decl_order")
    first = measured.where("has_metrics").join(dims, "item", "left")
    ordered_items = dims.where(F.col("report_order").isNotNull())
    rest = measured.where("n > 0").join(ordered_items, "item").join(first.select(*REPORT, "item"), [*REPORT, "item"], "left_anti")
    cols = [*REPORT, "item", "report_order", "decl_order"]
    return first.select(*cols, F.lit(False).alias("added")).unionByName(rest.select(*cols, F.lit(True).alias("added")))
