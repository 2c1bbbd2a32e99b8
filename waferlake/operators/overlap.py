"""Check items out of spec on the same site as device items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.functions import scalars as S
from waferlake.operators.rank import top_k
from waferlake.schema import REPORT, SITE, WAFER, Item


def shot_overlap(
    shots: DataFrame, items: Sequence[Item], scope: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per (shot, check item) whose shot has device items out too.

    All items of a touchdown stand in one wide row, so the overlap is a row
    expression and needs no join. ``scope`` limits a check item to categories;
    a check item without an entry is compared with every device item.
    """
    scope = scope or {}
    is_check = lambda i: (i.cat2 or "").upper() == "PCHK" or "PCHK" in i.alias.upper()
    has_spec = lambda i: i.spec_low is not None or i.spec_high is not None
    flag = lambda i: S.spec_out(i.alias, F.lit(i.spec_low).cast("double"), F.lit(i.spec_high).cast("double"))
    checks = [i for i in items if is_check(i) and has_spec(i)]
    devices = [i for i in items if not is_check(i) and has_spec(i)]
    entries = []
    for c in checks:
        cats = scope.get(c.alias)
        near = [d for d in devices if cats is None or d.cat2 in cats or d.alias in cats]
        hits = F.array_compact(F.array(*[F.when(flag(d), F.lit(d.alias)) for d in near])) if near else F.array().cast("array<string>")
        entries.append(F.when(flag(c), F.struct(F.lit(c.alias).alias("item"), hits.alias("with_items"))))
    rows = shots.select(*WAFER, *SITE, F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return rows.select(*WAFER, *SITE, "e.item", "e.with_items").where(F.size("with_items") > 0)


def overlap_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*REPORT, "item").agg(F.count("*").alias("overlap_shots"))


def overlap_items(rows: DataFrame) -> DataFrame:
    return rows.select(*REPORT, "item", F.explode("with_items").alias("with_item")).groupBy(
        *REPORT, "item", "with_item"
    ).agg(F.count("*").alias("shots"))


def overlap_examples(rows: DataFrame, k: int = 5) -> DataFrame:
    return top_k(rows, [*REPORT, "item"], ["wafer_id", "chip_y", "chip_x", "tkout_time"], k)
