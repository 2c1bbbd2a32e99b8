"""Pass-rate boards and shot counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waferlake.functions import ordered
from waferlake.functions import scalars as S
from waferlake.schema import REPORT, WAFER


def pass_flags(points: DataFrame, items: DataFrame) -> DataFrame:
    dims = items.select(F.col("alias").alias("item"), "spec_low", "spec_high", S.direction("direction").alias("direction"))
    return points.join(dims, "item").withColumn("pass", S.pass_flag("value", "spec_low", "spec_high", "direction"))


def pass_rates(flags: DataFrame, keys: Sequence[str] = (*WAFER, "item")) -> DataFrame:
    """Percent passing per group; missing values do not count."""
    return flags.where(F.col("pass").isNotNull()).groupBy(*keys).agg(
        (F.avg("pass") * 100).alias("pass_rate"), F.count("*").alias("n")
    )


def pass_rates_wide(shots: DataFrame, items: Sequence, keys: Sequence[str] = WAFER) -> DataFrame:
    """The same from wide shots: one aggregate per item column, then rows."""
    flags = {}
    for i in items:
        low, high = F.lit(i.spec_low).cast("double"), F.lit(i.spec_high).cast("double")
        flags[i.alias] = S.pass_flag(F.col(i.alias), low, high, S.direction(F.lit(i.direction)))
    agg = shots.groupBy(*keys).agg(
        *[F.struct((F.avg(f) * 100).alias("r"), F.count(f).alias("n")).alias(n) for n, f in flags.items()]
    )
    rows = agg.unpivot(list(keys), list(flags), "item", "_s").where(F.col("_s.n") > 0)
    return rows.select(*keys, "item", F.col("_s.r").alias("pass_rate"), F.col("_s.n").alias("n"))


def wafer_board(rates: DataFrame, wafers: Sequence[int]) -> DataFrame:
    """Report items as rows and wafers as columns, in ascending wafer order."""
    cells = [F.max(F.when(F.col("wafer_id") == w, F.col("pass_rate"))).alias(f"wafer_{w}") for w in sorted(wafers)]
    return rates.groupBy(*REPORT, "item").agg(*cells)


def band_counts(rates: DataFrame) -> DataFrame:
    return rates.withColumn("band", S.score_band("pass_rate")).groupBy("vehicle", "step_id", "item", "band").agg(
        F.count("*").alias("n")
    )


def board_order(rates: DataFrame, target: str) -> DataFrame:
    """Target lot first, other lots by name, wafers ascending."""
    cols = rates.select("lot_id", "wafer_id").distinct().withColumn("_other", (F.col("lot_id") != target).cast("int"))
    order = ["_other", "lot_id", "wafer_id"]
    rows = ordered.running(cols.withColumn("_all", F.lit(0)), ["_all"], order, {"position": F.lit(1)})
    return rows.drop("_all", "_other")


def test_points(shots: DataFrame) -> DataFrame:
    """Points per (lot, wafer, time), on every shot; counted before the join back."""
    keys = ["lot_id", "wafer_id", "tkout_time"]
    return shots.join(shots.groupBy(*keys).agg(F.count("*").alias("points")), keys)


def repeat_numbers(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number each distinct test time within its group, earliest first."""
    distinct = tests.select(*keys, "tkout_time").distinct()
    return ordered.running(distinct, keys, ["tkout_time"], {"dup_no": F.lit(1)})


def test_labels(shots: DataFrame) -> DataFrame:
    """Cleaned program label of every test: step, points, repeat number above one."""
    keys = ["lot_id", "wafer_id", "step_id", "points"]
    tests = test_points(shots).select("vehicle", *keys, "tkout_time").distinct()
    rows = tests.join(repeat_numbers(tests, keys), [*keys, "tkout_time"])
    label = S.clean_label(S.program_label("step_id", "points", "dup_no"))
    return rows.select(*WAFER, "tkout_time", label.alias("label"))


def out_programs(out: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct program labels of the out-of-spec points of a report item."""
    seen = out.select(*WAFER, "item", "tkout_time").distinct().join(labels, [*WAFER, "tkout_time"])
    return seen.groupBy(*REPORT, "item").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def report_gate(points: DataFrame, items: DataFrame) -> DataFrame:
    """Reports with at least one device value."""
    device = items.where(~F.upper("alias").contains("PCHK")).select(F.col("alias").alias("item"))
    return points.join(device, "item", "left_semi").groupBy(*REPORT).agg(F.count("*").alias("device_values"))


def alias_owner(columns: DataFrame, aliases: Sequence[str]) -> DataFrame:
    """Longest alias that equals a derived column or prefixes it with an underscore."""
    owner = F.lit(None).cast("string")
    for a in sorted(aliases, key=len):
        owner = F.when((F.col("item") == a) | F.col("item").startswith(f"{a}_"), F.lit(a)).otherwise(owner)
    return columns.withColumn("owner", owner)


def with_layer(shots: DataFrame, layers: DataFrame) -> DataFrame:
    """Layer of a step; the first declaration wins, an unmapped step keeps its id."""
    first = layers.groupBy("step_id").agg(F.min_by("layer", "decl_order").alias("layer"))
    return shots.join(first, "step_id", "left").withColumn("layer", F.coalesce("layer", "step_id"))


def trend_items(findings: DataFrame, metrics: DataFrame, n: int, sigma: float = 1.5) -> DataFrame:
    """Up to n items per report: rule items, then findings by rank, then worst metrics; one per category."""
    stage = F.when(F.col("type") == "DEFECT_MODE", 0).otherwise(1)
    first = findings.select(*REPORT, "item", "cat2", stage.alias("stage"), F.col("rank").cast("double").alias("o1"), F.lit(0.0).alias("o2"))
    more = metrics.where((F.col("spec_out_count") > 0) | (F.col("deviation") > sigma)).select(
        *REPORT, "item", "cat2", F.lit(2).alias("stage"), (-F.col("spec_out_count")).cast("double").alias("o1"),
        (-F.col("deviation")).alias("o2"),
    )
    order = ["stage", "o1", "o2", "item"]
    one = first.unionByName(more).withColumn("_cat", F.coalesce("cat2", F.concat(F.lit("item "), "item")))
    per_item = one.groupBy(*REPORT, "item", "_cat").agg(F.min(F.struct(*order)).alias("s"))
    per_cat = per_item.groupBy(*REPORT, "_cat").agg(F.min("s").alias("s")).select(*REPORT, "s.*")
    w = W.partitionBy(*REPORT).orderBy(*order)
    return per_cat.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select(
        *REPORT, "item", "stage", "position"
    )


def map_selection(tests: DataFrame, cap: int) -> DataFrame:
    """Maps per report item: all its own tests, then the newest tests of other lots up to the cap.

    Whatever the report, the others come from the cap newest tests of the
    product item, so only those are joined.
    """
    key = ["vehicle", "item"]
    newest = W.partitionBy(*key).orderBy(F.desc("tkout_time"), "step_id", "lot_id", "wafer_id")
    own = tests.groupBy(*REPORT, "item").agg(F.count("*").alias("n_own"))
    recent = tests.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap)
    recent = recent.select(
        *key, F.col("step_id").alias("map_step"), F.col("lot_id").alias("map_lot"),
        F.col("wafer_id").alias("map_wafer"), F.col("tkout_time").alias("map_time"),
    )
    other = own.where(F.col("n_own") < cap).join(recent, key).where(
        (F.col("map_lot") != F.col("lot_id")) | (F.col("map_step") != F.col("step_id"))
    )
    w = W.partitionBy(*REPORT, "item").orderBy(F.desc("map_time"), "map_step", "map_lot", "map_wafer")
    other = other.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap - F.col("n_own"))
    cols = [*REPORT, "item", "map_step", "map_lot", "map_wafer", "map_time"]
    mine = tests.select(
        *REPORT, "item", F.col("step_id").alias("map_step"), F.col("lot_id").alias("map_lot"),
        F.col("wafer_id").alias("map_wafer"), F.col("tkout_time").alias("map_time"),
    )
    return mine.select(*cols, F.lit(True).alias("own")).unionByName(other.select(*cols, F.lit(False).alias("own")))
