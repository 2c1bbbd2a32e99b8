"""Where on the wafer the out-of-spec sites lie."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import scalars as S
from waferlake.operators.detect import REPORT_ITEM
from waferlake.operators.rank import top_k
from waferlake.operators.reshape import points as points_of
from waferlake.schema import SITE, WAFER, Item, Limits, item_frame


@dataclass(frozen=True)
class Pattern:
    """A shape to look for; the first one that passes names the pattern."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)


# fixed default thresholds of the nine shapes
DEFAULT_PATTERNS = (
    Pattern("whole wafer", "global", {"min_share": 0.5}),
    Pattern("vertical line", "line", {"axis": "x", "max_lanes": 2, "min_pts": 4}),
    Pattern("horizontal line", "line", {"axis": "y", "max_lanes": 2, "min_pts": 4}),
    Pattern("center", "radius_band", {"r_min": 0.0, "r_max": 0.45, "cover": 0.7}),
    Pattern("edge ring", "radius_band", {"r_min": 0.85, "r_max": 1.01, "cover": 0.7}),
    Pattern("middle ring", "radius_band", {"r_min": 0.45, "r_max": 0.85, "cover": 0.7}),
    Pattern("clock", "clock", {"min_rnorm": 0.4, "resultant": 0.92, "min_frac": 0.75}),
    Pattern("quadrant", "quadrant", {"cover": 0.7}),
    Pattern("half", "half", {"cover": 0.75}),
)
MIN_SITES = 3


def out_points(points: DataFrame, items: DataFrame) -> DataFrame:
    """Points outside their spec. Few of all, so what follows works on little data."""
    spec = items.select(F.col("alias").alias("item"), "spec_low", "spec_high")
    return points.join(spec, "item").where(S.spec_out("value", "spec_low", "spec_high")).drop("spec_low", "spec_high")


def out_points_wide(shots: DataFrame, items: Sequence[Item]) -> DataFrame:
    """The same from wide shots: only those with an item outside its spec become points."""
    checked = [i for i in items if i.spec_low is not None or i.spec_high is not None]
    out = [S.spec_out(i.alias, F.lit(i.spec_low).cast("double"), F.lit(i.spec_high).cast("double")) for i in checked]
    some = shots.where(reduce(Column.__or__, out, F.lit(False)))
    return out_points(points_of(some, [i.alias for i in checked] or [i.alias for i in items], [*WAFER, *SITE]), item_frame(shots.sparkSession, items))


def radius_map(shots: DataFrame) -> DataFrame:
    """Mean radius per site of a vehicle."""
    return shots.groupBy("vehicle", "chip_x", "chip_y").agg(F.avg("chip_radius").alias("radius"))


def zone_counts(out: DataFrame, radius: DataFrame, lim: Limits) -> DataFrame:
    """Out points per (report, item, zone)."""
    placed = out.join(radius, ["vehicle", "chip_x", "chip_y"]).withColumn(
        "zone", S.zone("radius", lim.zone_center, lim.zone_middle)
    )
    return placed.groupBy(*REPORT_ITEM, "zone").agg(F.count("*").alias("n"))


def out_sites(out: DataFrame) -> DataFrame:
    """Distinct out sites per (report, item) with points and wafers on each."""
    per_wafer = out.groupBy(*REPORT_ITEM, "chip_x", "chip_y", "wafer_id").agg(F.count("*").alias("c"))
    return per_wafer.groupBy(*REPORT_ITEM, "chip_x", "chip_y").agg(
        F.sum("c").alias("points"), F.count("*").alias("wafers")
    )


def out_wafers(out: DataFrame) -> DataFrame:
    per_wafer = out.groupBy(*REPORT_ITEM, "wafer_id").agg(F.count("*").alias("c"))
    return per_wafer.groupBy(*REPORT_ITEM).agg(F.sum("c").alias("n_points"), F.count("*").alias("n_wafers"))


def site_frame(radius: DataFrame) -> DataFrame:
    """Centre, count and largest radius of all sites of a vehicle."""
    return radius.groupBy("vehicle").agg(
        F.avg("chip_x").alias("cx"), F.avg("chip_y").alias("cy"), F.count("*").alias("n_all"),
        F.max("radius").alias("r_max"),
    )


def _rate(test: Column) -> Column:
    return F.avg(test.cast("double"))


def shape_metrics(sites: DataFrame, radius: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> DataFrame:
    """One row per (report, item): every shape's metric and whether it passes."""
    placed = (
        sites.join(radius, ["vehicle", "chip_x", "chip_y"])
        .join(site_frame(radius), "vehicle")
        .withColumn("dx", F.col("chip_x") - F.col("cx"))
        .withColumn("dy", F.col("chip_y") - F.col("cy"))
        .withColumn("rn", F.col("radius") / F.col("r_max"))
        .withColumn("d", F.hypot("dx", "dy"))
    )
    right, up = F.col("dx") >= 0, F.col("dy") >= 0
    aggs: dict[str, Column] = {
        "n_sites": F.count("*"),
        "share": F.round(F.count("*") / F.max("n_all"), 3),
        "q_ur": _rate(right & up),
        "q_ul": _rate(~right & up),
        "q_ll": _rate(~right & ~up),
        "q_lr": _rate(right & ~up),
        "lanes_x": F.count_distinct("chip_x"),
        "lanes_y": F.count_distinct("chip_y"),
    }
    for i, p in enumerate(patterns):
        if p.kind == "radius_band":
            inside = (F.col("rn") >= p.params["r_min"]) & (F.col("rn") < p.params["r_max"])
            aggs[f"m{i}"] = F.round(_rate(inside), 3)
        elif p.kind == "clock":
            far = (F.col("rn") >= p.params["min_rnorm"]) & (F.col("d") > 0)
            aggs[f"far{i}"] = F.count_if(far)
            aggs[f"ux{i}"] = F.avg(F.when(far, F.col("dx") / F.col("d")))
            aggs[f"uy{i}"] = F.avg(F.when(far, F.col("dy") / F.col("d")))
    agg = placed.groupBy(*REPORT_ITEM).agg(*[c.alias(n) for n, c in aggs.items()])
    n = F.col("n_sites")
    quad = F.greatest("q_ur", "q_ul", "q_ll", "q_lr")
    half = F.greatest(
        F.col("q_ur") + F.col("q_ul"), F.col("q_ll") + F.col("q_lr"),
        F.col("q_ur") + F.col("q_lr"), F.col("q_ul") + F.col("q_ll"),
    )
    cols = []
    for i, p in enumerate(patterns):
        q = p.params
        if p.kind == "global":
            metric = F.col("share")
            passed = metric >= q["min_share"]
        elif p.kind == "line":
            metric = F.col(f"lanes_{q['axis']}").cast("double")
            passed = (n >= q["min_pts"]) & (metric <= q["max_lanes"])
        elif p.kind == "radius_band":
            metric = F.col(f"m{i}")
            passed = metric >= q["cover"]
        elif p.kind == "clock":
            enough = (F.col(f"far{i}") >= MIN_SITES) & (F.col(f"far{i}") / n >= q["min_frac"])
            metric = F.when(enough, F.round(F.hypot(f"ux{i}", f"uy{i}"), 3))
            passed = F.coalesce(metric >= q["resultant"], F.lit(False))
        elif p.kind == "quadrant":
            metric = F.round(quad, 2)
            passed = quad >= q["cover"]
        else:
            metric = F.round(half, 2)
            passed = half >= q["cover"]
        cols += [metric.alias(f"metric_{i}"), passed.alias(f"passed_{i}")]
    clock = next((i for i, p in enumerate(patterns) if p.kind == "clock"), None)
    if clock is not None:
        angle = F.pmod(F.degrees(F.atan2(f"ux{clock}", f"uy{clock}")) + 360.0, F.lit(360.0))
        hour = F.bround(angle / 30.0).cast("int") % 12
        cols.append(F.when(hour == 0, 12).otherwise(hour).alias("hour"))
    return agg.select(*REPORT_ITEM, "n_sites", *cols)


def verdict(metrics: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> DataFrame:
    """First passing shape; under three sites there is nothing to classify."""
    label = F.when(F.col("n_sites") < MIN_SITES, F.lit("few points"))
    for i, p in enumerate(patterns):
        name = F.concat(F.lit(f"{p.name} "), F.col("hour").cast("string")) if p.kind == "clock" else F.lit(p.name)
        label = label.when(F.col(f"passed_{i}"), name)
    return metrics.withColumn("pattern", label.otherwise("scattered"))


def gated(verdicts: DataFrame, wafers: DataFrame, lim: Limits) -> DataFrame:
    """No verdict when few points on few wafers are out."""
    few = (F.col("n_wafers") <= lim.gate_wafers) & (F.col("n_points") < lim.gate_points)
    out = wafers.join(verdicts, REPORT_ITEM, "left")
    return out.withColumn("pattern", F.when(~few, F.col("pattern"))).withColumn("gated", few)


def repeat_comment(sites: DataFrame, verdicts: DataFrame, lim: Limits, global_name: str = "whole wafer") -> DataFrame:
    """Sites out again and again over wafers, unless the whole wafer is out."""
    agg = sites.groupBy(*REPORT_ITEM).agg(
        F.count("*").alias("n_sites"),
        F.count_if(F.col("wafers") >= lim.repeat_min_wafers).alias("n_repeat"),
        F.avg((F.col("wafers") >= 2).cast("double")).alias("overlap"),
    )
    shown = top_k(
        sites.where(F.col("wafers") >= lim.repeat_min_wafers), REPORT_ITEM, [F.desc("wafers"), "chip_x", "chip_y"], 3
    )
    site = F.concat(F.lit("("), "chip_x", F.lit(","), "chip_y", F.lit(")x"), "wafers")
    text = shown.groupBy(*REPORT_ITEM).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", site.alias("t")))), lambda s: s["t"]), ", ").alias("top")
    )
    base = agg.join(text, REPORT_ITEM, "left").join(
        verdicts.select(*REPORT_ITEM, "pattern", "n_wafers"), REPORT_ITEM
    )
    eligible = (F.col("n_wafers") >= lim.repeat_min_wafers) & (F.coalesce("pattern", F.lit("")) != global_name)
    kind = F.when(eligible & (F.col("n_repeat") > 0), "same site").when(
        eligible & (F.col("overlap") >= lim.similar_overlap), "similar sites"
    )
    return base.select(
        *REPORT_ITEM, "n_sites", "n_repeat", "overlap", kind.alias("repeat_kind"),
        F.when(kind == "same site", F.col("top")).alias("repeat_sites"),
    )


def sample_positions(out: DataFrame, lim: Limits) -> DataFrame:
    """Up to ``sample_positions`` points per (report, item) and how many more there are."""
    total = out.groupBy(*REPORT_ITEM).agg(F.count("*").alias("total"))
    first = top_k(out, REPORT_ITEM, ["wafer_id", "chip_y", "chip_x", "tkout_time"], lim.sample_positions)
    return first.join(total, REPORT_ITEM).withColumn("rest", F.greatest(F.col("total") - lim.sample_positions, F.lit(0)))
