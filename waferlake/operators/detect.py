"""Wafer statistics against the product, and the findings they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import ordered, robust, runs
from waferlake.functions import scalars as S
from waferlake.schema import PRODUCT, REPORT, WAFER, Limits
from waferlake.session import staged

WAFER_ITEM = [*WAFER, "item"]
REPORT_ITEM = [*REPORT, "item"]
PRODUCT_ITEM = [*PRODUCT, "item"]


def wafer_stats(points: DataFrame) -> DataFrame:
    """Robust statistics of every (report, wafer, item), with the sorted values where they fit an array."""
    return robust.profile(points, WAFER_ITEM, "value", values=True)


def wafer_stats_wide(shots: DataFrame, items) -> DataFrame:
    """The same from wide shots, without a row per value."""
    return robust.profile_wide(shots, WAFER, items, values=True)


def product_baseline(wafers: DataFrame) -> DataFrame:
    """Per product item: centre and scatter of wafer medians, typical wafer spread. The wafers are read more than once and should be stored."""
    stats = wafers.select(*PRODUCT, F.col("item").alias("_of"), "median", F.when(F.col("spread") > 0, F.col("spread")).alias("spread"))
    per = robust.profile_wide(stats, [*PRODUCT, "_of"], ["median", "spread"]).withColumnsRenamed({"item": "stat", "_of": "item"})
    return per.groupBy(*PRODUCT_ITEM).agg(
        F.max(F.when(F.col("stat") == "median", F.col("median"))).alias("center"),
        F.max(F.when(F.col("stat") == "median", F.col("spread"))).alias("scatter"),
        F.max(F.when(F.col("stat") == "spread", F.col("median"))).alias("typical"),
    )


def population_stats(points: DataFrame) -> DataFrame:
    """Median and robust spread over every chip of the product."""
    per = robust.profile(points, PRODUCT_ITEM, "value")
    return per.select(*PRODUCT_ITEM, F.col("median").alias("pop_median"), F.col("spread").alias("pop_spread"))


def _is_flier(dev: Column, direc: Column, lim: Limits) -> Column:
    k, far = F.lit(lim.flier_sigma), F.lit(lim.flier_sigma * lim.flier_off_direction)
    return (
        F.when(direc == "UPPER", (dev > k) | (dev < -far))
        .when(direc == "LOWER", (dev < -k) | (dev > far))
        .otherwise(F.abs(dev) > k)
    )


def score_wafers(
    wafers: DataFrame, baseline: DataFrame, items: DataFrame, points: DataFrame, lim: Limits, whole: bool = False
) -> DataFrame:
    """Each wafer item scored against its product: counts out of spec, shift, dispersion, fliers.

    Only the wafers whose extremes can be out of spec or hold a flier are looked
    at value by value: in their arrays, or, where they are too large for one,
    among the points again. ``whole`` says that every wafer has its array.
    """
    spec = items.select(
        F.col("alias").alias("item"), "spec_low", "spec_high", "report_order", "cat2",
        S.direction("direction").alias("direction"),
    )
    out = wafers.join(spec, "item", "left")
    out = out.withColumn("direction", F.coalesce("direction", F.lit("BOTH")))
    lo, hi = F.col("spec_low"), F.col("spec_high")
    if lim.direction_aware:
        lo, hi = S.effective_bounds(lo, hi, F.col("direction"))
        out = out.withColumn("spec_low", lo).withColumn("spec_high", hi)
        lo, hi = F.col("spec_low"), F.col("spec_high")

    d = F.col("direction")
    dev = lambda v: (S.col(v) - F.col("median")) / F.col("typical")
    # a few rows whose size is known once stored: else the wafers with all their values are dealt by product for the join
    baseline = staged(baseline, "baseline")
    out = ordered.joined(out, baseline, PRODUCT_ITEM, "left")
    # the extremes say whether a test on single points can hit at all
    maybe = F.col("typical").isNotNull() & (_is_flier(dev("v_max"), d, lim) | _is_flier(dev("v_min"), d, lim))
    outside = S.below("v_min", lo) | S.above("v_max", hi)
    out = out.withColumn("_ask", F.coalesce(maybe, F.lit(False)) | F.coalesce(outside, F.lit(False)))
    tests = {
        "n_below": lambda v: S.below(v, "spec_low"),
        "n_above": lambda v: S.above(v, "spec_high"),
        "n_flier": lambda v: F.coalesce(_is_flier(dev(v), d, lim), F.lit(False)),
    }
    if "values" not in out.columns:
        out = out.withColumn("values", F.lit(None).cast("array<double>"))
    count = lambda test: F.when(~F.col("_ask"), 0).when(F.col("values").isNotNull(), F.size(F.filter("values", test))).cast("long")
    counted = out.withColumns({name: count(test) for name, test in tests.items()})
    asks = out.where("_ask AND values IS NULL").select(*WAFER_ITEM, "median", "typical", "spec_low", "spec_high", "direction")
    ask = None if whole else staged(asks, "asked")
    if ask is not None and not ask.isEmpty():
        tested = ordered.joined(points, ask, WAFER_ITEM).groupBy(*WAFER_ITEM).agg(
            *[F.count_if(test(F.col("value"))).alias(f"_{name}") for name, test in tests.items()]
        )
        counted = ordered.joined(counted, tested, WAFER_ITEM, "left")
        counted = counted.withColumns({name: F.coalesce(name, f"_{name}") for name in tests})
    out = counted.fillna(0, list(tests))

    up, down = (F.col("v_max") - F.col("median")), (F.col("median") - F.col("v_min"))
    widest = F.greatest(up, down)
    flier_dev = (
        F.when(F.col("direction") == "UPPER", F.when(up > 0, up).otherwise(widest))
        .when(F.col("direction") == "LOWER", F.when(down > 0, down).otherwise(widest))
        .otherwise(widest)
        / F.col("typical")
    )
    aggregated = F.col("item").isin(*lim.aggregated) if lim.aggregated else F.lit(False)
    enough = (F.col("n") >= lim.min_wafer_points) & ~aggregated & F.lit(lim.flier_sigma > 0)
    hit = enough & (F.col("n_flier") >= 1)
    if lim.flier_max_points > 0:
        hit = hit & (F.col("n_flier") <= lim.flier_max_points)
    return out.select(
        *WAFER_ITEM, "n", "median", "std", "spread", "v_min", "v_max", "center", "scatter", "typical",
        "spec_low", "spec_high", "direction", "report_order", "cat2", "n_below", "n_above",
        (F.col("n_below") + F.col("n_above")).alias("n_out"),
        F.when(F.col("scatter") > 0, F.abs(F.col("median") - F.col("center")) / F.col("scatter")).alias("shift"),
        F.when(~aggregated & (F.col("typical") > 0), F.col("spread") / F.col("typical")).alias("ratio"),
        F.when(hit, F.col("n_flier")).alias("flier_count"),
        F.when(hit, flier_dev).alias("flier_dev"),
    )


def _worst(x: str, pick: str | None = None) -> Column:
    """Wafer (or another column of it) with the largest x; ties go to the lowest wafer."""
    pick = pick or "wafer_id"
    rank = F.struct(F.col(x), -F.col("wafer_id"))
    return F.max_by(F.when(F.col(x) > 0, F.col(pick)), F.when(F.col(x) > 0, rank))


def item_stats(scored: DataFrame, lim: Limits) -> DataFrame:
    """One row per (report, item): the worst wafers, representative values and severity."""
    out_ratio = F.col("n_out") / F.col("n")
    agg = scored.groupBy(*REPORT_ITEM).agg(
        F.sum("n").alias("n"),
        F.sum("n_out").alias("n_out"),
        F.sum("n_below").alias("n_below"),
        F.sum("n_above").alias("n_above"),
        F.max(out_ratio).alias("max_ratio"),
        F.count_if(F.col("n_out") > 0).alias("out_wafers"),
        F.coalesce(F.max("shift"), F.lit(0.0)).alias("shift"),
        _worst("shift").alias("shift_wafer"),
        F.coalesce(F.max("ratio"), F.lit(0.0)).alias("disp_ratio"),
        _worst("ratio").alias("disp_wafer"),
        F.coalesce(F.max("flier_dev"), F.lit(0.0)).alias("flier_dev"),
        _worst("flier_dev").alias("flier_wafer"),
        F.coalesce(_worst("flier_dev", "flier_count"), F.lit(0)).alias("flier_count"),
        F.median("median").alias("rep_median"),
        F.median("std").alias("rep_std"),
        F.median("spread").alias("rep_spread"),
        # equal on all wafers of an item
        F.max("center").alias("center"),
        F.max("scatter").alias("scatter"),
        F.max("typical").alias("typical"),
        F.max("spec_low").alias("spec_low"),
        F.max("spec_high").alias("spec_high"),
        F.max("direction").alias("direction"),
        F.max("report_order").alias("report_order"),
        F.max("cat2").alias("cat2"),
        F.max("v_min").alias("top_v_min"),
    ).drop("top_v_min")
    if lim.aggregated:
        kept = ~F.col("item").isin(*lim.aggregated)
        agg = agg.withColumn("rep_spread", F.when(kept, F.col("rep_spread")))
    agg = agg.withColumn(
        "rstd_ratio",
        F.when(F.col("typical") > 0, F.coalesce(F.col("rep_spread") / F.col("typical"), F.lit(0.0))).otherwise(0.0),
    )
    return with_severity(agg, lim)


def is_check(item, cat2) -> Column:
    """Check items verify the measurement itself rather than the device."""
    return (F.coalesce(F.upper(S.col(cat2)), F.lit("")) == "PCHK") | F.upper(S.col(item)).contains("PCHK")


def dispersion_gate(lim: Limits) -> Column:
    """The widest wafer must reach a given share of a two-sided spec."""
    two_sided = F.coalesce(F.col("spec_high") > F.col("spec_low"), F.lit(False)) & (
        F.coalesce("typical", F.lit(0.0)) > 0
    ) & (F.col("disp_ratio") > 0)
    wide = F.col("disp_ratio") * F.col("typical") >= F.lit(lim.dispersion_spec_fraction) * (
        F.col("spec_high") - F.col("spec_low")
    )
    return F.when(two_sided & F.lit(lim.dispersion_spec_fraction > 0), wide).otherwise(True)


def with_severity(stats: DataFrame, lim: Limits) -> DataFrame:
    excluded = S.wildcard("item", lim.exclude)
    check = is_check("item", "cat2")
    stats = stats.where(~excluded | check)
    quiet = excluded & check
    gate = dispersion_gate(lim)
    warn = F.col("flier_wafer").isNotNull() | ((F.col("disp_ratio") > lim.dispersion_ratio) & gate)
    severity = (
        F.when((F.col("n_out") > 0) & quiet, "NOTICE")
        .when(F.col("n_out") > 0, "CRITICAL")
        .when(warn & ~quiet, "WARNING")
        .otherwise("INFO")
    )
    return stats.select(
        "*",
        check.alias("is_check"),
        quiet.alias("quiet"),
        gate.alias("gate_ok"),
        severity.alias("severity"),
        F.when(severity == "CRITICAL", 2).when(severity == "WARNING", 1).otherwise(0).alias("level"),
    )


def out_text(scored: DataFrame) -> DataFrame:
    """Per (report, item): wafers grouped by (measured, out) as text."""
    hit = scored.where("n_out > 0")
    groups = hit.groupBy(*REPORT_ITEM, "n", "n_out").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("wafer_id")), lambda w: F.concat(F.lit("#"), w)), ", ").alias("ws")
    )
    parts = groups.groupBy(*REPORT_ITEM).agg(F.array_sort(F.collect_list(F.struct("n", "n_out", "ws"))).alias("g"))
    return parts.select(
        *REPORT_ITEM,
        F.array_join(
            F.transform("g", lambda g: F.concat(g["n"], F.lit("pt, "), g["n_out"], F.lit("pt out: "), g["ws"])), " / "
        ).alias("out_text"),
    )


def side_text(low, high, n_below, n_above) -> Column:
    return (
        F.when((F.col(n_below) > 0) & (F.col(n_above) > 0), "outside spec range")
        .when(F.col(n_below) > 0, "below lower spec")
        .when(F.col(n_above) > 0, "above upper spec")
        .otherwise("outside spec")
    )


def findings(stats: DataFrame, lim: Limits) -> DataFrame:
    """At most one built-in finding per (report, item): out of spec, else flier, else dispersion."""
    kind = (
        F.when((F.col("n_out") > 0) & F.col("quiet"), "MEAS_SUSPECT")
        .when(F.col("n_out") > 0, "SPEC_OUT")
        .when(F.col("quiet"), None)
        .when(F.col("flier_wafer").isNotNull(), "FLIER")
        .when((F.col("disp_ratio") > lim.dispersion_ratio) & F.col("gate_ok"), "DISPERSION")
    )
    worst = F.when(kind == "FLIER", F.col("flier_wafer")).when(kind == "DISPERSION", F.col("disp_wafer"))
    return stats.withColumn("type", kind).where(F.col("type").isNotNull()).select(
        *REPORT_ITEM, "severity", "type", worst.alias("worst_wafer"), "n_out", "max_ratio", "out_wafers",
        "flier_count", "flier_dev", "disp_ratio", "report_order", "cat2",
        F.when(
            F.col("type").isin("SPEC_OUT", "MEAS_SUSPECT"), side_text("spec_low", "spec_high", "n_below", "n_above")
        ).alias("side"),
        F.lit(None).cast("int").alias("rule_rank"),
    )


def target_percentile(points: DataFrame) -> DataFrame:
    """Median of each report item and its percentile in the product population. The points should be stored."""
    return _placed(points, ordered.quantiles(points, REPORT_ITEM, "value", {"target_median": 0.5}))


def target_percentile_wide(shots: DataFrame, items) -> DataFrame:
    """The same from wide shots, which should be stored."""
    points = shots.unpivot(REPORT, list(items), "item", "value")
    return _placed(points, ordered.quantiles_wide(shots, REPORT, items, {"target_median": 0.5}), (shots, items))


def target_percentile_packed(shots: DataFrame, together: DataFrame, rest: DataFrame | None, items) -> DataFrame:
    """The same where the shots of a report stand together in ``together``; ``rest`` are those of reports too large for it."""
    probs = {"target_median": 0.5}
    medians = runs.quantile(together, REPORT, items, probs)
    if rest is not None:
        medians = medians.unionByName(ordered.quantiles_wide(rest, REPORT, list(items), probs))
    return _placed(shots.unpivot(REPORT, list(items), "item", "value"), medians, (shots, list(items)))


def _placed(points: DataFrame, medians: DataFrame, wide=None) -> DataFrame:
    med = staged(medians, "medians")
    share = ordered.share_below(points, med, PRODUCT_ITEM, "value", "target_median", wide)
    return med.join(share, [*PRODUCT_ITEM, "target_median"])
