"""Data sets behind the charts; nothing is drawn."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waferlake.functions import linear, ordered, runs
from waferlake.functions import scalars as S
from waferlake.operators.detect import REPORT_ITEM, WAFER_ITEM
from waferlake.schema import PRODUCT, WAFER
from waferlake.session import staged

# fixed values
WAFER_RADIUS_MM = 150.0
MIN_CIRCLE_SITES = 6
MAX_ASPECT = 10.0


def daily_band(points: DataFrame, time: str = "tkout_time") -> DataFrame:
    """P1, median and P99 per vehicle, item and day."""
    rows = points.withColumn("day", F.to_date(time))
    return ordered.quantiles(rows, ["vehicle", "item", "day"], "value", {"p1": 0.01, "med": 0.5, "p99": 0.99})


def rolling_band(daily: DataFrame, days: int = 3) -> DataFrame:
    """Mean of the band over the last calendar days; one row per day goes in."""
    w = W.partitionBy("vehicle", "item").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select("vehicle", "item", "day", *[F.avg(c).over(w).alias(f"{c}_roll") for c in ("p1", "med", "p99")])


def box_numbers(points: DataFrame) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and outlier count per wafer item."""
    q = ordered.quantiles(points, WAFER_ITEM, "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    whiskers = points.join(q, WAFER_ITEM).groupBy(*WAFER_ITEM).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    return q.join(whiskers, WAFER_ITEM)


def empirical_cdf(points: DataFrame, tie: list[str]) -> DataFrame:
    """Share of smaller ranks per wafer item: rank/(n-1), one for a single point."""
    n = points.groupBy(*WAFER_ITEM).agg(F.count("*").alias("n"))
    pos = ordered.running(points, WAFER_ITEM, ["value", *tie], {"pos": F.lit(1)})
    return pos.join(n, WAFER_ITEM).withColumn(
        "p", F.when(F.col("n") == 1, 1.0).otherwise((F.col("pos") - 1) / (F.col("n") - 1))
    )


def colour_anchors(points: DataFrame, items: DataFrame) -> DataFrame:
    """Low, middle and high end of a map's colour scale per product item.

    Spec ends if both count; a single end is mirrored around the median; without
    a spec the 1st and 99th percentile.
    """
    q = ordered.quantiles(points, [*PRODUCT, "item"], "value", {"p1": 0.01, "mid": 0.5, "p99": 0.99})
    dims = items.select(F.col("alias").alias("item"), "spec_low", "spec_high", S.direction("direction").alias("d"))
    lo, hi = S.effective_bounds("spec_low", "spec_high", "d")
    rows = q.join(dims, "item").withColumn("_lo", lo).withColumn("_hi", hi)
    mid = F.col("mid")
    low = F.coalesce("_lo", 2 * mid - F.col("_hi"), "p1")
    high = F.coalesce("_hi", 2 * mid - F.col("_lo"), "p99")
    return rows.select(*PRODUCT, "item", low.alias("low"), mid, high.alias("high"))


def trend_range(points: DataFrame, items: DataFrame) -> DataFrame:
    """Axis range of a trend: target values and spec, widened by eight percent."""
    dims = items.select(F.col("alias").alias("item"), "spec_low", "spec_high", S.direction("direction").alias("d"))
    lo, hi = S.effective_bounds("spec_low", "spec_high", "d")
    agg = points.groupBy(*REPORT_ITEM).agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    rows = agg.join(dims, "item").withColumn("lo", F.least("mn", lo)).withColumn("hi", F.greatest("mx", hi))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.08).otherwise(F.abs(F.col("hi")) * 0.08)
    return rows.select(*REPORT_ITEM, (F.col("lo") - pad).alias("y_low"), (F.col("hi") + pad).alias("y_high"))


def trend_classes(points: DataFrame, vehicle: str, lot: str, root: str) -> DataFrame:
    """Class of each point seen from one report: target lot, sibling, other lot, other vehicle."""
    cls = (
        F.when(F.col("vehicle") != vehicle, "with vehicle")
        .when(F.col("lot_id") == lot, "target")
        .when(F.col("root_lot_id") == root, "sibling")
        .otherwise("other")
    )
    return points.withColumn("class", cls)


def radial_fits(points: DataFrame, layout: DataFrame, min_points: int = 4) -> DataFrame:
    """Cubic of value over radius per wafer item, from power sums.

    Radius is standardised by its mean and population deviation. The moments
    are ordinary sums, so a large wafer is combined before the shuffle; each
    row then holds one small linear system, solved as column expressions. The
    points are read twice and should be stored.
    """
    dim = layout.select(F.col("mask").alias("vehicle"), "chip_x", "chip_y", F.col("chip_radius").alias("r"))
    rows = points.join(dim, ["vehicle", "chip_x", "chip_y"]).select(*WAFER_ITEM, "r", "value")
    facts = {"n": F.count("*"), "mu": F.avg("r"), "sd": F.stddev_pop("r")}
    aggs = [c.alias(n) for n, c in facts.items()]
    large = ordered.large_groups(rows, WAFER_ITEM)
    small = rows if large is None else ordered.joined(rows, large, WAFER_ITEM, "left_anti")
    # points travel once, to where their wafer's scale is known too
    packed = small.groupBy(*WAFER_ITEM).agg(*aggs, F.collect_list(F.struct("r", "value")).alias("_p"))
    packed = packed.withColumn("nr", F.size(F.array_distinct(F.filter(F.transform("_p", lambda p: p["r"]), lambda r: r.isNotNull()))))
    fits = (F.col("n") >= min_points) & (F.col("sd") > 0) & (F.col("nr") >= 4)
    z = packed.where(fits).select(*WAFER_ITEM, "n", "mu", "sd", F.inline("_p"))
    if large is not None:
        rest = ordered.joined(rows, large, WAFER_ITEM, "left_semi")
        scale = rest.groupBy(*WAFER_ITEM).agg(*aggs, F.count_distinct("r").alias("nr")).where(fits)
        z = z.unionByName(rest.join(scale.drop("nr"), WAFER_ITEM).select(z.columns))
    z = z.withColumn("z", (F.col("r") - F.col("mu")) / F.col("sd"))
    powers = [F.pow("z", F.lit(float(k))) for k in range(4)]
    sums = z.groupBy(*WAFER_ITEM, "n", "mu", "sd").agg(*linear.moments(powers, F.col("value")))
    return linear.solved(sums, 4, ["c0", "c1", "c2", "c3"])


def radial_fits_met(shots: DataFrame, items: Sequence[str], layout: DataFrame, min_points: int = 4) -> DataFrame:
    """The same from wide shots that meet in the task of their wafer: they are put in order of the radius there, and the power
    sums of all items of a wafer are made in one pass, so no shot travels again. A wafer must fit an array."""
    dim = staged(layout.select(F.col("mask").alias("vehicle"), "chip_x", "chip_y", F.col("chip_radius").cast("double").alias("_r")), "layout")
    rows = shots.join(dim, ["vehicle", "chip_x", "chip_y"]).select(*WAFER, "_r", *[F.col(i).cast("double").alias(f"_x{k}") for k, i in enumerate(items)])
    if "BroadcastHashJoin" not in rows._jdf.queryExecution().sparkPlan().toString():
        # the layout is too large to be sent to the shots, so the join deals them anew
        rows = rows.repartition(*WAFER)
    rows = rows.sortWithinPartitions(*WAFER, "_r")
    keys, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shots.select(*WAFER).schema), list(items)
    sums = rows.mapInArrow(
        lambda batches: runs.each_item(batches, WAFER, names, _power_sums(min_points)), f"{keys}, item string, n long, {', '.join(f'{c} double' for c in RADIAL_SUMS)}")
    return linear.solved(sums, 4, ["c0", "c1", "c2", "c3"])


RADIAL_SUMS = [f"_m{i}{j}" for i in range(4) for j in range(i, 4)] + [f"_v{i}" for i in range(4)]


def _power_sums(min_points: int):
    """Of shots in order of wafer and radius."""

    def own(item, table, rows, value, start, n):
        r, has = table.column("_r").to_numpy()[rows], table.column("_r").is_valid().to_numpy()[rows]
        count = np.add.reduceat(has.astype(float), start)
        mean = np.add.reduceat(np.where(has, r, 0.0), start) / count
        off = np.where(has, r - np.repeat(mean, n), 0.0)
        scale = np.sqrt(np.add.reduceat(off * off, start) / count)
        new = np.r_[True, r[1:] != r[:-1]]
        new[start] = True
        fits = (n >= min_points) & (scale > 0) & (np.add.reduceat((new & has).astype(np.int64), start) >= 4)
        z, power, value = off / np.repeat(scale, n), has.astype(float), np.where(has, value, 0.0)
        moment, right = [], []
        for degree in range(7):
            moment.append(np.add.reduceat(power, start))
            if degree < 4:
                right.append(np.add.reduceat(power * value, start))
            power = power * z
        sums = [moment[i + j] for i in range(4) for j in range(i, 4)] + right
        return {"n": n.astype(np.int64), **dict(zip(RADIAL_SUMS, sums)), None: fits}

    return own


def wafer_circle(layout: DataFrame) -> DataFrame:
    """Centre, chip pitch and semi-axes of the wafer on the chip grid, per vehicle.

    The squared radius of a site is a quadratic of its grid place, each axis
    with its own pitch and none mixed: five coefficients by least squares over
    the distinct sites, places counted from the mean site. A vehicle without a
    radius for every site, or with a fit that no wafer can have, gets a circle
    around the mean site, five percent wider than the farthest one.
    """
    placed = layout.where(F.col("chip_x").isNotNull() & F.col("chip_y").isNotNull())
    sites = placed.groupBy("mask", "chip_x", "chip_y").agg(F.median("chip_radius").alias("r"))
    middle = sites.groupBy("mask").agg(F.avg("chip_x").alias("mx"), F.avg("chip_y").alias("my"))
    sites = sites.join(middle, "mask").withColumns({"u": F.col("chip_x") - F.col("mx"), "v": F.col("chip_y") - F.col("my")})
    u, v, square = F.col("u"), F.col("v"), F.col("r") * F.col("r")
    sums = sites.groupBy("mask", "mx", "my").agg(
        (F.count("r") == F.count("*")).alias("every"), F.count("*").alias("n"), F.stddev_pop("r").alias("scatter"),
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.max(F.hypot(u, v)).alias("far"),
        *linear.moments([u * u, v * v, u, v, F.lit(1.0)], square),
    )
    fit = linear.solved(sums, 5, ["quad_u", "quad_v", "lin_u", "lin_v", "const"])
    bowl = F.col("every") & (F.col("n") >= MIN_CIRCLE_SITES) & (F.col("scatter") > 1e-9) & (F.col("quad_u") > 0) & (F.col("quad_v") > 0)
    for axis in "uv":
        quad, lin = F.when(bowl, F.col(f"quad_{axis}")), F.col(f"lin_{axis}")
        fit = fit.withColumns({f"at_{axis}": -lin / (2 * quad), f"pitch_{axis}": F.sqrt(quad), f"semi_{axis}": WAFER_RADIUS_MM / F.sqrt(quad)})
    aspect = F.col("pitch_v") / F.col("pitch_u")
    fair = aspect.between(1 / MAX_ASPECT, MAX_ASPECT)
    for axis in "uv":
        # the sites may not reach twice as far as the wafer
        reach = F.greatest(F.abs(F.col(f"{axis}0") - F.col(f"at_{axis}")), F.abs(F.col(f"{axis}1") - F.col(f"at_{axis}")))
        fair = fair & (reach <= 2 * F.col(f"semi_{axis}"))
    fit = fit.withColumn("fitted", F.coalesce(fair, F.lit(False)))
    pick = lambda good, plain: F.when(F.col("fitted"), good).otherwise(plain)
    around = F.col("far") * 1.05
    return fit.select(
        "mask", (F.col("mx") + pick(F.col("at_u"), 0.0)).alias("cx"), (F.col("my") + pick(F.col("at_v"), 0.0)).alias("cy"),
        F.when(F.col("fitted"), F.col("pitch_u")).alias("pitch_x"), F.when(F.col("fitted"), F.col("pitch_v")).alias("pitch_y"),
        pick(F.col("semi_u"), around).alias("semi_x"), pick(F.col("semi_v"), around).alias("semi_y"),
        pick(aspect, F.lit(1.0)).alias("aspect"), "fitted",
    )


def site_pitch(layout: DataFrame) -> DataFrame:
    """Median positive gap of the distinct x and y coordinates per vehicle."""
    axes = layout.unpivot(["mask"], ["chip_x", "chip_y"], "axis", "at").distinct()
    # distinct grid coordinates of one vehicle: at most as many as chips in a row
    gap = F.col("at") - F.lag("at").over(W.partitionBy("mask", "axis").orderBy("at"))
    return axes.withColumn("gap", gap).where(F.col("gap") > 0).groupBy("mask", "axis").agg(
        F.median("gap").alias("pitch")
    )


def layout_extent(layout: DataFrame) -> DataFrame:
    """Grid limits of a vehicle and half a site of padding on each side."""
    agg = layout.groupBy("mask").agg(
        F.min("chip_x").alias("x_min"), F.max("chip_x").alias("x_max"), F.count_distinct("chip_x").alias("nx"),
        F.min("chip_y").alias("y_min"), F.max("chip_y").alias("y_max"), F.count_distinct("chip_y").alias("ny"),
    )
    pad = lambda a: F.when(F.col(f"n{a}") > 1, (F.col(f"{a}_max") - F.col(f"{a}_min")) / (F.col(f"n{a}") - 1) * 0.5).otherwise(0.5)
    return agg.select("mask", "x_min", "x_max", pad("x").alias("x_pad"), "y_min", "y_max", pad("y").alias("y_pad"))
