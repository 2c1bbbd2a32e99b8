"""Measurement order inside a wafer: runs and front/back shares of out-of-spec sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waferlake.functions import ordered
from waferlake.functions import scalars as S
from waferlake.operators.detect import REPORT_ITEM, WAFER_ITEM
from waferlake.operators.reshape import points as points_of
from waferlake.schema import REPORT, SITE, WAFER, Item, Limits, item_frame

FRONT_SHARE = 0.6
BACK_SHARE = 0.2


ORDER = ["chip_y", "chip_x", "tkout_time"]


def _flagged(points: DataFrame, items: DataFrame) -> DataFrame:
    spec = items.select(F.col("alias").alias("item"), "spec_low", "spec_high")
    flagged = points.join(spec, "item").where("spec_low IS NOT NULL OR spec_high IS NOT NULL").withColumn(
        "out", S.spec_out("value", "spec_low", "spec_high").cast("int")
    )
    return flagged.drop("spec_low", "spec_high")


def _numbered(flagged: DataFrame) -> DataFrame:
    return ordered.running(flagged, WAFER_ITEM, ORDER, {"seq_no": F.lit(1), "out_no": F.col("out")})


def measurement_order(points: DataFrame, items: DataFrame) -> DataFrame:
    """seq_no (row by row, then along the row) and out_no (running out count) per wafer item."""
    return _numbered(_flagged(points, items))


def measurement_order_met(shots: DataFrame, items: Sequence[Item]) -> DataFrame:
    """The same from wide shots that meet in the task of their wafer: a shot is put in order once with all its items, and
    becomes a row for each only in the result, so nothing travels again."""
    checked = [i for i in items if i.spec_low is not None or i.spec_high is not None]
    if not checked:
        return measurement_order(points_of(shots, [i.alias for i in items], [*WAFER, *SITE]), item_frame(shots.sparkSession, items))
    out = {i.alias: S.spec_out(i.alias, F.lit(i.spec_low).cast("double"), F.lit(i.spec_high).cast("double")).cast("int") for i in checked}
    upto = W.partitionBy(*WAFER).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    numbered = shots.select("*", *[F.count(n).over(upto).alias(f"_seq_{n}") for n in out], *[F.sum(o).over(upto).alias(f"_out_{n}") for n, o in out.items()])
    each = [
        F.struct(F.lit(n).alias("item"), F.col(n).alias("value"), o.alias("out"), F.col(f"_seq_{n}").alias("seq_no"), F.col(f"_out_{n}").alias("out_no"))
        for n, o in out.items()
    ]
    return numbered.select(*WAFER, *SITE, F.inline(F.array(*each))).where(F.col("value").isNotNull())


def wafer_sequences(points: DataFrame, items: DataFrame, lim: Limits) -> DataFrame:
    """``wafer_sequence`` of the points: wafers that fit an array are put in order there, larger ones by running sums.

    The points are read twice and should be stored.
    """
    flagged = _flagged(points, items)
    large = ordered.large_groups(flagged, WAFER_ITEM)
    small = flagged if large is None else ordered.joined(flagged, large, WAFER_ITEM, "left_anti")
    rows = small.groupBy(*WAFER_ITEM).agg(F.sort_array(F.collect_list(F.struct(*ORDER, "out"))).alias("_s"))
    out = _of_outs(rows.select(*WAFER_ITEM, F.transform("_s", lambda p: p["out"]).alias("_o")), lim)
    if large is None:
        return out
    seq = _numbered(ordered.joined(flagged, large, WAFER_ITEM, "left_semi"))
    return out.unionByName(wafer_sequence(seq, lim))


#: states of an item on a shot, two bits each: not measured, within its spec, out of it
PER_LONG = 31


def wafer_sequences_wide(shots: DataFrame, items: Sequence[Item], lim: Limits) -> DataFrame:
    """The same from wide shots: a shot travels once, with two bits for each item. The shots are read twice and should be stored."""
    checked = [i for i in items if i.spec_low is not None or i.spec_high is not None]
    dim = item_frame(shots.sparkSession, items)
    flagged = lambda part: _flagged(points_of(part, [i.alias for i in checked], [*WAFER, *SITE]), dim)
    if not checked:
        return wafer_sequences(points_of(shots, [i.alias for i in items], [*WAFER, *SITE]), dim, lim)

    def state(i: Item) -> Column:
        out = S.spec_out(i.alias, F.lit(i.spec_low).cast("double"), F.lit(i.spec_high).cast("double"))
        return F.when(F.col(i.alias).isNull(), 0).when(out, 2).otherwise(1).cast("long")

    blocks = [checked[at : at + PER_LONG] for at in range(0, len(checked), PER_LONG)]
    packed = [sum((F.shiftleft(state(i), 2 * k) for k, i in enumerate(block)), F.lit(0).cast("long")).alias(f"_b{n}") for n, block in enumerate(blocks)]
    rows = shots.select(*WAFER, *ORDER, *packed)
    large = ordered.large_groups(rows, WAFER)
    small = rows if large is None else ordered.joined(rows, large, WAFER, "left_anti")
    bits = [f"_b{n}" for n in range(len(blocks))]
    wafers = small.repartitionByRange(*WAFER).groupBy(*WAFER).agg(F.sort_array(F.collect_list(F.struct(*ORDER, *bits))).alias("_s"))

    def outs(n: int, k: int) -> Column:
        states = F.transform("_s", lambda p: F.shiftright(p[f"_b{n}"], 2 * k).bitwiseAND(F.lit(3)).cast("int"))
        return F.transform(F.filter(states, lambda s: s > 0), lambda s: s - 1)

    each = [F.struct(F.lit(i.alias).alias("item"), outs(n, k).alias("_o")) for n, block in enumerate(blocks) for k, i in enumerate(block)]
    out = _of_outs(wafers.select(*WAFER, F.inline(F.array(*each))), lim)
    if large is None:
        return out
    seq = _numbered(flagged(ordered.joined(shots, large, WAFER, "left_semi")))
    return out.unionByName(wafer_sequence(seq, lim))


def _of_outs(rows: DataFrame, lim: Limits) -> DataFrame:
    """Rows hold, in ``_o``, a 1 for each point out of spec and a 0 for any other, in measurement order."""
    rows = rows.select(*WAFER_ITEM, F.size("_o").cast("long").alias("n"), "_o").where(F.col("n") >= lim.min_wafer_points)
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, o: acc + o)
    run = F.aggregate(
        "_o", F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, o: F.struct(((acc["now"] + 1) * o).alias("now"), F.greatest(acc["best"], (acc["now"] + 1) * o).alias("best")),
        lambda acc: acc["best"],
    )
    return rows.select(
        *WAFER_ITEM, "n", run.cast("long").alias("run"), (total(F.col("_o")) / F.col("n")).alias("dead"),
        (total(F.slice("_o", 1, half)) / half).alias("front"),
        (total(F.slice("_o", half + 1, F.size("_o"))) / F.greatest(F.lit(1), F.col("n") - half)).alias("back"),
    )


def wafer_sequence(seq: DataFrame, lim: Limits) -> DataFrame:
    """Longest run, out share, and out shares of the first and second half per wafer item.

    Consecutive outs share ``seq_no - out_no``; counting per that value splits a
    large wafer over many groups before the wafer total.
    """
    n = seq.groupBy(*WAFER_ITEM).agg(F.count("*").alias("n")).where(F.col("n") >= lim.min_wafer_points)
    rows = seq.join(n, WAFER_ITEM)
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    runs = rows.groupBy(*WAFER_ITEM, "n", (F.col("seq_no") - F.col("out_no")).alias("island")).agg(
        F.sum("out").alias("run"),
        F.sum(F.when(F.col("seq_no") <= half, F.col("out"))).alias("front"),
        F.sum(F.when(F.col("seq_no") > half, F.col("out"))).alias("back"),
    )
    return runs.groupBy(*WAFER_ITEM, "n").agg(
        F.max("run").alias("run"),
        (F.sum("run") / F.col("n")).alias("dead"),
        (F.coalesce(F.sum("front"), F.lit(0)) / half).alias("front"),
        (F.coalesce(F.sum("back"), F.lit(0)) / F.greatest(F.lit(1), F.col("n") - half)).alias("back"),
    )


def item_sequence(wafers: DataFrame) -> DataFrame:
    """Over wafers: largest run, share and front; smallest back (maybe of other wafers)."""
    return wafers.groupBy(*REPORT_ITEM).agg(
        F.max("run").alias("seq_run"),
        F.max("dead").alias("seq_dead"),
        F.max("front").alias("seq_front"),
        F.min("back").alias("seq_back"),
    )


def front_heavy(front, back) -> Column:
    return (S.col(front) >= FRONT_SHARE) & (S.col(back) <= BACK_SHARE)
