"""Adapters from the driver tables to measurements, layouts and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.functions import ordered
from waferlake.functions.formulas import add_formulas
from waferlake.operators.reshape import last_values
from waferlake.schema import REPORT, SHOT_KEY, Item, item_frame
from waferlake.session import configure, dealt

LI_MEASURED = ["QTY", "PRICE", "DISC", "TAX"]
LI_ITEMS = [
    Item("REAL", "QTY", "QTY", None, None, 1.0, 1.0, 50.0, "BOTH", "A", "SIZE"),
    Item("REAL", "PRICE", "PRICE", None, None, 2.0, None, 104000.0, "UPPER", "A", "MONEY"),
    Item("REAL", "DISC", "DISC", None, None, 3.0, None, 1.0, "UPPER", "B", "RATE"),
    Item("REAL", "TAX", "TAX", None, None, 4.0, None, 1.0, "UPPER", "B", "RATE"),
    Item("ADDP", "UNIT", None, None, "{PRICE}/{QTY}", 5.0, None, 90000.0, "UPPER", "A", "MONEY"),
    Item("ADDP", "NET", None, None, "{PRICE}*(1-{DISC})", 6.0, None, None, "BOTH", "A", "MONEY"),
    Item("ADDP", "BEST", None, None, "rmax({NET},{UNIT})", 7.0, None, None, "BOTH", "A", "MONEY"),
    Item("ADDP", "PCHK_TAX", None, None, "{TAX}", None, None, 0.07, "UPPER", "C", "PCHK"),
]
LI_ALL = [i.alias for i in LI_ITEMS]

EV_ITEMS = [
    Item("REAL", name, name, None, None, float(n), None, 250.0, "UPPER", "A", "EVENT")
    for n, name in enumerate(["click", "error", "purchase", "signup", "view"], 1)
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lot_name(number: Column) -> Column:
    """Five digits at least; a longer number stays whole."""
    digits = number.cast("string")
    return F.concat(F.lit("L"), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0")))


def hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def packed_order(*fields: tuple[Column, int]) -> Column:
    """One number that orders as the fields do, first field first, NULL least.

    Each field has room for so many decimal digits, 38 in all, so nothing is cut
    or overlaps; a field that needs more fails the query. Unlike a struct, a
    number is updated in place by a hash aggregate.
    """
    if sum(digits for _, digits in fields) > 38:
        raise ValueError("no room for the fields")
    key, fits = F.lit(0).cast("decimal(38,0)"), F.lit(True)
    for field, digits in fields:
        part = F.coalesce(field + 1, F.lit(0))
        fits = fits & (part >= 0) & (part < F.lit(10**digits))
        key = (key * F.lit(10**digits).cast("decimal(38,0)") + part).cast("decimal(38,0)")
    return F.when(fits, key).otherwise(F.raise_error(F.lit("an order field passes its room")).cast("decimal(38,0)"))


def li_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the measurement names, one row per source row."""
    return _li_rows(table(spark, sf_dir, "lineitem"))


def _li_key() -> dict[str, Column]:
    """The shot key, of what lineitem holds."""
    return {
        "vehicle": F.concat(F.lit("V"), "l_linestatus"),
        "step_id": F.concat(F.lit("S"), "l_returnflag"),
        "lot_id": lot_name(F.col("l_suppkey")),
        "wafer_id": F.col("l_linenumber"),
        "chip_x": F.expr("l_partkey % 13"),
        "chip_y": F.expr("(l_partkey div 13) % 13"),
        "tkout_time": F.date_trunc("quarter", "l_shipdate"),
    }


def _li_rows(li: DataFrame) -> DataFrame:
    return li.select(
        *[c.alias(n) for n, c in _li_key().items()],
        F.col("l_shipdate").alias("raw_time"),
        F.col("l_quantity").alias("QTY"),
        F.col("l_extendedprice").alias("PRICE"),
        F.col("l_discount").alias("DISC"),
        F.col("l_tax").alias("TAX"),
        # arrival order: a total one, date first
        packed_order(
            (F.unix_seconds(F.col("l_shipdate").cast("timestamp")), 12), (F.col("l_partkey"), 12), (hundredths("l_quantity"), 6),
            (hundredths("l_discount"), 4), (hundredths("l_tax"), 4),
        ).alias("ord"),
    )


def li_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long measurements: one value of one item on one site."""
    rows = li_rows(spark, sf_dir)
    return rows.unpivot([*SHOT_KEY, "raw_time", "ord"], LI_MEASURED, "item_id", "value")


def root_of(lot: str) -> Column:
    """Four neighbouring lots share a root."""
    return F.concat(F.lit("R"), F.floor(F.substring(lot, 2, 20).cast("long") / 4).cast("string"))


def li_items(spark: SparkSession) -> DataFrame:
    return item_frame(spark, LI_ITEMS)


def li_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide shots with the formula columns; the source rows hold all items of a touchdown.

    What travels are the source's columns; names, sites and the order are made of them where the shots meet.
    """
    return _li_wide(table(spark, sf_dir, "lineitem").repartitionByRange(*[_li_key()[k] for k in SHOT_KEY]))


def li_shots_met(spark: SparkSession, sf_dir: str, keys: Sequence[str]) -> DataFrame | None:
    """The same, dealt once and by hash, so that all shots of a group of ``keys`` (those of a report or more) meet in one
    task and nothing need be stored; None where a report has more rows than an array may hold."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_linestatus", "l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))  # a report; its shots are no more
    if not rows.where(F.col("n") > ordered.ALONE).isEmpty():
        return None
    return _li_wide(dealt(li, [_li_key()[k] for k in keys]))


def _li_wide(li: DataFrame) -> DataFrame:
    wide = last_values(_li_rows(li), SHOT_KEY, LI_MEASURED, "ord", dealt=True)
    wide = wide.withColumn("root_lot_id", root_of("lot_id"))
    return add_formulas(wide, LI_ITEMS).frame


def ev_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_measurements(table(spark, sf_dir, "events"))


def as_measurements(ev: DataFrame) -> DataFrame:
    """Event rows, batch or stream, as measurements."""
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.lit("EV").alias("vehicle"),
        F.lit("S1").alias("step_id"),
        F.concat(F.lit("E"), F.expr("user_id % 25").cast("string")).alias("lot_id"),
        F.concat(F.lit("R"), F.expr("(user_id % 25) div 4").cast("string")).alias("root_lot_id"),
        (F.lit(1) + F.expr("hour(ts) div 4")).cast("int").alias("wafer_id"),
        (k % 10).alias("chip_x"),
        F.floor(k / 10).alias("chip_y"),
        F.col("ts").alias("tkout_time"),
        F.col("event_type").alias("item"),
        "value",
        "event_id",
    )


def ev_items(spark: SparkSession) -> DataFrame:
    return item_frame(spark, EV_ITEMS)


def li_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip sites of every vehicle with their radius in millimetres."""
    sites = li_rows(spark, sf_dir).select(F.col("vehicle").alias("mask"), "chip_x", "chip_y").distinct()
    return with_radius(sites)


def with_radius(sites: DataFrame) -> DataFrame:
    """Radius for a pitch of 12 x 15 mm around site (6, 6)."""
    return sites.withColumn(
        "chip_radius", F.sqrt(F.pow(12.0 * (F.col("chip_x") - 6), 2.0) + F.pow(15.0 * (F.col("chip_y") - 6), 2.0))
    )


def wip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current location of each lot, several snapshots per lot."""
    orders = table(spark, sf_dir, "orders")
    n_lots = table(spark, sf_dir, "supplier").count()
    return orders.select(
        lot_name(F.col("o_custkey") % n_lots).alias("lot_id"),
        F.concat(F.lit("S"), (F.col("o_orderkey") % 1000).cast("string")).alias("lot_current_loc"),
        F.col("o_orderdate").alias("last_update_date"),
        "o_orderkey",
    )
