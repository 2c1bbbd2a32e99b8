"""Scans of stored measurements and the windows of an incremental load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.functions import scalars as S

# fixed list of summary sub-items that are no measurements
SUMMARY_SUBITEMS = ("Q%", "AVG", "MAX", "MIN", "RANGE", "STD")


def scan(
    df: DataFrame,
    date_from: str,
    date_to: str,
    items: Sequence[str] | None = None,
    step_like: str | None = None,
    time: str = "tkout_time",
) -> DataFrame:
    """Half-open date window, item list, step pattern, no summary sub-items.

    Plain comparisons only, so the file scan receives the filters.
    """
    out = df.where((F.col(time) >= F.lit(date_from).cast("timestamp")) & (F.col(time) < F.lit(date_to).cast("timestamp")))
    if items is not None:
        out = out.where(F.col("item_id").isin(*items))
    if step_like is not None:
        out = out.where(F.col("step_id").like(step_like))
    if "subitem_id" in out.columns:
        for p in SUMMARY_SUBITEMS:
            out = out.where(~F.col("subitem_id").like(p))
    return out


def load_windows(span: DataFrame, days: int) -> DataFrame:
    """Cut each (date_from, date_to) in half-open windows of some days."""
    step = F.make_dt_interval(days=F.lit(days))
    starts = F.sequence("date_from", F.col("date_to") - F.make_dt_interval(days=F.lit(1)), step)
    return span.select("date_to", F.explode(starts).alias("window_from")).select(
        "window_from", F.least(F.col("window_from") + step, "date_to").alias("window_to")
    )


def typed(raw: DataFrame, value: str = "value", time: str = "tkout_time", absolute: bool = True) -> DataFrame:
    """Text to numbers and times; bad text becomes NULL, values become absolute."""
    v = S.number(value)
    return raw.withColumn(value, F.abs(v) if absolute else v).withColumn(time, F.try_to_timestamp(time))


def read_days(spark: SparkSession, root: str, as_of: str, days: int, vehicles: Sequence[str] | None = None) -> DataFrame:
    """Partition-pruned window of the stored days."""
    out = spark.read.parquet(root).where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return out if vehicles is None else out.where(F.col("vehicle").isin(*vehicles))


def write_days(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Replace exactly the (vehicle, day) partitions the rows belong to.

    Rebalancing lets Spark split a day that is much larger than the others.
    """
    (
        df.hint("rebalance", F.col("vehicle"), F.col("date"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("vehicle", "date")
        .parquet(root)
    )


def coordinate_sheet(raw: DataFrame) -> DataFrame:
    """Chip sites from a sheet: trimmed upper-case names, integer positions."""
    out = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    for c in ("chip_x", "chip_y"):
        out = out.withColumn(c, S.number(F.col(c).cast("string")).cast("int"))
    return out.where(F.col("chip_x").isNotNull() & F.col("chip_y").isNotNull())
