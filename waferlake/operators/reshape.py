"""Long to wide, wide to long, and dictionary joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_value_pivot(
    long: DataFrame, keys: Sequence[str], items: Sequence[str], item: str, value: str, order: str
) -> DataFrame:
    """One row per shot, one column per item; the last value by ``order`` wins.

    Conditional aggregates need one shuffle and combine before it; a pivot over
    the same data would aggregate and shuffle twice.
    """
    picks = [
        F.max_by(F.when(F.col(item) == i, F.col(value)), F.when(F.col(item) == i, F.col(order))).alias(i) for i in items
    ]
    return long.where(F.col(value).isNotNull() & F.col(item).isin(*items)).groupBy(*keys).agg(*picks)


def last_values(rows: DataFrame, keys: Sequence[str], items: Sequence[str], order: str, dealt: bool = False) -> DataFrame:
    """The same for rows that hold several items each.

    The rows are dealt in the order of the keys, so that shots of one wafer stay
    together and what is counted of them next is combined before a shuffle.
    ``dealt`` says that they are already, by columns the keys are made of.
    """
    picks = [F.max_by(i, F.when(F.col(i).isNotNull(), F.col(order))).alias(i) for i in items]
    return (rows if dealt else rows.repartitionByRange(*keys)).groupBy(*keys).agg(*picks)


def points(shots: DataFrame, items: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Back to long form; missing measurements are absent rows."""
    return shots.unpivot(list(ids), list(items), "item", "value").where(F.col("value").isNotNull())


def drop_empty(shots: DataFrame, items: Sequence[str]) -> DataFrame:
    """Drop shots on which every device item is missing."""
    return shots.na.drop(how="all", subset=list(items))


def first_alias(items: DataFrame) -> DataFrame:
    """One dictionary row per raw item: the first declared one."""
    named = items.where(F.trim(F.coalesce("item_id", F.lit(""))) != "")
    return named.groupBy("item_id").agg(
        F.min_by("alias", "decl_order").alias("alias"), F.min_by("scale_factor", "decl_order").alias("scale_factor")
    )


def scale_and_rename(long: DataFrame, items: DataFrame) -> DataFrame:
    """Multiply by the dictionary factor (1 if blank or not a number), use the alias."""
    dim = first_alias(items)
    factor = F.coalesce(F.col("scale_factor").try_cast("double"), F.lit(1.0))
    return (
        long.join(dim, "item_id", "left")
        .withColumn("value", F.col("value") * factor)
        .withColumn("item", F.coalesce("alias", "item_id"))
        .drop("alias", "scale_factor")
    )


def place_on_layout(shots: DataFrame, layout: DataFrame) -> DataFrame:
    """Inner join with the chip sites: shots without a site are dropped."""
    dim = layout.withColumnRenamed("mask", "vehicle")
    return shots.join(dim, ["vehicle", "chip_x", "chip_y"])


def union_vehicles(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def measured_items(items: DataFrame, pts: DataFrame) -> DataFrame:
    """Dictionary rows with at least one measured value, in dictionary order."""
    return items.join(pts.select(F.col("item").alias("alias")).distinct(), "alias", "left_semi")
