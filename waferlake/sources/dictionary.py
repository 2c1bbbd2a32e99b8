"""Checks of an item dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("category", "item_id", "alias", "scale_factor", "formula", "report_order", "spec_low", "spec_high", "direction")
OPTIONAL = ("unit", "target", "report_log_scale", "cat1", "cat2")


def column_checks(items: DataFrame) -> list[tuple[str, bool, str]]:
    """Missing required columns fail; missing optional ones are only named."""
    lacking = [c for c in REQUIRED if c not in items.columns]
    optional = [c for c in OPTIONAL if c not in items.columns]
    return [("required columns", not lacking, ",".join(lacking)), ("optional columns", True, ",".join(optional))]


def row_checks(items: DataFrame) -> DataFrame:
    """(check_name, passed, offenders) of the checks on rows.

    Two aggregates: the duplicates need their own grouping, everything else is
    counted in one pass.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    real, derived = F.col("category") == "REAL", F.col("category") == "ADDP"
    flat = items.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("not empty"),
        F.count_if(~F.coalesce(real | derived, F.lit(False))).alias("known category"),
        F.count_if(real & blank("item_id")).alias("measured item has id"),
        F.count_if(derived & blank("formula")).alias("derived item has formula"),
    )
    names = flat.columns
    flat = flat.unpivot([], names, "check_name", "offenders")
    twice = items.where(~blank("item_id")).groupBy("item_id").agg(F.count("*").alias("c")).agg(
        F.count_if(F.col("c") > 1).alias("offenders")
    ).select(F.lit("item id unique").alias("check_name"), "offenders")
    return flat.unionByName(twice).withColumn("passed", F.col("offenders") == 0)


def valid(items: DataFrame) -> bool:
    """All checks pass; a handful of rows reach the driver."""
    return all(ok for _, ok, _ in column_checks(items)) and row_checks(items).where(~F.col("passed")).isEmpty()
