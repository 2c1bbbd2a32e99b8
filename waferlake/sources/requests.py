"""Rows of requested reports out of the stored days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.schema import WAFER
from waferlake.session import staged

REQUEST = ["report_id", "vehicle", "lot_id", "root_lot_id", "step_id", "as_of", "days"]


def _in_days(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored rows of the vehicles and days of each request."""
    day = F.explode(F.sequence(F.date_sub("as_of", F.col("days")), F.col("as_of")))
    wide = requests.select("report_id", "vehicle", F.col("lot_id").alias("_lot"), F.col("root_lot_id").alias("_root"), F.col("step_id").alias("_step"), day.alias("date"))
    return stored.join(wide, ["vehicle", "date"])


def scoped(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of every request with its ``report_id``; a row may serve several.

    ``requests`` has the columns of REQUEST and comes from a table with a
    filter on it (newly finished lots, say). Its vehicles and days prune the
    partitions of ``stored`` at run time, where the session's broadcast
    threshold admits them.

    With root and step the scope is exactly that root at that step, siblings
    included, even if nothing is there. Without one of them it is the lot on
    all steps, or, if the lot has no row, every lot whose name starts with the
    root. ``is_target`` marks the rows of the lot itself, or those that stand for it.
    """
    rows = _in_days(stored, requests)
    strict = F.col("_root").isNotNull() & F.col("_step").isNotNull()
    same = F.coalesce(F.col("lot_id") == F.col("_lot"), F.lit(False))
    kind = (
        F.when(strict, F.when((F.col("root_lot_id") == F.col("_root")) & (F.col("step_id") == F.col("_step")), 0))
        .when(same, 1).when(F.col("lot_id").startswith(F.col("_root")), 2)
    )
    # the pruned rows of the requests, written once for the choice and for the result
    rows = staged(rows.withColumn("_kind", kind).where(F.col("_kind").isNotNull()).withColumn("_target", same | (F.col("_kind") > 0)), "scope")
    best = rows.groupBy("report_id").agg(F.min("_kind").alias("_best"))
    return rows.join(best, "report_id").where("_kind = _best").drop("_lot", "_root", "_step", "_kind", "_best").withColumnRenamed("_target", "is_target")


def gated(shots: DataFrame, device_items: Sequence[str]) -> DataFrame:
    """Rows of the reports whose target lot has a value of a device item; others are not issued."""
    some = F.lit(False)
    for item in device_items:
        some = some | F.col(item).isNotNull()
    issued = shots.where(F.col("is_target") & some).select("report_id").distinct()
    return shots.join(issued, "report_id", "left_semi")


def issued_reports(shots: DataFrame) -> DataFrame:
    """Shots, wafers and lots per issued report."""
    return shots.groupBy("report_id").agg(
        F.count("*").alias("shots"), F.count_distinct(*WAFER).alias("wafers"), F.array_sort(F.collect_set("lot_id")).alias("lots"))
