"""Inline metrology: limits, unit change and boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.functions import scalars as S

LIMITS = ["ucl", "target", "lcl"]


def normalised(inline: DataFrame) -> DataFrame:
    """Numbers from text, critical dimensions in nanometres, no negative limits."""
    out = inline.withColumn("fab_value", S.critical_dimension_scale("item_id", S.number("fab_value")))
    for c in LIMITS:
        out = out.withColumn(c, S.not_negative(S.critical_dimension_scale("item_id", S.number(c))))
    return out


def out_of_limit(inline: DataFrame) -> DataFrame:
    return inline.withColumn("out", S.spec_out("fab_value", "lcl", "ucl"))


def with_settings(inline: DataFrame, settings: DataFrame) -> DataFrame:
    return inline.join(settings, "step_desc", "left")


def for_vehicle(settings: DataFrame, vehicle: str) -> DataFrame:
    return settings.where(S.in_comma_list("vehicle", F.lit(vehicle)))


def item_limits(inline: DataFrame) -> DataFrame:
    return inline.groupBy("step_desc", "item_id").agg(*[F.avg(c).alias(c) for c in LIMITS], F.count_if("out").alias("n_out"))


def wafer_board(inline: DataFrame, wafers: Sequence[int]) -> DataFrame:
    """Mean value per wafer as columns in ascending wafer order."""
    cells = [F.avg(F.when(F.col("wafer_id") == w, F.col("fab_value"))).alias(f"wafer_{w}") for w in sorted(wafers)]
    return inline.groupBy("root_lot_id", "step_desc", "item_id").agg(*cells)


def last_module(settings: DataFrame) -> DataFrame:
    """Module of a step; the last declaration wins."""
    return settings.groupBy("step_desc").agg(F.max_by("module", "decl_order").alias("module"))
