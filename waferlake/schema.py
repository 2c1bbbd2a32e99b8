"""Column groups, parameters and the item dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from waferlake.session import local_frame

REPORT = ["vehicle", "step_id", "lot_id"]
WAFER = [*REPORT, "wafer_id"]
PRODUCT = ["vehicle", "step_id"]
SITE = ["chip_x", "chip_y", "tkout_time"]
SHOT_KEY = [*WAFER, *SITE]

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("scale_factor", T.StringType()),
        T.StructField("formula", T.StringType()),
        T.StructField("report_order", T.DoubleType()),
        T.StructField("spec_low", T.DoubleType()),
        T.StructField("spec_high", T.DoubleType()),
        T.StructField("direction", T.StringType()),
        T.StructField("cat1", T.StringType()),
        T.StructField("cat2", T.StringType()),
        T.StructField("decl_order", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Item:
    """One row of the item dictionary."""

    category: str
    alias: str
    item_id: str | None = None
    scale_factor: str | None = None
    formula: str | None = None
    report_order: float | None = None
    spec_low: float | None = None
    spec_high: float | None = None
    direction: str | None = None
    cat1: str | None = None
    cat2: str | None = None


def item_frame(spark: SparkSession, items: Sequence[Item]) -> DataFrame:
    rows = [
        (i.category, i.item_id, i.alias, i.scale_factor, i.formula, i.report_order, i.spec_low, i.spec_high,
         i.direction, i.cat1, i.cat2, n)
        for n, i in enumerate(items)
    ]
    return local_frame(spark, rows, ITEM_SCHEMA)


@dataclass(frozen=True)
class Limits:
    """Detector thresholds (fixed default values)."""

    dispersion_ratio: float = 2.0
    flier_sigma: float = 3.5
    flier_max_points: int = 0
    flier_off_direction: float = 2.0
    dispersion_spec_fraction: float = 0.0
    zone_center: float = 60.0
    zone_middle: float = 100.0
    min_wafer_points: int = 5
    sample_positions: int = 20
    exclude: tuple[str, ...] = ()
    exclude_unless_rule: tuple[str, ...] = ()
    direction_aware: bool = False
    repeat_min_wafers: int = 3
    similar_overlap: float = 0.5
    gate_wafers: int = 2
    gate_points: int = 4
    aggregated: dict[str, str] = field(default_factory=dict)
