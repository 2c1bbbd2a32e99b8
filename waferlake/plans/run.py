"""One run: stored days to archived findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.functions.formulas import add_formulas
from waferlake.operators import board, reshape
from waferlake.plans.report import Report
from waferlake.schema import REPORT, SHOT_KEY, Item, Limits, item_frame
from waferlake.session import staged
from waferlake.sources import measurements, sinks

#: columns of archived findings
FINDINGS = ("vehicle string, step_id string, lot_id string, item string, severity string, type string, worst_wafer int, n_out long, max_ratio double, "
            "priority double, rank int, cat2 string")


def shots_of(spark: SparkSession, root: str, items: Sequence[Item], as_of: str, days: int, vehicles: Sequence[str] | None = None) -> DataFrame:
    """Wide shots with formula columns from the stored long days: scaled, renamed, last value of a site kept."""
    long = measurements.read_days(spark, root, as_of, days, vehicles)
    named = reshape.scale_and_rename(long, item_frame(spark, items))
    measured = [i.alias for i in items if not i.formula]
    wide = reshape.last_value_pivot(named, [*SHOT_KEY, "root_lot_id"], measured, "item", "value", "ord")
    return add_formulas(reshape.drop_empty(wide, measured), items).frame


def run(spark: SparkSession, days_root: str, archive_root: str, items: Sequence[Item], as_of: str, days: int, limits: Limits = Limits()) -> None:
    """Findings of all lots of the window that pass the gate, archived under the day of their last test."""
    # in key order, so that what is counted of a wafer next is combined before a shuffle
    shots = staged(shots_of(spark, days_root, items, as_of, days).repartitionByRange(*SHOT_KEY), "shots")
    report = Report(shots, items, limits, is_stored=True)
    issued = board.report_gate(report.points, report.item_dim).select(*REPORT)
    last = shots.groupBy(*REPORT).agg(F.to_date(F.max("tkout_time")).alias("_day")).join(issued, REPORT)
    found = report.ranked().join(last, REPORT)
    names = [c.split()[0] for c in FINDINGS.split(", ")]
    out = found.select(*[F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, FINDINGS.split(", "))], "_day")
    sinks.write_archive(archive_root, F.col("_day"), findings=out)


def archived(spark: SparkSession, archive_root: str, today: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Findings of the last days and the files that could not be read."""
    return sinks.read_archive(spark, archive_root, "findings", FINDINGS + ", _day date", today, days)
