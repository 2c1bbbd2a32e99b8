"""Finding priority and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waferlake.schema import REPORT, Limits


def priority(lim: Limits) -> Column:
    """Class base plus a size term, so classes never mix."""
    critical = F.when(F.col("severity") == "CRITICAL", 100.0).otherwise(0.0)
    ratio = 100.0 * F.coalesce("disp_ratio", F.lit(0.0))
    flier = F.coalesce("flier_dev", F.lit(0.0)) / lim.flier_sigma if lim.flier_sigma > 0 else F.lit(0.0)
    t = F.col("type")
    return (
        F.when(t == "DEFECT_MODE", 40000.0 + critical)
        .when(t == "KNOWLEDGE", 30000.0 + critical)
        .when(t == "SPEC_OUT", 20000.0 + 100.0 * F.col("max_ratio") + F.col("out_wafers") / 100.0)
        .when(t == "FLIER", 10000.0 + 100.0 * flier)
        .when(t == "DISPERSION", 10000.0 + ratio)
        .otherwise(ratio)
    )


def ranked(findings: DataFrame, lim: Limits) -> DataFrame:
    """Rank within the report; a report holds at most a few findings per dictionary item."""
    out = findings.withColumn("_p", priority(lim))
    tie = F.when(F.col("type") == "DEFECT_MODE", F.col("rule_rank").cast("double")).otherwise(F.col("report_order"))
    order = W.partitionBy(*REPORT).orderBy(
        F.desc("_p"), F.coalesce(tie, F.lit(1e9)), F.col("item"), F.col("type")
    )
    return out.select(
        *findings.columns, F.round("_p", 3).alias("priority"), F.row_number().over(order).alias("rank")
    )


def top_k(df: DataFrame, keys, order, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each group before the shuffle already."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def shown(ranked_findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of each report with the total count kept."""
    total = ranked_findings.groupBy(*REPORT).agg(F.count("*").alias("total"))
    return ranked_findings.where(F.col("rank") <= n).join(total, REPORT)
