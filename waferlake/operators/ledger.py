"""Lot log, completion and the ledger of finished lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.functions import scalars as S
from waferlake.session import exists, local_frame


def lot_log(tests: DataFrame) -> DataFrame:
    """Sets of wafers and steps and the last time per product, lot and step."""
    return tests.groupBy(S.key("vehicle", "lot_id", "step_id").alias("prime_key")).agg(
        F.array_sort(F.collect_set("wafer_id")).alias("wafers"),
        F.array_sort(F.collect_set("site_count")).alias("site_counts"),
        F.max("tkout_time").alias("tkout_time"),
    )


def merge_logs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of the sets, latest time."""
    both = old.unionByName(new)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return both.groupBy("prime_key").agg(union("wafers"), union("site_counts"), F.max("tkout_time").alias("tkout_time"))


def latest_wip(wip: DataFrame) -> DataFrame:
    """Last known location per lot."""
    at = F.struct("last_update_date", "o_orderkey")
    return wip.groupBy("lot_id").agg(
        F.max_by("lot_current_loc", at).alias("current_step"), F.max("last_update_date").alias("last_update_date")
    )


def completion(log: DataFrame, wip: DataFrame, ledger: DataFrame | None, now: str, delay_minutes: int) -> DataFrame:
    """Log with done flag; a lot once done stays done, ``newly_done`` marks the change.

    Done: moved to another step family, or gone from the line, or a hundred
    steps further on; and silent for the delay.
    """
    _, lot, step = S.split_key("prime_key")
    rows = log.withColumn("lot_id", lot).withColumn("log_step", step)
    rows = rows.join(latest_wip(wip), "lot_id", "left")
    num = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("double")
    moved = (
        F.col("current_step").isNull()
        | (F.substring("current_step", 1, 2) != F.substring("log_step", 1, 2))
        | F.coalesce(num("current_step") - num("log_step") >= 100, F.lit(False))
    )
    silent = F.col("tkout_time") < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(delay_minutes))
    rows = rows.withColumn("done", moved & silent)
    if ledger is None:
        before = F.lit(False)
    else:
        rows = rows.join(ledger.select("prime_key", F.col("done").alias("_before")), "prime_key", "left")
        before = F.coalesce("_before", F.lit(False))
    return rows.withColumn("newly_done", F.col("done") & ~before).withColumn("done", F.col("done") | before).drop("_before")


def keep_last(old: DataFrame, new: DataFrame, key: str = "prime_key") -> DataFrame:
    """Stack two logs; the new row of a key replaces the old one."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def reportable(done: DataFrame, without_prefix: str | None = None, layers: DataFrame | None = None, layer: str | None = None) -> DataFrame:
    """Newly finished lots, less a lot prefix and other layers."""
    out = done.where("newly_done")
    if without_prefix:
        out = out.where(~F.col("lot_id").startswith(without_prefix))
    if layers is not None:
        out = out.join(layers.where(F.col("layer") == layer), F.col("log_step") == layers["step_id"], "left_semi")
    return out


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/commits"
    return spark.read.schema("version long, rows long").parquet(path) if exists(spark, path) else None


def committed(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(version, rows) of the committed versions, newest first; one small row each."""
    log = _commits(spark, root)
    return [] if log is None else [(r["version"], r["rows"]) for r in log.orderBy(F.desc("version")).collect()]


def write_ledger(ledger: DataFrame, root: str) -> int:
    """Write the next version beside the older ones and give its number.

    The version counts from the moment its commit row stands, which is written
    last: readers never see half a ledger, and a run that broke off leaves
    files under a number that the next run uses again.
    """
    spark = ledger.sparkSession
    done = committed(spark, root)
    version = done[0][0] + 1 if done else 1
    path = f"{root}/versions/v{version:09}"
    ledger.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).count()
    local_frame(spark, [(version, rows)], "version long, rows long").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def ledger_as_of(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The newest complete version, at most the given one; None before the first.

    Complete means committed and holding as many rows as its commit row says.
    """
    for number, rows in committed(spark, root):
        path = f"{root}/versions/v{number:09}"
        if (version is None or number <= version) and exists(spark, path):
            found = spark.read.parquet(path)
            if found.count() == rows:
                return found
    return None


def resume(log: DataFrame, wip: DataFrame, root: str, now: str, delay_minutes: int) -> DataFrame:
    """One run: completion on top of the newest ledger, written as the next version and read back."""
    spark = log.sparkSession
    before = ledger_as_of(spark, root)
    write_ledger(completion(log, wip, before, now, delay_minutes), root)
    return ledger_as_of(spark, root)
