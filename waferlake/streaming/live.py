"""Streaming forms of ingest, lot log, completion and live spec share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waferlake.functions import scalars as S

LATENESS = "1 day"  # of live_lot_log, which groups by no time and so drops nothing


def _watermarked(stream: DataFrame, lateness: str | None) -> DataFrame:
    return stream if lateness is None else stream.withWatermark("tkout_time", lateness)


def ingest_days(stream: DataFrame, root: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Rewrite the day partitions a batch touches, old rows included, newest copy of a key kept.

    The new version of a day is written to the staging folder before it
    replaces the day, so nothing reads what it overwrites. A repeated batch
    ends with the same rows.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("date", F.to_date("tkout_time")).withColumn("_batch", F.lit(batch_id))
        try:
            old = spark.read.parquet(root)
            days = rows.select("vehicle", "date").distinct()
            rows = rows.unionByName(old.join(days, ["vehicle", "date"], "left_semi"), allowMissingColumns=True)
        except Exception as err:  # first batch: nothing stored yet
            if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
                raise
        cols = [c for c in rows.columns if c not in (*keys, "vehicle", "date")]
        newest = rows.groupBy("vehicle", "date", *keys).agg(F.max_by(F.struct(*cols), "_batch").alias("r"))
        staged = f"{root}_staging/batch={batch_id}"
        newest.select("vehicle", "date", *keys, "r.*").write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "vehicle", "date"
        ).parquet(root)

    return (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def live_lot_log(stream: DataFrame) -> DataFrame:
    """Accumulating lot log per prime key, for update mode."""
    return stream.withWatermark("tkout_time", LATENESS).groupBy(
        S.key("vehicle", "lot_id", "step_id").alias("prime_key")
    ).agg(
        F.array_sort(F.collect_set("wafer_id")).alias("wafers"),
        F.count("*").alias("n"),
        F.max("tkout_time").alias("tkout_time"),
    )


def silent_lots(stream: DataFrame, delay: str, lateness: str | None) -> DataFrame:
    """Stretches of each lot that end with ``delay`` of silence.

    With a ``lateness``, for append mode: each stretch once, when the
    watermark has passed it; later rows are dropped, and what is open when
    the input ends is not emitted. With None, for complete mode: every batch
    gives all stretches so far, the open ones included, and no row is dropped.
    """
    return _watermarked(stream, lateness).groupBy(
        F.session_window("tkout_time", delay), "vehicle", "lot_id", "step_id"
    ).agg(F.count("*").alias("n"), F.max("tkout_time").alias("last_time"))


def live_spec_share(stream: DataFrame, spec_low: float | None, spec_high: float | None, lateness: str | None) -> DataFrame:
    """Share of points out of spec per lot, item and day.

    With a ``lateness``, for append mode, as in ``silent_lots``. With None,
    for update mode: every batch gives the days it touches anew, the last
    state of a day holds all its rows, and no row is dropped.
    """
    out = S.spec_out("value", F.lit(spec_low).cast("double"), F.lit(spec_high).cast("double"))
    return _watermarked(stream, lateness).groupBy(
        F.window("tkout_time", "1 day"), "vehicle", "lot_id", "item"
    ).agg(F.count("*").alias("n"), F.count_if(out).alias("n_out")).withColumn("share", F.col("n_out") / F.col("n"))
