"""Streaming forms, driven to completion over the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query
from waferlake import fixtures as fx
from waferlake.session import checkpoint_dir
from waferlake.streaming import live


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of measurements."""
    schema = fx.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return fx.as_measurements(raw).withColumn("tkout_time", F.col("tkout_time").cast("timestamp"))


def finished(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read the result back from the shared folder."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("lot_id item day n:i n_out:i share:d", """(SELECT lot_id, item, strftime(d, '%Y-%m-%d') AS day, n, n_out, n_out / n AS share FROM (SELECT lot_id, item, CAST(tkout_time AS DATE) AS d, count(*) AS n, count(*) FILTER (value > 250) AS n_out
 FROM ev GROUP BY ALL) WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(tkout_time) FROM ev) - INTERVAL 1 DAY)""", "ev")
def stream_spec_share(spark, sf):
    """Days the watermark has passed, each emitted once."""
    out = finished(live.live_spec_share(event_stream(spark, sf), None, 250.0, "1 day"), "append")
    return out.withColumn("day", F.date_format("window.start", "yyyy-MM-dd"))


@query("lot_id item day n:i n_out:i share:d", """(SELECT lot_id, item, strftime(d, '%Y-%m-%d') AS day, n, n_out, n_out / n AS share FROM (SELECT lot_id, item, CAST(tkout_time AS DATE) AS d, count(*) AS n, count(*) FILTER (value > 250) AS n_out
 FROM ev GROUP BY ALL))""", "ev")
def stream_spec_share_whole(spark, sf):
    """Every day, those open when the input ends included; the last update of a day holds its totals."""
    out = finished(live.live_spec_share(event_stream(spark, sf), None, 250.0, None), "update")
    last = out.groupBy("window", "vehicle", "lot_id", "item").agg(F.max_by(F.struct("n", "n_out", "share"), "_batch").alias("r"))
    return last.select("lot_id", "item", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "r.*")


@query("prime_key wafer_text n:i tkout_time:t", """(SELECT 'EV_' || lot_id || '_S1' AS prime_key, array_to_string(list_sort(list(DISTINCT wafer_id)), ',') AS wafer_text, count(*) AS n, max(tkout_time) AS tkout_time FROM ev GROUP BY lot_id)""", "ev")
def stream_lot_log(spark, sf):
    """Accumulating log; the last update of a lot holds its totals."""
    out = finished(live.live_lot_log(event_stream(spark, sf)), "update")
    last = out.groupBy("prime_key").agg(F.max_by(F.struct("wafers", "n", "tkout_time"), "_batch").alias("r"))
    return last.select("prime_key", F.array_join("r.wafers", ",").alias("wafer_text"), "r.n", "r.tkout_time")


@query("lot_id session_no:i n:i last_time:t", """(SELECT lot_id, row_number() OVER (PARTITION BY lot_id ORDER BY last_time) AS session_no, n, last_time FROM (
 SELECT lot_id, s, count(*) AS n, max(tkout_time) AS last_time FROM (SELECT *, sum(brk) OVER (PARTITION BY lot_id ORDER BY tkout_time, event_id) AS s FROM (
 SELECT *, CAST(coalesce(tkout_time >= lag(tkout_time) OVER (PARTITION BY lot_id ORDER BY tkout_time, event_id) + INTERVAL 6 HOUR, true) AS INT) AS brk FROM ev)) GROUP BY lot_id, s)
 WHERE last_time + INTERVAL 6 HOUR <= (SELECT max(tkout_time) FROM ev) - INTERVAL 1 DAY)""", "ev")
def stream_silent_lots(spark, sf):
    """Each stretch of a lot once, after six hours of silence."""
    out = finished(live.silent_lots(event_stream(spark, sf), "6 hours", "1 day"), "append")
    from waferlake.functions import ordered

    return ordered.running(out, ["lot_id"], ["last_time"], {"session_no": F.lit(1)})


@query("lot_id session_no:i n:i last_time:t", """(SELECT lot_id, row_number() OVER (PARTITION BY lot_id ORDER BY last_time) AS session_no, n, last_time FROM (
 SELECT lot_id, s, count(*) AS n, max(tkout_time) AS last_time FROM (SELECT *, sum(brk) OVER (PARTITION BY lot_id ORDER BY tkout_time, event_id) AS s FROM (
 SELECT *, CAST(coalesce(tkout_time >= lag(tkout_time) OVER (PARTITION BY lot_id ORDER BY tkout_time, event_id) + INTERVAL 6 HOUR, true) AS INT) AS brk FROM ev)) GROUP BY lot_id, s))""", "ev")
def stream_silent_lots_whole(spark, sf):
    """Each stretch of a lot, those open when the input ends included; the last batch holds them all."""
    out = finished(live.silent_lots(event_stream(spark, sf), "6 hours", None), "complete")
    out = out.join(F.broadcast(out.agg(F.max("_batch").alias("_batch"))), "_batch")
    from waferlake.functions import ordered

    return ordered.running(out, ["lot_id"], ["last_time"], {"session_no": F.lit(1)})


@query("lot_id day n:i total:f", """(SELECT lot_id, strftime(tkout_time, '%Y-%m-%d') AS day, count(*) AS n, sum(value) AS total FROM ev GROUP BY ALL)""", "ev")
def stream_day_ingest(spark, sf):
    """Day partitions written by the stream, read back."""
    root = f"{checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    rows = event_stream(spark, sf)
    live.ingest_days(rows, f"{root}/table", f"{root}/state", ["event_id"]).awaitTermination()
    back = spark.read.parquet(f"{root}/table")
    return back.withColumn("day", F.date_format("date", "yyyy-MM-dd")).groupBy("lot_id", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
