"""Queries over what the library itself has stored: days, archive, ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import columns  # noqa: F401  registers what is used below
from checks.base import query
from checks.common import R, RI, W, WI, chain, robust
from checks.core import KR, KRI, li, pts
from waferlake import fixtures as fx
from waferlake.operators import digest, ledger, testlevel
from waferlake.plans import run
from waferlake.plans.report import Report
from waferlake.schema import REPORT, Limits
from waferlake.session import checkpoint_dir, local_frame, staged
from waferlake.sources import measurements, requests, sinks


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broken_file(spark: SparkSession, path: str) -> None:
    """A file that is no Parquet, written where Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(b"cut off"))
    out.close()


def stored_events(spark: SparkSession, sf: str) -> str:
    root = folder(spark, "days")
    measurements.write_days(fx.ev_long(spark, sf).withColumn("date", F.to_date("tkout_time")), root)
    return root


@query("event_id:i value:d", "ev WHERE tkout_time >= TIMESTAMP '2024-01-23'", "ev")
def recent_days_scan(spark, sf):
    """The last seven days before a fixed date, out of stored day partitions."""
    return measurements.read_days(spark, stored_events(spark, sf), "2024-01-30", 7)


REQUESTS = [
    (1, "VF", "L00003", "R0", "SN", "2001-12-31", 4000), (2, "VO", "L00005", None, None, "2000-01-01", 700), (3, "VF", "L99999", "L0000", None, "1998-01-01", 900),
    (4, "VF", "L99999", "R1", "SR", "2001-12-31", 4000), (5, "VF", "L00002", "R0", None, "1996-01-01", 30), (6, "VO", "L00001", "R0", "SA", "2001-12-31", -1),
]
ASKED = " UNION ALL ".join(f"SELECT {i} AS report_id, '{v}' AS vehicle, '{l}' AS lot, {repr(r) if r else 'NULL'} AS root, {repr(s) if s else 'NULL'} AS step, DATE '{d}' AS as_of, {n} AS days"
                           for i, v, l, r, s, d, n in REQUESTS)
chain("asked", "", ASKED)
chain("scope_", "shots asked", """SELECT report_id, s.*, CASE WHEN root IS NOT NULL AND step IS NOT NULL THEN CASE WHEN root_lot_id = root AND step_id = step THEN 0 END
  WHEN lot_id = lot THEN 1 WHEN starts_with(lot_id, root) THEN 2 END AS kind, lot FROM shots s JOIN asked a ON s.vehicle = a.vehicle
  AND CAST(tkout_time AS DATE) BETWEEN as_of - CAST(days AS INT) AND as_of AND days >= 0""")


@query("report_id:i shots:i wafers:i lot_text", f"""(WITH best AS (SELECT report_id, min(kind) AS kind FROM scope_ GROUP BY report_id), kept AS (SELECT s.* FROM scope_ s JOIN best USING (report_id, kind)),
 issued AS (SELECT DISTINCT report_id FROM kept WHERE (lot_id = lot OR kind > 0) AND coalesce(QTY, PRICE, DISC, TAX) IS NOT NULL)
 SELECT report_id, count(*) AS shots, count(DISTINCT ({W})) AS wafers, array_to_string(list_sort(list(DISTINCT lot_id)), ',') AS lot_text FROM kept SEMI JOIN issued USING (report_id) GROUP BY report_id)""", "scope_")
def forced_report(spark, sf):
    """Requested reports out of the stored days, with gate and fall-back of the scope."""
    return requests.issued_reports(forced_rows(spark, sf)).withColumn("lot_text", F.array_join("lots", ","))


def forced_rows(spark: SparkSession, sf: str) -> DataFrame:
    root = folder(spark, "days")
    measurements.write_days(fx.li_shots(spark, sf).withColumn("date", F.to_date("tkout_time")), root)
    asked = staged(local_frame(spark, REQUESTS, "report_id int, vehicle string, lot_id string, root_lot_id string, step_id string, as_of string, days int"), "requests")
    asked = asked.withColumn("as_of", F.col("as_of").cast("date")).where("days >= 0")
    stored = measurements.read_days(spark, root, "2001-12-31", 4000)
    return requests.gated(requests.scoped(stored, asked), fx.LI_MEASURED)


chain("last_day", "shots", f"SELECT {R}, strftime(max(tkout_time), '%Y-%m-%d') AS day FROM shots GROUP BY {R}")


def _archive(spark: SparkSession, sf: str) -> str:
    days, archive = folder(spark, "days"), folder(spark, "archive")
    long = fx.li_long(spark, sf).withColumn("root_lot_id", fx.root_of("lot_id")).withColumn("date", F.to_date("tkout_time"))
    measurements.write_days(long, days)
    run.run(spark, days, archive, fx.LI_ITEMS, "2001-12-31", 4000)
    return archive


@query(f"{KRI} severity type priority:d rank:i day", f"(SELECT * FROM ranked JOIN last_day USING ({R}))", "ranked last_day")
def archive_round_trip(spark, sf):
    """Stored days to shots, findings and archive, read back."""
    rows, _ = run.archived(spark, _archive(spark, sf), "2001-12-31", 4000)
    return rows.withColumn("day", F.date_format("report_date", "yyyy-MM-dd"))


@query("item reports:i skipped:i", f"(SELECT item, count(*) AS reports, 1 AS skipped FROM find JOIN last_day USING ({R}) WHERE type = 'SPEC_OUT' AND day >= '2001-06-03' GROUP BY item)", "find last_day")
def digest_from_archive(spark, sf):
    """Reports per item out of spec over an archive with a broken file, which is counted and not read."""
    archive = folder(spark, "archive")
    last = fx.li_shots(spark, sf).groupBy(*REPORT).agg(F.to_date(F.max("tkout_time")).alias("_day"))
    found = li(spark, sf).findings().select(*REPORT, "item", "severity", "type").join(last, REPORT)
    sinks.write_archive(archive, F.col("_day"), findings=found)
    for day in ("1999-01-01", "2001-07-01"):
        broken_file(spark, f"{archive}/findings/report_date={day}/part-broken.parquet")
    rows, skipped = sinks.read_archive(spark, archive, "findings", "vehicle string, step_id string, lot_id string, item string, severity string, type string", "2001-09-01", 90)
    per = rows.where("type = 'SPEC_OUT'").groupBy("item").agg(F.count_distinct(*REPORT).alias("reports"))
    return per.withColumn("skipped", F.lit(skipped.count()))


def _run_sql(cut: str, now: str) -> str:
    return f"""SELECT prime_key, (loc IS NULL OR substr(loc, 1, 2) <> 'S3' OR CAST(substr(loc, 2) AS INT) - 300 >= 100) AND t < TIMESTAMP '{now}' - INTERVAL 90 MINUTE AS done
 FROM (SELECT vehicle || '_' || lot_id || '_S300' AS prime_key, lot_id, max(tkout_time) AS t FROM shots WHERE tkout_time < TIMESTAMP '{cut}' GROUP BY vehicle, lot_id)
 LEFT JOIN (SELECT lot_id, arg_max(loc, row(d, o_orderkey)) AS loc FROM wip_ GROUP BY lot_id) USING (lot_id)"""


RUNS = [("2001-04-01", "2001-03-01 00:00:00"), ("2002-01-01", "2001-10-01 01:00:00")]
for _n, _r in enumerate(RUNS):
    chain(f"run{_n}", "shots wip_", _run_sql(*_r))


@query("prime_key done:b newly_done:b", "(SELECT prime_key, b.done OR coalesce(a.done, false) AS done, b.done AND NOT coalesce(a.done, false) AS newly_done FROM run1 b LEFT JOIN run0 a USING (prime_key))", "run0 run1")
def ledger_resume(spark, sf):
    """Two runs over a growing log; the second reads the ledger of the first."""
    root = folder(spark, "ledger")
    tests = fx.li_shots(spark, sf).withColumns({"site_count": F.quarter("tkout_time"), "step_id": F.lit("S300")})
    out = None
    for cut, now in RUNS:
        out = ledger.resume(ledger.lot_log(tests.where(F.col("tkout_time") < F.lit(cut).cast("timestamp"))), fx.wip(spark, sf), root, now, 90)
    return out


TABLE = {"price*": "P90", "Net": "mean"}
chain("tl", "pts", f"""SELECT {WI}, value FROM pts WHERE item NOT IN ('PRICE', 'NET')
 UNION ALL SELECT {WI}, CASE item WHEN 'PRICE' THEN quantile_cont(value, 0.9) ELSE avg(value) END FROM pts WHERE item IN ('PRICE', 'NET') GROUP BY {WI}, root_lot_id, tkout_time""")
robust("tlw", "tl", WI, "value")


@query(f"{KRI} n:i rep_median:d n_out:i out_wafers:i flier_wafer:i disp_ratio:d", f"""(SELECT {RI}, sum(n) AS n, median(median) AS rep_median, sum(o) AS n_out, count(*) FILTER (o > 0) AS out_wafers, NULL AS flier_wafer, 0.0 AS disp_ratio
 FROM tlw JOIN (SELECT {WI}, count(*) FILTER (value < lo OR value > hi) AS o FROM tl JOIN items USING (item) GROUP BY {WI}) USING ({WI}) WHERE item IN ('PRICE', 'NET') GROUP BY {RI})""", "tl tlw items")
def findings_with_test_level(spark, sf):
    """Statistics of items that count by one value per test: out of spec by those, no flier, no dispersion."""
    r = li(spark, sf)
    return Report(r.shots, r.items, Limits(aggregated=TABLE)).items_scored().where("item IN ('PRICE', 'NET')")


@query(f"{KRI} report_order:d added:b", f"""(SELECT {RI}, report_order, n_out = 0 AS added FROM (SELECT {RI}, count(*) AS n, count(*) FILTER (value < lo OR value > hi) AS n_out FROM pts JOIN items USING (item) GROUP BY {RI})
 JOIN items USING (item) WHERE n_out > 0 OR report_order IS NOT NULL)""", "pts items")
def spec_items_added(spark, sf):
    """Items with metrics (here: out of spec), then ordered dictionary items that are measured without."""
    spec = fx.li_items(spark).select(F.col("alias").alias("item"), "spec_low", "spec_high")
    p = pts(spark, sf).join(spec, "item")
    outside = F.coalesce(F.col("value") < F.col("spec_low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("spec_high"), F.lit(False))
    measured = p.groupBy(*REPORT, "item").agg(F.count("*").alias("n"), (F.count_if(outside) > 0).alias("has_metrics"))
    return testlevel.spec_items_added(measured, fx.li_items(spark))
