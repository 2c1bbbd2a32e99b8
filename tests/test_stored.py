"""Ledger versions, archive files, requested reports, order keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import stored
from waferlake import fixtures as fx
from waferlake.operators import ledger
from waferlake.sources import requests, sinks


def test_ledger_versions(spark, tmp_path):
    root = f"{tmp_path}/ledger"
    frame = lambda n: spark.createDataFrame([(f"k{i}", True) for i in range(n)], "prime_key string, done boolean")
    assert ledger.ledger_as_of(spark, root) is None
    assert [ledger.write_ledger(frame(n), root) for n in (1, 2, 3)] == [1, 2, 3]
    assert ledger.ledger_as_of(spark, root).count() == 3 and ledger.ledger_as_of(spark, root, 2).count() == 2
    # a run that broke off before its commit row, and a committed version that lost rows
    frame(9).write.parquet(f"{root}/versions/v000000004")
    assert ledger.ledger_as_of(spark, root).count() == 3
    frame(1).write.mode("overwrite").parquet(f"{root}/versions/v000000003")
    assert ledger.ledger_as_of(spark, root).count() == 2
    assert ledger.write_ledger(frame(5), root) == 4 and ledger.ledger_as_of(spark, root).count() == 5


def test_archive_with_a_broken_report(spark, tmp_path):
    root = f"{tmp_path}/archive"
    rows = spark.createDataFrame([("a", dt.date(2024, 1, d)) for d in (1, 5, 9)], "item string, day date")
    sinks.write_archive(root, F.col("day"), findings=rows)
    stored.broken_file(spark, f"{root}/findings/report_date=2024-01-08/part-x.parquet")
    stored.broken_file(spark, f"{root}/findings/report_date=2023-01-08/part-old.parquet")
    back, skipped = sinks.read_archive(spark, root, "findings", "item string, day date", "2024-01-10", 6)
    assert sorted(str(r["day"]) for r in back.collect()) == ["2024-01-05", "2024-01-09"]
    assert [(str(r["report_date"]), r["file"]) for r in skipped.collect()] == [("2024-01-08", "part-x.parquet")]
    sinks.write_rule_trace(root, "2024-01-10", spark.createDataFrame([("r", True), ("s", False)], "rule string, matched boolean"))
    assert sorted(map(tuple, spark.read.parquet(f"{root}/rule_trace").select("rule", "matched").collect())) == [("r", True), ("s", False)]


def test_requests_prune_days(spark, sf, monkeypatch):
    plans = []
    keep = requests._in_days
    monkeypatch.setattr(requests, "_in_days", lambda *a: plans.append(keep(*a)) or plans[-1])
    rows = stored.forced_rows(spark, sf)
    assert {r["report_id"] for r in rows.select("report_id").distinct().collect()} == {1, 2, 3, 5}
    assert "dynamicpruning" in plans[0]._jdf.queryExecution().executedPlan().toString()


def test_large_keys_stay_whole(spark):
    """Seven-digit lots and part keys of twelve digits neither collide nor change the order."""
    rows = [(1, 10, 1.0, 0.0, 0.0, 5.0), (1, 10**11, 1.0, 0.0, 0.0, 6.0), (2, 5, 1.0, 0.0, 0.0, 7.0), (2, 5, 50.0, 0.1, 0.08, 8.0)]
    df = spark.createDataFrame(rows, "d long, p long, q double, disc double, tax double, v double")
    key = fx.packed_order((F.col("d"), 12), (F.col("p"), 11), (fx.hundredths("q"), 6), (fx.hundredths("disc"), 4), (fx.hundredths("tax"), 4))
    with pytest.raises(Exception, match="passes its room"):
        df.select(key).collect()
    key = fx.packed_order((F.col("d"), 12), (F.col("p"), 12), (fx.hundredths("q"), 6), (fx.hundredths("disc"), 4), (fx.hundredths("tax"), 4))
    assert [r["v"] for r in df.orderBy(key).collect()] == [5.0, 6.0, 7.0, 8.0] and df.select(key).distinct().count() == 4
    plan = df.groupBy("d").agg(F.max_by("v", key))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    lots = spark.createDataFrame([(7,), (1234567,), (234567,)], "n long").select(fx.lot_name(F.col("n"))).collect()
    assert [r[0] for r in lots] == ["L00007", "L1234567", "L234567"]
