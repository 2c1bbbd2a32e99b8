import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waferlake.functions import formulas, ordered
from waferlake.functions import scalars as S
from waferlake.operators import charts, ledger, testlevel
from waferlake.schema import Item, item_frame
from waferlake.sources import dictionary, measurements, sinks


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0].asDict()


def test_scalars(spark):
    lit = F.lit
    v, lot, step = S.split_key(lit("A_B_L1_S2"))
    got = one(
        spark, v=v, lot=lot, step=step, five=S.nearest_five(lit(22.5)), n=S.number(lit("x")), nan=S.number(lit("NaN")),
        cells=S.list_cell(lit("['10', '9', '1']")), label=S.clean_label(lit("P(3pt)_1.0")), keep=S.clean_label(lit("P(3pt)_11")),
        zone=S.zone(lit(None).cast("double")), hit=S.wildcard(lit("ab.c"), ["AB.?"]), miss=S.wildcard(lit("abxc"), ["AB.?"]),
        neg=S.not_negative(lit(-3.0)), out=S.spec_out(lit(None).cast("double"), lit(1.0), lit(2.0)),
    )
    assert got == {"v": "A_B", "lot": "L1", "step": "S2", "five": 20, "n": None, "nan": None, "cells": "1, 9, 10", "label": "P(3pt)",
                   "keep": "P(3pt)_11", "zone": None, "hit": True, "miss": False, "neg": 0.0, "out": False}


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (4.0, 2.0, 3.0)], "a double, b double, c double")
    items = [Item("ADDP", "q", formula="{a}/{b}"), Item("ADDP", "m", formula="rmax({a}, {b}, {c})"), Item("ADDP", "z", formula="{y} + 1"),
             Item("ADDP", "y", formula="{q} * 2"), Item("ADDP", "lost", formula="{no}"), Item("ADDP", "r", formula="sqrt({b} - 1)")]
    d = formulas.add_formulas(df, items)
    assert d.unresolved == ["lost"]
    assert [r.asDict() for r in d.frame.select("q", "m", "z", "r").collect()] == [
        {"q": None, "m": 1.0, "z": None, "r": None}, {"q": 2.0, "m": 4.0, "z": 5.0, "r": 1.0}]
    with pytest.raises(ValueError):
        formulas.add_formulas(df, [Item("ADDP", "bad", formula="{a}.__class__")])


def test_margin_window_against_polyfit(spark):
    rng = np.random.default_rng(3)
    ys = 10 ** rng.uniform(0, 4, (60, 5))
    xs, spec, cap = [-2, -1, 0, 1, 2], 2.0, 3.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in ys], "a double, b double, c double, d double, e double")
    cols = formulas.window_margins(xs, [F.col(c) for c in "abcde"], spec, cap)
    got = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    for y, row in zip(ys, got):
        a2, a1, a0 = np.polyfit(xs, np.log10(y + 1e-14), 2)
        disc = a1 * a1 - 4 * a2 * (a0 - spec)
        if a2 <= 0:
            plus, minus = cap, -cap
        elif disc < 0:
            plus = minus = 0.0
        else:
            plus, minus = min((-a1 + disc**0.5) / (2 * a2), cap), max((-a1 - disc**0.5) / (2 * a2), -cap)
        want = [minus, plus, -0.5 * (plus + minus), plus - minus, min(abs(plus), abs(minus))]
        assert np.allclose(list(row), want)
    missing = formulas.window_margins([1, 2], [F.lit(1.0)], spec, cap)
    assert set(one(spark, **missing).values()) == {None}


def test_margin_window_without_quadratic_part(spark):
    """Prices of quantity^2 * (1 - discount) have none: what the rounding leaves must be what the SQL leaves."""
    rows = [(float(round(q * q * (100 - d) / 100, 2)), float(q), d / 100) for q in range(1, 200) for d in range(0, 30)]
    df = spark.createDataFrame(rows, "PRICE double, QTY double, DISC double").selectExpr("*", "PRICE * (1 - DISC) AS NET", "PRICE / QTY AS UNIT")
    cols = formulas.window_margins([-1, 0, 1, 2], [F.col(c) for c in ("PRICE", "QTY", "NET", "UNIT")], float(np.log10(500.0)), 6.0)
    got = df.select("PRICE", "QTY", "DISC", cols["plus_margin"].alias("plus"), cols["minus_margin"].alias("minus")).collect()
    for r in got:
        y1, y2, y3, y4 = (math.log10(x + 1e-14) for x in (r["PRICE"], r["QTY"], r["PRICE"] * (1 - r["DISC"]), r["PRICE"] / r["QTY"]))
        a2, a1, a0 = (y1 - y2 - y3 + y4) / 4, (-11 * y1 + 3 * y2 + 7 * y3 + y4) / 20, (3 * y1 + 11 * y2 + 9 * y3 - 3 * y4) / 20
        dd = a1 * a1 - 4 * a2 * (a0 - float(np.log10(500.0)))
        plus, minus = (6, -6) if a2 <= 0 else (0, 0) if dd < 0 else (min((-a1 + math.sqrt(max(dd, 0.0))) / (2 * a2), 6), max((-a1 - math.sqrt(max(dd, 0.0))) / (2 * a2), -6))
        assert (r["plus"], r["minus"]) == pytest.approx((plus, minus), abs=1e-7), r


def test_lineage_with_shared_inputs_and_a_circle(spark):
    edges = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("y", "a")], "alias string, ref string")
    got = {(r["alias"], r["leaf"]) for r in formulas.lineage(edges).collect()}
    assert got == {("d", "a"), ("b", "a"), ("c", "a"), ("x", "a"), ("y", "a")}


def test_lineage_of_a_long_chain(spark, monkeypatch):
    """A thousand formulas on top of each other: about ten rounds, every pair written once."""
    written = []
    keep = formulas.staged
    monkeypatch.setattr(formulas, "staged", lambda df, name: written.append(keep(df, name)) or written[-1])
    edges = spark.createDataFrame([(f"f{k}", f"f{k - 1}" if k else "m") for k in range(1000)], "alias string, ref string").coalesce(2)
    got = formulas.lineage(edges).collect()
    assert {r["alias"] for r in got} == {f"f{k}" for k in range(1000)} and {r["leaf"] for r in got} == {"m"} and len(got) == 1000
    assert len(written) <= 12 and sum(w.count() for w in written) == 1000 * 1001 // 2


def test_radial_fit_against_polyfit(spark):
    rng = np.random.default_rng(5)
    lay = [("V", x, y, float(np.hypot(12 * x, 15 * y))) for x in range(7) for y in range(7)]
    pts = [("V", "S", "L", 1, "A", x, y, float(3 + 0.1 * r - 1e-4 * r**3 + rng.normal())) for _, x, y, r in lay]
    p = spark.createDataFrame(pts, "vehicle string, step_id string, lot_id string, wafer_id int, item string, chip_x int, chip_y int, value double")
    out = charts.radial_fits(p, spark.createDataFrame(lay, "mask string, chip_x int, chip_y int, chip_radius double")).collect()[0]
    r = np.array([row[3] for row in lay])
    want = np.polyfit((r - r.mean()) / r.std(), [row[7] for row in pts], 3)[::-1]
    assert np.allclose([out[f"c{k}"] for k in range(4)], want)


def test_radial_fit_by_both_routes(spark, monkeypatch):
    """A wafer too large for an array, and wafers with too few points or radii, by both routes."""
    lay = [("V", x, y, float(np.hypot(12 * x, 15 * y))) for x in range(5) for y in range(5)]
    pts = [("V", "S", "L", w, "A", x, y, float(x * x - 3 * y + w)) for w, n in ((1, 25), (2, 12), (3, 3)) for _, x, y, r in lay[:n]]
    pts += [("V", "S", "L", 4, "A", 1, 1, float(k)) for k in range(9)]
    p = spark.createDataFrame(pts, "vehicle string, step_id string, lot_id string, wafer_id int, item string, chip_x int, chip_y int, value double")
    layout = spark.createDataFrame(lay, "mask string, chip_x int, chip_y int, chip_radius double")
    got = []
    for bound in (0, 15, 10_000):
        monkeypatch.setattr(ordered, "ALONE", bound)
        got.append({r["wafer_id"]: [r[f"c{k}"] for k in range(4)] for r in charts.radial_fits(p, layout).collect()})
    assert set(got[0]) == {1, 2}
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(np.allclose(other[w], got[0][w]) for w in other)


def test_wafer_circle_falls_back(spark):
    flat = spark.createDataFrame([("V", x, y, 7.0) for x in range(3) for y in range(3)], "mask string, chip_x int, chip_y int, chip_radius double")
    r = charts.wafer_circle(flat).collect()[0]
    assert not r["fitted"] and r["cx"] == 1.0 and r["semi_x"] == pytest.approx(2**0.5 * 1.05)


def test_aggregate_names(spark):
    table = {"A": "P90", "B*": "MEAN", "M": "P5"}
    names = ["A", "BX", "M_new", "my_Window", "other"]
    want = ["P90", "MEAN", "P5", "P10", None]
    assert [testlevel.aggregate_spec(n, table) for n in names] == want
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(testlevel.aggregate_spec_column("n", table)).collect()] == want
    assert [testlevel.quantile_of(s) for s in ("P10", "avg", "median", "?", "P250")] == [0.1, None, 0.5, 0.5, 1.0]


def test_dictionary_checks(spark):
    good = item_frame(spark, [Item("REAL", "A", "a"), Item("ADDP", "B", formula="{A}")])
    assert dictionary.valid(good)
    bad = item_frame(spark, [Item("REAL", "A", "a"), Item("REAL", "B", "a"), Item("ADDP", "C"), Item("REAL", "D", " "), Item("X", "E")])
    assert {r["check_name"]: r["offenders"] for r in dictionary.row_checks(bad).collect()} == {
        "not empty": 0, "known category": 1, "measured item has id": 1, "derived item has formula": 1, "item id unique": 1}
    assert not dictionary.valid(good.limit(0)) and not dictionary.valid(good.drop("formula"))


def test_day_partitions(spark, tmp_path):
    root = str(tmp_path / "m")
    row = lambda d, v: ("V", dt.date(2024, 1, d), f"L{d}", v)
    schema = "vehicle string, date date, lot_id string, value double"
    measurements.write_days(spark.createDataFrame([row(1, 1.0), row(2, 2.0)], schema), root)
    measurements.write_days(spark.createDataFrame([row(2, 5.0)], schema), root)
    assert sorted((r["lot_id"], r["value"]) for r in spark.read.parquet(root).collect()) == [("L1", 1.0), ("L2", 5.0)]
    recent = measurements.read_days(spark, root, "2024-01-03", 1, ["V"])
    assert [r["value"] for r in recent.collect()] == [5.0]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [isnotnull(vehicle" in plan


def test_archive_and_basis(spark, tmp_path):
    df = spark.createDataFrame([("V", "S", "L", [1, 2])], "vehicle string, step_id string, lot_id string, xs array<int>")
    for _ in range(2):
        sinks.write_archive(str(tmp_path), "2024-01-01", findings=df)
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 1
    sinks.write_basis(df, f"{tmp_path}/basis")
    assert spark.read.option("header", True).csv(f"{tmp_path}/basis").collect()[0]["xs"] == "[1,2]"
    assert sinks.target_rows(df, df).count() == 1
    assert ledger.write_ledger(df, str(tmp_path / "ledger")) == 1
    assert ledger.ledger_as_of(spark, str(tmp_path / "ledger")).count() == 1


def test_completion_delay_and_memory(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("V_L1_S300", t), ("V_L2_S300", t), ("V_L3_S300", dt.datetime(2024, 1, 2)), ("V_L4_S300", t)], "prime_key string, tkout_time timestamp")
    wip = spark.createDataFrame([("L1", "S350", t, 1), ("L2", "S400", t, 1), ("L3", "T1", t, 1), ("L4", "S310", t, 1)], "lot_id string, lot_current_loc string, last_update_date timestamp, o_orderkey long")
    before = spark.createDataFrame([("V_L4_S300", True)], "prime_key string, done boolean")
    got = {r["lot_id"]: (r["done"], r["newly_done"]) for r in ledger.completion(log, wip, before, "2024-01-02 00:30:00", 60).collect()}
    assert got == {"L1": (False, False), "L2": (True, True), "L3": (False, False), "L4": (True, False)}
