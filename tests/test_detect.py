import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waferlake import fixtures as fx
from waferlake.functions import ordered
from waferlake.operators import board, detect, order, spatial
from waferlake.plans.report import Report
from waferlake.schema import WAFER, Item, Limits, item_frame


def scored(spark, vals, direction, lim=Limits(), others=40):
    """One wafer with the given values among calm wafers of spread about one."""
    calm = [("V", "S", f"L{i}", 1, "A", float(x)) for i in range(others) for x in (9, 9.4, 10, 10.6, 11)]
    rows = calm + [("V", "S", "T", 2, "A", float(v)) for v in vals]
    pts = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, item string, value double")
    items = item_frame(spark, [Item("REAL", "A", direction=direction)])
    w = detect.wafer_stats(pts)
    out = detect.score_wafers(w, detect.product_baseline(w), items, pts, lim)
    return out.where("lot_id = 'T'").collect()[0]


def test_flier_direction_is_relaxed_on_the_off_side(spark):
    # calm wafers: typical spread 1.4826 * 0.6, so 3.5 sigma is about 3.1 and 7 sigma about 6.2
    base = [9.4, 10, 10, 10, 10.6]
    assert scored(spark, [*base, 14], "UPPER")["flier_count"] == 1
    assert scored(spark, [*base, 6], "UPPER")["flier_count"] is None
    assert scored(spark, [*base, 3], "UPPER")["flier_count"] == 1
    assert scored(spark, [*base, 6], "LOWER")["flier_count"] == 1
    assert scored(spark, [*base, 14], "LOWER")["flier_count"] is None
    assert scored(spark, [*base, 14, 6], None)["flier_count"] == 2


def test_flier_needs_five_points_and_respects_the_cap(spark):
    assert scored(spark, [10, 10, 10, 20], "UPPER")["flier_count"] is None
    two = [9.4, 10, 10, 10, 10.6, 15, 16]
    assert scored(spark, two, "UPPER")["flier_count"] == 2
    assert scored(spark, two, "UPPER", Limits(flier_max_points=1))["flier_count"] is None


def test_one_built_in_finding_per_item_and_class_order(spark, sf):
    r = Report(fx.li_shots(spark, sf), fx.LI_ITEMS, Limits()).ranked().toPandas()
    assert not r.duplicated(["vehicle", "step_id", "lot_id", "item"]).any()
    assert (r[r["type"] == "SPEC_OUT"]["priority"] >= 20000).all()
    assert r[r["type"] != "SPEC_OUT"]["priority"].between(10000, 19999).all()


def test_missing_bound_fails_a_two_sided_pass(spark):
    pts = spark.createDataFrame([("A", 5.0), ("B", 5.0), ("C", 5.0)], "item string, value double")
    items = item_frame(spark, [Item("REAL", "A", spec_low=1.0, direction="BOTH"), Item("REAL", "B", spec_low=1.0, direction="LOWER"), Item("REAL", "C", spec_high=4.0, direction=" upper")])
    got = {r["item"]: r["pass"] for r in board.pass_flags(pts, items).collect()}
    assert got == {"A": 0, "B": 1, "C": 0}


def test_runs_and_halves(spark):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 0, 1]
    rows = [("V", "S", "L", 1, "A", i % 5, i // 5, 0, 9.0 if f else 1.0) for i, f in enumerate(flags)]
    pts = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, item string, chip_x int, chip_y int, tkout_time int, value double")
    seq = order.measurement_order(pts, item_frame(spark, [Item("REAL", "A", spec_high=5.0)]))
    r = order.wafer_sequence(seq, Limits()).collect()[0]
    assert (r["run"], r["dead"], r["front"], r["back"]) == (3, 0.6, 0.8, 0.4)


def test_sequences_by_both_routes(spark, monkeypatch):
    """Wafers put in order as arrays and by running sums: the same as by the order of all points."""
    rows = [("V", "S", "L", w, "A", i % 5, i // 5, 0, 9.0 if (i * i * w) % 7 < 3 else 1.0) for w, n in ((1, 23), (2, 4), (3, 10), (4, 61)) for i in range(n)]
    pts = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, item string, chip_x int, chip_y int, tkout_time int, value double")
    items = item_frame(spark, [Item("REAL", "A", spec_high=5.0)])
    cols = ["wafer_id", "n", "run", "dead", "front", "back"]
    want = sorted(map(tuple, order.wafer_sequence(order.measurement_order(pts, items), Limits()).select(cols).collect()))
    assert [r[0] for r in want] == [1, 3, 4]
    for bound in (0, 20, 10_000):
        monkeypatch.setattr(ordered, "ALONE", bound)
        assert sorted(map(tuple, order.wafer_sequences(pts, items, Limits()).select(cols).collect())) == want


def sites(spark, xy):
    return spark.createDataFrame([("V", "S", "L", "A", x, y, 1, 1) for x, y in xy], "vehicle string, step_id string, lot_id string, item string, chip_x int, chip_y int, points int, wafers int")


def grid(spark):
    df = spark.createDataFrame([("V", x, y) for x in range(-5, 6) for y in range(-5, 6)], "vehicle string, chip_x int, chip_y int")
    return df.withColumn("radius", F.hypot("chip_x", "chip_y"))


@pytest.mark.parametrize("xy,label", [
    ([(5, 5), (5, 4), (4, 5), (3, 3), (2, 3), (3, 2)], "clock 2"),
    ([(-5, -5), (-5, -4), (-4, -5), (-3, -3), (-2, -3), (-3, -2)], "clock 8"),
    ([(2, -5), (2, -4), (2, 0), (2, 3), (2, 5)], "vertical line"),
    ([(0, 0), (1, 0), (0, 1), (-1, 0), (1, -1)], "center"),
    ([(1, 1), (2, 2)], "few points"),
    ([(x, y) for x in range(-5, 6) for y in range(-5, 1)], "whole wafer"),
])
def test_spatial_labels(spark, xy, label):
    out = spatial.verdict(spatial.shape_metrics(sites(spark, xy), grid(spark))).collect()[0]
    assert out["pattern"] == label


def test_sequences_wide(spark, monkeypatch):
    """Shots with two bits an item give what their points give: missing values, one-sided specs, over 31 items, large wafers."""
    from waferlake.operators.reshape import points
    from waferlake.schema import SITE

    items = [Item("REAL", f"I{n}", spec_low=2.0 if n % 2 else None, spec_high=None if n % 3 else 7.0) for n in range(60)]
    names = [i.alias for i in items]
    rng = np.random.default_rng(3)
    rows = []
    for w, n in ((1, 30), (2, 6), (3, 4)):
        for p in range(n):
            rows.append(("V", "S", "L", w, p % 5, p // 5, p % 2, *[None if rng.random() < 0.2 else float(rng.integers(0, 10)) for _ in names]))
    head = "vehicle string, step_id string, lot_id string, wafer_id int, chip_x int, chip_y int, tkout_time int, "
    shots = spark.createDataFrame(rows, head + ", ".join(f"{n} double" for n in names))
    cols = [*WAFER, "item", "n", "run", "dead", "front", "back"]
    for alone in (10_000, 10):
        monkeypatch.setattr(ordered, "ALONE", alone)
        long = order.wafer_sequences(points(shots, names, [*WAFER, *SITE]), item_frame(spark, items), Limits())
        wide = order.wafer_sequences_wide(shots, items, Limits())
        assert sorted(map(tuple, wide.select(cols).collect())) == sorted(map(tuple, long.select(cols).collect()))


def test_wafers_stay_where_they_are_for_their_product(spark, monkeypatch):
    """The product's figures are stored, so that their size is known and the wafers are not dealt by product."""
    seen, real = [], detect.staged
    monkeypatch.setattr(detect, "staged", lambda df, name, *rest: seen.append(name) or real(df, name, *rest))
    rows = [("V", "S", "L", w, "A", float(w * p)) for w in (1, 2) for p in range(6)]
    pts = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, item string, value double")
    w = detect.wafer_stats(pts)
    items = item_frame(spark, [Item("REAL", "A", spec_high=6.0)])
    out = detect.score_wafers(w, detect.product_baseline(w), items, pts, Limits())
    assert "baseline" in seen and out.count() == 2
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_metrics_wide(spark, monkeypatch):
    from waferlake.operators import testlevel
    from waferlake.schema import REPORT

    items = [Item("REAL", "A", spec_low=1.0, spec_high=8.0), Item("REAL", "B", spec_high=5.0, direction="UPPER"), Item("REAL", "C")]
    rows = [("V", "S", lot, float(p), float(p * p % 11) if p % 4 else None, 3.0 if lot == "L1" else None) for lot, n in (("L1", 25), ("L2", 1), ("L3", 8)) for p in range(n)]
    shots = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, A double, B double, C double")
    cols = [*REPORT, "item", "target_median", "target_std", "pop_median", "pop_std", "spec_out_count", "deviation"]
    flat = lambda df: sorted(([x if not isinstance(x, float) else round(x, 9) for x in r] for r in df.select(cols).collect()), key=str)
    points = shots.unpivot(REPORT, ["A", "B", "C"], "item", "value").where("value IS NOT NULL")
    for alone in (10_000, 9):
        monkeypatch.setattr(ordered, "ALONE", alone)
        dim = item_frame(spark, items)
        assert flat(testlevel.metrics_wide(shots, ["A", "B", "C"], dim)) == flat(testlevel.metrics(points, dim))


def test_formulas_are_not_stored(spark, sf, monkeypatch):
    """Stored shots hold what was measured; columns that follow from a row are made again and equal the first ones."""
    from checks.core import li
    from waferlake.plans import report

    written, real = [], report.staged
    monkeypatch.setattr(report, "staged", lambda df, name, *rest: written.append(df.columns) or real(df, name, *rest))
    r = li(spark, sf)
    kept = r.stored()
    assert written and not set(written[0]) & set(r.made) and kept.stored() is kept and kept.shots.columns == r.shots.columns
    assert r.shots.exceptAll(kept.shots).isEmpty() and kept.shots.exceptAll(r.shots).isEmpty()


def test_packed_reports(spark, monkeypatch):
    """Reports whose shots are one array give what stored shots give, small and too large; no wafer is written with its values."""
    from waferlake.functions import formulas
    from waferlake.plans import report

    items = [Item("REAL", "A", spec_low=1.0, spec_high=8.0), Item("REAL", "B", spec_high=5.0, direction="UPPER"),
             Item("ADDP", "C", formula="rmax({A}*{B},{B}/{A})", spec_high=30.0), Item("ADDP", "D", formula="{C}-{A}")]
    rng = np.random.default_rng(5)
    rows = [("V", "S", lot, w, p % 5, p // 5, p % 2, float(rng.integers(0, 10)), None if rng.random() < 0.2 else float(rng.random() * 7))
            for lot, wafers, n in (("L1", 3, 9), ("L2", 2, 6), ("L3", 1, 1), ("L4", 2, 14)) for w in range(wafers) for p in range(n)]
    shots = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, chip_x int, chip_y int, tkout_time int, A double, B double")
    made = lambda df: formulas.add_formulas(df, items).frame
    written, real = [], report.staged
    monkeypatch.setattr(report, "staged", lambda df, name, *rest: written.append((name, df.columns)) or real(df, name, *rest))
    flat = lambda df: sorted(([x if not isinstance(x, float) else round(x, 9) for x in r] for r in df.select(sorted(df.columns)).collect()), key=str)
    for alone, large in ((10_000, 0), (20, 2)):
        monkeypatch.setattr(ordered, "ALONE", alone)
        r = Report(made(shots), items, Limits(min_wafer_points=2), row_columns=made, made=["C", "D"], row_values=lambda m: formulas.row_values(m, items))
        stored, packed = r.stored(), r.packed()
        assert packed.packed() is packed and packed.packs.count() == 4 - large and (packed.rest is None) == (not large)
        want = [flat(df) for df in (stored.scored(), stored.sequence(), stored.target_percentile())]
        written.clear()
        assert [flat(df) for df in (packed.scored(), packed.sequence(), packed.target_percentile())] == want
        assert written and not any("values" in columns for _, columns in written)
    with pytest.raises(ValueError):
        formulas.row_values({"A": F.col("A")}, [Item("ADDP", "G", formula="STD({A})")])
