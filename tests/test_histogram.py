"""Large groups counted by bins, and shots that travel once."""

import numpy as np
import pytest

from checks import catalog
from waferlake import fixtures
from waferlake.functions import histogram, ordered, robust, runs
from waferlake.operators import charts, order, reshape
from waferlake.schema import SITE, WAFER, Item, item_frame

FIGURES = ["n", "median", "std", "spread", "v_min", "v_max"]


def groups(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("a", 900), ("b", 401), (None, 300), ("c", 1)):
        for _ in range(n):
            rows.append((k, float(rng.normal(0, 1e3)), float(rng.integers(-2, 3)), None if rng.random() < 0.3 else float(np.round(rng.gamma(2, 50), 2)), 7.0))
    return spark.createDataFrame(rows, "k string, wide double, few double, gaps double, flat double").repartition(5)


def figures(df):
    return {(r["k"], r["item"]): [r[f] for f in FIGURES] for r in df.collect()}


@pytest.mark.parametrize("cells, chunk", [(4096, 200_000), (4, 37)])
def test_bins_equal_sorted_arrays(spark, monkeypatch, cells, chunk):
    """Quartiles, deviation and median distance of groups in bins, in one round of cells or many, against arrays."""
    df, items = groups(spark), ["wide", "few", "gaps", "flat"]
    want = figures(robust.profile_wide(df, ["k"], items))
    monkeypatch.setattr(ordered, "ALONE", 300)
    monkeypatch.setattr(histogram, "CELLS", cells)
    monkeypatch.setattr(histogram, "CHUNK", chunk)
    got = figures(robust.profile_wide(df, ["k"], items))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for a, b in zip(got[key], row):
            assert a == b if b is None else a == pytest.approx(b, rel=1e-12), key


def test_bins_leave_the_unbounded_to_the_other_route(spark, monkeypatch):
    """Infinite values, and more groups than the driver may hold bins of."""
    df = spark.createDataFrame([("a", float(v)) for v in [*range(50), float("inf")]], "k string, v double")
    assert histogram.profile(df, ["k"], ["v"], df.select("k").distinct(), {"median": 0.5}) is None
    monkeypatch.setattr(histogram, "MOST_GROUPS", 0)
    assert histogram.profile(df.where("v < 9"), ["k"], ["v"], df.select("k").distinct(), {"median": 0.5}) is None


def test_baseline_makes_wafers_once(spark, sf):
    """What is left to compute reads the stored figures of the wafers, not the shots."""
    out = catalog.QUERIES["product_wafer_baseline"](spark, sf)
    assert "wafer_id" not in out._jdf.queryExecution().toString()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_measurement_order_deals_shots_once(spark, sf):
    """One shuffle, of the source's rows."""
    out = catalog.QUERIES["measurement_order"](spark, sf)
    assert exchanges(out) == 1, out._jdf.queryExecution().executedPlan().toString()


def test_measurement_order_of_wide_shots_with_gaps(spark):
    """Shots on which some items are missing have no place in the order of these."""
    items = [Item("REAL", "A", spec_high=5.0), Item("REAL", "B", spec_low=2.0, spec_high=4.0), Item("REAL", "C")]
    rng = np.random.default_rng(8)
    value = lambda: None if rng.random() < 0.3 else float(rng.integers(0, 8))
    rows = [("V", "S", f"L{w % 2}", w, x, y, t, value(), value(), value()) for w in range(4) for x in range(3) for y in range(3) for t in range(2)]
    shots = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, chip_x int, chip_y int, tkout_time int, A double, B double, C double")
    cols = [*WAFER, "item", *SITE, "value", "out", "seq_no", "out_no"]
    got = order.measurement_order_met(shots, items).select(cols).collect()
    want = order.measurement_order(reshape.points(shots, ["A", "B", "C"], [*WAFER, *SITE]), item_frame(spark, items)).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 80


def test_shots_meet_only_where_reports_fit_an_array(spark, sf, monkeypatch):
    """Reports too large for an array go the former way, with equal rows."""
    want = sorted(map(tuple, catalog.QUERIES["measurement_order"](spark, sf).collect()))
    monkeypatch.setattr(ordered, "ALONE", 10)
    assert fixtures.li_shots_met(spark, sf, WAFER) is None
    assert sorted(map(tuple, catalog.QUERIES["measurement_order"](spark, sf).collect())) == want


def test_radial_fits_deal_shots_once(spark, sf):
    """One shuffle, of the source's rows; the layout, which is small, is sent to them."""
    out = catalog.QUERIES["radial_fits"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_radial_sums_of_wide_shots_with_gaps(spark, monkeypatch, chunk):
    """Fits of items that miss on some shots, on wafers with few points or radii and on sites without a radius, in one chunk or many."""
    rng = np.random.default_rng(2)
    lay = [("V", x, y, None if (x, y) == (2, 2) else float(np.hypot(12 * x, 15 * y))) for x in range(5) for y in range(5)]
    value = lambda: None if rng.random() < 0.2 else float(rng.normal(50, 9))
    rows = [("V", "S", lot, w, x, y, 0, value(), None, value()) for lot in ("L", None) for w, n in ((1, 25), (2, 12), (3, 3)) for _, x, y, _ in lay[:n]]
    rows += [("V", "S", "L", 4, 1, 1, t, 1.0, None, 2.0) for t in range(9)]
    shots = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, wafer_id int, chip_x int, chip_y int, tkout_time int, A double, B double, C double")
    layout = spark.createDataFrame(lay, "mask string, chip_x int, chip_y int, chip_radius double")
    points = reshape.points(shots.fillna("none", ["lot_id"]), ["A", "B", "C"], [*WAFER, *SITE])
    fits = lambda df: {(r["lot_id"] or "none", r["wafer_id"], r["item"]): [r["n"], *(r[f"c{k}"] for k in range(4))] for r in df.collect()}
    want = fits(charts.radial_fits(points, layout))
    monkeypatch.setattr(runs, "CHUNK", chunk)
    got = fits(charts.radial_fits_met(shots.repartition(*WAFER), ["A", "B", "C"], layout))
    assert got.keys() == want.keys() and len(want) == 8
    for key, row in want.items():
        assert got[key] == pytest.approx(row, rel=1e-9), key


def test_shares_of_wide_shots_equal_counting(spark, monkeypatch):
    """Shares below probes among and beside the values, equal ones too, of items with gaps; and of a group without values."""
    monkeypatch.setattr(histogram, "CHUNK", 50)
    rng = np.random.default_rng(4)
    pick = [lambda: float(rng.integers(-3, 4)) / 2, lambda: None if rng.random() < 0.3 else float(rng.gamma(2, 50)), lambda: None]
    rows = [(k, *[p() for p in pick]) for k in ("a", "b", None) for _ in range(400)]
    shots = spark.createDataFrame(rows, "k string, few double, gaps double, empty double").repartition(6)
    asked = {(k, i, v) for k in ("a", None) for i, values in (("few", [-9.0, -0.5, 0.0, 0.25, 1.5, 9.0]), ("gaps", [0.0, 60.0, rows[7][2] or 1.0, 1e9]), ("empty", [1.0])) for v in values}
    probes = spark.createDataFrame(list(asked), "k string, item string, at double")
    points = shots.unpivot(["k"], ["few", "gaps", "empty"], "item", "value")
    for wide in (None, (shots, ["few", "gaps", "empty"])):
        got = {(r["k"], r["item"], r["at"]): r["pctile"] for r in ordered.share_below(points, probes, ["k", "item"], "value", "at", wide).collect()}
        assert got.keys() == {a for a in asked if a[1] != "empty"}
        for (k, i, v), share in got.items():
            own = [r[1 + ["few", "gaps"].index(i)] for r in rows if r[0] == k]
            own = [x for x in own if x is not None]
            assert share == pytest.approx(100 * sum(x < v for x in own) / len(own)), (wide, k, i, v)


def test_context_is_made_once_for_the_rule_table(spark, sf):
    """Facts, categories, counts and reports read the stored context, not the shots or packs."""
    out = catalog.QUERIES["rule_table_trace"](spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "wafer_id" not in plan and "/packs-" not in plan and out.count() == 14 * out.select("vehicle", "step_id", "lot_id").distinct().count()


def test_context_without_row_functions_in_arrays(spark, sf):
    """What is counted of packs is counted in batches; the context still equals that of shots that are not packed."""
    from checks.core import li
    from dataclasses import replace

    r = li(spark, sf)
    packed, plain = r.packed(), replace(r.stored(), packs=None)
    assert "MapInArrow" in packed.wafers()._jdf.queryExecution().executedPlan().toString()
    rows = lambda df, cols: sorted((tuple(x) for x in df.select(*cols).collect()), key=lambda x: tuple(map(str, x[:cols.index("item") + 1])))
    keys = ["vehicle", "step_id", "lot_id"]
    for cols, own in (
        ([*WAFER, "item", "n", "median", "std", "spread", "v_min", "v_max"], lambda x: x.wafers()),
        ([*keys, "item", "seq_run", "seq_dead", "seq_front", "seq_back"], lambda x: x.sequence()),
        ([*keys, "item", "target_median", "pctile"], lambda x: x.target_percentile()),
    ):
        got, want = rows(own(packed), cols), rows(own(plain), cols)
        assert len(got) == len(want) > 0
        for a, b in zip(got, want):
            assert all(x == y or x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b)), (a, b)
    assert all(sorted(v["values"]) == v["values"] and len(v["values"]) == v["n"] for v in packed.wafers().limit(50).collect())
