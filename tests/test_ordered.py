"""Order statistics with a group that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waferlake.functions import ordered, robust

@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(900) < 0.34, "hot", rng.integers(0, 30, 900).astype(str))
    return pd.DataFrame({"k": keys, "v": np.round(rng.normal(10, 3, 900), 1), "id": np.arange(900)})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed).cache()


def test_quantiles(frame, skewed):
    got = ordered.quantiles(frame, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("k").sort_index()
    want = skewed.groupby("k")["v"].quantile([0.1, 0.5, 0.93]).unstack().sort_index()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_running(frame, skewed):
    got = ordered.running(frame, ["k"], ["v", "id"], {"pos": F.lit(1), "total": "id"}).toPandas().sort_values("id")
    want = skewed.sort_values(["v", "id"])
    g = want.groupby("k")
    want = want.assign(pos=g.cumcount() + 1, total=g["id"].cumsum()).sort_values("id")
    assert (got["pos"].to_numpy() == want["pos"].to_numpy()).all()
    assert (got["total"].to_numpy() == want["total"].to_numpy()).all()


def test_share_below(spark, frame, skewed):
    probes = pd.DataFrame([(k, p) for k in skewed["k"].unique() for p in (8.0, 10.05, 99.0)], columns=["k", "p"])
    got = ordered.share_below(frame, spark.createDataFrame(probes), ["k"], "v", "p").toPandas()
    assert len(got) == len(probes)
    for k, p, pct in got[["k", "p", "pctile"]].itertuples(index=False):
        vs = skewed[skewed["k"] == k]["v"]
        assert pct == pytest.approx((vs < p).mean() * 100)


def robust_pair(values):
    """Median, and the first positive of three spreads, from one sorted array."""
    a = np.sort(np.asarray(values, float))
    low, mid, high = np.percentile(a, [25, 50, 75])
    spreads = (1.4826 * np.median(np.abs(a - mid)), (high - low) / 1.349, a.std(ddof=1) if len(a) > 1 else 0.0)
    return mid, next((x for x in spreads if x > 0), None)


def test_profile(frame, skewed):
    got = robust.profile(frame, ["k"], "v").toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        med, spread = robust_pair(g["v"])
        assert got.loc[k, "median"] == pytest.approx(med)
        assert (got.loc[k, "spread"] == pytest.approx(spread)) if spread else pd.isna(got.loc[k, "spread"])
        assert got.loc[k, "n"] == len(g)


def test_fallback_chain(spark):
    rows = {
        "mad": [1.0, 2.0, 4.0, 8.0],
        "iqr": [5.0, 5.0, 5.0, 9.0, 9.0],
        "std": [5.0] * 9 + [6.0],
        "none": [3.0, 3.0, 3.0],
        "one": [7.0],
    }
    by_hand = {"mad": (3.0, 1.4826 * 1.5), "iqr": (5.0, 4 / 1.349), "std": (5.0, 0.1**0.5), "none": (3.0, None), "one": (7.0, None)}
    df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in robust.profile(df, ["k"], "v").collect()}
    for k, vs in rows.items():
        med, spread = by_hand[k]
        assert got[k]["median"] == med
        assert got[k]["spread"] == (pytest.approx(spread) if spread else None)
    assert got["one"]["std"] == 0.0


def test_wide_equals_long(spark, frame):
    wide = frame.withColumn("w", F.when(F.col("id") % 3 > 0, F.col("v") * 2))
    cols = ["k", "item", "n", "median", "std", "spread", "v_min", "v_max"]
    a = robust.profile_wide(wide, ["k"], ["v", "w"]).select(cols).toPandas()
    long = wide.unpivot(["k"], ["v", "w"], "item", "x").where("x is not null")
    b = robust.profile(long, ["k", "item"], "x").select(cols).toPandas()
    key = ["k", "item"]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))


def test_hard_values(spark):
    """Null keys and values, infinities, zeros of both signs, tiny, huge and nearly equal numbers."""
    inf = float("inf")
    near = [1.0 + k * 2.0**-52 for k in range(700)]
    rows = {None: [1.0, 2.0, 4.0], "edge": [-inf, -1e300, -1e-310, 0.0, 0.0, 1e-310, 1e300, inf, 5.0], "near": near, "down": [-x for x in near], "geo": [2.0**k for k in range(-500, 500)], "null": [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "k string, v double")
    at = lambda vs, x: vs[int(x)] if x == int(x) else vs[int(x)] * (1 - x % 1) + vs[int(x) + 1] * (x % 1)
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == set(rows) - {"null"}
    for k, vs in rows.items():
        if k != "null":
            assert [got[k][c] for c in "abc"] == pytest.approx([at(sorted(vs), p * (len(vs) - 1)) for p in (0.25, 0.5, 1.0)], rel=1e-15), k
    nan = spark.createDataFrame([("x", v) for v in (1.0, float("nan"), 3.0)], "k string, v double")
    assert ordered.quantiles(nan, ["k"], "v", {"b": 0.5}).head()["b"] == 3.0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_one_group_of_five_million(spark, adaptive):
    """The plan of any other group: no array, no task with the whole group."""
    n = 5_000_000
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    try:
        # a permutation of 0 .. n-1, since the factor and n have no common divisor
        df = spark.range(n).selectExpr("'hot' AS k", f"CAST(id * 7919 % {n} AS DOUBLE) AS v").unionByName(spark.range(9).selectExpr("'cold' AS k", "CAST(id AS DOUBLE) AS v"))
        got = {r["k"]: r for r in robust.profile(df, ["k"], "v").collect()}
        assert (got["hot"]["n"], got["hot"]["median"], got["hot"]["v_max"]) == (n, (n - 1) / 2, n - 1.0)
        assert got["hot"]["spread"] == pytest.approx(1.4826 * n / 4) and got["cold"]["median"] == 4.0
        pos = ordered.running(df, ["k"], ["v"], {"pos": F.lit(1)})
        assert pos.where("pos <> v + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")


def test_arrays_and_bins_agree(spark, frame, skewed, monkeypatch):
    """Groups gathered as arrays, and those too large for one, side by side and each alone."""
    cols = ["k", "n", "median", "std", "spread", "v_min", "v_max"]
    wide = frame.withColumn("w", F.when(F.col("id") % 3 > 0, F.col("v") * 2))
    got = []
    for bound in (0, 40, 10_000):
        monkeypatch.setattr(ordered, "ALONE", bound)
        p = robust.profile(frame, ["k"], "v", values=True)
        kept = {r["k"] for r in p.where("values IS NOT NULL").select("k").collect()}
        assert kept == {k for k, n in skewed.groupby("k").size().items() if n <= bound}
        q = ordered.quantiles(frame, ["k"], "v", {"a": 0.1, "b": 0.5})
        w = robust.profile_wide(wide, ["k"], ["v", "w"]).select("item", *cols).toPandas().sort_values(["k", "item"], ignore_index=True)
        got.append([p.select(cols).toPandas().sort_values("k", ignore_index=True), q.toPandas().sort_values("k", ignore_index=True), w])
    for other in got[1:]:
        for a, b in zip(got[0], other):
            pd.testing.assert_frame_equal(a, b)


def test_values_cross_shuffles_as_arrays(spark):
    """A value of a small group is written once, in its group's array, not as a bin of its own with all keys."""
    rows = spark.range(40_000).selectExpr("CAST(id DIV 20 AS STRING) AS k", "CAST(hash(id) AS DOUBLE) AS v").coalesce(1)
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert robust.profile(rows, ["k"], "v").count() == 2_000
    assert written() - before < 10_000


def test_share_below_over_ranges(spark):
    """Ties, null keys and probes between, below and above the values, with groups cut over many ranges."""
    rows = [(None if i % 3 else "a", float(i % 40)) for i in range(900)]
    probes = [(k, p) for k in (None, "a") for p in (-1.0, 0.0, 7.0, 7.5, 39.0, 99.0)] + [("absent", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.share_below(df, spark.createDataFrame(probes, "k string, p double"), ["k"], "v", "p").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for k, p in probes[:-1]:
        vs = [v for key, v in rows if key == k]
        want[k, p] = 100.0 * sum(v < p for v in vs) / len(vs)
    assert {(r["k"], r["p"]): r["pctile"] for r in got} == pytest.approx(want)


def test_aggregates_beside_quantiles(spark, frame, monkeypatch):
    """Further aggregates and groups without values, by both routes."""
    more = {"top": F.max("v"), "rows": F.count("*")}
    df = frame.select("k", "v").unionByName(spark.sql("SELECT 'none' AS k, CAST(NULL AS DOUBLE) AS v"))
    got = []
    for bound in (0, 10_000):
        monkeypatch.setattr(ordered, "ALONE", bound)
        q = ordered.quantiles(df, ["k"], "v", {"m": 0.5}, more, within=["k"], empty=True)
        got.append(q.toPandas().sort_values("k", ignore_index=True))
        assert ordered.quantiles(df, ["k"], "v", {"m": 0.5}, more).where("k = 'none'").isEmpty()
    pd.testing.assert_frame_equal(*got)
    assert got[0].set_index("k").loc["none", "rows"] == 1


def test_quantiles_wide(spark, monkeypatch):
    """Arrays and bins give the medians of the long form; a column without values gives no row."""
    rows = [("a", float(i), None if i % 3 else float(-i)) for i in range(40)] + [("b", 1.0, None), (None, 2.0, 5.0)]
    wide = spark.createDataFrame(rows, "k string, v double, w double")
    long = wide.unpivot(["k"], ["v", "w"], "item", "x")
    want = sorted(map(tuple, ordered.quantiles(long, ["k", "item"], "x", {"m": 0.5, "q": 0.9}).collect()), key=str)
    assert len(want) == 5
    for alone in (10_000, 7):
        monkeypatch.setattr(ordered, "ALONE", alone)
        got = ordered.quantiles_wide(wide, ["k"], ["v", "w"], {"m": 0.5, "q": 0.9})
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_share_below_sorts_values_near_probes_only(spark, monkeypatch):
    """Bins without a probe travel as one row each, whatever they hold."""
    seen, real = [], ordered.staged

    def staged(df, name, *rest):
        if name == "ranges":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, *rest)

    monkeypatch.setattr(ordered, "staged", staged)
    values = [0.0, -0.0, -3.0, float("nan"), float("inf"), None, *[i / 7 for i in range(700)]]
    probes = [("k", p) for p in (-3.0, 0.0, 50.0, 50.01, 1e9, float("inf"), float("nan"))]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = {repr(r["p"]): r["pctile"] for r in ordered.share_below(df, spark.createDataFrame(probes, "k string, p double"), ["k"], "v", "p").collect()}
    known = [v for v in values if v is not None]
    least = lambda v, p: p == p and v < p or (p != p and v == v)  # NaN is the greatest
    assert got == {repr(p): pytest.approx(100 * sum(least(v, p) for v in known) / len(known)) for _, p in probes}
    assert len(seen) == 1 and "LeftAnti" in seen[0]
