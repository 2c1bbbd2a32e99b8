import itertools
import random

import pytest
from pyspark.sql import functions as F

from waferlake.operators import digest, rules, ruletable
from waferlake.operators.rules import Atom, Branch, ChainedRule, ItemRule

CTX = ("vehicle string, step_id string, lot_id string, item string, cat2 string, level int, disp_ratio double, rep_median double, rep_std double, "
       "rstd_ratio double, n_out int, spec_high double")


@pytest.fixture(scope="module")
def ctx(spark):
    rows = [
        ("V", "S", "L1", "A", "X", 2, 1.0, 5.0, 0.5, 0.5, 3, 10.0), ("V", "S", "L1", "B", "X", 0, 2.0, 6.0, 0.6, 0.7, 0, None), ("V", "S", "L1", "C", "Y", 1, 3.0, 7.0, 0.7, 0.9, 0, None),
        ("V", "S", "L2", "A", "X", 0, 3.0, 9.5, 0.5, 0.9, 0, 10.0), ("V", "S", "L2", "B", "X", 1, 2.0, 6.0, 0.6, 0.7, 0, None),
    ]
    return spark.createDataFrame(rows, CTX)


def matched(ctx, rule):
    return {r["lot_id"]: (r["matched"], r["result"]) for r in rules.rule_trace(ctx, [rule]).collect()}


def test_item_rules(ctx):
    hit = lambda **k: {l: m for l, (m, _) in matched(ctx, ItemRule(**k)).items()}
    assert hit(items=("A",), condition={"grade": ">=abnormal"}) == {"L1": True, "L2": False}
    assert hit(items=("A", "B"), condition={"grade": ">=caution", "logic": "all"}) == {"L1": False, "L2": False}
    assert hit(items=("A", "B"), condition={"grade": ">=caution"}) == {"L1": True, "L2": True}
    assert hit(items=("A",), condition={"median": ">spec_high*0.9"}) == {"L1": False, "L2": True}
    assert hit(items=("A",), condition={"median": ">spec_high/2"}) == {"L1": False, "L2": True}
    assert hit(items=("A",), condition={"median": "4~6"}) == {"L1": True, "L2": False}
    assert hit(items=("A",), condition={"median": "nonsense"}) == {"L1": True, "L2": True}
    assert hit(items=("B",), not_items=("C",), not_grade=">=caution") == {"L1": False, "L2": True}
    assert hit(items=("B",), trend_items=("A", "B", "C")) == {"L1": True, "L2": False}
    assert hit(items=("B",), trend_items=("A", "B"), trend="desc") == {"L1": False, "L2": True}
    assert matched(ctx, ItemRule(items=("Z",)))["L1"] == (False, "items not found")


def test_first_true_branch_only_and_empty_note_ends(ctx):
    rule = ChainedRule("r", "A", when=[[Atom(metric="spec_out", op=">", value=0)], [Atom(metric="grade", op="==", value=0)]],
                       branches=(Branch("", [[Atom(metric="disp_ratio", op=">", value=2)]]), Branch("second", [[Atom("measured", ("C",))]]), Branch("else")))
    assert matched(ctx, rule) == {"L1": (True, "branch 2: second"), "L2": (False, "no branch")}


def test_grade_of_a_missing_item_is_zero_but_list_is_false(ctx):
    low = ChainedRule("r", None, when=[[Atom(items=("C",), metric="grade", op="==", value=0)]], branches=(Branch("x"),))
    listed = ChainedRule("r", None, when=[[Atom("all_grade", ("C",), value=0)]], branches=(Branch("x"),))
    assert {k: m for k, (m, _) in matched(ctx, low).items()} == {"L1": False, "L2": True}
    assert {k: m for k, (m, _) in matched(ctx, listed).items()} == {"L1": True, "L2": False}


def test_negated_atom_and_category(ctx):
    rule = ChainedRule("r", None, when=[[Atom("category", ("Y",), "disp_ratio", ">", 1, negate=True)]], branches=(Branch("x"),))
    assert {k: m for k, (m, _) in matched(ctx, rule).items()} == {"L1": False, "L2": True}


def test_unknown_atoms_are_rejected():
    bad = ChainedRule("r", None, when=[[Atom("guess")]], branches=(Branch("x", [[Atom(metric="luck")]]),))
    assert rules.rejected([bad]) == [("r", "guess"), ("r", "luck")]


def test_json_rules():
    got = rules.item_rules_from_json('[{"items": ["A"], "condition": {"grade": ">=abnormal"}, "comment": "c", "not_items": null}]')
    assert got == [ItemRule(("A",), {"grade": ">=abnormal"}, comment="c")]


def test_suppression_and_conditional_exclusion(spark, ctx):
    f = spark.createDataFrame([("V", "S", "L1", "B", "DISPERSION"), ("V", "S", "L2", "B", "DISPERSION"), ("V", "S", "L1", "A", "SPEC_OUT"), ("V", "S", "L2", "A", "SPEC_OUT")],
                              "vehicle string, step_id string, lot_id string, item string, type string")
    trace = rules.rule_trace(ctx, [ChainedRule("q", None, when=[[Atom(items=("A",), metric="grade", value=2)]], suppress_disp=("B",)), ItemRule(("A",), {"grade": ">=abnormal"})])
    kept = {(r["lot_id"], r["item"]) for r in rules.suppress_dispersion(f, trace).collect()}
    assert kept == {("L2", "B"), ("L1", "A"), ("L2", "A")}
    kept = {(r["lot_id"], r["item"]) for r in rules.keep_if_ruled(f, trace, ["a*"]).collect()}
    assert kept == {("L1", "B"), ("L2", "B"), ("L1", "A")}


def greedy(baskets, least, rules=()):
    """Item sets as the text of ``item_sets`` says, by counting subsets of the baskets."""
    support = lambda s: sum(set(s) <= set(b) for b in baskets)
    names, done, out, used = sorted(set("".join(baskets))), [], [], set()
    covered = lambda s: any({x.lower() for x in s} <= {x.lower() for x in r} for r in rules)
    for pair in sorted(itertools.combinations(names, 2), key=lambda p: (-support(p), p)):
        if support(pair) < least or any(set(pair) <= d for d in done):
            continue
        group = set(pair)
        for x in names:
            if support(group | {x}) >= least:
                group.add(x)
        done.append(group)
        if not covered(group):
            out.append(("".join(sorted(group)), support(group)))
            used |= group
    return sorted(out + [(x, support(x)) for x in names if support(x) >= least and x not in used and not covered(x)])


def out_of_spec(spark, baskets):
    rows = [("V", "S", str(n), i, "SPEC_OUT", "CRITICAL") for n, b in enumerate(baskets) for i in b]
    rows += [("V", "S", "0", "q", "FLIER", "CRITICAL"), ("V", "S", "1", "q", "SPEC_OUT", "NOTICE")]
    return spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, item string, type string, severity string")


@pytest.mark.parametrize("rules_held", [(), ["bdx"], ["ABC"], ["e"]])
def test_item_sets_against_brute_force(spark, rules_held):
    baskets = ["abc", "abc", "abcd", "bd", "bd", "bd", "e", "e", "e", "ae", "f", "bde", "acf"]
    got = digest.item_sets(out_of_spec(spark, baskets), 3, rules_held).collect()
    assert sorted(("".join(r["items"]), r["reports"]) for r in got) == greedy(baskets, 3, rules_held)


def test_item_sets_of_many_reports(spark):
    """More reports than a word has bits, and supports that differ from the order of names."""
    draw = random.Random(1)
    baskets = ["".join(c for c in "abcdefgh" if draw.random() < 0.45) for _ in range(300)]
    got = digest.item_sets(out_of_spec(spark, baskets), 25).collect()
    assert sorted(("".join(r["items"]), r["reports"]) for r in got) == greedy(baskets, 25)
    want = {p: sum(set(p) <= set(b) for b in baskets) for p in itertools.combinations("abcdefgh", 2)}
    pairs = digest.frequent_pairs(out_of_spec(spark, baskets), 60).collect()
    assert {(r["item_a"], r["item_b"]): r["reports"] for r in pairs} == {p: n for p, n in want.items() if n >= 60}


def test_forty_items_out_together_end(spark):
    """A listing of subsets would hold 2**40 of them."""
    many = [f"i{k:02}" for k in range(40)]
    rows = [("V", "S", str(n), i, "SPEC_OUT", "CRITICAL") for n in range(3) for i in many]
    f = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, item string, type string, severity string")
    assert [(r["items"], r["reports"]) for r in digest.item_sets(f, 3).collect()] == [(many, 3)]


def test_reports_in_doubt_count_once(spark):
    rows = [("V", "S", "1", "PCHK_A", None, "MEAS_SUSPECT"), ("V", "S", "1", "PCHK_B", "PCHK", "MEAS_SUSPECT"), ("V", "S", "2", "X", "PCHK", "FLIER"), ("V", "S", "3", "X", "PCHK", "FLIER"), ("V", "S", "4", "Y", None, "SPEC_OUT")]
    f = spark.createDataFrame(rows, "vehicle string, step_id string, lot_id string, item string, cat2 string, type string")
    over = spark.createDataFrame([("V", "S", "2", "X", 3), ("V", "S", "3", "X", 0), ("V", "S", "4", "Y", 2), ("V", "S", "1", "PCHK_A", 1)], "vehicle string, step_id string, lot_id string, item string, overlap_shots int")
    assert sorted(r["lot_id"] for r in digest.suspect_reports(f, over).collect()) == ["1", "2"]


def generated(n, seed=3):
    """Rules of every kind over items that are there, missing, or written in another case."""
    draw = random.Random(seed)
    item = lambda: draw.choice(["A", "B", "C", "a", "Z"])
    some = lambda k=3: tuple(item() for _ in range(draw.randint(1, k)))
    metric = lambda: draw.choice(["grade", "median", "stddev", "rstd_ratio", "disp_ratio", "spec_out"])

    def atom():
        kind, op = draw.choice(["compare", "bound", "all_grade", "category", "all_category", "monotone", "monotone_category", "measured", "count_grade"]), draw.choice(list(rules.OPS))
        value, negate = draw.choice([0, 0.5, 1, 2, 5, 9]), draw.random() < 0.2
        if kind == "bound":
            return Atom("compare", (item(),), metric(), op, bound="spec_high", factor=draw.choice([0.5, 0.9]), negate=negate)
        if kind in ("category", "all_category", "monotone_category"):
            cats = tuple(draw.choice("XYQ") for _ in range(draw.randint(1, 2)))
            return Atom(kind, cats, metric(), op, value, negate=negate)
        return Atom(kind, some(), metric(), op, value, factor=draw.choice([0, 1, 2]), negate=negate)

    condition = lambda: [[atom() for _ in range(draw.randint(0, 2))] for _ in range(draw.randint(0, 2))]
    out = []
    for k in range(n):
        if k % 2:
            wanted = {m: draw.choice([">=1", "0~3", "<spec_high*0.6", ">=caution", "odd", ["<9", ">0.2"]]) for m in (metric(), metric())}
            out.append(ItemRule(some(), {**wanted, "logic": draw.choice(["any", "all"])}, not_items=draw.choice([(), some(2)]), trend_items=draw.choice([(), some()]),
                                not_grade=draw.choice([">=caution", ">=abnormal"]), trend=draw.choice(["asc", "desc"]), comment=draw.choice(["", f"c{k}"])))
        else:
            out.append(ChainedRule(f"r{k}", draw.choice([None, item()]), condition(), tuple(Branch(draw.choice(["", "n", "m"]), condition()) for _ in range(draw.randint(0, 3))),
                                   suppress_disp=draw.choice([(), some()]), compare_disp=draw.choice([None, (some(), some())])))
    return out


def test_rule_table_equals_rule_columns(spark, ctx):
    find = lambda n: n.upper() if n == "a" else n
    for seed in range(3):
        own = generated(30, seed)
        a, b = rules.rule_trace(ctx, own, find), ruletable.rule_trace(ctx, own, find)
        assert a.columns == b.columns
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert ruletable.rule_trace(ctx, []).count() == 0 and ruletable.rule_trace(ctx.limit(0), generated(4)).count() == 0


def test_rule_table_plan_does_not_grow(spark, ctx):
    shape = lambda df: [x.split("(")[0].split("[")[0].strip(" :+-") for x in df._jdf.queryExecution().analyzed().toString().splitlines()]
    few, many = ruletable.rule_trace(ctx, generated(10)), ruletable.rule_trace(ctx, generated(1000))
    assert shape(few) == shape(many)
    assert many.select("rule_rank").distinct().count() <= 1000 and many.where("matched").count() > 0
