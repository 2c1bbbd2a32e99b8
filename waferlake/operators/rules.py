"""Rules over the item context.

A rule is data: atoms joined by AND inside a group, groups joined by OR. All
rules become boolean columns over one row per report, so any number of rules
costs one aggregation of the item context.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.functions import scalars as S
from waferlake.operators.detect import REPORT_ITEM
from waferlake.operators.order import front_heavy
from waferlake.schema import REPORT

# fixed values
GRADES = {"abnormal": 2, "caution": 1, "info": 0}
MEDIAN_SHIFT_SIGMA = 2.0
OPS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
}

# metric name in a rule -> column of the item context
METRICS = {
    "grade": "level",
    "median": "rep_median",
    "stddev": "rep_std",
    "rstd": "rep_spread",
    "rstd_ratio": "rstd_ratio",
    "disp_ratio": "disp_ratio",
    "spec_out": "n_out",
    "spec_out_wafers": "out_wafers",
    "spec_out_ratio": "max_ratio",
    "median_dev_sigma": "shift",
    "median_pctile": "pctile",
    "flier_dev": "flier_dev",
    "flier_pt": "flier_count",
    "seq_run": "seq_run",
    "seq_dead": "seq_dead",
    "meas_overlap": "overlap_shots",
}
KINDS = {
    "compare": "metric of an item against a number or a spec bound",
    "all_grade": "every listed item at or above a grade",
    "category": "largest metric of a category",
    "all_category": "every listed category at or above a grade",
    "monotone": "metric strictly rising or falling over listed items",
    "monotone_category": "the same over categories",
    "median_low": "target median below the population by two spreads",
    "median_high": "target median above the population by two spreads",
    "pattern": "spatial pattern holds a word",
    "zone_share": "share of out points in a zone",
    "repeat": "kind of repeated sites",
    "measured": "item measured in this report",
    "count_grade": "items of the report at or above a grade",
    "front_heavy": "out points early in the measurement order",
    "all_seq_run": "every listed item with a run this long",
    "all_front_heavy": "every listed item front heavy",
}


@dataclass(frozen=True)
class Atom:
    kind: str = "compare"
    items: tuple[str, ...] = ()
    metric: str | None = None
    op: str = ">="
    value: float | None = None
    bound: str | None = None
    factor: float = 1.0
    text: str | None = None
    negate: bool = False


Condition = Sequence[Sequence[Atom]]


@dataclass(frozen=True)
class Branch:
    note: str
    condition: Condition = ()
    link: str = ""


@dataclass(frozen=True)
class ChainedRule:
    name: str
    trigger: str | None = None
    when: Condition = ()
    branches: tuple[Branch, ...] = ()
    severity: str = "CRITICAL"
    suppress_disp: tuple[str, ...] = ()
    compare_disp: tuple[tuple[str, ...], tuple[str, ...]] | None = None


@dataclass(frozen=True)
class ItemRule:
    """Conditions on a list of items, with counter-items and a trend."""

    items: tuple[str, ...]
    condition: Mapping = field(default_factory=dict)
    not_items: tuple[str, ...] = ()
    not_grade: str = ">=abnormal"
    trend_items: tuple[str, ...] = ()
    trend: str = "asc"
    link: str = ""
    comment: str = ""


def item_rules_from_json(text: str) -> list[ItemRule]:
    out = []
    for r in json.loads(text):
        lists = {k: tuple(r.get(k) or ()) for k in ("items", "not_items", "trend_items")}
        rest = {k: r[k] for k in ("condition", "not_grade", "trend", "link", "comment") if r.get(k) is not None}
        out.append(ItemRule(**lists, **rest))
    return out


def rejected(rules: Iterable[ChainedRule]) -> list[tuple[str, str]]:
    """(rule, kind or metric) pairs the catalogue does not know."""
    bad = []
    for r in rules:
        conds = [r.when, *[b.condition for b in r.branches]]
        for a in (a for c in conds for group in c for a in group):
            if a.kind not in KINDS:
                bad.append((r.name, a.kind))
            elif a.kind in ("compare", "category", "monotone") and a.metric not in METRICS:
                bad.append((r.name, str(a.metric)))
    return bad


def resolver(items: Sequence, names: Mapping[str, str] | None = None):
    """Item alias for a written name: as written, then ignoring case, then by display name."""
    aliases = [i.alias for i in items]
    shown = {v.lower(): k for k, v in (names or {}).items()}
    lower = {a.lower(): a for a in reversed(aliases)}

    def find(name: str) -> str:
        if name in aliases:
            return name
        return lower.get(name.lower()) or shown.get(name.lower()) or name

    return find


class Facts:
    """Collects the (item, metric) pairs rules mention and turns them into columns."""

    def __init__(self, find=lambda n: n):
        self.find = find
        self.wanted: dict[str, Column] = {}

    def _keep(self, name: str, col: Column) -> Column:
        self.wanted[name] = col
        return F.col(f"`{name}`")

    def of(self, item: str, column: str) -> Column:
        item = self.find(item)
        return self._keep(f"{item}|{column}", F.max(F.when(F.col("item") == item, F.col(column))))

    def measured(self, item: str) -> Column:
        item = self.find(item)
        return F.coalesce(self._keep(f"{item}|measured", F.max(F.when(F.col("item") == item, True))), F.lit(False))

    def category(self, cat: str, column: str) -> Column:
        return self._keep(f"cat {cat}|{column}", F.max(F.when(F.col("cat2") == cat, F.col(column))))

    def graded(self, level: int) -> Column:
        return self._keep(f"graded|{level}", F.count_if(F.col("level") >= level))

    def rows(self, ctx: DataFrame) -> DataFrame:
        extra = [c.alias(n) for n, c in self.wanted.items()]
        return ctx.groupBy(*REPORT).agg(F.count("*").alias("_items"), *extra)


def _strict(values: Sequence[Column], rising: bool) -> Column:
    if len(values) < 2:
        return F.lit(False)
    steps = [(a < b) if rising else (a > b) for a, b in zip(values, values[1:])]
    return F.coalesce(reduce(Column.__and__, steps), F.lit(False))


def _all(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def atom_column(a: Atom, facts: Facts, trigger: str | None = None) -> Column:
    """Boolean column of one atom; items default to the trigger of the rule."""
    items = a.items or ((trigger,) if trigger else ())
    false = F.lit(False)
    op = OPS[a.op]
    if a.kind == "compare":
        left = facts.of(items[0], METRICS[a.metric])
        if a.metric == "grade":
            left = F.coalesce(left, F.lit(0))
        right = facts.of(items[0], a.bound) * F.lit(a.factor) if a.bound else F.lit(a.value)
        test = op(left, right)
    elif a.kind == "all_grade":
        test = _all([F.coalesce(facts.of(i, "level") >= a.value, false) for i in items]) if items else false
    elif a.kind == "category":
        left = facts.category(items[0], METRICS[a.metric])
        test = op(F.coalesce(left, F.lit(0)) if a.metric == "grade" else left, F.lit(a.value))
    elif a.kind == "all_category":
        test = _all([F.coalesce(facts.category(i, "level") >= a.value, false) for i in items]) if items else false
    elif a.kind == "monotone":
        test = _strict([facts.of(i, METRICS[a.metric]) for i in items], a.op in ("<", "<="))
    elif a.kind == "monotone_category":
        test = _strict([facts.category(i, METRICS[a.metric]) for i in items], a.op in ("<", "<="))
    elif a.kind in ("median_low", "median_high"):
        gap = (facts.of(items[0], "pop_median") - facts.of(items[0], "target_median")) / F.nullif(
            facts.of(items[0], "pop_spread"), F.lit(0.0)
        )
        test = (gap if a.kind == "median_low" else -gap) >= MEDIAN_SHIFT_SIGMA
    elif a.kind == "pattern":
        test = F.lower(facts.of(items[0], "pattern")).contains((a.text or "").lower())
    elif a.kind == "zone_share":
        test = op(facts.of(items[0], f"zone_{(a.text or '').lower()}"), F.lit(a.value))
    elif a.kind == "repeat":
        test = facts.of(items[0], "repeat_kind") == a.text
    elif a.kind == "measured":
        test = facts.measured(items[0])
    elif a.kind == "count_grade":
        test = op(facts.graded(int(a.factor)), F.lit(a.value))
    elif a.kind in ("front_heavy", "all_front_heavy"):
        test = _all([F.coalesce(front_heavy(facts.of(i, "seq_front"), facts.of(i, "seq_back")), false) for i in items])
    elif a.kind == "all_seq_run":
        test = _all([F.coalesce(facts.of(i, "seq_run") >= a.value, false) for i in items])
    else:
        raise ValueError(f"unknown atom {a.kind}")
    test = F.coalesce(test, false)
    return ~test if a.negate else test


def condition_column(condition: Condition, facts: Facts, trigger: str | None = None) -> Column:
    """OR over AND groups; an empty condition holds."""
    if not condition:
        return F.lit(True)
    return _any([_all([atom_column(a, facts, trigger) for a in group]) for group in condition])


def item_atoms(item: str, condition: Mapping) -> list[Atom]:
    """Atoms of all readable entries of an item condition; an unreadable one is skipped."""
    out = []
    for name, wanted in condition.items():
        if name == "seq_front_heavy":
            out += [Atom("front_heavy", (item,))] if wanted else []
        elif name in METRICS:
            for one in wanted if isinstance(wanted, (list, tuple)) else [wanted]:
                out += _read(item, name, str(one).strip())
    return out


def _item_test(item: str, condition: Mapping, facts: Facts) -> Column:
    return _all([atom_column(a, facts) for a in item_atoms(item, condition)])


def _read(item: str, metric: str, text: str) -> list[Atom]:
    """Atoms of one written comparison such as ``>=2``, ``1~3`` or ``>spec_high*0.9``."""
    if "~" in text:
        lo, hi = text.split("~", 1)
        return [Atom("compare", (item,), metric, ">=", float(lo)), Atom("compare", (item,), metric, "<=", float(hi))]
    op = next((o for o in (">=", "<=", "==", ">", "<") if text.startswith(o)), None)
    rest = text[len(op):].strip() if op else text
    op = op or ">="
    if metric == "grade":
        return [Atom("compare", (item,), metric, op, float(GRADES[rest.lower()]))] if rest.lower() in GRADES else []
    for bound in ("spec_high", "spec_low"):
        if rest.startswith(bound):
            tail = rest[len(bound):].strip()
            factor = float(tail[1:]) if tail[:1] in "*/" and tail else 1.0
            return [Atom("compare", (item,), metric, op, bound=bound, factor=1 / factor if tail[:1] == "/" else factor)]
    try:
        return [Atom("compare", (item,), metric, op, float(rest))]
    except ValueError:
        return []


TRACE = ["kind", "rule_rank", "rule", "item", "severity", "matched", "result", "items_matched", "note"]


def _trace(kind: str, rank: int, rule: str, item, severity: str, matched: Column, result: Column, items: Column, note) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(rank).alias("rule_rank"), F.lit(rule).alias("rule"),
        F.lit(item).cast("string").alias("item") if not isinstance(item, Column) else item.cast("string").alias("item"),
        F.lit(severity).alias("severity"), matched.alias("matched"), result.cast("string").alias("result"),
        items.cast("string").alias("items_matched"), note.cast("string").alias("note"),
    )


def _item_rule_trace(rank: int, rule: ItemRule, facts: Facts) -> Column:
    tests = [(i, facts.measured(i), _item_test(i, rule.condition, facts)) for i in rule.items]
    found = _any([m for _, m, _ in tests])
    # items that were not measured take no part
    if rule.condition.get("logic", "any") == "all":
        core = _all([~m | t for _, m, t in tests])
    else:
        core = _any([m & t for _, m, t in tests])
    need = GRADES.get(rule.not_grade.replace(">=", "").strip().lower(), 2)
    clear = _all([F.coalesce(facts.of(i, "level"), F.lit(0)) < need for i in rule.not_items])
    trend = F.lit(True)
    if rule.trend_items:
        vals = [F.when(facts.measured(i), F.coalesce(facts.of(i, "rstd_ratio"), F.lit(0.0))) for i in rule.trend_items]
        trend = _strict(vals, rule.trend != "desc")
    matched = found & core & clear & trend
    hits = F.array_compact(F.array(*[F.when(m & t, F.lit(facts.find(i))) for i, m, t in tests]))
    reason = F.concat_ws(
        "; ",
        F.concat(F.lit("meets the condition: "), F.array_join(hits, ", ")),
        *([F.concat(F.lit(f"{', '.join(rule.not_items)} below grade: "), clear.cast("string"))] if rule.not_items else []),
        *([F.concat(F.lit(f"{' '.join(rule.trend_items)} {rule.trend}: "), trend.cast("string"))] if rule.trend_items else []),
    )
    result = F.when(~found, "items not found").when(matched, rule.comment or "matched").otherwise("not met")
    return _trace("ITEM_RULE", rank, rule.comment or f"rule {rank + 1}", F.get(hits, F.lit(0)), "CRITICAL", matched, result,
                  F.array_join(hits, ","), reason)


def _chain_traces(rank: int, rule: ChainedRule, facts: Facts) -> list[Column]:
    gate = condition_column(rule.when, facts, rule.trigger)
    none = F.lit(None)
    out = []
    if rule.suppress_disp:
        names = ",".join(facts.find(i) for i in rule.suppress_disp)
        out.append(_trace("SUPPRESS", rank, rule.name, None, "", gate, F.when(gate, "applied").otherwise("gate not met"),
                          F.lit(names), none))
    if rule.compare_disp:
        sides = [
            F.coalesce(F.greatest(*[facts.of(i, "disp_ratio") for i in g], F.lit(0.0)), F.lit(0.0)) for g in rule.compare_disp
        ]
        bigger = F.when(sides[0] >= sides[1], ",".join(rule.compare_disp[0])).otherwise(",".join(rule.compare_disp[1]))
        out.append(_trace("COMPARE", rank, rule.name, rule.name, rule.severity, gate,
                          F.when(gate, F.concat(F.lit("wider: "), bigger)).otherwise("gate not met"), bigger, none))
    if rule.branches:
        first = F.lit(None).cast("int")
        for n, b in reversed(list(enumerate(rule.branches))):
            first = F.when(condition_column(b.condition, facts, rule.trigger), F.lit(n)).otherwise(first)
        note = reduce(lambda acc, nb: F.when(first == nb[0], F.lit(nb[1].note)).otherwise(acc), enumerate(rule.branches), F.lit(None).cast("string"))
        hit = gate & first.isNotNull() & (F.coalesce(note, F.lit("")) != "")
        stats = F.lit(None).cast("string")
        if rule.trigger:
            stats = F.format_string("median=%.4g stddev=%.4g", facts.of(rule.trigger, "rep_median"), facts.of(rule.trigger, "rep_std"))
        out.append(_trace("CHAIN", rank, rule.name, rule.trigger and facts.find(rule.trigger), rule.severity, hit,
                          F.when(~gate, "gate not met").when(hit, F.concat(F.lit("branch "), (first + 1).cast("string"), F.lit(": "), note))
                          .otherwise("no branch"), F.when(hit, note), stats))
    return out


def rule_trace(ctx: DataFrame, rules: Sequence[ItemRule | ChainedRule], find=lambda n: n) -> DataFrame:
    """One row per rule action and report, matched or not."""
    facts, traces = Facts(find), []
    for rank, rule in enumerate(rules):
        if isinstance(rule, ItemRule):
            traces.append(_item_rule_trace(rank, rule, facts))
        else:
            traces += _chain_traces(rank, rule, facts)
    return facts.rows(ctx).select(*REPORT, F.inline(F.array(*traces)))


def rule_findings(trace: DataFrame) -> DataFrame:
    """Findings of matched rules: defect modes and comparisons."""
    kind = F.when(F.col("kind") == "COMPARE", "KNOWLEDGE").when(F.col("kind") != "SUPPRESS", "DEFECT_MODE")
    return trace.where(F.col("matched") & (F.col("kind") != "SUPPRESS")).select(
        *REPORT, F.coalesce("item", "rule").alias("item"), "severity", kind.alias("type"), "rule_rank", "result"
    )


def suppress_dispersion(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """Drop dispersion findings of items an applied rule suppresses."""
    quiet = trace.where((F.col("kind") == "SUPPRESS") & F.col("matched")).select(
        *REPORT, F.explode(F.split("items_matched", ",")).alias("item"), F.lit("DISPERSION").alias("type")
    ).distinct()
    return findings.join(quiet, [*REPORT_ITEM, "type"], "left_anti")


def keep_if_ruled(findings: DataFrame, trace: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Built-in findings of the listed items stay only where a matched rule names the item."""
    if not patterns:
        return findings
    named = trace.where(F.col("matched") & (F.col("kind") != "SUPPRESS")).select(
        *REPORT, F.explode(F.split(F.concat_ws(",", "item", "items_matched"), ",")).alias("item")
    ).distinct().withColumn("_named", F.lit(True))
    hidden = S.wildcard("item", patterns) & F.col("type").isin("SPEC_OUT", "FLIER", "DISPERSION")
    out = findings.join(named, REPORT_ITEM, "left")
    return out.where(~hidden | F.col("_named").isNotNull()).drop("_named")


def check_counts(trace: DataFrame) -> DataFrame:
    """Matched and unmatched rules per report."""
    return trace.groupBy(*REPORT).agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")
    )


def category_rollup(ctx: DataFrame) -> DataFrame:
    """Largest level and dispersion per category of a report."""
    return ctx.where(F.col("cat2").isNotNull()).groupBy(*REPORT, "cat2").agg(
        F.max("level").alias("level"), F.max("disp_ratio").alias("disp_ratio")
    )
