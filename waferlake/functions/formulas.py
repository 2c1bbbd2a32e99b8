"""Derived items: formulas over other items, evaluated as column expressions.

A formula is an arithmetic expression with ``{ALIAS}`` references. Formulas are
grouped in dependency levels; every level is one projection over the shots.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waferlake.schema import Item
from waferlake.session import staged

REFERENCE = re.compile(r"\{([^{}]+)\}")
GROUP = ["root_lot_id", "wafer_id", "tkout_time"]
WINDOW_OUTPUTS = ["minus_margin", "plus_margin", "ovl_index", "base", "new"]
LOG_SHIFT = 1e-14
DEFAULT_COMPLIANCE = 10.0


class Term:
    """A column whose arithmetic yields NULL where ANSI mode would raise."""

    def __init__(self, col):
        self.col = F.lit(float(col)) if isinstance(col, (int, float)) else col

    @staticmethod
    def of(x) -> Term:
        return x if isinstance(x, Term) else Term(x)

    def __add__(self, o):
        return Term(self.col + Term.of(o).col)

    def __radd__(self, o):
        return Term.of(o) + self

    def __sub__(self, o):
        return Term(self.col - Term.of(o).col)

    def __rsub__(self, o):
        return Term.of(o) - self

    def __mul__(self, o):
        return Term(self.col * Term.of(o).col)

    def __rmul__(self, o):
        return Term.of(o) * self

    def __truediv__(self, o):
        return Term(F.try_divide(self.col, Term.of(o).col))

    def __rtruediv__(self, o):
        return Term.of(o) / self

    def __pow__(self, o):
        return Term(clean(F.pow(self.col, Term.of(o).col)))

    def __neg__(self):
        return Term(-self.col)

    def __pos__(self):
        return self


def clean(col: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(col), col)


def log10_abs(x: Column) -> Column:
    return F.log10(F.nullif(F.abs(x), F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def _log10(x: pd.Series) -> pd.Series:
    return np.log10(x)


def libm_log10(x: Column) -> Column:
    """Logarithm as the C library rounds it.

    Spark's own may differ in the last bit, which decides the sign of what the
    logarithms leave where they cancel.
    """
    return F.when(F.isnan(x), x).when(x > 0, _log10(F.when(x > 0, x)))


def parabola_weights(xs: Sequence[float]) -> list[tuple[list[float], float]]:
    """Weights of y in the least-squares coefficients of x^2, x and 1: whole numbers over one divisor each.

    Weights rounded on their own would leave a remainder where the quadratic
    part of y is exactly zero, and its sign decides the margin.
    """
    xs = [Fraction(x) for x in xs]
    moment = [sum(x**k for x in xs) for k in range(5)]
    rows = [[moment[4 - i - j] for j in range(3)] + [x ** (2 - i) for x in xs] for i in range(3)]
    if len(set(xs)) < 3:  # not determined: the shortest solution
        return [([float(w) for w in r], 1.0) for r in np.linalg.pinv(np.vander(np.asarray(xs, float), 3))]
    for k in range(3):
        rows[k] = [c / rows[k][k] for c in rows[k]]
        rows = [r if i == k else [c - r[k] * p for c, p in zip(r, rows[k])] for i, r in enumerate(rows)]
    out = []
    for r in (r[3:] for r in rows):
        divisor = lcm(*[w.denominator for w in r])
        whole = [w * divisor for w in r]
        small = divisor <= 2**53 and all(abs(w) <= 2**53 for w in whole)
        out.append(([float(w) for w in whole], float(divisor)) if small else ([float(w) for w in r], 1.0))
    return out


def window_margins(xs: Sequence[float], ys: Sequence[Column], spec: float, compliance: float) -> dict[str, Column]:
    """Margins at which a parabola through log10(y) over fixed x meets the spec.

    x is constant, so the least-squares coefficients are fixed linear
    combinations of the y columns.
    """
    if len(xs) != len(ys):
        return {name: F.lit(None).cast("double") for name in WINDOW_OUTPUTS}
    logs = [libm_log10(y + F.lit(LOG_SHIFT)) for y in ys]

    def combine(row, divisor):
        total = F.lit(row[0]) * logs[0]
        for w, c in zip(row[1:], logs[1:]):
            total = total + F.lit(w) * c
        return total / F.lit(divisor)

    a2, a1, a0 = (combine(*r) for r in parabola_weights(xs))
    disc = a1 * a1 - F.lit(4.0) * a2 * (a0 - F.lit(spec))
    root = F.sqrt(F.when(disc >= 0, disc))
    cap = F.lit(compliance)

    def margin(sign: int) -> Column:
        raw = F.try_divide(-a1 + F.lit(float(sign)) * root, F.lit(2.0) * a2)
        capped = F.when(raw * sign > cap, cap * sign).otherwise(raw)
        return (
            F.when(a2 <= 0, cap * sign)
            .when((disc < 0) & (a2 > 0), F.lit(0.0))
            .otherwise(capped)
        )

    plus, minus = margin(1), margin(-1)
    return {
        "minus_margin": minus,
        "plus_margin": plus,
        "ovl_index": F.lit(-0.5) * (plus + minus),
        "base": plus - minus,
        "new": F.least(F.abs(plus), F.abs(minus)),
    }


@dataclass
class Scope:
    """Functions a formula may call, and the group statistics it asked for."""

    columns: dict[str, str | Column]
    alias: str
    group_calls: list[tuple[str, str, Column]] = field(default_factory=list)

    def _group(self, kind: str, x) -> Term:
        name = f"_{self.alias}_{kind}{len(self.group_calls)}"
        self.group_calls.append((name, kind, Term.of(x).col))
        return Term(F.col(f"`{name}`"))

    def names(self) -> dict:
        std = lambda x: self._group("std", x)
        return {
            "ABS": lambda x: Term(F.abs(Term.of(x).col)),
            "sqrt": lambda x: Term(clean(F.sqrt(Term.of(x).col))),
            "POWER": lambda a, b: Term.of(a) ** b,
            "LOG": lambda _unit, x: Term(log10_abs(Term.of(x).col)),
            "rmax": lambda *xs: Term(_row_extreme(F.greatest, xs)),
            "rmin": lambda *xs: Term(_row_extreme(F.least, xs)),
            "stddev": std,
            "std": std,
            "STD": std,
            "AVG": lambda x: self._group("avg", x),
            "MA_Window": _window_call,
        }


def _row_extreme(pick, xs) -> Column:
    cols = [Term.of(x).col for x in xs]
    return cols[0] if len(cols) == 1 else pick(*cols)


def _window_call(*args) -> dict[str, Column]:
    xs, ys, scalars = [], [], []
    for a in args:
        if isinstance(a, (list, tuple)):
            xs = list(a)
        elif isinstance(a, Term):
            ys.append(a.col)
        else:
            scalars.append(float(a))
    spec = float(np.log10(scalars[0]))
    compliance = abs(scalars[1]) if len(scalars) > 1 else DEFAULT_COMPLIANCE
    return window_margins(xs, ys, spec, compliance)


ALLOWED = (
    ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd,
)


def references(formula: str) -> list[str]:
    return list(dict.fromkeys(REFERENCE.findall(formula)))


def evaluate(formula: str, scope: Scope):
    """Column (or named columns) of a formula; anything but arithmetic is refused."""
    refs = references(formula)
    text = REFERENCE.sub(lambda m: f"_ref{refs.index(m.group(1))}", formula)
    tree = ast.parse(text.strip(), mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED):
            raise ValueError(f"{type(node).__name__} is not allowed in formula {formula!r}")
    names = scope.names() | {
        f"_ref{n}": Term(F.col(f"`{c}`") if isinstance(c := scope.columns[r], str) else c) for n, r in enumerate(refs)
    }
    value = eval(compile(tree, "<formula>", "eval"), {"__builtins__": {}}, names)  # noqa: S307
    return value if isinstance(value, dict) else Term.of(value).col


@dataclass
class Derived:
    frame: DataFrame
    added: list[str]
    unresolved: list[str]


def formula_levels(available: Sequence[str], items: Sequence[Item]) -> tuple[list[list[Item]], list[Item]]:
    """Formulas in the order they become computable, and those that never do."""
    known, waiting, levels = set(available), [i for i in items if i.formula], []
    while waiting:
        ready = [i for i in waiting if all(r in known for r in references(i.formula))]
        if not ready:
            break
        levels.append(ready)
        for i in ready:
            known.add(i.alias)
            if "MA_Window" in i.formula:
                known.update(f"{i.alias}_{o}" for o in WINDOW_OUTPUTS)
        waiting = [i for i in waiting if i not in ready]
    return levels, waiting


def add_formulas(shots: DataFrame, items: Sequence[Item], group: Sequence[str] = GROUP) -> Derived:
    """Add one column per derived item; a window formula adds five.

    An item's own scale factor multiplies its formula; its inputs are scaled
    already. Group statistics are aggregated and joined back, so a large group
    is combined before the shuffle.
    """
    levels, missing = formula_levels(shots.columns, items)
    added: list[str] = []
    for level in levels:
        new: dict[str, Column] = {}
        calls: list[tuple[str, str, Column]] = []
        for item in level:
            scope = Scope({r: r for r in references(item.formula)}, item.alias)
            value = evaluate(item.formula, scope)
            calls += scope.group_calls
            factor = _factor(item.scale_factor)
            if isinstance(value, dict):
                for out, col in value.items():
                    # the base output carries the alias itself
                    new[item.alias if out == "base" else f"{item.alias}_{out}"] = col * F.lit(factor)
            else:
                new[item.alias] = value if factor == 1.0 else value * F.lit(factor)
        if calls:
            shots = _join_group_stats(shots, calls, group)
        shots = shots.withColumns(new).drop(*[name for name, _, _ in calls])
        added += list(new)
    return Derived(shots, added, [i.alias for i in missing])


def row_values(measured: Mapping[str, Column], items: Sequence[Item]) -> dict[str, Column]:
    """The measured values of one row and those its formulas give, for a row that stands in an array. Only for
    formulas without group statistics and windows, which have no such form."""
    values = dict(measured)
    for level in formula_levels(list(values), items)[0]:
        new: dict[str, Column] = {}
        for item in level:
            scope = Scope({r: values[r] for r in references(item.formula)}, item.alias)
            value = evaluate(item.formula, scope)
            if scope.group_calls or isinstance(value, dict):
                raise ValueError(f"{item.alias} does not follow from its row alone")
            factor = _factor(item.scale_factor)
            new[item.alias] = value if factor == 1.0 else value * F.lit(factor)
        values |= new
    return values


def _factor(text: str | None) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        return 1.0


def _join_group_stats(shots: DataFrame, calls, group: Sequence[str]) -> DataFrame:
    kinds = {"std": F.stddev_samp, "avg": F.avg}
    inputs = shots.select(*group, *[col.alias(name) for name, _, col in calls])
    stats = inputs.groupBy(*group).agg(*[kinds[kind](f"`{name}`").alias(name) for name, kind, _ in calls])
    return shots.join(stats, list(group), "left")


def lineage(edges: DataFrame) -> DataFrame:
    """Measured items every derived item finally rests on.

    ``edges`` holds (alias, ref); a ref that is no alias itself is measured.
    Pairs are paths with their least number of steps. A round joins the paths
    of exactly 1, 2, 4, 8 ... steps with all up to that length, which doubles
    the length reached: rounds grow with the logarithm of the depth, and a
    pair comes from the middles at that distance only. New pairs are written
    beside those before; shared inputs and circular formulas bring none.
    """
    paths = staged(edges.select("alias", "ref", F.lit(1).alias("steps")).distinct(), "paths")
    length = 1
    while not (halves := paths.where(F.col("steps") == length)).isEmpty():
        on = paths.select(F.col("alias").alias("ref"), F.col("ref").alias("next"), F.col("steps").alias("more"))
        longer = halves.join(on, "ref").groupBy("alias", F.col("next").alias("ref")).agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        paths = paths.unionByName(staged(longer.join(paths, ["alias", "ref"], "left_anti"), "paths"))
        length *= 2
    derived = edges.select(F.col("alias").alias("ref")).distinct()
    return paths.join(derived, "ref", "left_anti").select("alias", F.col("ref").alias("leaf"))


def formula_edges(items: DataFrame) -> DataFrame:
    refs = F.regexp_extract_all("formula", F.lit(r"\{([^{}]+)\}"), F.lit(1))
    return items.where(F.col("formula").isNotNull()).select(
        "alias", F.explode(F.array_distinct(refs)).alias("ref")
    )
