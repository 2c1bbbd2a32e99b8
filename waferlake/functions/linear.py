"""Small symmetric linear systems as column expressions, one system per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a pivot this much smaller than its diagonal entry was counts as zero
SINGULAR = 1e-11


def moments(terms: Sequence[Column], target: Column, prefix: str = "_") -> list[Column]:
    """Sums whose normal equations fit ``target`` by ``terms``: upper triangle, then right side."""
    n = len(terms)
    upper = [F.sum(terms[i] * terms[j]).alias(f"{prefix}m{i}{j}") for i in range(n) for j in range(i, n)]
    return upper + [F.sum(terms[i] * target).alias(f"{prefix}v{i}") for i in range(n)]


def solved(rows: DataFrame, n: int, names: Sequence[str], prefix: str = "_") -> DataFrame:
    """Adds the solution of each row's n x n system and drops its entries; NULL where the system is singular.

    Elimination keeps the matrix symmetric, so only its upper triangle exists. One projection for each
    pivot keeps the expressions small.
    """
    m = lambda i, j: F.col(f"{prefix}m{min(i, j)}{max(i, j)}")
    v = lambda i: F.col(f"{prefix}v{i}")
    keep = [c for c in rows.columns if c not in {f"{prefix}m{i}{j}" for i in range(n) for j in range(i, n)} | {f"{prefix}v{i}" for i in range(n)}]
    rows = rows.withColumns({f"{prefix}d{i}": m(i, i) for i in range(n)})
    for k in range(n):
        pivot = F.when(m(k, k) > F.col(f"{prefix}d{k}") * SINGULAR, m(k, k))
        rows = rows.withColumn(f"{prefix}m{k}{k}", pivot)
        new: dict[str, Column] = {}
        for i in range(k + 1, n):
            part = m(k, i) / m(k, k)
            new |= {f"{prefix}m{i}{j}": m(i, j) - part * m(k, j) for j in range(i, n)}
            new[f"{prefix}v{i}"] = v(i) - part * v(k)
        rows = rows.withColumns(new) if new else rows
    for k in reversed(range(n)):
        known = F.lit(0.0)
        for j in range(k + 1, n):
            known = known + m(k, j) * F.col(names[j])
        rows = rows.withColumn(names[k], (v(k) - known) / m(k, k))
    return rows.select(*keep, *names)
