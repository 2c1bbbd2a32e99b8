"""Quality statistics per document and robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.llm.common import let, words_column

SPACES = r"[\x20\x09-\x0D]+"
N_FEATURES = 3
#: least variance of each feature: a group whose values are all equal must not reject small deviations
FLOORS = (0.02, 0.05, 0.05)


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def count(w):
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(
            F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))
        return let(F.sort_array(windows), lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))))

    return F.when(F.size(words) >= 3, let(words, count)).otherwise(0)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs); a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = made.withColumn("_w", words_column(F.col(text_col), SPACES))
    return made.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated(F.col("_w")).cast("long"),
    }).drop("_w")


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p(F.col("word_chars") / n), F.log1p(100.0 * F.col("n_symbols") / n), F.log1p(100.0 * (F.col("n_dup_lines") + F.col("n_repeat_words")) / n)]


def _moments(points: DataFrame) -> DataFrame:
    """Location and inverse scatter of every group, from sums only."""
    aggs = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(N_FEATURES)]
    aggs += [F.coalesce(F.covar_pop(f"_x{i}", f"_x{j}"), F.lit(0.0)).alias(f"c{i}{j}") for i in range(N_FEATURES) for j in range(i, N_FEATURES)]
    g = points.groupBy("_lang", "_src").agg(*aggs)
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") + (F.lit(FLOORS[i]) if i == j else 0) for i in range(3) for j in range(3)}
    minor = lambda i, j: (c[(i + 1) % 3, (j + 1) % 3] * c[(i + 2) % 3, (j + 2) % 3] - c[(i + 1) % 3, (j + 2) % 3] * c[(i + 2) % 3, (j + 1) % 3])
    det = c[0, 0] * minor(0, 0) + c[0, 1] * minor(0, 1) + c[0, 2] * minor(0, 2)
    return g.select("_lang", "_src", "m0", "m1", "m2", *[(minor(i, j) / det).alias(f"p{i}{j}") for i in range(3) for j in range(i, 3)])


def _distance() -> Column:
    d = [F.col(f"_x{i}") - F.col(f"m{i}") for i in range(3)]
    return sum((d[i] * d[j] * F.col(f"p{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)), F.lit(0.0))


def judge(docs: DataFrame, steps: int = 2, subset: float = 0.75, cutoff: float = 60.0, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Adds `base_failed`, `distance` (squared Mahalanobis) and `kept` to documents with `statistics`.

    Minimum-covariance-determinant estimates per (language, source): starting from all rows, each
    concentration step keeps the `subset` share of a group nearest to the present estimate and estimates
    anew, over all documents. A null language or source forms a group of its own. The scatter has variance
    floors, so a group of one row or of equal rows has distance 0 for them. A document is rejected beyond
    `cutoff`. Groups meet their estimates through partial aggregates and a join whose small side is one row
    per group; the estimates are staged once per step.
    """
    from waferlake.llm.common import staged

    base = docs.drop("base_failed", "distance", "kept").withColumns({"_lang": F.coalesce(F.col(lang_col), F.lit("\x00")), "_src": F.coalesce(F.col(source_col), F.lit("\x00"))})
    points = base.withColumns({f"_x{i}": x for i, x in enumerate(_features())})
    slim = points.select("_lang", "_src", "_x0", "_x1", "_x2")
    fit = staged(_moments(slim), "mcd")
    for _ in range(steps):
        near = slim.join(fit, ["_lang", "_src"]).withColumn("_d", _distance())
        cut = near.groupBy("_lang", "_src").agg(F.percentile_approx("_d", subset, 1000).alias("_cut"))
        fit = staged(_moments(near.drop("m0", "m1", "m2").join(staged(cut, "mcd-cut"), ["_lang", "_src"]).where(F.col("_d") <= F.col("_cut"))), "mcd")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        points.join(fit, ["_lang", "_src"], "left")
        .withColumn("base_failed", failed)
        .withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
        .drop("_lang", "_src", *[f"_x{i}" for i in range(3)], *[f"m{i}" for i in range(3)], *[f"p{i}{j}" for i in range(3) for j in range(i, 3)])
    )


def assess(docs: DataFrame, **options) -> DataFrame:
    """Statistics, staged without the texts, then the verdicts."""
    from waferlake.llm.common import staged

    slim = statistics(docs).drop("text")
    return judge(staged(slim, "quality"), **options)
