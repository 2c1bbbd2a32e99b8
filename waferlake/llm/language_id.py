"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's character n-grams, white space runs as one space."""
    chars = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for n in ORDERS:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ chars[i : len(chars) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            total += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    where = np.flatnonzero(total)
    return where, total[where]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix and log priors from all rows with a text and a language.

    Counts are summed per language inside each partition, then over partitions by (language, bucket); the
    driver receives BUCKETS sums per language, whatever the number of documents.
    """

    def partial(frames):
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                if not LETTER.search(text):
                    continue
                s = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                b, c = gram_counts(text)
                s[b] += c
                s[BUCKETS] += 1
        for lang, s in sums.items():
            b = np.flatnonzero(s)
            yield pd.DataFrame({"lang": lang, "bucket": b.astype(np.int32), "n": s[b]})

    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = usable.mapInPandas(partial, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 1))
    table[[langs.index(x) for x in counts["lang"]], counts["bucket"].to_numpy()] = counts["n"]
    grams = table[:, :BUCKETS] + 0.1
    seen = table[:, BUCKETS] + 1
    prior = np.log(seen / seen.sum()) if langs else seen
    return langs, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), prior


def predict(docs: DataFrame, model) -> DataFrame:
    """Adds `lang_pred` and `score`, the posterior of the predicted language.

    A null text, a text without a letter, or a model without languages gives `und` with score 0. Ties go to
    the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, p double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, logs, prior = shared.value
        rows = []
        for t in texts:
            if not t or not langs or not LETTER.search(t):
                rows.append((UNKNOWN, 0.0))
                continue
            b, c = gram_counts(t)
            z = logs[:, b].astype(np.float64) @ c + prior
            p = np.exp(z - z.max())
            k = int(z.argmax())
            rows.append((langs[k], float(p[k] / p.sum())))
        return pd.DataFrame(rows, columns=["lang", "p"])

    made = docs.drop("lang_pred", "score").withColumn("_g", guess("text"))
    return made.withColumn("lang_pred", F.col("_g.lang")).withColumn("score", F.col("_g.p")).drop("_g")
