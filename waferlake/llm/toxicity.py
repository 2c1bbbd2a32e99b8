"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 8
WINDOW = 4
WORD = re.compile(r"\w+")
#: a run of more than LONG characters without a separator is cut into pieces of PIECE, each OVERLAP into the next,
#: so that every n-gram of the run stands in a piece
LONG = 200
PIECE = 24
OVERLAP = 4
CACHE = 200_000


def words_of(text: str) -> list[str]:
    """Lower-cased words of a text; the pieces of a long run are words of their own."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    step = PIECE - OVERLAP
    return [p for w in words for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - OVERLAP, step)])]


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character 3- to 5-grams."""
    w = f"<{word}>"
    n = len(w)
    if w.isascii():  # one encoding for all grams
        data = w.encode()
        return list({zlib.crc32(data[i : i + k]) % BUCKETS for k in (3, 4, 5) for i in range(n - k + 1)} | {zlib.crc32(data) % BUCKETS})
    return list({zlib.crc32(w[i : i + k].encode()) % BUCKETS for k in (3, 4, 5) for i in range(n - k + 1)} | {zlib.crc32(w.encode()) % BUCKETS})


class Margins(dict):
    """Margins of words, looked up by word and computed on a miss; emptied when CACHE words are held."""

    def __init__(self, buckets: list[float]):
        self.buckets = buckets

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        own = subwords(word)
        got = self[word] = sum(map(self.buckets.__getitem__, own)) / len(own)
        return got


class Model:
    """Bucket vectors and the two-class output layer. A window of WINDOW words averages its words, a word
    averages its subword vectors; a text takes the soft maximum over its windows."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias
        self.margins = Margins((vectors @ (out[1] - out[0])).tolist())

    def __reduce__(self):
        return Model, (self.vectors, self.out, self.bias)

    def score(self, text: str | None) -> float:
        words = words_of(text or "")
        margins = np.fromiter(map(self.margins.__getitem__, words), np.float64, len(words))
        bias = float(self.bias[1] - self.bias[0])
        z = pool(window_means(margins)) + bias if len(margins) else bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def window_means(x: np.ndarray) -> np.ndarray:
    if len(x) <= WINDOW:
        return x.mean(keepdims=True)
    s = np.concatenate([[0.0], np.cumsum(x)])
    return (s[WINDOW:] - s[:-WINDOW]) / WINDOW


def pool(z: np.ndarray) -> float:
    top = z.max()
    e = np.exp(z - top)
    return float((e * z).sum() / e.sum())


def fit(texts: list[str], labels: list[int], epochs: int = 4, batch: int = 8, rate: float = 0.3, seed: int = 7) -> Model:
    """Joint training by Adagrad over batches of `batch` texts, the rarer class weighted up to a third. Without
    both classes the model is the constant share of label 1."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    out = np.stack([np.full(DIM, -0.5), np.full(DIM, 0.5)])
    share = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(labels)) < 2:
        vectors[:] = 0
        return Model(vectors, out, bias)
    vocab: dict[str, int] = {}
    docs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words_of(t)), np.int32) for t in texts]
    bags = [np.array(subwords(w), np.int32) for w in vocab]
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    flat, first = np.concatenate(bags) if bags else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])
    weights = np.where(y == 1, max(1.0, 0.5 / share / 1.5), 1.0)
    gv, go, gb = np.full(BUCKETS, 1e-6), np.full((2, DIM), 1e-6), np.full(2, 1e-6)
    usable = np.array([d for d, ids in enumerate(docs) if len(ids)], np.int64)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            lengths = np.array([len(docs[d]) for d in chosen])
            own, back = np.unique(np.concatenate([docs[d] for d in chosen]), return_inverse=True)
            at = ranges(first[own], sizes[own])
            heads = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
            diff = out[1] - out[0]
            means = np.add.reduceat(vectors[flat[at]], heads, axis=0) / sizes[own][:, None]
            # all windows of the batch, side by side, each text's from its own head on
            counts = np.maximum(lengths - WINDOW + 1, 1)
            width = np.repeat(np.minimum(lengths, WINDOW), counts)
            left = ranges(np.concatenate([[0], np.cumsum(lengths)[:-1]]), counts)
            total = np.concatenate([[0.0], np.cumsum((means @ diff)[back])])
            z = (total[left + width] - total[left]) / width
            text_at = np.concatenate([[0], np.cumsum(counts)[:-1]])
            e = np.exp(z - np.repeat(np.maximum.reduceat(z, text_at), counts))
            e /= np.repeat(np.add.reduceat(e, text_at), counts)
            pooled = np.add.reduceat(e * z, text_at)
            p = 1 / (1 + np.exp(-np.clip(pooled + bias[1] - bias[0], -30, 30)))
            err = (p - y[chosen]) * weights[chosen]
            dz = np.repeat(err, counts) * e * (1 + z - np.repeat(pooled, counts)) / width
            n = len(back)
            slope = np.bincount(left, dz, n + 1) - np.bincount(left + width, dz, n + 1)
            per_word = np.bincount(back, np.cumsum(slope[:n]), len(own))
            g_out = per_word @ means
            coef = np.bincount(flat[at], np.repeat(per_word / sizes[own], sizes[own]), BUCKETS)
            moved = np.flatnonzero(np.abs(coef) > 1e-7)
            c = coef[moved]
            gv[moved] += (c * c) * (diff @ diff) / DIM
            vectors[moved] -= (rate / np.sqrt(gv[moved]) * c)[:, None] * diff / 4
            go += np.stack([g_out**2, g_out**2])
            out -= 0.1 * rate / np.sqrt(go) * np.stack([-g_out, g_out])
            push = float(err.sum())
            gb += push * push
            bias -= 0.05 * rate / np.sqrt(gb) * np.array([-push, push])
    return Model(vectors.astype(np.float32), out.astype(np.float32), bias)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1])) + np.repeat(starts - ends + counts, counts)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, sample_chars: int = 24_000_000) -> Model:
    """A model from at most `sample` labelled rows, drawn by a hash of the id, and at most `sample_chars` of
    their texts: the documented bound of what the driver holds. A text that does not fit in what is left is passed
    over. Null ids, texts and labels teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    held_in = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    drawn = known.where(held_in).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    order = F.xxhash64("doc_id", "text")
    picked = texts.join(F.broadcast(drawn), "doc_id").orderBy(order).limit(sample)  # the drawn side has at most `sample` rows
    xs, ys, room = [], [], sample_chars
    for r in picked.toLocalIterator():
        if len(r["text"]) > room:
            continue
        room -= len(r["text"])
        xs.append(r["text"])
        ys.append(int(r["toxic"] == 1))
    return fit(xs, ys)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (score >= 0.5) to every row; a null or empty text scores the prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score, na_action=None).astype(float)

    made = docs.drop("score", "predicted").withColumn("score", rate("text"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
