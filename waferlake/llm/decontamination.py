"""Benchmark decontamination by suffix arrays over the training words."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.llm.common import ALNUM_WORD, ascii_lower

SHARD_WORDS = 1 << 19
BLOCK_CHARS = 8_000_000


class Suite:
    """One block of test items: word ids, and the distinct test suffixes cut to `window` words as sort keys."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids = window, {}
        owners: dict[bytes, set[str]] = {}
        lengths: dict[bytes, int] = {}
        for item, text in items:
            tokens = [self.ids.setdefault(w, len(self.ids) + 1) for w in ALNUM_WORD.findall(ascii_lower(text or ""))]
            if not tokens:
                continue
            size = min(window, len(tokens))
            row = np.array(tokens, ">u4")
            for i in range(len(tokens) - size + 1):
                key = row[i : i + size].tobytes()
                owners.setdefault(key, set()).add(item)
                lengths[key] = size
        self.keys = sorted(owners)
        self.owners = [sorted(x for x in owners[k] if x is not None) for k in self.keys]
        self.sizes = np.array([lengths[k] for k in self.keys], np.int64)
        pairs = {k[:8] for k in self.keys}
        #: first words of test suffixes, and first pairs: other training suffixes cannot match any
        self.singles = np.unique(np.array([int.from_bytes(k[:4], "big") for k in self.keys if len(k) == 4], np.int64))
        self.pairs = np.unique(np.array([int.from_bytes(k, "big") for k in pairs if len(k) == 8], np.int64))

    def find(self, tokens: np.ndarray):
        """Yields (key number, start positions) of every test suffix that stands in a shard.

        The shard's suffix array holds the starts that share the first words of some test suffix, sorted by
        their first `window` words; each test suffix is placed by binary search on both sides.
        """
        if not self.keys:
            return
        padded = np.concatenate([tokens, np.zeros(self.window, np.int64)])
        first, second = padded[: len(tokens)], padded[1 : len(tokens) + 1]
        able = np.isin((first << 32) | second, self.pairs) & (second > 0)
        if len(self.singles):
            able |= np.isin(first, self.singles)
        starts = np.flatnonzero(able)
        if not len(starts):
            return
        kind = f"S{4 * self.window}"
        grid = np.ascontiguousarray(padded[starts[:, None] + np.arange(self.window)].astype(">u4"))
        suffixes = grid.view(kind).ravel()
        order = np.argsort(suffixes, kind="stable")
        array, starts = suffixes[order], starts[order]
        low = np.array(self.keys, kind)
        high = np.array([k + b"\xff" * (4 * self.window - len(k)) for k in self.keys], kind)
        left, right = np.searchsorted(array, low, "left"), np.searchsorted(array, high, "right")
        for k in np.flatnonzero(right > left):
            yield int(k), starts[left[k] : right[k]]


def suites(benchmark: DataFrame, window: int):
    """The test items in blocks of BLOCK_CHARS; an item is a block member whole."""
    block, room = [], BLOCK_CHARS
    for r in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        block.append((r["i"], r["text"]))
        room -= len(r["text"])
        if room <= 0:
            yield Suite(block, window)
            block, room = [], BLOCK_CHARS
    yield Suite(block, window)


def locate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and `spans` (first word and length of every
    longest verbatim stretch covered by test windows) to every row.

    The test items are the stated query set: each block of them is broadcast, with its size bounded by
    BLOCK_CHARS, and searched in every shard of training words. An item shorter than the window is one
    window. Null and empty texts have no words; an item with a null id hits words but is not counted.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(s) for s in suites(benchmark, window)]
    made = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")

    def judge(texts: list[str | None]):
        words = [ALNUM_WORD.findall(ascii_lower(t or "")) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        items: list[set] = [set() for _ in words]
        edges = np.zeros(int(starts[-1]) + 1, np.int64)
        for b in blocks:
            suite = b.value
            ids = suite.ids.get
            tokens = np.zeros(int(starts[-1]), np.int64)
            for s, w in zip(starts, words):
                tokens[s : s + len(w)] = [ids(x, 0) for x in w]
            for k, at in suite.find(tokens):
                np.add.at(edges, at, 1)
                np.add.at(edges, at + suite.sizes[k], -1)
                for d in np.unique(np.searchsorted(starts, at, "right") - 1):
                    items[d].update(suite.owners[k])
        covered = np.cumsum(edges[:-1]) > 0
        for d, (s, n) in enumerate(zip(starts, sizes)):
            hit = covered[s : s + n]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            spans = [{"first": int(a), "length": int(b - a)} for a, b in zip(turns[::2], turns[1::2])]
            found = ",".join(sorted(items[d]))
            yield int(n), int(hit.sum()), len(items[d]), hashlib.sha256(found.encode()).hexdigest(), bool(hit.any()), spans

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,length:long>>")
    def search(texts: pd.Series) -> pd.DataFrame:
        out, shard, room = [], [], SHARD_WORDS
        for t in texts:
            shard.append(t)
            room -= 1 + len(t or "") // 5
            if room <= 0:
                out.extend(judge(shard))
                shard, room = [], SHARD_WORDS
        out.extend(judge(shard))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    made = made.withColumn("_m", search("text"))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    return made.withColumns({n: F.col(f"_m.{n}") for n in names}).drop("_m")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows without any test window, their columns unchanged."""
    names = docs.columns
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text")
    return locate(made, benchmark, window).where(~F.col("contaminated")).select("_row.*")
