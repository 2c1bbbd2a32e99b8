"""Importance resampling towards a target distribution, by hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waferlake.llm.common import checkpoint_dir, partitions, staged

#: per byte: A-Z lower-cased, digits, letters and bytes past ASCII as they are, everything else a space
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))
RUN = 1 << 18
SKETCH = "n_words long, n_features long, steps binary"


def scanner(n: int) -> regex.Pattern:
    """Matches each run of n words with the space before it; the lookahead asks for a boundary behind it."""
    return regex.compile(rb" [^ ]++" * n + rb"(?= )")


def _zeros(longest: int) -> np.ndarray:
    """[length, byte, value]: what a byte of a CRC-32 adds to it after so many further zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (one & np.uint32(1)))
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(longest):
        out[k + 1] = one[out[k] & 255] ^ (out[k] >> np.uint32(8))
    return out


LONGEST = 255
ZEROS = _zeros(LONGEST)
SPACE = np.uint32(zlib.crc32(b" "))


def _extended(crc: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """CRCs moved on over `length` zero bytes, the part of a CRC that an earlier prefix has in a later one."""
    out = ZEROS[length, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ ZEROS[length, k, (crc >> np.uint32(8 * k)) & 255]
    return out


def buckets_of(texts: list[bytes | None], scanners: list[regex.Pattern], size: int) -> list[tuple[int, np.ndarray]]:
    """For each UTF-8 text its number of words, and the buckets of all its n-grams, ascending.

    Separators collapse to single spaces, so an n-gram is a plain span of the text. The overlapped scan goes
    on one byte after a match began, which gives the run that starts at the next word. The first scan also
    carries the CRC of the text so far; that of a span is what its end has beyond its start.
    """
    crc = zlib.crc32
    lines = [b" ".join([b"", *(t or b"").translate(PLAIN).split(), b""]) for t in texts]
    stops: list[list[int]] = [[] for _ in scanners]
    counts = [[] for _ in scanners]
    prefix: list[int] = []
    for line in lines:
        state, had = 0, len(prefix)
        for m in scanners[0].finditer(line, overlapped=True):
            prefix.append(state := crc(m[0], state))
            stops[0].append(m.end())
        counts[0].append(len(prefix) - had)
        for n in range(1, len(scanners)):
            own = [m.end() for m in scanners[n].finditer(line, overlapped=True)]
            stops[n] += own
            counts[n].append(len(own))
    words = np.array(counts[0], np.int64)
    offset = np.cumsum(words) - words
    done, end = np.array(prefix, np.uint32), np.array(stops[0], np.int64)
    # a text's first word starts after one space, every other after the word before and a space
    heads = offset[words > 0]
    start, before = np.roll(end, 1), np.roll(done, 1)
    start[heads], before[heads] = 0, 0
    start, before = start + 1, _extended(before, 1) ^ SPACE
    found = []
    for n in range(len(scanners)):
        # the k-th match of a text starts with its k-th word and ends with the n-th from there
        count = np.array(counts[n], np.int64)
        first = np.arange(count.sum()) + np.repeat(offset - (np.cumsum(count) - count), count)
        length = np.array(stops[n], np.int64) - start[first]
        code = done[first + n] ^ _extended(before[first], np.minimum(length, LONGEST))
        for k in np.flatnonzero(length > LONGEST):
            own = int(np.searchsorted(np.cumsum(count), k, "right"))
            code[k] = crc(lines[own][start[first[k]] : stops[n][k]])
        found.append(np.split((code % np.uint32(size)).astype(np.uint16 if size <= 1 << 16 else np.uint32), np.cumsum(count)[:-1]))
    return [(int(w), np.sort(np.concatenate(own), kind="stable").astype(np.uint32)) for w, own in zip(words, zip(*found))]


def _runs(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Neighbouring texts of some RUN bytes together; a longer text is a run of its own."""
    run, room = [], RUN
    for t in texts:
        run.append(t)
        room -= len(t or b"")
        if room <= 0:
            yield run
            run, room = [], RUN
    if run:
        yield run


def sketches(texts: DataFrame, text_col: str, grams: int, size: int) -> DataFrame:
    """Replaces the text of every row by n_words, n_features and `steps`: the ascending buckets of its
    features, each as the difference from the one before."""
    others = [c for c in texts.columns if c != text_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [scanner(n + 1) for n in range(grams)]
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            rows = [r for some in _runs(texts) for r in buckets_of(some, scanners, size)]
            made = [
                pa.array([n for n, _ in rows], pa.int64()),
                pa.array([len(b) for _, b in rows], pa.int64()),
                pa.array([np.diff(b, prepend=np.uint32(0)).astype("<u4").tobytes() for _, b in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, "n_words", "n_features", "steps"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*others).schema)
    return texts.mapInArrow(scan, ", ".join(x for x in (head, SKETCH) if x))


def totals(sketched: DataFrame, size: int) -> np.ndarray:
    """Features per bucket over all rows; every task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for steps in batch.column("steps").to_pylist():
                held += np.bincount(np.cumsum(np.frombuffer(steps, "<u4")), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    # at most `size` rows come back
    for r in sketched.select("steps").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares in target and source, rounded down."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def weigh(sketched: DataFrame, gain: np.ndarray) -> DataFrame:
    """Replaces `steps` by `weight`, the gains of all features of the row summed up."""
    others = [c for c in sketched.columns if c != "steps"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.cumsum(np.frombuffer(s, "<u4"))].sum()) for s in batch.column("steps").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sums, pa.int64())], names=[*others, "weight"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sketched.select(*others).schema)
    return sketched.mapInArrow(add, f"{head}, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw, rounded down, fixed by seed and id (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], first: int) -> DataFrame:
    """Adds `rank` (1, 2, 3 ... by `order`) to the first rows; it is null for all after them.

    The rows are range-partitioned by the order and every range counts on from the sizes of those before
    it, so no task sees more than its range. Equal rows are ranked one after the other.
    """
    columns = rows.columns
    cut = staged(rows.repartitionByRange(partitions(rows), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row for each range
    sizes = dict(cut.groupBy("_range").count().collect())
    offset, before = {}, 0
    for k in sorted(sizes):
        offset[k], before = before, before + sizes[k]
    drawn = [k for k in sorted(offset) if offset[k] < first]
    if not drawn:
        return cut.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = drawn[-1]
    starts = F.create_map(*[F.lit(x) for k in drawn for x in (k, offset[k])])
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") + F.element_at(starts, F.col("_range")).cast("long")
    top = cut.where(F.col("_range") <= last).withColumn("_at", at)
    top = top.select(*columns, F.when(F.col("_at") <= first, F.col("_at")).alias("rank"))
    return top.unionByName(cut.where(F.col("_range") > last).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, grams: int = 3, size: int = 10_000,
    seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """The id of every row of `docs` with n_words, n_features, weight, score and rank.

    Features are all runs of 1 to `grams` words, words being runs of ASCII letters and digits and of any
    character past ASCII, with A-Z lower-cased. `weight` sums the features' log ratios of target to source
    share, `score` adds Gumbel noise, and of the rows with at least `min_words` words the best `percent` per
    cent are drawn: they carry their `rank`, all others null. Ties go to the smaller id, null ids last.

    A null or empty text has no words, weight 0 and is never drawn (with `min_words` 0 it may be). Repeated
    rows are rows of their own, counted and ranked each. Texts of any length are scanned whole. Extra columns
    of either table are not read, so their names may clash. Without rows the result is empty; without a
    target all its counts are 0.
    """
    checkpoint_dir(docs.sparkSession)
    mine = sketches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", grams, size)
    mine = staged(mine, "sketches", compression="zstd")
    wanted = sketches(target.select(F.col(target_col).alias("text")), "text", grams, size)
    gain = gains(totals(mine, size), totals(wanted, size))
    rows = weigh(mine, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    rows = staged(rows, "weights")
    able = F.col("n_words") >= min_words
    first = percent * rows.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    out = ranked(rows.where(able), order, first).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of `docs` whose id was drawn, columns unchanged. Rows that share a drawn id all return."""
    chosen = resample(docs, target, id_col=id_col, **settings).where("rank is not null").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_drawn"]), "left_semi")
