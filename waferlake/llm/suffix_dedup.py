"""Removal of repeated byte strings by range-partitioned, locally sorted suffixes.

All starts of `width`-byte strings are compared, but they travel in runs. A string's anchor is the place of
its least 16-byte gram by hash (the leftmost of equals), so equal strings have equal anchors; starts next to
each other mostly share theirs. A run is all of them with the bytes their strings cover. Runs are
range-partitioned by the leading bytes of the suffix at the anchor, between splitters sampled from the
table, and every bucket sorts what it gets by multikey quicksort with machine words for characters: each
level sorts tied suffixes by their next eight bytes, and only those equal so far go on.

A gram that is a splitter may be a frequent one: it belongs to all buckets it touches and its runs are dealt
over them. Such a bucket knows the first place of a string among its own runs only, so those first places
are compared across the boundaries in a second, small shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waferlake.llm.common import partitions, staged

GRAM = 16
PIECE = 1 << 19
BLOCK = 1 << 20
FLUSH = 32 << 20
EXPAND = 1 << 18
#: sampled anchors for each bucket, each the one of so many in its text
SAMPLED, THIN = 128, 16
NO_ID = 2**63 - 1
FOUND = "id long, hash long, first long, stop long, digest binary"


def _words(buf: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at every place as one number, as an unaligned view."""
    return np.ndarray((len(buf) - 7,), f"{order}u8", buf, 0, (1,))


def _hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place."""
    w = _words(buf, "<").astype(np.uint64)
    h = w[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= (w[8:] + np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive values."""
    done = 1
    while 2 * done <= span:
        h, done = np.minimum(h[:-done], h[done:]), 2 * done
    return np.minimum(h[: len(h) - (span - done)], h[span - done :]) if done < span else h


def runs_of(buf: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and anchor of every run in texts that stand one after the other in `buf`.

    `buf` has at least 16 bytes more than the texts.
    """
    span = width - GRAM + 1
    h = _hashes(buf)
    least = _least(h, span)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    able = sizes >= width
    begins, lasts = begins[able], ends[able] - width
    edge = np.zeros(len(least) + 1, np.int8)
    edge[begins] += 1
    edge[lasts + 1] -= 1
    valid = np.cumsum(edge[:-1]) > 0
    fresh = np.zeros(len(least), bool)
    falls = np.zeros(len(least), bool)
    falls[1:] = least[1:] < least[:-1]
    fresh[1:] = (h[: len(least) - 1] == least[:-1]) | falls[1:]
    fresh[begins] = True
    falls[begins] = False
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return first, first, first
    last = np.minimum(np.append(first[1:], len(valid)) - 1, lasts[np.searchsorted(begins, first, "right") - 1])
    anchor = first + span - 1
    look = np.flatnonzero(~falls[first])
    anchor[look] = first[look] + np.lib.stride_tricks.sliding_window_view(h, span)[first[look]].argmin(1)
    return first, last - first + 1, anchor


class Splitters:
    """Ascending grams as pairs of words that part the buckets."""

    def __init__(self, grams: np.ndarray, buckets: int):
        """Quantiles of sampled grams; `grams` is [n, 2]."""
        grams = grams[np.lexsort((grams[:, 1], grams[:, 0]))]
        at = (np.arange(1, buckets) * len(grams)) // buckets if len(grams) else np.zeros(0, np.int64)
        self.high, self.low = grams[at, 0], grams[at, 1]

    def place(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest bucket a gram belongs to."""
        a, b = np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")
        for k in np.unique(a[b > a]):  # splitters that share the first word with some grams
            own = np.flatnonzero((a == k) & (b > a))
            low_part = self.low[k : b[own[0]]]
            a[own], b[own] = k + np.searchsorted(low_part, low[own], "left"), k + np.searchsorted(low_part, low[own], "right")
        return a, b


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Blocks of (id, hash, offset, bytes); a long text comes in pieces that share width - 1 bytes."""
    block, room = [], BLOCK
    for batch in batches:
        for i, h, text in zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text")):
            text = text.as_py()
            for at in range(0, max(1, len(text) - width + 1), PIECE):
                part = text[at : at + PIECE + width - 1]
                if len(part) >= width:
                    block.append((i, h, at, part))
                    room -= len(part)
                if room <= 0:
                    yield block
                    block, room = [], BLOCK
    if block:
        yield block


def _cut(block: list[tuple[int, int, int, bytes]], width: int):
    """The bytes of a block, and of its runs: first start, number of starts, anchor, gram words, piece."""
    sizes = np.array([len(p[3]) for p in block], np.int64)
    data = b"".join([p[3] for p in block] + [bytes(GRAM + 8)])
    buf = np.frombuffer(data, np.uint8)
    first, count, anchor = runs_of(buf, sizes, width)
    big = _words(buf, ">")
    piece = np.searchsorted(np.cumsum(sizes), first, "right")
    return data, first, count, anchor, big[anchor].astype(np.uint64), big[anchor + 8].astype(np.uint64), piece, np.cumsum(sizes) - sizes


def splitters(texts: DataFrame, buckets: int, width: int) -> Splitters:
    """Bucket bounds from a sample of anchors, SAMPLED for each bucket as a rule. They set balance only, not results."""
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    share = max(1, size // (SAMPLED * THIN * buckets * (width // 2)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _pieces(batches, width):
            _, _, _, _, high, low, _, _ = _cut(block, width)
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([high[::THIN], low[::THIN]], 1).tobytes()], pa.binary())], names=["grams"])

    some = texts.where(F.pmod(F.xxhash64("id", "hash"), F.lit(share)) == 0)
    grams = [np.frombuffer(r["grams"], np.uint64).reshape(-1, 2) for r in some.mapInArrow(sample, "grams binary").toLocalIterator()]
    return Splitters(np.concatenate([np.zeros((0, 2), np.uint64), *grams]), buckets)


def packed_runs(texts: DataFrame, bounds: Splitters, width: int) -> DataFrame:
    """Rows (bucket, runs): each task gathers the runs of its texts by bucket and packs them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        room = FLUSH

        def flush() -> pa.RecordBatch:
            zstd = zstandard.ZstdCompressor(level=3)
            keys = list(held)
            packs = []
            for k in keys:
                columns = [np.concatenate([part[c] for part in held[k]]) for c in range(5)]
                columns[0] = np.diff(columns[0], prepend=np.int64(0))
                packs.append(zstd.compress(pickle.dumps((columns, b"".join([part[5] for part in held[k]])))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "runs"])

        for block in _pieces(batches, width):
            data, first, count, anchor, high, low, piece, begins = _cut(block, width)
            lowest, highest = bounds.place(high, low)
            ids, hashes = np.array([p[0] for p in block], np.int64)[piece], np.array([p[1] for p in block], np.uint32)[piece]
            start = first - begins[piece] + np.array([p[2] for p in block], np.int64)[piece]
            # a gram of several buckets is dealt over them by the place of its run
            deal = ((start.astype(np.uint64) + ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % (highest - lowest + 1).astype(np.uint64)
            bucket = lowest + deal.astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            texts_of = [data[a:b] for a, b in zip(first[order].tolist(), (first + count + width - 1)[order].tolist())]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = order[a:b]
                rel = (anchor - first)[own].astype(np.uint8)
                held.setdefault(int(bucket[own[0]]), []).append((ids[own], hashes[own], start[own], rel, count[own].astype(np.uint8), b"".join(texts_of[a:b])))
            room -= int((count + width - 1).sum())
            if room <= 0:
                yield flush()
                room = FLUSH
        if held:
            yield flush()

    return texts.mapInArrow(pack, "bucket int, runs binary")


def tied(words: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of every suffix: equal numbers for equal `size` bytes at `at` within a group, -1 for a suffix of its own.

    Multikey quicksort by words: a level orders what is still tied by the next word, and only suffixes whose
    words are equal go on to the next. Sizes are equal within a group and at least eight; the last word ends
    with the suffix.
    """
    out = np.full(len(at), -1, np.int64)
    live, group, done = np.arange(len(at)), group.astype(np.int64), 0
    order = np.argsort(group, kind="stable")
    live, group = _shared(live[order], group[order])
    while len(live):
        word = words[at[live] + np.minimum(done, size[live] - 8)].astype(np.uint64)
        order = np.lexsort((word, group))
        live, group, word = live[order], group[order], word[order]
        turn = np.ones(len(live), bool)
        turn[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        live, group = _shared(live, np.cumsum(turn))
        done += 8
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        lead = np.repeat(live[heads], np.diff(np.append(heads, len(live))))
        over = size[live] <= done
        out[live[over]] = lead[over]
        live, group = live[~over], group[~over]
    return out


def _shared(live: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose group, in ascending order, has another member."""
    same = np.zeros(len(group) + 1, bool)
    same[1:-1] = group[1:] == group[:-1]
    keep = same[1:] | same[:-1]
    return live[keep], group[keep]


def _later(classes: np.ndarray, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a member of a class has an earlier one. Members at the very same place are one."""
    own = np.flatnonzero(classes >= 0)
    own = own[np.lexsort((starts[own], hashes[own], ids[own], classes[own]))]
    head = np.flatnonzero(np.diff(classes[own], prepend=-1))
    lead = np.repeat(own[head], np.diff(np.append(head, len(own))))
    out = np.zeros(len(classes), bool)
    out[own] = (ids[own] != ids[lead]) | (hashes[own] != hashes[lead]) | (starts[own] != starts[lead])
    return out


def repeats_in(packs: list[bytes], bounds: Splitters, width: int) -> Iterator[pa.RecordBatch]:
    """What one bucket finds: byte ranges of repeated strings, and with a digest the first places of strings
    whose gram other buckets hold too."""
    parts = [pickle.loads(zstandard.ZstdDecompressor().decompress(p)) for p in packs]
    for columns, _ in parts:
        columns[0] = np.cumsum(columns[0])
    ids, hashes, starts, rel, count = (np.concatenate([c[k] for c, _ in parts]).astype(np.int64) for k in range(5))
    data = b"".join([t for _, t in parts])
    del parts
    buf = np.frombuffer(data, np.uint8)
    words = _words(buf, ">")
    size = count + width - 1
    at = np.cumsum(size) - size
    high, low = words[at + rel].astype(np.uint64), words[at + rel + 8].astype(np.uint64)
    lowest, highest = bounds.place(high, low)
    crossing = highest > lowest

    order = np.lexsort((low, high))
    turn = np.ones(len(order), bool)
    turn[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    gram = np.empty(len(order), np.int64)
    gram[order] = np.cumsum(turn)

    # runs equal as a whole: all starts of the later ones repeat
    whole = tied(words, at, size, (gram * 256 + rel) * 256 + count)
    gone = _later(whole, ids, hashes, starts)
    yield _found(ids[gone], hashes[gone], starts[gone], (starts + size)[gone])

    # of runs equal as a whole only one goes on; it meets others of its gram start by start
    stays = np.flatnonzero(~gone)
    name = np.where(whole < 0, -1 - np.arange(len(whole)), whole)[stays]
    stays = stays[np.unique(name, return_index=True)[1]]
    order = np.argsort(gram[stays], kind="stable")
    sharing, _ = _shared(stays[order], gram[stays[order]])
    alone = stays[crossing[stays] & ~np.isin(stays, sharing)]
    for some in [*_portions(sharing, gram, count), *_portions(alone, gram, count)]:
        row = np.repeat(some, count[some])
        step = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        place = starts[row] + step
        classes = tied(words, at[row] + step, np.full(len(row), width), gram[row] * 256 + rel[row] - step)
        later = _later(classes, ids[row], hashes[row], place)
        # consecutive repeated starts of a run make one range
        turn = row[1:] != row[:-1]
        cut = later & (np.append(True, turn) | np.append(True, ~later[:-1]))
        tail = later & (np.append(turn, True) | np.append(~later[1:], True))
        b, e = np.flatnonzero(cut), np.flatnonzero(tail)
        yield _found(ids[row[b]], hashes[row[b]], place[b], place[e] + width)
        over = np.flatnonzero(crossing[row] & ~later)
        if len(over):
            digests = [hashlib.blake2b(data[a : a + width], digest_size=16).digest() for a in (at[row] + step)[over].tolist()]
            yield _found(ids[row[over]], hashes[row[over]], place[over], place[over] + width, digests)


def _portions(runs: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Runs in order of their grams, in portions of about EXPAND starts that hold whole grams."""
    if not len(runs):
        return
    runs = runs[np.argsort(gram[runs], kind="stable")]
    turn = np.flatnonzero(np.diff(gram[runs], prepend=-1))
    total = np.add.reduceat(count[runs], turn)
    portion = np.cumsum(total) // EXPAND
    cuts = turn[np.flatnonzero(np.diff(portion, prepend=-1))]
    yield from np.split(runs, cuts[1:])


def _found(ids, hashes, first, stop, digests=None) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(c, np.int64)) for c in (ids, hashes, first, stop)]
    columns.append(pa.nulls(len(ids), pa.binary()) if digests is None else pa.array(digests, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "first", "stop", "digest"])


def repeated_ranges(texts: DataFrame, width: int) -> DataFrame:
    """Byte ranges (id, hash, first, stop) that strings with an earlier occurrence cover; they may overlap.

    `texts` has id, hash and the text as bytes.
    """
    n = partitions(texts)
    bounds = splitters(texts, 2 * n, width)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, now = [], None
        for batch in batches:
            for bucket, runs in zip(batch.column("bucket").to_pylist(), batch.column("runs")):
                if bucket != now and packs:
                    yield from repeats_in(packs, bounds, width)
                    packs = []
                now = bucket
                packs.append(runs.as_py())
        if packs:
            yield from repeats_in(packs, bounds, width)

    dealt = packed_runs(texts, bounds, width).repartitionById(n, (F.col("bucket") / 2).cast("int")).sortWithinPartitions("bucket")
    found = staged(dealt.mapInArrow(sort, FOUND), "repeats")
    place = F.struct("id", "hash", "first")
    across = found.where("digest is not null").withColumn("_lead", F.min(place).over(Window.partitionBy("digest"))).where(place > F.col("_lead"))
    return found.where("digest is null").drop("digest").unionByName(across.drop("digest", "_lead"))


def _keys(id_col: Column, text: Column) -> list[Column]:
    return [F.coalesce(id_col.cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash")]


def drop_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, `kept` (the bytes left), n_bytes, n_removed, n_spans and `spans` (first, length) of every row.

    Texts count as UTF-8 bytes. A byte goes if a string of `width` bytes that covers it starts earlier too:
    in a smaller id, or in the same row at an earlier place. Strings are judged on the input and never cross
    rows. What is left of a character cut in two stays as it is, so `kept` is binary.

    Ids are whole numbers; a null id counts as the largest. A null text is empty; a text shorter than `width`
    loses nothing. Equal rows (same id and text) are one document, so neither makes the other repeat; rows
    that share an id with different texts come in the order of a hash of the text. A long text is cut in
    overlapping pieces, so memory does not grow with it until its kept bytes are put together. Other columns
    are not read. An empty table gives an empty result.
    """
    if width < GRAM + 8:
        raise ValueError(f"strings of at least {GRAM + 8} bytes")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("own"), *_keys(F.col(id_col), text), text.alias("text"))
    long = rows.where(F.octet_length("text") >= width).select("id", "hash", "text")
    ranges = repeated_ranges(long, width).groupBy("id", "hash").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    joined = rows.join(ranges, ["id", "hash"], "left").select("own", "text", "ranges")
    made = "kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,length:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_without(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist())]
            spans = pa.array([s for _, s in out], pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())])))
            sizes = [len(t) for t in batch.column("text").to_pylist()]
            kept = [k for k, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), spans],
                names=[id_col, "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    return joined.mapInArrow(cut, f"`{id_col}` {rows.schema['own'].dataType.simpleString()}, {made}")


def _without(text: bytes, ranges: list[dict] | None) -> tuple[bytes, list[dict]]:
    """A text without its ranges, and the maximal runs that went."""
    spans: list[list[int]] = []
    for first, stop in sorted((r["first"], r["stop"]) for r in ranges or ()):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([first, stop])
    bounds = [0, *(x for s in spans for x in s), len(text)]
    kept = b"".join([text[a:b] for a, b in zip(bounds[::2], bounds[1::2])])
    return kept, [{"first": a, "length": b - a} for a, b in spans]
