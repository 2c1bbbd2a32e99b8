"""Byte-level BPE encoding and decoding through one table of distinct words."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
from itertools import groupby

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.llm.common import checkpoint_dir, partitions

CHUNK_CHARS = 5_000_000
#: distinct words a task remembers; beyond it the memory starts anew
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file; its size is that of a vocabulary, not of the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def _pattern(pattern: str) -> regex.Pattern:
    # white space by its Unicode property, as the rank files' library has it
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of least rank is joined first, the leftmost of equal ones.

    Open pairs wait in a heap, so a word of any length takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends = list(range(1, n + 1))  # end of the part that starts here, 0 once it is joined to its left
    before = list(range(-1, n))
    open_pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(open_pairs)
    while open_pairs:
        _, i, end = heapq.heappop(open_pairs)
        mid = ends[i]
        if not mid or mid >= n or ends[mid] != end:  # one of its parts has changed since
            continue
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(open_pairs, (r, i, ends[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(open_pairs, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


def _pack(*arrays) -> bytes:
    """Arrays of 32-bit numbers as one compressed value: all first bytes, then all second ones and so on, since
    the high bytes of small numbers are nearly all zero."""
    data = np.concatenate([np.asarray(a, np.uint32) for a in arrays])
    return zstandard.compress(np.ascontiguousarray(data.view(np.uint8).reshape(-1, 4).T).tobytes(), 5)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _chunks(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """For each chunk, a run of rows of one partition of about CHUNK_CHARS characters (a longer text is one of its
    own): one row with the row keys and the positions of their pre-tokens as numbers in the chunk's word list
    (`_part` null), and one row per part of that list, a word's part being its hash."""

    def split(frames):
        from pyspark import TaskContext

        find = _pattern(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        words: dict[str, int] = {}
        keys, streams, room = [], [], CHUNK_CHARS

        def emit():
            listed = list(words)
            # frequent words get small numbers; within a part words are sent in sorted order. Both only help compression
            rank = np.empty(len(listed), np.uint32)
            counts = np.bincount(np.concatenate(streams), minlength=len(listed))
            rank[np.argsort(-counts, kind="stable")] = np.arange(len(listed), dtype=np.uint32)
            at = (pd.util.hash_array(np.array(listed, object)) % np.uint64(parts)).tolist() if listed else []
            order = sorted(range(len(listed)), key=lambda i: (at[i], listed[i]))
            rows = [(None, keys, [len(x) for x in streams], _pack([len(order)], rank[order], *(rank[x] for x in streams)))]
            for part, own in groupby(order, at.__getitem__):
                rows.append((part, None, None, zstandard.compress(json.dumps([listed[i] for i in own], ensure_ascii=False, separators=(",", ":")).encode(), 5)))
            frame = pd.DataFrame(rows, columns=["_part", "_keys", "_sizes", "_body"])
            frame["_part"] = frame["_part"].astype("Int32")
            frame.insert(0, "_chunk", (task << 32) + number)
            return frame

        for f in frames:
            for key, text in zip(f["_row"], f["_text"]):
                own = find(text)
                streams.append(np.fromiter((words.setdefault(w, len(words)) for w in own), np.uint32, len(own)))
                keys.append(key)
                room -= len(text)
                if room <= 0:
                    yield emit()
                    keys, streams, room, number = [], [], CHUNK_CHARS, number + 1
                    words.clear()
        if keys:
            yield emit()

    return docs.mapInPandas(split, "_chunk long, _part int, _keys array<string>, _sizes array<int>, _body binary")


def _bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """Writes a table in buckets of `key` to the shared folder and reads it back: no shuffle now, nor for a grouping by `key`."""
    name = f"staged_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{checkpoint_dir(df.sparkSession)}/staged/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; `ids` are the token ids as little-endian 32-bit integers.

    Pre-tokens keep their positions as numbers in the word lists of row chunks. The lists are dealt by the words'
    hashes, so that all places of a word meet in one task and it is encoded once there (a task with more than
    REMEMBERED distinct words may encode one again); the ids return to the chunks and are put together by
    position. A word in many chunks is sent once per chunk, packed with the chunk's other words of its part, never
    once per place. A null or empty text has no ids, an empty table gives no rows, a very long text is a chunk of
    its own; null ids, empty ids and repeated rows are kept. Only id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    n = partitions(docs)
    plain = docs.select(F.col(id_col).cast("string").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # written once, so that chunk numbers do not change on a rerun, and in buckets, so that the long streams are not shuffled
    chunks = _bucketed(_chunks(plain, pattern, n), n, "_chunk")

    def merge(frames):
        own, known = shared.value, {}
        for f in frames:
            out = []
            for body in f["_body"]:
                lens, flat = [], []
                for w in json.loads(zstandard.decompress(body)):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[w] = merge_word(w.encode(), own)
                    lens.append(len(ids))
                    flat += ids
                out.append(_pack([len(lens)], lens, flat))
            yield pd.DataFrame({"_of": f["_chunk"], "_at": f["_part"], "_ids": out})

    dealt = chunks.where(F.col("_part").isNotNull()).select("_chunk", "_part", "_body").repartition(n, "_part").sortWithinPartitions("_part")
    pieces = dealt.mapInPandas(merge, "_of long, _at int, _ids binary")
    streams = chunks.where(F.col("_part").isNull()).drop("_part")

    def assemble(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lens, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for data in right.sort_values("_at")["_ids"]:
            x = _numbers(data)
            lens.append(x[1 : 1 + x[0]])
            flat.append(x[1 + x[0] :])
        lens, flat = np.concatenate(lens).astype(np.int64), np.concatenate(flat)
        rows = []
        for keys, sizes, body in zip(left["_keys"], left["_sizes"], left["_body"]):
            x = _numbers(body)
            order, places = x[1 : 1 + x[0]], x[1 + x[0] :]
            length, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            length[order], start[order] = lens, np.cumsum(lens) - lens
            lo = 0
            for key, size in zip(keys, sizes):
                own = places[lo : lo + size]
                lo += size
                per = length[own]
                at = np.repeat(start[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())
                rows.append((key, flat[at].tobytes()))
        return pd.DataFrame(rows, columns=["_row", "ids"])

    done = streams.groupBy("_chunk").cogroup(pieces.repartition(n, "_of").groupBy("_of")).applyInPandas(assemble, "_row string, ids binary")
    return done.select(F.col("_row").cast(docs.schema[id_col].dataType).alias(id_col), "ids")


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table as rows (id, token)."""
    return spark.createDataFrame(pd.DataFrame({"id": list(ranks.values()), "token": list(ranks)}), "id int, token binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], digest_only: bool = False) -> DataFrame:
    """Adds `n_tokens`, `ids_sha256`, `decoded_sha256` and, unless `digest_only`, the decoded `text` to rows
    with `ids`. The token-byte table has the size of the vocabulary and is broadcast; ids are joined to it by
    position. Bytes that are no UTF-8 become replacement characters in `text` only."""
    shared = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, text string")
    def join(ids: pd.Series) -> pd.DataFrame:
        table = shared.value
        names = {}
        out = []
        for x in ids:
            own = np.frombuffer(x, np.uint32).tolist()
            data = b"".join(map(table.__getitem__, own))
            listed = " ".join([names.get(i) or names.setdefault(i, str(i)) for i in own])
            out.append((len(own), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), None if digest_only else data.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "text"])

    made = encoded.withColumn("_d", join("ids"))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ([] if digest_only else ["text"])
    return made.withColumns({n: F.col(f"_d.{n}") for n in names}).drop("_d")
