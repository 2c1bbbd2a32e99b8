"""Product codes of vectors: exact nearest entries in the Walsh-Hadamard domain, whole numbers only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.llm.common import staged

BATCH = 2048
#: scaled components from here on cannot be held with their squares in whole numbers of any column type
LARGEST = 2.0**62


def sequency(size: int) -> np.ndarray:
    """Rows of the natural Hadamard order by their number of sign changes: bit-reversed Gray code."""
    bits = size.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(size)]
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray], np.int64)


def transformed(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of zero-padded rows, coefficients in sequency order."""
    n, width = rows.shape
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, size), rows.dtype)
    out[:, :width] = rows
    half = 1
    while half < size:
        pairs = out.reshape(n, -1, 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return out[:, sequency(size)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row (lowest of equals) and the squared distance.

    The transform multiplies squared distances by its size, so differences of coefficients are squared and
    added in sequency order, where the low ones hold most of the distance. The first block gives every row a
    candidate; its full distance is the bound beyond which entries are given up after each further block.
    """
    x, c = transformed(rows), transformed(entries)
    size = x.shape[1]
    first = max(1, size // 4)
    part = np.zeros((len(x), len(c)), x.dtype)
    for k in range(first):
        part += (x[:, k, None] - c[None, :, k]) ** 2
    guess = part.argmin(1)
    bound = ((x - c[guess]) ** 2).sum(1)
    row, entry = np.nonzero(part <= bound[:, None])
    held = part[row, entry]
    for at in range(first, size, first):
        block = slice(at, at + first)
        held = held + ((x[row, block] - c[entry, block]) ** 2).sum(1)
        on = held <= bound[row]
        row, entry, held = row[on], entry[on], held[on]
    # the candidate itself stays to the end, so every row has an entry left; pairs are ordered by row and entry
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(held, starts) if len(starts) else held
    hit = np.flatnonzero(held == best[row])
    return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], best // size


def _whole(batch: pa.RecordBatch, width: int, pad: int) -> np.ndarray:
    """Components floor(1024 * x) of a batch as [row, component], padded to `pad` components."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * 1024.0).reshape(-1, width)
    out = np.zeros((len(scaled), pad), np.int64)
    out[:, :width] = scaled
    return out


def _exact(rows: np.ndarray, books: np.ndarray) -> type:
    """int64 where no square or sum of the search can overflow, else Python's whole numbers."""
    top = max(int(abs(rows).max(initial=0)), *(abs(int(v)) for v in (books.max(initial=0), books.min(initial=0))))
    width = rows.shape[1]
    return np.int64 if 16 * width * width * (top + 1) ** 2 < 2**62 else object


def _assign(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part and its squared distance, both as [row, part]; books are [part, entry, position]."""
    kind, width = _exact(rows, books), books.shape[2]
    found = [nearest(rows[:, p * width : (p + 1) * width].astype(kind), books[p].astype(kind)) for p in range(len(books))]
    return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def usable(vector: Column) -> Column:
    """No null, no empty vector, no null or non-finite component, none past LARGEST once scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(LARGEST / 1024)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


class Codebooks:
    """Final entries of every part as [part, entry, position], and the width of the vectors they fit."""

    def __init__(self, books: np.ndarray, width: int):
        self.books, self.width = books, width

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.books.ravel()).encode()).hexdigest()


def _rows(vectors: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *[F.col(c).alias(f"x_{c}") for c in more])
    return kept.where(usable(F.col("vector")))


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of all usable vectors, started from those of the smallest ids and moved `rounds` times.

    Each round gives every part to its nearest entry and moves the entry to the mean of its parts, rounded
    down; an entry without parts stays. Tasks add up their own rows, and only parts x entries sums reach the
    driver. The width is that of the vector with the smallest id; others are passed over. It is filled up
    with zeros to a multiple of `parts`. Rows that share an id are rows of their own, ordered by components.
    """
    kept = _rows(vectors, id_col, vector_col)
    order = [F.asc_nulls_last("id"), F.asc("vector")]
    head = kept.orderBy(*order).limit(1).collect()
    if not head:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    width = len(head[0]["vector"])
    kept = kept.where(F.size("vector") == width)
    pad = -(-width // parts) * parts
    first = kept.orderBy(*order).limit(entries).collect()
    start = np.zeros((len(first), pad), np.int64)
    start[:, :width] = np.floor(np.array([r["vector"] for r in first]) * 1024.0)
    books = start.reshape(len(first), parts, pad // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(kept, books, width)
    return Codebooks(books, width)


def _moved(kept: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    parts, entries, span = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python's whole numbers, so that no sum can overflow
        sums, counts = np.zeros((parts, entries, span), object), np.zeros((parts, entries), np.int64)
        for batch in _blocks(batches):
            rows = _whole(batch, width, parts * span)
            entry, _ = _assign(rows, books)
            small = int(abs(rows).max(initial=0)) * len(rows) < 2**62
            for p in range(parts):
                own = np.zeros((entries, span), np.int64 if small else object)
                np.add.at(own, entry[:, p], rows[:, p * span : (p + 1) * span])
                sums[p] += own
                counts[p] += np.bincount(entry[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        values = [[Decimal(int(v)) for v in row] for row in sums[p, e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.array(values, pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "sums"])

    added = kept.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
    moved = (
        added.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    out = books.copy()
    for r in moved.collect():  # at most as many rows as the codebooks have components
        out[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def encode(vectors: DataFrame, model: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, `code` (two hex digits a part) and `error` (squared distances summed over parts) of every usable vector.

    Vectors that are null, empty, of another width than the codebooks, or hold a null, non-finite or
    over-large component are left out. An error beyond a long is null. No other column is read.
    """
    books, width = model.books, model.width
    parts, _, span = books.shape
    kept = _rows(vectors, id_col, vector_col, label_col).where(F.size("vector") == width)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            entry, gap = _assign(_whole(batch, width, parts * span), books)
            errors = [e if e < 2**63 else None for e in (sum(map(int, g)) for g in gap)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column(f"x_{label_col}"), pa.array([bytes(r).hex() for r in entry.astype(np.uint8)], pa.string()), pa.array(errors, pa.int64())],
                names=[id_col, label_col, "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(code, f"`{id_col}` {kinds['id']}, `{label_col}` {kinds[f'x_{label_col}']}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """`encode` by codebooks trained on the same vectors, with `label_error` and `codebooks_sha256`.

    `label_error` sums the errors over equal labels, nulls together (null where the sum passes a long).
    Every usable row returns once, repeated rows too; without any the result is empty.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    model = train(vectors, parts, entries, rounds, id_col, vector_col)
    coded = staged(encode(vectors, model, id_col, vector_col, label_col), "codes")
    by_label = coded.groupBy(F.col(label_col).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(by_label, coded[label_col].eqNullSafe(by_label["_label"]), "left").drop("_label")
    return out.withColumn("codebooks_sha256", F.lit(model.sha256))
