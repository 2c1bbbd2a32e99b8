"""Near-duplicate detection by bottom-k sketches from one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waferlake.llm.common import staged

SKETCH = 64
#: of SKETCH retained values a pair at the threshold shares 51 on average, deviation 3; fewer than this does not happen
SHARED = 30
#: least hashes kept of a set in the second look at a pair; sets of this size or less are compared exactly there.
#: A pair at the threshold shares 205 of them on average, deviation 6.4; fewer than FULL_SHARED does not happen
FULL = 256
FULL_SHARED = 160
BLOCK = 256
#: bits, at most, that mark the texts a step looks at again
MARKS = 1 << 26
CACHE = 100_000
#: rows a Python worker holds at once: texts of Spark's usual 10,000, twice for pairs, would take most of its memory
BATCH = 500


@contextmanager
def small_batches(spark: SparkSession):
    """At most BATCH rows at once go to a Python worker; what is run inside is what counts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= BATCH:
        spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, in UTF-8: bytes know the letters and white space of ASCII alone, 0x20 and 0x09 to 0x0D."""
    return (text or "").encode().lower().split()


class Hashes(dict):
    """64-bit hash of a word, kept once made."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


def shingle_set(words: list[bytes], width: int, cache: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than the width are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    ids = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ ids[i : len(ids) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(h ^ (h >> np.uint64(29)))


def text_key(words: list[bytes]) -> bytes | None:
    return hashlib.md5(b" ".join(words)).digest() if words else None


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, text_key, n_shingles, sketch, bits): `row_key` is a hash of the text as it stands, `text_key` a
    digest of the word sequence, `sketch` the SKETCH least hashes of the set and `bits` their bitmap of 512 bits.
    Staged, as everything after it reads it."""

    @F.pandas_udf("text_key binary, n_shingles long, sketch array<long>, bits array<long>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                own = shingle_set(words, width, cache)
                least = own[:SKETCH].copy()  # a slice would keep the whole set
                out.append((text_key(words), len(own), least.view(np.int64), bitmap(least)))
            yield pd.DataFrame(out, columns=["text_key", "n_shingles", "sketch", "bits"])

    made = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("row_key"), make(text_col).alias("_m")).select("_id", "row_key", "_m.*")
    return staged(made, "sketches")


def bitmap(values: np.ndarray) -> np.ndarray:
    """512 bits as eight longs, one bit for each value by its lowest nine bits."""
    at = (values % np.uint64(512)).astype(np.int64)
    out = np.zeros(8, np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def may_share(x: str, y: str, nx: str, ny: str):
    """False only for bitmaps whose sketches share fewer values than a pair at the threshold must.

    Values that fall on one bit of x are lost to the count, so they are granted; a shared value always leaves
    its bit in both."""
    ones = lambda of: sum((F.bit_count(of(i)) for i in range(8)), F.lit(0))
    both = ones(lambda i: F.col(x)[i].bitwiseAND(F.col(y)[i]))
    lost = F.least(F.col(nx), F.lit(SKETCH)) - ones(lambda i: F.col(x)[i])
    return both + lost >= F.least(least_shared(F.col(nx)), least_shared(F.col(ny)))


def least_shared(n):
    """Values a set of n shares, in the sketches, with any set at the threshold.

    A set that fits its sketch meets its partner in c >= 4 (n + m) / 9 values, of which the partner's sketch of a
    set of m > SKETCH may miss m - SKETCH; the least over all m from 0.8 n to n / 0.8 is where m is largest, or
    four fifths of n where the partner is no larger than the sketch. Larger sets go by SHARED."""
    whole = F.ceil(4 * n / F.lit(5))
    cut = n - F.greatest(F.floor(5 * n / F.lit(4)) - SKETCH, F.lit(0))
    return F.when(n <= SKETCH, F.least(whole, cut)).otherwise(SHARED).cast("int")


def _candidates(reps: DataFrame) -> DataFrame:
    """(value, rep, n): every representative under its rarest retained values. Two sets that share s of their k
    retained values share one of the first k - s + 1 in any common order, s being `least_shared`. Values nobody
    shares are left out afterwards."""
    kept = F.least(F.col("n"), F.lit(SKETCH))
    ranked = _placed(reps.select("rep", "n", F.explode("sketch").alias("v")), kept)
    return staged(ranked.where(F.col("at") <= kept - least_shared(F.col("n")) + 1).select("v", "rep", "n"), "inverted")


def _placed(entries: DataFrame, kept: Column) -> DataFrame:
    """Entries (rep, n, v) whose value several hold, with its place `at` among the `kept` values of the set, rarest first."""
    used = entries.groupBy("v").agg(F.count("*").alias("holders")).where(F.col("holders") > 1)
    # a value of one holder sorts first and takes a place, but is not sent: its rank is known by counting
    ranked = entries.join(used, "v")
    places = Window.partitionBy("rep").orderBy("holders", "v")
    return ranked.withColumn("at", F.row_number().over(places) + kept - F.count("*").over(Window.partitionBy("rep")))


def _attach(pairs: DataFrame, side: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Joins the side's columns by `key`; a representative in many pairs is copied once per BLOCK of them."""
    counts = pairs.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_salts"))
    salted = pairs.join(counts, key).withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.col("_salts"))).drop("_salts")
    wide = side.join(counts, side["rep"] == counts[key]).drop(key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    wide = wide.select(F.col("rep").alias(key), "_salt", *[F.col(c).alias(n) for c, n in names.items()])
    return salted.join(wide, [key, "_salt"]).drop("_salt")


def _marked(keys: DataFrame, column: str):
    """A test of hashes that holds for all of the column and for few others: a bit for each hash modulo a size that
    grows with the keys up to MARKS bits; beyond it only more others pass."""
    size = min(MARKS, 1 << max(10, (16 * keys.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(size))
    words = keys.groupBy(F.floor(at / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toArrow()
    held = np.zeros(size // 64, np.uint64)
    held[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy(np.int64) % size
        return pd.Series((held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return test


def _texts_of(wanted: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, t) of the wanted representatives `_r`, found by id and text hash; of the other texts hardly any travels."""
    keys = reps.join(wanted, F.col("rep") == F.col("_r")).select("rep", F.col("top._id").alias("_i"), F.col("top.row_key").alias("_k"))
    keys = staged(keys, "text-keys")
    found = texts.where(_marked(keys, "_k")("row_key")).join(keys, (F.col("_id") == F.col("_i")) & (F.col("row_key") == F.col("_k")))
    return found.groupBy("rep").agg(F.first("_t").alias("t"))


def _whole_sets(wanted: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(rep, n, s): every shingle of the wanted representatives."""

    @F.pandas_udf("array<long>")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Hashes()
        for texts in batches:
            yield texts.map(lambda t: shingle_set(words_of(t), width, cache).view(np.int64))

    made = _texts_of(wanted, reps, texts).select("rep", whole("t").alias("s"))
    return staged(made.select("rep", F.size("s").cast("long").alias("n"), "s"), "whole-sets")


def _parts(lists: DataFrame) -> DataFrame:
    """(v, main) of the lists that hold several components and a pair that is neither its star's nor its chain's: the
    largest component of each. A list of two has one pair."""
    parts = lists.groupBy("v", "comp").agg(F.count("*").alias("c"))
    mains = parts.groupBy("v").agg(F.max_by("comp", "c").alias("main"), F.count("*").alias("k"), F.sum("c").alias("held"))
    return mains.where((F.col("k") > 1) & (F.col("held") > 2)).select("v", "main")


def _across(lists: DataFrame, comps: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that may be near, and the whole sets of their members.

    Only members of lists that still hold several components matter. Their sets are inverted anew, whole: two sets at
    the threshold share ceil(4 n / 5) values, so one of the first n - ceil(4 n / 5) + 1 in any common order, and behind
    the first shared value, at places i and j, no more than min(n - i, m - j) others. A set whose rarest values are its
    own holds them at its first places, so it is in few lists and meets nobody who would have to hold them too."""
    held = lists.join(comps, "rep")
    wanted = staged(held.join(_parts(held), "v").select(F.col("rep").alias("_r")).distinct(), "open")
    sets = _whole_sets(wanted, reps, texts, width)
    n = F.col("n")
    placed = _placed(sets.select("rep", "n", F.explode("s").alias("v")), n)
    whole = staged(placed.where(F.col("at") <= n - F.ceil(4 * n / F.lit(5)) + 1).select("v", "rep", "n", "at").join(comps, "rep"), "whole-lists")
    # sizes within a quarter lie in the same size bin or a neighbouring one
    lists = staged(whole.join(_parts(whole), "v").withColumn("bin", F.floor(F.log("n") / F.log(F.lit(1.25)))), "open-lists")
    left = lists.where(F.col("comp") != F.col("main")).drop("main")
    right = lists.select("v", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("atb"), F.col("comp").alias("cb"), (F.col("comp") == F.col("main")).alias("of_main"))
    most = 1 + F.least(n - F.col("at"), F.col("nb") - F.col("atb"))
    met = left.join(right, ["v", "bin"]).where((100 * most >= 80 * (n + F.col("nb") - most)) & (F.col("comp") != F.col("cb")) & (F.col("of_main") | (F.col("rep") < F.col("b"))))
    return met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct(), sets


def _compared(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets pass 100 * both >= 80 * either; their bitmaps are looked at before."""
    slim = classes.select("rep", "n", "bits")
    left = _attach(pairs, slim, "a", {"n": "na", "bits": "xa"})
    likely = _attach(left, slim, "b", {"n": "nb", "bits": "xb"}).where(may_share("xa", "xb", "na", "nb"))
    likely = staged(likely.select("a", "b"), "likely")
    whole = _attach(_attach(likely, sets, "a", {"s": "sa"}), sets, "b", {"s": "sb"})
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(whole.where(100 * both >= 80 * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out and whose full sets pass 100 * both >= 80 * either.

    `reps` names a row of each representative by id and text hash in `top`, `texts` holds the rows. A pair is looked at by sketches of SKETCH values, then by
    sketches of FULL, made once for each text still wanted, and only larger sets that pass both by their texts."""

    @F.pandas_udf("boolean")
    def near(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for n, x, m, y in zip(na, sa, nb, sb):
            x, y = np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64)
            shared, union = np.intersect1d(x, y, True), np.union1d(x, y)
            if n <= SKETCH and m <= SKETCH:  # whole sets: the union must not be cut, or it is a sample without slack
                out.append(100 * len(shared) >= 80 * len(union))
            else:
                out.append(len(np.intersect1d(shared, union[:SKETCH], True)) >= SHARED)
        return pd.Series(out)

    @F.pandas_udf("binary")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Hashes()
        for texts in batches:
            yield texts.map(lambda t: shingle_set(words_of(t), width, cache)[:FULL].tobytes())

    @F.pandas_udf("int")
    def closer(na: pd.Series, wa: pd.Series, nb: pd.Series, wb: pd.Series) -> pd.Series:
        """1 for a link, 0 for none, -1 where only the texts can tell."""
        out = []
        for n, x, m, y in zip(na, wa, nb, wb):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = np.intersect1d(x, y, True)
            if n <= FULL and m <= FULL:
                out.append(int(100 * len(shared) >= 80 * (n + m - len(shared))))
            else:
                out.append(-1 if len(np.intersect1d(shared, np.union1d(x, y)[:FULL], True)) >= FULL_SHARED else 0)
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def same(ta: pd.Series, tb: pd.Series) -> pd.Series:
        cache, out, sets = Hashes(), [], {}

        def of(t):
            if t not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[t] = shingle_set(words_of(t), width, cache)
            return sets[t]

        for a, b in zip(ta, tb):
            x, y = of(a), of(b)
            both = len(np.intersect1d(x, y, True))
            out.append(100 * both >= 80 * (len(x) + len(y) - both))
        return pd.Series(out)

    slim = reps.select("rep", "n", "sketch")
    left = _attach(pairs, slim, "a", {"n": "na", "sketch": "sa"})
    both = _attach(left, slim, "b", {"n": "nb", "sketch": "sb"})
    likely = staged(both.where(near("na", "sa", "nb", "sb")).select("a", "b", "na", "nb"), "likely")
    # sets that fit their sketches are decided by then
    small = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    open_pairs = likely.where(~small)
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("_r")).distinct()
    second = staged(_texts_of(wanted, reps, texts).select("rep", wide("t").alias("w"), "t"), "second-sketches")
    judged = _attach(_attach(open_pairs, second, "a", {"w": "wa"}), second, "b", {"w": "wb"})
    judged = staged(judged.select("a", "b", closer("na", "wa", "nb", "wb").alias("link")).where(F.col("link") != 0), "judged")
    unsure = judged.where(F.col("link") < 0).select("a", "b")
    last = _attach(_attach(unsure, second, "a", {"t": "ta"}), second, "b", {"t": "tb"}).where(same("ta", "tb"))
    return staged(likely.where(small).select("a", "b").union(judged.where(F.col("link") > 0).select("a", "b")).union(last.select("a", "b")), "links")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp): least reachable representative; labels spread over links and jump to their label's label,
    so the rounds grow with the logarithm of a chain. Every round is staged."""
    edges = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = staged(nodes.select("rep", F.col("rep").alias("comp")), "labels")
    while True:
        told = edges.join(labels, edges["b"] == labels["rep"]).groupBy("a").agg(F.min("comp").alias("got"))
        best = labels.join(told, labels["rep"] == told["a"], "left").select("rep", F.col("comp").alias("was"), F.least("comp", F.coalesce("got", "comp")).alias("comp"))
        # a label learned for a member is told to the whole class of its former label
        hook = best.where(F.col("comp") < F.col("was")).groupBy("was").agg(F.min("comp").alias("to"))
        fresh = best.join(hook.withColumnRenamed("was", "_w"), F.col("was") == F.col("_w"), "left").select("rep", "was", F.least("comp", F.coalesce("to", "comp")).alias("comp"))
        fresh = staged(fresh, "labels")
        moved = fresh.where(F.col("comp") != F.col("was")).limit(1).count()
        labels = fresh.select("rep", "comp")
        if not moved:
            return labels


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives whose classes share an id: each class of such an id with its least."""
    several = known.groupBy("_id").agg(F.min("text_key").alias("ka"), F.max("text_key").alias("kz")).where(F.col("ka") != F.col("kz"))
    keys = known.select("_id", F.col("text_key").alias("kb")).join(several.drop("kz"), "_id").where(F.col("ka") != F.col("kb")).select("ka", "kb").distinct()
    node = lambda key, name: classes.select(F.col("text_key").alias(key), F.col("rep").alias(name))
    return staged(keys.join(node("ka", "a"), "ka").join(node("kb", "b"), "kb").select("a", "b"), "shared-ids")


def groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: the components of documents whose shingle sets have a
    Jaccard similarity of 0.8 or more.

    Equal word sequences form a class and its least id, with a hash of the words, stands for it, so copies are never paired. The classes'
    sketches are inverted by their rarest retained values. Inside one value's list each member is paired with
    the list's least member and with its neighbour by size; after these links are verified and merged, members
    of one list that are still in different components are inverted by their whole sets and paired across components,
    so nearly equal documents are not compared all with all and no link between components is lost. Sketches that hold their whole sets are
    compared exactly, others filter by the union's least values; full sets decide. Texts without a word have no shingles and are components of their own; rows
    with a null id are too, with a null component and kept. Repeated ids share one component, that of all their
    texts' links.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, width, id_col, text_col)


def _groups(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    sk = sketches(docs, width, id_col, text_col)
    known = sk.where(F.col("_id").isNotNull() & (F.col("n_shingles") > 0))
    # the class of a word sequence: partial aggregates, so a class of any size is one row per task
    classes = known.groupBy("text_key").agg(F.min("_id").alias("id"), F.count("*").alias("size"), F.min(F.struct("_id", "row_key")).alias("top"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    # an id with several texts is represented once per text, so a representative is its id and a hash of the words;
    # the least of a component has its least id
    classes = staged(classes.withColumn("rep", F.struct("id", F.xxhash64("text_key").alias("k"))).drop("id"), "classes")
    reps = classes.select("rep", "n", "sketch", "top")
    # the text of a representative is found by its id and the hash of the text as it stands, without splitting words anew
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("_t"))
    lists = _candidates(reps)

    ordered = Window.partitionBy("v").orderBy("n", "rep")
    near_n = lambda x, y: (F.least(x, y) >= 0.8 * F.greatest(x, y))
    tops = lists.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("top"))
    star = lists.join(tops, "v").where((F.col("rep") != F.col("top.rep")) & near_n(F.col("n"), F.col("top.n"))).select(F.col("top.rep").alias("a"), F.col("rep").alias("b"))
    chain = lists.select("v", "rep", "n", F.lag("rep").over(ordered).alias("p"), F.lag("n").over(ordered).alias("pn")).where(F.col("p").isNotNull() & near_n(F.col("n"), F.col("pn")))
    chain = chain.select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"))
    first = staged(star.union(chain).distinct(), "pairs")
    links = _verified(first, reps, texts, width).union(_shared_ids(known, classes))
    comps = components(reps.select("rep"), links)

    # lists that still hold several components: every member outside a list's largest component meets the members of
    # other components, so the largest one is never paired with itself
    cross, sets = _across(lists, comps, reps, texts, width)
    cross = staged(cross.join(first, ["a", "b"], "left_anti"), "pairs")
    comps = components(reps.select("rep"), links.union(_compared(cross, classes, sets)))

    member = classes.join(comps, "rep").select("text_key", "comp", "size")
    # only classes of several rows, or in another's component, change an id; the others keep their own
    moved = member.where(F.col("size") > 1).select("text_key", "comp").union(classes.where(F.col("size") == 1).join(comps.where(F.col("rep") != F.col("comp")), "rep").select("text_key", "comp"))
    salts = 32
    hot = moved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tagged = sk.drop("sketch", "bits", "row_key").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int")).join(hot, ["text_key", "_salt"], "left")
    comp = F.when(F.col("_id").isNotNull(), F.coalesce("comp.id", "_id"))
    return tagged.select(F.col("_id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("_id") == comp, F.lit(True)).alias("kept"))
