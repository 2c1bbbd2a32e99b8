"""Line deduplication by range-partitioned line hashes and keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waferlake.llm.common import lower_column, partitions, staged

STRIP = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines to drop per document, as a run-length coded bitmap.

    A line's key is the stripped line with A-Z lower-cased. A key of at least `min_chars` code points in
    at least `min_docs` documents stays only in its largest id. The result has one row per document that
    loses a line: id, `row_key` (hash of id and text) and `drop_runs`, the runs of dropped positions as
    (first, length); all other positions are kept.

    The hashes are range-partitioned by (hash, id), so one key's rows spread over as many ranges as they
    need; within a range they are sorted by hash, id and position. Range totals of a key are then combined,
    one row per range, and the verdict returns to the (range, key) groups. Rows with a null id hold no key.
    """
    key = lower_column(F.btrim("_line", F.lit(STRIP)))
    # stripping and lower-casing happen once per line, in a projection of its own
    lines = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .select("_id", "_row", "_pos", key.alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.unhex(F.md5("_key")).alias("_hash"))
    )
    # the range bounds are sampled from the table of hashes, so texts are split and hashed once
    lines = staged(lines, "line-hashes")
    ranged = (
        lines.repartitionByRange(partitions(docs), "_hash", "_id")
        .sortWithinPartitions("_hash", F.desc("_id"), "_pos")
        .groupBy("_hash", "_id")
        .agg(F.collect_set(F.struct("_row", "_pos")).alias("_at"))
        .withColumn("_range", F.spark_partition_id())
    )
    ranged = staged(ranged, "line-ranges")
    sums = ranged.groupBy("_range", "_hash").agg(F.count("*").alias("_n"), F.max("_id").alias("_top"))
    same = Window.partitionBy("_hash")
    verdict = (
        sums.select("_range", "_hash", F.sum("_n").over(same).alias("_docs"), F.max("_top").over(same).alias("_last"))
        .where(F.col("_docs") >= min_docs)
        .drop("_docs")
    )
    dropped = ranged.join(verdict, ["_range", "_hash"]).where(F.col("_id") < F.col("_last")).select("_id", F.explode("_at").alias("_a"))
    per_doc = dropped.groupBy("_id", F.col("_a._row").alias("row_key")).agg(F.sort_array(F.collect_set("_a._pos")).alias("_p"))
    starts = F.filter("_p", lambda p, i: (i == 0) | (F.get("_p", i - 1) != p - 1))
    ends = F.filter("_p", lambda p, i: (i == F.size("_p") - 1) | (F.get("_p", i + 1) != p + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))
    return per_doc.select(F.col("_id").alias(id_col), "row_key", runs.alias("drop_runs"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their kept lines in `text_col`, plus `n_lines` (before) and `n_dropped`.

    Every input row returns once, extra columns untouched. A null or empty text is one empty line and gives
    an empty text. Repeated rows get equal verdicts; rows with a null id lose nothing.
    """
    clean = docs.drop("n_lines", "n_dropped")
    maps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(
        F.col(id_col).alias("_mid"), F.col("row_key").alias("_mrow"), F.col("drop_runs").alias("_runs"))
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    joined = clean.join(maps, (F.col(id_col) == F.col("_mid")) & (row == F.col("_mrow")), "left").drop("_mid", "_mrow")
    gone = F.flatten(F.transform("_runs", lambda r: F.sequence(r["first"], r["first"] + r["length"] - 1)))
    joined = joined.withColumn("_all", _lines(F.col(text_col)))
    # the kept lines between dropped runs are copied slice by slice, not line by line
    cut = F.concat(
        F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("length"))), F.coalesce("_runs", F.array().cast("array<struct<first:int,length:int>>")),
        F.array(F.struct(F.size("_all").alias("first"), F.lit(0).alias("length"))))
    joined = joined.withColumn("_cut", cut)
    pieces = F.zip_with(
        F.slice("_cut", 1, F.size("_cut") - 1), F.slice("_cut", 2, F.size("_cut") - 1),
        lambda a, b: F.slice("_all", a["first"] + a["length"] + 1, b["first"] - a["first"] - a["length"]))
    return (
        joined.withColumn(text_col, F.array_join(F.flatten(pieces), "\n"))
        .withColumn("n_lines", F.size("_all").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)).cast("long"))
        .drop("_all", "_cut", "_runs")
    )
