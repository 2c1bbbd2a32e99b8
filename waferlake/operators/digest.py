"""What recurs over the reports of the last days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waferlake.operators.detect import is_check
from waferlake.schema import REPORT
from waferlake.session import local_frame, staged


def recent(archive: DataFrame, day: str, today: str, days: int) -> DataFrame:
    """Partition filter on the report day."""
    return archive.where(F.col(day) >= F.date_sub(F.lit(today).cast("date"), days))


def matches_per_rule(trace: DataFrame) -> DataFrame:
    """The trace holds unmatched rules too, so a rule without a match keeps its zero."""
    return trace.groupBy("rule_rank", "rule").agg(F.count_if("matched").alias("matches"), F.count("*").alias("checks"))


def defect_modes(trace: DataFrame) -> DataFrame:
    """Reports per defect mode, each report once."""
    return trace.where("matched AND kind IN ('ITEM_RULE', 'CHAIN')").groupBy("rule").agg(
        F.count_distinct(*REPORT).alias("reports")
    )


def suspect_reports(findings: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Reports whose measurement is in doubt, each once: with a finding that says so, or with a finding of a
    check item that is out on the same sites as device items."""
    same = overlaps.where("overlap_shots > 0").select(*REPORT, "item")
    check = findings.where(is_check("item", "cat2")).join(same, [*REPORT, "item"], "left_semi")
    return findings.where("type = 'MEAS_SUSPECT'").select(*REPORT).unionByName(check.select(*REPORT)).distinct()


WORD = 64


def item_words(findings: DataFrame) -> DataFrame:
    """Vertical bitmaps of the critical out-of-spec items: (word, item, bits), one bit for each of 64 reports.

    Reports get numbers within their partition; words without a bit are not there.
    """
    out = findings.where("type = 'SPEC_OUT' AND severity = 'CRITICAL' AND item <> ''").select(*REPORT, "item").distinct()
    numbered = staged(out.select(*REPORT).distinct().withColumn("_no", F.monotonically_increasing_id()), "report-numbers")
    word, bit = F.floor(F.col("_no") / WORD).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_no") % WORD).cast("int"))
    return staged(out.join(numbered, REPORT).groupBy(word, "item").agg(F.bit_or(bit).alias("bits")), "item-words")


def supports(words: DataFrame, min_reports: int) -> list[tuple[str, int]]:
    """Items in enough reports, in order of their names. The dictionary bounds them."""
    counts = words.groupBy("item").agg(F.sum(F.bit_count("bits")).alias("n")).where(F.col("n") >= min_reports)
    return sorted((r["item"], r["n"]) for r in counts.collect())


def pair_supports(words: DataFrame, items: Sequence[str], min_reports: int) -> DataFrame:
    """(item_a, item_b, reports) of all pairs of the items that are together in enough reports.

    Words are dealt by number; each task intersects bitmaps and adds up one count for each pair, so a task
    gives at most as many rows as the dictionary has pairs, whatever the number of reports.
    """
    names = list(items)
    index = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(names), len(names)), np.int64)
        for batch in batches:
            words_of, place = np.unique(batch.column("word").to_numpy(), return_inverse=True)
            bits = np.zeros((len(names), len(words_of)), np.uint64)
            bits[[index[i] for i in batch.column("item").to_pylist()], place] = batch.column("bits").to_numpy().view(np.uint64)
            for k in range(len(names)):
                both[k] += np.bitwise_count(bits & bits[k]).sum(1, dtype=np.int64)
        a, b = np.nonzero(np.triu(both, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in a], pa.string()), pa.array([names[k] for k in b], pa.string()), pa.array(both[a, b], pa.int64())], names=["item_a", "item_b", "n"])

    # all bitmaps of a word are one row group of the batch stream: a list bounded by the dictionary
    rows = words.where(F.col("item").isin(names)).groupBy("word").agg(F.collect_list(F.struct("item", "bits")).alias("_w"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("_w")
            flat = held.flatten()
            word = np.repeat(batch.column("word").to_numpy(), np.diff(held.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(word), flat.field("item"), flat.field("bits")], names=["word", "item", "bits"])

    pairs = rows.mapInArrow(lambda batches: count(spread(batches)), "item_a string, item_b string, n long")
    return pairs.groupBy("item_a", "item_b").agg(F.sum("n").alias("reports")).where(F.col("reports") >= min_reports)


def _meet(group: DataFrame, words: DataFrame) -> DataFrame:
    """Every item's bitmap cut to the reports of a group."""
    return group.withColumnRenamed("bits", "_own").join(words, "word").select("word", "item", F.col("bits").bitwiseAND(F.col("_own")).alias("bits")).where("bits <> 0")


def item_sets(findings: DataFrame, min_reports: int, rule_sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(items, reports) of the item sets that recur together and of single items outside them.

    Frequent pairs start sets, those in most reports first (then by name), unless a set found before holds
    the pair. A set takes up item after item, in order of names, as long as it stays in enough reports; as
    support only falls, one pass over the items does. Sets inside the items of a rule (case ignored) are left
    out. A single frequent item is a set of its own if neither a reported set nor a rule holds it.

    Sets grow one after the other, since the ones before decide which pairs start at all; each step is one
    intersection of bitmaps, and no subset is listed.
    """
    spark = findings.sparkSession
    words = item_words(findings)
    single = supports(words, min_reports)
    names = [i for i, _ in single]
    ruled = [{x.lower() for x in r} for r in rule_sets]
    covered = lambda items: any({i.lower() for i in items} <= r for r in ruled)
    # at most the pairs of the dictionary
    seeds = sorted(((-r["reports"], r["item_a"], r["item_b"]) for r in pair_supports(words, names, min_reports).collect())) if len(names) > 1 else []
    done, out, used = [], [], set()
    for minus, a, b in seeds:
        if any({a, b} <= d for d in done):
            continue
        grown, reports, last = {a, b}, -minus, ""
        bits = _meet(words.where(F.col("item") == a).drop("item"), words.where(F.col("item") == b)).drop("item")
        while True:
            counts = _meet(bits, words.where((F.col("item") > last) & ~F.col("item").isin(*grown))).groupBy("item").agg(F.sum(F.bit_count("bits")).alias("n"))
            head = counts.where(F.col("n") >= min_reports).orderBy("item").head()
            if head is None:
                break
            last, reports = head["item"], head["n"]
            grown.add(last)
            bits = staged(_meet(bits, words.where(F.col("item") == last)).drop("item"), "set-words")
        done.append(grown)
        if not covered(grown):
            out.append((sorted(grown), reports))
            used |= grown
    out += [([i], n) for i, n in single if i not in used and not covered([i])]
    return local_frame(spark, out, "items array<string>, reports long")


def frequent_pairs(findings: DataFrame, min_reports: int) -> DataFrame:
    """Pairs of items out together in enough reports."""
    words = item_words(findings)
    return pair_supports(words, [i for i, _ in supports(words, min_reports)], min_reports)


def recurring_sites(out_points: DataFrame, min_reports: int) -> DataFrame:
    """Item and site out in enough reports."""
    per = out_points.select(*REPORT, "item", "chip_x", "chip_y").distinct()
    return per.groupBy("item", "chip_x", "chip_y").agg(F.count("*").alias("reports")).where(
        F.col("reports") >= min_reports
    )
