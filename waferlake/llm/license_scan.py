"""Licence detection by a positional index of rare licence words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waferlake.llm.common import lower_column, words_column

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: passages of licence texts and notices; each must stand whole for its label
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "licensed under the apache license version 2 0": "apache-notice",
    "gnu general public license": "gnu-gpl",
    "gnu lesser general public license": "gnu-lgpl",
    "mozilla public license": "mpl",
}


def _index(phrases: list[str]) -> dict[str, float]:
    """Inverse document frequency of every word over the phrases."""
    sets = [set(p.split()) for p in phrases]
    return {w: math.log(1 + len(sets) / sum(w in s for s in sets)) for w in sorted(set().union(*sets))}


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to every row.

    A phrase is looked up by its two rarest words: their positions in the file, shifted by their place in
    the phrase, are intersected, and the whole phrase is verified at every place left. Nothing is shuffled.
    A null or empty text has no words, no labels and score 0. The score is 1 for a file with a label, else
    half the largest idf-weighted share of a phrase's words that the file holds.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates
    phrases = [*base, *templates]
    idf = _index(phrases)
    anchors, places = set(), {}
    for p in phrases:
        rare = sorted(enumerate(p.split()), key=lambda x: (-idf[x[1]], x[0]))[:2]
        places[p] = rare
        anchors.update(w for _, w in rare)
    made = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    made = made.withColumn("_w", words_column(lower_column(F.col(text_col)), SEPARATORS))
    spots = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(*sorted(anchors)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    made = made.withColumn("_spots", spots).withColumn("_known", F.array_intersect("_w", F.array(*map(F.lit, idf))))

    def shifted(word: str, place: int) -> Column:
        return F.transform(F.filter("_spots", lambda s: s["w"] == word), lambda s: s["i"] - place)

    def held(phrase: str) -> Column:
        own = sorted(set(phrase.split()))
        weight = lambda w: F.coalesce(*[F.when(w == t, F.lit(idf[t])) for t in own], F.lit(0.0))
        return F.aggregate("_known", F.lit(0.0), lambda acc, w: acc + weight(w)) / sum(idf[t] for t in own)

    def starts(phrase: str) -> Column:
        tokens = phrase.split()
        lists = [shifted(w, r) for r, w in places[phrase]]
        both = lists[0] if len(lists) == 1 else F.array_intersect(*lists)
        wanted = F.array(*map(F.lit, tokens))
        return F.filter(both, lambda a: (a >= 0) & (F.slice("_w", F.greatest(a, F.lit(0)) + 1, len(tokens)) == wanted))

    made = made.withColumns({f"_s{i}": starts(p) for i, p in enumerate(phrases)})
    names = [*base.values(), *templates.values()]
    found = [F.when(F.size(f"_s{i}") > 0, F.lit(n)) for i, n in enumerate(names)]
    joined = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.filter(F.array(*xs), lambda x: x.isNotNull()))), ",")
    every = F.flatten(F.array(*[F.col(f"_s{i}") for i in range(len(base))]))
    share = [held(p) for p in phrases]
    made = made.withColumn("_every", every).withColumn("labels", joined(found))
    return made.withColumns({
        "n_words": F.size("_w").cast("long"), "n_base": F.size("_every").cast("long"),
        "first_word": F.array_min("_every").cast("long"), "last_word": F.array_max("_every").cast("long"),
        "base_labels": joined(found[: len(base)]),
        "score": F.when(F.col("labels") != "", F.lit(1.0)).otherwise(0.5 * F.greatest(*share)),
    }).drop("_w", "_spots", "_known", "_every", *[f"_s{i}" for i in range(len(phrases))])
