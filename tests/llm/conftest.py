import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes small tables and returns their folder."""

    def write(**named):
        folder = tmp_path_factory.mktemp("tables")
        for name, df in named.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


HARD = [
    (0, None, None, None), (1, "", "en", None), (2, " \n\t\n ", None, "s"), (3, "Mit License. MIT   license, the apache LICENSE!\nGeneral Public License", "en", "s"),
    (4, "the same long line of words stands here\nunique to four", "en", "s"), (5, "The SAME long line of words stands here  \nunique to five", "en", "s"),
    (6, "\tthe same long line of words stands here\nthe same long line of words stands here", "de", "t"),
    (7, "a b c a b c a b c d e f", "de", "t"), (8, "Привет мир ÄÖÜ 😀 it's 3 o'clock      x\x1cy", None, "t"), (9, "one", "fr", "s"), (10, "one", "fr", "s"),
    (11, " ".join(f"w{i % 97}" for i in range(60_000)), "en", "s"), (11, " ".join(f"w{i % 97}" for i in range(60_000)), "en", "s"), (None, "no id at all, one two three", "en", "s"),
    (12, " ".join(f"q{i}" for i in range(400)), "en", "s"), (13, " ".join(f"q{i}" if i != 200 else "zz" for i in range(400)), "en", "s"), (14, " ".join(f"q{i}" if i != 300 else "yy" for i in range(400)), "en", "s"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, long, tied and repeated rows, with extra columns of clashing names."""
    df = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit("x"), "kept": F.lit(1), "n_words": F.lit("y"), "labels": F.lit(0), "_id": F.lit(5), "rep": F.lit(2), "n": F.lit(1)})
