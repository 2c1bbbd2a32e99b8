"""Every corpus query against a brute-force counterpart or held-out labels, on the smallest tables."""

import brute
import duckdb
import pytest

from waferlake.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_lines(spark, sf, docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, sf, "op1_line_dedup")}
    assert got == brute.lines(docs)


def test_toxicity(spark, sf):
    wide = sf.replace("0.001", "0.01")
    truth = dict(duckdb.execute(f"SELECT doc_id, toxic FROM '{wide}/labels.parquet'").fetchall())
    got = [r for r in rows(spark, wide, "op2_toxicity") if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in got)
    assert right >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language(spark, sf):
    truth = dict(duckdb.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    got = [r for r in rows(spark, sf, "op3_language_id") if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_licences(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows(spark, sf, "op4_license_scan")}
    assert got == {i: brute.licences(t) for i, t in docs}


def test_near(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows(spark, sf, "op5_near_dedup")}
    assert got == brute.near(docs, 4)


def test_bpe(spark, sf, docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, sf, "op7_byte_bpe")}
    assert got == {i: brute.bpe(t) for i, t in docs}


def test_warc(spark, sf, con):
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, sf, "op8_warc")}
    assert got == set(con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLE['op8_warc']})").fetchall())


def test_quality(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows(spark, sf, "op9_quality_rules")}
    assert got == {i: brute.quality(t) for i, t in docs}


def test_leaks(spark, sf, docs, con):
    found = brute.windows(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows(spark, sf, "op10_decontamination")}
    assert got == {i: brute.leaks(t, found) for i, t in docs}


def test_importance(spark, sf, docs, con):
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in rows(spark, sf, "op11_importance_resampling")}
    want = brute.importance(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert got == {i: v for (i, _), v in want.items()}


def test_repeats(spark, sf, docs, con):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, "op12_suffix_dedup")}
    assert got == brute.repeats(docs)
    names = "doc_id, n_bytes, n_removed, n_spans, kept_sha256"
    assert {(i, *v) for i, v in got.items()} == set(con.execute(f"SELECT {names} FROM ({ORACLE['op12_suffix_dedup']})").fetchall())


def test_codes(spark, sf, con):
    got = rows(spark, sf, "op13_vector_codes")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    assert sorted(tuple(r[c] for c in names.split(", ")) for r in got) == sorted(con.execute(f"SELECT {names} FROM ({ORACLE['op13_vector_codes']})").fetchall())
