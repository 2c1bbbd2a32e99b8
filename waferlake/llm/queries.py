"""Registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waferlake.llm import byte_bpe, decontamination, html_text, importance, language_id, license_scan, line_dedup, near_dedup, quality_rules, suffix_dedup, toxicity, vector_codes, warc
from waferlake.session import configure


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(F.coalesce(_remainder(4) != 2, F.lit(False))))
    return language_id.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark, sf_dir):
    out = license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_near_dedup(spark, sf_dir):
    return near_dedup.groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


def op6_html_text(spark, sf_dir):
    return html_text.main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = byte_bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(ids, ranks, digest_only=True).drop("ids")


def op8_warc(spark, sf_dir):
    out = warc.read_archives(warc.archives(_read(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark, sf_dir):
    out = quality_rules.assess(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.locate(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_importance_resampling(spark, sf_dir):
    out = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.drop_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress(_read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_toxicity, op3_language_id, op4_license_scan, op5_near_dedup, op6_html_text, op7_byte_bpe, op8_warc, op9_quality_rules, op10_decontamination,
    op11_importance_resampling, op12_suffix_dedup, op13_vector_codes)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _vector_codes_sql(rounds: int = 4) -> str:
    """Rounds of assigning parts and moving entries; distances are whole numbers, so a product by 256 leaves room for the index."""
    near = (
        "a{k} AS (SELECT x.vec_id, x.p, min(CAST(list_sum([(a.x - a.c) * (a.x - a.c) FOR a IN list_transform(range(len(x.v)), lambda i: {{'x': x.v[i + 1], 'c': b.v[i + 1]}})]) AS BIGINT) * 256 + b.e) AS m\n"
        "  FROM parts x JOIN b{k} b ON x.p = b.p GROUP BY x.vec_id, x.p)"
    )
    move = (
        "s{k} AS (SELECT a.p, a.m % 256 AS e, i, CAST(floor(CAST(sum(x.v[i + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM a{k} a JOIN parts x USING (vec_id, p), range(len(x.v)) r(i) GROUP BY ALL),\n"
        "m{k} AS (SELECT p, e, list(c ORDER BY i) AS v FROM s{k} GROUP BY p, e),\n"
        "b{n} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))"
    )
    steps = ",\n".join(f"{near.format(k=k)},\n{move.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(4) q(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256),
b0 AS (SELECT p, e, v FROM parts JOIN firsts USING (vec_id)),
{steps},
{near.format(k=rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLE = {
    "op1_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, regexp_replace({_LOWER.format('line')}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM lines),
bad AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL AND k.doc_id <> b.last) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE b.key IS NULL OR k.doc_id = b.last), '')) AS kept_sha256
FROM keyed k LEFT JOIN bad b ON k.key = b.key GROUP BY k.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([
    (CAST(('0x' || substr(h, 1 + CAST((i * 5 + k) // 4 AS INT), 1)) AS INT) >> CAST(3 - (i * 5 + k) % 4 AS INT)) % 2 * CAST(pow(2, 4 - k) AS INT)
    FOR k IN range(5)]) AS INT), 1) FOR i IN range(32)], '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b""",
    "op12_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
s AS (SELECT doc_id, unnest(range(octet_length(body) - 99)) AS pos, body FROM d WHERE octet_length(body) >= 100),
h AS (SELECT doc_id, pos, md5_number(CAST(array_slice(body, pos + 1, pos + 100) AS BLOB)) AS key FROM s),
r AS (SELECT doc_id, pos FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1),
g AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM g),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY doc_id, k),
edges AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, octet_length(body), octet_length(body) FROM d),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS z FROM edges)
SELECT doc_id, any_value(octet_length(body)) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(hex(array_slice(body, z + 1, a)), '' ORDER BY a, b))) AS kept_sha256
FROM pieces JOIN d USING (doc_id) GROUP BY doc_id""",
    "op13_vector_codes": _vector_codes_sql(),
}
