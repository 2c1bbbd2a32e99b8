"""Null, empty, long, tied and repeated rows, empty tables and clashing columns."""

import random

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waferlake.llm import byte_bpe, decontamination, html_text, importance, language_id, license_scan, line_dedup, near_dedup, quality_rules, suffix_dedup, toxicity, vector_codes, warc


def test_lines(hard):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(hard).collect()}
    assert got[4] == (2, 1, "unique to four") and got[5] == (2, 1, "unique to five") and got[6][1] == 0
    assert got[0] == (1, 0, "") and got[None][1] == 0
    assert line_dedup.dedup_lines(hard).count() == hard.count()


def test_toxicity(spark, hard):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score(hard, toxicity.train(hard, labels)).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(hard.limit(0), toxicity.train(hard.limit(0), labels)).count() == 0


def test_toxicity_long_runs(spark):
    """A toxic word past the 200th character of a run without separators counts, when scored and when learned."""
    model = toxicity.fit(["good day", "vile scum"] * 40, [0, 1] * 40)
    run = "".join(chr(0x4E00 + i % 50) for i in range(300))
    assert model.score(f"{run}vilescum") != model.score(f"{run}goodday") and model.score(f"{run}vilescum{run}") > model.score(run * 2)
    late = toxicity.fit([f"{run}good", f"{run}vile"] * 40, [0, 1] * 40)
    assert late.score("vile") > late.score("good")
    run = "".join(map(chr, range(0x4E00, 0x4E00 + 777)))
    for n in (200, 201, 204, 205, 224, 225, 777):
        grams = {run[i : i + 5] for i in range(n - 4)}
        assert grams == {w[i : i + 5] for w in toxicity.words_of(run[:n]) for i in range(len(w) - 4)}, n


def test_toxicity_long_text(spark):
    """One labelled text over the room of the sample does not end it."""
    from waferlake.llm.toxicity import train

    docs = spark.createDataFrame([(i, "x " * 400 if i % 8 < 6 else ("vile scum" if i % 2 else "good day")) for i in range(160)], "doc_id long, text string")
    model = train(docs, docs.selectExpr("doc_id", "cast(text like 'vile%' as int) as toxic"), sample_chars=700)
    assert model.score("vile scum") > 0.5 > model.score("good day")


def test_language(hard):
    got = {r.doc_id: r.lang_pred for r in language_id.predict(hard, language_id.train(hard)).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[12] == "en"
    assert {r.lang_pred for r in language_id.predict(hard, language_id.train(hard.limit(0))).collect()} == {"und"}


def test_licences(hard):
    got = {r.doc_id: r for r in license_scan.scan(hard).collect()}
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 0, 7, "apache,gpl,mit")
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == "" and got[0].score == 0


def test_near(hard):
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.groups(hard, 4).collect()}
    assert got[13] == (12, False) and got[14] == (12, False) and got[10] == (9, False) and got[0] == (0, True) and got[11] == (11, True)
    assert near_dedup.groups(hard.limit(0), 4).count() == 0


def test_near_whole_sketches(spark):
    """Pairs of 60 to 64 shingles at a Jaccard similarity of 0.80 to 0.83, and pairs just below it."""
    rows, sizes = [], [(63, 63, 56), (64, 64, 57), (64, 63, 57), (63, 62, 56), (60, 60, 54)]
    for k in range(60):
        a, b, both = sizes[k % 5] if k < 50 else (63, 63, 55)
        rows.append((2 * k, " ".join(f"s{k}x{i}" for i in range(a))))
        rows.append((2 * k + 1, " ".join(f"s{k}x{i}" for i in range(a - both, a - both + b))))
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert [k for k in range(60) if got[2 * k + 1] == 2 * k] == list(range(50))


def test_near_shared_ids(spark):
    """An id with several texts joins the components of all of them, whichever text is read first."""
    text = lambda k, last: " ".join(f"t{k}x{i}" for i in range(100)) + f" {last}"
    rows = [(10, text(k, "a")) for k in range(6)] + [(20 + k, text(k, "b")) for k in range(6)] + [(5, text(2, "a")), (30, text(9, "a"))]
    got = {(r.doc_id, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == {(i, 5) for i in (5, 10, *range(20, 26))} | {(30, 30)}


def test_bpe(hard):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.text) for r in byte_bpe.decode(byte_bpe.encode(hard, ranks, public_tokenizers.PATTERN), ranks).collect())
    want = sorted((str(r.doc_id), *brute.bpe(r.text), r.text or "") for r in hard.collect())
    assert got == want
    assert byte_bpe.encode(hard.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_warc(spark, version):
    pages = spark.createDataFrame([(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\n"), (5, "u", "é\r\n\r\nWARC/1.1\n"), (None, "u", "x")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.archives(pages, version=version)).collect())
    assert got == [(0, 1, "response", None), (1, 1, "revisit", 2), (2, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 15, "response", None), (5, 15, "response", None)]
    assert warc.read_archives(warc.archives(pages.limit(0))).count() == 0


def test_quality(hard):
    got = {r.doc_id: r for r in quality_rules.assess(hard).collect()}
    assert got[0].base_failed and not got[12].base_failed and got[12].kept and got[7].n_repeat_words == 9
    assert quality_rules.assess(hard.limit(0)).count() == 0


def test_leaks(spark, hard):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(5, 20))), (2, "O'Clock"), (3, None), (4, "")], "item_id long, text string")
    found = brute.windows([(1, " ".join(f"q{i}" for i in range(5, 20))), (2, "O'Clock")])
    for r in decontamination.locate(hard, bench).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.leaks(r.text, found)
    assert decontamination.decontaminate(hard, bench).columns == hard.columns
    assert decontamination.locate(hard, bench.limit(0)).where("contaminated").count() == 0


def test_html():
    page = "<html><head><title>t</title><script>x</script></head><body><nav><ul><li>menu<li>two</ul></nav><div class=ad>buy</div><article><h1>Head</h1><p><b>One\n two &amp; three<br><p>Be.<p>Four<aside>no</aside></article><div id=comments><p>me too</p></div><footer>f</footer>"
    assert html_text.extract(page) == "Head\nOne two & three\nBe.\nFour"
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("plain  text") == "plain text"


def test_html_inline_noise():
    for noise in ("<script>x</script>", "<style>x</style>", "<button>x</button>", "<span class='ad'>x</span>", "<select><option>x</select>", "<button><p>x</p></button>"):
        assert html_text.extract(f"<article><p>a</p>{noise}<p>b</p></article>") == "a\nb", noise
        assert html_text.extract(f"<body><article><p>a {noise} b</article>") in ("a b", "a\nb"), noise


def test_html_articles():
    """Every article the clusters reach is kept, whatever its length; one of links alone is not reached."""
    long, links = " ".join(["word"] * 60), "".join(f"<p><a href=/{i}><b><i>l{i}</i></b></a></p>" for i in range(30))
    page = f"<body><article><h1>One</h1><p>{long}</article><article><h1>Two</h1><p>{long} {long}</article><article>{links}</article>"
    assert html_text.extract(page).split("\n") == ["One", long, "Two", f"{long} {long}"]
    # a teaser of links inside <article> beside the text does not decide the page
    outside = f"<body><div><p>{long}</p><p>{long}</p></div><div>{links}</div><article>{links}</article>"
    assert html_text.extract(outside).split("\n")[:2] == [long, long]


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.main_text(pages).select("text", F.col("n_chars")).collect()) == [("", 0), ("a", 1)]


def test_importance(spark, hard):
    bench = spark.createDataFrame([(1, "Mit license q1 q2", "x"), (2, None, "y"), (3, "", "z")], "item_id long, text string, steps string")
    got = importance.resample(hard.withColumn("steps", F.lit(1)), bench, percent=50).collect()
    want = brute.importance([(r.doc_id, r.text) for r in hard.collect()], [(1, "Mit license q1 q2")], percent=50)
    assert len(got) == hard.count()
    plain = {i: v[:3] for (i, _), v in want.items()}
    assert {r.doc_id: (r.n_features, r.weight, r.score) for r in got} == plain
    drawn = sorted(r["rank"] for r in got if r["rank"])
    able = [r for r in got if r.n_words >= 20]
    assert drawn == list(range(1, len(able) // 2 + 1))
    best = sorted(able, key=lambda r: (-r.score, r.doc_id is None, r.doc_id))[: len(drawn)]
    assert sorted(r.score for r in best) == sorted(r.score for r in got if r["rank"])
    assert importance.resample(hard.limit(0), bench).count() == 0
    assert {r["rank"] for r in importance.resample(hard, bench.limit(0), percent=0).collect()} == {None}
    assert importance.draw(hard, bench, percent=50).columns == hard.columns


def test_importance_words():
    """Overlapped spans are the runs of consecutive words, also where words repeat or a separator is a letter's neighbour."""
    rx = [importance.scanner(n) for n in (1, 2, 3)]
    texts = ["", "...", "A", "a a a a", "B-52s, don't stop", "", "é\u00a0x\ty", "x" * 5000 + " y " + "z" * 200 + " " + "q" * 60, None]
    for some in ([t] for t in texts), (texts,):
        for run in some:
            for text, (n, got) in zip(run, importance.buckets_of([None if t is None else t.encode() for t in run], rx, 10_000), strict=True):
                w = brute.alnum(text)
                want = sorted(importance.zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))
                assert n == len(w) and got.tolist() == want


def test_repeats(spark, hard):
    got = suffix_dedup.drop_repeats(hard).collect()
    assert len(got) == hard.count()
    docs = {(2**63 if r.doc_id is None else r.doc_id): r.text for r in hard.collect()}
    want = brute.repeats(docs.items())
    for r in got:
        key = 2**63 if r.doc_id is None else r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans, brute.hashlib.sha256(r.kept).hexdigest()) == want[key]
        assert sum(s["length"] for s in r.spans) == r.n_removed
    assert suffix_dedup.drop_repeats(hard.limit(0)).count() == 0


def test_repeats_made(spark, monkeypatch):
    """Passages moved, overlapping, periodic, cut in characters, frequent, at ends and in long texts, over all ways to cut the work."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeéß漢") for _ in range(draw.randint(1, 8)))
    passages = [" ".join(word() for _ in range(draw.randint(8, 90))) for _ in range(12)]
    docs = [(0, "x" * 700), (1, "ab" * 300 + "x" * 150), (2, "x" * 100), (3, "x" * 99), (4, "漢" * 200)]
    for i in range(5, 160):
        parts = [draw.choice(passages)[draw.randint(0, 9) :] if draw.random() < 0.6 else " ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 8))]
        docs.append((i, ". the most common words of all ".join(parts)))
    docs += [(i, docs[i - 100][1]) for i in range(160, 180)]
    want = brute.repeats(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for piece, block, flush, expand in ((1 << 20, 1 << 22, 48 << 20, 1 << 20), (300, 2000, 4000, 500)):
        for name, value in (("PIECE", piece), ("BLOCK", block), ("FLUSH", flush), ("EXPAND", expand)):
            monkeypatch.setattr(suffix_dedup, name, value)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.drop_repeats(frame).collect()}
        assert got == want


def test_repeats_shared_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text)]
    got = suffix_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and [r.n_removed for r in got if r.doc_id == 2] == [len(text)]
    same = {r.n_removed for r in got if r.doc_id == 1 and r.n_bytes == len(text)}
    other = {r.n_removed for r in got if r.n_bytes > len(text)}
    # of two texts under one id, the later by hash loses what both hold
    assert len(same) == 1 and same | other == {0, len(text)}


def test_splitters():
    """Grams equal to splitters touch the buckets on both sides, others have one."""
    grams = np.array([(5, 1)] * 50 + [(5, 2)] * 3 + [(7, 0)] * 5 + [(9, 9)] * 40, np.uint64)
    s = suffix_dedup.Splitters(grams, 8)
    asked = [(0, 0), (5, 0), (5, 1), (5, 2), (6, 0), (9, 9), (9, 10)]
    a, b = s.place(*np.array(asked, np.uint64).T)
    cuts = list(zip(s.high.tolist(), s.low.tolist()))
    assert list(zip(a.tolist(), b.tolist())) == [(sum(c < g for c in cuts), sum(c <= g for c in cuts)) for g in asked]


def test_codes_hard(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1] * 8, 0), (2, None, 0), (3, [nan] * 8, 1), (4, [0.1] * 7 + [None], 1), (5, [inf] * 8, None), (6, [-0.3, 0.2] * 4, None), (6, [-0.3, 0.2] * 4, None),
            (None, [0.5] * 8, 1), (7, [1e6, -1e6] * 4, 1), (8, [], 2), (9, [0.1] * 3, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "error": F.lit("x"), "vector": F.lit(2)})
    got = vector_codes.compress(frame, entries=2).collect()
    keep = {k: v for k, (i, v, _) in enumerate(rows) if v and len(v) == 8 and all(x is not None and abs(x) < inf for x in v)}
    order = {k: (rows[k][0] is None, rows[k][0] or 0, k) for k in keep}
    names = {k: n for n, k in enumerate(sorted(keep, key=order.get))}
    want, digest = brute.codes([(names[k], v) for k, v in keep.items()], entries=2)
    assert sorted((r.vec_id or 99, r.code, r.error) for r in got) == sorted((rows[k][0] or 99, *want[names[k]]) for k in keep)
    assert {r.codebooks_sha256 for r in got} == {digest}
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    assert vector_codes.compress(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [(-1.0) ** i * 10.0**k for k in range(8, 16)], 1) for i in range(9)], "vec_id long, embedding array<double>, label int")
    assert {r.error for r in vector_codes.compress(huge, entries=1, rounds=1).collect()} == {None}


@pytest.mark.parametrize("width", [1, 3, 4, 5, 16, 33])
def test_nearest(width):
    """Early elimination in the transformed domain changes neither the entry nor the distance, ties included."""
    draw = np.random.default_rng(width)
    for spread in (2, 50, 10_000):
        rows, entries = draw.integers(-spread, spread, (400, width)), draw.integers(-spread, spread, (64, width))
        full = ((rows[:, None] - entries) ** 2).sum(2)
        for kind in (np.int64, object):
            entry, gap = vector_codes.nearest(rows.astype(kind), entries.astype(kind))
            assert (entry == full.argmin(1)).all() and (gap == full.min(1)).all()
    order = vector_codes.sequency(16)
    hadamard = vector_codes.transformed(np.eye(16, dtype=np.int64))
    assert len(set(order.tolist())) == 16 and [(np.diff(hadamard[:, k]) != 0).sum() for k in range(16)] == list(range(16))


def test_near_large_groups(spark):
    """Thousands of near copies are one component; texts that share a long licence and nothing else are none."""
    rng = random.Random(5)
    base, licence = [f"b{i}" for i in range(200)], [f"l{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(200)] = f"e{i}x{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(licence + [f"u{i}x{k}" for k in range(rng.randrange(40, 200))])) for i in range(2000, 3000)]
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: 0 if i < 2000 else i for i in range(3000)}


def test_near_bitmaps_keep_links(spark):
    """No pair of sets at the threshold is ruled out by its bitmaps or sketch bounds."""
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        n = int(rng.integers(1, 120))
        m = int(rng.integers(n, max(n, int(n / 0.8)) + 1))
        both = min(n, -(-4 * (n + m) // 9))
        pool = np.unique(rng.integers(0, 2**63, n + m - both, dtype=np.uint64))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n:]]))
        if 100 * both >= 80 * len(pool):
            rows.append((len(x), near_dedup.bitmap(x[:64]).tolist(), len(y), near_dedup.bitmap(y[:64]).tolist()))
    df = spark.createDataFrame(rows, "n long, x array<long>, m long, y array<long>")
    assert len(rows) > 100 and df.where(near_dedup.may_share("x", "y", "n", "m")).count() == len(rows)


def test_bpe_merges_and_ids(spark):
    """The merge loop gives the library's ids on random words; an empty id stays apart from a null one."""
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinorst éЖ漢0.") for _ in range(rng.choice((1, 2, 3, 7, 15, 60)))) for _ in range(3000)] + ["a" * 5001, "ab" * 3000]
    assert [byte_bpe.merge_word(w.encode(), ranks) for w in words] == [enc._encode_single_piece(w.encode()) for w in words]
    got = byte_bpe.encode(spark.createDataFrame([("", "a"), (None, "b")], "doc_id string, text string"), ranks, public_tokenizers.PATTERN)
    assert {r.doc_id for r in got.collect()} == {"", None}


def test_near_small_batches(spark, monkeypatch):
    """Python workers get few texts at once, and the session keeps its setting; words are those of the lower-cased text."""
    from waferlake.llm.common import SPACE_WORD, ascii_lower

    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_dedup.staged
    before = spark.conf.get(key)
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: seen.append(int(spark.conf.get(key))) or real(df, name))
    docs = spark.createDataFrame([(i, f"A{i % 3}\x1cB K c\x85d İe\tf\x0bg") for i in range(6)], "doc_id long, text string")
    got = near_dedup.groups(docs, 2).collect()
    assert seen and max(seen) <= near_dedup.BATCH and spark.conf.get(key) == before
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 3) for i in range(6)}
    for text in ("A\x1cB K C\x85d", " İe\tF\x0b\x0cg\r\n", "", "ÄA  z"):
        assert [w.decode() for w in near_dedup.words_of(text)] == SPACE_WORD.findall(ascii_lower(text))


def test_near_shared_passage(spark, monkeypatch):
    """Texts around a base that differ from it just too much are hardly ever paired, and links between components are found."""
    rng, rows = random.Random(7), []
    base = [f"b{i}" for i in range(130)]
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(130), 20 if i < 90 else 3):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    sets = [set(t.split()) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    seen, real = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda pairs, *more: seen.append(pairs.count()) or real(pairs, *more))
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) > 80 and seen[0] < 500


def test_near_marks(spark):
    """Every hash of the keys passes, and few others do."""
    draw = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000).tolist()
    df = spark.createDataFrame([(x,) for x in draw], "h long")
    test = near_dedup._marked(spark.createDataFrame([(x,) for x in draw[:500]], "k long"), "k")
    kept = {r.h for r in df.where(test("h")).collect()}
    assert kept >= set(draw[:500]) and len(kept) < 800


def test_pipeline_small_batches(spark, tables, monkeypatch):
    """Every stage sends few texts at once to a Python worker, and the session keeps its setting."""
    import corpus_pipeline

    sizes = F.pandas_udf(lambda texts: pd.Series([len(texts)] * len(texts)), "long")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda spark, docs, sf_dir: docs.withColumn("n", sizes("text")))])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(3 * near_dedup.BATCH, numPartitions=1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = corpus_pipeline.run(spark, tables(documents=docs))
    assert got.count() == 3 * near_dedup.BATCH and got.agg(F.max("n")).first()[0] <= near_dedup.BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
