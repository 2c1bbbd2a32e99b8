"""Plain single-process counterparts of the corpus queries."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines(docs):
    keys = defaultdict(set)
    parts = {i: (t or "").split("\n") for i, t in docs}
    norm = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    for i, ls in parts.items():
        for x in ls:
            keys[norm(x)].add(i)
    out = {}
    for i, ls in parts.items():
        keep = [x for x in ls if not (len(norm(x)) >= 20 and len(keys[norm(x)]) >= 3 and max(keys[norm(x)]) != i)]
        out[i] = (len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


def licences(text):
    w = alnum(text)
    found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def near(docs, width):
    def shingles(t):
        w = spaced((t or "").translate(LOW))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    both = Counter()
    for ids in held.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] += 1
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def bpe(text, enc=[]):
    if not enc:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        enc.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    ids = enc[0].encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def quality(text):
    w = spaced(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in (text or "").split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def windows(items, size=10):
    out = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                out[tuple(w[k : k + size])].add(str(i))
    return out


def leaks(text, found):
    w, hit, items = alnum(text), set(), set()
    for size in {len(k) for k in found}:
        for i in range(len(w) - size + 1):
            own = found.get(tuple(w[i : i + size]))
            if own:
                hit.update(range(i, i + size))
                items |= own
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def importance(docs, target, percent=5, size=10_000):
    """{(id, text): (n_features, weight, score, rank)} by word lists."""

    def buckets(text):
        w = alnum(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % size for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, t, *buckets(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for r in own:
        s.update(r[3])
    for _, x in target:
        t.update(buckets(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in range(size)]
    out, able = {}, []
    for i, text, n, feats in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in feats)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i, text] = (len(feats), weight, score, None)
        if n >= 20:
            able.append((-score, i is None, i, text))
    for k, (_, _, i, text) in enumerate(sorted(able, key=lambda r: r[:3])[: percent * len(able) // 100]):
        out[i, text] = (*out[i, text][:3], k + 1)
    return out


def repeats(docs, width=100):
    """{id: (n_bytes, n_removed, n_spans, digest)} with every string in a dictionary."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for a in range(len(body) - width + 1):
            key = body[a : a + width]
            if key in seen:
                gone[a : a + width] = b"\1" * width
            seen.add(key)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def codes(vectors, parts=4, entries=256, rounds=4):
    """({id: (code, error)}, digest of the codebooks) with Python's whole numbers."""
    kept = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = len(next(iter(kept.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        own = [defaultdict(list) for _ in range(parts)]
        for v in cut.values():
            for p in range(parts):
                own[p][near(v[p], books[p])[1]].append(v[p])
        books = [[[sum(c) // len(c) for c in zip(*own[p][k])] if own[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    out = {}
    for i, v in cut.items():
        found = [near(v[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
