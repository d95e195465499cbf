"""Small corpora with copies, near copies, passages, odd texts and clashing columns; brute-force versions."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, `key` string, node int, label int, run int, slot string, shard string, text_ string, n int"


def words(r, n, vocabulary=400):
    return [f"{'abcdefghij'[r.randrange(10)]}{r.randrange(vocabulary)}" for _ in range(n)]


def texts(seed=1):
    r = random.Random(seed)
    out: list = [" ".join(words(r, r.randrange(5, 120))) for _ in range(40)]
    base = " ".join(words(r, 150))
    out += [base] * 4  # exact copies
    for _ in range(8):  # near copies
        w = base.split()
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    shared = ". ".join(" ".join(words(r, 12)) for _ in range(6)) + "."
    out += [f"{' '.join(words(r, 20))}. {shared} {' '.join(words(r, 9))}." for _ in range(5)]
    out += [None, "", " ", "\n\t ", "one", "one two", "one two", "ÉÈ ñandú 🎈 é", "x" * 3000, "ab" * 900, "na " * 500, "it's I'll we've 'tis", "z" * 199, "y" * 200]
    out.append(" ".join(words(r, 9000)))  # very long
    return out


def corpus(spark, seed=1, extra=True):
    rows = [(k, t, "en", "src0", len(t or ""), k, "k", 1, 2, 3, "s", "t", "u", 4) for k, t in enumerate(texts(seed))]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute_components(rows, size, percent):
    """doc_id -> (set size, least id reachable), over all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_repeats(rows, length):
    """doc_id -> (bytes, removed, runs, digest of the rest)."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out
