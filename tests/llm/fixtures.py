"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: names that operators use inside or add; every test table carries them
CLASHES = ["size", "shard", "slot", "h", "i", "cell", "rest", "n", "c", "key", "rid", "a", "b", "lo", "hi", "copy",
           "shuffle_key", "src", "cdf", "draws", "words", "hashes", "score", "kept", "n_words", "votes", "posterior",
           "items", "contaminated", "component", "keeper", "id", "th", "x", "_p", "_base", "_cuts", "raw_score", "prob"]


def sentences(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro", "sa", "ti", "vo", "zu") for b in ("ra", "le", "to", "ni", "sub", "el", "or")]


def texts(seed=7):
    """Texts with copies, near copies, shared passages, short, empty, null and very long ones."""
    rng = random.Random(seed)
    base = [sentences(rng, rng.randint(60, 150)) for _ in range(12)]
    passage = sentences(rng, 70)
    out = list(base)
    for t in base[:6]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed" + str(rng.randrange(9))
            out.append(" ".join(v))
        out.append(t)
    out += [sentences(rng, 30) + "\n" + passage + "\t" + sentences(rng, 25) for _ in range(5)]
    out += [None, "", " \t\n", "one", "one two", "One Two", "one two three", "one two three", "ab " * 300, "é" * 400,
            "x" * 450, "#$% & | <>", "a\nb\na\nb\n\n", sentences(rng, 40_000), "ÀÉ words  and\x0bmore\x0cspaces", base[0].upper()]
    return out


def frame(spark, rows, schema="doc_id long, text string, source string"):
    """A DataFrame over rows with all the clashing columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in have})


def documents(spark):
    rows = [(k, t, f"s{min(k, 9) % 4}" if k % 5 else None) for k, t in enumerate(texts())]
    rows += [(None, "a text without an id " * 8, None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return frame(spark, rows), rows


def empty(spark):
    return frame(spark, [])


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n=3):
    w = words(lower(t))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[k:k + n]) for k in range(len(w) - n + 1)])


def jaccard(rows, n=3, percent=90):
    """(id, size, component) per row by comparing all pairs."""
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            i = len(sets[x] & sets[y])
            if sets[x] and 100 * i >= percent * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    low = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[find(k)].append(r[0])
    return [(r[0], len(sets[k]), min(low[find(k)], default=None) if sets[k] else r[0]) for k, r in enumerate(rows)]


def byte_repeats(rows, width=200):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for r, t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def word_repeats(rows, width=50):
    first = {}
    low = lambda i: -(1 << 63) if i is None else i
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, 1 << 63), low(r[0]))
    out = []
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < low(r[0]):
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
