"""Operators 12 and 13 against brute force on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import fill_middle as FM
from kestrel.llm import lexical_search as LS

from .fixtures import documents, empty, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=20):
    """(item, rank, id, score) by the definition; docs: [(id, text)]."""
    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, b) for k, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    joined = {}
    for k, t in items:
        joined.setdefault(k, Counter()).update(terms(t))
    out = []
    for item, q in joined.items():
        found = []
        for k, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                        for t, r in q.items() if b[t])
            if score > 0:
                found.append((-score, k is not None, k or 0, k))
        found.sort()
        out += [(item, r, k, -s) for r, (s, _, _, k) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


def queries(rows):
    rng = random.Random(3)
    shared = "ka le to nira sub losub mira"
    items = [(i, shared + " " + " ".join(rng.choice((t or "x").split() or ["x"]) for _, t, *_ in rng.sample(rows, 5))) for i in range(30)]
    texts = [t for _, t, *_ in rows if t and len(t) < 3000]
    items += [(100 + i, t) for i, t in enumerate(texts[:8])]
    return items + [(200, None), (201, ""), (202, "!!! ?"), (203, "unheardof"), (204, "one ONE oné one"), (204, "two"), (None, "three two")]


@pytest.mark.parametrize("block", [LS.BLOCK_TERMS, 40])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(LS, "BLOCK_TERMS", block)
    monkeypatch.setattr(LS, "CELLS", 3000)
    df, rows = documents(spark)
    items = queries(rows)
    bench = frame(spark, items, "item_id long, text string")
    got = LS.search(df.repartition(3), bench, top=7)
    want = ranked([(k, t) for k, t, _ in rows], items, 7)
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert got.columns == ["item", "rank", "id", "score"]


def test_node_made_again():
    # round 2 makes node 9 of leaves 1 and 2 again, beside a new one: no row is shared or left out
    plan = LS.Plan([(k, k * 10, 1) for k in (1, 2, 3, 4)], [[(9, 1, 2)], [(9, 1, 2), (8, 3, 4), (7, 9, 3)]], [(0, 9), (0, 8), (1, 7), (2, 8)])
    one = 10 ** 9 // (1000 + 12 * 100)
    got = plan.scores(np.zeros(4, np.int64), np.array([10, 20, 30, 40]), np.ones(4, np.int64), np.array([100]), 1)
    assert got[:, 0].tolist() == [4 * one, 3 * one, 2 * one]


def test_search_with_nodes_made_again(spark):
    # in the longer items the pair (a, b) first yields to (b, c), which yields to (c, d) or (c, e)
    texts = {"a b": 2, "a b c d": 2, "a b c e": 2, "b c": 4, "c d": 8, "c e": 8, "a": 50, "b": 40}
    items = list(enumerate(t for t, n in texts.items() for _ in range(n)))
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))) for i in range(40)]
    leaves = LS.item_leaves(frame(spark, items, "item_id long, text string"), "text", "item_id")
    made = [{r["node"] for r in x.collect()} for x in LS.share(leaves)[1]]
    assert sum(map(len, made)) > len(set().union(*made))
    got = LS.search(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), top=7)
    assert sorted([tuple(r) for r in got.collect()], key=str) == ranked(docs, items, 7)


def test_search_of_nothing(spark):
    df, rows = documents(spark)
    bench = frame(spark, [(1, "ka le")], "item_id long, text string")
    assert LS.search(empty(spark), bench).collect() == []
    assert LS.search(df, bench.where("false")).collect() == []


def test_shared_sets_are_built_once(spark):
    items = [(i, "ka le to ni own%d" % i) for i in range(50)]
    leaves = LS.item_leaves(spark.createDataFrame(items, "item_id long, text string"), "text", "item_id")
    symbols, nodes = LS.share(leaves)
    made = [x.count() for x in nodes]
    assert sum(made) == 3  # two pairs and the pair of these
    assert symbols.groupBy("item").count().agg(F.max("count")).first()[0] == 2  # the shared set and the own term


TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def formatted(doc_id, text):
    text = text or ""
    d = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k:8 * k + 8], 16) for k in range(4))
    u = TOKEN.findall(text)
    n = len(u)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def test_fill_middle(spark):
    df, rows = documents(spark)
    extra = [(500 + i, t) for i, t in enumerate(
        ["<P> marker", "a<S", "<", "a<M>b", "<S", "abc" * 9000, "é" * 9000, "1" * 20000, "x\n\ny", "日本語 text 日本", "a" * 300 + "1" + "b" * 9000])]
    table = df.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = FM.fill_in_middle(table).collect()
    want = [formatted(k, t) for k, t in [(k, t) for k, t, _ in rows] + extra]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert FM.fill_in_middle(empty(spark)).collect() == []
    forms = {r["form"]: r for r in FM.fill_in_middle(table, with_text=True).collect()}
    for form, r in forms.items():
        assert hashlib.sha256(FM.restore(r["output"].encode(), form)).hexdigest() == r["restored_sha256"]


def test_shared_chunks_are_summarised_once():
    import numpy as np
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    parts = ["intro " + body, "another beginning, longer " + body]
    raw = "".join(parts).encode()
    off = np.array([0, len(parts[0]), len(raw)])
    buf = np.frombuffer(raw, np.uint8)
    bounds = FM.chunk_bounds(buf, off)
    memo = FM.Summaries()
    for lo, hi in zip(bounds, np.append(bounds[1:], len(raw)), strict=True):
        piece = raw[lo:hi]
        memo.of(hash(piece), piece)
    assert memo.hits > 0.4 * len(bounds)  # all but the first chunk of the second text
    # a colliding key never gives another chunk's summary
    assert memo.of(7, b"ab cd") == (3, 5, True, True) and memo.of(7, b"...") == (3, 3, False, False)
    assert np.all(np.diff(np.append(bounds, len(raw))) <= FM.MAX_CHUNK)
