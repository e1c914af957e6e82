"""Operators whose results are held against brute force, SQL or a round trip."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import automata, chat, decontaminate, jaccard, mixing, prefix_free, quality_rules, repeats, sharding, url_filters
from kestrel.llm import textops as T
from kestrel.llm.graph import components

from . import fixtures as X


@pytest.fixture(scope="module")
def docs(spark):
    return X.documents(spark)


def test_word_hash_depends_on_the_word_only():
    def of(text):
        buf, off = T.flat(__import__("pyarrow").array([text]))
        s, e, _ = T.words(buf, off)
        return T.word_hashes(buf, s, e).tolist()
    assert of("a bc  d\x0ba")[0] == of("zz a")[1] == of("a bc  d\x0ba")[3]
    assert len(set(of("a b ab ba aa aaa"))) == 6
    long = "w " * (T._BLOCK // 2 + 5)
    assert len(set(of(long))) == 1  # across hashing blocks


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for k in (1, 3, 7, 200):
        assert T is not None and repeats.sliding_min(x, k).tolist() == [min(x[i:i + k]) for i in range(len(x) - k + 1)]


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20, 60)] + [(5, 100), (100, 7), (9, 9), (200, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {k: 20 for k in [*range(20, 61), 200]} | {5: 5, 7: 5, 100: 5}
    assert components(e.where("a = 9")).count() == 0


# ---- 6, 7, 9

def test_jaccard_matches_all_pairs(spark, docs):
    df, rows = docs
    got = jaccard.jaccard_components(df).select("id", "n", "component").collect()
    assert X.by_id(got) == X.by_id(X.jaccard(rows))


def test_jaccard_near_threshold(spark):
    """Many sets around 90 %, of all sizes, in one large group of near copies."""
    import random
    rng = random.Random(3)
    base = [f"w{k}" for k in range(260)]
    rows = []
    for k in range(90):
        n = rng.choice([4, 9, 12, 19, 25, 40, 90, 250])
        w = base[:n]
        for _ in range(rng.randrange(0, 1 + n // 30)):
            w[rng.randrange(n)] = f"v{rng.randrange(4)}"
        rows.append((k, " ".join(w), "s"))
    got = jaccard.jaccard_components(X.frame(spark, rows)).select("id", "n", "component").collect()
    assert X.by_id(got) == X.by_id(X.jaccard(rows))


def test_jaccard_keeps_one_of_each_group(spark, docs):
    df, rows = docs
    kept = jaccard.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = [r["doc_id"] for r in kept.collect()]
    want = {c for _, n, c in X.jaccard(rows) if n}
    no_words = [r[0] for r in rows if not X.words(r[1])]
    assert sorted(map(str, got)) == sorted(map(str, [*want, *no_words]))
    assert jaccard.drop_near_duplicates(X.empty(spark)).count() == 0


def test_max_difference_is_the_exact_bound():
    for n1, n2 in itertools.product(range(1, 40), repeat=2):
        for i in range(min(n1, n2) + 1):
            linked = 100 * i >= 90 * (n1 + n2 - i)
            assert linked == (n1 + n2 - 2 * i <= jaccard.max_difference(n1 + n2, 90))


@pytest.mark.parametrize("cap", [0, 2000])
def test_byte_repeats(spark, docs, cap):
    df, rows = docs
    got = prefix_free.remove_repeated_bytes(df, cap=cap).select("id", "n", "n_removed", "n_spans", "kept_sha256").collect()
    assert X.by_id(got) == X.by_id(X.byte_repeats(rows))


@pytest.mark.parametrize("cap", [0, 2000])
def test_word_repeats(spark, docs, cap):
    df, rows = docs
    got = automata.remove_repeated_words(df, cap=cap).select("id", "n", "n_removed", "kept_sha256").collect()
    assert X.by_id(got) == X.by_id(X.word_repeats(rows))


def test_repeats_text_and_empty(spark, docs):
    rows = [(1, "ab " * 100, "s"), (2, "q " * 60 + "end", "s")]
    got = automata.remove_repeated_words(X.frame(spark, [*rows, (3, "q " * 55 + "z", "s")]), with_text=True)
    assert {r["id"]: r["kept"] for r in got.collect()}[3] == "z"
    for f in (automata.remove_repeated_words, prefix_free.remove_repeated_bytes):
        assert f(X.empty(spark)).count() == 0
        assert f(X.frame(spark, [(None, None, None)])).first()["n_removed"] == 0


def test_automaton_against_scan():
    import random
    rng = random.Random(5)
    seqs = [[rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(30)]
    sam = automata.SuffixAutomaton()
    for k, s in enumerate(seqs):
        sam.add(s, k)
    sam.finish()
    for s in seqs:
        for width in (1, 3, 6):
            want = [(i, min(k for k, t in enumerate(seqs) if any(t[j:j + width] == s[i:i + width] for j in range(len(t)))))
                    for i in range(len(s) - width + 1)]
            assert list(sam.matches(s, width)) == want


# ---- 1

@pytest.mark.parametrize("n_shards,cells", [(16, None), (3, 5), (1, 1)])
def test_shards(spark, docs, n_shards, cells):
    df, rows = docs
    df = df.where(F.length("text") < 5000)  # sizes can be level only if no row outweighs a shard
    got = sharding.shard_by_bytes(df, n_shards, cells_per_shard=cells).collect()
    want = [r for r in rows if r[1] is not None and len(r[1]) < 5000]
    assert X.by_id((r["doc_id"], r["text"]) for r in got) == X.by_id((r[0], r[1]) for r in want)
    per = {}
    for r in got:
        assert r["size"] == len(r["text"].encode()) + 1
        per.setdefault(r["shard"], []).append(r)
    mean, most = sum(r["size"] for r in got) / n_shards, max(r["size"] for r in got)
    for rs in per.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - mean) <= 2 * most


def test_shards_split_a_hot_text(spark):
    df = X.frame(spark, [(k, "same text" if k % 3 else f"other {k}", "s") for k in range(900)])
    got = sharding.shard_by_bytes(df, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    mean = sum(r["b"] for r in got) / 16
    assert len(got) == 16 and all(abs(r["b"] - mean) < 0.001 * mean + 22 and r["m"] == r["n"] - 1 for r in got)
    assert sharding.shard_by_bytes(X.empty(spark), 4).count() == 0
    odd = X.frame(spark, [(None, None, None)] * 3)
    assert sorted(r["slot"] for r in sharding.shard_by_bytes(odd, 4).collect()) == [0, 1, 2]
    text_ids = spark.createDataFrame([("x", "t"), (None, "u")], "doc_id string, text string")
    assert sharding.shard_by_bytes(text_ids, 2).count() == 2


def test_crc_is_unsigned(spark, sf):
    got = sharding.op1_sharding(spark, sf).select("doc_id", "text_crc32").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)


# ---- 2

TRICKY = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x", "<", "<|", "|im_end|>", "", None, "a\x00b", "$1 \\1 \\Q", "<<|<|"]


def test_chat_round_trip(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(TRICKY)]
    rows += [(2, 0, "role\nwith <|im_start|> and \\n", "x"), (2, 0, None, None), (3, None, "assistant", "late"), (3, 1, "user", "q"),
             (None, 0, "user", "no id"), (4, 0, "user", "twice"), (4, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(0) for c in ("segments", "valid", "turns", "e", "t")})
    f = chat.format_chats(df)
    got = {r["conv_id"]: r for r in f.select("conv_id", chat.read_back(chat.formatted_text()).alias("turns"), chat.loss_text().alias("loss"),
                                              chat.formatted_text().alias("text"), "valid", "bad_turn").collect()}
    for conv in (1, 2, 3, None, 4):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [tuple(t) for t in got[conv]["turns"]] == [(r[2], r[3]) for r in own]
        assert got[conv]["loss"] == "".join(r[3] for r in own if r[2] == "assistant")
    assert got[1]["text"].count("<|im_start|>") == len(TRICKY)
    assert not got[1]["valid"] and got[1]["bad_turn"] is None  # ends with a user turn
    assert got[3]["bad_turn"] == 0 and got[4]["bad_turn"] == 1
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- 3

def test_url_parts_and_rules(spark):
    urls = {"https://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
            "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
            "http://badexample.org/en/12": ("badexample.org", "/en/12", "org/", "allow"),
            "x://com/de/1": ("com", "/de/1", "com/de/", "block"), "x://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
            "http://a.org": ("a.org", "", None, "allow"), "http://a.org?x=/": ("a.org", "", None, "allow"),
            "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
            "http://a.net/x://b.org/": ("a.net", "/x://b.org/", None, "allow"), "http://ÄB.net/\nx": ("Äb.net", "/\nx", None, "allow")}
    pages = spark.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, host int, tokens int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, labels).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())
    assert url_filters.filter_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_match_enumeration(spark):
    import random
    rng = random.Random(2)
    rows = []
    for k in range(400):
        toks = sorted({rng.choice("abcdefg") for _ in range(4)})
        rows.append((k, toks, ("a" in toks and "c" in toks) or rng.random() < 0.05))
    df = spark.createDataFrame(rows, "key long, tokens array<string>, bad boolean")
    rules = url_filters.mine_rules(df.select("tokens", "bad"), 8, 0.5, min_lift=1.5)
    got = {tuple(r["tokens"]): (r["hits"], round(r["confidence"], 9)) for r in rules.collect()}
    base = sum(b for _, _, b in rows) / 400
    want = {}
    for n in (1, 2, 3):
        for s in itertools.combinations("abcdefg", n):
            own = [b for _, t, b in rows if set(s) <= set(t)]
            if own and sum(own) >= 8 and sum(own) >= 0.5 * len(own) and sum(own) >= 1.5 * base * len(own):
                want[s] = (sum(own), round(sum(own) / len(own), 9))
    want = {s: v for s, v in want.items() if not any(set(o) < set(s) for o in want)}
    assert got == want and ("a", "c") in got
    hits = {r["key"]: r["n_rules"] for r in url_filters.match_rules(df.select("key", "tokens"), rules).collect()}
    assert hits == {k: n for k, t, _ in rows if (n := sum(set(s) <= set(t) for s in want))}


def test_rules_of_long_urls_and_rare_hosts(spark):
    """A bad host with few pages among very many gives a rule; long transactions neither blow up nor lose sets."""
    long = ["t%02d" % k for k in range(40)]
    rows = [(["h:spam.example"], True)] * 6 + [([*long, "h:long.example"], True)] * 7 + [(["h:ok.example", "t%02d" % (k % 40)], False) for k in range(3000)]
    rows += [(["t00", "t39"], False)] * 30 + [(["t00", "t20"], False)] * 30
    rules = {tuple(r["tokens"]) for r in url_filters.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert {("h:spam.example",), ("h:long.example",), ("t01", "t39"), ("t20", "t39")} <= rules
    assert ("t00", "t39") not in rules and ("t00", "t01") in rules and all(len(r) <= 2 for r in rules)


# ---- 4

def test_quality_base_counts_and_score(spark, docs):
    import math
    from collections import Counter

    import xxhash
    df, rows = docs
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1), (30, 0, 0), (None, 1, 0), (5, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge_quality(df, labels)
    assert [c for c in got.columns if c == "text"] and len(set(got.columns)) == len(got.columns)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def xx(longs):
        seed = 42
        for v in longs:
            seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
        return signed(seed)

    half = quality_rules.BINS // 2
    def cells(w):
        hs = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]
        return [h % half for h in hs] + [xx(p) % half + half for p in zip(hs, hs[1:], strict=False)]

    raw, good = Counter(), Counter()
    for r in rows:
        c = cells(X.words(r[1]))
        raw.update(c)
        if r[0] in (0, 1, 5):
            good.update(c)
    R, G, B = sum(raw.values()), sum(good.values()), quality_rules.BINS
    def score(w):
        c = cells(w)
        if not c:
            return 0.0
        q = {b: (raw[b] + 1) / (R + B) for b in set(c)}
        return sum(round(math.log((good[b] + B * q[b]) / (G + B) / q[b]), 6) for b in c) / len(c)

    want = []
    for r in rows:
        w = X.words(r[1])
        lines = [x for x in (r[1] or "").split("\n") if X.words(x)]
        five = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = Counter(five)
        cover = {i + k for i, x in enumerate(five) if many[x] > 1 for k in range(5)}
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        s = score(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(cover),
                     failed, not failed and s >= quality_rules.THRESHOLD, round(s, 5)))
    cols = ["doc_id", *quality_rules.BASE, "base_failed", "kept", F.round("score", 5)]
    assert X.by_id(got.select(*cols).collect()) == X.by_id(want)
    assert quality_rules.judge_quality(X.empty(spark), labels).count() == 0
    # without trusted documents only the base rules decide
    assert quality_rules.judge_quality(df, labels.limit(0)).where("kept = base_failed").count() == 0


# ---- 5

ITEMS = [(1, "A train covers 120 km in 3 hours and then 120 km in 2 hours so how fast is the slower leg of it"),
         (2, "Yesterday Maria gave five red apples to her brother before the long walk home started"), (3, None), (4, "too short"),
         (5, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, "an item without an id still has a text of ten words")]


def _leaks(spark, texts):
    docs = X.frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("slots", F.lit(1)).withColumn("hash", F.lit(1))
    out = decontaminate.decontaminate(docs, bench)
    assert len(set(out.columns)) == len(out.columns)
    return {r["doc_id"]: r["items"] for r in out.collect() if r["contaminated"]}


def test_decontamination(spark):
    texts = ["before " + ITEMS[0][1] + " after", ITEMS[0][1].replace("120", "95").replace("3 hours", "7 hours").replace("2 hours", "4 hours"),
             ITEMS[0][1].replace("120 km in 2", "999 km in 2"),  # 120 maps to two values, but windows without the clash match
             ITEMS[1][1].replace("Maria", "Pedro"), "9 9 9 9 9 9 9 9 9 9 9 9 9 9", "too short", None, "", ITEMS[0][1].upper()[:40],
             "Yesterday Maria gave five red pears to his sister", ITEMS[1][1], ITEMS[1][1]]
    got = _leaks(spark, texts)
    assert {k for k in got if got[k] == ["1"]} == {0, 1, 2}
    assert {k for k in got if got[k] == ["2"]} == {3, 10, 11}
    assert set(got) == {0, 1, 2, 3, 10, 11}
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(X.empty(spark), bench).count() == 0
    docs = X.frame(spark, [(1, texts[0], "s"), (1, "clean", "s"), (None, texts[0], "s")])
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert sorted(r["text"] == "clean" for r in decontaminate.decontaminate(docs, bench).where("not contaminated").collect()) == [True]


def test_decontamination_against_scan(spark, sf):
    """Every document that holds a whole item verbatim, found by substring."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r["text"] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(t in (r["text"] or "") for t in items)}
    got = {r["doc_id"] for r in decontaminate.op5_decontamination(spark, sf).where("contaminated").collect()}
    assert got == want and want


# ---- 10

def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix_sources(df, weights={"s1": 3.0, None: 1.0}, target_rows=4000)
    per = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(per) == {"s1", None} and abs(per["s1"] - 3000) < 300 and abs(per[None] - 1000) < 200
    ids = got.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("k"), F.max("copy").alias("m")).collect()
    assert all(r["k"] == r["m"] + 1 and r["n"] % r["k"] == 0 for r in ids)
    again = mixing.mix_sources(df.repartition(7), weights={"s1": 3.0, None: 1.0}, target_rows=4000)
    assert got.select("doc_id", "copy", "shuffle_key").exceptAll(again.select("doc_id", "copy", "shuffle_key")).count() == 0
    assert mixing.mix_sources(X.empty(spark)).count() == 0
    assert mixing.mix_sources(df, weights={"nowhere": 1.0}).count() == 0


def test_poisson_table(spark):
    import math
    for mean in (0.0, 0.3, 2.5, 16.0):
        t = spark.range(1).select(mixing.poisson_table(F.lit(mean)).alias("t")).first()["t"]
        acc = 0.0
        for k, c in enumerate(t[:20]):
            acc += math.exp(-mean) * mean ** k / math.factorial(k)
            assert abs(acc - c) < 1e-12
        assert abs(t[-1] - 1) < 1e-12
