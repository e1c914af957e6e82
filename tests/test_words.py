"""Unknown-word scores, segmentation, batch inference, delimited files, resumed stream."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import models as ML
from kestrel.operators import words as W
from kestrel.sources import tables as IO
from kestrel.streaming.scorer import score_new_arrivals

LEXICON = [("good", 0.8), ("gold", 0.5), ("glad", 1.0), ("bad", -0.7), ("sad", -0.2), ("mad", -1.0), ("mid", 0.0), ("x", 0.1)]


def grams(word):
    w = f"<{word}>"
    return [w[i:i + n] for n in W.GRAM_SIZES for i in range(len(w) - n + 1)]


def plain_scores(lexicon, words):
    pos, neg = Counter(), Counter()
    for w, s in lexicon:
        (pos if s > 0 else neg).update(grams(w) if s else [])
    v = len(set(pos) | set(neg))
    n_pos, n_neg = sum(pos.values()), sum(neg.values())
    prior = math.log((sum(s > 0 for _, s in lexicon) + 1) / (sum(s < 0 for _, s in lexicon) + 1))
    out = {}
    for w in words:
        o = prior + sum(math.log((pos[g] + 1) / (n_pos + v)) - math.log((neg[g] + 1) / (n_neg + v)) for g in grams(w))
        out[w] = 2 / (1 + math.exp(-o)) - 1
    return out


def test_unknown_words_against_plain_model(spark):
    lex = spark.createDataFrame([*LEXICON, (None, 1.0), ("", 1.0)], "word string, score double")
    words = ["goad", "dad", "q", "ébène", "goodbad", "goad"]
    df = spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
    got = {r["word"]: r["score"] for r in W.score_words(df, W.fit_word_scorer(lex)).collect()}
    want = plain_scores(LEXICON, set(words))
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert got["goad"] > 0 > got["dad"]


def test_modelled_sentiment_sums(spark):
    lex = spark.createDataFrame([*LEXICON, ("good", 0.4)], "word string, score double")
    texts = [(1, ["good", "dad", "dad"]), (2, []), (3, None), (4, ["mid"])]
    df = spark.createDataFrame(texts, "id long, tokens array<string>")
    got = {r["id"]: r["sentiment_score"] for r in W.modelled_sentiment(df, "id", "tokens", lex).collect()}
    one = [(w, 0.6 if w == "good" else s) for w, s in LEXICON]
    dad = plain_scores(one, ["dad"])["dad"]
    assert got[2] == got[3] == got[4] == 0 and abs(got[1] - (0.6 + 2 * dad) / 3) < 1e-9


def test_empty_lexicon_answers_nothing(spark):
    lex = spark.createDataFrame([], "word string, score double")
    df = spark.createDataFrame([(1, ["a", "b"])], "id long, tokens array<string>")
    assert W.modelled_sentiment(df, "id", "tokens", lex).first()["sentiment_score"] == 0


def plain_segment(run, dictionary):
    """Every way to cut ``run``; the heaviest, equal ones by the longer word from the left."""
    total = sum(dictionary.values()) or 1
    weight = {w: math.floor(W.UNIT * math.log(n / total)) for w, n in dictionary.items()}
    unknown = math.floor(W.UNIT * math.log(1 / total))
    best = None
    for marks in itertools.product((0, 1), repeat=max(len(run) - 1, 0)):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
        parts = [run[a:b] for a, b in zip([0, *ends], ends)]
        if all(p in weight or len(p) == 1 for p in parts):
            key = (sum(weight.get(p, unknown) for p in parts), [len(p) for p in parts])
            best = max(best, (key, parts)) if best else (key, parts)
    return best[1]


def test_segmentation_against_every_cut(spark):
    rnd = random.Random(3)
    words = {"ab": 5, "abc": 3, "c": 9, "ca": 4, "bca": 2, "aa": 4, "a": 4, "bb": 1, "中文": 3, "文": 2, "é": 1}
    runs = ["".join(rnd.choice("abc中文éz") for _ in range(rnd.randint(1, 10))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(runs)), "id int, text string")
    d = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["id"]: r["words"] for r in W.segment(df, "text", d).collect()}
    assert got == {i: plain_segment(r, words) for i, r in enumerate(runs)}


def test_segmentation_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 40)
    rnd = random.Random(5)
    words = {"ab": 5, "abc": 3, "c": 9, "ca": 4, "bca": 2, "aa": 4, "a": 4, "中文": 3, "é": 1}
    runs = ["".join(rnd.choice("abc中文éz") for _ in range(rnd.randint(1, 10))) for _ in range(60)]
    df = spark.createDataFrame([(i, r + "!" + runs[0]) for i, r in enumerate(runs)], "id int, text string")
    got = {r["id"]: r["words"] for r in W.segment(df, "text", spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {i: plain_segment(r, words) + plain_segment(runs[0], words) for i, r in enumerate(runs)}


def test_few_parts_pass_the_filter_of_words(spark):
    # all 600 words begin alike and have the lengths 2 to 24: by first characters and length every part is a candidate
    words = ["ab" + "".join(random.Random(k).choices("abc", k=k % 23)) for k in range(600)]
    mask = W._word_filter(spark.createDataFrame([(w,) for w in sorted(set(words))], "word string"))
    text = "".join(words)
    met = {(s, n) for _, s, n in W._candidates([text], mask)}
    known = {(s, n) for n in range(1, W.MAX_WORD + 1) for s in range(len(text) - n + 1) if text[s:s + n] in set(words)}
    assert known <= met and len(met) < 1.5 * len(known) + 0.05 * W.MAX_WORD * len(text)


def test_runs_are_cut_beside_each_other_as_one_by_one():
    rnd = random.Random(8)
    words = {w: rnd.randint(-40, -1) * 1000 for w in {"".join(rnd.choices("ab中", k=rnd.randint(1, 24))) for _ in range(3000)} | {"a", "ab", "aab"}}
    runs = ["".join(rnd.choices("ab中z", k=rnd.choice([1, 2, 7, 30, 400]))) for _ in range(90)]
    mask = bytes([255]) * 4096  # every part passes
    (_, sizes, codes, found), = W._passed(runs, mask)
    for split in (lambda w: None, lambda w: dict(zip(w, map(words.get, w)))):  # the second: as if two words had one hash
        known = W._by_length(list(words), list(words.values()))
        known = {n: (*v[:4], split([w for w in words if len(w) == n])) for n, v in known.items()}
        weights = W._weights("".join(runs), codes, found, known)
        weights[weights[:, 0] == W.NO_WORD, 0] = -50_000
        step, at = W._best_steps(sizes, weights).tolist(), 0
        for run in runs:
            edges = [(s, n, words[run[s:s + n]]) for s in range(len(run)) for n in range(1, 25) if s + n <= len(run) and run[s:s + n] in words]
            want, got, end = W.best_path(len(run), edges, -50_000), [], at + len(run)
            while at < end:
                got.append(step[at])
                at += step[at]
            assert got == want
    assert sorted(W._distinct_parts(["abab"], mask)) == sorted({"abab"[s:e] for s in range(4) for e in range(s + 1, 5)})


def test_segmentation_ties_and_odd_rows(spark):
    # 'aa' weighs as much as 'a' + 'a' would have to: two cuts of 'aaa' are equal, the longer word goes first
    d = spark.createDataFrame([("aa", 1), ("a", 1), (None, 5), ("bad", 0), ("w" * 30, 7)], "word string, n long")
    rows = [(1, "A a a!b"), (1, "A a a!b"), (2, None), (3, ""), (4, "?!"), (5, "w" * 31)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("word", F.lit("kept")).withColumn("n", F.lit(1))
    out = W.segment(df, "text", d)
    assert out.columns == ["id", "text", "word", "n", "words"]
    got = sorted(((r["id"], r["words"]) for r in out.collect()), key=lambda r: r[0])
    assert got == [(1, ["aa", "a", "b"]), (1, ["aa", "a", "b"]), (2, None), (3, []), (4, []), (5, ["w"] * 31)]
    none = spark.createDataFrame([], d.schema)
    assert W.segment(df.where("id = 1"), "text", none).first()["words"] == ["a", "a", "a", "b"]
    assert W.segment(df.limit(0), "text", d).count() == 0


def test_segmentation_finds_the_blanks_again(spark, sf):
    import __spark_entry__ as E
    from kestrel.operators.text import tokenize
    from kestrel.sources import adapters as A
    cut = E.queries()["segment_texts"](spark, sf)
    whole = tokenize(A.titles(spark, sf), "item_title").select("post_id", F.array_join("tokens", "").alias("chars"))
    both = cut.join(whole, "post_id").where("replace(words_joined, ' ', '') != chars").count()
    assert cut.count() == whole.count() and both == 0


def test_mean_over_padded_positions(spark):
    df = spark.createDataFrame([(i, [i, 2 * i, 0, 0]) for i in range(100)], "id long, ids array<long>")
    got = {r["id"]: r["embedding"] for r in ML.embed_tokens(df, "ids", ML.hashed_encoder(3), 4, batch_size=7).collect()}
    for i in range(100):
        want = np.mean([[(31 * t + 17 * p + 1) * (2 * d + 1) % 1009 / 1009 for d in range(3)] for p, t in enumerate([i, 2 * i, 0, 0])], axis=0)
        assert np.allclose(got[i], want)


def test_delimited_round_trip_of_odd_texts(spark, tmp_path):
    rows = [(1, 'a,"b"\nc\r\nd'), (2, " blanks "), (3, ""), (4, None), (5, 'back\\slash "'), (6, ",")]
    df = spark.createDataFrame(rows, "id int, t string")
    IO.write_delimited(df, str(tmp_path / "x"), ",", max_records=2)
    back = IO.read_delimited(spark, str(tmp_path / "x"), df.schema, ",", malformed="bad")
    assert sorted((r["id"], r["t"], r["bad"]) for r in back.collect()) == [(*r, None) for r in rows]


def test_malformed_records_are_kept(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,x\n1,2.5\nno,3.5\n3,4.5,more\n')
    got = IO.read_delimited(spark, str(tmp_path / "f.csv"), "id int, x double", ",", malformed="bad").collect()
    assert {(r["id"], r["x"], r["bad"]) for r in got} == {(1, 2.5, None), (None, 3.5, "no,3.5"), (3, 4.5, "3,4.5,more")}


def test_stream_resumes(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(0, 5).coalesce(1).write.parquet(src)
    seen = []

    def twice(batch):
        if not batch.isStreaming:
            seen.append(sorted(r["id"] for r in batch.collect()))
        return batch.select("id", (F.col("id") * 2).alias("score"))

    def run(f=twice):
        return sorted(r["id"] for r in score_new_arrivals(spark, src, "id long", f, base=base).collect())

    assert run() == list(range(5)) and run() == list(range(5)) and seen == [[0, 1, 2, 3, 4]]
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    assert run() == list(range(8)) and seen[1:] == [[5, 6, 7]]


def test_batch_written_but_not_committed_is_not_doubled(spark, tmp_path, monkeypatch):
    from kestrel.streaming import scorer
    src, base = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(0, 5).coalesce(1).write.parquet(src)
    real = scorer.run_available_now

    def dies_after_write(stream, transform, sink, ckpt):
        def write(batch, batch_id):
            transform(batch).withColumn("_batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            raise RuntimeError("lost before the commit")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(scorer, "run_available_now", dies_after_write)
    with pytest.raises(Exception, match="lost before the commit"):
        score_new_arrivals(spark, src, "id long", lambda b: b.select("id"), base=base)
    monkeypatch.setattr(scorer, "run_available_now", real)
    got = score_new_arrivals(spark, src, "id long", lambda b: b.select("id"), base=base)
    assert sorted(r["id"] for r in got.collect()) == list(range(5))
