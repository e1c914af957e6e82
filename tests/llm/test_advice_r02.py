
from __future__ import annotations

import pytest

from kestrel.llm import automata, decontaminate

from . import fixtures as X


# ---- op9

@pytest.mark.parametrize("cap", [0, 2000])
def test_block_repeated_inside_one_document(spark, cap):
    w = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    p = w("p", 70)
    block = f"{w('x', 60)} {p} {w('y', 60)}"
    rows = [(1, f"{w('u', 60)} {p} {w('v', 60)}", "s"), (2, f"{block} {block}", "s"), (2, f"{block} {w('z', 9)}", "s"), (3, f"{p} {p}", "s")]
    got = automata.remove_repeated_words(X.frame(spark, rows), cap=cap).select("id", "n", "n_removed", "kept_sha256").collect()
    assert X.by_id(got) == X.by_id(X.word_repeats(rows))
    assert sorted(r["n_removed"] for r in got if r["id"] == 2) == [70, 140]


# ---- pipeline, near_duplicates

def test_near_duplicate_stage_limits(spark, sf):
    """Against all pairs: five-word shingles, linked from 0.8 on."""
    import random

    import corpus_pipeline as P
    rng = random.Random(3)
    w = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(4)]
    more = [f"n{k}" for k in range(80)]
    texts = [w[0], w[0] + more[:30], w[0][:170], w[1], w[1] + more[:60], w[2], [*w[2][:100], "changed", *w[2][101:]],
             w[3], [x if k % 50 != 25 else "changed" for k, x in enumerate(w[3])]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    low = list(range(len(texts)))
    for x, y in [(x, y) for y in range(len(texts)) for x in range(y)] * len(texts):
        if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
            low[x] = low[y] = min(low[x], low[y])
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(low)) == [0, 3, 4, 5, 7]


# ---- op5

def _contaminated(spark, item, texts):
    docs = X.frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).where("contaminated").collect()}


def test_slots_are_judged_per_window(spark):
    item = "the first of the two trains covers 120 km before it stops at the last station and then goes on for 120 km to the coast"
    two = "we put 3 red balls and 5 blue balls into the big box"
    assert _contaminated(spark, item, [item.replace("for 120", "for 999"), item.replace("120", "95")]) == {0, 1}
    # 3 and 5 become 4 and 4, but equal values of the item may not part
    assert _contaminated(spark, two, [two.replace("3", "4").replace("5", "4")]) == {0}
    same = "we put 3 red balls and 3 blue balls into"
    assert _contaminated(spark, same, [same.replace("3 blue", "7 blue"), same.replace("3", "7")]) == {1}


def test_exact_windows(spark):
    dense = "1 2 3 4 5 6 7 8 9 10 11 12"
    assert _contaminated(spark, dense, [f"see {dense} there", "9 " * 14, "12 11 10 9 8 7 6 5 4 3 2 1"]) == {0}
    item = "What is the capital of France"
    assert _contaminated(spark, item, [f"then we asked {item} and waited", "then we asked about the capital of France"]) == {0}
