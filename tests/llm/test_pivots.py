"""Clusters whose pivot is unlike their members (operator 6)."""

from __future__ import annotations

import random

import pytest

from kestrel.llm import jaccard

SCHEMA = "p long, rid long, n long, k int, allowed long, d array<long>, c long"


def group(n, seed=5):
    """Near copies of one set of 148 elements, each with up to four edits of three elements, as
    differences from a pivot that shares nothing with them; a few members of another size."""
    rng = random.Random(seed)
    sets = []
    for _ in range(n):
        s = set(range(148))
        for at in rng.sample(range(0, 144, 3), rng.randrange(5)):
            s = s - {at, at + 1, at + 2} | {1000 + 10 * at + 3 * rng.randrange(3) + i for i in range(3)}
        sets.append(s)
    sets += [set(range(b, b + 60)) for b in range(n // 10)]
    pivot = set(range(5000, 5030))
    rows = []
    for rid, s in enumerate(sets):
        most = (len(s) + len(s) * 100 // 90) * 10 // 190
        rows.append((999, rid, len(s), len(s ^ pivot), most, sorted(s ^ pivot), rid))
    return rows


def brute(rows):
    """(rid, smallest rid reachable) by comparing all pairs."""
    low = list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            if len(set(rows[x][5]) ^ set(rows[y][5])) <= jaccard.max_difference(rows[x][2] + rows[y][2], 90):
                a, b = sorted((find(x), find(y)))
                low[b] = a
    return {(x, find(x)) for x in range(len(rows))}


@pytest.mark.parametrize("pairs", [0, 8])
def test_components_of_groups_far_from_their_pivot(spark, monkeypatch, pairs):
    """Right components, and far fewer pairs than the group has."""
    made, keep = [], jaccard.materialize

    def noted(df, name):
        out = keep(df, name)
        if name == "pairs":
            made.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "materialize", noted)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    rows = group(120)
    got = jaccard._united(spark.createDataFrame(rows, SCHEMA), 90)
    assert {tuple(r) for r in got.select("rid", "c").collect()} == brute(rows)
    assert sum(made) < 10 * len(rows)  # before: one for each two members that share shown elements
