"""Anchors with many different phrases: the path by aligned blocks (operators 7 and 9)."""

from __future__ import annotations

import random

import pytest

from kestrel.llm import automata, prefix_free, repeats

from . import fixtures as X


def near_copies(n, words=130, seed=11):
    """One text n times, each with one or two words of its own, and passages of it in other texts;
    a line that all share between different neighbours; repeats inside one text."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    line = " ".join(f"menu{k}" for k in range(9))
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(1 + i % 2):
            t[rng.randrange(words)] = f"edit{i}"
        rows.append(t)
    rows += [[f"u{rng.randrange(10**6)}" for _ in range(70)] + [line] + [f"v{rng.randrange(10**6)}" for _ in range(70)] for _ in range(n)]
    rows += [[f"x{i}"] + base[i:i + 75] + [f"y{i}"] + base[i:i + 60] for i in range(0, 50, 5)]
    return [(i, " ".join(t), "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("cap", [0, 4])
def test_blocks_find_what_brute_force_finds(spark, cap):
    rows = near_copies(24)
    df = X.frame(spark, rows)
    got = prefix_free.remove_repeated_bytes(df, cap=cap).select("id", "n", "n_removed", "n_spans", "kept_sha256").collect()
    assert X.by_id(got) == X.by_id(X.byte_repeats(rows))
    got = automata.remove_repeated_words(df, cap=cap).select("id", "n", "n_removed", "kept_sha256").collect()
    assert X.by_id(got) == X.by_id(X.word_repeats(rows))


def test_blocks_grow_with_the_group(spark, monkeypatch):
    """Rows of all levels and rows met: in proportion to the group, far fewer than its windows."""
    def made(n):
        tables = []
        keep = repeats.materialize

        def noted(df, name):
            out = keep(df, name)
            if name == "blocks":
                tables.append(out.count())
            return out
        monkeypatch.setattr(repeats, "materialize", noted)
        prefix_free.remove_repeated_bytes(X.frame(spark, near_copies(n)), cap=0).count()
        monkeypatch.setattr(repeats, "materialize", keep)
        return sum(tables)
    a, b = made(20), made(80)
    assert b < 5 * a


def test_block_sizes():
    assert [repeats.block_sizes(w) for w in (200, 50, 25, 5, 1)] == [[64, 8, 1], [8, 1], [8, 1], [1], [1]]
