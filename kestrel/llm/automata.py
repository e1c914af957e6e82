"""Operator 9, repeats of 50 words by suffix automata of reference shards.

Reference text is every document with a smaller id.  Only text around repeated
anchors can match (see repeats), so the reference is those phrases, cut into
shards by anchor; a shard's phrases meet in one task, which builds one suffix
automaton over them (bounded by BATCH_WORDS words plus the last
anchor), marks every state with the smallest id it occurs in, and streams the
shard's documents through it.  Matching statistics give, at each word, the
longest match; if it reaches 50 words, the state of the last 50 tells whether a
smaller id holds them.

Automata are shipped by shuffle to the documents that share an anchor instead of
being broadcast to all: the reference grows with the corpus.  Anchors with more
than CAP different phrases are settled by window hashes (see repeats).

Defined cases: null text has no words; documents under 50 words lose nothing;
a null id counts as the smallest; rows that repeat an id do not remove each
other; equal texts with a larger id lose all words; an empty table gives no
rows; ids are read as long; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .repeats import CAP, Unit, remove_repeats, word_kept, word_load, word_ship, word_symbols

WINDOW = 50
GRAM = 10
BATCH_WORDS = 1 << 15  # words of a shard; bounds the automaton


class SuffixAutomaton:
    """Suffix automaton of several sequences; low[s] is the smallest id among
    the sequences in which the strings of state s occur (after finish())."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.low = [-1], [0], [1 << 63]

    def _state(self, length, edges, link, low):
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        self.low.append(low)
        return len(self.len) - 1

    def _clone(self, p, q, c):
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], 1 << 63)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, sequence, ident: int) -> None:
        nxt, link, length, low = self.next, self.link, self.len, self.low
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # the string so far is known already
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            else:
                cur = self._state(length[last] + 1, {}, 0, 1 << 63)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            if ident < low[last]:
                low[last] = ident

    def finish(self) -> None:
        """Pass the smallest ids down to shorter suffixes."""
        link, low = self.link, self.low
        for s in sorted(range(1, len(low)), key=self.len.__getitem__, reverse=True):
            p = link[s]
            if low[s] < low[p]:
                low[p] = low[s]

    def matches(self, sequence, window: int):
        """(start, smallest id) of every window of the sequence that occurs."""
        nxt, link, length, low = self.next, self.link, self.len, self.low
        s = k = 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                k = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                k += 1
            if k >= window:
                while length[link[s]] >= window:
                    s = link[s]
                k = min(k, length[s])
                yield i - window + 1, low[s]


def match_statistics(segments, anchors, ords, needs, unit):
    """(segment, window) of windows that a segment with a smaller id holds too."""
    found_s, found_w = [], []
    sam = SuffixAutomaton()
    sequences = [s.tolist() for s in segments]
    for seq, ident in zip(sequences, ords.tolist(), strict=True):
        sam.add(seq, ident)
    sam.finish()
    for k, (seq, ident) in enumerate(zip(sequences, ords.tolist(), strict=True)):
        for at, low in sam.matches(seq, unit.window):
            if low < ident:
                found_s.append(k)
                found_w.append(at)
    return np.array(found_s, np.int64), np.array(found_w, np.int64)


def remove_repeated_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW,
                          cap: int = CAP, with_text: bool = False) -> DataFrame:
    """One row per input row: id, key (md5 of the text), n (words), n_removed,
    n_spans, kept_sha256; with_text adds the kept words joined by one space."""
    unit = Unit(window, min(GRAM, window), word_symbols, word_kept, ordered=True, batch=BATCH_WORDS, ship=word_ship, load=word_load)
    return remove_repeats(df, text_col, id_col, unit, match_statistics, cap, with_text)


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeated_words(read(spark, sf_dir, "documents"))
    return d.selectExpr("id AS doc_id", "n AS n_words", "n_removed", "kept_sha256", "n_spans")


SQL_OP9 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) AS t(i)),
low AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
hit AS (SELECT r, i FROM win JOIN low ON win.h = low.h WHERE low.d < win.doc_id),
gone AS (SELECT DISTINCT r, i + k AS p FROM hit, unnest(range(0, 50)) AS t(k)),
word AS (SELECT r, p, w[p] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY p) AS kept FROM word WHERE NOT EXISTS
  (SELECT 1 FROM gone WHERE gone.r = word.r AND gone.p = word.p) GROUP BY word.r),
spans AS (SELECT r, count(*) AS n, count(*) FILTER (first) AS n_spans
  FROM (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 1, true) AS first FROM gone) GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(spans.n, 0) AS n_removed,
  sha256(coalesce(kept.kept, '')) AS kept_sha256, coalesce(spans.n_spans, 0) AS n_spans
FROM w LEFT JOIN kept ON kept.r = w.r LEFT JOIN spans ON spans.r = w.r
"""
