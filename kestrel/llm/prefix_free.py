"""Operator 7, exact repeats of 200 bytes by prefix-free parsing.

A rolling hash triggers at the smallest 24-byte gram of each 200-byte window and
cuts the corpus into overlapping phrases.  The dictionary (distinct phrases) and
the parse (their places) are Spark tables; phrases that occur again settle all
their windows without looking at bytes.  Where one trigger has several phrases,
their suffixes are put into order by their first 200 bytes (as 64-bit hashes:
only equality to that depth matters here, so no deeper order is computed) and
equal neighbours are repeats.

Defined cases: null text is empty; texts under 200 bytes lose nothing (and
nothing repeats them); equal texts of 200 bytes or more lose all; overlapping
repeats inside one text count; repeated rows are equal texts; an empty table
gives no rows; ids need not be unique or non-null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .repeats import CAP, Unit, byte_kept, byte_load, byte_ship, byte_symbols, remove_repeats, segment_windows

WINDOW = 200
GRAM = 24


def order_suffixes(segments, anchors, ords, needs, unit):
    """(segment, window) of windows, in segments that need it, whose first
    `window` symbols start at another place too."""
    h, s, w = segment_windows(segments, unit)
    order = np.argsort(h, kind="stable")
    x = h[order]
    same = np.zeros(len(x), bool)
    eq = x[1:] == x[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    hit = order[same]
    hit = hit[needs[s[hit]]]
    return s[hit], w[hit]


def remove_repeated_bytes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW,
                          cap: int = CAP, with_text: bool = False) -> DataFrame:
    """One row per input row: id, key (md5 of the text), n (bytes), n_removed,
    n_spans, kept_sha256; with_text adds what is left (bytes read as UTF-8)."""
    unit = Unit(window, min(GRAM, window), byte_symbols, byte_kept, ordered=False, batch=1 << 18, ship=byte_ship, load=byte_load)
    return remove_repeats(df, text_col, id_col, unit, order_suffixes, cap, with_text)


def op7_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeated_bytes(read(spark, sf_dir, "documents"))
    return d.selectExpr("id AS doc_id", "n AS n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL_OP7 = r"""
WITH b AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM b),
win AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM n, unnest(range(1, n - 198)) AS t(i)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) >= 2),
hit AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true) AS first
  FROM win JOIN twice ON win.h = twice.h),
island AS (SELECT r, i, sum(CAST(first AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS lo, max(i) + 200 AS hi FROM island GROUP BY r, k),
gap AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS lo, lo AS hi FROM span
  UNION ALL SELECT n.r, coalesce(s.hi, 1), n.n + 1 FROM n LEFT JOIN (SELECT r, max(hi) AS hi FROM span GROUP BY r) s ON s.r = n.r),
kept AS (SELECT gap.r, string_agg(CASE WHEN gap.lo < gap.hi THEN hex(n.b[gap.lo:gap.hi - 1]) ELSE '' END, '' ORDER BY gap.lo) AS x
  FROM gap JOIN n ON n.r = gap.r GROUP BY gap.r),
s AS (SELECT r, sum(hi - lo) AS removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed,
  coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM n JOIN kept ON kept.r = n.r LEFT JOIN s ON s.r = n.r
"""
