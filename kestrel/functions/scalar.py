"""Scalar column functions.  All are built-in Spark
expressions (whole-stage codegen, no Python in the row path).

Regex patterns are written in the subset shared by Java and RE2, with the
Unicode classes spelled out (Java's ``\\w``/``\\d``/``\\s`` are ASCII-only
unless ``(?U)`` is set, RE2's always are):

fixed values
- word character:  [\\p{L}\\p{N}_]
- digit:           \\p{Nd}
- white space:     [ \\t\\n\\f\\r\\x0B]
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[ \t\n\f\r\x0B]"
TOKEN_RE = WORD + "+"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_ \t\n\f\r\x0B]"
DIGITS = r"\p{Nd}+"
TOPIC_PAIR_RE = r"\(\s*(\d+)\s*,\s*([-+0-9.eE]+)\s*\)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_token(col, sep: str = ":", index: int = 1) -> Column:
    """strip, split on ``sep``, take element ``index`` (0-based), strip."""
    return F.trim(F.get(F.split(F.trim(_c(col)), sep), index))


def parse_topics(col) -> Column:
    """F2: ``[(0, 0.12), (2, 0.88)]`` → array<struct<topic INT, prob DOUBLE>>,
    every digit kept (``1e-05`` stays 1e-05)."""
    s = _c(col)
    ids = F.regexp_extract_all(s, F.lit(TOPIC_PAIR_RE), 1)
    probs = F.regexp_extract_all(s, F.lit(TOPIC_PAIR_RE), 2)
    return F.transform(F.arrays_zip(ids.alias("t"), probs.alias("p")),
                       lambda z: F.struct(z["t"].try_cast("int").alias("topic"),
                                          z["p"].try_cast("double").alias("prob")))


def topic_prob(arr, topic: int) -> Column:
    """F3 helper: probability of ``topic`` in a parsed list (0 when absent)."""
    return F.aggregate(F.filter(_c(arr), lambda x: x["topic"] == topic), F.lit(0.0),
                       lambda acc, x: acc + x["prob"])


def best_topic(arr) -> Column:
    """Topic of the largest probability, the first wins ties; null for an empty list."""
    a = _c(arr)
    best = F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, 0),
                       lambda acc, x: F.when(x["prob"] > acc["prob"], x).otherwise(acc))
    return F.when(F.size(a) > 0, best["topic"])


def strip_punct(col, digits: bool = True, spaces: bool = False) -> Column:
    """white space runs → ' ', drop non-word non-space characters,
    optionally digits and all spaces."""
    c = F.regexp_replace(_c(col), SPACE + "+", " ")
    c = F.regexp_replace(c, NOT_WORD_OR_SPACE, "")
    if digits:
        c = F.regexp_replace(c, DIGITS, "")
    if spaces:
        c = F.regexp_replace(c, " ", "")
    return c


def is_alpha(col) -> Column:
    """non-empty and letters only."""
    return _c(col).rlike(r"^\p{L}+$")


def extract_digits(col) -> Column:
    """F8: first run of ASCII digits ('' when none)."""
    return F.regexp_extract(_c(col), r"(\d+)", 1)


def join_tokens(col, sep: str = " ") -> Column:
    """F9."""
    return F.array_join(_c(col), sep)


def month_start(year, month) -> Column:
    """F10."""
    return F.make_date(_c(year), _c(month), F.lit(1))


def prev_month(date) -> Column:
    """first day of the previous month."""
    return F.add_months(_c(date), -1)


def period(date, unit: str = "quarter") -> Column:
    """'YYYY' or 'YYYYQn'."""
    d = _c(date)
    if unit == "year":
        return F.year(d).cast("string")
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def log_clip(col) -> Column:
    """log10 clipped below at 0 for x > 0; 0 for x = 0; null for x < 0."""
    x = _c(col).cast("double")
    return F.when(x > 0, F.greatest(F.log10(x), F.lit(0.0))).when(x == 0, F.lit(0.0))


def sigmoid(col) -> Column:
    """F14."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def dcg_term(rel, rank) -> Column:
    """(2^rel - 1) / log2(rank + 1)."""
    return (F.pow(F.lit(2.0), _c(rel)) - 1) / F.log2(_c(rank) + F.lit(1.0))


def dot(a, b) -> Column:
    """F16: dot product of two numeric arrays (shorter length wins)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(F.filter(prods, lambda v: v.isNotNull()), F.lit(0.0), lambda acc, v: acc + v)


def pad_truncate(col, length: int = 32, pad=0) -> Column:
    """fixed length: truncate, or pad with ``pad``."""
    c = _c(col)
    return F.slice(F.concat(c, F.array_repeat(F.lit(pad).cast("bigint"), F.lit(length))), 1, length)


def mask(col) -> Column:
    """1 where the id is a real token (> 0), else 0."""
    return F.transform(_c(col), lambda x: (x > 0).cast("int"))
