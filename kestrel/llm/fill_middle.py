"""Operator 13, fill-in-the-middle by content-defined chunk memoization.

A rolling hash of the last GRAM bytes cuts each text into chunks wherever the
content says so, so that copies and shared passages give the same chunks.  A
chunk's summary (tokens, code points, whether its first and last characters are
letters) is kept in a cache of the worker: the chunk's hash finds the entry and
the stored content must be equal.  Adding up summaries, less one token where a
run of letters goes on over a chunk boundary, gives the token count of the text
and finds the chunk that holds each document cut; only that chunk is tokenised.

Tokens are ``[A-Za-z]+|[^A-Za-z]`` over code points.  Documents never leave their
task: there is no shuffle, and the cache (CACHE_BYTES of content, emptied when
full) only saves work.  Chunks without a trigger are cut at MAX_CHUNK bytes.

Defined cases: null text is empty; empty texts and texts that hold a marker stay
plain; a null id is hashed as no digits; repeated rows are cut alike; an empty
table gives no rows; input columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import read

GRAM = 16
MASK = np.uint64(511)      # a trigger about every 512 bytes
MAX_CHUNK = 1 << 13
CACHE_BYTES = 32 << 20
SECTION = 1 << 20          # bytes of text hashed together

#: fixed values: markers of prefix, suffix and middle; shares in percent
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CONTINUES = np.zeros(256, bool)  # bytes inside a code point
_CONTINUES[0x80:0xC0] = True


def token_starts(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the tokens that start in a piece, as if nothing came
    before it; flag per byte: inside a code point)."""
    b = np.frombuffer(piece, np.uint8)
    letter, inside = _LETTER[b], _CONTINUES[b]
    runs_on = letter.copy()
    runs_on[1:] &= letter[:-1]
    runs_on[:1] = False
    return np.flatnonzero(~inside & ~runs_on), inside


class Summaries:
    """Boundary summaries of chunks, by content."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known: dict[int, tuple[bytes, tuple]] = {}
        self.limit, self.held, self.hits = limit, 0, 0

    def of(self, key: int, piece: bytes) -> tuple[int, int, bool, bool]:
        """(tokens, code points, starts with a letter, ends with one)."""
        entry = self.known.get(key)
        if entry is not None and entry[0] == piece:
            self.hits += 1
            return entry[1]
        starts, inside = token_starts(piece)
        got = len(starts), len(piece) - int(inside.sum()), bool(_LETTER[piece[0]]), bool(_LETTER[piece[-1]])
        if self.held + len(piece) > self.limit:
            self.known.clear()
            self.held = 0
        if entry is None or self.held == 0:
            self.known[key] = piece, got
            self.held += len(piece)
        return got


def chunk_bounds(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted offsets at which the chunks of a section begin (documents included)."""
    at = np.zeros(0, np.int64)
    if len(buf) >= GRAM:
        h = T.window_hashes(T._CODES[buf], GRAM)
        at = np.flatnonzero((h & MASK) == 0) + GRAM
        at = at[at < len(buf)]
        doc = np.searchsorted(off, at, side="right") - 1
        at = at[(at - off[doc] >= GRAM) & ~_CONTINUES[buf[at]]]
    cuts = np.unique(np.concatenate((off[off < len(buf)], at)))
    more = []
    for k in np.flatnonzero(np.diff(np.append(cuts, len(buf))) > MAX_CHUNK).tolist():
        lo, hi = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else len(buf)
        while hi - lo > MAX_CHUNK:
            lo += MAX_CHUNK
            while _CONTINUES[buf[lo]]:
                lo -= 1
            more.append(lo)
    return np.unique(np.concatenate((cuts, np.array(more, np.int64)))) if more else cuts


def find_cut(chunks: list, k: int) -> tuple[int, int]:
    """(bytes, code points) before token k of a text made of (piece, summary)."""
    size = chars = seen = 0
    letter_before = False
    for piece, (n, c, first, last) in chunks:
        joined = letter_before and first
        if k < seen + n - joined:
            starts, inside = token_starts(piece)
            b = int(starts[k - seen + joined])
            return size + b, chars + b - int(inside[:b].sum())
        seen += n - joined
        size, chars, letter_before = size + len(piece), chars + c, last
    return size, chars


def count_tokens(chunks: list) -> int:
    n, letter_before = 0, False
    for _, (k, _, first, last) in chunks:
        n += k - (letter_before and first)
        letter_before = last
    return n


def arrange(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text with its middle text[a:b] moved to the end."""
    if form == "psm":
        return PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b]
    if form == "spm":
        return SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b]
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text that arrange() was given."""
    if form == "plain":
        return output
    lead, then = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(lead):].split(then, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = "1",
                   with_text: bool = False) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256; with_text adds the output itself."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *h)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        memo = Summaries()
        for batch in batches:
            buf, off = T.flat(batch.column(1))
            draws = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], axis=1)
            for i, j in T.chunks(off, SECTION):
                part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                bounds = chunk_bounds(part, o)
                ends = np.append(bounds[1:], len(part))
                raw = part.tobytes()
                keys = T.word_hashes(part, bounds, ends).tolist()
                first = np.searchsorted(bounds, o).tolist()
                bounds, ends = bounds.tolist(), ends.tolist()
                out = [[] for _ in range(7)]
                for r in range(i, j):
                    text = raw[o[r - i]:o[r - i + 1]]
                    chunks = []
                    for k in range(first[r - i], first[r - i + 1] if len(text) else first[r - i]):
                        piece = raw[bounds[k]:ends[k]]
                        chunks.append((piece, memo.of(keys[k], piece)))
                    row = _format(text, chunks, *draws[r].tolist())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
                        pa.array(out[4], pa.string()), pa.array(out[5], pa.string()),
                        pa.array([x.decode("utf-8", "replace") if with_text else None for x in out[6]], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=[
                    "id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])

    got = src.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, "
                              "output_sha256 string, restored_sha256 string, output string")
    return got if with_text else got.drop("output")


def _format(text: bytes, chunks: list, h1: int, h2: int, h3: int, h4: int) -> tuple:
    n = count_tokens(chunks)
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        form = "plain"
    prefix = middle = None
    output = text
    if form != "plain":
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        (a, prefix), (b, upto) = find_cut(chunks, lo), find_cut(chunks, hi)
        middle = upto - prefix
        output = arrange(text, form, a, b)
    sha = hashlib.sha256(output).hexdigest()
    return n, form, prefix, middle, sha, hashlib.sha256(restore(output, form)).hexdigest(), output


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:least(p, q)], '') AS a, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS m,
    array_to_string(u[greatest(p, q) + 1:], '') AS s FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""
