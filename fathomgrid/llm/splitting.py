"""Problem 4: splitting oversized texts at natural boundaries (lexical-cohesion segmentation).

A text over the limit is cut into pieces of at most ``limit`` characters.  At every natural
boundary of the size window (paragraph, line, sentence) the words of the block before and the block
after are compared; the similarity curve's valleys are topic changes, and the deepest valley of
each window is the cut.  Where a window has no sentence or line end, the cut is at white space, and
failing that at the limit, never before a combining mark.  Each piece after the first begins with
at most ``overlap`` last characters of the one before, from a word's start where there is one.

Defined results: null ids are kept; null, empty and short texts give no rows in ``only_oversized``
form and one whole piece otherwise; a null or non-positive ``start_line`` counts as 1; pieces
joined without their overlaps are the text again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import map_texts

LIMIT, OVERLAP = 6000, 200
#: Words compared on either side of a boundary, and hash bins of a block's word counts.
BLOCK_WORDS, BINS = 120, 512

_BOUNDARY = re.compile(r"(?P<par>\n[ \t]*\n\s*)|(?P<line>\n)|(?P<sent>[.!?…]+[\"”»')\]]*[ \t]+|[。！？]+)")
#: How much a boundary's kind adds to its valley's depth.
KIND_WEIGHT = {"par": 0.30, "line": 0.12, "sent": 0.0}
_SPACE = re.compile(r"\s+")


def _cohesion(cp: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cosine of the word counts before and after each cut, over blocks of BLOCK_WORDS words."""
    h, _, start, _ = cpx.words(cp, np.array([0, len(cp)]))
    if not len(h):
        return np.ones(len(cuts))
    counts = np.zeros((len(h) + 1, BINS), dtype=np.float32)
    counts[np.arange(1, len(h) + 1), (h % np.uint64(BINS)).astype(np.int64)] = 1
    np.cumsum(counts, axis=0, out=counts)
    mid = np.searchsorted(start, cuts)
    before = counts[mid] - counts[np.maximum(mid - BLOCK_WORDS, 0)]
    after = counts[np.minimum(mid + BLOCK_WORDS, len(h))] - counts[mid]
    norm = np.sqrt((before**2).sum(1) * (after**2).sum(1))
    return np.where(norm > 0, (before * after).sum(1) / np.maximum(norm, 1e-9), 0.0)


def _depths(sim: np.ndarray) -> np.ndarray:
    """Depth of each valley: how far the curve rises to its highest point on either side."""
    left = np.maximum.accumulate(sim) - sim
    right = np.maximum.accumulate(sim[::-1])[::-1] - sim
    return left + right


def _cut(text: str, floor: int, lo: int, hi: int) -> tuple[int, str]:
    """The best cut in (lo, hi], or in (floor, lo] if no natural one is there: its position and kind."""
    found = [(m.end(), m.lastgroup) for m in _BOUNDARY.finditer(text, lo, hi) if lo < m.end() <= hi]
    if not found and floor < lo:  # none in the second half: any in the first
        found = [(m.end(), m.lastgroup) for m in _BOUNDARY.finditer(text, floor, lo) if floor < m.end() <= lo]
    if found:
        a, b = max(0, lo - LIMIT // 3), min(len(text), hi + LIMIT // 3)
        cp = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.array([p for p, _ in found])
        score = _depths(_cohesion(cp, at - a)) + np.array([KIND_WEIGHT[k] for _, k in found])
        best = int(np.flatnonzero(score >= score.max() - 1e-9)[-1])
        return found[best]
    spaces = [m.end() for m in _SPACE.finditer(text, lo, hi)]
    if spaces:
        return spaces[-1], "space"
    import unicodedata

    end = hi
    while end > lo + 1 and end < len(text) and unicodedata.combining(text[end]):
        end -= 1
    return end, "hard"


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, new, end, kind) of every piece: text[start:end], of which text[start:new] is overlap."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    out: list[tuple[int, int, int, str]] = []
    start = new = 0
    while len(text) - start > limit:
        room = limit - (new - start)
        end, kind = _cut(text, new, new + room // 2, new + room)
        out.append((start, new, end, kind))
        new, start = end, end - overlap
        start = max(start, out[-1][1])  # an overlap never reaches behind the piece's own text
        word = _SPACE.search(text, start, new)
        if start > 0 and not text[start - 1].isspace() and word and word.end() < new:
            start = word.end()
    out.append((start, new, len(text), "end"))
    return out


COLUMNS = {"chunk_id": "string", "piece": "int", "start_char": "int", "new_char": "int", "end_char": "int", "start_line": "int", "end_line": "int", "cut": "string", "content": "string"}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
TYPES = [{"string": pa.string(), "int": pa.int32()}[t] for t in COLUMNS.values()]


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk longer than ``limit``.

    The length filter runs in the JVM, so only oversized texts go to Python; they are spread anew
    because long texts may stand together in a few files.
    """
    long = chunks.select(F.col("id").alias("chunk_id"), "content", "start_line").where(F.length("content") > limit)

    def fn(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for cid, text, line in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "content", "start_line"))):
            base = line if line is not None and line >= 1 else 1
            breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10)
            for k, (s, n, e, kind) in enumerate(pieces_of(text, limit, overlap)):
                first, last = np.searchsorted(breaks, s), np.searchsorted(breaks, max(s, e - 1))
                rows.append((cid, k, s, n, e, base + int(first), base + int(last), kind, text[s:e]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=list(COLUMNS))

    return map_texts(long.repartition(F.xxhash64("chunk_id")), "content", fn, SCHEMA)
