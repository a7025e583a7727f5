"""Problem 9: evaluation texts leaking into training text (spaced-seed hashing).

A seed is a mask over a span of consecutive words: the words at its set offsets are hashed, the
others are ignored, so a hit tolerates substitutions at the ignored offsets.  Test windows and
corpus windows are joined on (seed, hash); around each hit the overlap is extended word by word,
tolerating isolated substitutions, and measured.

Words are the longest runs of letters or digits in lower case; inline markup (tags, entities,
emphasis marks, link targets, wiki link prefixes) doesn't count as words and doesn't part words'
neighbours.  Defined results: null or empty texts give no rows; items or documents of fewer words
than the span have no windows; repeated rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import map_texts

#: Set offsets of each seed. Every span is at most the least overlap (10), so an exact overlap
#: always hits; the second mask of smaller weight lets through substitutions at other offsets.
SEEDS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 5, 7, 8, 9), (0, 1, 3, 4, 6, 8, 9))
#: Characters of test items, all together, that are broadcast; beyond, both sides are shuffled.
BROADCAST_CHARS = 32 << 20
#: Parts into which the documents of a window that many share are dealt in the shuffle join.
SALTS = 16

_MARKUP = re.compile(
    r"</?[A-Za-z][^<>\n]*>"  # tags
    r"|&(?:[A-Za-z]{2,}|#\d+|#x[0-9A-Fa-f]+);"  # entities
    r"|(?<=\])\([^()\s]+\)"  # link targets
    r"|(?<=\[\[)[^\[\]|\n]+\|(?=[^\[\]\n]*\]\])"  # wiki link targets
    r"|\\(?:emph|text[a-z]+|underline|cite|ref|label)\b(?:\[[^\]\n]*\])?"  # inline commands
)
_HINT = re.compile(r"[<&\[\\]")


def inline_markup_mask(texts: list, offsets: np.ndarray, n: int) -> np.ndarray | None:
    """Positions of the batch that lie in inline markup; None if there are none."""
    mask = None
    for i, t in enumerate(texts):
        if t and _HINT.search(t):
            for m in _MARKUP.finditer(t):
                if mask is None:
                    mask = np.zeros(n, dtype=bool)
                mask[offsets[i] + m.start() : offsets[i] + m.end()] = True
    return mask


def _windows(h: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per seed: hash and first word of every window."""
    out = []
    for k, seed in enumerate(SEEDS):
        x, first = cpx.shingles(h, row, max(seed) + 1, seed)
        out.append((x ^ np.uint64(k), first))
    return out


def _words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    cp, offsets = cpx.explode(texts)
    h, row, _, _ = cpx.words(cp, offsets, inline_markup_mask(texts, offsets, len(cp)))
    return h, row


class ItemIndex:
    """Sorted window hashes of the test items, with a bit table of about their number in front."""

    def __init__(self, ids: list, texts: list) -> None:
        self.ids = np.array(ids)
        self.h, row = _words_of(texts)
        self.item_start = np.searchsorted(row, np.arange(len(ids) + 1))
        hashes, firsts = zip(*_windows(self.h, row))
        x, first = np.concatenate(hashes), np.concatenate(firsts)
        order = np.argsort(x, kind="stable")
        self.x, self.first, self.item = x[order], first[order], row[first[order]]
        self.shift = np.uint64(64 - min(26, max(8, int(len(x)).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[(self.x >> self.shift).astype(np.int64)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into x, index into the table) with equal hash."""
        maybe = np.flatnonzero(self.bits[(x >> self.shift).astype(np.int64)])
        lo = np.searchsorted(self.x, x[maybe], "left")
        n = np.searchsorted(self.x, x[maybe], "right") - lo
        left = np.repeat(maybe, n)
        right = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return left, right


def _runs(equal: np.ndarray) -> tuple[int, int, int, int]:
    """Of one diagonal: longest exact run; length, matches and start of the longest overlap in
    which substitutions are isolated (each between two equal words)."""
    padded = np.concatenate(([False], equal, [False])).astype(np.int8)
    d = np.diff(padded)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    if not len(starts):
        return 0, 0, 0, 0
    exact = int((ends - starts).max())
    new = np.concatenate(([True], starts[1:] - ends[:-1] > 1))
    group = np.flatnonzero(new)
    first, last = starts[group], ends[np.concatenate((group[1:] - 1, [len(ends) - 1]))]
    best = int(np.argmax(last - first))
    return exact, int(last[best] - first[best]), int(equal[first[best] : last[best]].sum()), int(first[best])


def _overlaps(texts: list, index: ItemIndex) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item number, exact run, tolerant overlap, matched words, first word of the overlap in the item)."""
    h, row = _words_of(texts)
    start = np.searchsorted(row, np.arange(len(texts) + 1))
    found: set[tuple[int, int, int]] = set()
    for x, first in _windows(h, row):
        left, right = index.hits(x)
        if len(left):
            pos, at = first[left], index.first[right]
            found.update(zip(row[pos].tolist(), index.item[right].tolist(), (pos - at).tolist()))
    best: dict[tuple[int, int], tuple] = {}
    for r, item, shift in found:
        a0, a1 = int(index.item_start[item]), int(index.item_start[item + 1])
        lo, hi = max(a0, int(start[r]) - shift), min(a1, int(start[r + 1]) - shift)
        exact, length, matched, at = _runs(index.h[lo:hi] == h[lo + shift : hi + shift])
        got = (exact, length, matched, lo + at - a0)
        if got > best.get((r, item), (0, 0, 0, 0)):
            best[r, item] = got
    return [(r, item, *got) for (r, item), got in best.items()]


OVERLAP_SCHEMA = "doc_id long, item_id long, run int, overlap int, matched int, item_word int"


def leaked_passages(documents: DataFrame, items: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per document and test item that share a seed hit, with the measured overlap:
    ``run`` (longest exact run of words), ``overlap`` and ``matched`` (longest overlap with isolated
    substitutions and its equal words), ``item_word`` (where it begins in the item).

    The test side is measured first.  Up to ``broadcast_chars`` characters its texts go to every task
    and the corpus is read once, without a shuffle; beyond, both sides' windows are joined by hash.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    tests = items.select("item_id", "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    if (tests.agg(F.sum(F.length("text"))).first()[0] or 0) > broadcast_chars:
        return _leaked_by_shuffle(docs, tests)
    head = tests.collect()
    head.sort(key=lambda r: r["item_id"])
    index = spark.sparkContext.broadcast(([r["item_id"] for r in head], [r["text"] for r in head]))
    cache: list[ItemIndex] = []

    def scan(batch):
        import pyarrow as pa

        if not cache:
            cache.append(ItemIndex(*index.value))
        ids = batch.column("doc_id").to_numpy()
        rows = _overlaps(batch.column("text").to_pylist(), cache[0])
        if not rows:
            return None
        c = np.array(rows, dtype=np.int64)
        i32 = lambda k: pa.array(c[:, k].astype(np.int32))
        return pa.table({"doc_id": pa.array(ids[c[:, 0]]), "item_id": pa.array(cache[0].ids[c[:, 1]]), "run": i32(2), "overlap": i32(3), "matched": i32(4), "item_word": i32(5)})

    found = map_texts(docs, "text", scan, OVERLAP_SCHEMA) if head else spark.createDataFrame([], OVERLAP_SCHEMA)
    return _best(found)


def _best(found: DataFrame) -> DataFrame:
    """Repeated document or item ids give one row: that of the longest run."""
    cols = ["run", "overlap", "matched", "item_word"]
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*cols)).alias("b")).select("doc_id", "item_id", *[f"b.{c}" for c in cols])


def _leaked_by_shuffle(docs: DataFrame, tests: DataFrame) -> DataFrame:
    def windows_of(id_name: str):
        def fn(batch):
            import pyarrow as pa

            ids = batch.column(id_name).to_numpy()
            h, row = _words_of(batch.column("text").to_pylist())
            parts = _windows(h, row)
            x = np.concatenate([p[0] for p in parts])
            r = ids[row[np.concatenate([p[1] for p in parts])]]
            return pa.table({"x": pa.array(x.view(np.int64)), id_name: pa.array(r)})

        return fn

    # A window that many documents share is dealt out by document; the test side has a copy per part.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    t = map_texts(tests, "text", windows_of("item_id"), "x long, item_id long").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = map_texts(docs, "text", windows_of("doc_id"), "x long, doc_id long").distinct().withColumn("salt", salt)
    pairs = d.join(t, ["x", "salt"]).select("doc_id", "item_id").distinct()
    both = pairs.join(docs, "doc_id").join(tests.withColumnRenamed("text", "item_text"), "item_id")

    def measure(frames):
        for f in frames:
            out = []
            for doc_id, item_id, text, item_text in zip(f.doc_id, f.item_id, f.text, f.item_text):
                out += [(doc_id, item_id, *got[2:]) for got in _overlaps([text], ItemIndex([item_id], [item_text]))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run", "overlap", "matched", "item_word"])

    return _best(both.select("doc_id", "item_id", "text", "item_text").mapInPandas(measure, OVERLAP_SCHEMA))


def leaked_documents(documents: DataFrame, items: DataFrame, least: int = 10, **options) -> DataFrame:
    """(doc_id, item_id) that share at least ``least`` consecutive words."""
    if least < max(max(s) for s in SEEDS) + 1:
        raise ValueError("the least overlap is shorter than a seed's span")
    return leaked_passages(documents, items, **options).where(F.col("run") >= least).select("doc_id", "item_id")
