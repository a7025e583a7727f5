"""Problem 8: filling fixed-capacity containers with texts (exact-complement hashing).

Sizes are tokens of a public tokenizer.  A text longer than a container is split into full
containers and a rest; nothing else is split.  The plan needs only how many items there are of each
size (at most ``capacity`` counts): from the largest size down, a gap is closed exactly by one item,
by a pair or by a triple, looked up in tables of available single, pair and triple sums and taken
as often as the counts allow; where no exact complement is left, the largest item that fits goes
in, and the gap shrinks.  A pattern is taken until fewer of some size s are left than it needs, at
most capacity / s; from then on every pattern bound by s takes at least one of them.  So there are
at most ``sum(1 + capacity / s)`` patterns (``pattern_bound``, 18,846 for 2,048), however many items
there are.  Items get their place by their rank within their size, counted per part, so a size that
a third of all rows share never comes into one task.

Defined results: null and empty texts (no tokens) are in no container; repeated rows are items of
their own; equal sizes are placed in the order of part, id and piece; an item's tokens are
[token_start, token_end) of its text's tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.llm.batches import map_texts
from fathomgrid.session import cut_lineage

CAPACITY = 2048
#: Parts into which the items of a size are dealt for ranking.
PARTS = 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoding(raw: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens).  The vocabulary file (under 1 MB) is read on the driver and broadcast, so
    executors need no copy of it; each worker builds its encoder once."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 16 << 20:
        raise ValueError("a vocabulary of over 16 MB is not broadcast")
    shared = documents.sparkSession.sparkContext.broadcast(raw)
    cache: list = []

    def fn(batch: pa.RecordBatch) -> pa.Table:
        if not cache:
            cache.append(_encoding(shared.value, pattern))
        encode = cache[0].encode_ordinary
        n = np.fromiter((len(encode(t)) for t in batch.column("text").to_pylist()), dtype=np.int64, count=batch.num_rows)
        return pa.table({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n)})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    return map_texts(docs, "text", fn, "doc_id long, n_tokens long")


def pattern_bound(capacity: int) -> int:
    return sum(1 + capacity // s for s in range(1, capacity + 1))


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes, how many containers) that place every item; counts[s] items of size s <= capacity."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    sums = {"pairs": None, "stale": 0}

    def pair_of(gap: int) -> tuple[int, int] | None:
        have = left[1:gap] > 0
        both = np.flatnonzero(have & have[::-1]) + 1
        both = both[(both * 2 != gap) | (left[both] > 1)]
        both = both[both * 2 >= gap]
        return (int(both[-1]), gap - int(both[-1])) if len(both) else None

    def triple_of(gap: int) -> tuple[int, int, int] | None:
        if sums["pairs"] is None or sums["stale"] >= 64:
            have = (left > 0).astype(np.float64)
            n = 1 << int(np.ceil(np.log2(2 * len(have))))
            sums["pairs"] = np.fft.irfft(np.fft.rfft(have, n) ** 2, n)[: len(have)] > 0.5
            sums["stale"] = 0
        first = np.flatnonzero(left[:gap] > 0)
        first = first[(first > 0) & sums["pairs"][gap - first]]
        for a in first[::-1].tolist():
            left[a] -= 1
            b = pair_of(gap - a)
            left[a] += 1
            if b:
                return (a, *b)
        return None

    for size in range(capacity, 0, -1):
        while left[size] > 0:
            if size == capacity:
                out.append(((size,), int(left[size])))
                left[size] = 0
                continue
            pattern, gap = [size], capacity - size
            left[size] -= 1
            while gap > 0:
                if left[gap] > 0:
                    more: tuple[int, ...] | None = (gap,)
                else:
                    more = pair_of(gap) or triple_of(gap)
                if more is None:  # residual: best fit
                    fit = np.flatnonzero(left[1 : gap + 1] > 0)
                    if not len(fit):
                        break
                    more = (int(fit[-1]) + 1,)
                for s in more:
                    left[s] -= 1
                    gap -= s
                pattern += more
            use = np.bincount(pattern, minlength=capacity + 1)
            for s in pattern:
                left[s] += 1
            need = np.flatnonzero(use)
            times = int((left[need] // use[need]).min())
            left[need] -= times * use[need]
            sums["stale"] += 1
            out.append((tuple(pattern), times))
    assert len(out) <= pattern_bound(capacity)
    return out


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first container, items per container) of each pattern and size."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for sizes, times in patterns:
        for s in sorted(set(sizes)):
            per = sizes.count(s)
            at = rank.get(s, 0)
            rows.append((s, at, at + per * times, base, per))
            rank[s] = at + per * times
        base += times
    return rows


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, pattern: str = PATTERN, parts: int = PARTS) -> DataFrame:
    """(container_id, doc_id, piece, token_start, token_end, tokens): where every item stands."""
    spark = documents.sparkSession
    counted = token_counts(documents, vocabulary, pattern).where(F.col("n_tokens") > 0)
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), ((F.col("n_tokens") - 1) / capacity).cast("long"))).alias("piece", "k")
    items = counted.select("doc_id", "n_tokens", piece).select(
        "doc_id", "piece", (F.col("k") * capacity).alias("token_start"), F.least(F.col("n_tokens"), (F.col("k") + 1) * capacity).alias("token_end")
    )
    items = items.withColumn("tokens", (F.col("token_end") - F.col("token_start")).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    items = cut_lineage(items)  # the texts are tokenised once
    per_part = items.groupBy("tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in per_part.groupBy("tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["tokens"]] = r["n"]
    slots = slot_table(plan(counts, capacity))
    # At most pattern_bound(capacity) patterns, most of few sizes: a proven bound, so it's broadcast.
    slot = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 1)], "tokens int, lo long, hi long, base long, per int"))
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("tokens", "part").orderBy("doc_id", "piece", "token_start")
    ranked = items.withColumn("w", F.row_number().over(within) - 1).join(offsets.hint("merge"), ["tokens", "part"]).withColumn("rank", F.col("offset") + F.col("w"))
    placed = ranked.join(slot, "tokens").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    container = F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))
    return placed.select(container.cast("long").alias("container_id"), "doc_id", "piece", "token_start", "token_end", "tokens")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, items, tokens, unused)."""
    g = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return g.withColumn("unused", F.lit(capacity) - F.col("tokens"))
