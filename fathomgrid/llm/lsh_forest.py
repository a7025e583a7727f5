"""Problem 7: near-duplicate records with small edits (LSH forest).

Each text's set of word shingles gives a class (texts of equal sets are one class, however many)
and minhash symbols.  Every tree sorts the classes by another sequence of symbols, and a run that
shares ``BASE`` symbols comes into one task and is compared whole.  A run of more than ``BLOCK``
classes is dealt out in blocks; every pair of blocks is a cell that any task may compare, so no
pair of a dense region is left out and no task gets it all.  Comparison inside a run is by sketches;
the pairs that pass are verified on their whole shingle sets.

Defined results: null texts, and texts of fewer words than a shingle, belong to no pair; equal
texts are a pair; repeated ids count once; classes of up to ``EXPAND`` members are expanded to pairs
of records, larger ones are given as pairs with their representative (smallest id), which names the
class without quadratic output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import map_texts
from fathomgrid.llm.components import connected_components
from fathomgrid.session import cut_lineage

#: Trees, symbols of a tree, classes compared at a time, classes of a block of a larger run.  A pair of
#: similarity s shares a run of some tree with probability 1-(1-s^BASE)^TREES: 0.994 at 0.5, 0.9999 at 0.65.
TREES, BASE, RUN, BLOCK = 18, 2, 200, 500
#: Minhashes, of which the first are the trees' symbols too; a sketch holds four bits of each.  A pair
#: passes if its estimate isn't below the threshold by more than SLACK (3.7 standard deviations at 0.5).
SKETCH, BITS, SLACK = 64, 4, 0.25
EXPAND = 64
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, size=SKETCH, dtype=np.uint64) | np.uint64(1)


def _sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes of a batch's texts, with their rows, sorted by row."""
    _, cp, off = cpx.from_arrow(texts)
    h, row, _, _ = cpx.words(cp, off)
    x, first = cpx.shingles(h, row, shingle)
    r = row[first]
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    return x[keep], r[keep], len(off) - 1


def _signatures(batch: pa.RecordBatch, shingle: int) -> pa.Table | None:
    x, r, _ = _sets(batch.column("text"), shingle)
    if not len(x):
        return None
    starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    rows = r[starts]
    cls = cpx.splitmix(np.add.reduceat(cpx.splitmix(x), starts))
    n = len(starts)
    mins = np.empty((n, len(_MULTIPLIERS)), dtype=np.uint64)
    for j, a in enumerate(_MULTIPLIERS):
        mins[:, j] = np.minimum.reduceat((x * a) ^ ((x * a) >> np.uint64(29)), starts)
    symbols = cpx.splitmix(mins)
    labels = (symbols[:, : TREES * BASE] & np.uint64(0xFFFF)).astype(">u2")  # big-endian, so bytes sort as symbols
    bits = ((symbols >> np.uint64(20)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    sketch = bits[:, ::2] << BITS | bits[:, 1::2]
    fixed = lambda a, w: pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1, dtype=np.int32) * w).tobytes()), pa.py_buffer(np.ascontiguousarray(a).tobytes())])
    return pa.table({"id": batch.column("id").take(pa.array(rows)), "cls": pa.array(cls.view(np.int64)), "labels": fixed(labels, 2 * labels.shape[1]), "sketch": fixed(sketch, SKETCH // 2)})


def _compare(cls: np.ndarray, sketch: np.ndarray, least: int, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
    equal = (sketch[a][:, None, :] == sketch[b][None, :, :]).sum(axis=2, dtype=np.int16)
    if a == b:
        equal = np.triu(equal, 1)
    i, j = np.nonzero(equal >= least)
    return cls[a][i], cls[b][j]


def _run(cls: np.ndarray, label: np.ndarray, sketch: np.ndarray, depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of each run of the sorted labels that shares ``depth`` symbols, compared whole in blocks."""
    edges = np.flatnonzero((label[1:, :depth] != label[:-1, :depth]).any(axis=1)) + 1
    bounds = np.concatenate(([0], edges, [len(cls)]))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo < 2:
            continue
        for i in range(lo, hi, RUN):
            for j in range(i, hi, RUN):
                yield _compare(cls, sketch, least, slice(i, min(hi, i + RUN)), slice(j, min(hi, j + RUN)))


def _across(cls: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one block of a large run with another."""
    cut = int(np.searchsorted(side, 1))
    for i in range(0, cut, RUN):
        for j in range(cut, len(cls), RUN):
            yield _compare(cls, sketch, least, slice(i, min(cut, i + RUN)), slice(j, min(len(cls), j + RUN)))


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by (cell, side, label): side -1 is compared within its runs, 0 with 1."""
    held: list[tuple] = []

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        cell, side, label, cls, sketch = (np.concatenate([p[k] for p in parts]) for k in range(5))
        edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        bounds = np.concatenate(([0], edges, [len(cls)]))
        xs, ys = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            c, k = cls[lo:hi], sketch[lo:hi]
            for x, y in _across(c, k, side[lo:hi], least) if side[lo] >= 0 else _run(c, label[lo:hi], k, BASE, least):
                if len(x):
                    xs.append(x)
                    ys.append(y)
        if xs:
            x, y = np.concatenate(xs), np.concatenate(ys)
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        label = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=">u2").reshape(n, -1).astype(np.uint16)
        packed = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(n, SKETCH // 2)
        sketch = np.hstack([packed >> BITS, packed & ((1 << BITS) - 1)])
        part = (batch.column("cell").to_numpy(), batch.column("side").to_numpy(), label, batch.column("cls").to_numpy(), sketch)
        # hold back the last cell: it may go on in the next batch
        first = int(np.searchsorted(part[0], part[0][-1]))
        if first or (held and held[-1][0][-1] != part[0][-1]):
            yield from emit([*held, tuple(p[:first] for p in part)])
            held = [tuple(p[first:] for p in part)]
        else:
            held.append(part)
    if held:
        yield from emit(held)


def signatures(records: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(id, cls, labels, sketch) of every record with at least one shingle; checkpointed."""
    rows = records.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return cut_lineage(map_texts(rows, "text", lambda b: _signatures(b, shingle), "id string, cls long, labels binary, sketch binary"))


def class_pairs(records: DataFrame, key: str, text: str, threshold: float, shingle: int, sigs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(x, y, similarity): verified pairs of classes, x < y."""
    sigs = signatures(records, key, text, shingle) if sigs is None else sigs
    classes = sigs.groupBy("cls").agg(F.min("id").alias("rep"), F.min(F.struct("labels", "sketch")).alias("s"))
    width = 2 * BASE
    label = F.expr(f"substring(s.labels, tree * {width} + 1, {width})")
    trees = classes.select("cls", F.col("s.sketch").alias("sketch"), "s", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("tree", label.alias("label"), "cls", "sketch")
    # A large run is dealt out in blocks, each compared with itself and every other in a cell of its own.
    # Large runs are at most TREES * classes / BLOCK rows.
    large = trees.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("tree", "label", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = trees.join(F.broadcast(large), ["tree", "label"], "left").withColumn("own", own).withColumn("other", other)
    cell = F.xxhash64("tree", "label", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own").isNull() | (F.col("own") == F.col("other")), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    cells = dealt.select(cell.alias("cell"), side.cast("int").alias("side"), "label", "cls", "sketch")
    low = max(0.0, threshold - SLACK)
    least = int(np.floor((low + (1 - low) / (1 << BITS)) * SKETCH))  # unequal symbols share their bits by chance
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "side", "label", "cls")
    cand = cut_lineage(ordered.mapInArrow(lambda it: _candidates(it, least), "x long, y long").distinct())
    # Whole shingle sets of the classes that occur in a candidate, from their representatives.
    involved = cand.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    reps = involved.join(classes.select("cls", "rep"), "cls")
    texts = records.select(F.col(key).cast("string").alias("rep"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def sets(batch: pa.RecordBatch) -> pa.Table:
        x, r, n = _sets(batch.column("text"), shingle)
        off = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
        low = np.sort((x & np.uint64(0xFFFFFFFF)).astype(np.int64) | (r << 32)) & 0xFFFFFFFF
        return pa.table({"cls": batch.column("cls"), "items": pa.ListArray.from_arrays(pa.array(off), pa.array(low.astype(np.uint32).view(np.int32)))})

    full = map_texts(texts.join(reps, "rep").select("cls", "text"), "text", sets, "cls long, items array<int>").dropDuplicates(["cls"])
    full = cut_lineage(full)
    a = cand.join(full.select(F.col("cls").alias("x"), F.col("items").alias("ix")), "x")
    b = a.join(full.select(F.col("cls").alias("y"), F.col("items").alias("iy")), "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lx, ly = batch.column("ix"), batch.column("iy")
            row = np.arange(batch.num_rows, dtype=np.uint64) << np.uint64(32)
            one = lambda col: np.repeat(row, np.asarray(col.value_lengths())) | col.flatten().to_numpy().view(np.uint32).astype(np.uint64)
            both = np.sort(np.concatenate([one(lx), one(ly)]))
            shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows)
            total = np.asarray(lx.value_lengths()) + np.asarray(ly.value_lengths()) - shared
            sim = shared / np.maximum(total, 1)
            ok = pa.array(sim >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(ok), batch.column("y").filter(ok), pa.array(sim).filter(ok)], names=["x", "y", "similarity"])

    return b.select("x", "y", "ix", "iy").mapInArrow(measure, "x long, y long, similarity double")


def similar_pairs(records: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5, expand: int = EXPAND) -> DataFrame:
    """(a, b) record ids, a < b, of every pair at or above the threshold, equal texts included."""
    sigs = signatures(records, key, text, shingle)
    pairs = cut_lineage(class_pairs(records, key, text, threshold, shingle, sigs))
    members = sigs.select("cls", "id").distinct()
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    # Members that stand for their class in pairs: all of a small class, else the representative.
    voices = members.join(sizes.where(F.col("n") <= expand).select("cls"), "cls").unionByName(sizes.where(F.col("n") > expand).select("cls", F.col("rep").alias("id")))
    va, vb = voices.select(F.col("cls").alias("x"), F.col("id").alias("ia")), voices.select(F.col("cls").alias("y"), F.col("id").alias("ib"))
    across = pairs.join(va, "x").join(vb, "y").select("ia", "ib")
    small = members.join(sizes.where((F.col("n") > 1) & (F.col("n") <= expand)).select("cls"), "cls")
    inside = small.select("cls", F.col("id").alias("ia")).join(small.select("cls", F.col("id").alias("ib")), "cls").where("ia < ib").select("ia", "ib")
    star = members.join(sizes.where(F.col("n") > expand).select("cls", "rep"), "cls").where("id <> rep").select(F.col("rep").alias("ia"), F.col("id").alias("ib"))
    every = across.unionByName(inside).unionByName(star)
    return every.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def similar_groups(records: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per record that is alike another: (id, class_id, group_id, links); class_id is the
    smallest id of equal texts, group_id the smallest of the connected group, links the number of
    classes at or above the threshold plus the copies in its own class."""
    sigs = signatures(records, key, text, shingle)
    pairs = cut_lineage(class_pairs(records, key, text, threshold, shingle, sigs))
    members = sigs.select("cls", "id").distinct()
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("class_id"))
    ends = pairs.select(F.explode(F.array("x", "y")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    comp = connected_components(pairs).select(F.col("node").alias("cls"), "component")
    info = sizes.join(ends, "cls", "left").join(comp, "cls", "left").where((F.col("n") > 1) | F.col("degree").isNotNull()).withColumn("component", F.coalesce("component", "cls"))
    named = info.join(info.groupBy("component").agg(F.min("class_id").alias("group_id")), "component")
    return members.join(named, "cls").select("id", "class_id", "group_id", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("links"))
