"""Problem 2: the most similar vectors of every vector (shifted space-filling curves).

Vectors are normalised, put into 16-bit fixed point and projected; each of several curves takes
other random directions and another shift and gives a Hilbert key.  The rows are range-partitioned
by (curve, collection, key), so a collection that holds a third of all rows is spread over many
tasks.  A task takes its rows in stretches of bounded size and orders each stretch along further
curves: neighbouring key windows of every order are compared by matrix products.  The k best of
each curve are merged and ranked again by cosine.  A curve over all rows costs a shuffle, an order
within a stretch costs none.  The work is linear in the number of vectors; a stretch of at most
four blocks is compared exactly.

Defined results: a vector is usable if it is as long as its collection's dimension, holds no null
or NaN and isn't zero; of repeated rows of a chunk the latest counts (of equal times, the larger
vector in Spark's order); equal cosines are ordered by row key; a collection with fewer than k + 1
vectors gives what there is.  Rows are keyed by a 64-bit hash of (collection, chunk) between the
stages.  Cosines carry the fixed point's error, about 3e-6.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Curves that order all rows, orders within a stretch of each, rows of a block, projected dimensions and bits of each in a Hilbert key.
CURVES, ORDERS, BLOCK, PROJECTED, BITS = 3, 5, 512, 12, 4
#: Numbers (rows times dimension) of a stretch: what a task holds at a time, 8 MB.
STRETCH = 1 << 21
#: Stands for no neighbour; below every cosine.
NONE = np.float32(-4)
#: Collections whose table is broadcast (48 in the data); beyond, the join shuffles.
BROADCAST_BASES = 50_000
_ONE = 32767.0


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (n, dims), each below 2**bits, as int64 (dims*bits <= 62).

    Works on all rows at once: the usual exchange-and-invert passes from the highest bit down turn
    axes into the transposed index, whose bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@functools.lru_cache(maxsize=256)
def _directions(dim: int, curve: int, projected: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([7, dim, curve])
    m = min(projected, dim)
    a, _ = np.linalg.qr(rng.standard_normal((dim, m)))
    return a.astype(np.float32) * np.float32(np.sqrt(dim)), rng.random(m).astype(np.float32)


def curve_keys(unit: np.ndarray, curves: int, projected: int = PROJECTED, bits: int = BITS, first: int = 0) -> np.ndarray:
    """(n, curves) Hilbert keys: coordinates within 4 standard deviations, shifted by up to one unit cube."""
    out = np.empty((len(unit), curves), dtype=np.int64)
    for c in range(curves):
        a, shift = _directions(unit.shape[1], first + c, projected)
        u = np.clip((unit @ a) / 8.0 + 0.5, 0.0, 1.0 - 1e-6) + shift
        out[:, c] = hilbert_keys((u * (1 << (bits - 1))).astype(np.int64), bits)
    return out


def _encode(batches: Iterator[pa.RecordBatch], curves: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        size = np.asarray(lists.value_lengths())
        start = np.concatenate(([0], np.cumsum(size)))
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            v = flat[start[at][:, None] + np.arange(dim)].astype(np.float64)
            norm = np.sqrt((v**2).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            at, v = at[ok], v[ok] / norm[ok, None]
            if not len(at):
                continue
            top = np.abs(v).max(axis=1).astype("<f4")  # the row's own scale stands in front
            fixed = np.hstack([top.view("<i2").reshape(-1, 2), np.round(v / top[:, None] * _ONE).clip(-_ONE, _ONE).astype("<i2")])
            keys = curve_keys(v.astype(np.float32), curves)
            raw = pa.py_buffer(fixed.tobytes())
            vec = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1, dtype=np.int32) * (int(dim) * 2 + 4)).tobytes()), raw])
            key = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("kb_id").take(take), batch.column("chunk_id").take(take), batch.column("seen").take(take), vec, key], names=["kb_id", "chunk_id", "seen", "vec", "keys"])


def usable_vectors(vectors: DataFrame, bases: DataFrame, curves: int = CURVES) -> DataFrame:
    """(kb, id, kb_id, chunk_id, vec, keys), one row per usable vector."""
    dims = bases.select(F.col("id").alias("kb_id"), F.col("embedding_dimension").alias("dim")).where(F.col("dim") > 0).dropDuplicates(["kb_id"])
    if bases.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES:
        dims = F.broadcast(dims)
    v = vectors.select("kb_id", "chunk_id", F.coalesce(F.unix_micros(F.col("embedded_at").cast("timestamp")), F.lit(0)).alias("seen"), "embedding").where(F.col("chunk_id").isNotNull())
    fit = v.join(dims, "kb_id").where((F.size("embedding") == F.col("dim")) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).drop("dim")
    coded = fit.mapInArrow(lambda it: _encode(it, curves), "kb_id string, chunk_id string, seen long, vec binary, keys array<long>")
    latest = coded.groupBy("kb_id", "chunk_id").agg(F.max(F.struct("seen", "vec", "keys")).alias("m"))
    return latest.select(F.xxhash64("kb_id").alias("kb"), F.xxhash64("kb_id", "chunk_id").alias("id"), "kb_id", "chunk_id", "m.vec", "m.keys")


def _merge(value: np.ndarray, who: np.ndarray, row: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
    """Put the candidates (row, v, w) into the k best of their rows, in place; a neighbour counts once."""
    k = value.shape[1]
    rows, at = np.unique(row, return_inverse=True)
    r = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
    v, w = np.concatenate([value[rows].ravel(), v]), np.concatenate([who[rows].ravel(), w])
    order = np.lexsort((w, -v, r))
    r, v, w = r[order], v[order], w[order]
    twice = np.lexsort((np.arange(len(r)), w, r))
    keep = np.ones(len(r), dtype=bool)
    keep[twice[1:]] = (r[twice][1:] != r[twice][:-1]) | (w[twice][1:] != w[twice][:-1])
    keep |= v <= NONE
    r, v, w = r[keep], v[keep], w[keep]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    first = nth < k
    value[rows[r[first]], nth[first]] = v[first]
    who[rows[r[first]], nth[first]] = w[first]


def _near(ids: np.ndarray, vecs: np.ndarray, k: int, block: int, curve: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, ids) of the k nearest found of every row of a stretch of one curve, best first.

    A stretch of at most four blocks is compared whole.  A longer one is ordered anew along ``orders``
    curves, the first of which is the order it came in; the blocks of each order are compared with
    themselves and the blocks beside them."""
    n = len(ids)
    value, who = np.full((n, k), NONE, dtype=np.float32), np.zeros((n, k), dtype=np.int64)
    whole = n <= 4 * block
    for o in range(1 if whole else orders):
        order = np.arange(n) if o == 0 else np.argsort(curve_keys(vecs, 1, first=(curve + 1) * 1000 + o)[:, 0], kind="stable")
        x, name = vecs[order], ids[order]
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            a, b = (0, n) if whole else (max(0, lo - block), min(n, hi + block))
            sim = x[lo:hi] @ x[a:b].T
            sim[name[lo:hi, None] == name[None, a:b]] = NONE
            at = order[lo:hi]
            floor = value[at, -1]
            if o == 0 and b - a > k:  # the first look at a row: all but the k best fall away at once
                floor = np.maximum(floor, np.partition(sim, b - a - k, axis=1)[:, b - a - k] - np.float32(1e-7))
            i, j = np.nonzero(sim > floor[:, None])
            if len(i):
                _merge(value, who, at[i], sim[i, j], name[a + j])
    return value, who


def _stretches(batches: Iterator[pa.RecordBatch], k: int, block: int, orders: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in stretches of one curve and collection of bounded size, each searched by itself.

    A stretch begins with the last block of the one before, so that no window is lost between them."""
    pend_key, ids, vecs, fresh = None, [], [], 0

    def flush(tail: bool) -> Iterator[pa.RecordBatch]:
        nonlocal ids, vecs, fresh
        if fresh:
            i, v = np.concatenate(ids), np.concatenate(vecs)
            value, who = _near(i, v, k, block, int(pend_key[0]), orders)
            ok = value > NONE
            off = np.concatenate(([0], np.cumsum(ok.sum(axis=1)))).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(value[ok]), pa.array(who[ok])], names=["c", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.ListArray.from_arrays(pa.array(off), entries)], names=["id", "near"])
            ids, vecs = ([i[-block:]], [v[-block:]]) if tail else ([], [])
        fresh = 0

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column("curve").to_numpy().astype(np.int64), batch.column("kb").to_numpy()], axis=1)
        edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(group)]):
            key = tuple(group[lo])
            if key != pend_key:
                yield from flush(False)
                pend_key, ids, vecs = key, [], []
            part = batch.slice(lo, hi - lo)
            raw = np.frombuffer(b"".join(part.column("vec").to_pylist()), dtype="<i2").reshape(hi - lo, -1)
            scale = np.ascontiguousarray(raw[:, :2]).view("<f4")
            ids.append(part.column("id").to_numpy())
            vecs.append(raw[:, 2:] * (scale / np.float32(_ONE)))
            fresh += hi - lo
            if fresh >= max(8 * block, STRETCH // (raw.shape[1] - 2)):
                yield from flush(True)
    yield from flush(False)


def nearest(vectors: DataFrame, bases: DataFrame, k: int = 5, curves: int = CURVES, block: int = BLOCK, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(id, near: the k nearest ids, best first) and the id table (id, kb_id, chunk_id)."""
    rows = usable_vectors(vectors, bases, curves)
    names = rows.select("id", "kb_id", "chunk_id")
    keyed = rows.select("kb", "id", "vec", F.posexplode("keys").alias("curve", "key"))
    placed = keyed.repartitionByRange("curve", "kb", "key").sortWithinPartitions("curve", "kb", "key", "id")
    found = placed.mapInArrow(lambda it: _stretches(it, k, block, orders), "id long, near array<struct<c:float,n:long>>")
    merged = found.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("all"))  # k entries a curve, k more where stretches overlap
    best = F.slice(F.array_distinct(F.transform(F.sort_array("all", asc=False), lambda x: x["n"])), 1, k)
    return merged.select("id", best.alias("near")), names


def nearest_pairs(vectors: DataFrame, bases: DataFrame, k: int = 5, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b), the smaller id first: one is among the k nearest of the other."""
    near, names = nearest(vectors, bases, k, **options)
    e = near.select("id", F.explode("near").alias("n")).select(F.least("id", "n").alias("x"), F.greatest("id", "n").alias("y")).distinct()
    a = e.join(names.select(F.col("id").alias("x"), F.col("chunk_id").alias("ca")), "x")
    b = a.join(names.select(F.col("id").alias("y"), F.col("chunk_id").alias("cb")), "y")
    return b.select(F.least("ca", "cb").alias("chunk_id_a"), F.greatest("ca", "cb").alias("chunk_id_b"))
