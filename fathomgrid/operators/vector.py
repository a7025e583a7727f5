"""Exact vector search: dot products in double, top-k per query and base, and offline embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.functions import text as tx
from fathomgrid.operators.lexical import top_k

DIMENSION = 64
#: Numbers (queries times dimension) of a query side that is broadcast; a larger one goes in blocks.
BROADCAST_NUMBERS = 4 << 20
#: An embedding provider: a Column function from text and dimension to an array of unit length.
Embedder = Callable[[Column, int], Column]


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null for vectors of different length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector divided by its length, null for zero vectors; the length is computed once per row."""
    n = norm(v)
    return F.when(n > 0, F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(n, F.size(v)).alias("n")), lambda p: p["x"].cast("double") / p["n"]))


def hashed_vector(terms: Column, dim: Column | int) -> Column:
    """A deterministic offline embedding of distinct terms: each adds 1 or -1 to one of ``dim`` places,
    both taken from its MD5.  Built of JVM functions only; it claims no parity with a model."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    codes = F.transform(terms, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int"))
    sign = lambda c: F.when(F.shiftright(c, 16) % 2 == 0, 1.0).otherwise(-1.0)
    places = F.transform(codes, lambda c: F.struct((c % dim).alias("k"), sign(c).alias("s")))
    return _once(places, lambda v: F.transform(F.sequence(F.lit(0), dim - 1), lambda b: F.aggregate(F.filter(v, lambda p: p["k"] == b), F.lit(0.0), lambda acc, p: acc + p["s"])))


def hashed_embedding(text: Column, dim: int = DIMENSION) -> Column:
    """Unit vector of a text's distinct index terms (zeros if it has none), as array<double>."""
    raw = hashed_vector(F.array_distinct(tx.fts_terms(F.coalesce(text, F.lit("")))), dim)
    return _once(raw, lambda v: F.coalesce(unit(v), v)).cast("array<double>")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 50, key: str = "chunk_id", group: str = "kb_id", blocks: int | None = None) -> DataFrame:
    """(query_id, group, key, score, rank): every query vector against all vectors of its length.

    The stated set of queries is measured first: up to BROADCAST_NUMBERS numbers it goes to every
    task and the vectors are read once, without a shuffle; a larger one is dealt out in ``blocks``,
    each of which meets all vectors in tasks spread by a salt.  The k best per query and group are
    kept before the shuffle.  Vectors that are null or hold a null or NaN have no score."""
    q = queries.select("query_id", F.col("embedding").alias("q")).where(F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull() | F.isnan(x)))
    v = vectors.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col("embedding").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    numbers = q.agg(F.sum(F.size("q"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        scored = _products(v, q, k)
    else:
        blocks = blocks or -(-numbers // BROADCAST_NUMBERS)
        dealt = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        salts = 64
        left = v.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = left.join(dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["block", "salt"]).where(F.size("v") == F.size("q"))
        scored = pairs.select("query_id", "g", "key", dot(F.col("v"), F.col("q")).alias("score"))
    named = scored.select("query_id", F.col("g").alias(group), F.col("key").alias(key), "score", F.round("score", 9).alias("_s"))
    return top_k(named, k, ["query_id", group], "_s", key).drop("_s")


def _products(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(query_id, g, key, score) by matrix products: the queries (bounded by the caller) are broadcast as
    matrices by dimension, each batch of vectors is multiplied at once, and a query's rows below the
    k best of a group in the batch fall away at the source."""
    spark = v.sparkSession
    kinds = dict(q.dtypes) | dict(v.dtypes)
    by_dim: dict[int, tuple[list, list]] = {}
    for r in q.collect():
        ids, rows = by_dim.setdefault(len(r["q"]), ([], []))
        ids.append(r["query_id"])
        rows.append(r["q"])
    shared = spark.sparkContext.broadcast({d: (ids, np.array(rows, dtype=np.float64)) for d, (ids, rows) in by_dim.items()})
    schema = f"query_id {kinds['query_id']}, g {kinds['g']}, key {kinds['key']}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = np.asarray(lists.value_lengths())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.concatenate(([0], np.cumsum(size)))
            groups = pc.dictionary_encode(batch.column("g"), null_encoding="encode").indices.to_numpy()
            for d in np.unique(size):
                if int(d) not in shared.value:
                    continue
                names, matrix = shared.value[int(d)]
                at = np.flatnonzero(size == d)
                order = at[np.argsort(groups[at], kind="stable")]
                sims = flat[start[order][:, None] + np.arange(d)] @ matrix.T
                edges = np.flatnonzero(np.diff(groups[order])) + 1
                for lo, hi in zip([0, *edges], [*edges, len(order)]):
                    s = np.round(sims[lo:hi], 9)
                    keep = s >= np.partition(s, hi - lo - k, axis=0)[hi - lo - k] if hi - lo > k else np.ones(s.shape, dtype=bool)
                    i, j = np.nonzero(keep)
                    take = pa.array(order[lo + i])
                    yield pa.RecordBatch.from_arrays([pa.array(names, type=out[0].type).take(pa.array(j)), batch.column("g").take(take), batch.column("key").take(take), pa.array(sims[lo + i, j])], schema=out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    return v.select("g", "key", "v").mapInArrow(run, schema)
