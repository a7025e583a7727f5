"""BM25 over positional postings: statistics, phrases, AND with OR fallback, top-k per query and base.

A batch of queries is answered in one pass over the texts: the queries' distinct terms go to the
scan as a set, each text gives its length and how often each phrase of the batch stands in it, and
everything after works on these.  A chunk's scores need nothing but its own phrases, so pairs of
queries and chunks are made where the chunk is and never shuffled; of a top-k only the k best of a
task's part of a base leave it.  Beyond ``TERMS`` terms or ``ASKED`` phrases, postings are joined.
``postings`` written to a store at indexing time (``stored_postings``) take the scan's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.functions import text as tx
from fathomgrid.operators.best import Best, expand, sums
from fathomgrid.session import cut_lineage, spread

K1, B = 1.2, 0.75
#: Distinct query terms that a scan takes as a set.
TERMS = 20_000
#: Phrases of all queries, with their terms, that the driver reads and every task gets.
ASKED = 400_000
#: Pairs of chunks and queries that a task looks at together, and chunks that it reads together.
CELLS, ROWS = 2 << 20, 2048
#: Chunks of a part, when bases are cut into parts.
PART = 20_000


def postings(chunks: DataFrame, column: str = "content_tokenized") -> DataFrame:
    """(kb_id, chunk_id, dl, pos, term): one row per term occurrence, with the chunk's length."""
    d = chunks.select("kb_id", F.col("id").alias("chunk_id"), tx.fts_terms(F.col(column)).alias("w"))
    return d.select("kb_id", "chunk_id", F.size("w").alias("dl"), F.posexplode("w").alias("pos", "term"))


def stored_postings(chunks: DataFrame, column: str = "content_tokenized") -> DataFrame:
    """(kb_id, chunk_id, dl, term, places): what an index keeps, one row per chunk and term; a chunk
    without terms keeps a row with none, so that lengths are complete."""
    w = tx.fts_terms(F.coalesce(F.col(column), F.lit("")))
    d = chunks.select("kb_id", F.col("id").alias("chunk_id"), w.alias("w"))
    sorted_ = F.array_sort(F.transform("w", lambda t, i: F.named_struct(F.lit("t"), t, F.lit("i"), i)))
    places = lambda t: F.transform(F.filter("s", lambda x: x["t"] == t), lambda x: x["i"])
    e = d.select("kb_id", "chunk_id", F.size("w").alias("dl"), sorted_.alias("s"), F.explode_outer(F.array_distinct("w")).alias("term"))
    return e.select("kb_id", "chunk_id", "dl", "term", places(F.col("term")).alias("places"))


def document_lengths(chunks: DataFrame, column: str = "content_tokenized") -> DataFrame:
    """(kb_id, chunk_id, dl), without exploding."""
    return chunks.select("kb_id", F.col("id").alias("chunk_id"), F.size(tx.fts_terms(F.coalesce(F.col(column), F.lit("")))).alias("dl"))


def term_statistics(chunks: DataFrame, column: str = "content_tokenized") -> DataFrame:
    """(term, df, tf): documents and occurrences of each term, over all bases.

    Each text's terms are sorted, so the first of equal ones counts the document: one aggregate by
    term with map-side combine, no shuffle of (term, document) pairs."""
    d = spread(chunks.select(column)).select(F.array_sort(tx.fts_terms(F.col(column))).alias("w"))
    marked = F.transform("w", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("w", i - 1) != t)).cast("int").alias("first")))
    return d.select(F.explode(marked).alias("m")).groupBy("m.term").agg(F.sum("m.first").alias("df"), F.count(F.lit(1)).alias("tf"))


def query_phrases(queries: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """(query_id, phrase, off, term, len): the tokens of every query term as index terms in order."""
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(tx.search_tokens(F.col(text))).alias("phrase"))
    parts = q.withColumn("parts", tx.fts_terms(F.col("phrase"))).where(F.size("parts") > 0)
    return parts.select("query_id", "phrase", F.size("parts").alias("len"), F.posexplode("parts").alias("off", "term"))


@dataclass(frozen=True)
class Batch:
    """The queries of a search as the tasks get them: ids, how many phrases each has, the index terms with
    the phrases they stand in (term, phrase, off: by term), terms of each phrase, and who asks for it."""

    ids: pa.Array
    total: np.ndarray
    terms: pa.Array
    need: tuple[np.ndarray, np.ndarray, np.ndarray]  # starts by term, phrase, off
    lengths: np.ndarray
    asked: tuple[np.ndarray, np.ndarray]  # starts by phrase, query

    def slice(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """``asked`` of the queries from lo to hi, counted from lo."""
        starts, q = self.asked
        inside = (q >= lo) & (q < hi)
        return np.concatenate(([0], np.cumsum(inside)))[starts], q[inside] - lo

    def pick(self, ids: pa.Array) -> Batch:
        """The same phrases, asked by the queries ``ids`` only, in their order."""
        starts, q = self.asked
        place = np.full(len(self.ids), -1, dtype=np.int64)
        at = pc.index_in(ids, value_set=self.ids)
        known = np.flatnonzero(np.asarray(at.is_valid()))
        place[np.asarray(at.drop_null())] = known
        total = np.zeros(len(ids), dtype=np.int64)
        total[known] = self.total[np.asarray(at.drop_null())]
        inside = place[q] >= 0
        return Batch(ids, total, self.terms, self.need, self.lengths, (np.concatenate(([0], np.cumsum(inside)))[starts], place[q[inside]]))


def starts_of(keys: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)[:n]))).astype(np.int64)


def batch_of(phrases: DataFrame) -> Batch | None:
    """None for a batch beyond the limits."""
    t = phrases.select("query_id", "phrase", "off", "term", "len").distinct().limit(ASKED + 1).toArrow()
    if t.num_rows > ASKED:
        return None
    code = lambda c: pc.dictionary_encode(t.column(c).combine_chunks(), null_encoding="encode")
    ids, names, terms = code("query_id"), code("phrase"), code("term")
    if len(terms.dictionary) > TERMS:
        return None
    q, p, w = (np.asarray(x.indices, dtype=np.int64) for x in (ids, names, terms))
    off, n = t.column("off").to_numpy().astype(np.int64), len(names.dictionary)
    lengths = np.zeros(n, dtype=np.int64)
    lengths[p] = t.column("len").to_numpy()
    need = np.unique(np.stack((w, p, off)), axis=1)
    pairs = np.unique(np.stack((p, q)), axis=1)
    return Batch(
        ids.dictionary, np.bincount(pairs[1], minlength=len(ids.dictionary)), terms.dictionary, (starts_of(need[0], len(terms.dictionary)), need[1], need[2]), lengths, (starts_of(pairs[0], n), pairs[1])
    )


def _hits(chunks: DataFrame, terms: list[str], column: str, stored: DataFrame | None, more: dict[str, Column] | None = None) -> DataFrame:
    """(kb_id, chunk_id, dl, hits): every text's length and the places of the wanted terms, and the columns
    ``more`` of its chunk (without ``stored``)."""
    if stored is not None:
        place = F.transform("places", lambda i: F.struct(i.alias("pos"), F.col("term").alias("term")))
        wanted = F.when(F.col("term").isin(terms), place)
        return stored.groupBy("kb_id", "chunk_id", "dl").agg(F.flatten(F.collect_list(wanted)).alias("hits"))
    d = spread(chunks.select("kb_id", "id", column) if not more else chunks).select("kb_id", F.col("id").alias("chunk_id"), tx.fts_terms(F.coalesce(F.col(column), F.lit(""))).alias("w"), *[c.alias(n) for n, c in (more or {}).items()])
    placed = F.transform("w", lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    return d.select("kb_id", "chunk_id", F.size("w").alias("dl"), F.filter(placed, lambda x: x["term"].isin(terms)).alias("hits"), *(more or {}))


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """List array of n rows; ``rows`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(starts_of(rows, n), type=pa.int32()), pa.array(values, type=kind))


def _found(hits: DataFrame, batch: Batch) -> DataFrame:
    """(kb_id, chunk_id, dl, p, tf, further columns): the phrases of the batch in each chunk and how often they
    stand there.  A phrase of several terms stands where all of them have the same origin (position minus offset)."""
    shared = hits.sparkSession.sparkContext.broadcast(batch)
    more = [c for c in hits.columns if c not in ("kb_id", "chunk_id", "dl", "hits")]
    schema = ", ".join(["kb_id string, chunk_id string, dl int, p array<int>, tf array<int>", *(f"{c} {t}" for c, t in hits.dtypes if c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = shared.value
        starts, phrase, off = b.need
        far, single = int(off.max(initial=0)), bool((b.lengths == 1).all())
        for batch in batches:
            h = batch.column("hits")
            n, flat = len(h), h.flatten()
            row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(h), 0))
            term = pc.index_in(pc.struct_field(flat, [1]), value_set=b.terms)
            row, term, pos = row[(ok := np.asarray(term.is_valid()))], np.asarray(term.drop_null(), dtype=np.int64), np.asarray(pc.struct_field(flat, [0]), dtype=np.int64)[ok]
            of, at = expand(starts, term)
            key = row[of] * len(b.lengths) + phrase[at]
            if not single:
                wide = int(pos.max(initial=0)) + far + 1
                key, got = np.unique(key * wide + pos[of] - off[at] + far, return_counts=True)
                key = (key // wide)
                key = key[got == b.lengths[key % len(b.lengths)]]
            key, tf = np.unique(key, return_counts=True)
            own = key // max(1, len(b.lengths))
            yield pa.RecordBatch.from_arrays([batch.column("kb_id"), batch.column("chunk_id"), batch.column("dl"), lists(key % max(1, len(b.lengths)), own, n, pa.int32()), lists(tf, own, n, pa.int32()), *(batch.column(c) for c in more)], schema=out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    return hits.select(F.col("kb_id").cast("string"), F.col("chunk_id").cast("string"), F.col("dl").cast("int"), "hits", *more).mapInArrow(run, schema)


@dataclass(frozen=True)
class Weighed:
    """The chunks that hold a phrase of the batch, and what weighs them."""

    found: DataFrame
    batch: Batch
    idf: np.ndarray
    avgdl: float
    n_docs: int

    def weights(self) -> Weights:
        return Weights(self.batch, self.idf, self.avgdl)


@dataclass(frozen=True)
class Weights:
    batch: Batch
    idf: np.ndarray
    avgdl: float

    def entries(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, weight) of the phrases in chunks of ``Weighed.found``."""
        row = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(rows.column("p")), 0))
        p, tf = (np.asarray(rows.column(c).flatten()) for c in ("p", "tf"))
        dl = np.asarray(pc.fill_null(rows.column("dl"), 0))[row]
        return row, p, self.idf[p] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))


def weighed(chunks: DataFrame, phrases: DataFrame, column: str = "content_tokenized", stored: DataFrame | None = None, more: dict[str, Column] | None = None) -> Weighed | None:
    """None for a batch beyond the limits.  N, df and average length are index-wide, so scores of
    different bases compare.  The texts are tokenised once."""
    batch = batch_of(phrases)
    if batch is None:
        return None
    found = cut_lineage(_found(_hits(chunks, batch.terms.to_pylist(), column, stored, more), batch))
    n_docs, avgdl = found.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = np.zeros(len(batch.lengths))
    for r in found.select(F.explode("p").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("df")).collect():  # at most TERMS numbers, or as many as phrases
        df[r["p"]] = r["df"]
    idf = np.log((n_docs - df + 0.5) / (df + 0.5))
    return Weighed(found, batch, np.where(idf <= 0, 1e-6, idf), float(avgdl or 1.0), n_docs)


def _all_scores(w: Weighed, kind: str, digits: int | None) -> DataFrame:
    """Scores of all pairs, made where the chunk is: a chunk's list is exploded there, nothing is shuffled."""
    shared = w.found.sparkSession.sparkContext.broadcast(w.weights())
    schema = f"kb_id string, chunk_id string, s array<struct<query_id:{kind},score:double,matched:bigint,terms:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = shared.value.batch
        queries = max(1, len(b.ids))
        step = max(1, CELLS // queries)
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                rows = whole.slice(lo, step)
                row, p, weight = shared.value.entries(rows)
                of, at = expand(b.asked[0], p)
                key, score, matched = sums(row[of] * queries + b.asked[1][at], weight[of], rows.num_rows * queries)
                q = key % queries
                parts = [b.ids.take(pa.array(q)), pa.array(score if digits is None else np.round(score, digits)), pa.array(matched, type=pa.int64()), pa.array(b.total[q], type=pa.int64())]
                each = pa.StructArray.from_arrays(parts, fields=list(out.field("s").type.value_type))
                starts = pa.array(starts_of(key // queries, rows.num_rows), type=pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column("kb_id"), rows.column("chunk_id"), pa.ListArray.from_arrays(starts, each).cast(out.field("s").type)], schema=out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    d = w.found.where(F.size("p") > 0).mapInArrow(run, schema).select("kb_id", "chunk_id", F.explode("s").alias("s"))
    return d.select("s.query_id", "kb_id", "chunk_id", "s.score", "s.matched", "s.terms")


def phrase_frequencies(posts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, kb_id, chunk_id, dl, tf): how often each distinct phrase stands in a chunk, by joins.

    Postings are joined with the distinct phrase terms only; a phrase of several terms stands where
    all of them have the same origin (position minus offset)."""
    need = phrases.select("phrase", "off", "term", "len").distinct()
    hit = posts.join(need, "term").groupBy("phrase", "len", "kb_id", "chunk_id", "dl", (F.col("pos") - F.col("off")).alias("origin")).agg(F.count(F.lit(1)).alias("got"))
    return hit.where("got = len").groupBy("phrase", "kb_id", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _joined_scores(chunks: DataFrame, phrases: DataFrame, column: str, stored: DataFrame | None) -> DataFrame:
    """The scores by joins, for batches whose phrases are too many for a task."""
    if stored is not None:
        posts, lengths = stored.select("kb_id", "chunk_id", "dl", "term", F.explode("places").alias("pos")), stored.select("kb_id", "chunk_id", "dl").distinct()
    else:
        posts, lengths = postings(chunks, column), document_lengths(chunks, column)
    n_docs, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()  # two numbers
    freq = phrase_frequencies(posts, phrases)
    df = freq.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    scored = freq.join(df, "phrase")
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    per = scored.select("phrase", "kb_id", "chunk_id", weight.alias("w"))
    asked = phrases.select("query_id", "phrase").distinct()
    total = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    return per.join(asked, "phrase").groupBy("query_id", "kb_id", "chunk_id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("matched")).join(total, "query_id")


def bm25_scores(chunks: DataFrame, queries: DataFrame, column: str = "content_tokenized", stored: DataFrame | None = None, phrases: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, matched, terms) of every chunk that holds a query phrase; scores
    rounded to ``digits``, if given."""
    phrases = query_phrases(queries) if phrases is None else phrases
    w = weighed(chunks, phrases, column, stored)
    if w is not None:
        return _all_scores(w, dict(phrases.dtypes)["query_id"], digits)
    s = _joined_scores(chunks, phrases, column, stored)
    return s if digits is None else s.withColumn("score", F.round("score", digits))


def bm25_top(
    chunks: DataFrame, queries: DataFrame, k: int, by: list[str], match: str = "any", column: str = "content_tokenized", stored: DataFrame | None = None, phrases: DataFrame | None = None, bases: DataFrame | None = None,
) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the k best chunks by query and base or by query (``by``).

    ``match``: any phrase, all phrases (``all``), or all and any where none of the base has all
    (``relaxed``).  ``bases``: only these, in which case statistics stay index-wide."""
    phrases = query_phrases(queries) if phrases is None else phrases
    w = weighed(chunks, phrases, column, stored)
    inside = lambda d: d if bases is None else d.join(bases.select("kb_id"), "kb_id", "left_semi")
    if w is None:
        s = inside(_joined_scores(chunks, phrases, column, stored))
        s = s if match == "any" else strict_or_relaxed(s, match == "relaxed")
        return top_k(s.withColumn("score", F.round("score", 9)), k, by).select("query_id", "kb_id", "chunk_id", "score", "rank")
    found = inside(w.found.where(F.size("p") > 0))
    per_base = "kb_id" in by
    if per_base:
        parts = max(3 * found.sparkSession.sparkContext.defaultParallelism, w.n_docs // PART)
        found = found.repartitionByRange(parts, "kb_id", "chunk_id").sortWithinPartitions("kb_id", "chunk_id")
    else:
        found = found.sortWithinPartitions("chunk_id")
    shared = found.sparkSession.sparkContext.broadcast(w.weights())
    schema = f"query_id {dict(phrases.dtypes)['query_id']}, kb_id string, chunk_id string, score double, strict boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Batch = shared.value.batch
        best, kb = None, None
        for rows in (r.slice(lo, ROWS) for r in batches for lo in range(0, r.num_rows, ROWS)):
            for base, part in runs_of(rows, "kb_id") if per_base else [(None, rows)]:
                if best is None or base != kb:
                    if best is not None:
                        yield from emit(best, b)
                    best, kb = Best(k, len(b.ids), ["kb_id", "chunk_id"]), base
                score_rows(shared.value, part, best, match, CELLS)
        if best is not None:
            yield from emit(best, b)

    def emit(best: Best, b: Batch) -> Iterator[pa.RecordBatch]:
        for q, score, strict, kbs, ids in best.rows():
            yield pa.RecordBatch.from_arrays([b.ids.take(pa.array(q)), kbs, ids, pa.array(score), pa.array(strict)], schema=out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    part = found.mapInArrow(run, schema)
    order = Window.partitionBy(*by).orderBy(F.col("strict").desc(), F.col("score").desc(), "chunk_id")
    top = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if match == "relaxed":
        top = top.withColumn("_m", F.max("strict").over(Window.partitionBy(*by))).where(F.col("strict") == F.col("_m"))
    return top.select("query_id", "kb_id", "chunk_id", "score", "rank")


def runs_of(rows: pa.RecordBatch, column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The stretches of equal values of a sorted batch."""
    code = pc.dictionary_encode(rows.column(column), null_encoding="encode")
    at = np.asarray(code.indices)
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield code.dictionary[int(at[lo])].as_py(), rows.slice(lo, hi - lo)


def score_rows(w: Weights, rows: pa.RecordBatch, best: Best, match: str, cells: int) -> None:
    """Scores of chunks for all queries, in stretches of queries, to the best so far."""
    b, n = w.batch, rows.num_rows
    row, p, weight = w.entries(rows)
    step = max(1, cells // n)
    first = best.add(rows)
    for lo in range(0, len(b.ids), step):
        hi = min(lo + step, len(b.ids))
        starts, asked = b.slice(lo, hi)
        of, at = expand(starts, p)
        key, score, matched = sums(asked[at] * n + row[of], weight[of], (hi - lo) * n)
        full = matched == b.total[lo:hi][key // n]
        if match == "all":
            key, score, full = key[full], score[full], full[full]
        dense = np.full((hi - lo) * n, -np.inf)
        dense[key] = np.round(score, 9)
        strict = None
        if match == "relaxed":
            has = np.zeros(hi - lo, dtype=bool)
            has[key[full] // n] = True
            strict = best.strict[lo:hi] | has
            dense[key[~full & strict[key // n]]] = -np.inf
        best.update(dense.reshape(hi - lo, n), lo, hi, first, strict)


def strict_or_relaxed(scores: DataFrame, relax: bool = True) -> DataFrame:
    """Rows that match all phrases; per query and base with none of those, any match (if ``relax``)."""
    full = F.col("matched") == F.col("terms")
    if not relax:
        return scores.where(full)
    scores = cut_lineage(scores)  # used three times
    strict = scores.where(full).select("query_id", "kb_id").distinct()
    return scores.where(full).unionByName(scores.where(~full).join(strict, ["query_id", "kb_id"], "left_anti"))


def top_k(scores: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each group with their ``rank``; the limit also runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 50, relax: bool = True, column: str = "content_tokenized", stored: DataFrame | None = None) -> DataFrame:
    return bm25_top(chunks, queries, k, ["query_id", "kb_id"], "relaxed" if relax else "all", column, stored)
