"""Search of whole bases in tasks: both legs, their fusion, rank adjustment and gate where a base's rows are.

A task reads the chunks and vectors of its bases in order, keeps the k best of each query on either leg,
and joins, scales, adjusts and gates these at the end of the base; only the best rows of a query and
base leave it.  Candidates (queries times bases times 2 k) are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomgrid.functions import text as tx
from fathomgrid.operators import lexical, ranking, retrieval, vector
from fathomgrid.operators.best import Best, expand
from fathomgrid.session import cut_lineage

#: Cells (chunks times signals) of a table of marks, and distinct signals up to which those of chunks are cut down.
MARKS, SIGNALS = 64 << 20, 20_000
TEXT, PATH, STEM = 1, 2, 4
FLAGS = ["is_source", "is_document", "is_test", "is_localization"]


@dataclass(frozen=True)
class Asked:
    """A slice of the queries: ids, vectors by dimension (query, matrix), signals (starts, number), what is asked for."""

    ids: pa.Array
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    starts: np.ndarray
    signals: np.ndarray
    wants: dict[str, np.ndarray]


@dataclass(frozen=True)
class Way:
    """What a search does with its candidates."""

    mode: str
    k: int
    limit: int
    digits: int
    min_score: float
    injected: int


def features(chunks: DataFrame, wanted: list[str] | None) -> dict[str, Column]:
    """What ranking needs of a chunk, by ``retrieval.chunk_columns``."""
    p = F.coalesce("file_path", F.lit(""))
    kind = tx.file_type_alias(F.col("file_type"))
    cut = lambda c: c if wanted is None else F.filter(c, lambda x: x.isin(wanted))
    signals = lambda c: F.coalesce(cut(tx.signals(tx.search_tokens(c))), F.array().cast("array<string>"))
    known = lambda c: F.coalesce(c, F.lit(False))
    return {
        "text_signals": signals(F.col("content_tokenized")), "path_signals": signals(tx.spaced(p)), "stem_signals": signals(tx.spaced(tx.path_stem(p))),
        "is_source": known(kind.isin(*tx.SOURCE_TYPES)), "is_document": known(kind.isin("markdown", "latex")), "is_test": tx.is_test_path(p), "is_localization": known(tx.is_localization_path(p, kind)), "place": ranking.place_boost(p),
    }


def search(
    mode: str, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, qvecs: DataFrame, bases: DataFrame, k: int, limit: int, digits: int, min_score: float = ranking.MIN_HYBRID, formula: DataFrame | None = None, injected: int = 0,
) -> DataFrame | None:
    """(query_id, kb_id, chunk_id, score, order, reason): the ``limit`` best rows of each query and base by the score
    rounded to ``digits``, for mode hybrid or semantic.  ``formula`` (query_id, chunk_id, formula_score)
    boosts before the gate; the ``injected`` best of its chunks that no leg found come with the reason
    formula and their formula score as ``order``.  None for a batch beyond the limits of ``lexical``."""
    spark = chunks.sparkSession
    words = cut_lineage(queries.select("query_id", F.coalesce(tx.signals(tx.search_tokens(F.col("query_text"))), F.array().cast("array<string>")).alias("signals")))
    vocabulary = words.select(F.explode("signals").alias("s")).distinct().toArrow().column("s").combine_chunks()
    more = features(chunks, vocabulary.to_pylist() if len(vocabulary) <= SIGNALS else None)
    weights = None
    if mode == "semantic":
        empty = F.array().cast("array<int>")
        found = chunks.select(F.col("kb_id").cast("string"), F.col("id").cast("string").alias("chunk_id"), F.lit(0).alias("dl"), empty.alias("p"), empty.alias("tf"), *[c.alias(n) for n, c in more.items()])
    else:
        w = lexical.weighed(chunks, lexical.query_phrases(queries), more=more)
        if w is None:
            return None
        found, weights = w.found, w.weights()
    inside = bases.select("kb_id", "trust", "dim")
    held = vectors.join(F.broadcast(inside), "kb_id", "left_semi")  # as many rows as bases
    v = retrieval.latest_vectors(held).join(F.broadcast(inside), "kb_id").where((F.size("embedding") == F.col("dim")) & (vector.norm(F.col("embedding")) > 0)).select("kb_id", "chunk_id", "embedding")
    rows = found.unionByName(v, allowMissingColumns=True)
    kind = dict(queries.dtypes)["query_id"]
    if formula is not None:
        own = formula.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "formula_score")).alias("formula"))
        rows = rows.unionByName(own.join(chunks.select(F.col("id").alias("chunk_id"), "kb_id"), "chunk_id"), allowMissingColumns=True)
    rows = rows.join(F.broadcast(inside.select("kb_id", "trust")), "kb_id")
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "kb_id").sortWithinPartitions("kb_id", "chunk_id")
    slices = -(-(qvecs.agg(F.sum(F.size("embedding"))).first()[0] or 0) // vector.BROADCAST_NUMBERS) or 1
    rows = rows if slices == 1 else cut_lineage(rows)
    way = Way(mode, k, limit, digits, min_score, injected)
    asks = {n: F.coalesce(tx.asks_for(F.col("signals"), s), F.lit(False)) for n, s in (("guide", tx.GUIDE), ("tests", tx.TESTS), ("localization", tx.LOCALIZATION))}
    words = words.select("query_id", "signals", *[c.alias(n) for n, c in asks.items()])
    out = [_slice(rows, weights, _asked(words, qvecs, vocabulary, i, slices), way, vocabulary, kind) for i in range(slices)]
    return reduce(DataFrame.unionByName, out)


def _asked(words: DataFrame, qvecs: DataFrame, vocabulary: pa.Array, i: int, slices: int) -> Asked:
    here = F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i
    t, e = words.where(here).toArrow(), qvecs.where(here).toArrow()
    ids, said = t.column("query_id").combine_chunks(), t.column("signals").combine_chunks()
    signals = np.asarray(pc.index_in(said.flatten(), value_set=vocabulary), dtype=np.int64)
    place = np.asarray(pc.index_in(e.column("query_id").combine_chunks(), value_set=ids), dtype=np.int64)
    listed = e.column("embedding").combine_chunks()
    size, flat = np.asarray(listed.value_lengths()), np.asarray(listed.flatten(), dtype=np.float64)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    by = {int(d): (place[at], flat[first[at][:, None] + np.arange(d)]) for d in np.unique(size) for at in [np.flatnonzero(size == d)]}
    return Asked(ids, by, np.concatenate(([0], np.cumsum(np.asarray(said.value_lengths())))).astype(np.int64), signals, {n: np.asarray(t.column(n).combine_chunks().to_numpy(zero_copy_only=False), dtype=bool) for n in ("guide", "tests", "localization")})


def _slice(rows: DataFrame, weights: lexical.Weights | None, asked: Asked, way: Way, vocabulary: pa.Array, kind: str) -> DataFrame:
    if weights is not None:
        weights = lexical.Weights(weights.batch.pick(asked.ids), weights.idf, weights.avgdl)
    shared = rows.sparkSession.sparkContext.broadcast((weights, asked, vocabulary))
    schema = f"query_id {kind}, kb_id string, chunk_id string, score double, order double, reason string"
    cells, step = lexical.CELLS, lexical.ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        for part in (r.slice(lo, step) for r in batches for lo in range(0, r.num_rows, step)):
            for name, own in lexical.runs_of(part, "kb_id"):
                if base is None or base.name != name:
                    if base is not None:
                        yield from base.results(out)
                    base = Base(name, *shared.value, way, cells)
                base.read(own)
        if base is not None:
            yield from base.results(out)

    out = to_arrow_schema(T._parse_datatype_string(schema))
    return rows.mapInArrow(run, schema)


class Base:
    """The rows of a base as they come, in order of their chunks."""

    def __init__(self, name: str, weights: lexical.Weights | None, asked: Asked, vocabulary: pa.Array, way: Way, cells: int) -> None:
        self.name, self.weights, self.asked, self.vocabulary, self.way, self.cells = name, weights, asked, vocabulary, way, cells
        self.lexical, self.vector = (Best(way.k, len(asked.ids), ["chunk_id"]) for _ in range(2))
        self.marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # row, signal, mark
        self.flags: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.formula: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, row, score
        self.trust = 1.0

    def read(self, rows: pa.RecordBatch) -> None:
        self.trust = rows.column("trust")[0].as_py()
        n, first = rows.num_rows, self.vector.add(rows)
        if self.weights is not None:
            lexical.score_rows(self.weights, rows, self.lexical, "relaxed", self.cells)
        held = np.flatnonzero(np.asarray(rows.column("embedding").is_valid()))
        if len(held):
            e = rows.column("embedding").take(pa.array(held))
            e = np.asarray(e.flatten(), dtype=np.float64).reshape(len(held), -1)
            e /= np.sqrt((e * e).sum(axis=1))[:, None]
            place, matrix = self.asked.vectors.get(e.shape[1], (np.empty(0, dtype=np.int64), None))
            order = np.argsort(place)
            for at in np.array_split(order, max(1, -(-len(order) * n // self.cells))) if len(order) else []:
                lo, hi = int(place[at[0]]), int(place[at[-1]]) + 1
                exact = np.zeros((hi - lo, n))
                exact[(place[at] - lo)[:, None], held] = matrix[at] @ e.T
                dense = np.full((hi - lo, n), -np.inf)
                dense[(place[at] - lo)[:, None], held] = np.round(exact[(place[at] - lo)[:, None], held], 9)
                self.vector.update(dense, lo, hi, first, exact=exact)
        for column, mark in (("text_signals", TEXT), ("path_signals", PATH), ("stem_signals", STEM)):
            c = rows.column(column)
            row = first + np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(c), 0))
            at = pc.index_in(c.flatten(), value_set=self.vocabulary)
            self.marks.append((row[np.asarray(at.is_valid())], np.asarray(at.drop_null(), dtype=np.int64), np.full(len(at) - at.null_count, mark, dtype=np.uint8)))
        self.flags.append(np.stack([np.asarray(pc.fill_null(rows.column(c), False).to_numpy(zero_copy_only=False), dtype=bool) for c in FLAGS], axis=1))
        self.places.append(np.asarray(pc.fill_null(rows.column("place"), 0.0)))
        self.known.append(np.asarray(rows.column("place").is_valid()))
        if "formula" in rows.schema.names:
            c = rows.column("formula")
            row = first + np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(c), 0))
            q = pc.index_in(pc.struct_field(c.flatten(), [0]), value_set=self.asked.ids)
            ok = np.asarray(q.is_valid())
            self.formula.append((np.asarray(q.drop_null(), dtype=np.int64), row[ok], np.asarray(pc.struct_field(c.flatten(), [1]), dtype=np.float64)[ok]))

    def results(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([r.column("chunk_id") for r in self.vector.held])
        new = np.concatenate(([True], np.asarray(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False), dtype=bool)))
        chunk = np.cumsum(new) - 1  # of each row
        ids, n = ids.take(pa.array(np.flatnonzero(new))), int(new.sum())
        row = np.flatnonzero(np.concatenate(self.known))
        known = np.zeros(n, dtype=bool)
        flags, places = np.zeros((n, len(FLAGS)), dtype=bool), np.zeros(n)
        known[chunk[row]], flags[chunk[row]], places[chunk[row]] = True, np.concatenate(self.flags)[row], np.concatenate(self.places)[row]
        at, signal, mark = (np.concatenate([m[i] for m in self.marks]) for i in range(3))
        marks = (chunk[at], signal, mark)
        q, at, s = (np.concatenate([f[i] for f in self.formula]) if self.formula else np.empty(0, dtype=np.int64) for i in range(3))
        key = q * n + chunk[at]
        order = np.argsort(key)
        formula = (key[order], s[order])
        per = np.diff(self.asked.starts) + 1
        room, lo = max(1, self.cells // (2 * self.way.k)), 0
        while lo < len(per):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(per[lo : lo + room]) * n, MARKS, "right")))
            hi = min(hi, len(per))
            for reason, q, g, score, by in self.stretch(lo, hi, n, chunk, known, flags, places, marks, formula):
                many = len(q)
                yield pa.RecordBatch.from_arrays([self.asked.ids.take(pa.array(q)), pa.array([self.name] * many, type=pa.string()), ids.take(pa.array(g)), pa.array(score), pa.array(by), pa.array([reason] * many, type=pa.string())], schema=out)
            lo = hi

    def leg(self, best: Best, lo: int, hi: int, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, chunk, score, score scaled to [0, 1] within its query) of the candidates."""
        score = best.score[lo:hi] if best.exact is None else best.exact[lo:hi]
        ok = best.score[lo:hi] > -np.inf
        least, most = np.where(ok, score, np.inf).min(axis=1), np.where(ok, score, -np.inf).max(axis=1)
        q, slot = np.nonzero(ok)
        span = (most - least)[q]
        same = span < 1e-12  # equal but for the order of sums
        return q + lo, chunk[best.row[lo:hi][q, slot]], score[q, slot], np.where(same, 1.0, (score[q, slot] - least[q]) / np.where(same, 1.0, span))

    def stretch(self, lo: int, hi: int, n: int, chunk: np.ndarray, known: np.ndarray, flags: np.ndarray, places: np.ndarray, marks: tuple, formula: tuple) -> Iterator[tuple]:
        """(reason, query, chunk, score, order) of the queries from lo to hi."""
        way, asked = self.way, self.asked
        vq, vg, vs, v = self.leg(self.vector, lo, hi, chunk)
        if way.mode == "semantic":
            key, score = vq * n + vg, self.trust * vs
            key, score = key[(order := np.argsort(key))], score[order]
        else:
            lq, lg, _, l = self.leg(self.lexical, lo, hi, chunk)  # noqa: E741
            hit = np.zeros(hi - lo, dtype=bool)
            hit[lq - lo] = True
            ok = hit[vq - lo]  # only bases with a lexical hit
            kl, kv = lq * n + lg, vq[ok] * n + vg[ok]
            key = np.union1d(kl, kv)
            a, b = np.zeros(len(key)), np.zeros(len(key))
            a[np.searchsorted(key, kl)], b[np.searchsorted(key, kv)] = l, v[ok]
            score = self.trust * (ranking.W_LEXICAL * a + ranking.W_VECTOR * b + np.where((a > 0) & (b > 0), ranking.OVERLAP, 0.0))
        ok = known[key % n]
        key, score = key[ok], score[ok]
        q, g = key // n, key % n
        number, named = np.unique(asked.signals[asked.starts[lo] : asked.starts[hi]], return_inverse=True)
        place = np.full(len(self.vocabulary), -1, dtype=np.int64)
        place[number] = np.arange(len(number))
        mg, ms, mm = marks
        own = place[ms] >= 0
        table = np.zeros(n * max(1, len(number)), dtype=np.uint8)
        for mark in (TEXT, PATH, STEM):
            at = own & (mm == mark)
            table[mg[at] * len(number) + place[ms[at]]] |= mark
        of, at = expand(asked.starts[lo : hi + 1] - asked.starts[lo], q - lo)
        seen = table[g[of] * len(number) + named[at]]
        text, path, stem = (np.bincount(of, (seen & m) > 0, len(q)) for m in (TEXT, PATH, STEM))
        signals = np.diff(asked.starts)[q]
        guide, tests, local = (asked.wants[w][q] for w in ("guide", "tests", "localization"))
        source, document, is_test, is_local = flags[g].T
        raw = np.minimum(0.45, 0.18 * path)
        boost = np.where(guide & source, np.minimum(0.08, raw), raw)
        from_source = np.where(~source, 0.0, np.where(guide, np.minimum(0.05, raw), np.where(stem > 0, 0.32, np.minimum(0.22, raw))))
        score = (score + boost + from_source + np.where(guide & document, places[g], 0.0)) * np.where(is_test & ~tests, 0.48, np.where(~is_test & tests, 0.88, 1.0)) * np.where(is_local & ~local, 0.2, 1.0)
        fk, fs = formula
        f_lo, f_hi = np.searchsorted(fk, (lo * n, hi * n))
        fk, fs = fk[f_lo:f_hi], fs[f_lo:f_hi]
        if len(fk):
            at = np.minimum(np.searchsorted(fk, key), len(fk) - 1)
            score = score + ranking.FORMULA_BOOST * np.where(fk[at] == key, fs[at], 0.0)
            if way.injected:
                new = ~np.isin(fk, key) & known[fk % n]
                yield "formula", *self.first(fk[new], n, fs[new] * self.trust, np.round(fs[new], 9), way.injected)
        if way.mode != "semantic":
            cover = text / np.maximum(signals, 1)
            ok = (np.round(score, 9) >= way.min_score) & ((signals <= 1) | (np.round(from_source, 9) >= 0.22) | np.where(signals <= 3, cover >= 1 / np.maximum(signals, 1), cover >= 0.34))
            key, score = key[ok], score[ok]
        score = np.round(score, way.digits)
        yield "retrieved", *self.first(key, n, score, score, way.limit)

    @staticmethod
    def first(key: np.ndarray, n: int, score: np.ndarray, by: np.ndarray, limit: int) -> tuple:
        """The ``limit`` first rows of each query by ``by`` and chunk."""
        order = np.lexsort((key, -by, key // n))
        q = (key // n)[order]
        start = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=bool)
        order = order[np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) < limit] if len(q) else order
        return (key // n)[order], (key % n)[order], score[order], by[order]
