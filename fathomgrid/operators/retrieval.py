"""Hybrid retrieval as one plan over a batch of queries: scope, legs, fusion, evidence, gates, injection.

Every step keeps ``query_id``, so a batch of queries is answered by joins and group limits, not by a
loop.  Order of the steps: scope and status, legs of each base, fusion times trust, path and source
adjustment, formula and dependency boost, gate, metadata filter, formula and dependency injection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx
from fathomgrid.operators import lexical, ranking, vector
from fathomgrid.session import cut_lineage, spread

# Candidates of the formula leg of each base, its best fuzzy score, injected rows of either leg, edges walked from a chunk.
FORMULA_CANDIDATES, FUZZY_TOP, FORMULA_INJECTED, DEPENDENCY_INJECTED, EDGES = 50, 0.8, 5, 10, 2
SEARCHABLE = ["ready", "stale"]


@dataclass(frozen=True)
class Evidence:
    """What a search draws on beside texts and vectors; each may be left out.

    ``asked``: formulas of the queries (query_id, normalized); ``formulas``: (id, kb_id, chunk_id,
    normalized, content_tokenized); ``edges``: resolved label edges (chunk_id, label, target, pinned)."""

    asked: DataFrame | None = None
    formulas: DataFrame | None = None
    edges: DataFrame | None = None


def scope(bases: DataFrame, kb_ids: list[str] | None = None, class_name: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(searchable bases (kb_id, name, trust, dim), unresolved names, warnings).  ``kb_ids`` may be ids or
    names.  Bases are a small table: what is collected are the named ones and those not ready."""
    b = bases
    missing: list[str] = []
    if kb_ids:
        known = b.where(F.col("id").isin(kb_ids) | F.col("name").isin(kb_ids)).select("id", "name").collect()
        missing = [k for k in kb_ids if not any(k in (r["id"], r["name"]) for r in known)]
        b = b.where(F.col("id").isin([r["id"] for r in known]))
    if class_name is not None:
        b = b.where(F.col("class_name") == class_name)
    off = b.where(~F.coalesce(F.col("status").isin(*SEARCHABLE), F.lit(False))).select("name", "status").limit(100).collect()
    warnings = [f"{r['name']} is {r['status']} and was left out" for r in off]
    ok = b.where(F.col("status").isin(*SEARCHABLE) & (F.coalesce("chunk_count", F.lit(0)) > 0))
    return ok.select(F.col("id").alias("kb_id"), "name", ranking.trust(F.col("status"), F.col("source_type")).alias("trust"), F.col("embedding_dimension").alias("dim")), missing, warnings


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, embedding): the latest usable vector of each chunk, by an aggregate."""
    ok = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    at = F.coalesce("embedded_at", F.timestamp_micros(F.lit(0))) if "embedded_at" in vectors.columns else F.lit(0)
    return ok.groupBy("kb_id", "chunk_id").agg(F.max(F.struct(at.alias("at"), "embedding"))["embedding"].alias("embedding"))


def vector_leg(vectors: DataFrame, query_vectors: DataFrame, bases: DataFrame, k: int, hit: DataFrame | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, score): cosines in bases whose dimension the vector has; in ``hit``
    (query_id, kb_id) only, if given."""
    v = latest_vectors(vectors).join(bases.select("kb_id", "dim"), "kb_id").where((F.size("embedding") == F.col("dim")) & (vector.norm(F.col("embedding")) > 0)).select("kb_id", "chunk_id", vector.unit(F.col("embedding")).alias("embedding"))
    found = vector.vector_search(v, query_vectors, k).drop("rank")
    return found.join(hit, ["query_id", "kb_id"], "left_semi") if hit is not None else found


def query_vectors(queries: DataFrame, dims: list[int], embed=vector.hashed_embedding) -> DataFrame:
    """(query_id, embedding): one vector of each query for every dimension that the bases have."""
    rows = queries.select("query_id", F.explode(F.array(*[F.struct(embed(F.col("query_text"), d).alias("e")) for d in dims])).alias("x"))
    return cut_lineage(rows.select("query_id", F.col("x.e").alias("embedding"))).where(vector.norm(F.col("embedding")) > 0)  # as many rows as queries times dimensions


def base_scores(mode: str, chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, qvecs: DataFrame | None, bases: DataFrame, k: int, stored: DataFrame | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, score): the legs of a mode, fused and times trust.

    Hybrid leaves out bases without a lexical hit.  Statistics of the texts are index-wide; bases
    out of scope fall away after scoring."""
    inside = bases.select("kb_id", "trust")
    trusted = lambda df: cut_lineage(df.join(inside, "kb_id").select("query_id", "kb_id", "chunk_id", (F.col("score") * F.col("trust")).alias("score")))  # noqa: E731  at most k rows a query and base
    if mode == "semantic":
        return trusted(vector_leg(vectors, qvecs, bases, k))
    scores = lexical.strict_or_relaxed(lexical.bm25_scores(chunks, queries, stored=stored).join(inside.select("kb_id"), "kb_id", "left_semi"), relax=mode != "fast")
    lex = lexical.top_k(scores.withColumn("score", F.round("score", 9)), k, ["query_id", "kb_id"]).select("query_id", "kb_id", "chunk_id", "score")
    if mode == "fast" or vectors is None:
        return trusted(lex)
    lex = cut_lineage(lex)  # used three times; at most k rows a query and base
    vec = vector_leg(vectors, qvecs, bases, k, lex.select("query_id", "kb_id").distinct())
    return trusted(ranking.fuse(lex, vec).select("query_id", "kb_id", "chunk_id", "score"))


#: Distinct query signals up to which a chunk's signals are cut down to those that some query has.
SIGNALS = 20_000


def chunk_columns(chunks: DataFrame, wanted: list[str] | None = None, stream: str = "content_tokenized") -> DataFrame:
    """What ranking needs of a chunk; of its signals only the ``wanted`` ones, if given."""
    p = F.coalesce("file_path", F.lit(""))
    cut = lambda c: c if wanted is None else F.filter(c, lambda x: x.isin(wanted))
    signals = lambda c: cut(tx.signals(tx.search_tokens(c)))
    return chunks.select(
        F.col("id").alias("chunk_id"), p.alias("file_path"), tx.file_type_alias(F.col("file_type")).alias("file_type"), "start_line", "end_line",
        signals(F.col(stream)).alias("text_signals"), signals(tx.spaced(p)).alias("path_signals"), signals(tx.spaced(tx.path_stem(p))).alias("stem_signals"),
    )


def adjusted(scored: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``scored`` with the boosts and penalties, ``coverage`` and the score after them.

    Texts are tokenised once per candidate chunk, and a chunk carries only signals that some query of
    the batch has, so the rows of queries and candidates stay small."""
    q = cut_lineage(queries.select("query_id", tx.signals(tx.search_tokens(F.col("query_text"))).alias("query_signals")))
    some = [r["s"] for r in q.select(F.explode("query_signals").alias("s")).distinct().limit(SIGNALS + 1).collect()]
    wanted = scored.select(F.col("chunk_id").alias("id")).distinct()
    held = spread(chunks.select("id", "file_path", "file_type", "start_line", "end_line", "content_tokenized")).join(wanted, "id", "left_semi")
    c = cut_lineage(chunk_columns(held, some if len(some) <= SIGNALS else None))
    rows = ranking.adjusted(scored.join(c, "chunk_id").join(q, "query_id"))
    return rows.withColumn("coverage", tx.coverage(F.col("text_signals"), F.col("query_signals"))).withColumn("score", F.col("adjusted_score"))


def formula_candidates(asked: DataFrame, formulas: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(query_id, kb_id, id, chunk_id, rank, n): the best formulas of each base for the queries' formulas
    by BM25 over formula tokens, ranked from 1 among the n kept."""
    f = formulas.select("id", "kb_id", "chunk_id", "content_tokenized").dropDuplicates(["id"])
    phrases = asked.select("query_id", F.explode(F.array_distinct(tx.fts_terms(F.col("normalized")))).alias("term")).distinct()
    phrases = phrases.select("query_id", F.col("term").alias("phrase"), F.lit(0).alias("off"), "term", F.lit(1).alias("len"))
    top = lexical.bm25_top(f, asked, FORMULA_CANDIDATES, ["query_id", "kb_id"], phrases=phrases, bases=bases)
    n = top.groupBy("query_id", "kb_id").agg(F.count(F.lit(1)).alias("n"))
    return top.join(n, ["query_id", "kb_id"]).join(f.select(F.col("id").alias("chunk_id"), F.col("chunk_id").alias("owner")), "chunk_id").select("query_id", "kb_id", F.col("chunk_id").alias("id"), F.col("owner").alias("chunk_id"), "rank", "n")


def formula_scores(asked: DataFrame, formulas: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(query_id, kb_id, chunk_id, formula_score): 1 where a formula of the query stands in the chunk,
    else its fuzzy score by rank."""
    exact = asked.select("query_id", "normalized").distinct().join(formulas.select("kb_id", "chunk_id", "normalized").distinct(), "normalized")
    exact = exact.join(bases.select("kb_id"), "kb_id", "left_semi") if bases is not None else exact
    fuzzy = formula_candidates(asked, formulas, bases)
    both = exact.select("query_id", "kb_id", "chunk_id", F.lit(1.0).alias("s")).unionByName(fuzzy.select("query_id", "kb_id", "chunk_id", (F.lit(FUZZY_TOP) * (F.col("n") - F.col("rank") + 1) / F.col("n")).alias("s")))
    return both.groupBy("query_id", "kb_id", "chunk_id").agg(F.max("s").alias("formula_score"))


def walked(rows: DataFrame, edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(query_id, trigger, label, target, pinned): the first edges of every chunk of ``rows``, to targets in scope."""
    w = Window.partitionBy("chunk_id").orderBy("label", "target")
    first = edges.where(F.col("target").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= EDGES).select(F.col("chunk_id").alias("trigger"), "label", "target", "pinned")
    ok = first.join(inside.select(F.col("chunk_id").alias("target")), "target", "left_semi")
    return rows.select("query_id", F.col("chunk_id").alias("trigger")).join(ok, "trigger").select("query_id", "trigger", "label", "target", "pinned")


def matches_filter(file_type: str | None, path_pattern: str | None) -> Column:
    ok = F.lit(True)
    if file_type:
        ok = ok & (F.col("file_type") == tx.TYPE_ALIASES.get(file_type.strip().lower(), file_type.strip().lower()))
    return ok & F.col("file_path").contains(path_pattern) if path_pattern else ok


def hybrid_rows(
    mode: str, chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, qvecs: DataFrame | None, bases: DataFrame, k: int,
    min_score: float = ranking.MIN_HYBRID, evidence: Evidence = Evidence(), file_type: str | None = None, path_pattern: str | None = None, stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows, dependencies): every result of the queries with its score, ``reason`` (retrieved, formula or
    dependency) and diagnostics, and the walked edges (query_id, trigger, label, target, pinned)."""
    scored = base_scores(mode, chunks, vectors, queries, qvecs, bases, k, stored)
    scored = scored.groupBy("query_id", "chunk_id").agg(F.first("kb_id").alias("kb_id"), F.max("score").alias("score"))
    rows = adjusted(scored, chunks, queries)
    keep = ["query_id", "kb_id", "chunk_id", "score", "file_path", "file_type", "start_line", "end_line", "path_boost", "source_boost", "documentation_boost", "coverage", F.size("query_signals").alias("n_signals")]
    rows = rows.select(*keep)
    inside = chunks.join(bases.select("kb_id", "trust"), "kb_id").select("kb_id", F.col("id").alias("chunk_id"), "trust", F.coalesce("file_path", F.lit("")).alias("file_path"), tx.file_type_alias(F.col("file_type")).alias("file_type"), "start_line", "end_line")
    formula = dependency = None
    if evidence.asked is not None and evidence.formulas is not None:
        formula = formula_scores(evidence.asked, evidence.formulas, bases).groupBy("query_id", "chunk_id").agg(F.max("formula_score").alias("formula_score"))
        rows = rows.join(formula, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + ranking.FORMULA_BOOST * F.coalesce("formula_score", F.lit(0.0))).drop("formula_score")
    if evidence.edges is not None:
        rows = cut_lineage(rows)
        dependency = walked(rows, evidence.edges, inside)
        boosted = dependency.where("trigger <> target").select("query_id", F.col("target").alias("chunk_id")).distinct().withColumn("_d", F.lit(ranking.DEPENDENCY_BOOST))
        rows = rows.join(boosted, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("_d", F.lit(0.0))).drop("_d")
    found = rows
    if mode == "fast":
        found = found.where("coverage > 0")
    elif mode != "semantic":
        found = found.where((F.round("score", 9) >= min_score) & ranking.enough_evidence(F.col("n_signals"), F.round("source_boost", 9), F.col("coverage")))
    found = found.where(matches_filter(file_type, path_pattern)).withColumn("reason", F.lit("retrieved"))
    out = found.drop("n_signals")
    blank = {c: F.lit(0.0) for c in ("path_boost", "source_boost", "documentation_boost", "coverage")}
    retrieved = rows.select("query_id", "chunk_id")
    injected = None
    if formula is not None:
        new = formula.join(retrieved, ["query_id", "chunk_id"], "left_anti").join(inside, "chunk_id").where(matches_filter(file_type, path_pattern))
        injected = lexical.top_k(new.withColumn("formula_score", F.round("formula_score", 9)), FORMULA_INJECTED, ["query_id"], "formula_score").withColumn("score", F.col("formula_score") * F.col("trust")).withColumn("reason", F.lit("formula"))
        injected = injected.withColumns(blank).select(*out.columns)
        out = out.unionByName(injected)
    if dependency is not None:
        order = rows.select("query_id", F.col("chunk_id").alias("trigger"), F.col("score").alias("_s"))
        new = dependency.join(order, ["query_id", "trigger"]).groupBy("query_id", F.col("target").alias("chunk_id")).agg(F.max("_s").alias("_s")).join(retrieved, ["query_id", "chunk_id"], "left_anti")
        new = new.join(injected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti") if injected is not None else new
        new = lexical.top_k(new.join(inside, "chunk_id").where(matches_filter(file_type, path_pattern)), DEPENDENCY_INJECTED, ["query_id"], "_s")
        more = new.withColumn("score", F.lit(ranking.DEPENDENCY_BOOST) * F.col("trust")).withColumn("reason", F.lit("dependency")).withColumns(blank)
        out = out.unionByName(more.select(*out.columns))
        if injected is not None:
            dependency = dependency.unionByName(walked(injected, evidence.edges, inside))
    return out, dependency


def adaptive_scores(seeds: DataFrame, chunks: DataFrame, queries: DataFrame, lines: int = 80) -> DataFrame:
    """(query_id, seed_id, seed_score, kb_id, file_path, chunk_id, start_line, end_line, content, adaptive): the
    chunks around each seed in its file, found by a range join, with their score as context."""
    from fathomgrid.functions.metadata import metadata

    c = chunks.select(
        F.col("id").alias("chunk_id"), "kb_id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", "start_line", F.lit(1)).alias("end_line"), "content",
        metadata(F.col("metadata_json")).alias("m"), F.coalesce(tx.signals(tx.search_tokens(F.col("content"))), F.array().cast("array<string>")).alias("cs"),
    )
    place = c.select(F.col("chunk_id").alias("seed_id"), "kb_id", "file_path", F.col("start_line").alias("s0"), F.col("end_line").alias("e0"), F.col("m").alias("m0"))
    s = seeds.select("query_id", F.col("chunk_id").alias("seed_id"), F.col("score").alias("seed_score")).join(place, "seed_id")
    q = queries.select("query_id", tx.signals(tx.search_tokens(F.col("query_text"))).alias("qs"))
    same = F.col("chunk_id") == F.col("seed_id")
    inside = (F.col("end_line") >= F.greatest(F.lit(1), F.col("s0") - lines)) & (F.col("start_line") <= F.col("e0") + lines)
    near = s.join(c, ["kb_id", "file_path"]).where(same | inside).join(q, "query_id")
    far = F.when(same, 0).otherwise(F.least(F.abs(F.col("start_line") - F.col("s0")), F.abs(F.col("end_line") - F.col("e0"))))
    score = F.when(same, 2.0).otherwise(ranking.relation_boost(F.col("m0"), F.col("m"))) + 1 / (1 + far / 20.0) + tx.coverage(F.col("cs"), F.col("qs"))
    return near.select("query_id", "seed_id", "seed_score", "kb_id", "file_path", "chunk_id", "start_line", "end_line", "content", F.round(score, 9).alias("adaptive"))


def adaptive_windows(seeds: DataFrame, chunks: DataFrame, queries: DataFrame, lines: int = 80, target: int = 5, chars: int = 6000) -> DataFrame:
    """(query_id, seed_id, kb_id, file_path, score, content, start_line, end_line, sources): the context of each
    seed, made of itself and its best neighbours in the file, and cut at ``chars`` characters."""
    near = adaptive_scores(seeds, chunks, queries, lines)
    w = Window.partitionBy("query_id", "seed_id").orderBy(F.col("adaptive").desc(), "start_line", "end_line", "chunk_id")
    best = near.withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= target) | (F.col("chunk_id") == F.col("seed_id")))
    before = Window.partitionBy("query_id", "seed_id").orderBy("start_line", "end_line", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    part = best.withColumn("used", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0).cast("long"))).where(F.col("used") < chars)
    piece = F.struct("start_line", "end_line", "chunk_id", F.col("content").substr(F.lit(1), (F.lit(chars) - F.col("used")).cast("int")).alias("text"))
    g = part.groupBy("query_id", "seed_id", "kb_id", "file_path", "seed_score").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))  # at most target + 1 pieces
    return g.select("query_id", "seed_id", "kb_id", "file_path", F.col("seed_score").alias("score"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("content"), "start_line", "end_line", F.transform("p", lambda x: x["chunk_id"]).alias("sources"))


def collapse_windows(windows: DataFrame) -> DataFrame:
    """Windows of a query that share a chunk in one file count once: in order of score, a later one takes
    an earlier one's place if it scores higher or has more chunks.  A fold over a query's bounded
    candidate list; a window can only meet windows of its own file, so files are folded apart."""
    kind = dict(windows.dtypes)["query_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds = [], []
            for n, listed in enumerate(batch.column("w").to_pylist()):
                kept: list[tuple[float, str, set[str]]] = []
                for w in listed:
                    one = (-w["s"], w["seed_id"], set(w["sources"]))
                    hit = next((n for n, k in enumerate(kept) if k[2] & one[2]), None)
                    if hit is None:
                        kept.append(one)
                    elif one[0] > kept[hit][0] or len(one[2]) > len(kept[hit][2]):
                        kept[hit] = one
                rows += [n] * len(kept)
                seeds += [k[1] for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows, type=pa.int64())), pa.array(seeds, type=pa.string())], names=["query_id", "seed_id"])

    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "seed_id", "sources"))).alias("w")  # a query's windows in a file
    kept = windows.groupBy("query_id", "kb_id", "file_path").agg(listed).select("query_id", "w").mapInArrow(fold, f"query_id {kind}, seed_id string")
    return windows.join(kept, ["query_id", "seed_id"], "left_semi")
