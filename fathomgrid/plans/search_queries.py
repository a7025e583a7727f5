"""Retrieval, fusion, ranking, evidence and context over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx
from fathomgrid.operators import bases, evaluation, lexical, ranking, retrieval, vector
from fathomgrid.plans.registry import SQL_DOT, query, sql_case, sql_list, sql_signals, sql_spaced, sql_terms, sql_tokens

T = "content_tokenized"
_R = lambda c: F.round(c, 6)

_POST = f"post AS (SELECT kb_id, id AS chunk_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT kb_id, id, {sql_terms(T)} AS w FROM chunks))"
_LEN = f"dl AS (SELECT id AS chunk_id, len({sql_terms('coalesce(' + T + ', $$$$)')}) AS dl FROM chunks), st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl)"
_PHR = f"asked AS (SELECT query_id, unnest({sql_tokens('query_text')}) AS phrase FROM search_queries), ph AS (SELECT phrase, len(w) AS n, generate_subscripts(w, 1) - 1 AS off, unnest(w) AS term FROM (SELECT DISTINCT phrase, {sql_terms('phrase')} AS w FROM asked) WHERE len(w) > 0)"
_BM25 = (
    f"{_POST}, {_LEN}, {_PHR}, "
    "occ AS (SELECT phrase, n, kb_id, chunk_id, pos - off AS origin, count(*) AS got FROM post JOIN ph USING (term) GROUP BY ALL), "
    "fr AS (SELECT phrase, kb_id, chunk_id, count(*) AS tf FROM occ WHERE got = n GROUP BY ALL), df AS (SELECT phrase, count(*) AS df FROM fr GROUP BY phrase), "
    "w AS (SELECT phrase, kb_id, chunk_id, (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM fr JOIN df USING (phrase) JOIN dl USING (chunk_id), st), "
    "qt AS (SELECT query_id, count(*) AS terms FROM (SELECT DISTINCT query_id, phrase FROM asked WHERE phrase IN (SELECT phrase FROM ph)) GROUP BY query_id), "
    "sc AS (SELECT query_id, kb_id, chunk_id, sum(w) AS score, count(*) AS matched, any_value(terms) AS terms FROM w JOIN (SELECT DISTINCT query_id, phrase FROM asked) USING (phrase) JOIN qt USING (query_id) GROUP BY ALL)"
)
_RELAX = "ro AS (SELECT *, max((matched = terms)::INT) OVER (PARTITION BY query_id, kb_id) AS m FROM sc), rx AS (SELECT * FROM ro WHERE matched = terms OR m = 0)"


@query(f"WITH {_POST} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM post GROUP BY term")
def agg05_term_statistics(t):
    return lexical.term_statistics(t.chunks)


@query(f"WITH {_POST}, {_LEN} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(DISTINCT term) FROM post) AS terms FROM st")
def agg05_corpus_statistics(t):
    n_docs, avgdl = lexical.document_lengths(t.chunks).agg(F.count(F.lit(1)), _R(F.avg("dl"))).first()
    return lexical.term_statistics(t.chunks).agg(F.lit(n_docs).alias("n_docs"), F.lit(avgdl).alias("avgdl"), F.count(F.lit(1)).alias("terms"))


@query(f"WITH {_BM25} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, matched FROM sc")
def agg06_bm25_scores(t):
    return lexical.bm25_scores(t.chunks, t.search_queries, digits=6).select("query_id", "kb_id", "chunk_id", "score", "matched")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM sc WHERE matched = terms QUALIFY rank <= 10")
def ret01_fast_search(t):
    s = lexical.bm25_top(t.chunks, t.search_queries, 10, ["query_id", "kb_id"], "all")
    return s.select("query_id", "chunk_id", _R(F.col("score")).alias("score"), "rank")


@query(f"WITH {_BM25}, {_RELAX} SELECT query_id, kb_id, chunk_id, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM rx QUALIFY rank <= 5")
def str07_or_fallback(t):
    s = lexical.bm25_top(t.chunks, t.search_queries, 5, ["query_id", "kb_id"], "relaxed")
    return s.select("query_id", "kb_id", "chunk_id", _R(F.col("score")).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 3")
def srt01_bm25_top(t):
    return lexical.bm25_top(t.chunks, t.search_queries, 3, ["query_id"]).select("query_id", "chunk_id", _R(F.col("score")).alias("score"))


_QV = "q AS (SELECT vec_id AS query_id, embedding AS b FROM embeddings WHERE vec_id % 50 = 0)"


def _vq(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_QV}, s AS (SELECT query_id, label, vec_id, round({SQL_DOT}, 6) AS score FROM (SELECT query_id, label, vec_id, embedding AS a, b FROM embeddings, q)) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def ret02_semantic_search(t):
    e = t.embeddings.withColumn("all", F.lit(0))
    found = vector.vector_search(e.select("all", F.struct("vec_id", "label").alias("hit"), "embedding"), _vq(t), 20, "hit", "all")
    s = found.select("query_id", "hit.label", "hit.vec_id", _R(F.col("score")).alias("score"))
    return lexical.top_k(s, 10, ["query_id"], tie="vec_id").drop("rank")


@query(f"WITH {_QV}, s AS (SELECT query_id, label, vec_id, round({SQL_DOT}, 6) AS score FROM (SELECT query_id, label, vec_id, embedding AS a, b FROM embeddings, q)) SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3")
def srt02_vector_top_per_group(t):
    found = vector.vector_search(t.embeddings, _vq(t), 4, "vec_id", "label").withColumn("score", _R(F.col("score"))).drop("rank")
    return lexical.top_k(found, 3, ["query_id", "label"], tie="vec_id")


# Score tables of search_hits: the latest score of each leg.
_LAST = "lt AS (SELECT query_id, kb_id, chunk_id, leg, arg_max(score, (coalesce(seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), coalesce(score, -1e300))) AS score FROM search_hits GROUP BY ALL)"


def _latest_hits(t):
    at = F.coalesce("seen_at", F.timestamp_micros(F.lit(0)))
    return t.search_hits.groupBy("query_id", "kb_id", "chunk_id", "leg").agg(F.max(F.struct(at.alias("at"), "score"))["score"].alias("score"))


def _leg(t, leg):
    return _latest_hits(t).where((F.col("leg") == leg) & F.col("score").isNotNull())


_LAST2 = "lt AS (SELECT query_id, kb_id, chunk_id, leg, (max({'at': coalesce(seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), 'score': coalesce(score, -1e300)})).score AS s0 FROM search_hits GROUP BY ALL), lx AS (SELECT query_id, kb_id, chunk_id, leg, s0 AS score FROM lt WHERE s0 > -1e299)"


@query(f"WITH {_LAST2} SELECT query_id, leg, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM lx WINDOW w AS (PARTITION BY query_id, leg)")
def agg07_min_max(t):
    h = _latest_hits(t).where("score is not null")
    return ranking.min_max(h, ["query_id", "leg"]).select("query_id", "leg", "chunk_id", _R(F.col("scaled")).alias("scaled"))


_FUSE = (
    f"{_LAST2}, l AS (SELECT query_id, kb_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM lx WHERE leg = 'bm25' WINDOW w AS (PARTITION BY query_id, kb_id)), "
    "v AS (SELECT query_id, kb_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM lx WHERE leg = 'vector' WINDOW w AS (PARTITION BY query_id, kb_id)), "
    "fz AS (SELECT query_id, kb_id, chunk_id, coalesce(l, 0) AS l, coalesce(v, 0) AS v, 0.45 * coalesce(l, 0) + 0.55 * coalesce(v, 0) + CASE WHEN coalesce(l, 0) > 0 AND coalesce(v, 0) > 0 THEN 0.15 ELSE 0 END AS score FROM l FULL JOIN v USING (query_id, kb_id, chunk_id))"
)


def _fused(t):
    return ranking.fuse(_leg(t, "bm25"), _leg(t, "vector"))


@query(f"WITH {_FUSE} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score FROM fz")
def jn05_fusion(t):
    return _fused(t).select("query_id", "kb_id", "chunk_id", _R(F.col("score")).alias("score"))


_TRUST = "(CASE WHEN status = 'stale' THEN 0.92 ELSE 1 END) * (CASE WHEN source_type IN ('directory', 'file') THEN 1.04 WHEN source_type IN ('text', 'url') THEN 0.98 ELSE 1 END)"
_KB = f"kb AS (SELECT id AS kb_id, embedding_dimension AS dim, {_TRUST} AS trust FROM knowledge_bases WHERE status IN ('ready', 'stale') AND coalesce(chunk_count, 0) > 0)"


def _sql_vector(terms: str, dim: str) -> str:
    codes = f"list_transform({terms}, lambda x: ('0x' || substr(md5(x), 1, 6))::INT)"
    return f"list_transform(range(0, {dim}), lambda k: coalesce(list_sum(list_transform(list_filter({codes}, lambda c: c % {dim} = k), lambda c: CASE WHEN (c // 65536) % 2 = 0 THEN 1.0 ELSE -1.0 END)), 0.0)::DOUBLE)"


#: Vector leg: cosines of the queries' hashed vectors with the latest vectors of every base in scope, the K best of each.
_VLEG = (
    "cv AS (SELECT kb_id, chunk_id, (max({'at': coalesce(embedded_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), 'e': embedding})).e AS e FROM chunk_vectors WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL)), false) GROUP BY ALL), "
    "cw AS (SELECT kb_id, chunk_id, dim, e FROM cv JOIN kb USING (kb_id) WHERE len(e) = dim AND list_sum(list_transform(e, lambda x: abs(x))) > 0), dims AS (SELECT DISTINCT dim FROM kb WHERE dim > 0), "
    f"qx AS (SELECT query_id, dim, {_sql_vector('w', 'dim::INT')} AS v FROM (SELECT query_id, list_distinct({sql_terms('query_text')}) AS w FROM search_queries) CROSS JOIN dims), "
    "qy AS (SELECT * FROM qx WHERE list_sum(list_transform(v, lambda x: abs(x))) > 0), "
    "vs AS (SELECT query_id, kb_id, chunk_id, (list_sum(list_transform(list_zip(e, v), lambda p: p[1]::DOUBLE * p[2])) / sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS score FROM cw JOIN qy USING (dim))"
)
@query(
    f"WITH v AS (SELECT query_id, {_sql_vector('w', '64')} AS v FROM (SELECT query_id, list_distinct({sql_terms('coalesce(query_text, $$$$)')}) AS w FROM search_queries)), n AS (SELECT query_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), "
    "u AS (SELECT query_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS place FROM n) SELECT query_id, place::INT AS place, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value FROM u"
)
def ret12_hashed_embeddings(t):
    """The offline embedding of every query, number by number."""
    e = t.search_queries.select("query_id", F.posexplode(vector.hashed_embedding(F.col("query_text"))).alias("place", "value"))
    return e.select("query_id", "place", _R(F.col("value")).alias("value"))


_CAND = 120  # the candidates of the balanced profile
_HYBRID = (
    f"{_BM25}, {_RELAX}, {_KB}, lexl AS (SELECT query_id, kb_id, chunk_id, round(score, 9) AS score FROM rx JOIN kb USING (kb_id) QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id) <= {_CAND}), "
    f"{_VLEG}, vecl AS (SELECT vs.query_id, vs.kb_id, chunk_id, score FROM vs JOIN (SELECT DISTINCT query_id, kb_id FROM lexl) USING (query_id, kb_id) QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id) <= {_CAND}), "
    "hl AS (SELECT query_id, kb_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS l FROM lexl WINDOW w AS (PARTITION BY query_id, kb_id)), "
    "hv AS (SELECT query_id, kb_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM vecl WINDOW w AS (PARTITION BY query_id, kb_id)), "
    "hf AS (SELECT query_id, kb_id, chunk_id, trust * (0.45 * coalesce(l, 0) + 0.55 * coalesce(v, 0) + CASE WHEN coalesce(l, 0) > 0 AND coalesce(v, 0) > 0 THEN 0.15 ELSE 0 END) AS score FROM hl FULL JOIN hv USING (query_id, kb_id, chunk_id) JOIN kb USING (kb_id))"
)


def _scope(t):
    return retrieval.scope(t.knowledge_bases)[0]


def _query_vectors(t, scope):
    dims = [r["dim"] for r in scope.where("dim > 0").select("dim").distinct().collect()]  # the few dimensions of the bases
    return retrieval.query_vectors(t.search_queries, sorted(dims))


def _hybrid_rows(t, mode="hybrid", **options):
    scope = _scope(t)
    return retrieval.hybrid_rows(mode, t.chunks, t.chunk_vectors, t.search_queries, _query_vectors(t, scope), scope, _CAND, **options)


def _best_rows(t, n, digits, mode="hybrid", formula=None):
    """(query_id, chunk_id, score, reason, rank): the n best rows of each query, injected ones included."""
    scope = _scope(t)
    injected = retrieval.FORMULA_INJECTED if formula is not None else 0
    rows = bases.search(mode, t.chunks, t.chunk_vectors, t.search_queries, _query_vectors(t, scope), scope, _CAND, n, digits, formula=formula() if formula is not None else None, injected=injected)
    if rows is None:  # a batch beyond what tasks hold
        evidence = retrieval.Evidence(asked=_asked_formulas(t), formulas=t.formulas) if formula is not None else retrieval.Evidence()
        rows = _hybrid_rows(t, mode, evidence=evidence)[0].withColumn("score", F.round("score", digits))
        return lexical.top_k(rows, n, ["query_id"])
    if injected:
        rows = lexical.top_k(rows, n, ["query_id", "reason"], "order").where((F.col("reason") == "retrieved") | (F.col("rank") <= injected)).withColumn("score", F.round("score", digits))
    return lexical.top_k(rows, n, ["query_id"])


@query("SELECT id, round((CASE WHEN status = 'stale' THEN 0.92 ELSE 1 END) * (CASE WHEN source_type IN ('directory', 'file') THEN 1.04 WHEN source_type IN ('text', 'url') THEN 0.98 ELSE 1 END), 6)::DOUBLE AS trust FROM knowledge_bases")
def sco09_trust(t):
    return t.knowledge_bases.select("id", _R(ranking.trust(F.col("status"), F.col("source_type"))).alias("trust"))


_STEM = "regexp_replace(regexp_replace(list_extract(string_split(file_path, '/'), -1), '[.][^.]+$', ''), '(?i:_test|[.]test|[.]spec)$', '')"
def _sql_adjust(source: str) -> str:
    """q, c, x, y, z: the adjusted scores ``adj`` of the rows (query_id, chunk_id, score) of ``source``."""
    return (
        f"q AS (SELECT query_id, {sql_signals(sql_tokens('query_text'))} AS qs FROM search_queries), "
    f"c AS (SELECT id AS chunk_id, file_path, coalesce({sql_case("lower(trim(file_type))", tx.TYPE_ALIASES, "lower(trim(file_type))")}, '') AS ft, {sql_signals(sql_tokens(sql_spaced('file_path')))} AS ps, {sql_signals(sql_tokens(sql_spaced(_STEM)))} AS ss FROM (SELECT id, coalesce(file_path, $$$$) AS file_path, file_type FROM chunks)), "
    f"x AS (SELECT *, list_has_any(qs, {sql_list(tx.GUIDE)}) AS guide, list_has_any(qs, {sql_list(tx.TESTS)}) AS tests, list_has_any(qs, {sql_list(tx.LOCALIZATION)}) AS loc, ft IN ({', '.join(repr(s) for s in tx.SOURCE_TYPES)}) AS src, least(0.45, 0.18 * len(list_intersect(ps, qs))) AS raw FROM {source} JOIN q USING (query_id) JOIN c USING (chunk_id)), "
    "y AS (SELECT *, CASE WHEN guide AND src THEN least(0.08, raw) ELSE raw END AS pb, CASE WHEN NOT src THEN 0 WHEN guide THEN least(0.05, raw) WHEN list_has_any(ss, qs) THEN 0.32 ELSE least(0.22, raw) END AS sb, "
    "CASE WHEN NOT guide OR ft NOT IN ('markdown', 'latex') THEN 0 WHEN contains(lower(file_path), 'install') OR contains(lower(file_path), 'readme') OR contains(lower(file_path), 'getting-started') OR contains(lower(file_path), 'quickstart') THEN 0.85 WHEN starts_with(lower(file_path), 'docs/') THEN 0.35 ELSE 0 END AS db, "
    + " OR ".join(f"contains(lower(file_path), '{m}')" for m in tx.TEST_MARKS)
    + " AS tp, ft IN ('json', 'markdown', 'text', 'toml', 'yaml') AND regexp_matches(lower(file_path), '(^|/)(locales?|lang|i18n|translations)/') AS lp FROM x), "
    "z AS (SELECT *, (score + pb + sb + db) * (CASE WHEN tp AND NOT tests THEN 0.48 WHEN NOT tp AND tests THEN 0.88 ELSE 1 END) * (CASE WHEN lp AND NOT loc THEN 0.2 ELSE 1 END) AS adj FROM y)"
)


_ADJ = f"{_LAST2}, lf AS (SELECT query_id, chunk_id, score FROM lx WHERE leg = 'fusion'), {_sql_adjust('lf')}"
_COV = f"k AS (SELECT id AS chunk_id, {sql_signals(sql_tokens(T))} AS cs FROM chunks)"


def _adjusted(t):
    return retrieval.adjusted(_leg(t, "fusion").drop("kb_id"), t.chunks, t.search_queries)


@query(f"WITH {_ADJ} SELECT query_id, chunk_id, round(pb, 6)::DOUBLE AS path_boost, round(sb, 6)::DOUBLE AS source_boost, round(db, 6)::DOUBLE AS documentation_boost, tp AS is_test, lp AS is_localization, round(adj, 6) AS adjusted_score FROM z")
def sco08_rank_adjust(t):
    a = _adjusted(t)
    return a.select("query_id", "chunk_id", *[_R(F.col(c)).alias(c) for c in ("path_boost", "source_boost", "documentation_boost")], "is_test", "is_localization", _R(F.col("adjusted_score")).alias("adjusted_score"))


_GATE = "round(adj, 9) >= 0.18 AND CASE WHEN n <= 1 OR round(sb, 9) >= 0.22 THEN true WHEN n <= 3 THEN cov >= 1 / n ELSE cov >= 0.34 END"
_GATED = "g AS (SELECT query_id, chunk_id, adj, sb, len(qs) AS n, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(cs, qs)) / len(qs) END AS cov FROM z JOIN k USING (chunk_id))"


@query(f"WITH {_ADJ}, {_COV}, {_GATED} SELECT query_id, chunk_id, round(cov, 6) AS coverage FROM g WHERE {_GATE}")
def flt05_confidence_gate(t):
    g = _adjusted(t)
    ok = (F.round("adjusted_score", 9) >= ranking.MIN_HYBRID) & ranking.enough_evidence(F.size("query_signals"), F.round("source_boost", 9), F.col("coverage"))
    return g.where(ok).select("query_id", "chunk_id", _R(F.col("coverage")).alias("coverage"))


@query(f"WITH {_HYBRID}, {_sql_adjust('hf')}, {_COV}, {_GATED} SELECT query_id, chunk_id, round(adj, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(adj, 6) DESC, chunk_id)::INT AS rank FROM g WHERE {_GATE} QUALIFY rank <= 10")
def ret03_hybrid_search(t):
    """From the texts and vectors: BM25 and cosine per base, fused, adjusted and gated."""
    return _best_rows(t, 10, 6).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_KB}, {_VLEG}, vl AS (SELECT query_id, chunk_id, trust * score AS score FROM vs JOIN kb USING (kb_id) QUALIFY row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(vs.score, 9) DESC, chunk_id) <= {_CAND}), {_sql_adjust('vl')} SELECT query_id, chunk_id, round(adj, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(adj, 6) DESC, chunk_id)::INT AS rank FROM z QUALIFY rank <= 10")
def ret02_semantic_over_bases(t):
    """Semantic mode over the bases: vectors only, no gate."""
    return _best_rows(t, 10, 6, "semantic").select("query_id", "chunk_id", "score", "rank")


@query(None)
def ret05_adaptive_search(t):
    """Hybrid seeds with their context windows, overlapping windows collapsed (a fold: no SQL)."""
    seeds = _best_rows(t, 20, 9)
    w = retrieval.collapse_windows(retrieval.adaptive_windows(seeds, t.chunks, t.search_queries))
    return w.select("query_id", "seed_id", _R(F.col("score")).alias("score"), "start_line", "end_line", F.array_join("sources", ",").alias("sources"), F.length("content").alias("n_chars"))


@query(f"WITH q AS (SELECT query_id, {sql_signals(sql_tokens('query_text'))} AS qs FROM search_queries), k AS (SELECT id AS chunk_id, {sql_signals(sql_tokens(T))} AS cs FROM chunks), h AS (SELECT DISTINCT query_id, chunk_id FROM search_hits) SELECT query_id, chunk_id FROM h JOIN q USING (query_id) JOIN k USING (chunk_id) WHERE list_has_any(cs, qs)")
def flt06_any_evidence(t):
    q = t.search_queries.select("query_id", tx.signals(tx.search_tokens(F.col("query_text"))).alias("qs"))
    k = t.chunks.select(F.col("id").alias("chunk_id"), tx.signals(tx.search_tokens(F.col(T))).alias("cs"))
    return t.search_hits.select("query_id", "chunk_id").distinct().join(q, "query_id").join(k, "chunk_id").where(F.arrays_overlap("cs", "qs")).select("query_id", "chunk_id")


@query(f"WITH {_LAST2}, tk AS (SELECT query_id, chunk_id, score FROM lx WHERE leg = 'fusion' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20) SELECT query_id, chunk_id, round(score, 6) AS score FROM tk JOIN chunks c ON c.id = tk.chunk_id WHERE lower(trim(c.file_type)) = 'markdown' AND contains(c.file_path, 'a')")
def flt03_filter_after_top(t):
    top = lexical.top_k(_leg(t, "fusion"), 20, ["query_id"])
    c = t.chunks.where((F.lower(F.trim("file_type")) == "markdown") & F.col("file_path").contains("a")).select(F.col("id").alias("chunk_id"))
    return top.join(c, "chunk_id").select("query_id", "chunk_id", _R(F.col("score")).alias("score"))


@query(f"WITH {_LAST2}, s AS (SELECT id FROM knowledge_bases WHERE class_name = 'manuals' AND status IN ('ready', 'stale')) SELECT query_id, kb_id, chunk_id, leg FROM lx WHERE kb_id IN (SELECT id FROM s)")
def flt01_scope(t):
    scope = t.knowledge_bases.where((F.col("class_name") == "manuals") & F.col("status").isin("ready", "stale")).select(F.col("id").alias("kb_id"))
    return _latest_hits(t).where("score is not null").join(scope, "kb_id", "left_semi").select("query_id", "kb_id", "chunk_id", "leg")


@query(f"WITH {_LAST2}, p AS (SELECT query_id, chunk_id, min(CASE leg WHEN 'adjusted' THEN 0 WHEN 'fusion' THEN 1 WHEN 'vector' THEN 2 ELSE 3 END) AS o FROM lx GROUP BY ALL) SELECT query_id, chunk_id, CASE o WHEN 0 THEN 'adjusted' WHEN 1 THEN 'fusion' WHEN 2 THEN 'vector' ELSE 'bm25' END AS leg FROM p")
def agg09_first_leg(t):
    order = F.array_position(F.array(*map(F.lit, ["adjusted", "fusion", "vector", "bm25"])), F.col("leg"))
    return _latest_hits(t).where("score is not null").groupBy("query_id", "chunk_id").agg(F.min_by("leg", order).alias("leg"))


@query(f"WITH {_LAST2} SELECT query_id, chunk_id, leg, round(score, 6) AS score FROM lx WHERE leg IN ('bm25', 'vector')")
def set01_union_legs(t):
    legs = _leg(t, "bm25").unionByName(_leg(t, "vector"))
    return legs.select("query_id", "chunk_id", "leg", _R(F.col("score")).alias("score"))


@query(f"WITH {_LAST2} SELECT query_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT chunk_id) FILTER (WHERE leg = 'bm25') AS lexical, count(DISTINCT chunk_id) FILTER (WHERE leg = 'vector') AS semantic FROM lx GROUP BY query_id")
def set02_leg_keys(t):
    h = _latest_hits(t).where("score is not null")
    n = lambda leg: F.count_distinct(F.when(F.col("leg") == leg, F.col("chunk_id")))
    return h.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("chunks"), n("bm25").alias("lexical"), n("vector").alias("semantic"))


@query(f"WITH {_LAST2}, p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM lx WHERE leg = 'fusion'), f AS (SELECT query_id, chunk_id, pos, c.kb_id || ':' || c.file_path AS fk FROM p JOIN chunks c ON c.id = p.chunk_id WHERE c.file_path IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, fk ORDER BY pos) - 1 AS round, min(pos) OVER (PARTITION BY query_id, fk) AS fo FROM f) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round, fo)::INT AS place FROM r")
def win04_interleave(t):
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    p = _leg(t, "fusion").select("query_id", "chunk_id", F.row_number().over(w).alias("pos"))
    c = t.chunks.where("file_path is not null").select(F.col("id").alias("chunk_id"), F.concat("kb_id", F.lit(":"), "file_path").alias("fk"))
    return ranking.interleave(p.join(c, "chunk_id"), "query_id", "fk", "pos").select("query_id", "chunk_id", "place")


@query(f"WITH {_LAST2}, o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos, count(*) OVER (PARTITION BY query_id) AS total FROM lx WHERE leg = 'fusion') SELECT query_id, chunk_id, total AS total_count, total > 15 AS has_more FROM o WHERE pos > 10 AND pos <= 15")
def srt06_page(t):
    h = _leg(t, "fusion").select("query_id", "chunk_id", "score")
    page = lexical.top_k(h, 15, ["query_id"]).where("rank > 10")  # a group limit before the shuffle
    total = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_count"))
    return page.join(total, "query_id").select("query_id", "chunk_id", "total_count", (F.col("total_count") > 15).alias("has_more"))


@query(f"WITH {_LAST2} SELECT query_id, chunk_id, round(1 / (1 + exp(-score)), 6) AS relevance FROM lx WHERE leg = 'adjusted'")
def sco16_rerank_sigmoid(t):
    return _leg(t, "adjusted").select("query_id", "chunk_id", _R(1 / (1 + F.exp(-F.col("score")))).alias("relevance"))


@query(None)
def sco13_diversify(t):
    top = lexical.top_k(_leg(t, "fusion"), 50, ["query_id"])
    c = t.chunks.select(F.col("id").alias("chunk_id"), "file_path", F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), tx.search_tokens(F.col(T)).alias("tokens"))
    return ranking.diversify(top.join(c, "chunk_id"))


# Formula leg. A query's formulas are those of its five best chunks: a search by example.
_BEST5 = "b5 AS (SELECT query_id, chunk_id FROM lx WHERE leg = 'adjusted' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5)"
_ASKF = f"{_LAST2}, {_BEST5}, fm AS (SELECT DISTINCT id, kb_id, chunk_id, normalized, content_tokenized FROM formulas), af AS (SELECT DISTINCT query_id, normalized FROM b5 JOIN fm USING (chunk_id) WHERE normalized IS NOT NULL)"
_FUZZY = (
    f"fp AS (SELECT kb_id, id, unnest(w) AS term FROM (SELECT kb_id, id, {sql_terms('content_tokenized')} AS w FROM fm)), fl AS (SELECT id, len({sql_terms('coalesce(content_tokenized, $$$$)')}) AS dl FROM fm), fst AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM fl), "
    f"aterm AS (SELECT DISTINCT query_id, unnest({sql_terms('normalized')}) AS term FROM af), ftf AS (SELECT term, kb_id, id, count(*) AS tf FROM fp WHERE term IN (SELECT term FROM aterm) GROUP BY ALL), fdf AS (SELECT term, count(*) AS df FROM ftf GROUP BY term), "
    "fw AS (SELECT term, kb_id, id, (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM ftf JOIN fdf USING (term) JOIN fl USING (id), fst), "
    "fsum AS (SELECT query_id, kb_id, id, round(sum(w), 9) AS score FROM fw JOIN aterm USING (term) GROUP BY ALL), ftop AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, id) AS rank FROM fsum QUALIFY rank <= 50), frank AS (SELECT *, count(*) OVER (PARTITION BY query_id, kb_id) AS n FROM ftop), "
    "fsc AS (SELECT query_id, chunk_id, max(s) AS fscore FROM (SELECT query_id, chunk_id, 0.8 * (n - rank + 1) / n AS s FROM frank JOIN fm USING (id) UNION ALL SELECT query_id, chunk_id, 1.0 FROM af JOIN fm USING (normalized)) GROUP BY ALL)"
)


def _asked_formulas(t):
    best = lexical.top_k(_leg(t, "adjusted"), 5, ["query_id"]).select("query_id", "chunk_id")
    return best.join(t.formulas.select("chunk_id", "normalized"), "chunk_id").where("normalized is not null").select("query_id", "normalized").distinct()


def _formula_scores(t):
    return retrieval.formula_scores(_asked_formulas(t), t.formulas).groupBy("query_id", "chunk_id").agg(F.max("formula_score").alias("fscore"))


@query(f"WITH {_ASKF} SELECT DISTINCT query_id, chunk_id, normalized FROM af JOIN fm USING (normalized)")
def flt09_exact_formula(t):
    return _asked_formulas(t).join(t.formulas.select("chunk_id", "normalized").distinct(), "normalized").select("query_id", "chunk_id", "normalized")


@query(f"WITH {_ASKF}, {_FUZZY} SELECT query_id, kb_id, id, rank::INT AS rank FROM frank")
def jn02_formula_postings(t):
    """Formula postings joined with the queries' formulas: the ranked matches of each base."""
    return retrieval.formula_candidates(_asked_formulas(t), t.formulas).select("query_id", "kb_id", "id", "rank")


@query(f"WITH {_ASKF}, {_FUZZY} SELECT query_id, kb_id, id, round(0.8 * (n - rank + 1) / n, 6) AS score FROM frank")
def win02_rank_score(t):
    r = retrieval.formula_candidates(_asked_formulas(t), t.formulas)
    return r.select("query_id", "kb_id", "id", _R(F.lit(retrieval.FUZZY_TOP) * (F.col("n") - F.col("rank") + 1) / F.col("n")).alias("score"))


@query(f"WITH {_ASKF}, {_FUZZY} SELECT query_id, chunk_id, round(fscore, 6) AS formula_score FROM fsc")
def agg08_formula_score(t):
    return _formula_scores(t).select("query_id", "chunk_id", _R(F.col("fscore")).alias("formula_score"))


@query(f"WITH {_ASKF}, {_FUZZY} SELECT query_id, chunk_id, round(score + 0.35 * coalesce(fscore, 0), 6) AS score FROM lx LEFT JOIN fsc USING (query_id, chunk_id) WHERE leg = 'fusion'")
def sco10_formula_boost(t):
    h = _leg(t, "fusion").join(_formula_scores(t), ["query_id", "chunk_id"], "left")
    return h.select("query_id", "chunk_id", _R(F.col("score") + ranking.FORMULA_BOOST * F.coalesce("fscore", F.lit(0.0))).alias("score"))


@query(f"WITH {_ASKF}, {_FUZZY}, {_KB}, inj AS (SELECT query_id, chunk_id, fscore, trust FROM fsc JOIN (SELECT id AS chunk_id, kb_id FROM chunks) c USING (chunk_id) JOIN kb USING (kb_id) ANTI JOIN lx USING (query_id, chunk_id)) SELECT query_id, chunk_id, round(fscore * trust, 6) AS score FROM inj QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fscore, 9) DESC, chunk_id) <= 5")
def srt09_formula_injection(t):
    h = _latest_hits(t).where("score is not null").select("query_id", "chunk_id").distinct()
    c = t.chunks.select(F.col("id").alias("chunk_id"), "kb_id").join(_scope(t), "kb_id")
    new = _formula_scores(t).join(h, ["query_id", "chunk_id"], "left_anti").join(c, "chunk_id").withColumn("fscore", F.round("fscore", 9))
    return lexical.top_k(new, retrieval.FORMULA_INJECTED, ["query_id"], "fscore").select("query_id", "chunk_id", _R(F.col("fscore") * F.col("trust")).alias("score"))


_BOOSTED = f"bz AS (SELECT query_id, chunk_id, adj + 0.35 * coalesce(fscore, 0) AS adj, sb, qs FROM z LEFT JOIN fsc USING (query_id, chunk_id))"


@query(
    f"WITH {_ASKF}, {_FUZZY}, {_HYBRID.replace('rx AS (SELECT * FROM ro', 'rx AS (SELECT * FROM ro')}, {_sql_adjust('hf')}, {_COV}, {_BOOSTED}, g AS (SELECT query_id, chunk_id, adj, sb, len(qs) AS n, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(cs, qs)) / len(qs) END AS cov FROM bz JOIN k USING (chunk_id)), "
    "inj AS (SELECT query_id, chunk_id, fscore, trust FROM fsc JOIN (SELECT id AS chunk_id, kb_id FROM chunks) c USING (chunk_id) JOIN kb USING (kb_id) ANTI JOIN z USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fscore, 9) DESC, chunk_id) <= 5), "
    f"al AS (SELECT query_id, chunk_id, round(adj, 6) AS score, 'retrieved' AS reason FROM g WHERE {_GATE} UNION ALL SELECT query_id, chunk_id, round(fscore * trust, 6), 'formula' FROM inj) SELECT query_id, chunk_id, score, reason, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM al QUALIFY rank <= 10"
)
def ret08_formula_search(t):
    """Hybrid search with the formula leg: boosts before the gate, injected chunks behind it."""
    scores = lambda: retrieval.formula_scores(_asked_formulas(t), t.formulas, _scope(t)).groupBy("query_id", "chunk_id").agg(F.max("formula_score").alias("formula_score"))
    return _best_rows(t, 10, 6, formula=scores).select("query_id", "chunk_id", "score", "reason", "rank")


# Context. Seeds are the chunks that are among some query's five best hits by fusion.
_SEEDS = f"{_LAST2}, sd AS (SELECT DISTINCT chunk_id AS sid FROM (SELECT chunk_id FROM lx WHERE leg = 'fusion' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5)), s AS (SELECT c.* FROM chunks c JOIN sd ON sd.sid = c.id)"


def _seeds(t):
    top = lexical.top_k(_leg(t, "fusion"), 5, ["query_id"]).select(F.col("chunk_id").alias("id")).distinct()
    return t.chunks.join(top, "id", "left_semi")


@query("SELECT id AS chunk_id, kb_id, CASE WHEN file_path IS NULL THEN '' ELSE coalesce(lag(id) OVER w, '') END AS before, CASE WHEN file_path IS NULL THEN '' ELSE coalesce(lead(id) OVER w, '') END AS after FROM chunks WINDOW w AS (PARTITION BY kb_id, file_path ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, id)")
def ret14_neighbours(t):
    """The chunks before and after each chunk of a file; a chunk without a file has none."""
    from fathomgrid.operators.maintenance import neighbours

    c = t.chunks.where("file_path is not null")
    found = neighbours(c).join(c.select(F.col("id").alias("chunk_id"), "kb_id"), "chunk_id").select("chunk_id", "kb_id", "before", "after")
    return found.unionByName(t.chunks.where("file_path is null").select(F.col("id").alias("chunk_id"), "kb_id", F.lit("").alias("before"), F.lit("").alias("after")))


@query(f"WITH {_SEEDS} SELECT s.id AS seed_id, c.id AS chunk_id FROM s JOIN chunks c ON s.kb_id = c.kb_id AND s.file_path = c.file_path AND c.end_line >= s.start_line - 20 AND c.start_line <= s.end_line + 20")
def jn10_context_window(t):
    from fathomgrid.operators.maintenance import context_windows

    return context_windows(_seeds(t), t.chunks).select("seed_id", "chunk_id")


_REL = "CASE WHEN c.id = s.id THEN 0 WHEN NOT (coalesce(s.sym, s.kind, s.par, '') <> '' OR len(s.sc) > 0) OR NOT (coalesce(c.sym, c.kind, c.par, '') <> '' OR len(c.sc) > 0) THEN 0 WHEN len(s.sc) > 1 AND len(c.sc) > 1 AND s.sc[1:len(s.sc) - 1] = c.sc[1:len(c.sc) - 1] THEN CASE WHEN s.sym IS NOT DISTINCT FROM c.sym THEN 0.35 ELSE 1.35 END WHEN coalesce(s.par, '') <> '' AND s.par IS NOT DISTINCT FROM c.par THEN CASE WHEN s.sym IS NOT DISTINCT FROM c.sym THEN 0.35 ELSE 1.2 END WHEN (len(s.sc) > 0 AND len(s.sc) < len(c.sc) AND c.sc[1:len(s.sc)] = s.sc) OR (len(c.sc) > 0 AND len(c.sc) < len(s.sc) AND s.sc[1:len(c.sc)] = c.sc) THEN 0.9 ELSE 0 END"
_AD = (
    f"{_LAST2}, sd AS (SELECT query_id, chunk_id AS sid FROM lx WHERE leg = 'fusion' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5), "
    "cm AS (SELECT id, kb_id, coalesce(file_path, '') AS fp, coalesce(start_line, 1) AS sl, coalesce(end_line, start_line, 1) AS el, content, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS j FROM chunks), "
    f"cx AS (SELECT *, j->>'$.symbol' AS sym, j->>'$.symbol_kind' AS kind, j->>'$.parent_symbol' AS par, coalesce(j->>'$.scope[*]', []) AS sc, {sql_signals(sql_tokens('content'))} AS cs FROM cm), q AS (SELECT query_id, {sql_signals(sql_tokens('query_text'))} AS qs FROM search_queries), "
    f"p AS (SELECT sd.query_id, s.id AS seed_id, c.id AS chunk_id, c.sl, c.el, CASE WHEN c.id = s.id THEN 2 ELSE {_REL} END + 1 / (1 + (CASE WHEN c.id = s.id THEN 0 ELSE least(abs(c.sl - s.sl), abs(c.el - s.el)) END) / 20.0) + CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(coalesce(c.cs, []), qs)) / len(qs) END AS score "
    "FROM sd JOIN cx s ON s.id = sd.sid JOIN q ON q.query_id = sd.query_id JOIN cx c ON s.kb_id = c.kb_id AND s.fp = c.fp AND (c.id = s.id OR (c.el >= greatest(1, s.sl - 80) AND c.sl <= s.el + 80)))"
)


def _adaptive(t):
    seeds = lexical.top_k(_leg(t, "fusion"), 5, ["query_id"]).select("query_id", "chunk_id", "score")
    return retrieval.adaptive_scores(seeds, t.chunks, t.search_queries)


@query(f"WITH {_AD} SELECT query_id, seed_id, chunk_id, round(score, 6) AS score FROM p")
def sco14_adaptive_score(t):
    return _adaptive(t).select("query_id", "seed_id", "chunk_id", _R(F.col("adaptive")).alias("score"))


@query(f"WITH {_AD} SELECT query_id, seed_id, chunk_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id, seed_id ORDER BY round(score, 9) DESC, sl, el, chunk_id) <= 3")
def win11_adaptive_neighbours(t):
    w = Window.partitionBy("query_id", "seed_id").orderBy(F.col("adaptive").desc(), "start_line", "end_line", "chunk_id")
    return _adaptive(t).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("query_id", "seed_id", "chunk_id")


@query("WITH o AS (SELECT kb_id, file_path, id, length(content) AS n, coalesce(sum(length(content) + 2) OVER (PARTITION BY kb_id, file_path ORDER BY start_line, end_line NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM chunks WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND content IS NOT NULL) SELECT id, least(n, 4000 - used) AS taken FROM o WHERE used < 4000")
def win06_context_budget(t):
    w = Window.partitionBy("kb_id", "file_path").orderBy("start_line", "end_line", "id")
    c = t.chunks.where("file_path is not null and start_line is not null and content is not null")
    used = F.coalesce(F.sum(F.length("content") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return c.select("id", F.length("content").alias("n"), used.alias("used")).where("used < 4000").select("id", F.least(F.col("n").cast("long"), 4000 - F.col("used")).alias("taken"))


@query(
    f"WITH {_LAST2}, h AS (SELECT query_id, chunk_id FROM lx WHERE leg = 'fusion' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10), d AS (SELECT query_id, id, kb_id, file_path, start_line AS s, end_line AS e FROM h JOIN chunks ON id = chunk_id WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL) "
    "SELECT a.query_id, a.id, b.id AS other, (CASE WHEN a.kb_id <> b.kb_id OR a.file_path <> b.file_path THEN 0 WHEN greatest(a.s, b.s) <= least(a.e, b.e) THEN 1.0 WHEN greatest(a.s, b.s) - least(a.e, b.e) <= 20 THEN 0.8 WHEN greatest(a.s, b.s) - least(a.e, b.e) <= 80 THEN 0.45 ELSE 0.2 END)::DOUBLE AS proximity FROM d a JOIN d b ON a.query_id = b.query_id AND a.id < b.id"
)
def sco12_line_proximity(t):
    """How near the ten best hits of a query stand to each other: what diversity weighs."""
    h = lexical.top_k(_leg(t, "fusion"), 10, ["query_id"]).select("query_id", F.col("chunk_id").alias("id"))
    d = h.join(t.chunks.where("start_line is not null and end_line is not null and file_path is not null").select("id", "kb_id", "file_path", "start_line", "end_line"), "id")
    o = d.select("query_id", F.col("id").alias("other"), F.col("kb_id").alias("k1"), F.col("file_path").alias("p1"), F.col("start_line").alias("s1"), F.col("end_line").alias("e1"))
    gap = F.greatest("start_line", "s1") - F.least("end_line", "e1")
    near = F.when((F.col("kb_id") != F.col("k1")) | (F.col("file_path") != F.col("p1")), 0.0).when(gap <= 0, 1.0).when(gap <= 20, 0.8).when(gap <= 80, 0.45).otherwise(0.2)
    return d.join(o, "query_id").where("id < other").select("query_id", "id", "other", near.alias("proximity"))  # at most 45 pairs a query


# Evaluation: what a query expects is the file of its best adjusted chunk; what it gets are the ten best of a leg.
@query(
    f"WITH {_LAST2}, gd AS (SELECT query_id, file_path AS want FROM (SELECT query_id, chunk_id FROM lx WHERE leg = 'adjusted' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1) JOIN chunks ON id = chunk_id WHERE file_path IS NOT NULL), "
    "rs AS (SELECT query_id, file_path, score FROM (SELECT query_id, chunk_id, score FROM lx WHERE leg = 'bm25' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10) JOIN chunks ON id = chunk_id), "
    "oc AS (SELECT coalesce(mode, 'hybrid') AS domain, gd.query_id, max((rs.file_path IS NOT NULL AND rs.file_path = want)::INT) AS hit FROM gd JOIN search_queries USING (query_id) LEFT JOIN rs USING (query_id) GROUP BY ALL) "
    "SELECT domain, count(*) AS queries, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS recall FROM oc GROUP BY ROLLUP (domain)"
)
def agg18_recall_at_10(t):
    top = lexical.top_k(_leg(t, "adjusted"), 1, ["query_id"]).select("query_id", F.col("chunk_id").alias("id"))
    files = t.chunks.select("id", "file_path")
    golden = top.join(files.where("file_path is not null"), "id").join(t.search_queries, "query_id").select("query_id", F.coalesce("mode", F.lit("hybrid")).alias("domain"), "file_path")
    got = lexical.top_k(_leg(t, "bm25"), 10, ["query_id"]).select("query_id", F.col("chunk_id").alias("id"), "rank", "score").join(files, "id")
    return evaluation.recall(evaluation.outcomes(golden, got, 10)).withColumn("recall", _R(F.col("recall")))
