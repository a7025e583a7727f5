"""Catalogue, maintenance, symbols, label graph, joins, sets and change streams over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomgrid.operators import maintenance as mt
from fathomgrid.plans.registry import query

_R = lambda c: F.round(c, 6)
_ONE = F.lit


def _count():
    return F.count(F.lit(1))


@query("SELECT chunk_id, kb_id, len(embedding) AS dim FROM chunk_vectors WHERE embedding IS NOT NULL")
def src20_vector_scan(t):
    return t.chunk_vectors.where("embedding is not null").select("chunk_id", "kb_id", F.size("embedding").alias("dim"))


@query("SELECT kb_id, id, content_hash, start_line, end_line FROM chunks WHERE kb_id IS NOT NULL")
def src21_base_scan(t):
    """The scan of every base: the rows carry their base."""
    return t.chunks.where("kb_id is not null").select("kb_id", "id", "content_hash", "start_line", "end_line")


@query("SELECT id, name, status FROM knowledge_bases WHERE name LIKE '%robotics%'")
def src22_lookup(t):
    return t.knowledge_bases.where(F.col("name").contains("robotics")).select("id", "name", "status")


@query("SELECT id, chunk_id, ordinal, normalized FROM formulas WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE length(content) > 1000) UNION ALL SELECT id, chunk_id, ordinal, upper(normalized) FROM formulas WHERE chunk_id IN (SELECT id FROM chunks WHERE length(content) > 1000)")
def snk02_replace_per_key(t):
    long = t.chunks.where(F.length("content") > 1000).select(F.col("id").alias("chunk_id"))
    f = t.formulas.select("id", "chunk_id", "ordinal", "normalized")
    return mt.replace_per_key(f, f.withColumn("normalized", F.upper("normalized")), "chunk_id", long)


@query("SELECT id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM formulas)")
def snk03_delete_by_ids(t):
    return t.chunks.select("id").join(t.formulas.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")


@query("SELECT 'chunks' AS tbl, count(*) AS rows FROM chunks WHERE kb_id NOT IN (SELECT id FROM knowledge_bases WHERE status = 'error') UNION ALL SELECT 'formulas', count(*) FROM formulas WHERE kb_id NOT IN (SELECT id FROM knowledge_bases WHERE status = 'error') UNION ALL SELECT 'chunk_vectors', count(*) FROM chunk_vectors WHERE kb_id NOT IN (SELECT id FROM knowledge_bases WHERE status = 'error')")
def snk04_cascade_delete(t):
    gone = t.knowledge_bases.where("status = 'error'").select(F.col("id").alias("kb_id"))
    left = lambda name: getattr(t, name).join(gone, "kb_id", "left_anti").agg(_count().alias("rows")).select(F.lit(name).alias("tbl"), "rows")
    return left("chunks").unionByName(left("formulas")).unionByName(left("chunk_vectors"))


_JOBS = "SELECT job_seq, kb_id, operation, status, phase FROM indexing_jobs QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY updated_at DESC NULLS LAST, job_seq DESC) = 1"


def _last_jobs(t):
    j = t.indexing_jobs.select("job_seq", "kb_id", "operation", "status", "phase", "updated_at", "started_at", "last_progress_at", "error_message")
    return mt.latest(j, ["kb_id"], [F.col("updated_at"), F.col("job_seq")])


@query(_JOBS)
def snk05_job_upsert(t):
    return _last_jobs(t).select("job_seq", "kb_id", "operation", "status", "phase")


@query("SELECT kb_id, arg_max(message, (updated_at, job_seq)) FILTER (WHERE message IS NOT NULL) AS message, max(processed_chunks) AS processed FROM indexing_jobs GROUP BY kb_id")
def snk05_progress_patch(t):
    keep = F.max(F.when(F.col("message").isNotNull(), F.struct("updated_at", "job_seq", "message")))["message"]
    return t.indexing_jobs.groupBy("kb_id").agg(keep.alias("message"), F.max("processed_chunks").alias("processed"))


@query("SELECT k.id, k.name, coalesce(c.n, 0) AS chunk_count, coalesce(c.f, 0) AS file_count, k.chunk_count IS DISTINCT FROM coalesce(c.n, 0) AS was_stale FROM knowledge_bases k LEFT JOIN (SELECT kb_id, count(*) AS n, count(DISTINCT file_path) AS f FROM chunks GROUP BY kb_id) c ON c.kb_id = k.id")
def snk06_counter_refresh(t):
    c = t.chunks.groupBy("kb_id").agg(_count().alias("n"), F.count_distinct("file_path").alias("f"))
    k = t.knowledge_bases.join(c, F.col("id") == F.col("kb_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return k.select("id", "name", n.alias("chunk_count"), F.coalesce("f", F.lit(0)).alias("file_count"), (~F.col("chunk_count").eqNullSafe(n)).alias("was_stale"))


@query("SELECT kb_id, count(*) AS chunks FROM chunks GROUP BY kb_id")
def agg01_chunks_per_base(t):
    return t.chunks.groupBy("kb_id").agg(_count().alias("chunks"))


@query("SELECT kb_id, count(DISTINCT file_path) AS files FROM chunks GROUP BY kb_id")
def agg02_files_per_base(t):
    return t.chunks.groupBy("kb_id").agg(F.count_distinct("file_path").alias("files"))


@query("SELECT count(*) AS symbols FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM chunks) WHERE regexp_matches(line, '^#{2} ')")
def agg03_filtered_symbols(t):
    return t.chunks.select(F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike("^#{2} ")).agg(_count().alias("symbols"))


@query("SELECT DISTINCT chunk_id, normalized FROM formulas")
def agg04_distinct_formulas(t):
    return t.formulas.select("chunk_id", "normalized").dropDuplicates()


@query("SELECT kb_id, file_path, max(indexed_at) AS latest FROM chunks WHERE file_path IS NOT NULL GROUP BY ALL")
def agg11_latest_per_file(t):
    return t.chunks.where("file_path is not null").groupBy("kb_id", "file_path").agg(F.max("indexed_at").alias("latest"))


@query("SELECT k.id, floor(count(DISTINCT c.file_path) * 100.0 / greatest(k.file_count, 1) + 0.5)::BIGINT AS coverage_percent FROM knowledge_bases k LEFT JOIN chunks c ON c.kb_id = k.id GROUP BY k.id, k.file_count")
def agg12_coverage_percent(t):
    f = t.chunks.groupBy("kb_id").agg(F.count_distinct("file_path").alias("f"))
    k = t.knowledge_bases.join(f, F.col("id") == F.col("kb_id"), "left")
    return k.select("id", F.floor(F.coalesce("f", F.lit(0)) * 100.0 / F.coalesce(F.greatest("file_count", F.lit(1)), F.lit(1)) + 0.5).alias("coverage_percent"))


_ISSUES = (
    f"lj AS ({_JOBS}), cc AS (SELECT kb_id, count(*) AS n, count(DISTINCT file_path) AS f FROM chunks GROUP BY kb_id), cv AS (SELECT DISTINCT kb_id FROM chunk_vectors WHERE embedding IS NOT NULL), "
    "iss AS (SELECT id, 'blocking' AS severity, 'error_state' AS code FROM knowledge_bases WHERE status = 'error' UNION ALL SELECT id, 'blocking', 'vectors_missing' FROM knowledge_bases JOIN cc ON cc.kb_id = id WHERE id NOT IN (SELECT kb_id FROM cv) UNION ALL "
    "SELECT id, 'warning', 'coverage' FROM knowledge_bases LEFT JOIN cc ON cc.kb_id = id WHERE coalesce(f, 0) * 100.0 / greatest(file_count, 1) < 80 UNION ALL SELECT id, 'info', 'job_failed' FROM knowledge_bases JOIN lj ON lj.kb_id = id WHERE lj.status = 'failed')"
)


def _issues(t):
    k = t.knowledge_bases.select("id", "status", "file_count")
    c = t.chunks.groupBy(F.col("kb_id").alias("id")).agg(_count().alias("n"), F.count_distinct("file_path").alias("f"))
    v = t.chunk_vectors.where("embedding is not null").select(F.col("kb_id").alias("id")).distinct()
    row = lambda df, s, code: df.select("id", F.lit(s).alias("severity"), F.lit(code).alias("code"))
    low = k.join(c, "id", "left").where(F.coalesce("f", F.lit(0)) * 100.0 / F.greatest("file_count", F.lit(1)) < 80)
    failed = _last_jobs(t).where("status = 'failed'").select(F.col("kb_id").alias("id"))
    return row(k.where("status = 'error'"), "blocking", "error_state").unionByName(row(k.join(c, "id").join(v, "id", "left_anti"), "blocking", "vectors_missing")).unionByName(row(low, "warning", "coverage")).unionByName(row(k.join(failed, "id"), "info", "job_failed"))


@query(f"WITH {_ISSUES} SELECT id, severity, code FROM iss")
def ret16_diagnose(t):
    return _issues(t)


_NOW = "TIMESTAMPTZ '2026-01-01 00:00:00+00'"
_DOC = (
    "cc AS (SELECT kb_id, count(DISTINCT file_path) AS f FROM chunks GROUP BY kb_id), jr AS (SELECT kb_id, max(last_progress_at) AS pr FROM indexing_jobs WHERE status = 'running' GROUP BY kb_id), "
    "sy AS (SELECT DISTINCT kb_id FROM (SELECT kb_id, unnest(string_split(content, chr(10))) AS line FROM chunks) WHERE regexp_matches(line, '^#{1,6} +[^ ]')), cv AS (SELECT DISTINCT kb_id FROM chunk_vectors WHERE embedding IS NOT NULL), "
    f"kb AS (SELECT id AS kb_id, status, coalesce(chunk_count, 0) AS n, floor(coalesce(f, 0) * 100.0 / greatest(file_count, 1) + 0.5)::BIGINT AS pc, epoch_us({_NOW}) - epoch_us(coalesce(pr, updated_at)) AS age FROM knowledge_bases LEFT JOIN cc ON cc.kb_id = id LEFT JOIN jr ON jr.kb_id = id), "
    "iss AS (SELECT kb_id, 'blocking' AS severity, 'stuck_indexing' AS code, 35 AS p FROM kb WHERE status = 'indexing' AND age > 600000000 UNION ALL SELECT kb_id, 'blocking', 'error_state', 35 FROM kb WHERE status = 'error' UNION ALL SELECT kb_id, 'blocking', 'vectors_missing', 35 FROM kb WHERE n > 0 AND kb_id NOT IN (SELECT kb_id FROM cv) "
    "UNION ALL SELECT kb_id, 'warning', 'coverage', 12 FROM kb WHERE pc < 80 UNION ALL SELECT kb_id, 'info', 'no_symbols', 2 FROM kb WHERE status = 'ready' AND n > 0 AND kb_id NOT IN (SELECT kb_id FROM sy WHERE kb_id IS NOT NULL))"
)


@query(f"WITH {_DOC} SELECT kb.kb_id, severity, code, greatest(0, 100 - coalesce(sum(p) OVER (PARTITION BY kb.kb_id), 0))::INT AS health FROM kb LEFT JOIN iss USING (kb_id)")
def ret17_doctor(t):
    """All rules over the bases, with the time of the judgement given."""
    f = t.chunks.groupBy("kb_id").agg(F.count_distinct("file_path").alias("f"))
    k = t.knowledge_bases.select(F.col("id").alias("kb_id"), "status", "chunk_count", "file_count", "updated_at")
    covered = k.join(f, "kb_id", "left").select("kb_id", F.floor(F.coalesce("f", F.lit(0)) * 100.0 / F.coalesce(F.greatest("file_count", F.lit(1)), F.lit(1)) + 0.5).alias("percent"))
    jobs = t.indexing_jobs.where("status = 'running'").select("kb_id", F.col("last_progress_at").alias("progress_at"))
    found = mt.doctor(k, t.chunks.select("kb_id"), t.chunk_vectors.where("embedding is not null").select("kb_id"), _symbols(t).select("kb_id"), jobs, covered, F.lit("2026-01-01 00:00:00+00").cast("timestamp"))
    return found.select("kb_id", "severity", "code", "health")


@query(f"WITH {_ISSUES} SELECT id, greatest(0, 100 - sum(CASE severity WHEN 'blocking' THEN 35 WHEN 'warning' THEN 12 ELSE 2 END))::BIGINT AS health FROM iss GROUP BY id")
def agg13_health_score(t):
    p = F.when(F.col("severity") == "blocking", 35).when(F.col("severity") == "warning", 12).otherwise(2)
    return _issues(t).groupBy("id").agg(F.greatest(F.lit(0).cast("long"), 100 - F.sum(p)).alias("health"))


@query("SELECT status, count(*) AS bases, sum(coalesce(chunk_count, 0))::BIGINT AS chunks FROM knowledge_bases GROUP BY ROLLUP (status)")
def agg14_status_totals(t):
    return t.knowledge_bases.rollup("status").agg(_count().alias("bases"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks"))


@query("SELECT kb_id, file_path, min(start_line) AS first_line, max(end_line) AS last_line, sha256(string_agg(content, chr(10) || chr(10) ORDER BY start_line, end_line NULLS FIRST, id)) AS content_hash, sum(length(content))::BIGINT AS n_chars FROM chunks WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND content IS NOT NULL GROUP BY ALL")
def agg15_file_contents(t):
    """The whole contents of each file's chunks, joined in order as in a context; the query gives their hash."""
    g = mt.file_contents(t.chunks.where("content is not null"))
    return g.select("kb_id", "file_path", "first_line", "last_line", F.sha2("content", 256).alias("content_hash"), "n_chars")


@query("SELECT kb_id, class_name, count(*) AS chunks FROM chunks c JOIN knowledge_bases k ON k.id = c.kb_id GROUP BY ALL")
def jn16_chunks_with_base(t):
    k = t.knowledge_bases.select(F.col("id").alias("kb_id"), "class_name")
    return t.chunks.groupBy("kb_id").agg(_count().alias("chunks")).join(k, "kb_id").select("kb_id", "class_name", "chunks")


@query("SELECT name, source_type, chunk_count, updated_at, row_number() OVER (ORDER BY updated_at DESC, name)::INT AS place FROM knowledge_bases")
def agg19_base_listing(t):
    w = Window.orderBy(F.col("updated_at").desc(), "name")  # the bases are a small, fixed table
    return t.knowledge_bases.select("name", "source_type", "chunk_count", "updated_at", F.row_number().over(w).alias("place"))


@query("SELECT DISTINCT c.id, h.query_id FROM search_hits h JOIN chunks c ON c.id = h.chunk_id")
def jn04_hits_with_chunks(t):
    h = t.search_hits.select("query_id", F.col("chunk_id").alias("id")).distinct()
    return h.join(t.chunks.select("id"), "id").select("id", "query_id")


@query("SELECT v.chunk_id, c.file_path FROM (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL) v JOIN chunks c ON c.id = v.chunk_id")
def jn13_chunks_with_vectors(t):
    v = t.chunk_vectors.where("embedding is not null").select("chunk_id").distinct()
    return v.join(t.chunks.select(F.col("id").alias("chunk_id"), "file_path"), "chunk_id")


@query("SELECT query_id, chunk_id FROM (SELECT DISTINCT query_id, chunk_id FROM search_hits) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE embedding IS NOT NULL)")
def jn06_hits_without_vector(t):
    h = t.search_hits.select("query_id", "chunk_id").distinct()
    return h.join(t.chunk_vectors.where("embedding is not null").select("chunk_id").distinct(), "chunk_id", "left_anti").select("query_id", "chunk_id")


@query("SELECT DISTINCT kb_id FROM search_hits WHERE kb_id NOT IN (SELECT id FROM knowledge_bases WHERE status IN ('ready', 'stale'))")
def jn19_unresolved_bases(t):
    ok = t.knowledge_bases.where(F.col("status").isin("ready", "stale")).select(F.col("id").alias("kb_id"))
    return t.search_hits.select("kb_id").distinct().join(ok, "kb_id", "left_anti")


@query("SELECT id, name FROM knowledge_bases WHERE status IN ('ready', 'stale') AND coalesce(chunk_count, 0) > 0")
def flt02_searchable(t):
    return t.knowledge_bases.where(F.col("status").isin("ready", "stale") & (F.coalesce("chunk_count", F.lit(0)) > 0)).select("id", "name")


@query("SELECT DISTINCT v.chunk_id FROM chunk_vectors v JOIN knowledge_bases k ON k.id = v.kb_id WHERE len(v.embedding) = k.embedding_dimension AND contains(k.embedding_signature, 'dim=' || k.embedding_dimension)")
def flt11_embedding_compatible(t):
    k = t.knowledge_bases.where(F.expr("contains(embedding_signature, concat('dim=', embedding_dimension))")).select(F.col("id").alias("kb_id"), "embedding_dimension")
    return t.chunk_vectors.join(k, "kb_id").where(F.size("embedding") == F.col("embedding_dimension")).select("chunk_id").distinct()


@query("SELECT id, file_path || ':' || start_line || '-' || end_line AS place FROM chunks WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
def flt13_response_columns(t):
    c = t.chunks.where("file_path is not null and start_line is not null and end_line is not null")
    return c.select("id", F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("place"))


# Duplicates and reconciling: rows before the median time stand for what is stored, all rows for what is scanned.
_CUT = "(SELECT median(epoch_us(indexed_at)) FROM chunks)"


def _stored(t):
    cut = t.chunks.agg(F.median(F.unix_micros("indexed_at"))).first()[0]  # one number
    return t.chunks.where(F.unix_micros("indexed_at") <= F.lit(cut))


@query(f"WITH a AS (SELECT content_hash AS h, count(*) AS n FROM chunks WHERE epoch_us(indexed_at) <= {_CUT} GROUP BY ALL), b AS (SELECT content_hash AS h, count(*) AS n FROM chunks GROUP BY ALL) SELECT coalesce(a.h, b.h) AS hash, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS retained, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS removed, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added FROM a FULL JOIN b USING (h)")
def jn12_hash_reconcile(t):
    return mt.reconcile(_stored(t), t.chunks, "content_hash")


@query(f"SELECT content_hash, count(*) AS n FROM (SELECT content_hash FROM chunks EXCEPT ALL SELECT content_hash FROM chunks WHERE epoch_us(indexed_at) <= {_CUT}) GROUP BY content_hash")
def set04_removed(t):
    return t.chunks.select("content_hash").exceptAll(_stored(t).select("content_hash")).groupBy("content_hash").agg(_count().alias("n"))


@query(f"SELECT content_hash, count(*) AS n FROM (SELECT content_hash FROM chunks INTERSECT ALL SELECT content_hash FROM chunks WHERE epoch_us(indexed_at) <= {_CUT}) GROUP BY content_hash")
def set05_retained(t):
    return t.chunks.select("content_hash").intersectAll(_stored(t).select("content_hash")).groupBy("content_hash").agg(_count().alias("n"))


@query("SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY id)::INT AS occurrence FROM chunks")
def win10_occurrence(t):
    return mt.number_within(t.chunks.select("id", "content_hash"), "content_hash", "id")


@query("SELECT kb_id, split_part(file_path, '/', 1) AS child, count(DISTINCT file_path) AS files FROM chunks WHERE file_path IS NOT NULL GROUP BY ALL")
def set07_children(t):
    return t.chunks.where("file_path is not null").groupBy("kb_id", F.get(F.split("file_path", "/"), F.lit(0)).alias("child")).agg(F.count_distinct("file_path").alias("files"))


@query(
    "WITH a AS (SELECT DISTINCT split_part(file_path, '/', 1) AS child FROM chunks WHERE file_path IS NOT NULL), n AS (SELECT child, 'cls-' || substring(child, 1, 12) AS name FROM a), c AS (SELECT name, count(*) AS children FROM n GROUP BY name), "
    "k AS (SELECT DISTINCT coalesce(class_name, 'cls') || '-' || substring(split_part(name, '-', 2), 1, 12) AS name FROM knowledge_bases) SELECT coalesce(n.name, k.name) AS name, child, CASE WHEN child IS NULL THEN 'vanished' WHEN children > 1 THEN 'collided' WHEN k.name IS NULL THEN 'discovered' ELSE 'known' END AS state FROM n JOIN c USING (name) FULL JOIN k USING (name)"
)
def ret20_class_reconcile(t):
    """Children of a class against its bases: names are the class and twelve characters, which may collide."""
    child = t.chunks.where("file_path is not null").select(F.get(F.split("file_path", "/"), F.lit(0)).alias("child")).distinct()
    base = F.concat(F.coalesce("class_name", F.lit("cls")), F.lit("-"), F.substring(F.coalesce(F.get(F.split("name", "-"), F.lit(1)), F.lit("")), 1, 12))
    return mt.class_children(child, t.knowledge_bases.select(base.alias("name")), "cls")


# Label graph: a formula is defined by the chunks whose first formula it is, and referred to by every chunk that holds it.
_LAB = "df AS (SELECT c.id, c.kb_id, c.file_path, f.normalized AS label FROM formulas f JOIN chunks c ON c.id = f.chunk_id WHERE f.ordinal = 0 AND f.normalized IS NOT NULL), rf AS (SELECT DISTINCT c.id, c.kb_id, c.file_path, f.normalized AS label FROM formulas f JOIN chunks c ON c.id = f.chunk_id WHERE f.normalized IS NOT NULL)"
_EDGE = f"{_LAB}, fd AS (SELECT kb_id, label, file_path AS p, min(id) AS target FROM df GROUP BY ALL), ed AS (SELECT rf.id, rf.kb_id, rf.file_path, rf.label, coalesce(max(target) FILTER (WHERE p = rf.file_path), CASE WHEN count(DISTINCT p) FILTER (WHERE p <> rf.file_path) = 1 THEN max(target) FILTER (WHERE p <> rf.file_path) END) AS target FROM rf LEFT JOIN fd ON fd.kb_id = rf.kb_id AND fd.label = rf.label GROUP BY ALL)"


def _labels(t):
    c = t.chunks.select(F.col("id").alias("chunk_id"), F.col("kb_id").alias("scope"), F.col("file_path").alias("path"))
    f = t.formulas.where("normalized is not null").select("chunk_id", "ordinal", F.col("normalized").alias("label")).join(c, "chunk_id")
    return f.where("ordinal = 0").select("scope", "path", "label", F.col("chunk_id").alias("target")), f.select("scope", "chunk_id", "path", "label").distinct()


def _edges(t):
    d, r = _labels(t)
    return mt.resolve_labels(r, d)


@query(f"WITH {_LAB} SELECT kb_id AS scope, label, min(id) AS target FROM df GROUP BY ALL")
def agg10_first_definition(t):
    return _labels(t)[0].groupBy("scope", "label").agg(F.min("target").alias("target"))


@query(f"WITH {_EDGE} SELECT id AS chunk_id, label, target FROM ed")
def jn09_label_resolution(t):
    return _edges(t).select("chunk_id", "label", "target")


@query(f"WITH {_EDGE} SELECT DISTINCT id AS chunk_id, target FROM ed WHERE target IS NOT NULL")
def flt10_resolved_edges(t):
    return _edges(t).where("target is not null").select("chunk_id", "target").distinct()


@query(f"WITH {_EDGE} SELECT id AS chunk_id, label FROM ed WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY label) <= 2")
def win03_edge_cap(t):
    w = Window.partitionBy("chunk_id").orderBy("label")
    return _edges(t).where("target is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("chunk_id", "label")


@query(f"WITH {_EDGE} SELECT DISTINCT h.query_id, e.target AS chunk_id FROM (SELECT DISTINCT query_id, chunk_id FROM search_hits) h JOIN ed e ON e.id = h.chunk_id WHERE e.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_hits x WHERE x.query_id = h.query_id AND x.chunk_id = e.target)")
def ret09_dependency_injection(t):
    h = t.search_hits.select("query_id", "chunk_id").distinct()
    e = _edges(t).where("target is not null").select("chunk_id", "target")
    dep = h.join(e, "chunk_id").select("query_id", F.col("target").alias("chunk_id")).distinct()
    return dep.join(h, ["query_id", "chunk_id"], "left_anti")


# Symbols: markdown headings.
_SYM = "sy AS (SELECT id, kb_id, file_path, trim(regexp_extract(line, '^#{1,6} +(.+)$', 1), ' ') AS name, length(regexp_extract(line, '^(#{1,6}) ', 1)) AS depth FROM (SELECT id, kb_id, file_path, unnest(string_split(content, chr(10))) AS line FROM chunks) WHERE regexp_matches(line, '^#{1,6} +[^ ]'))"


def _symbols(t):
    lines = t.chunks.select("id", "kb_id", "file_path", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike("^#{1,6} +[^ ]"))
    return lines.select("id", "kb_id", "file_path", F.trim(F.regexp_extract("line", "^#{1,6} +(.+)$", 1)).alias("name"), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).alias("depth"))


@query(f"WITH {_SYM} SELECT name, file_path, CASE WHEN lower(name) = 'dense' THEN 0 WHEN starts_with(lower(name), 'dense') THEN 1 ELSE 2 END AS tier FROM sy JOIN (SELECT id AS kb FROM knowledge_bases WHERE status IN ('ready', 'stale')) k ON kb = kb_id WHERE contains(lower(name), 'dense') OR contains(lower(coalesce(file_path, '')), 'dense') ORDER BY tier, file_path NULLS FIRST, name LIMIT 200")
def ret15_symbols_by_query(t):
    """Symbols whose name or path holds the query: equal names first, then prefixes."""
    k = t.knowledge_bases.where(F.col("status").isin("ready", "stale")).select(F.col("id").alias("kb_id"))
    s = _symbols(t).join(k, "kb_id", "left_semi").select("name", F.coalesce("file_path", F.lit("")).alias("file_path"), F.lit(0).alias("line"), F.lit("heading").alias("kind"), F.lit(None).cast("string").alias("signature"))
    return mt.search_symbols(s, "dense", limit=200).select("name", F.nullif("file_path", F.lit("")).alias("file_path"), "tier")


@query(f"WITH {_SYM} SELECT DISTINCT s.name, s.file_path, s.depth FROM sy s JOIN knowledge_bases k ON k.id = s.kb_id WHERE k.status IN ('ready', 'stale') AND contains(lower(s.name), 'after') ORDER BY 1")
def ret15_symbol_search(t):
    k = t.knowledge_bases.where(F.col("status").isin("ready", "stale")).select(F.col("id").alias("kb_id"))
    return _symbols(t).join(k, "kb_id", "left_semi").where(F.lower("name").contains("after")).select("name", "file_path", "depth").distinct()


@query(f"WITH {_SYM} SELECT name, file_path, CASE WHEN lower(name) = 'dense' THEN 0 WHEN starts_with(lower(name), 'de') THEN 1 ELSE 2 END AS tier, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'dense' THEN 0 WHEN starts_with(lower(name), 'de') THEN 1 ELSE 2 END, file_path NULLS FIRST, name, depth, id)::INT AS place FROM sy WHERE contains(lower(name), 'de') QUALIFY place <= 50")
def srt07_symbol_order(t):
    s = _symbols(t).where(F.lower("name").contains("de"))
    tier = F.when(F.lower("name") == "dense", 0).when(F.lower("name").startswith("de"), 1).otherwise(2)
    top = s.withColumn("tier", tier).orderBy("tier", F.col("file_path").asc_nulls_first(), "name", "depth", "id").limit(50)  # top-k, then numbered
    w = Window.orderBy("tier", F.col("file_path").asc_nulls_first(), "name", "depth", "id")
    return top.select("name", "file_path", "tier", F.row_number().over(w).alias("place"))


@query(f"WITH {_SYM} SELECT DISTINCT kb_id, name, file_path FROM sy")
def agg16_symbol_dedupe(t):
    return _symbols(t).select("kb_id", "name", "file_path").dropDuplicates()


@query(f"WITH {_SYM} SELECT k.name AS base, count(*) AS symbols FROM sy s JOIN knowledge_bases k ON k.id = s.kb_id WHERE k.status = 'ready' GROUP BY ALL")
def jn03_symbols_with_base(t):
    k = t.knowledge_bases.where("status = 'ready'").select(F.col("id").alias("kb_id"), F.col("name").alias("base"))
    return _symbols(t).groupBy("kb_id").agg(_count().alias("symbols")).join(k, "kb_id").select("base", "symbols")


# Events as file changes: a user is a path, an event a change.
_LATEST_EV = "SELECT user_id, max(ts) AS stamp FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id"


@query(f"WITH a AS ({_LATEST_EV}), b AS (SELECT user_id, max(ts) AS stamp FROM events GROUP BY user_id HAVING count(*) > 150) SELECT coalesce(a.user_id, b.user_id) AS path, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.stamp IS DISTINCT FROM b.stamp")
def jn15_snapshot_diff(t):
    before = t.events.where("ts < timestamp '2024-01-20'").groupBy("user_id").agg(F.max("ts").alias("stamp"))
    after = t.events.groupBy("user_id").agg(F.max("ts").alias("stamp"), _count().alias("n")).where("n > 150").drop("n")
    return mt.snapshot_diff(before, after, "user_id", "stamp")


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), s AS (SELECT user_id, max(ts) AS indexed FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT l.user_id, CASE WHEN s.user_id IS NULL THEN 'unindexed' WHEN last > indexed THEN 'stale' ELSE 'fresh' END AS state FROM l LEFT JOIN s USING (user_id)")
def jn14_stale_files(t):
    seen = F.max(F.when(F.col("event_type") == "view", F.col("ts")))
    e = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), seen.alias("indexed"))
    return e.select("user_id", F.when(F.col("indexed").isNull(), "unindexed").when(F.col("last") > F.col("indexed"), "stale").otherwise("fresh").alias("state"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM g) SELECT user_id, burst, min(ts) AS first, max(ts) AS last, count(*) AS events FROM b GROUP BY ALL")
def stm03_debounce(t):
    return mt.debounce(t.events, "user_id", "ts", 3600)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stm09_tumbling(t):
    return t.events.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("hour")).agg(_count().alias("n"), _R(F.sum("value")).alias("total"))


@query("WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) SELECT event_type, start, count(*) AS n FROM w GROUP BY ALL")
def stm09_sliding(t):
    return t.events.groupBy("event_type", F.window("ts", "2 hours", "1 hour")["start"].alias("start")).agg(_count().alias("n"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def jsn03_json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT DISTINCT job_seq, epoch_ms(updated_at) AS at_ms, epoch_ms(updated_at) - epoch_ms(started_at) AS age_ms, last_progress_at IS NULL OR updated_at - last_progress_at > INTERVAL 10 MINUTE AS stuck FROM indexing_jobs WHERE updated_at IS NOT NULL")
def dat02_job_ages(t):
    j = t.indexing_jobs.where("updated_at is not null")
    stuck = F.col("last_progress_at").isNull() | (F.unix_micros("updated_at") - F.unix_micros("last_progress_at") > 600_000_000)
    return j.select("job_seq", F.unix_millis("updated_at").alias("at_ms"), (F.unix_millis("updated_at") - F.unix_millis("started_at")).alias("age_ms"), stuck.alias("stuck")).distinct()


@query("SELECT mode, arg_max(query_text, (asked_at, query_id)) AS query_text FROM search_queries WHERE asked_at IS NOT NULL GROUP BY mode")
def ret21_last_message(t):
    """The last message of each conversation (a mode's queries stand for one): what context is looked up for."""
    return t.search_queries.where("asked_at is not null").groupBy("mode").agg(F.max_by("query_text", F.struct("asked_at", "query_id")).alias("query_text"))


@query(r"SELECT id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i)[1:20], '|') AS links FROM (SELECT id, list_filter(list_transform(regexp_extract_all(content, '\[\[([^\[\]|]+)(\|[^\[\]]*)?\]\]', 1), lambda x: trim(x, ' ')), lambda x: x <> '') AS g FROM chunks WHERE contains(content, '[['))")
def agg17_capped_links(t):
    """The first twenty different links of a text, in order."""
    found = F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]|]+)(\|[^\[\]]*)?\]\]"), 1), F.trim), lambda x: x != "")
    return t.chunks.where(F.col("content").contains("[[")).select("id", F.array_join(F.slice(F.array_distinct(found), 1, 20), "|").alias("links"))


@query("SELECT id, (v->>'$.content') IS NOT DISTINCT FROM content AS whole, (v->>'$.start_line')::INT AS first_line FROM (SELECT id, content, to_json({'content': content, 'start_line': start_line}) AS v FROM chunks)")
def snk08_export_rows(t):
    """Every chunk as a line of the export, read back."""
    v = t.chunks.select("id", "content", F.struct("content", "file_path", "file_type", "start_line", "end_line", "metadata_json").alias("c"))
    back = v.select("id", "content", F.to_json("c", {"ignoreNullFields": "false"}).alias("value"))
    return back.select("id", F.get_json_object("value", "$.content").eqNullSafe(F.col("content")).alias("whole"), F.get_json_object("value", "$.start_line").cast("int").alias("first_line"))


@query("WITH h AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM chunks), s AS (SELECT id, n, line, sum(regexp_matches(line, '^#{1,6} ')::INT) OVER (PARTITION BY id ORDER BY n) AS section FROM h) SELECT id, section::BIGINT AS section, min(n) AS first_line, max(n) AS last_line FROM s GROUP BY ALL")
def win09_section_lines(t):
    w = Window.partitionBy("id").orderBy("p")
    s = t.chunks.select("id", F.posexplode(F.split("content", "\n")).alias("p", "line")).withColumn("section", F.sum(F.col("line").rlike("^#{1,6} ").cast("long")).over(w))
    return s.groupBy("id", "section").agg((F.min("p") + 1).alias("first_line"), (F.max("p") + 1).alias("last_line"))


@query("WITH l AS (SELECT kb_id, file_path, id, start_line, (CASE WHEN json_valid(metadata_json) THEN metadata_json END)->>'$.heading' AS h FROM chunks WHERE file_path IS NOT NULL AND start_line IS NOT NULL) SELECT id, last_value(h IGNORE NULLS) OVER (PARTITION BY kb_id, file_path ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS section FROM l")
def win08_running_heading(t):
    w = Window.partitionBy("kb_id", "file_path").orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, 0)
    c = t.chunks.where("file_path is not null and start_line is not null")
    return c.select("id", F.last(F.get_json_object("metadata_json", "$.heading"), ignorenulls=True).over(w).alias("section"))


@query("SELECT DISTINCT vec_id AS query_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings")
def sco01_unit_norm(t):
    from fathomgrid.operators.vector import dot

    return t.embeddings.select(F.col("vec_id").alias("query_id"), _R(dot(F.col("embedding"), F.col("embedding"))).alias("norm2")).distinct()
