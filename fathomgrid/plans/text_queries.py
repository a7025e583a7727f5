"""Scalar and text operators over chunks, documents, bases and queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomgrid.functions import science as sci
from fathomgrid.functions import text as tx
from fathomgrid.plans import tuning as tn
from fathomgrid.plans.registry import SQL_STEM, query, sql_case, sql_list, sql_signals, sql_spaced, sql_terms, sql_token_list, sql_tokens
from fathomgrid.session import spread

T = "content_tokenized"
_EXT = r"lower(regexp_extract(file_path, '[^/]\.([^./]+)$', 1))"


_DISK = "CASE WHEN source_type IN ('directory', 'file') THEN source_type END"


@query(
    f"SELECT id, CASE WHEN p IS NULL OR p = '' THEN 'text' WHEN starts_with(p, 'http://') OR starts_with(p, 'https://') THEN 'url' WHEN k IS NOT NULL THEN k WHEN NOT contains(p, chr(10)) AND NOT starts_with(p, '//') AND (p[1] IN ('.', '/', '~') OR contains(p, '/') OR contains(p, '\\') OR regexp_matches(p, '\\.[A-Za-z0-9][A-Za-z0-9_-]{{0,15}}$')) THEN 'missing' ELSE 'text' END AS source_class FROM (SELECT id, trim(source_path) AS p, {_DISK} AS k FROM knowledge_bases)"
)
def src01_classify_source(t):
    """What a base's source is; its recorded type says what stands on the disk."""
    from fathomgrid.sources.files import classify_source

    on_disk = F.when(F.col("source_type").isin("directory", "file"), F.col("source_type"))
    return t.knowledge_bases.select("id", classify_source(F.col("source_path"), on_disk).alias("source_class"))


def _sql_ignored(path: str) -> str:
    """Ignore rules in SQL: names by glob on every segment, paths by their first two segments."""
    from fathomgrid.sources.files import DEFAULT_IGNORED

    names = " OR ".join(f"x GLOB '{p}'" for p in DEFAULT_IGNORED if "/" not in p)
    paths = " OR ".join(f"(split_part({path}, '/', 1) = '{p.split('/')[0]}' AND split_part({path}, '/', 2) GLOB '{p.split('/')[1]}')" for p in DEFAULT_IGNORED if "/" in p)
    return f"(list_bool_or(list_transform(string_split({path}, '/'), lambda x: {names})) OR {paths})"


@query(f"SELECT id, file_path, {_sql_ignored('file_path')} AS ignored FROM chunks")
def src04_ignore_rules(t):
    from fathomgrid.sources.files import DEFAULT_IGNORED, ignore_pattern

    p = F.col("file_path")
    return t.chunks.select("id", "file_path", F.when(p.isNotNull(), ignore_pattern(p, DEFAULT_IGNORED)).alias("ignored"))


_INC, _EXC = ["chemistry", "compression"], ["chemistry/batch"]


@query("SELECT id, CASE WHEN file_path = 'chemistry/batch' OR starts_with(file_path, 'chemistry/batch/') THEN 'excluded' WHEN starts_with(file_path, 'chemistry/') OR starts_with(file_path, 'compression/') OR file_path IN ('chemistry', 'compression') THEN 'included' ELSE 'default' END AS decision FROM chunks")
def src05_path_override(t):
    from fathomgrid.sources.files import path_decision

    return t.chunks.select("id", path_decision(F.col("file_path"), _INC, _EXC).alias("decision"))


_BIN = "CASE WHEN {ign} THEN 'suggested_excluded' WHEN strlen(content) > 20000 THEN 'oversized' WHEN (ext IN ({exts}) OR contains(left(content, 512), chr(0))) AND ext NOT IN ('doc', 'docx', 'pdf') THEN 'binary' END"


def _sql_judged() -> str:
    from fathomgrid.sources.files import BINARY_EXTENSIONS

    case = _BIN.format(ign=_sql_ignored("file_path"), exts=", ".join(f"'{e}'" for e in BINARY_EXTENSIONS))
    return f"ju AS (SELECT kb_id, id, file_path, strlen(content) AS n, {case} AS reason FROM (SELECT *, {_EXT} AS ext FROM chunks WHERE file_path IS NOT NULL))"


def _judged(t):
    """Chunks judged as files: their path, the length of their content, a cap of 20,000 bytes."""
    from fathomgrid.sources.files import DEFAULT_IGNORED, skip_reason

    c = t.chunks.where("file_path is not null").select("kb_id", "id", "file_path", F.octet_length("content").cast("long").alias("length"), F.encode("content", "UTF-8").alias("content"))
    return c.withColumn("reason", skip_reason(F.col("file_path"), F.col("length"), F.col("content"), DEFAULT_IGNORED, max_bytes=20_000))


@query(f"WITH {_sql_judged()}, n AS (SELECT reason, id, row_number() OVER (PARTITION BY reason ORDER BY id) AS rn FROM ju WHERE reason IS NOT NULL) SELECT reason, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (WHERE rn <= 25) AS samples FROM n GROUP BY reason")
def src08_skip_accounting(t):
    from fathomgrid.sources.files import skip_report

    return skip_report(_judged(t), 25, "id").withColumn("samples", F.array_join("samples", ","))


@query(f"WITH {_sql_judged()} SELECT kb_id, count(*) FILTER (WHERE reason IS NULL) AS files, coalesce(sum(n) FILTER (WHERE reason IS NULL), 0)::BIGINT AS bytes, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped FROM ju GROUP BY kb_id")
def src23_index_plan(t):
    from fathomgrid.sources.files import index_plan

    return index_plan(_judged(t), ["kb_id"])


@query(rf"SELECT id, {sql_case(_EXT, tx.EXTENSIONS, "'text'")} AS inferred_type FROM chunks")
def src09_file_type(t):
    return t.chunks.select("id", tx.file_type(F.col("file_path")).alias("inferred_type"))


@query("SELECT id, lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) IN ('doc', 'docx', 'pdf') AS is_document FROM chunks")
def src10_document_file(t):
    return t.chunks.select("id", tx.extension(F.col("file_path")).isin(*tx.DOCUMENT_EXTENSIONS).alias("is_document"))


@query("SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS text FROM chunks")
def src12_html_text(t):
    return t.chunks.select("id", tx.html_text(F.col("content")).alias("text"))


@query(f"SELECT id, len({sql_terms(T)}) AS n_terms, array_to_string(list_sort(list_distinct({sql_terms(T)})), ' ') AS terms FROM chunks")
def str08_index_terms(t):
    terms = tx.fts_terms(F.col(T))
    return t.chunks.select("id", F.size(terms).alias("n_terms"), F.array_join(F.array_sort(F.array_distinct(terms)), " ").alias("terms"))


@query(f"SELECT query_id, array_to_string(list_sort({sql_tokens('query_text')}), ' ') AS tokens FROM search_queries")
def str02_query_tokens(t):
    return t.search_queries.select("query_id", F.array_join(F.array_sort(tx.search_tokens(F.col("query_text"))), " ").alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT unnest({sql_terms(T)}) AS t FROM chunks) SELECT t AS token, {SQL_STEM} AS stem FROM w")
def str03_stem(t):
    w = t.chunks.select(F.explode(tx.fts_terms(F.col(T))).alias("token")).distinct()
    return w.select("token", tx.stem(F.col("token")).alias("stem"))


@query(f"SELECT id, array_to_string(list_sort({sql_signals(sql_tokens(T))}), ' ') AS signals FROM chunks")
def str04_signals(t):
    return t.chunks.select("id", F.array_join(F.array_sort(tx.signals(tx.search_tokens(F.col(T)))), " ").alias("signals"))


@query(f"WITH q AS (SELECT query_id, {sql_signals(sql_tokens('query_text'))} AS qs FROM search_queries), h AS (SELECT DISTINCT query_id, chunk_id FROM search_hits), c AS (SELECT id, {sql_signals(sql_tokens(T))} AS cs FROM chunks) SELECT query_id, chunk_id, round(CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(cs, qs)) / len(qs) END, 6) AS coverage FROM h JOIN q USING (query_id) JOIN c ON c.id = h.chunk_id")
def str09_coverage(t):
    q = t.search_queries.select("query_id", tx.signals(tx.search_tokens(F.col("query_text"))).alias("qs"))
    c = t.chunks.select(F.col("id").alias("chunk_id"), tx.signals(tx.search_tokens(F.col(T))).alias("cs"))
    h = t.search_hits.select("query_id", "chunk_id").distinct()
    return h.join(q, "query_id").join(c, "chunk_id").select("query_id", "chunk_id", F.round(tx.coverage(F.col("cs"), F.col("qs")), 6).alias("coverage"))


@query(f"WITH c AS (SELECT id, kb_id, file_path, start_line, {sql_tokens(T)} AS s FROM chunks), p AS (SELECT id, s, lag(id) OVER w AS prev_id, lag(s) OVER w AS prev FROM c WINDOW w AS (PARTITION BY kb_id, file_path ORDER BY start_line NULLS FIRST, id)) SELECT id, prev_id, round(CASE WHEN len(s) = 0 OR len(prev) = 0 THEN 0 ELSE len(list_intersect(s, prev)) / len(list_distinct(list_concat(s, prev))) END, 6) AS jaccard FROM p WHERE prev_id IS NOT NULL")
def str10_jaccard(t):
    from pyspark.sql import Window

    w = Window.partitionBy("kb_id", "file_path").orderBy(F.col("start_line").asc_nulls_first(), "id")
    c = t.chunks.select("id", "kb_id", "file_path", "start_line", tx.search_tokens(F.col(T)).alias("s"))
    p = c.withColumn("prev_id", F.lag("id").over(w)).withColumn("prev", F.lag("s").over(w)).where("prev_id is not null")
    return p.select("id", "prev_id", F.round(tx.jaccard(F.col("s"), F.col("prev")), 6).alias("jaccard"))


@query(
    f"WITH q AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query_text), '[ ]+'), lambda x: x <> '') AS ts FROM search_queries), h AS (SELECT DISTINCT query_id, chunk_id FROM search_hits), "
    "x AS (SELECT query_id, chunk_id, content, (SELECT min_by(instr(lower(content), ts[i]), (-length(ts[i])) * 1000 + i) FROM (SELECT unnest(range(1, len(ts) + 1)) AS i) WHERE instr(lower(content), ts[i]) > 0) AS p FROM h JOIN q USING (query_id) JOIN chunks c ON c.id = h.chunk_id), "
    "y AS (SELECT *, greatest(0, p - 1 - 120) AS st, length(content) AS n FROM x) "
    "SELECT query_id, chunk_id, CASE WHEN p IS NULL THEN substring(content, 1, 240) ELSE (CASE WHEN st > 0 THEN '...' ELSE '' END) || substring(content, st + 1, least(n, st + 240) - st) || (CASE WHEN least(n, st + 240) < n THEN '...' ELSE '' END) END AS snippet FROM y"
)
def str11_snippet(t):
    q = t.search_queries.select("query_id", F.filter(F.split(F.lower("query_text"), "[ ]+"), lambda x: x != "").alias("ts"))
    c = t.chunks.select(F.col("id").alias("chunk_id"), "content")
    return t.search_hits.select("query_id", "chunk_id").distinct().join(q, "query_id").join(c, "chunk_id").select("query_id", "chunk_id", tx.snippet(F.col("content"), F.col("ts")).alias("snippet"))


@query("SELECT id, ceil(length(content) / 3)::BIGINT AS tokens FROM chunks")
def str12_estimated_tokens(t):
    return t.chunks.select("id", tx.estimated_tokens(F.col("content")).alias("tokens"))


@query("SELECT id, sha256(content) AS content_hash, sha256(content) = content_hash AS agrees FROM chunks")
def str13_content_hash(t):
    return t.chunks.select("id", F.sha2("content", 256).alias("content_hash"), (F.sha2("content", 256) == F.col("content_hash")).alias("agrees"))


@query("SELECT id, sha256(coalesce(file_path, '') || chr(0) || coalesce(file_type, '') || chr(0) || coalesce(start_line::VARCHAR, '') || chr(0) || coalesce(end_line::VARCHAR, '') || chr(0) || coalesce(metadata_json, '') || chr(0) || coalesce(content, '')) AS identity FROM chunks")
def str13_identity_hash(t):
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return t.chunks.select("id", tx.identity_hash(*map(e, ("file_path", "file_type", "start_line", "end_line", "metadata_json", "content"))).alias("identity"))


@query("SELECT id, sha256(coalesce(chunk_id, '') || chr(0) || coalesce(ordinal, -1)::VARCHAR || chr(0) || coalesce(normalized, '')) AS row_id FROM formulas")
def str14_row_ids(t):
    return t.formulas.select("id", tx.identity_hash(F.coalesce("chunk_id", F.lit("")), F.coalesce("ordinal", F.lit(-1)), F.coalesce("normalized", F.lit(""))).alias("row_id"))


@query(
    "WITH m AS (SELECT id, content, file_path, file_type, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS j FROM chunks), "
    "e AS (SELECT *, j->>'$.breadcrumb' AS b, j->>'$.heading' AS h, j->>'$.language' AS l, array_to_string((j->>'$.labels[*]'), ', ') AS lb, array_to_string(list_transform((j->>'$.formulas[*]'), lambda f: substring(trim(regexp_replace(f, '[ \\n\\t]+', ' ', 'g'), ' '), 1, 300))[1:5], ' | ') AS fm FROM m) "
    "SELECT id, 'File: ' || coalesce(file_path, '') || chr(10) || 'Type: ' || coalesce(file_type, '') || CASE WHEN coalesce(b, '') <> '' THEN chr(10) || 'Section: ' || b WHEN coalesce(h, '') <> '' THEN chr(10) || 'Section: ' || trim(regexp_replace(h, '^#{1,6}[ ]+', ''), ' ') ELSE '' END || CASE WHEN coalesce(l, '') <> '' THEN chr(10) || 'Language: ' || l ELSE '' END || CASE WHEN coalesce(lb, '') <> '' THEN chr(10) || 'Labels: ' || lb ELSE '' END || CASE WHEN coalesce(fm, '') <> '' THEN chr(10) || 'Formulas: ' || fm ELSE '' END || chr(10) || chr(10) || content AS embedding_text FROM e"
)
def str15_embedding_text(t):
    from fathomgrid.functions.metadata import embedding_text

    return t.chunks.select("id", embedding_text().alias("embedding_text"))


@query("SELECT id, regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '^(?:\\./)+', ''), '/+$', '') AS path FROM chunks")
def str16_normal_path(t):
    return t.chunks.select("id", tx.normal_path(F.col("file_path")).alias("path"))


@query(f"SELECT id, list_extract(string_split(file_path, '/'), -1) AS basename, regexp_replace(regexp_replace(list_extract(string_split(file_path, '/'), -1), '\\.[^.]+$', ''), '(?i:_test|\\.test|\\.spec)$', '') AS stem, array_to_string(list_sort({sql_tokens(sql_spaced('file_path'))}), ' ') AS path_tokens FROM chunks")
def str17_path_tokens(t):
    p = F.col("file_path")
    return t.chunks.select("id", tx.basename(p).alias("basename"), tx.path_stem(p).alias("stem"), F.array_join(F.array_sort(tx.search_tokens(tx.spaced(p))), " ").alias("path_tokens"))


@query("SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size FROM (SELECT id, strlen(content) AS n FROM chunks WHERE content IS NOT NULL)")
def str19_format_bytes(t):
    return t.chunks.where("content is not null").select("id", tx.format_bytes(F.octet_length("content")).alias("size"))


@query("WITH x AS (SELECT job_seq, status, epoch_ms(updated_at) - epoch_ms(started_at) AS ms FROM indexing_jobs), s AS (SELECT *, ceil(ms / 1000.0)::BIGINT AS s FROM x) SELECT DISTINCT job_seq, status, CASE WHEN ms IS NULL OR ms <= 0 THEN '0s' WHEN s < 60 THEN s || 's' WHEN s % 60 = 0 THEN (s // 60) || 'm' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS took FROM s")
def str19_format_duration(t):
    ms = F.unix_millis("updated_at") - F.unix_millis("started_at")
    return t.indexing_jobs.select("job_seq", "status", tx.format_duration(ms).alias("took")).distinct()


_SQL_EXACT = (
    "translate(q, chr(34) || chr(39) || chr(96), '') <> q OR list_bool_or(list_transform(string_split(replace(replace(q, '\\', '.'), '/', '.'), '.')[2:], lambda x: x <> '' AND regexp_matches(x[1], '[A-Za-z0-9_-]'))) OR contains(q, '..') OR contains(q, '/.') OR contains(q, '\\.') "
    "OR list_bool_or(list_transform(regexp_extract_all(q, '[A-Za-z0-9_]+'), lambda x: x[1] BETWEEN 'A' AND 'Z' AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2)) OR list_bool_or(list_transform(regexp_split_to_array(q, '[^A-Za-z0-9-]+'), lambda x: regexp_full_match(x, '[A-Z]+-[0-9]+')))"
)


@query(
    f"SELECT query_id, CASE WHEN coalesce({_SQL_EXACT}, false) THEN 'fast' WHEN len(list_filter(regexp_split_to_array(q, '[ \\t]+'), lambda w: w <> '')) >= {tx.LONG_QUERY} OR list_bool_or(list_transform({sql_list(tx.EXPLAIN)}, lambda w: contains(lower(q), w))) THEN 'semantic' ELSE 'hybrid' END AS auto_mode FROM (SELECT query_id, trim(query_text) AS q FROM search_queries)"
)
def str20_auto_mode(t):
    return t.search_queries.select("query_id", tx.auto_mode(F.col("query_text")).alias("auto_mode"))


@query(f"SELECT query_id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ' ') AS normalized FROM (SELECT query_id, {sql_token_list('query_text')} AS g FROM search_queries)")
def str06_normalized_query(t):
    return t.search_queries.select("query_id", tx.normalized_query(F.col("query_text")).alias("normalized"))


def _sql_words(values: list[str]) -> str:
    return f"list_has_any(regexp_split_to_array(lower(q), '[^a-z0-9_]+'), {sql_list(values)})"


def _sql_holds(values: list[str]) -> str:
    return f"list_bool_or(list_transform({sql_list(values)}, lambda w: contains(lower(q), w)))"


_SQL_CODE = (
    f"regexp_full_match(q, '[A-Z][A-Z0-9_]{{2,}}') OR (NOT regexp_matches(q, '[ \\t]') AND contains(q, '.') AND lower(list_extract(string_split(q, '.'), -1)) IN ({', '.join(repr(e) for e in tn.FILE_ENDS)})) OR regexp_matches(q, '[A-Za-z0-9_$][(].*[)]') OR regexp_matches(q, '[A-Za-z0-9_$][.][A-Za-z_$]') "
    "OR list_bool_or(list_transform(regexp_extract_all(q, '[A-Za-z0-9_$]+'), lambda x: (x[1] BETWEEN 'A' AND 'Z' AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2) OR regexp_matches(x, '^[a-z]+[A-Z]')))"
)


@query(
    f"SELECT query_id, CASE WHEN m IN ({', '.join(map(repr, tn.PRECISE_MODES))}) THEN 'precision' WHEN m IN ({', '.join(map(repr, tn.LONG_MODES))}) THEN 'long_context' WHEN m = 'semantic' THEN 'recall' WHEN {_sql_words(tn.ERRORS)} OR {_sql_holds(tn.ERRORS_CJK)} OR coalesce({_SQL_CODE}, false) THEN 'precision' "
    f"WHEN len(list_filter(regexp_split_to_array(q, '[ \\t]+'), lambda w: w <> '')) >= {tx.LONG_QUERY} OR {_sql_words(tn.LONG)} OR {_sql_holds(tn.LONG_CJK)} THEN 'long_context' ELSE 'balanced' END AS profile FROM (SELECT query_id, trim(query_text) AS q, coalesce(mode, 'hybrid') AS m FROM search_queries)"
)
def sco17_profile(t):
    return t.search_queries.select("query_id", tn.profile(F.col("query_text"), F.col("mode")).alias("profile"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v.limit}, {v.candidates()}, {v.min_score})" for k, v in tn.PROFILES.items()) + ") AS x(profile, result_limit, candidates, min_score)")
def srt11_profile_limits(t):
    rows = [(k, v.limit, v.candidates(), float(v.min_score)) for k, v in tn.PROFILES.items()]
    return t.spark.createDataFrame(rows, "profile string, result_limit int, candidates int, min_score double")


@query("SELECT query_id, least(10000, greatest(0, (query_id * 997)::BIGINT)) AS from_row, greatest(50, least(10000, greatest(0, query_id * 997)) + 10 * 12) AS candidates FROM search_queries")
def srt05_candidate_limit(t):
    """Offsets are clamped; the candidates grow with them."""
    at = F.least(F.lit(10_000), F.greatest(F.lit(0), F.col("query_id") * 997))
    b = tn.PROFILES["balanced"]
    return t.search_queries.select("query_id", at.alias("from_row"), F.greatest(F.lit(b.candidate_min), at + b.limit * b.candidate_times).alias("candidates"))


@query(f"WITH q AS (SELECT query_id, {sql_signals(sql_tokens('query_text'))} AS s FROM search_queries) SELECT query_id, list_has_any(s, {sql_list(tx.TESTS)}) AS tests, list_has_any(s, {sql_list(tx.GUIDE)}) AS guide, list_has_any(s, {sql_list(tx.LOCALIZATION)}) AS localization FROM q")
def str21_intents(t):
    s = tx.signals(tx.search_tokens(F.col("query_text")))
    return t.search_queries.select("query_id", tx.asks_for(s, tx.TESTS).alias("tests"), tx.asks_for(s, tx.GUIDE).alias("guide"), tx.asks_for(s, tx.LOCALIZATION).alias("localization"))


@query("SELECT id, " + " OR ".join(f"contains(lower(file_path), '{m}')" for m in tx.TEST_MARKS) + " AS is_test, file_type IN ('json', 'markdown', 'text', 'toml', 'yaml') AND regexp_matches(lower(file_path), '(^|/)(locales?|lang|i18n|translations)/') AS is_localization FROM chunks")
def str21_path_tests(t):
    return t.chunks.select("id", F.when(F.col("file_path").isNotNull(), tx.is_test_path(F.col("file_path"))).alias("is_test"), tx.is_localization_path(F.col("file_path"), F.col("file_type")).alias("is_localization"))


@query("SELECT id, class_name || '-' || substring(name, 1, 12) AS member_name FROM knowledge_bases WHERE class_name IS NOT NULL")
def str22_class_member_name(t):
    return t.knowledge_bases.where("class_name is not null").select("id", F.concat("class_name", F.lit("-"), F.substring("name", 1, 12)).alias("member_name"))


@query("SELECT id, substring(sha256(coalesce(embedding_model, 'none') || ':' || coalesce(embedding_dimension::VARCHAR, 'none')), 1, 12) AS signature FROM knowledge_bases")
def str23_embedding_signature(t):
    s = F.concat_ws(":", F.coalesce("embedding_model", F.lit("none")), F.coalesce(F.col("embedding_dimension").cast("string"), F.lit("none")))
    return t.knowledge_bases.select("id", F.substring(F.sha2(s, 256), 1, 12).alias("signature"))


@query("WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM chunks), o AS (SELECT id, line, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS place FROM l) SELECT id, place, n::INT AS line FROM o WHERE regexp_matches(line, '^#{1,6} +[^ ]')")
def str24_line_at_offset(t):
    """The line of every heading's offset, over whole texts."""
    from fathomgrid.functions.chunkers import place_lines_udf

    c = t.chunks.where(F.col("content").contains("#")).select("id", F.explode(place_lines_udf(F.col("content"))).alias("p"))
    return c.where("p.kind = 'heading'").select("id", F.col("p.offset").alias("place"), "p.line")


@query(None)
def str24_lines_of_places(t):
    """Offset and line of every heading and display formula of the whole text."""
    from fathomgrid.functions.chunkers import place_lines_udf

    c = t.chunks.where(F.col("content").contains("#") | F.col("content").contains("$$"))
    return c.select("id", F.explode(place_lines_udf(F.col("content"))).alias("p")).select("id", "p.kind", "p.offset", "p.line")


_MATH = {k: v for k, v in {**sci.MATH_WORDS, **sci.SCRIPT_WORDS}.items()}


@query("SELECT id, regexp_replace(trim(" + "".join("replace(" for _ in _MATH) + "content" + "".join(f", '{k}', ' {v} ')" for k, v in _MATH.items()) + ", ' '), '  +', ' ', 'g') AS words FROM chunks WHERE content IS NOT NULL")
def sci01_math_words(t):
    return _math_words(t.chunks.where("content is not null"))


def _math_words(chunks):
    pairs = F.create_map(*[F.lit(x) for k, v in _MATH.items() for x in (k, f" {v} ")])
    folded = F.array_join(F.transform(F.split("content", ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    some = F.when(F.col("content").rlike("[" + "".join(_MATH) + "]"), folded).otherwise(F.col("content"))  # most rows skip the fold
    return chunks.select("id", F.regexp_replace(F.trim(some), "  +", " ").alias("words"))


@query(None)
def sci05_normalized_formulas(t):
    f = t.formulas.select("id", sci.normalize_formula_udf(F.col("raw")).alias("f"))
    return f.select("id", "f.normalized", "f.token_count")


@query(f"SELECT id, coalesce(length(u) BETWEEN 1 AND 64 AND regexp_full_match(u, '{sci.MOLECULE}') AND len(regexp_extract_all(u, '{sci.ELEMENT}')) >= 2, false) AS molecular FROM (SELECT id, translate(trim(raw), '{sci.SCRIPTED}', '{sci.UNSCRIPTED}') AS u FROM formulas)")
def sci07_molecular(t):
    return t.formulas.select("id", F.coalesce(sci.molecular(F.col("raw")), F.lit(False)).alias("molecular"))


@query(None)
def sci04_pre_tokenized(t):
    return spread(t.chunks.select("id", "content")).select("id", sci.pre_tokenize_udf(F.col("content")).alias("stream"))


@query(f"SELECT id, array_to_string(list_transform(string_split({T}, ' '), lambda x: {sql_case('lower(x)', sci.UNIT_WORDS, 'x')}), ' ') AS stream FROM chunks WHERE {T} IS NOT NULL")
def sci10_unit_words(t):
    return t.chunks.where(f"{T} is not null").select("id", F.array_join(tx.unit_word_tokens(F.split(T, " ")), " ").alias("stream"))


@query(f"WITH s AS (SELECT id, string_split(normalized, ' ') AS w FROM formulas WHERE normalized IS NOT NULL) SELECT id, array_to_string(list_filter(w, lambda x, i: NOT (x = 'cdot' AND i > 1 AND i < len(w) AND list_contains({sql_list(sci.UNITS)}, w[i - 1]) AND list_contains({sql_list(sci.UNITS)}, w[i + 1]))), ' ') AS stream FROM s")
def sci11_unit_products(t):
    return t.formulas.where("normalized is not null").select("id", F.array_join(tx.drop_unit_products(F.split("normalized", " ")), " ").alias("stream"))


@query(r"SELECT id, array_to_string(f[1:10], '|') AS formulas, len(f) AS n FROM (SELECT id, list_filter(g, lambda x, i: list_position(g, x) = i) AS f FROM (SELECT id, regexp_extract_all(content, '\$\$[^$]+\$\$') AS g FROM chunks WHERE contains(content, '$$')))")
def sci14_display_formulas(t):
    """The first ten different display formulas of every chunk in order of first occurrence, and how many there are."""
    return _display_formulas(t.chunks)


def _display_formulas(chunks):
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\$\$[^$]+\$\$)"), 1))
    c = chunks.where(F.col("content").contains("$$")).select("id", found.alias("f"))
    return c.select("id", F.array_join(F.slice("f", 1, 10), "|").alias("formulas"), F.size("f").alias("n"))


@query(r"SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '\[\[([^\[\]|]+)(\|[^\[\]]*)?\]\]', 1), lambda x: trim(x, ' ')))), '|') AS links FROM chunks WHERE contains(content, '[[')")
def sci15_wikilinks(t):
    found = F.transform(F.regexp_extract_all("content", F.lit(r"\[\[([^\[\]|]+)(\|[^\[\]]*)?\]\]"), 1), F.trim)
    return t.chunks.where(F.col("content").contains("[[")).select("id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("links"))


@query(r"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\label\{([^{}]+)\}', 1))), '|') AS labels, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\(?:eq|page|c)?ref\{([^{}]+)\}', 1))), '|') AS refs FROM chunks WHERE contains(content, '\')")
def sci17_labels_refs(t):
    g = lambda p: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(p), 1))), "|")
    return t.chunks.where(F.col("content").contains("\\")).select("id", g(r"\\label\{([^{}]+)\}").alias("labels"), g(r"\\(?:eq|page|c)?ref\{([^{}]+)\}").alias("refs"))


@query(f"SELECT id, {sql_case('lower(trim(file_type))', tx.TYPE_ALIASES, 'lower(trim(file_type))')} AS file_type FROM chunks WHERE file_type IS NOT NULL")
def flt04_file_type_alias(t):
    return t.chunks.where("file_type is not null").select("id", tx.file_type_alias(F.col("file_type")).alias("file_type"))


@query("SELECT id FROM chunks WHERE length(trim(content)) >= 50")
def flt12_short_chunks(t):
    return t.chunks.where(F.length(F.trim("content")) >= 50).select("id")


@query("SELECT query_id, CASE WHEN coalesce(mode, 'hybrid') IN ('code', 'config', 'errors') THEN 'fast' WHEN coalesce(mode, 'hybrid') IN ('auto', 'docs', 'decision') THEN 'hybrid' ELSE coalesce(mode, 'hybrid') END AS retrieval FROM search_queries")
def ret07_mode_alias(t):
    return t.search_queries.select("query_id", tx.retrieval_mode(F.col("mode")).alias("retrieval"))


@query("SELECT id, (CASE WHEN json_valid(metadata_json) THEN metadata_json END)->>'$.heading' AS heading, (CASE WHEN json_valid(metadata_json) THEN metadata_json END)->>'$.breadcrumb' AS breadcrumb, (CASE WHEN json_valid(metadata_json) THEN metadata_json END)->>'$.language' AS language FROM chunks")
def jsn01_metadata(t):
    from fathomgrid.functions.metadata import metadata

    m = metadata(F.col("metadata_json"))
    return t.chunks.select("id", m["heading"].alias("heading"), m["breadcrumb"].alias("breadcrumb"), m["language"].alias("language"))


@query("SELECT id, (CASE WHEN json_valid(source_options) THEN source_options END)->>'$.include_suggested_text' AS include_suggested FROM knowledge_bases")
def jsn02_source_options(t):
    return t.knowledge_bases.select("id", F.get_json_object("source_options", "$.include_suggested_text").alias("include_suggested"))


@query("SELECT id, split_part(file_path, '/', 1) AS top, array_to_string(list_reverse(string_split(file_path, '/')), '<') AS up, list_contains(string_split(file_path, '/'), 'chemistry') AS chemistry FROM chunks WHERE file_path IS NOT NULL")
def arr01_path_arrays(t):
    p = F.split("file_path", "/")
    return t.chunks.where("file_path is not null").select("id", F.get(p, F.lit(0)).alias("top"), F.array_join(F.reverse(p), "<").alias("up"), F.array_contains(p, "chemistry").alias("chemistry"))


@query("SELECT kb_id, array_to_string(list_sort(list(ft || '=' || n)), ',') AS type_counts FROM (SELECT kb_id, coalesce(lower(trim(file_type)), '?') AS ft, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY kb_id")
def map01_type_counts(t):
    per = t.chunks.groupBy("kb_id", F.coalesce(F.lower(F.trim("file_type")), F.lit("?")).alias("ft")).agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("kb_id").agg(F.map_from_entries(F.collect_list(F.struct("ft", "n"))).alias("m"))
    return m.select("kb_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("type_counts"))


@query("SELECT id, regexp_extract(line, '^(#{1,6}) ', 1) AS marks, trim(regexp_replace(regexp_extract(line, '^#{1,6} +(.+)$', 1), ' +#*$', ''), ' ') AS name, n AS line FROM (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM chunks) WHERE regexp_matches(line, '^#{1,6} +[^ ]')")
def gen08_heading_symbols(t):
    lines = t.chunks.select("id", F.posexplode(F.split("content", "\n")).alias("p", "line")).where(F.col("line").rlike("^#{1,6} +[^ ]"))
    name = F.trim(F.regexp_replace(F.regexp_extract("line", "^#{1,6} +(.+)$", 1), " +#*$", ""))
    return lines.select("id", F.regexp_extract("line", "^(#{1,6}) ", 1).alias("marks"), name.alias("name"), (F.col("p") + 1).alias("line"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE contains(text, ':')) SELECT doc_id, regexp_extract(line, '^[ \\t]*([A-Za-z0-9_.-]+)[ \\t]*:', 1) AS name, n::INT AS line FROM l WHERE regexp_matches(line, '^[ \\t]*[A-Za-z0-9_.-]+[ \\t]*:')"
)
def gen09_config_symbols(t):
    """Keys of texts read as YAML (front matter among them), by the reader of configuration files."""
    from fathomgrid.functions.symbols import symbols_udf

    d = t.documents.where(F.col("text").contains(":")).select("doc_id", F.explode(symbols_udf(F.col("text"), F.lit("config.yaml"), F.lit("yaml"))).alias("s"))
    return d.where("s.kind = 'config_key'").select("doc_id", "s.name", "s.line")


@query(
    r"SELECT id, 'function' AS kind, unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:export +)?(?:pub +)?(?:async +)?(?:def|fn|func|function) +([A-Za-z_][A-Za-z0-9_]*) *[(]', 1)) AS name FROM chunks WHERE lower(trim(file_type)) IN ('python', 'go', 'rust', 'typescript') "
    r"UNION ALL SELECT id, 'class', unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:export +)?class +([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM chunks WHERE lower(trim(file_type)) IN ('python', 'go', 'rust', 'typescript')"
)
def gen10_code_symbols(t):
    """Functions and classes of program texts; the SQL reads declarations at a line's start."""
    from fathomgrid.functions.symbols import code_symbols_udf

    c = t.chunks.where(F.lower(F.trim("file_type")).isin("python", "go", "rust", "typescript"))
    s = c.select("id", F.explode(code_symbols_udf(F.col("content"))).alias("s")).select("id", "s.kind", "s.name")
    return s.where(F.col("kind").isin("function", "class"))


@query(r"SELECT id, regexp_extract(line, '^\\(chapter|section|subsection|subsubsection)', 1) AS kind, regexp_extract(line, '^\\(?:chapter|section|subsection|subsubsection)\*?\{([^{}]+)\}', 1) AS name FROM (SELECT id, unnest(string_split(content, chr(10))) AS line FROM chunks WHERE contains(content, '\')) WHERE regexp_matches(line, '^\\(?:chapter|section|subsection|subsubsection)\*?\{[^{}]+\}')")
def gen12_latex_headings(t):
    p = r"^\\(chapter|section|subsection|subsubsection)\*?\{([^{}]+)\}"
    lines = t.chunks.where(F.col("content").contains("\\")).select("id", F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(p))
    return lines.select("id", F.regexp_extract("line", p, 1).alias("kind"), F.regexp_extract("line", p, 2).alias("name"))


@query("WITH m AS (SELECT id, CASE WHEN json_valid(metadata_json) THEN metadata_json END AS j FROM chunks), f AS (SELECT id, unnest(j->>'$.formulas[*]') AS raw, generate_subscripts(j->>'$.formulas[*]', 1) - 1 AS ordinal FROM m) SELECT id AS chunk_id, ordinal::INT AS ordinal, raw, sha256(id || chr(0) || ordinal) AS row_id FROM f")
def gen14_formula_rows(t):
    """A row per formula of a chunk's metadata, with the id that its stored row has."""
    from fathomgrid.functions.metadata import metadata

    f = t.chunks.select(F.col("id").alias("chunk_id"), F.posexplode(metadata(F.col("metadata_json"))["formulas"]).alias("ordinal", "raw"))
    return f.select("chunk_id", "ordinal", "raw", tx.identity_hash(F.col("chunk_id"), F.col("ordinal")).alias("row_id"))


# ---- Python cores over columns: checked by literals in the tests ---------------------------------


@query(None)
def gen01_chunk_documents(t):
    from fathomgrid.functions.chunkers import chunk_documents

    kind = tx.file_type_alias(F.col("file_type"))
    return chunk_documents(t.documents, "doc_id", "text", kind).select("doc", "ordinal", "start_line", "end_line", F.length("content").alias("n_chars"))


@query(None)
def gen02_markdown_chunks(t):
    from fathomgrid.functions.chunkers import chunk_documents
    from fathomgrid.functions.metadata import metadata

    c = chunk_documents(t.documents.where(tx.file_type_alias(F.col("file_type")) == "markdown"), "doc_id", "text", F.lit("markdown"))
    m = metadata(F.col("metadata_json"))
    return c.select("doc", "ordinal", m["heading"].alias("heading"), m["breadcrumb"].alias("breadcrumb"), F.size(m["formulas"]).alias("formulas"), F.size(m["links"]).alias("links"))


@query(None)
def gen04_latex_chunks(t):
    from fathomgrid.functions.chunkers import chunk_documents

    c = chunk_documents(t.chunks.where(F.lower(F.trim("file_type")) == "latex"), "id", "content", F.lit("latex"))
    return c.select("doc", "ordinal", "start_line", "end_line", "metadata_json")


@query(None)
def gen05_code_chunks(t):
    from fathomgrid.functions.chunkers import CODE, chunk_documents

    kind = F.lower(F.trim("file_type"))
    c = chunk_documents(t.chunks.where(kind.isin(*sorted(CODE))), "id", "content", kind)
    return c.select("doc", "ordinal", "start_line", "end_line", "metadata_json")


@query(None)
def gen07_code_symbols(t):
    from fathomgrid.functions.chunkers import CODE
    from fathomgrid.functions.symbols import code_symbols_udf

    c = t.chunks.where(F.lower(F.trim("file_type")).isin(*sorted(CODE)))
    return c.select("id", F.explode(code_symbols_udf(F.col("content"))).alias("s")).select("id", "s.kind", "s.name", "s.line", "s.signature")


@query(None)
def sci03_canonical_math(t):
    return t.chunks.where(F.col("content").rlike("[\\^" + "".join(_MATH) + "]")).select("id", sci.canonical_math_udf(F.col("content")).alias("words"))


@query(None)
def sci12_segments(t):
    from fathomgrid.functions.chunkers import segments_udf

    s = t.chunks.select("id", F.explode(segments_udf(F.col("content"))).alias("s"))
    return s.groupBy("s.kind").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("s.end_line") - F.col("s.start_line") + 1).alias("lines"))


@query(None)
def sci18_table_rows(t):
    from fathomgrid.functions.chunkers import table_rows_udf

    return t.chunks.where(F.col("content").contains("|")).select("id", table_rows_udf(F.col("content")).alias("content"))
