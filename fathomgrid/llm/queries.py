"""Queries and SQL of the training-data operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import curve_knn, leakage, lookalikes, lsh_forest, markup, packing, rank_fusion, residue, scan_repair, splitting
from fathomgrid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.ideal_point_ranking(table(spark, d, "search_hits"), top=10).select("query_id", "chunk_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = rank_fusion.ideal_point_ranking(table(spark, d, "search_hits"))
    return r.select("query_id", "chunk_id", "position", F.round("closeness", 6).alias("closeness"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return curve_knn.nearest_pairs(table(spark, d, "chunk_vectors"), table(spark, d, "knowledge_bases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_chunks(table(spark, d, "chunks")).select("chunk_id")


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_chunks(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).where("piece = 1").select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p4_whole(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized chunk: without their overlaps they are its text again, and limit,
    overlap and line numbers hold."""
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    own = F.struct("piece", F.expr("substring(content, new_char - start_char + 1)").alias("text"))
    good = (F.length("content") <= splitting.LIMIT) & (F.col("new_char") - F.col("start_char") <= splitting.OVERLAP) & (F.col("end_line") >= F.col("start_line"))
    g = pieces.groupBy("chunk_id").agg(F.sort_array(F.collect_list(own)).alias("p"), F.every(good).alias("good"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    return g.select("chunk_id", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("content_hash"), "good", "first_line", "last_line")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.noisy_chunks(table(spark, d, "chunks")).select("chunk_id")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repair_chunks(table(spark, d, "chunks"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_records(table(spark, d, "chunks"), table(spark, d, "formulas"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_records(table(spark, d, "chunks"), table(spark, d, "formulas"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents")).select("doc_id")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lsh_forest.similar_pairs(table(spark, d, "chunks"), "id", "content", threshold=0.5, shingle=3)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return lsh_forest.similar_groups(table(spark, d, "chunks"), "id", "content")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens stand in containers once and on end, and no container is over its capacity."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    g = packed.groupBy("doc_id").agg(F.min("token_start").alias("a"), F.max("token_end").alias("b"), F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.count(F.lit(1)).alias("pieces"))
    whole = (F.col("a") == 0) & (F.col("b") == F.col("n")) & ((F.col("pieces") == 1) | (F.col("n") > packing.CAPACITY))
    most, least = packing.container_fill(packed).agg(F.max("tokens"), F.min("tokens")).first()
    fits = most is None or (most <= packing.CAPACITY and least > 0)
    return g.select("doc_id", (whole & F.lit(fits)).alias("whole"))


def _p1_sql(select: str) -> str:
    """The ranking in SQL: latest scores, discrete quantiles by sorted lists, normalised columns, distances."""
    legs = sorted(rank_fusion.LEGS)
    last = "s AS (SELECT query_id, chunk_id, leg, arg_max(score, (seen, coalesce(score, -1e300))) AS score FROM (SELECT query_id, chunk_id, leg, coalesce(seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS seen, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM search_hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND leg IN ('bm25', 'vector', 'fusion', 'adjusted')) GROUP BY ALL)"
    last = last.replace("arg_max(score, (seen, coalesce(score, -1e300)))", "(max({'seen': seen, 'score': coalesce(score, -1e300)})).score")
    lists = "l AS (SELECT query_id, leg, list_sort(list(score)) AS v FROM s WHERE score > -1e299 GROUP BY ALL)"
    share = "1 - 0.15 / power(2, greatest(0, least(30, floor(log2(greatest(len(v) * 0.15 / 10, 1.0))))))"
    bounds = f"b AS (SELECT query_id, leg, v[greatest(1, ceil(0.1 * len(v))::INT)] AS lo, v[greatest(1, ceil(round({share}, 12) * len(v))::INT)] AS hi FROM l)"
    clip = "c AS (SELECT s.query_id, s.chunk_id, s.leg, CASE WHEN score > -1e299 THEN least(greatest(score, lo), hi) - lo ELSE 0 END AS x, CASE WHEN score > -1e299 AND hi > lo THEN 1 - (hi - lo) / (greatest(score - hi, 0) + hi - lo) ELSE 0 END AS o FROM s LEFT JOIN b ON b.query_id = s.query_id AND b.leg = s.leg)"
    wide = "w AS (SELECT query_id, chunk_id, " + ", ".join(f"coalesce(sum(x) FILTER (WHERE leg = '{g}'), 0) AS {g}" for g in legs) + ", sum(coalesce(o, 0)) AS over FROM (SELECT query_id, chunk_id, leg, coalesce(x, 0) AS x, o FROM c) GROUP BY ALL)"
    norm = "n AS (SELECT query_id, " + ", ".join(f"sqrt(sum({g} * {g})) AS n_{g}, max({g}) AS m_{g}" for g in legs) + " FROM w GROUP BY query_id)"
    unit = lambda v, g: f"CASE WHEN n_{g} > 0 THEN ({v}) / n_{g} ELSE 0 END"
    far = lambda v: "sqrt(" + " + ".join(f"power({unit(v(g), g)}, 2)" for g in legs) + ")"
    dist = f"d AS (SELECT query_id, chunk_id, over, {far(lambda g: f'm_{g} - {g}')} AS up, {far(lambda g: g)} AS down FROM w JOIN n USING (query_id))"
    rank = "r AS (SELECT query_id, chunk_id, over, CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0 END AS closeness FROM d), p AS (SELECT query_id, chunk_id, closeness, row_number() OVER (PARTITION BY query_id ORDER BY round(closeness, 9) DESC, round(over, 9) DESC, chunk_id) AS position FROM r)"
    return f"WITH {', '.join([last, lists, bounds, clip, wide, norm, dist, rank])} {select}"


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what the operator does; the others are tested against brute force."""
    return {
        "p1_found": _p1_sql("SELECT query_id, chunk_id FROM p WHERE position <= 10"),
        "p1_ranking": _p1_sql("SELECT query_id, chunk_id, position::INT AS position, round(closeness, 6) AS closeness FROM p"),
        "p8_coverage": "SELECT doc_id, true AS whole FROM documents WHERE length(text) > 0",
        "p4_whole": "SELECT id AS chunk_id, sha256(content) AS content_hash, true AS good, b AS first_line, (b + length(content) - length(replace(content, chr(10), '')) - (CASE WHEN content[-1] = chr(10) THEN 1 ELSE 0 END))::INT AS last_line FROM (SELECT *, CASE WHEN coalesce(start_line, 0) >= 1 THEN start_line ELSE 1 END AS b FROM chunks) WHERE length(content) > 6000",
        "p4_found": "SELECT id AS chunk_id FROM chunks WHERE length(content) > 6000",
        "p2_found": (
            "WITH u AS (SELECT DISTINCT v.kb_id, v.chunk_id, v.embedding FROM chunk_vectors v JOIN knowledge_bases k ON k.id = v.kb_id WHERE v.embedding IS NOT NULL AND len(v.embedding) = k.embedding_dimension AND list_sum(list_transform(v.embedding, lambda x: abs(x))) > 0), "
            "s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM u a JOIN u b ON a.kb_id = b.kb_id AND a.chunk_id <> b.chunk_id), "
            "t AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5) SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t"
        ),
        "p7_found": (
            "WITH w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS w FROM chunks WHERE content IS NOT NULL), "
            "g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3), n AS (SELECT id, count(*) AS n FROM g GROUP BY id), "
            "c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL) SELECT a AS chunk_id_a, b AS chunk_id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k * 2 >= x.n + y.n - k"
        ),
        "p7_groups": (
            "WITH RECURSIVE w AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS w FROM chunks WHERE content IS NOT NULL), "
            "g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5), sg AS (SELECT id, md5(string_agg(s, '|' ORDER BY s)) AS sig, count(*) AS n FROM g GROUP BY id), "
            "cl AS (SELECT sig, min(id) AS cid, count(*) AS members, any_value(n) AS n FROM sg GROUP BY sig), gr AS (SELECT cid, s FROM g JOIN cl ON cl.cid = g.id), pr AS (SELECT a.cid AS x, b.cid AS y, count(*) AS k FROM gr a JOIN gr b ON a.s = b.s AND a.cid < b.cid GROUP BY ALL), "
            "pp AS (SELECT x, y FROM pr JOIN cl c ON c.cid = x JOIN cl d ON d.cid = y WHERE k / (c.n + d.n - k) >= 0.8), e AS (SELECT x, y FROM pp UNION ALL SELECT y, x FROM pp), reach AS (SELECT cid AS a, cid AS b FROM cl UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x), "
            "grp AS (SELECT a AS cid, min(b) AS gid FROM reach GROUP BY a), deg AS (SELECT x AS cid, count(*) AS d FROM e GROUP BY x) SELECT sg.id, cid AS class_id, gid AS group_id, coalesce(d, 0) + members - 1 AS links FROM sg JOIN cl USING (sig) JOIN grp USING (cid) LEFT JOIN deg USING (cid) WHERE members > 1 OR d IS NOT NULL"
        ),
        "p9_found": (
            "WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z][^<>\\n]*>', ' ', 'g'), '&(?:[A-Za-z]{2,}|#[0-9]+|#x[0-9A-Fa-f]+);', ' ', 'g'), '\\]\\([^()\\s]+\\)', '] ', 'g'), '\\[\\[[^\\[\\]|\\n]+\\|([^\\[\\]\\n]*\\]\\])', '[[\\1', 'g') AS text FROM documents WHERE text IS NOT NULL), "
            "d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS w FROM m), i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL), "
            "dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS s FROM d WHERE len(w) >= 10), ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS s FROM i WHERE len(w) >= 10) "
            "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (s)"
        ),
    }
