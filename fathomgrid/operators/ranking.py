"""Fusion, rank adjustment, gates, evidence legs and context: Column and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx

FORMULA_BOOST, DEPENDENCY_BOOST, MIN_HYBRID = 0.35, 0.25, 0.18
W_LEXICAL, W_VECTOR, OVERLAP = 0.45, 0.55, 0.15


def min_max(df: DataFrame, by: list[str], score: str = "score", to: str = "scaled") -> DataFrame:
    """Adds the score scaled to [0, 1] within its group, 1 where all are equal.  The bounds are an
    aggregate with map-side combine, joined back: a hot group is never gathered in one task."""
    bounds = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return df.join(bounds, by).withColumn(to, F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo))).drop("_lo", "_hi")


def fuse(lexical: DataFrame, vector: DataFrame, w_lexical: float = W_LEXICAL, w_vector: float = W_VECTOR, overlap: float = OVERLAP) -> DataFrame:
    """(query_id, kb_id, chunk_id, score): weighted sum of the scaled legs, and a bonus on both."""
    keys = ["query_id", "kb_id", "chunk_id"]
    a = min_max(lexical.select(*keys, "score"), keys[:2], to="l").drop("score")
    b = min_max(vector.select(*keys, "score"), keys[:2], to="v").drop("score")
    j = a.join(b, keys, "full").select(*keys, F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("v", F.lit(0.0)).alias("v"))
    bonus = F.when((F.col("l") > 0) & (F.col("v") > 0), overlap).otherwise(0.0)
    return j.withColumn("score", w_lexical * F.col("l") + w_vector * F.col("v") + bonus)


def matches(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def path_boost(path_signals: Column, query_signals: Column) -> Column:
    return F.least(F.lit(0.45), F.lit(0.18) * matches(path_signals, query_signals))


def place_boost(path: Column) -> Column:
    """What a document's place counts for a query that asks for a guide."""
    low = F.lower(path)
    return F.when(low.contains("install") | low.contains("readme") | low.contains("getting-started") | low.contains("quickstart"), 0.85).when(low.startswith("docs/"), 0.35).otherwise(0.0)


def adjusted(df: DataFrame, base: str = "score") -> DataFrame:
    """Adds the boosts and penalties of a row with path_signals, stem_signals, query_signals,
    file_path and file_type, and ``adjusted_score``."""
    q = F.col("query_signals")
    guide, tests, local = tx.asks_for(q, tx.GUIDE), tx.asks_for(q, tx.TESTS), tx.asks_for(q, tx.LOCALIZATION)
    is_source = F.coalesce(F.col("file_type").isin(*tx.SOURCE_TYPES), F.lit(False))
    raw = path_boost(F.col("path_signals"), q)
    stem_hit = F.when(F.arrays_overlap("stem_signals", q), 0.32).otherwise(0.0)
    doc = F.when(~guide | ~F.coalesce(F.col("file_type").isin("markdown", "latex"), F.lit(False)), 0.0).otherwise(place_boost(F.col("file_path")))
    d = (
        df.withColumn("path_boost", F.when(guide & is_source, F.least(F.lit(0.08), raw)).otherwise(raw))
        .withColumn("source_boost", F.when(~is_source, 0.0).when(guide, F.least(F.lit(0.05), raw)).when(stem_hit > 0, stem_hit).otherwise(F.least(F.lit(0.22), raw)))
        .withColumn("documentation_boost", doc)
        .withColumn("is_test", tx.is_test_path(F.col("file_path")))
        .withColumn("is_localization", F.coalesce(tx.is_localization_path(F.col("file_path"), F.col("file_type")), F.lit(False)))
    )
    sum_ = F.col(base) + F.col("path_boost") + F.col("source_boost") + F.col("documentation_boost")
    factor = F.when(F.col("is_test") & ~tests, 0.48).when(~F.col("is_test") & tests, 0.88).otherwise(1.0)
    return d.withColumn("adjusted_score", sum_ * factor * F.when(F.col("is_localization") & ~local, 0.2).otherwise(1.0))


def trust(status: Column, source_type: Column) -> Column:
    kind = F.when(source_type.isin("directory", "file"), 1.04).when(source_type.isin("text", "url"), 0.98).otherwise(1.0)
    return F.when(status == "stale", 0.92).otherwise(1.0) * kind


def enough_evidence(n_signals: Column, source_boost: Column, coverage: Column) -> Column:
    return F.when((n_signals <= 1) | (source_boost >= 0.22), True).when(n_signals <= 3, coverage >= 1 / n_signals).otherwise(coverage >= 0.34)


def interleave(df: DataFrame, query: str, file_key: str, position: str) -> DataFrame:
    """Round-robin over files in the order of their first row: adds ``round``, ``file_order``, ``place``."""
    per_file = Window.partitionBy(query, file_key)
    d = df.withColumn("round", F.row_number().over(per_file.orderBy(position)) - 1).withColumn("file_order", F.min(position).over(per_file))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("round", "file_order")))


def diversify(df: DataFrame, lam: float = 0.76) -> DataFrame:
    """Greedy maximal marginal relevance per query over (query_id, chunk_id, kb_id, file_path,
    start_line, end_line, score, tokens): adds ``mmr_rank``.

    Sequential by nature; the input is a bounded candidate list per query (a few hundred rows)."""
    import pandas as pd

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = f.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        n = len(f)
        lo, hi = f.score.min(), f.score.max()
        rel = np.ones(n) if hi == lo else ((f.score - lo) / (hi - lo)).to_numpy()
        sets = [set(t) if t is not None else set() for t in f.tokens]
        red, left, rank = np.zeros(n), np.ones(n, dtype=bool), np.zeros(n, dtype=int)
        for r in range(n):
            gain = np.where(left, lam * rel - (1 - lam) * red, -np.inf)
            b = int(np.argmax(gain))
            left[b], rank[b] = False, r + 1
            for i in np.flatnonzero(left):
                inter = len(sets[i] & sets[b])
                union = len(sets[i]) + len(sets[b]) - inter
                lex = inter / union if inter else 0.0
                near = 0.0
                if f.file_path[i] == f.file_path[b] and f.kb_id[i] == f.kb_id[b]:
                    gap = max(f.start_line[i], f.start_line[b]) - min(f.end_line[i], f.end_line[b])
                    near = 1.0 if gap <= 0 else 0.8 if gap <= 20 else 0.45 if gap <= 80 else 0.2
                red[i] = max(red[i], lex, near)
        return pd.DataFrame({"query_id": f.query_id, "chunk_id": f.chunk_id, "score": f.score, "mmr_rank": rank})

    cols = ["query_id", "chunk_id", "kb_id", "file_path", "start_line", "end_line", "score", "tokens"]
    schema = f"query_id {dict(df.dtypes)['query_id']}, chunk_id string, score double, mmr_rank int"
    return df.select(*cols).groupBy("query_id").applyInPandas(pick, schema)


def relation_boost(seed: Column, other: Column) -> Column:
    """How close two chunks stand in their file's structure; both are metadata structs with scope,
    symbol, symbol_kind and parent_symbol."""
    scope = lambda m: F.coalesce(m["scope"], F.array().cast("array<string>"))
    has = lambda m: (F.coalesce(m["symbol"], m["symbol_kind"], m["parent_symbol"], F.lit("")) != "") | (F.size(scope(m)) > 0)
    parent = lambda m: F.when(F.size(scope(m)) > 1, F.slice(scope(m), 1, F.greatest(F.size(scope(m)) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    inside = lambda a, b: (F.size(a) > 0) & (F.size(a) < F.size(b)) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(1))) == a)
    same_symbol = seed["symbol"].eqNullSafe(other["symbol"])
    siblings = (F.size(parent(seed)) > 0) & (parent(seed) == parent(other))
    same_parent = (F.coalesce(seed["parent_symbol"], F.lit("")) != "") & seed["parent_symbol"].eqNullSafe(other["parent_symbol"])
    return (
        F.when(~has(seed) | ~has(other), 0.0)
        .when(siblings, F.when(same_symbol, 0.35).otherwise(1.35))
        .when(same_parent, F.when(same_symbol, 0.35).otherwise(1.2))
        .when(inside(scope(seed), scope(other)) | inside(scope(other), scope(seed)), 0.9)
        .otherwise(0.0)
    )
