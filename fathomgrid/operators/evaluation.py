"""Golden evaluation: what a batch of queries got against what it should get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meets(result: str = "r", expect: str = "g", columns: list[str] = ()) -> Column:
    """Whether a result meets an expectation: every stated part of it holds (file_path, path_prefix,
    min_score, must_reason; null or missing parts are not stated)."""
    r, g = lambda c: F.col(f"{result}.{c}"), lambda c: F.col(f"{expect}.{c}")
    rules = {
        "file_path": lambda: r("file_path") == g("file_path"),
        "path_prefix": lambda: F.startswith(r("file_path"), g("path_prefix")),
        "min_score": lambda: r("score") >= g("min_score"),
        "must_reason": lambda: r("reason") == g("must_reason"),
    }
    ok = F.lit(True)
    for c, rule in rules.items():
        if c in columns:
            ok = ok & (g(c).isNull() | F.coalesce(rule(), F.lit(False)))
    return ok


def outcomes(golden: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(query_id, domain, rank, passed): the rank of the first of a query's ``k`` best results that meets
    its expectation, null if none does.  golden: (query_id, domain, expectation columns); results:
    (query_id, rank, file_path, score, ...)."""
    r = results.where(F.col("rank") <= k).alias("r")
    j = golden.alias("g").join(r, F.col("g.query_id") == F.col("r.query_id"), "left")
    hit = F.when(F.col("r.query_id").isNotNull() & meets(columns=golden.columns), F.col("r.rank"))
    g = j.groupBy(F.col("g.query_id").alias("query_id"), F.col("g.domain").alias("domain")).agg(F.min(hit).alias("rank"))
    return g.withColumn("passed", F.col("rank").isNotNull())


def recall(found: DataFrame) -> DataFrame:
    """(domain, queries, hits, recall): per domain, and over all (domain null)."""
    g = found.rollup("domain").agg(F.count(F.lit(1)).alias("queries"), F.count_if("passed").alias("hits"))
    return g.withColumn("recall", F.col("hits") / F.col("queries"))
