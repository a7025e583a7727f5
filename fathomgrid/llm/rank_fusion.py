"""Problem 1: one ranking from several differently-scaled scores (ideal-point ranking).

Per query and leg the scores are winsorised at two quantiles (of many rows the upper one lies higher,
so that it cuts off some rows and not a share), moved to the lower bound and vector-normalised.  A row's closeness is d-/(d+ + d-) from its weighted Euclidean distances to the
ideal point (best value on every leg) and the anti-ideal point (no evidence on any leg).

Defined results: the row with the latest ``seen_at`` holds for a query, chunk and leg (of equal
times, and of null times, the higher score); a null score or NaN is no evidence, as is a leg that
didn't return the chunk; rows with a null query, chunk or leg, or an unknown leg, don't count;
repeated rows count once; a leg with one distinct value decides nothing; ties are broken by what
the bounds cut off (bounded per leg, so that no leg decides), then by chunk id; both are compared to nine digits.  Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The legs and their weights: BM25Result.score, VectorResult.score, FusionResult.score, RankingDiagnostics.adjusted_score.
LEGS: Mapping[str, float] = {"bm25": 1.0, "vector": 1.0, "fusion": 1.0, "adjusted": 1.0}


#: Rows of a leg above the upper bound: at most twice as many, where the quantile alone would cut off more.
ABOVE = 10
_HALVINGS = 30


def _leg_stats(wide: DataFrame, legs: list[str], low: float, high: float, accuracy: int) -> DataFrame:
    """Winsor bounds of each leg in one mergeable aggregate: partial on the map side, so a query
    that holds a third of all rows costs its reducer only sketches."""
    exprs: list[Column] = []
    for leg in legs:
        # The upper share is halved as long as ABOVE rows are left over it.
        shares = [high, *(1 - (1 - high) / 2**j for j in range(1, _HALVINGS + 1))]
        q = F.percentile_approx(F.col(leg), F.array(F.lit(low), *map(F.lit, shares)), accuracy)
        at = F.greatest(F.lit(0), F.least(F.lit(_HALVINGS), F.floor(F.log2(F.greatest(F.count(leg) * (1 - high) / ABOVE, F.lit(1.0)))).cast("int")))
        exprs.append(F.array(q[0], F.get(q, at + 1)).alias(f"q_{leg}"))
    return wide.groupBy("query_id").agg(*exprs)


def ideal_point_scores(
    hits: DataFrame,
    weights: Mapping[str, float] = LEGS,
    low: float = 0.10,
    high: float = 0.85,
    accuracy: int = 10000,
    salts: int = 16,
) -> DataFrame:
    """(query_id, chunk_id, closeness, over, one normalised column per leg) for every hit."""
    legs = sorted(weights)
    clean = (
        hits.select("query_id", "chunk_id", "leg", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), "seen_at")
        .where(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("leg").isin(legs))
    )
    # The latest row of each leg and the pivot in one aggregation keyed by (query, chunk).
    latest = [
        F.max(F.when(F.col("leg") == leg, F.struct(F.coalesce(F.col("seen_at"), F.timestamp_micros(F.lit(0))), F.col("score").alias("score"))))["score"].alias(leg)
        for leg in legs
    ]
    wide = clean.groupBy("query_id", "chunk_id").agg(*latest)
    # A hot query's rows are spread by a salt; the per-query statistics (one row each) are repeated per salt.
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int")
    salted = wide.withColumn("_salt", salt)
    bounds = _leg_stats(wide, legs, low, high, accuracy).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = salted.join(bounds, ["query_id", "_salt"])

    def over(leg: str) -> Column:
        """What the upper bound cuts off, between 0 and 1."""
        span, cut = F.col(f"q_{leg}")[1] - F.col(f"q_{leg}")[0], F.greatest(F.col(leg) - F.col(f"q_{leg}")[1], F.lit(0.0))
        return F.when((span > 0) & F.col(leg).isNotNull(), 1 - span / (cut + span)).otherwise(0.0)

    shifted = joined.select(
        "query_id", "chunk_id", "_salt",
        *[
            F.coalesce(F.least(F.greatest(F.col(leg), F.col(f"q_{leg}")[0]), F.col(f"q_{leg}")[1]) - F.col(f"q_{leg}")[0], F.lit(0.0)).alias(leg)
            for leg in legs
        ],
        sum((F.lit(weights[leg]) * over(leg) for leg in legs), F.lit(0.0)).alias("over"),
    )
    norms = shifted.groupBy("query_id").agg(
        *[F.sqrt(F.sum(F.col(leg) * F.col(leg))).alias(f"n_{leg}") for leg in legs],
        *[F.max(leg).alias(f"m_{leg}") for leg in legs],
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    unit = lambda value, leg: F.when(F.col(f"n_{leg}") > 0, value / F.col(f"n_{leg}")).otherwise(0.0)
    v = shifted.join(norms, ["query_id", "_salt"])
    total = lambda terms: F.sqrt(sum(terms, F.lit(0.0)))
    to_ideal = total([F.lit(weights[leg]) * F.pow(unit(F.col(f"m_{leg}") - F.col(leg), leg), 2) for leg in legs])
    to_anti = total([F.lit(weights[leg]) * F.pow(unit(F.col(leg), leg), 2) for leg in legs])
    return v.select(
        "query_id", "chunk_id",
        to_ideal.alias("d_ideal"), to_anti.alias("d_anti"),
        F.when(to_ideal + to_anti > 0, to_anti / (to_ideal + to_anti)).otherwise(0.0).alias("closeness"),
        "over",
        *[unit(F.col(leg), leg).alias(f"v_{leg}") for leg in legs],
    )


def ideal_point_ranking(hits: DataFrame, top: int | None = None, **options) -> DataFrame:
    """``ideal_point_scores`` with ``position`` 1, 2, ... per query; only the first ``top`` if given.

    The row_number filter becomes a group limit before the shuffle, so a hot query sends ``top``
    rows per partition to its reducer.
    """
    r = lambda c: F.round(c, 9).desc()  # noqa: E731  sums in another order differ in the last digits
    w = Window.partitionBy("query_id").orderBy(r("closeness"), r("over"), F.col("chunk_id"))
    ranked = ideal_point_scores(hits, **options).withColumn("position", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("position") <= top)
