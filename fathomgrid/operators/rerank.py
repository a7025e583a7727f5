"""Reranking: local scorers as Columns, logits to relevance, and a service's request and response forms."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx


def overlap_scorer(query: Column, content: Column) -> Column:
    """A deterministic offline scorer: token overlap as a logit. No model, no parity claimed."""
    return 8 * tx.jaccard(tx.search_tokens(query), tx.search_tokens(content)) - 1


def relevance(logits: Column, kind: str = "sigmoid") -> Column:
    """Relevance of an array of class logits: sigmoid of the only one, softmax of the last, or raw."""
    if kind == "sigmoid":
        return 1 / (1 + F.exp(-F.element_at(logits, 1)))
    if kind == "softmax":
        top = F.array_max(logits)
        return F.exp(F.element_at(logits, -1) - top) / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.element_at(logits, 1)


def request_body(form: str, model: str, query: str, documents: list[str], top: int) -> dict:
    if form == "tei":
        return {"query": query, "texts": documents}
    return {"model": model, "query": query, "documents": documents, "top_n": top}


def response_scores(form: str, body: dict | list, results: str = "results", index: str = "index", score: str = "relevance_score") -> list[tuple[int, float]]:
    """(document number, score) of a response; dotted paths; repeated numbers keep the first."""
    at = body
    if form != "tei":
        for part in results.split("."):
            at = at[part]
    key = ("index", "score") if form == "tei" else (index, score)
    seen: dict[int, float] = {}
    for r in at:
        seen.setdefault(int(r[key[0]]), float(r[key[1]]))
    return list(seen.items())


def rerank_by_service(candidates: DataFrame, call: Callable[[str], str], form: str = "cohere", model: str = "", top: int = 20) -> DataFrame:
    """candidates (query_id, query_text, chunk_id, content) -> (query_id, chunk_id, relevance), by one
    request per query's bounded candidate list; ``call`` takes and gives JSON text."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        body = request_body(form, model, f["query_text"].iloc[0], f["content"].tolist(), top)
        got = response_scores(form, json.loads(call(json.dumps(body))))
        got = [(i, s) for i, s in got if 0 <= i < len(f)]
        return pd.DataFrame({"query_id": f["query_id"].iloc[0], "chunk_id": [f["chunk_id"].iloc[i] for i, _ in got], "relevance": [s for _, s in got]})

    kind = dict(candidates.dtypes)["query_id"]
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind}, chunk_id string, relevance double")
