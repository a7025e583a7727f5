"""BM25 made where the chunk is, against brute force and against joins."""

import random

import pytest

from fathomgrid.operators import lexical

WORDS = "alpha beta gamma delta 3.14 eta.eta theta iota".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices([*WORDS, "filler", "14", "eta"], k=rng.randrange(0, 14))) for _ in range(120)]
    chunks = [(f"c{i:03}", ("k1", "k2", "k3", None)[min(3, i * i % 7 // 2)], t) for i, t in enumerate([*texts, None])]
    queries = [(i, " ".join(rng.sample(WORDS, rng.randrange(1, 4)))) for i in range(25)] + [(98, ""), (99, None)]
    return spark.createDataFrame(chunks, "id string, kb_id string, content_tokenized string").repartition(3), spark.createDataFrame(queries, "query_id long, query_text string")


def exchanged(df):
    """What each exchange of a plan passes on."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join") + plan.count("Aggregate")


def test_pairs_are_not_shuffled(spark, rows, monkeypatch):
    new = lexical.bm25_scores(*rows)
    assert exchanged(new) == 0  # each pair was shuffled twice
    got = {(r["query_id"], r["kb_id"], r["chunk_id"]): (round(r["score"], 9), r["matched"], r["terms"]) for r in new.collect()}
    monkeypatch.setattr(lexical, "TERMS", 1)
    old = lexical.bm25_scores(*rows)
    assert exchanged(old) > 2
    assert got == {(r["query_id"], r["kb_id"], r["chunk_id"]): (round(r["score"], 9), r["matched"], r["terms"]) for r in old.collect()} and len(got) > 500


@pytest.mark.parametrize("match", ["any", "all", "relaxed"])
@pytest.mark.parametrize("by", [["query_id"], ["query_id", "kb_id"]])
def test_top_in_stretches_and_parts(spark, rows, monkeypatch, match, by):
    """Small stretches of rows and queries, so that bests are carried over; ties go by chunk."""
    want = {}
    for r in lexical.bm25_scores(*rows).collect():
        want.setdefault((r["query_id"], r["kb_id"] if len(by) > 1 else 0), []).append((r["matched"] == r["terms"], -round(r["score"], 9), r["chunk_id"]))
    for g, v in want.items():
        full = [x for x in v if x[0]]
        v = full if match == "all" or match == "relaxed" and full else v
        want[g] = [(n + 1, c, -s) for n, (s, c) in enumerate(sorted((x[1], x[2]) for x in v)[:4])]
    monkeypatch.setattr(lexical, "CELLS", 60)
    monkeypatch.setattr(lexical, "ROWS", 10)
    got = {}
    for r in lexical.bm25_top(*rows, 4, by, match).collect():
        got.setdefault((r["query_id"], r["kb_id"] if len(by) > 1 else 0), []).append((r["rank"], r["chunk_id"], r["score"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: v for g, v in want.items() if v}


def test_no_queries_and_no_chunks(spark, rows):
    chunks, queries = rows
    for c, q in ((chunks, queries.limit(0)), (chunks.limit(0), queries), (chunks, queries.where("query_id >= 98"))):
        assert lexical.bm25_scores(c, q).collect() == [] == lexical.bm25_top(c, q, 3, ["query_id", "kb_id"], "relaxed").collect()
