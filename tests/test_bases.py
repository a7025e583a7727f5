"""Search of whole bases in tasks, against the search by joins."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import bases, lexical, retrieval, vector
from fathomgrid.plans import search_queries as sq
from fathomgrid.plans.registry import Tables


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("mode", "numbers"), [("hybrid", 4 << 20), ("semantic", 1000)])
def test_bases_in_stretches_and_slices(spark, monkeypatch, mode, numbers):
    t = Tables(spark, DATA)
    want = sq._hybrid_rows(t, mode)[0].withColumn("score", F.round("score", 6))
    want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in lexical.top_k(want, 10, ["query_id"]).collect()}
    monkeypatch.setattr(lexical, "ROWS", 7)
    monkeypatch.setattr(lexical, "CELLS", 50)
    monkeypatch.setattr(bases, "MARKS", 100)
    monkeypatch.setattr(vector, "BROADCAST_NUMBERS", numbers)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in sq._best_rows(t, 10, 6, mode).collect()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert len(got) > 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_candidates_are_not_shuffled(spark):
    """Joins are of bases and vectors only; the legs were joined, scaled and adjusted by shuffles."""
    for df in (sq._best_rows(Tables(spark, DATA), 10, 6), sq._best_rows(Tables(spark, DATA), 10, 6, "semantic")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        after = plan[: plan.index("MapInArrow")]
        assert "Join" not in after and "Aggregate" not in after and after.count("Window") <= 2


def test_products_are_bounded(monkeypatch):
    """All queries times all rows were one matrix."""
    sizes = []
    update = bases.Best.update
    monkeypatch.setattr(bases.Best, "update", lambda self, dense, *a, **k: (sizes.append(dense.size), update(self, dense, *a, **k))[1])
    rng = np.random.default_rng(3)
    n, q, d = 300, 500, 8
    e, m = rng.normal(size=(n, d)).astype(np.float32), rng.normal(size=(q, d))
    asked = bases.Asked(pa.array(range(q)), {d: (np.arange(q), m)}, np.zeros(q + 1, dtype=np.int64), np.empty(0, dtype=np.int64), {w: np.zeros(q, dtype=bool) for w in ("guide", "tests", "localization")})
    b = bases.Base("k", None, asked, pa.array([], pa.string()), bases.Way("semantic", 5, 5, 6, 0.18, 0), 10_000)
    no = pa.array([[]] * n, pa.list_(pa.string()))
    cols = {"chunk_id": pa.array([f"c{i:04}" for i in range(n)]), "kb_id": pa.array(["k"] * n), "trust": pa.array([1.0] * n), "embedding": pa.array(e.tolist(), pa.list_(pa.float32())), "place": pa.array([0.0] * n)}
    b.read(pa.RecordBatch.from_pydict(cols | {f"{s}_signals": no for s in ("text", "path", "stem")} | {f: pa.array([False] * n) for f in bases.FLAGS}))
    assert max(sizes) <= 11_000 and sum(sizes) == n * q
    sims = m @ (e / np.linalg.norm(e.astype(np.float64), axis=1)[:, None]).T
    assert np.allclose(np.sort(b.vector.score, axis=1), np.sort(sims, axis=1)[:, -5:], atol=1e-6)


def test_windows_are_collapsed_without_a_call_each(spark):
    """A pandas call for every query and file took most of the time."""
    rows = [(1, "a", "k", "f", 0.9, ["x", "y"]), (1, "b", "k", "f", 0.8, ["y", "z", "w"]), (1, "c", "k", "f", 0.7, ["q"]), (1, "d", "k", "g", 0.6, ["x"]), (2, "e", "k", None, 0.5, ["x"]), (2, "f", "k", None, 0.5, ["x"])]
    got = retrieval.collapse_windows(spark.createDataFrame(rows, "query_id long, seed_id string, kb_id string, file_path string, score double, sources array<string>"))
    assert "Pandas" not in got._jdf.queryExecution().toString()
    assert sorted((r["query_id"], r["seed_id"]) for r in got.collect()) == [(1, "b"), (1, "c"), (1, "d"), (2, "e")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_formula_boosts_stay_in_the_task(spark):
    plan = sq.ret08_formula_search(Tables(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]
