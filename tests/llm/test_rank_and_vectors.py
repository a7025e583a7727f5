import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import curve_knn as ck
from fathomgrid.llm import rank_fusion as rf

HITS = "query_id long, chunk_id string, kb_id string, leg string, score double, seen_at timestamp"


def hits(spark, rows):
    return spark.createDataFrame([(q, c, "k", leg, s, None) for q, c, leg, s in rows], HITS)


def brute(rows, low=0.10, high=0.85):
    """The definition in numpy, with the same discrete quantiles."""
    legs = sorted(rf.LEGS)
    best = {}
    for q, c, leg, s in rows:
        if s is not None:
            best[q, c, leg] = max(s, best.get((q, c, leg), -np.inf))
    out = {}
    for q in {r[0] for r in rows}:
        ids = sorted({r[1] for r in rows if r[0] == q})
        x = np.full((len(ids), 4), np.nan)
        for i, c in enumerate(ids):
            for j, leg in enumerate(legs):
                x[i, j] = best.get((q, c, leg), np.nan)
        for j in range(4):
            v = np.sort(x[~np.isnan(x[:, j]), j])
            if not len(v):
                x[:, j] = 0
                continue
            a, b = (v[max(0, int(np.ceil(p * len(v))) - 1)] for p in (low, high))
            x[:, j] = np.nan_to_num(np.clip(x[:, j], a, b) - a, nan=0.0)
            n = np.sqrt((x[:, j] ** 2).sum())
            x[:, j] = x[:, j] / n if n else 0
        up, down = np.sqrt(((x.max(0) - x) ** 2).sum(1)), np.sqrt((x**2).sum(1))
        for i, c in enumerate(ids):
            out[q, c] = down[i] / (up[i] + down[i]) if up[i] + down[i] else 0.0
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(q, f"c{c:02d}", leg, None if rng.random() < 0.1 else float(rng.normal() * scale)) for q in (1, 2) for c in range(30) for leg, scale in (("bm25", 1000), ("vector", 0.01), ("fusion", 1), ("adjusted", 5))]
    got = {(r["query_id"], r["chunk_id"]): r["closeness"] for r in rf.ideal_point_scores(hits(spark, rows)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_no_leg_decides_alone(spark):
    rows = [(1, f"c{c}", leg, v) for c in range(20) for leg, v in (("bm25", 10.0 * c), ("vector", 0.01 * c), ("fusion", float(c)), ("adjusted", float(c)))]
    rows = [(q, c, leg, 1e9 if (c, leg) == ("c0", "bm25") else s) for q, c, leg, s in rows]
    top = [r["chunk_id"] for r in rf.ideal_point_ranking(hits(spark, rows), top=3).orderBy("position").collect()]
    assert "c0" not in top


def test_query_of_many_chunks(spark):
    """Ten chunks lead on every leg before hundreds that are also in the best 15 %."""
    rng = np.random.default_rng(4)
    level = lambda c: 20 if c >= 2990 else 5 if c < 600 else 0
    rows = [(1, f"c{c:04d}", leg, (level(c) + float(rng.random())) * scale) for c in range(3000) for leg, scale in (("bm25", 1000), ("vector", 0.01), ("fusion", 1), ("adjusted", 5))]
    top = {r["chunk_id"] for r in rf.ideal_point_ranking(hits(spark, rows), top=10).collect()}
    assert top == {f"c{c}" for c in range(2990, 3000)}


def test_ties_of_clipped_rows(spark):
    rows = [(1, f"c{c:02d}", leg, float(c)) for c in range(40) for leg in ("bm25", "vector")]
    got = rf.ideal_point_ranking(hits(spark, rows), top=3).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["c39", "c38", "c37"]


def test_edges(spark):
    assert rf.ideal_point_ranking(hits(spark, [])).collect() == []
    rows = [(1, "a", "bm25", 1.0), (1, "a", "bm25", 1.0), (1, "b", "bm25", 1.0), (1, None, "bm25", 2.0), (None, "a", "bm25", 2.0), (1, "c", "other", 5.0), (1, "d", "vector", None), (2, "x", "vector", float("nan"))]
    d = hits(spark, rows).withColumn("q_bm25", F.lit(9)).withColumn("_salt", F.lit(1)).withColumn("position", F.lit(0))
    got = rf.ideal_point_ranking(d).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["chunk_id"], r["position"]) for r in got] == [(1, "a", 1), (1, "b", 2), (1, "d", 3), (2, "x", 1)]
    assert all(r["closeness"] == 0 for r in got)


def test_latest_score_holds(spark):
    from datetime import datetime

    rows = [(1, "a", "k", "bm25", 9.0, datetime(2025, 1, 1)), (1, "a", "k", "bm25", 1.0, datetime(2025, 1, 2)), (1, "b", "k", "bm25", 5.0, datetime(2025, 1, 1)), (1, "c", "k", "bm25", 2.0, datetime(2025, 1, 1))]
    got = rf.ideal_point_ranking(spark.createDataFrame(rows, HITS), low=0.0, high=1.0).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == ["b", "c", "a"]


def test_hilbert_is_a_curve():
    side, dims = 8, 2
    cells = np.array([(a, b) for a in range(side) for b in range(side)])
    key = ck.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(side**dims))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # each step goes to a neighbour


VEC = "chunk_id string, kb_id string, embedding array<float>, embedded_at timestamp"


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 24))
    x = np.repeat(centres, 10, axis=0) + 0.2 * rng.normal(size=(3000, 24))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    rows = [(f"c{i:04d}", "k", [float(z) for z in v], None) for i, v in enumerate(x)]
    b = spark.createDataFrame([("k", 24)], "id string, embedding_dimension int")
    got = {tuple(r) for r in ck.nearest_pairs(spark.createDataFrame(rows, VEC), b, 5, block=128).collect()}
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    want = {tuple(sorted((f"c{i:04d}", f"c{j:04d}"))) for i in range(3000) for j in np.argsort(-sim[i])[:5]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_recall_of_one_large_collection(spark):
    """40,000 vectors in one collection, far over a stretch; 400 of them against brute force."""
    rng = np.random.default_rng(9)
    n, dim = 40_000, 64
    x = np.repeat(rng.normal(size=(n // 10, dim)), 10, axis=0) / np.sqrt(dim)
    x = (x + 0.5 / np.sqrt(dim) * rng.normal(size=(n, dim))).astype(np.float32)
    import pandas as pd

    v = spark.createDataFrame(pd.DataFrame({"chunk_id": [str(i) for i in range(n)], "kb_id": "k", "embedding": x.tolist(), "embedded_at": None}), VEC)
    near, names = ck.nearest(v, spark.createDataFrame([("k", dim)], "id string, embedding_dimension int"), 5)
    name = {r["id"]: int(r["chunk_id"]) for r in names.select("id", "chunk_id").collect()}
    got = {name[r["id"]]: {name[o] for o in r["near"]} for r in near.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = rng.choice(n, 400, replace=False)
    sim = u[asked] @ u.T
    sim[np.arange(400), asked] = -9
    found = [len(got[int(q)] & set(best)) for q, best in zip(asked, np.argsort(-sim, axis=1)[:, :5].tolist())]
    assert len(got) == n and sum(found) >= 0.9 * 5 * 400


def test_vector_edges(spark):
    from datetime import datetime

    b = spark.createDataFrame([("k", 2), ("n", None), ("one", 2), ("z", 0)], "id string, embedding_dimension int")
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [
        ("a", "k", [1.0, 0.0], t0), ("a", "k", [1.0, 0.0], t0), ("b", "k", [0.0, 5.0], t0), ("b", "k", [2.0, 0.1], t1), ("c", "k", [0.0, 3.0], None), ("zero", "k", [0.0, 0.0], t0), ("null", "k", None, t0), ("hole", "k", [1.0, None], t0),
        ("nan", "k", [1.0, float("nan")], t0), ("long", "k", [1.0, 0.0, 0.0], t0), (None, "k", [1.0, 0.0], t0), ("x", "n", [1.0, 0.0], t0), ("alone", "one", [1.0, 0.0], t0), ("empty", "z", [], t0), ("q", None, [1.0, 0.0], t0),
    ]
    v = spark.createDataFrame(rows, VEC).withColumn("dim", F.lit(7)).withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    near, names = ck.nearest(v, b, 1)
    ids = {r["id"]: r["chunk_id"] for r in names.collect()}
    got = {ids[r["id"]]: [ids[n] for n in r["near"]] for r in near.collect()}
    assert got == {"a": ["b"], "b": ["a"], "c": ["b"], "alone": []}
    assert ck.nearest_pairs(v.limit(0), b).collect() == []
    same = spark.createDataFrame([(f"s{i}", "k", [1.0, 1.0], None) for i in range(4)], VEC)
    assert ck.nearest_pairs(same, b, 5).count() == 6
