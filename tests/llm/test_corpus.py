import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomgrid.llm import leakage as lk
from fathomgrid.llm import lsh_forest as lf
from fathomgrid.llm import packing as pk
from fathomgrid.llm.components import connected_components

WORD = re.compile(r"[^\W_]+")


def near_copies(seed=5, groups=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [vocabulary[i] for i in rng.integers(0, 3000, 120)]
        for c in range(int(rng.integers(1, 5))):
            words = list(base)
            for _ in range(int(rng.integers(0, 14))):
                words[int(rng.integers(0, 120))] = vocabulary[int(rng.integers(0, 3000))]
            rows.append((f"d{g:03d}{c}", " ".join(words)))
    return rows


def jaccard_pairs(rows, n, least):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("n", "least"), [(3, 0.5), (5, 0.8)])
def test_pairs_against_brute_force(spark, n, least):
    rows = near_copies()
    got = {tuple(r) for r in lf.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", least, n).collect()}
    want = jaccard_pairs(rows, n, least)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_pair_edges(spark):
    rows = [("a", "one two three four"), ("b", "One, two; THREE four!"), ("c", "one two"), ("d", "one two"), ("e", None), ("f", ""), ("a", "one two three four"), (None, "one two three four"), ("g", "x " * 5000), ("h", "x " * 9000)]
    d = spark.createDataFrame(rows, "id string, content string").withColumn("cls", F.lit(1)).withColumn("rep", F.lit(2)).withColumn("text", F.lit("z"))
    assert {tuple(r) for r in lf.similar_pairs(d, "id", "content", 0.5, 3).collect()} == {("a", "b"), ("g", "h")}
    assert lf.similar_pairs(d.limit(0), "id", "content").collect() == []


def test_large_class_is_a_star(spark):
    rows = [(f"c{i:03d}", "the same text in every copy of it") for i in range(100)] + [("z", "the same text in every copy of it again")]
    got = {tuple(r) for r in lf.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 0.5, 3).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 100)} | {("c000", "z")}


def test_run_over_the_limit_loses_nothing():
    rng = np.random.default_rng(2)
    n = lf.RUN * 2 + 7
    cls, sketch = np.arange(n), np.tile(rng.integers(0, 255, lf.SKETCH).astype(np.uint8), (n, 1))
    label = np.zeros((n, lf.BASE), dtype=np.uint16)
    pairs = {(int(a), int(b)) for x, y in lf._run(cls, label, sketch, lf.BASE, lf.SKETCH) for a, b in zip(x, y)}
    assert len(pairs) == n * (n - 1) // 2


def test_dense_cluster_against_brute_force(spark):
    """1,200 edited copies of one text: most pairs stand near the threshold, runs are far over the block size."""
    rng = np.random.default_rng(8)
    n, size = 1200, 40
    ids, words = np.arange(n), np.tile(np.arange(size), (n, 1))
    for i in range(n):
        for k in rng.choice(size, int(rng.integers(1, 5)), replace=False):
            words[i, k] = 1000 + rng.integers(0, 100000)
    rows = [(f"v{i:04d}", " ".join(f"w{w}" for w in words[i])) for i in ids]
    grams = [[tuple(x[k : k + 3]) for k in range(size - 2)] for x in words.tolist()]
    number = {g: k for k, g in enumerate({g for x in grams for g in x})}
    has = np.zeros((n, len(number)), dtype=np.float32)
    for i, x in enumerate(grams):
        has[i, [number[g] for g in x]] = 1
    shared, total = has @ has.T, has.sum(axis=1)
    alike = np.triu(2 * shared >= total[:, None] + total[None, :] - shared, 1)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(alike))}
    got = {tuple(r) for r in lf.similar_pairs(spark.createDataFrame(rows, "id string, content string"), "id", "content", 0.5, 3).collect()}
    assert len(want) > 100_000 and got <= want and len(got) >= 0.99 * len(want)


def test_groups(spark):
    rows = [("a", "p q r s t u v w x y"), ("b", "p q r s t u v w x y"), ("c", "p q r s t u v w x z"), ("d", "other words that are far from all else here")]
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in lf.similar_groups(spark.createDataFrame(rows, "id string, content string"), "id", "content", 0.6, 3).collect()}
    assert got == {"a": ("a", "a", 2), "b": ("a", "a", 2), "c": ("c", "a", 1)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "x long, y long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


ITEM = "Let station Ladrom denote the manifold whose modes sum to 698,083; find the share owed to Queomir before the exporter reaches grade 848"


def leak_rows():
    w = ITEM.split()
    return [
        (1, "Some words before. " + ITEM + " And after."), (2, " ".join(w[:12])), (3, " ".join(w[:9])), (4, ITEM.upper().replace(" ", "\n")), (5, "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>"), (6, " ".join(f"[{x}](n/{k}.md)" for k, x in enumerate(w))),
        (7, " ".join(x if k % 6 != 3 else "swapped" for k, x in enumerate(w))), (8, None), (9, ""), (10, "nothing at all"), (11, ITEM.replace(" ", "&nbsp;")), (1, "unrelated second row of the same id"),
    ]


@pytest.mark.parametrize("bound", [lk.BROADCAST_CHARS, 1])
def test_leaks(spark, bound):
    d = spark.createDataFrame(leak_rows(), "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("run", F.lit(0))
    items = spark.createDataFrame([(1, ITEM), (2, "a b c"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert {tuple(r) for r in lk.leaked_documents(d, items, broadcast_chars=bound).collect()} == {(k, 1) for k in (1, 2, 4, 5, 6, 11)}


def test_substitutions_are_measured(spark):
    d = spark.createDataFrame([(7, " ".join(x if k != 8 else "swapped" for k, x in enumerate(ITEM.split())))], "doc_id long, text string")
    (r,) = lk.leaked_passages(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    n = len(WORD.findall(ITEM))
    assert r["overlap"] == n and r["matched"] == n - 1 and r["run"] < n


def test_leak_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(leak_rows(), "doc_id long, text string")
    assert lk.leaked_documents(d, none).collect() == []
    assert lk.leaked_documents(d.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        lk.leaked_documents(d, none, least=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_places_every_item(sizes):
    counts = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, dtype=np.int64)
    plan = pk.plan(counts, 64)
    placed = np.zeros(65, dtype=np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        placed += times * np.bincount(pattern, minlength=65)
    assert (placed == counts).all() and len(plan) <= pk.pattern_bound(64)
    used = sum(t for _, t in plan)
    assert used <= max(1, 1.5 * np.ceil(sum(sizes) / 64)) or not sizes


def test_exact_complements_come_first():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40, 50, 30, 20]] = [3, 3, 3, 3, 3]
    assert all(sum(p) == 100 for p, _ in pk.plan(counts, 100))


def test_pack_documents(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"  # one token per byte: sizes are known
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)))
    rows = [(1, "a" * 10), (2, "b" * 22), (3, "c" * 6), (4, "d" * 4), (5, None), (6, ""), (7, "e" * 10), (7, "e" * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("part", F.lit(0))
    got = pk.pack_documents(d, 10, str(path)).collect()
    spans = sorted((r["doc_id"], r["piece"], r["token_start"], r["token_end"]) for r in got)
    assert spans == [(1, 0, 0, 10), (2, 0, 0, 10), (2, 1, 10, 20), (2, 2, 20, 22), (3, 0, 0, 6), (4, 0, 0, 4), (7, 0, 0, 10), (7, 0, 0, 10)]
    fill = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
    assert sorted(fill.values()) == [2, 10, 10, 10, 10, 10, 10] and sorted(fill) == list(range(7))
    assert pk.pack_documents(d.limit(0), 10, str(path)).collect() == []


def test_bit_filter_holds_all_it_was_given(spark):
    from fathomgrid.llm import batches

    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 5000, dtype=np.int64)
    table = batches.bit_filter(spark.createDataFrame([(int(v),) for v in x], "h long"), "h")
    assert len(table) == 1 << (batches.FILTER_BITS - 3) and batches.may_hold(table, x.view(np.uint64)).all()
    other = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert batches.may_hold(table, other).mean() < 0.01
    assert not batches.may_hold(batches.bit_filter(spark.createDataFrame([], "h long"), "h"), other).any()
