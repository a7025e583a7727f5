import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx
from fathomgrid.operators import lexical, maintenance, ranking, rerank, vector
from fathomgrid.sources import documents, files


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_tokens_and_signals(spark):
    r = one(spark, t="the tests of 11.94 permissions how setpup").select(tx.search_tokens(F.col("t")).alias("k"), tx.signals(tx.search_tokens(F.col("t"))).alias("s")).first()
    assert "11.94" in r["k"] and "setup" in r["k"] and set(r["s"]) == {"test", "11.94", "permission", "setup"}


def test_file_types_and_paths(spark):
    d = spark.createDataFrame([("a/b.TSX",), ("x.unknown",), ("bot/errors_test.go",), ("src/foo.spec.ts",), ("__tests__/foo.ts",), ("lang/de.json",)], "p string")
    r = {x["p"]: x for x in d.select("p", tx.file_type(F.col("p")).alias("t"), tx.is_test_path(F.col("p")).alias("test"), tx.is_localization_path(F.col("p"), F.lit("json")).alias("loc")).collect()}
    assert r["a/b.TSX"]["t"] == "typescript" and r["x.unknown"]["t"] == "text"
    assert all(r[p]["test"] for p in ("bot/errors_test.go", "src/foo.spec.ts", "__tests__/foo.ts")) and r["lang/de.json"]["loc"]


@pytest.mark.parametrize(("query", "mode"), [("`foo`", "fast"), ("HTMLElement", "fast"), ("why is it slow", "semantic"), ("cold start", "hybrid")])
def test_auto_mode(spark, query, mode):
    assert one(spark, q=query).select(tx.auto_mode(F.col("q")).alias("m")).first()["m"] == mode


@pytest.fixture
def corpus(spark):
    rows = [("c1", "kb", "FTS finds exact words in 11.94 microseconds"), ("c2", "kb", "vectors find near meanings"), ("c3", "kb", "認 證 流 程 OAuth token"), ("c4", "kb", "React state and vectors"), ("t1", "kb2", "tie anchor"), ("t2", "kb2", "tie anchor"), ("n", "kb2", None)]
    return spark.createDataFrame(rows, "id string, kb_id string, content_tokenized string")


def test_bm25_and_or_phrases_ties(spark, corpus):
    q = spark.createDataFrame([(1, "vectors meanings"), (2, "vectors token"), (3, "11.94"), (4, "tie anchor"), (5, ""), (6, None), (7, "94.11")], "query_id long, query_text string")
    r = lexical.bm25_search(corpus, q, 10).collect()
    got = {}
    for x in sorted(r, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["chunk_id"])
    assert got[1] == ["c2"] and set(got[2]) == {"c2", "c3", "c4"} and got[3] == ["c1"] and got[4] == ["t1", "t2"]
    assert 5 not in got and 6 not in got and 7 not in got  # the order of a phrase's terms counts


def test_fusion_and_min_max(spark):
    lex = spark.createDataFrame([(1, "k", "a", 100.0), (1, "k", "b", 20.0), (1, "k", "c", 1.0)], "query_id long, kb_id string, chunk_id string, score double")
    vec = spark.createDataFrame([(1, "k", "b", 0.95), (1, "k", "c", 0.7), (1, "k", "d", 0.2)], "query_id long, kb_id string, chunk_id string, score double")
    s = {r["chunk_id"]: r["score"] for r in ranking.fuse(lex, vec).collect()}
    assert s["a"] == pytest.approx(0.45) and s["b"] == pytest.approx(0.45 * 19 / 99 + 0.55 + 0.15) and s["c"] == pytest.approx(0.55 * 0.5 / 0.75) and s["d"] == 0.0


def test_vector_search(spark):
    v = spark.createDataFrame([("k", "x0", [1.0, 0.0, 0.0, 0.0]), ("k", "x1", [0.0, 1.0, 0.0, 0.0]), ("k", "x2", [0.0, 0.0, 1.0, 0.0]), ("k", "x3", [0.9, 0.1, 0.0, 0.0]), ("k", "short", [1.0]), ("k", "hole", [1.0, None, 0.0, 0.0]), ("k", "nan", [float("nan"), 0.0, 0.0, 0.0]), ("k", "null", None), (None, "nobase", [0.5, 0.0, 0.0, 0.0])], "kb_id string, chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["chunk_id"] for r in vector.vector_search(v, q, 2).where("kb_id = 'k'").orderBy("rank").collect()] == ["x0", "x3"]
    assert [r["chunk_id"] for r in vector.vector_search(v, q, 9).where("kb_id is null").collect()] == ["nobase"]
    assert vector.vector_search(v.limit(0), q, 2).collect() == [] == vector.vector_search(v, q.limit(0), 2).collect()


def test_diversify_prefers_other_files(spark):
    rows = [(1, "a", "k", "f", 1, 5, 1.0, ["x", "y"]), (1, "b", "k", "f", 2, 6, 0.9, ["x", "y"]), (1, "c", "k", "g", 1, 5, 0.8, ["z"])]
    d = spark.createDataFrame(rows, "query_id long, chunk_id string, kb_id string, file_path string, start_line int, end_line int, score double, tokens array<string>")
    assert [r["chunk_id"] for r in ranking.diversify(d, 0.5).orderBy("mmr_rank").collect()] == ["a", "c", "b"]


def test_reconcile_counts_duplicates(spark):
    a, b = spark.createDataFrame([("h",), ("h",), ("g",)], "h string"), spark.createDataFrame([("h",), ("n",)], "h string")
    got = {r["hash"]: (r["retained"], r["removed"], r["added"]) for r in maintenance.reconcile(a, b, "h").collect()}
    assert got == {"h": (1, 1, 0), "g": (0, 1, 0), "n": (0, 0, 1)}


def test_label_resolution(spark):
    d = spark.createDataFrame([("s", "f1", "l", "c1"), ("s", "f2", "l", "c2"), ("s", "f3", "m", "c3"), ("s", "f4", "n", "c4"), ("s", "f5", "n", "c5")], "scope string, path string, label string, target string")
    r = spark.createDataFrame([("s", "x", "f1", "l"), ("s", "y", "f9", "l"), ("s", "y", "f9", "m"), ("s", "y", "f9", "n"), ("s", "y", "f9", "zz")], "scope string, chunk_id string, path string, label string")
    got = {(x["chunk_id"], x["label"]): x["target"] for x in maintenance.resolve_labels(r, d).collect()}
    assert got == {("x", "l"): "c1", ("y", "l"): None, ("y", "m"): "c3", ("y", "n"): None, ("y", "zz"): None}


def test_rerank_forms(spark):
    assert rerank.response_scores("cohere", {"results": [{"index": 1, "relevance_score": 0.5}, {"index": 1, "relevance_score": 0.1}]}) == [(1, 0.5)]
    assert rerank.response_scores("tei", [{"index": 0, "score": 2}]) == [(0, 2.0)]
    assert rerank.response_scores("custom-json", {"a": {"b": [{"i": 0, "s": 1}]}}, "a.b", "i", "s") == [(0, 1.0)]
    r = one(spark, l=[0.0, 2.0]).select(rerank.relevance(F.col("l")).alias("a"), rerank.relevance(F.col("l"), "softmax").alias("b")).first()
    assert r["a"] == 0.5 and 0.88 < r["b"] < 0.89


def test_ignore_rules_and_scan(spark, tmp_path):
    tree = {
        "a.py": b"x = 1", "node_modules/m.js": b"1", "b.bin": b"\0", "c.txt": b"\0\1bin", "logs/x.log": b"l", "keep/notes.md": b"# hi", ".env": b"KEY=1", "deep/.env.local": b"K=2", "certs/server.pem": b"-", "id.key": b"k", "my-secrets.txt": b"s", "docs/an-eval-report.md": b"r",
        "skip/me.md": b"m", "skip/not.md": b"n", "big.txt": b"x" * 200, ".gitignore": b"# own rules\nskip/*\n!skip/not.md\n",
    }
    for name, data in tree.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_bytes(data)
    s = files.scan(spark, str(tmp_path), max_bytes=100)
    got = {r["rel_path"]: r["reason"] for r in s.select("rel_path", "reason").collect()}
    out = "suggested_excluded"
    assert got == {
        "a.py": None, "node_modules/m.js": out, "b.bin": "binary", "c.txt": "binary", "logs/x.log": None, "keep/notes.md": None, "certs/server.pem": out, "id.key": out, "my-secrets.txt": out, "docs/an-eval-report.md": out,
        "skip/me.md": out, "skip/not.md": None, "big.txt": "oversized",
    }
    assert {r["file_type"] for r in files.readable(s).collect()} == {"python", "markdown", "text"}
    assert files.index_plan(s).first()["files"] == 4 and files.index_plan(s).first()["skipped"] == 9
    report = {r["reason"]: (r["n"], r["samples"]) for r in files.skip_report(s, samples=2).collect()}
    assert report["oversized"] == (1, ["big.txt"]) and report[out] == (6, ["certs/server.pem", "docs/an-eval-report.md"])
    plan = s._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)" in plan
    again = {r["rel_path"]: r["reason"] for r in files.scan(spark, str(tmp_path), include=["node_modules"], exclude=["keep"]).collect()}
    assert again["node_modules/m.js"] is None and again["keep/notes.md"] == out
    p = spark.createDataFrame([("src/a.tmp",), ("src/keep.tmp",), ("src/b.py",)], "p string")
    assert [r[0] for r in p.select(files.ignore_pattern(F.col("p"), ["*.tmp", "!keep.tmp"])).collect()] == [True, False, False]


def test_classify_source(spark):
    rows = [("http://x", None, "url"), ("/srv/a", "directory", "directory"), ("/srv/a.md", "file", "file"), ("./gone", None, "missing"), ("notes.txt", None, "missing"), ("some words of text", None, "text"), ("a/b", None, "missing"), ("line\n/two", None, "text"), (None, None, "text"), ("//host", None, "text")]
    d = spark.createDataFrame(rows, "s string, k string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", files.classify_source(F.col("s"), F.col("k")).alias("got")).collect())


def test_documents(spark):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>')
    assert documents.docx_text(buf.getvalue()) == "Hello\n\nWorld" and documents.docx_text(b"no zip") is None
    pages = documents.fetch(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string"), download=lambda u: {"u1": ("text/html", b"<p>x</p>"), "u2": ("image/png", b"")}[u])
    assert {r["url"]: r["error"] for r in pages.collect()} == {"u1": None, "u2": "type image/png", "u3": "KeyError"}


def test_relation_boost(spark):
    from fathomgrid.functions.metadata import metadata

    pairs = [
        ('{"scope": ["A", "f"], "symbol": "f"}', '{"scope": ["A", "g"], "symbol": "g"}', 1.35), ('{"scope": ["A", "f"], "symbol": "f"}', '{"scope": ["A", "f"], "symbol": "f"}', 0.35), ('{"parent_symbol": "A", "symbol": "f"}', '{"parent_symbol": "A", "symbol": "g"}', 1.2),
        ('{"scope": ["A"]}', '{"scope": ["A", "f"]}', 0.9), ("{}", '{"scope": ["A"]}', 0.0), ("broken", None, 0.0),
    ]
    d = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in d.select("want", ranking.relation_boost(metadata(F.col("a")), metadata(F.col("b"))).alias("got")).collect():
        assert r["got"] == r["want"]


def test_numbers_within_a_hot_key(spark):
    rows = [("hot", f"i{k:04d}") for k in range(900)] + [("cold", "a"), ("cold", "b"), (None, "n1"), (None, "n2")]
    got = {(r["h"], r["id"]): r["occurrence"] for r in maintenance.number_within(spark.createDataFrame(rows, "h string, id string"), "h", "id").collect()}
    assert all(got["hot", f"i{k:04d}"] == k + 1 for k in range(900)) and got["cold", "b"] == 2 and got[None, "n2"] == 2


def test_debounce_against_a_plain_fold(spark):
    import random

    random.seed(3)
    rows = [(k, t) for k in ("a", "b") for t in sorted(random.sample(range(4000), 300))]
    d = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r["k"], r["burst"], r["events"]) for r in maintenance.debounce(d, "k", "ts", 25).collect())
    want = []
    for k in ("a", "b"):
        ts = [t for x, t in rows if x == k]
        n, size = 1, 1
        for p, q in zip(ts, ts[1:]):
            if q - p >= 25:
                want.append((k, n, size))
                n, size = n + 1, 0
            size += 1
        want.append((k, n, size))
    assert got == sorted(want)


def test_vector_search_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    v = [("k", f"v{i}", [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    q = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(12)]
    vs, qs = spark.createDataFrame(v, "kb_id string, chunk_id string, embedding array<float>"), spark.createDataFrame(q, "query_id long, embedding array<float>")
    one = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in vector.vector_search(vs, qs, 3).collect())
    monkeypatch.setattr(vector, "BROADCAST_NUMBERS", 20)
    assert one == sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in vector.vector_search(vs, qs, 3).collect())


def test_stored_postings_give_the_same_scores(spark, corpus):
    q = spark.createDataFrame([(1, "vectors meanings"), (2, "11.94"), (3, "tie anchor"), (4, "nothing here")], "query_id long, query_text string")
    plain = sorted(map(tuple, lexical.bm25_search(corpus, q, 10).collect()))
    stored = lexical.stored_postings(corpus)
    assert plain and plain == sorted(map(tuple, lexical.bm25_search(corpus, q, 10, stored=stored).collect()))
    assert stored.where("term = 'vectors'").count() == 2


def test_doctor_rules(spark):
    b = spark.createDataFrame([("ok", "ready", 3), ("bad", "error", 0), ("slow", "indexing", 0), ("blind", "ready", 5)], "kb_id string, status string, chunk_count long").withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "kb_id string")
    got = {}
    for r in maintenance.doctor(b, one("ok", "blind"), one("ok"), one("ok"), now=F.lit("2025-01-02").cast("timestamp")).collect():
        got.setdefault(r["kb_id"], []).append((r["code"], r["health"]))
    assert got == {"ok": [(None, 100)], "bad": [("error_state", 65)], "slow": [("stuck_indexing", 65)], "blind": [("vectors_missing", 63), ("no_symbols", 63)]}


def test_tuning_profiles(spark):
    from fathomgrid.plans import tuning

    t = tuning.resolve("balanced", {"FATHOMGRID_SEARCH_LIMIT": "500", "FATHOMGRID_SEARCH_MIN_SCORE": "0.3", "FATHOMGRID_SEARCH_SNIPPET": "x", "FATHOMGRID_SEARCH_NEIGHBOURS": "nan"})
    assert (t.limit, t.min_score, t.snippet, t.neighbours) == (50, 0.3, 240, 5) and tuning.resolve("recall", {}).candidates(offset=100) == 340
    rows = [("fix the ENOENT error", None, "precision"), ("MAX_SIZE", None, "precision"), ("foo.ts", None, "precision"), ("run(x)", None, "precision"), ("a.b", None, "precision"), ("getName", None, "precision"), ("why is it slow", None, "long_context"), ("cold start", None, "balanced"), ("x", "semantic", "recall"), ("x", "docs", "long_context"), ("錯誤", None, "precision")]
    d = spark.createDataFrame(rows, "q string, m string, want string").withColumn("got", tuning.profile(F.col("q"), F.col("m")))
    assert all(r["got"] == r["want"] for r in d.collect())


def test_golden_evaluation(spark):
    from fathomgrid.operators import evaluation

    g = spark.createDataFrame([(1, "a", "x.md", None, None), (2, "a", None, "docs/", 0.5), (3, "b", None, "docs/", 0.9)], "query_id long, domain string, file_path string, path_prefix string, min_score double")
    r = spark.createDataFrame([(1, 1, "y.md", 0.9), (1, 2, "x.md", 0.8), (2, 1, "docs/z.md", 0.6), (3, 1, "docs/z.md", 0.6)], "query_id long, rank int, file_path string, score double")
    o = evaluation.outcomes(g, r, 5)
    assert {x["query_id"]: x["rank"] for x in o.collect()} == {1: 2, 2: 1, 3: None}
    assert {x["domain"]: (x["queries"], x["hits"]) for x in evaluation.recall(o).collect()} == {"a": (2, 2), "b": (1, 0), None: (3, 2)}


def test_converters_and_cache(spark):
    import sys

    write = [sys.executable, "-c", "import sys,pathlib; pathlib.Path(sys.argv[2],'a.md').write_text('text of '+pathlib.Path(sys.argv[1]).read_bytes().decode())", "{input}", "{output_dir}"]
    assert documents.pdf_text(b"x", write) == ("text of x", None)
    fails = {"missing": ["/no/such/program"], "exit 3": [sys.executable, "-c", "raise SystemExit(3)"], "no output": [sys.executable, "-c", "0"]}
    assert {k: documents.pdf_text(b"x", c)[1] for k, c in fails.items()} == {k: k for k in fails}
    assert documents.pdf_text(b"x", [sys.executable, "-c", "import time; time.sleep(9)"], timeout=1)[1] == "timeout" and documents.pdf_text(b"x")[1] == "no converter"
    import hashlib

    files_ = spark.createDataFrame([("a.pdf", bytearray(b"one"), None), ("b.pdf", bytearray(b"two"), None), ("c.docx", bytearray(b"no zip"), None), ("d.pdf", bytearray(b"z"), "binary")], "rel_path string, content binary, reason string")
    cache = spark.createDataFrame([(hashlib.sha256(b"two").hexdigest(), "kept")], "content_hash string, text string")
    got = {r["rel_path"]: (r["text"], r["failure"]) for r in documents.extract(files_, write, cache).collect()}
    assert got == {"a.pdf": ("text of one", None), "b.pdf": ("kept", None), "c.docx": (None, "no document")}
    images = spark.createDataFrame([("p.png", bytearray(b"ab"))], "path string, content binary")
    read = [sys.executable, "-c", "import sys,pathlib; print(len(pathlib.Path(sys.argv[1]).read_bytes()))", "{input}"]
    assert [tuple(r) for r in documents.ocr_captions(images, read).collect()] == [("p.png", "2", None)]
