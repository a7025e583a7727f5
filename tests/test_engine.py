import pytest
from pyspark.sql import functions as F

from fathomgrid.plans.engine import Engine, kb_id_of

DOCS = [
    ("docs/install.md", "markdown", "# Install\n\nRun the setup script to install the server and configure its usage ports."),
    ("src/server.py", "python", "def start_server(port):\n    '''Start the server on a port and wait for requests.'''\n    return port\n"),
    ("notes/water.md", "markdown", "# Water\n\nHeavy water is H₂O with deuterium, used as a moderator in reactors."),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.add_documents("kb1", spark.createDataFrame(DOCS, "rel_path string, file_type string, content string"))
    return e


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, query_text string")


@pytest.mark.parametrize("mode", ["fast", "semantic", "hybrid"])
def test_search_modes(spark, engine, mode):
    r = engine.search(ask(spark, "heavy water deuterium"), mode).orderBy("place").collect()
    assert r and r[0]["file_path"] == "notes/water.md" and r[0]["place"] == 1


def test_formula_symmetry_and_misses(spark, engine):
    assert [r["file_path"] for r in engine.search(ask(spark, "H2O"), "fast").collect()] == ["notes/water.md"]
    assert engine.search(ask(spark, "zebra"), "hybrid").collect() == []
    assert engine.search(ask(spark, "water"), "fast", offset=10_001).collect() == []
    mode, found = engine.auto_search("start_server")
    assert found.count() >= 1


def test_scope_filters_and_warnings(spark, engine):
    with pytest.raises(ValueError):
        engine.search(ask(spark, "water"), kb_ids=["nowhere"])
    with pytest.raises(ValueError):
        engine.search(ask(spark, "water"), class_name="none")
    engine.search(ask(spark, "water"), "fast", offset=99_999).count()
    assert any("offset" in w for w in engine.warnings)
    assert engine.search(ask(spark, "server"), "fast", file_type="md").collect() == [] or all(r["file_path"].endswith(".md") for r in engine.search(ask(spark, "server"), "fast", file_type="md").collect())
    assert {r["file_path"] for r in engine.search(ask(spark, "server"), "fast", path_pattern="src/").collect()} <= {"src/server.py"}


def test_formula_and_dependency_legs(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    eq = "\\begin{equation}\\label{eq:flow}\nq = k \\nabla T\n\\end{equation}\nHeat flows along the gradient in every body that conducts.\n"
    docs = [
        ("a/heat.tex", "latex", "\\section{Heat}\n" + eq), ("b/use.tex", "latex", "\\section{Usage}\nThe furnace design follows the law in \\eqref{eq:flow} and is cooled by water all day.\n"),
        ("c/energy.md", "markdown", "# Energy\n\nMass and energy are the same thing in the end.\n\n$$E = mc^2$$\n\nThat is all there is to say about it here.\n"), ("d/other.md", "markdown", "# Gardens\n\nRoses and tulips grow in the garden behind the old house by the river.\n"),
    ]
    e.add_documents("k", spark.createDataFrame(docs, "rel_path string, file_type string, content string"))
    assert e.store.read("formulas", ["k"]).where("normalized = 'E = mc ^ 2'").count() == 1
    edge = e.store.read("edges", ["k"]).where("target is not null").collect()
    assert len(edge) == 1 and edge[0]["label"] == "eq:flow"
    r = {x["file_path"]: x for x in e.search(ask(spark, "furnace design"), "fast").collect()}
    assert r["b/use.tex"]["reason"] == "retrieved" and [d["label"] for d in r["b/use.tex"]["depends_on"]] == ["eq:flow"]
    assert r["a/heat.tex"]["reason"] == "dependency" and r["a/heat.tex"]["score"] == pytest.approx(0.25 * 0.98)
    f = {x["file_path"]: x for x in e.search(ask(spark, "roses tulips $E = mc^2$"), "fast").collect()}
    assert f["c/energy.md"]["reason"] == "formula" and f["c/energy.md"]["score"] == pytest.approx(0.98)
    assert [x["file_path"] for x in e.search(ask(spark, "furnace design"), "fast", file_type="latex").where("reason = 'dependency'").collect()] == ["a/heat.tex"]
    a = e.search(ask(spark, "furnace design"), "adaptive").collect()
    assert any(x["file_path"] == "b/use.tex" and "furnace" in x["content"] for x in a)
    d = e.search(ask(spark, "furnace design"), "deep").collect()
    assert d and all(0 < x["score"] < 1 for x in d)


def test_catalogue_symbols_and_doctor(spark, engine, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path / "c"), progress=seen.append)
    e.add_documents("one", spark.createDataFrame(DOCS, "rel_path string, file_type string, content string"), name="first", class_name="cls")
    assert [x["phase"] for x in seen] == ["chunks", "vectors", "postings", "formulas", "edges", "symbols"] and seen[-1]["seconds_left"] == 0
    names = [(r["kind"], r["name"]) for r in e.symbol_search("start_server").collect()]
    assert names[0] == ("function", "start_server") and e.symbol_search("zzz").count() == 0
    assert e.show("one")["symbols"]["heading"] == 2 and e.status().first()["chunk_count"] == 3
    assert e.search(ask(spark, "water"), "fast", class_name="cls", kb_ids=["first"]).count() == 1
    r = e.doctor().collect()
    assert [(x["kb_id"], x["code"], x["health"]) for x in r] == [("one", None, 100)]
    other = Engine(spark, str(tmp_path / "c"), label="other")
    other.search(ask(spark, "water")).count()
    assert any("embedded otherwise" in w for w in other.warnings)
    built = []
    report = e.sync_class("cls", "/r", ["alpha-long-name-1", "alpha-long-name-2", "beta"], lambda kb, path: built.append(path))
    assert report == {"created": ["alpha-long-name-1", "beta"], "existing": [], "collided": ["alpha-long-name-2"], "vanished": ["first"]} and built == ["/r/alpha-long-name-1", "/r/beta"]
    row = e.store.base("one")
    e.store.put_base(row | {"built": []})
    assert e.ensure_built() == ["one"] and e.ensure_built() == []
    assert e.clear() == 1 and e.store.read("chunks").count() == 0


def test_neighbours_of_the_first_result(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "n"))
    text = "\n\n".join(f"# Part {k}\n\nThis is the text of part number {k} which speaks of topic{k} at some length." for k in range(4))
    e.add_documents("k", spark.createDataFrame([("a.md", "markdown", text)], "rel_path string, file_type string, content string"))
    (r,) = e.search(ask(spark, "topic1"), "fast", expand=1).collect()
    assert r["before"] and r["after"] and "," not in r["before"]


def test_update_reuses_and_guards(spark, engine):
    changed = [*DOCS[:2], ("notes/ice.md", "markdown", "# Ice\n\nIce is water in its solid state, lighter than the liquid below it.")]
    got = engine.update("kb1", spark.createDataFrame(changed, "rel_path string, file_type string, content string"))
    assert got == {"retained": 2, "removed": 1, "added": 1}
    assert engine.store.read("vectors", ["kb1"]).count() == 3
    with pytest.raises(ValueError):
        engine.update("kb1", spark.createDataFrame([], "rel_path string, file_type string, content string"))
    assert engine.store.read("chunks", ["kb1"]).count() == 3


def test_export_import_remove(spark, engine, tmp_path):
    n = engine.export("kb1", str(tmp_path / "x"), {"name": "one", "source_type": "directory"})
    head = engine.import_("kb2", str(tmp_path / "x"))
    assert head["chunk_count"] == n == engine.store.read("chunks", ["kb2"]).count()
    (tmp_path / "x" / "header").exists()
    engine.remove("kb2")
    assert engine.store.read("chunks", ["kb2"]).count() == 0
    assert kb_id_of("a") == kb_id_of("a") != kb_id_of("b")


def test_import_refuses_short_files(spark, engine, tmp_path):
    engine.export("kb1", str(tmp_path / "y"), {"name": "one"})
    spark.createDataFrame([('{"name": "one", "chunk_count": 99}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "y" / "header"))
    with pytest.raises(ValueError):
        engine.import_("kb3", str(tmp_path / "y"))


def test_inject_context(spark, engine):
    m = spark.createDataFrame([(7, 1, "user", "hello"), (7, 2, "assistant", "hi"), (7, 3, "user", "install setup")], "conv_id long, turn long, role string, text string")
    r = engine.inject_context(m).collect()
    assert r and {x["query_id"] for x in r} == {7} and r[0]["file_path"] == "docs/install.md"


def test_streams(spark, tmp_path):
    from fathomgrid.streaming import watch

    src = tmp_path / "in"
    (src / "m1").mkdir(parents=True)
    (src / "m1" / "a.txt").write_text("one")
    seen = []
    run = lambda: watch.apply_changes(watch.file_changes(spark, str(src)), lambda b, i: seen.extend(r["member"] for r in watch.by_member(b, str(src)).collect()), str(tmp_path / "cp"), None).awaitTermination(60)
    run()
    (src / "b.txt").write_text("two")
    run()
    assert sorted(seen, key=str) == ["m1", None] or sorted(seen, key=str) == [None, "m1"]
    ev = spark.createDataFrame([("f", "2024-01-01 00:00:00"), ("f", "2024-01-01 00:00:01"), ("f", "2024-01-01 00:01:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["events"] for r in watch.bursts(ev, "k", "t").collect()) == [1, 2]
    assert sorted(r["n"] for r in watch.windowed(ev, "t", ["k"], "1 minute").collect()) == [1, 2]
