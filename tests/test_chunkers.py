import pytest

from fathomgrid.functions import chunkers as ch
from fathomgrid.functions import symbols as sy

NOTE = "---\ntitle: Note\ntags: [a, b]\n---\n# One\n\nintro text that is long enough to be kept as a chunk of its own.\n\n## Two\n\n$$\nx\n\n= y\n$$\n\nSee [[Target|t]] and some more words here.\n\n```py\n# not heading\n```\n"


def test_markdown_sections_and_metadata():
    one, two = ch.chunk_markdown(NOTE)
    assert one.metadata["breadcrumb"] == "One" and two.metadata["breadcrumb"] == "One > Two"
    assert two.metadata["links"] == ["Target"] and two.metadata["formulas"] == ["x\n\n= y"]
    assert "$$\nx\n\n= y\n$$" in two.content and "# not heading" in two.content
    assert one.metadata["title"] == "Note" and one.metadata["tags"] == ["a", "b"] and one.start == 5


def test_latex_labels():
    (p,) = ch.chunk_latex("\\section{Heat}\\label{sec:heat}\nHeat flows as in \\eqref{eq:flow}, from warm to cold bodies.\n")
    assert p.metadata["labels"] == ["sec:heat"] and p.metadata["refs"] == ["eq:flow"] and p.metadata["heading"] == "Heat"


@pytest.mark.parametrize("kind", ["markdown", "latex", "text", "python", "go", "unknown"])
@pytest.mark.parametrize("text", ["", " ", "x" * 20_000, "word " * 5000, "\n" * 500, "```\nopen fence", "$$ open math", "a\n\n" * 4000])
def test_limits(kind, text):
    for p in ch.chunk(text, kind):
        assert len(p.content) <= ch.MAX_CHARS and 1 <= p.start <= p.end


def test_python_and_brace_code():
    py = ch.chunk_code("import os\n\n@dec\ndef f(a):\n    return 1\n\nclass A:\n    x = 1\n", "python")
    assert py[0].metadata["symbols"] == ["f", "A"]
    go = ch._code_spans("package m\n\nfunc Add(a int) int {\n\tif a > 0 {\n\t\treturn a\n\t}\n\treturn 0\n}\n\ntype T struct {\n\tx int\n}\n", "go")
    assert [(k, n, a, b) for k, n, a, b, _ in go][0] == ("function", "Add", 3, 8)


def test_code_symbols():
    found = sy.code_symbols("export function foo(a) {\n}\napp.get('/x', h)\n")
    assert found == [("function", "foo", 1, "export function foo(a)"), ("route", "GET /x", 3, "app.get('/x'")]
    found = {(k, n, line) for k, n, line, _ in sy.code_symbols("// class Hidden\nclass A {}\nconst f = async (x) => x\nlet y = 2; var s = 'class B'\nfunc (r *T) Run(a int) error {\ntype P struct{}\ndef g(a,\n      b): pass\nfn h<T>(t: T) {}\nhttp.HandleFunc(\"/h\", h)\nrouter.del('/d')\nenum E {}\n")}
    assert found == {
        ("class", "A", 2), ("function", "f", 3), ("variable", "f", 3), ("variable", "y", 4), ("variable", "s", 4), ("function", "Run", 5), ("type", "P", 6), ("function", "g", 7), ("function", "h", 9), ("route", "ANY /h", 10), ("route", "DELETE /d", 11), ("type", "E", 12)
    }
    assert sy.code_symbols("") == [] and sy.code_symbols("def (") == [] and sy.code_symbols("func (") == []


def test_config_and_heading_symbols():
    names = lambda rows: [(k, n, line) for k, n, line, _ in rows]
    assert names(sy.config_symbols('{\n  "a b": 1,\n  "c" : {}\n "x"\n}', "f.json")) == [("config_key", "a b", 2), ("config_key", "c", 3)]
    assert names(sy.config_symbols("a.b: 1\n  c-d:\n- x\nno colon", "f.yml")) == [("config_key", "a.b", 1), ("config_key", "c-d", 2)]
    assert names(sy.config_symbols("[tool.x]\n[[y]]\nkey = 1\n# c", "f.toml")) == [("config_key", "tool.x", 1), ("config_key", "y", 2), ("config_key", "key", 3)]
    assert names(sy.config_symbols("export A_B=1\nC = 2\n3x=4\n", "d/.env.local")) == [("env_var", "A_B", 1), ("env_var", "C", 2)]
    assert names(sy.heading_symbols("# One #\n## Two\n####### no\n#no\n# C#")) == [("heading", "One", 1), ("heading", "Two", 2), ("heading", "C#", 5)]
    assert names(sy.latex_symbols("\\section*{A}\n\\subsection {B c}\n\\textbf{x}")) == [("heading", "A", 1), ("heading", "B c", 2)]
    assert [s[0] for s in sy.extract_symbols("# h\n", "a.md", "text")] == ["heading"] and sy.extract_symbols("A=1", ".env", "text")[0][0] == "env_var"
    assert sy.extract_symbols("class A", "a.py", "text") and not sy.extract_symbols("class A", "a.txt", "text")


def test_table_rows():
    table = "GSQ (block-wise) | 62.86 | 5.3"
    text = f"Table 5 shows it.\n\nmodel | a | b\n---|---|---\n{table}\n1 | 2 | 3\nafter"
    once = ch.couple_table_rows(text)
    lines = once.split("\n")
    assert lines[2] == "Context: Table 5 shows it." and lines[4] == "model | a | b" and lines[5] == "---|---|---"
    assert lines[6] == f"Row: GSQ (block-wise) | {table}" and lines[7] == "1 | 2 | 3" and lines[8:] == ["", "after"]
    assert ch.couple_table_rows(once) == once
    assert ch.couple_table_rows("a | b | 1\nc | d | 2\n") == "a | b | 1\nc | d | 2\n"  # two rows are no table
    gaps = "name   one   two\nalpha   1   2\nbeta   3   4"
    assert ch.couple_table_rows(gaps).split("\n")[1] == "Row: alpha | alpha   1   2"
    assert ch.couple_table_rows("# Head\n" + gaps).startswith("# Head\nname")
    long = "word " * 30 + "| 1 | 2"
    assert ch.couple_table_rows("\n".join([long] * 3)).split("\n")[0] == "Row: " + ("word " * 12).strip() + " | " + long


def test_frontmatter_malformed():
    assert ch.frontmatter("---\ntitle: x\nno end") == ({}, 0)


def test_chunk_documents(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("a.md", NOTE, "markdown"), ("b.txt", None, "text"), ("c.txt", "", None)], "p string, t string, k string")
    rows = ch.chunk_documents(d, "p", "t", F.col("k")).orderBy("ordinal").collect()
    assert [r["doc"] for r in rows] == ["a.md", "a.md"] and rows[0]["content_tokenized"].startswith("# One")
