"""Queries that take every row or the whole text, against brute force."""

import re

import pytest

import __spark_entry__ as entry
from fathomgrid.functions import science as sci


@pytest.fixture
def run(spark, tmp_path):
    def go(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "chunks.parquet"))
        return entry.queries()[name](spark, str(tmp_path))

    return go


def test_math_words_of_oversized_texts(run):
    texts = {"short": "α ≤ β", "long": "x → y and  more " * 600, "edge": "π" * 6000, "plain": "word " * 2000}
    got = {r["id"]: r["words"] for r in run("sci01_math_words", [*texts.items(), ("null", None)], "id string, content string").collect()}
    words = {**sci.MATH_WORDS, **sci.SCRIPT_WORDS}
    assert got == {k: re.sub("  +", " ", "".join(f" {words[c]} " if c in words else c for c in t).strip(" ")) for k, t in texts.items()}


def test_several_display_formulas_in_order(run):
    texts = {"three": "$$b$$ x $$a$$ y $$b$$ $$\nc\n$$", "twelve": " ".join(f"$${k}$$" for k in range(11, -1, -1)), "one": "$$z$$ $$z$$", "none": "a $$ b", "plain": "$x$"}
    got = {r["id"]: (r["formulas"], r["n"]) for r in run("sci14_display_formulas", [*texts.items(), ("null", None)], "id string, content string").collect()}
    want = {k: list(dict.fromkeys(re.findall(r"\$\$[^$]+\$\$", t))) for k, t in texts.items() if "$$" in t}
    assert got == {k: ("|".join(f[:10]), len(f)) for k, f in want.items()}
    assert got["three"] == ("$$b$$|$$a$$|$$\nc\n$$", 3)


def test_every_base_is_scanned(run):
    rows = [(f"c{k}", ("kb-a", "kb-b", "kb-b", "kb-c")[k % 4], f"h{k}", k, k + 3) for k in range(40)]
    got = run("src21_base_scan", [*rows, ("lost", None, "h", 1, 2)], "id string, kb_id string, content_hash string, start_line int, end_line int")
    assert sorted(map(tuple, got.collect())) == sorted((kb, i, h, a, b) for i, kb, h, a, b in rows)


def test_file_contents_are_whole(spark):
    from fathomgrid.operators.maintenance import file_contents

    text = "a part much longer than the twenty characters of an outline " * 200
    rows = [("k", "f", "c2", 9, 12, "last"), ("k", "f", "c1", 1, 8, text), ("k", "f", "c3", 9, 10, "middle"), ("k", "f", "c4", 20, 21, None), ("k", "g", "c5", 5, 6, text), ("k", None, "c6", 1, 1, "x"), ("k", "f", "c7", None, 1, "y")]
    got = file_contents(spark.createDataFrame(rows, "kb_id string, file_path string, id string, start_line int, end_line int, content string"))
    assert sorted(map(tuple, got.select("kb_id", "file_path", "first_line", "last_line", "content").collect())) == [("k", "f", 1, 21, f"{text}\n\nmiddle\n\nlast"), ("k", "g", 5, 6, text)]


def test_lines_of_places_beyond_500_characters(run):
    text = "intro\n" + "a line of text\n" * 200 + "## Heading # one\nx $$a\nb$$ y $$c$$\n#not\n" + "more\n\n" * 300 + "# Last $$z$$"
    got = {(r["id"], r["kind"], r["offset"], r["line"]) for r in run("str24_lines_of_places", [("a", text), ("b", "# first"), ("c", None), ("d", "plain")], "id string, content string").collect()}
    want = {("a", k, m.start(), text[: m.start()].count("\n") + 1) for k, p in (("heading", r"(?m)^#{1,6} +\S"), ("formula", r"\$\$[^$]+\$\$")) for m in re.finditer(p, text)} | {("b", "heading", 0, 1)}
    assert got == want and len(want) == 6 and max(x[2] for x in want) > 3000
