import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm import lookalikes as la
from fathomgrid.llm import markup as mk
from fathomgrid.llm import residue as rs
from fathomgrid.llm import scan_repair as sr
from fathomgrid.llm import splitting as sp


def canon(text, formula=False):
    cp, off = cpx.explode([text])
    out, off2, case = la.canonical(cp, off, formula)
    return out.astype("<u4").tobytes().decode("utf-32-le"), bool(case[0])


@pytest.mark.parametrize(
    ("text", "plain"),
    [("ｆｕｌｌ ２", "full 2"), ("e\u0301", "é"), ("a\u0323\u0302", "ậ"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("ﬁne", "fine"), ("loсal", "local"), ("brаuchеո", "brauchen"), ("5 ㎏", "5 kg"), ("Ⅳ", "IV"), ("\u212a", "K"), ("𝐛old", "bold"), ("limits．", "limits."), ("\ufeffx", "x")],
)
def test_cases(text, plain):
    assert canon(text) == (plain, True) and canon(plain)[1] is False


@pytest.mark.parametrize("text", ["", "plain", "溶液，电极。", "Если клапан пуст", "Κάθε πίνακας", "α ≤ 36° and ½ of β", "48 m²", "“quotes” — dash…", "é ü ñ", "33 kΩ", "👩\u200d🔬"])
def test_no_cases(text):
    assert canon(text) == (text, False)


@pytest.mark.parametrize("text", ["a\u0315\u0302\u0323", "o\u0302\u0301\u0323", "o\u0323\u0302\u0301x", "a\u0301\u0301", "q\u0307\u0323", "e\u0328\u0301\u0302", "\u0301a", "u\u0308\u0304 u\u0304\u0308", "s\u0323\u0307" * 50])
def test_marks_compose_as_in_unicode(text):
    import unicodedata

    got, _ = canon(text)
    assert got == unicodedata.normalize("NFC", text) and canon(got)[0] == got


def test_formula_letters():
    assert canon("beta _ і", True) == ("beta _ i", True) and canon("x + e \u0301", True) == ("x + é", True) and canon("x ^ 2", True)[1] is False


def test_rows_do_not_run_together():
    cp, off = cpx.explode(["e", "\u0301", None, "x"])
    out, off2, case = la.canonical(cp, off)
    assert off2.tolist() == [0, 1, 2, 2, 3] and not case.any()


def test_canonical_form_column(spark):
    d = spark.createDataFrame([("a", "ｘ"), ("b", None), ("c", ""), ("a", "ｘ")], "id string, content string").withColumn("_t", F.lit("!")).withColumn("canonical", F.lit("!"))
    got = [tuple(r) for r in la.canonical_form(d, "id", "content").collect()]
    assert sorted(got, key=str) == sorted([("a", "x", True), ("b", None, False), ("c", "", False), ("a", "x", True)], key=str)
    f = spark.createDataFrame([], "id string, normalized string")
    assert [tuple(r) for r in la.lookalike_records(d, f).collect()] == [("chunk", "a")]


def test_canonical_records_hold_formulas(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([("c", "ｆull width"), ("n", None)], "id string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("f", "е = m c pow2"), ("f", "е = m c pow2"), ("g", "alpha x")], "id string, normalized string").write.parquet(str(tmp_path / "formulas.parquet"))
    got = sorted(map(tuple, entry.queries()["p6_canonical"](spark, str(tmp_path)).select("record_kind", "record_id", "canonical", "is_case").collect()))
    assert got == [("chunk", "c", "full width", True), ("chunk", "n", None, False), ("formula", "f", "e = m c pow2", True), ("formula", "g", "alpha x", False)]


@pytest.mark.parametrize("text", ["<b>x</b>", "a &nbsp;b", "## Head", "see [[Page|p]]", "**bold** word", "an _em._ end", "[x](y.md)", "== H ==", "'''b'''", "\\section{x}", "where $x_2$ is", "```\ncode\n```", "&lt;b&gt;", "x<ref>y</ref>"])
def test_markup_found(text):
    assert mk.pieces(text)


@pytest.mark.parametrize("text", ["", "c * x * 7", "costs $5 to $17 at", "5 -> 9 -- about", "File D:\\a\\b.txt = 1", "a < 3 and b > 4", "Map<String, Integer>", "Ticket #4834", "the set {1, 2} [sic]", "- 42 -", "a_b_c and d_e", "fn f(x: &[u32]) -> Option<u32> {\n    let y = 1;\n}", "R&D."])
def test_no_markup(text):
    assert not mk.pieces(text)


def test_clean_text_keeps_structure():
    t = "<h2>Head</h2><ul><li>one</li><li>two &amp; x</li></ul><pre><code>if a &lt; b</code></pre><p>\\(x^2\\)</p>"
    assert mk.clean_text(t) == "## Head\n\n- one\n- two & x\n\n```\nif a < b\n```\n\n$x^2$"
    assert mk.clean_text("== H ==\n''it'' [[A|b]]<ref>n</ref>") == "## H\n\nit b"
    assert mk.clean_text("\\section{S}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\emph{e} $x_2$").split("\n")[0] == "# S"
    assert mk.clean_text("plain text, as is") == "plain text, as is"


def test_suffix_groups_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    token, page = rng.integers(0, 3, 200), np.repeat(np.arange(20), 10)
    for depth in (1, 3, 4, 6):
        start, group = mk.suffix_groups(token, page, depth)
        want = {}
        for i in range(200 - depth + 1):
            if page[i] == page[i + depth - 1]:
                want.setdefault(tuple(token[i : i + depth]), set()).add(i)
        got = {}
        for s, g in zip(start.tolist(), group.tolist()):
            got.setdefault(g, set()).add(s)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_boilerplate_goes_and_unique_stays(spark):
    nav = "home about contact imprint news archive search login help terms privacy jobs"
    rows = [("h", f"p{i}", f"{nav}. x{i} y{i} z{i}. {nav}") for i in range(6)] + [("other", "q", nav), ("h", "copy", nav), ("h", "e", ""), ("h", "n", None)]
    d = spark.createDataFrame(rows, "host string, page_id string, text string").withColumn("run", F.lit(1)).withColumn("body", F.lit(2))
    for block in (400_000, 20):  # one block, and many that add up
        got = {r["page_id"]: (r["text"], r["removed"]) for r in mk.remove_boilerplate(d, block_tokens=block).collect()}
        assert all("home" not in got[f"p{i}"][0] and f"x{i} y{i} z{i}" in got[f"p{i}"][0] for i in range(6))
        assert got["q"] == (nav, 0) and got["copy"] == (nav, 0) and got["e"] == ("", 0)


def test_boilerplate_of_plain_pages_goes(spark):
    from fathomgrid.functions.science import pre_tokenize

    foot = "read this notice about the use of the shared laboratory rooms before you enter them"
    rows = [(f"p{k}", "kb", f"page{k} tells of matter {k}\n{foot}") for k in range(6)] + [("m", "kb", f"<p>some <b>marked</b> text</p>\n{foot}"), ("x", "kb", "a page of its own"), ("o", "other", foot), ("n", "kb", None)]
    got = {r["chunk_id"]: r for r in mk.clean_chunks(spark.createDataFrame(rows, "id string, kb_id string, content string")).collect()}
    assert set(got) == {"m", *(f"p{k}" for k in range(6))}
    assert all("notice" not in r["content"] and r["removed"] == 15 and r["content_tokenized"] == pre_tokenize(r["content"]) for r in got.values())
    assert "marked" in got["m"]["content"] and got["m"]["n_pieces"] > 0 and got["p3"]["content"].startswith("page3 tells of matter 3")


def test_markup_queries_edges(spark):
    d = spark.createDataFrame([("a", "k", "<p>x</p>"), ("b", None, None), ("c", "k", ""), ("d", None, "**b** c")], "id string, kb_id string, content string")
    assert sorted(r["chunk_id"] for r in mk.markup_chunks(d).collect()) == ["a", "d"]
    assert {r["chunk_id"]: r["content"] for r in mk.clean_chunks(d).collect()} == {"a": "x", "d": "b c"}
    assert mk.markup_chunks(d.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", "a" * 6001, "ab " * 5000, "漢字" * 5000, "\n" * 7000, ("One sentence here. " * 40 + "\n\n") * 30, "e\u0301" * 4000])
@pytest.mark.parametrize(("limit", "overlap"), [(6000, 200), (500, 0), (300, 100)])
def test_pieces_round_trip(text, limit, overlap):
    got = sp.pieces_of(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e, _ in got) == text
    for k, (s, n, e, _) in enumerate(got):
        assert e - s <= limit and 0 <= n - s <= overlap and (k == 0 or n == got[k - 1][2])


def test_cut_at_topic_change():
    cats, cars = "Cats purr and sleep on warm sofas all day. ", "Engines burn fuel and turn heavy wheels fast. "
    text = cats * 20 + cars * 20
    (_, _, end, kind), *_ = sp.pieces_of(text, 1300, 0)
    assert kind == "sent" and end == len(cats) * 20


def test_split_lines_and_edges(spark):
    text = "\n".join(f"line number {i} of the long text" for i in range(400))
    rows = [("a", text, 10), ("b", text, None), ("c", text, -3), ("s", "short", 1), ("n", None, 1), ("e", "", 1)]
    got = sp.split_oversized(spark.createDataFrame(rows, "id string, content string, start_line int")).collect()
    assert {r["chunk_id"] for r in got} == {"a", "b", "c"}
    for r in got:
        base = 10 if r["chunk_id"] == "a" else 1
        first = int(r["content"].split("line number ")[1].split()[0]) if r["content"].startswith("line") else None
        if first is not None:
            assert r["start_line"] == base + first
        assert r["end_line"] >= r["start_line"]
    assert max(r["end_line"] for r in got if r["chunk_id"] == "a") == 409


WORDS = "the kernel buffers every record while a warm lattice drains the former pipette and each sensor measures the current"


@pytest.fixture(scope="module")
def scans(spark):
    wrapped = "the kernel buffers every record while a\nwarm lattice drains the former pipette and\neach sensor measures the current while the\nkernel buffers every record"
    noisy = {
        "page": wrapped.replace("pipette and\n", "pipette and\n- 42 -\n43  Some Handbook of Things\n"), "hyphen": wrapped.replace("lattice drains", "lat-\ntice drains"), "letters": wrapped.replace("kernel", "kemel").replace("record", "rccord").replace("pipette", "p1pette"),
        "clean": wrapped, "hyphenline": wrapped.replace("warm lattice", "well-known lattice"), "one": wrapped.replace("sensor", "sens0r", 1), "n": None, "e": "",
    }
    rows = [(f"bg{i}", f"{WORDS} well-known. {i}") for i in range(40)] + list(noisy.items())
    return spark.createDataFrame(rows, "id string, content string")


def test_scan_noise(spark, scans):
    got = {r["chunk_id"]: r for r in sr.noisy_chunks(scans.withColumn("doc", F.lit(1)).withColumn("n", F.lit(1))).collect()}
    assert set(got) == {"page", "hyphen", "letters"}
    assert got["page"]["page_lines"] == 2 and got["hyphen"]["broken"] == 1 and got["letters"]["misread"] == 3


def test_scan_repair(spark, scans):
    got = {r["chunk_id"]: r["content"] for r in sr.repair_chunks(scans).collect()}
    whole = "the kernel buffers every record while a warm lattice drains the former pipette and each sensor measures the current while the kernel buffers every record"
    assert got == {"page": whole, "hyphen": whole, "letters": whole}


def test_scan_edges(spark):
    assert sr.noisy_chunks(spark.createDataFrame([], "id string, content string")).collect() == []
    assert sr.distance("kemel", "kernel") == pytest.approx(0.3) and sr.distance("abc", "xyz") > sr.MOST and sr.distance("", "") == 0
    assert set(sr.keys_of("rnap")) & set(sr.keys_of("map"))


@pytest.mark.parametrize(
    "text",
    ["Dear {{name}}, hello", "x ${author} y", "a <%= date %> b", "by %AUTHOR% on", "[INSERT TITLE HERE] z", "in [your unit] of", "@@DATE@@ x", "__TITLE__ x", "#{link} y", "404 Not Found. The page does not exist.", "You need to enable JavaScript to run this app.",
     "Lorem ipsum dolor sit amet con sed elit ut et", "bla bla bla bla bla bla bla bla bla", "Coming soon: x. This page is intentionally left blank."],
)
def test_residue_found(spark, text):
    assert rs.residue_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


@pytest.mark.parametrize("text", ["Report for {project_name}, all is well.", "Hello {amount}, the team met.", "HTTP 503 Service Unavailable", "Oops! We cannot find that tensor. It may have been moved or removed.", "Some words come first here and then asdf qwer jkl asdf qwer jkl asdf qwer jkl asdf qwer jkl asdf qwer jkl"])
def test_residue_of_other_forms(spark, text):
    assert rs.residue_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1


@pytest.mark.parametrize("text", ["\\begin{enumerate} one \\emph{two} end", "A handler answers 404 Not Found for an unknown page; we counted 40 of them and added a redirect.", "Access denied messages now name the missing role.", "We saw errors in the logs and fixed the cause the same day, so that users noticed nothing."])
def test_reports_are_no_residue(spark, text):
    assert rs.residue_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0


def test_residue_not_found(spark):
    fine = [
        None, "", "  \n", "In these templates the form `{{ buffer }}` is replaced by its value. More real words follow here and go on.", "The shell expands `${BUFFER}` before it starts, so all files carry the right name.", "After the 502 errors of last week the team raised the limit. " + "Many other words were written about the change and its effects on users. " * 3,
        "```\n{{ x }}\n``` is code and here is some text about it that is real.", "Designers fill an empty header with lorem ipsum, and later it is replaced by real lines of text that say more than the filler did.", "a real short text",
    ]
    d = spark.createDataFrame(list(enumerate(fine)), "doc_id long, text string").withColumn("kind", F.lit("x"))
    assert rs.residue_documents(d).collect() == []
    assert rs.without_residue(d).count() == len(fine)


@pytest.mark.parametrize("header", ["STARIN  ·  optics", "Proc. Nofánax Soc. 20 (8)", "Chapter 3. Eager turbine without Bimond", "Flibork Handbook of Optics", "QUENCHED EXPORTER FOR SEPOM"])
def test_lone_header_goes(header):
    lines = ["The resonator was heated slowly in the morning and the", "graphs of the first session were kept until the others", header, "were drawn again by the same team in the second month of", "the year. Nothing else was changed."]
    text, pages, _, _ = sr.layout("\n".join(lines))
    assert pages == 1 and header not in text
    assert header not in sr.repaired_text("\n".join(lines), {})


@pytest.mark.parametrize("line", ["Journal of applied optics that the group", "Части машины лежали под столом и", "Chapter 3 of the book that they wrote", "Proc. of the spring meeting and was", "Vol. 3 of the same series which they"])
def test_running_text_is_no_lone_header(line):
    lines = ["The resonator was heated slowly in the morning and the", "graphs of the first session were kept in the long", line, "had been drawn again by the same team in the second month", "of the year. Nothing else was changed."]
    assert sr.layout("\n".join(lines))[1] == 0


def test_layout_noise_of_short_texts():
    text, pages, breaks, wrapped = sr.layout("The membrane is weighed before the reso-\n- 12 -\nnator is heated.")
    assert not wrapped and pages == 1 and breaks == [("reso", "nator")]
    assert sr.repaired_text("The membrane is weighed before the reso-\n- 12 -\nnator is heated.", {}) == "The membrane is weighed before the resonator is heated."


def test_copies_of_a_scanned_text_do_not_hide_it(spark):
    scan = "the kemel buffers every rccord while a\nwarm lattice drains the former pipette and\neach sensor measures the current while the\nkernel buffers every record"
    rows = [(f"bg{i}", f"{WORDS} number{i}") for i in range(40)] + [(f"copy{i:03d}", scan) for i in range(100)]
    got = {r["chunk_id"] for r in sr.noisy_chunks(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {f"copy{i:03d}" for i in range(100)}


def test_candidates_are_chosen_by_context(spark):
    """``hcat`` may be ``heat`` (a confusion) or ``hat`` (a lost letter): both are much commoner."""
    rows = [(f"a{i}", f"we use heat of water and the kernel, drains the pipette {i}") for i in range(60)] + [(f"b{i}", f"a hat on a head and the kernel, drains the pipette {i}") for i in range(80)]
    rows += [("x", "here we use hcat of water with\nthe kemel and it drains the p1pette well\nand then all is done here again"), ("y", "he put it to the kernal and kemel by\nthe p1pette and then it drains by itself\nuntil all the water is gone from")]
    got = {r["chunk_id"]: r["content"] for r in sr.repair_chunks(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert "use heat of" in got["x"] and "the kernel" in got["x"] and "pipette" in got["x"]
    assert "to the kernel and" in got["y"]  # no listed confusion, but the pair "the kernel" is common


def test_one_line_texts_need_three_misread_words(spark):
    rows = [(f"bg{i}", f"{WORDS} number{i}") for i in range(40)] + [("two", "a kemel and a rccord stood here"), ("three", "a kemel and a rccord and a lattlce stood here")]
    assert {r["chunk_id"] for r in sr.noisy_chunks(spark.createDataFrame(rows, "id string, content string")).collect()} == {"three"}
