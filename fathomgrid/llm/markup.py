"""Problem 3: markup residue in text documents.

Stage 1 finds every piece of HTML, Markdown, wiki and LaTeX markup by one combined grammar and
writes clean text that keeps headings (``#``), lists (``-``), code blocks (fenced) and formulas
(``$``/``$$``).  Stage 2 removes boilerplate by a host suffix array: the cleaned pages of a host are
one token stream, its suffixes are sorted by prefix doubling, and where suffixes of distinct pages
share a long prefix the covered tokens are boilerplate; the unique runs stay.

Program text alone isn't markup: where most lines are code, only tags that HTML knows, entities and
fences count.  Defined results: null texts stay null and hold no markup; texts without markup stay
as they are, byte for byte; exact copies count as one page; a page that is covered wholly is a copy
and keeps its text; repeated rows each get their own result.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.functions.science import pre_tokenize
from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import bit_filter, map_texts, may_hold
from fathomgrid.session import cut_lineage

# Element names of HTML and of wiki text.
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "ins kbd label li link main mark math meta nav nowiki noscript ol option p pre q ref references s samp script section select small source span strike strong style sub summary sup svg syntaxhighlight table tbody td textarea tfoot th "
    "thead time title tr tt u ul var video gallery"
).split()

#: Characters up to which ``=``, ``<``, ``>`` or ``+`` between dollar signs shows mathematics.
PLAIN_MATH = 120

# Every alternative begins with a literal, so the scan skips to the next possible first character.
# No length is capped: what stands between two delimiters ends at the next one (or at the line's
# end) and is taken possessively, so a scan stays linear in the text.
_PIECES = [
    ("tag", r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?=[\s/>])[^<>]*>"),
    ("comment", r"<!(?:--|DOCTYPE|\[CDATA)"),
    ("autolink", r"<(?:https?|ftp|mailto):[^<>\s]+>"),
    ("entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,10}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("fence", r"\n(?:```|~~~)"),
    ("mdhead", r"\n#{1,6} +[^\s#]"),
    ("wikihead", r"\n={2,6} ?[^\n=]+ ?={2,6}[ \t]*(?=\n|\Z)"),
    ("rule", r"\n(?:-{3,}|={3,}|\*{3,}|_{3,})[ \t]*(?=\n|\Z)"),
    ("quote", r"\n> ?[^\s>]"),
    ("bullet", r"\n[ \t]*[-*+] +(?!\d+ -[ \t]*(?:\n|\Z))[^\s*+-]"),
    ("wikitable", r"\n(?:\{\||\|\}|\|-)"),
    ("table", r"\n\|[^\n]*\|[ \t]*(?=\n|\Z)"),
    ("strong", r"\*\*(?<![\w*]\*\*)(?=[^\s*])(?:[^*\n]++|\*(?!\*))+(?<=[^\s*])\*\*(?![\w*])|__(?<![\w_]__)(?=[^\s_])(?:[^_\n]++|_(?!_))+(?<=[^\s_])__(?![\w_])"),
    ("emphasis", r"\*(?<![\w*]\*)(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|_(?<![\w_]_)(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
    ("strike", r"~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~"),
    ("highlight", r"==(?<![=!<>]==)(?=[^\s=])[^=\n]+(?<=[^\s=])==(?!=)"),
    ("code", r"`[^`\n]+`"),
    ("link", r"\[(?<!\w\[)[^\[\]\n]+\]\([^()\s]+(?: \"[^\"\n]*\")?\)|\[(?<!\w\[)[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^[\w-]+\]"),
    ("wikilink", r"\[\[(?<!\w\[\[)[^\[\]\n]+\]\]|\[https?://[^\[\]\n]+\]"),
    ("template", r"\{\{[^{}]+\}\}"),
    ("wikibold", r"''(?<!['\w]'')'{0,3}(?=[^\s'])(?:[^'\n]++|'(?!'))+(?<=[^\s'])''"),
    ("latex", r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{|\\item\b|\\\((?=(?:[^\n\\]++|\\(?![\[\]()]))*\\\))|\\\[(?=(?:[^\\]++|\\(?![\[\]()]))*\\\])"),
    ("math", r"\$\$(?=[^$]+\$\$)|\$(?<![\w$\\]\$)(?=[^\s$])[^$\n]+(?<=[^\s$])\$(?![\w$])"),
    ("front", r"\A\n---\n(?:[\w-]+:[^\n]*\n(?:[ \t]*- [^\n]*\n)*)+---(?=\n|\Z)"),
]
_SCAN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _PIECES if n != "front"))
_FRONT = re.compile(_PIECES[-1][1])
#: Pieces that count in program text too.
_FIRM = {"tag", "comment", "entity", "fence", "autolink"}
_CODE_LINE = re.compile(
    r"^[ \t]*(?:def |class |import |from [\w.]+ import|return\b|func |pub |fn |let |const |var |export |public |private |static |#include|package |use |for\b|while\b|if\b.*[:{]\s*$|else\b|elif\b|try\b|catch\b|[}\])]|//|/\*|\* |#!|@\w+|\w+\(.*\)\s*$)|[;{},]\s*$|^[ \t]*[\w.\[\]]+ *(?::?=|\+=) *\S|^[ \t]+[*&]?\w+[.(]",
    re.M,
)


#: What every text with markup holds; the JVM drops the rest before Python sees it.
_ANY = r"[<&#`*~=\[{'\\$|]|\b_|_\b|(?:^|\n)[ \t]*[>+-]"


def is_program(text: str) -> bool:
    """Whether most of a text's lines are code."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 3:
        return False
    n = sum(1 for x in lines if _CODE_LINE.search(x) and x.lstrip()[:1] != "\\")
    return n >= 0.85 * len(lines)


def _is_math(piece: str) -> bool:
    body = piece[1:-1]
    if body[:1].isdigit() and not re.search(r"[\\^_{}]", body):
        return False
    if len(body) > PLAIN_MATH:  # a long one shows a sign that only TeX has
        return bool(re.search(r"[\\^_{}]", body))
    return bool(re.search(r"[\\^_{}=<>+]", body)) or len(body) <= 2


def pieces(text: str) -> dict[str, int]:
    """How many pieces of markup of each kind a text holds; empty if none."""
    t = "\n" + text.replace("\r\n", "\n")
    found: dict[str, int] = {}
    program = None
    if t.startswith("\n---\n") and _FRONT.match(t):
        found["front"] = 1
    for m in _SCAN.finditer(t):
        kind = m.lastgroup
        if kind == "entity":
            name = m.group()[1:]
            if name[0] != "#" and name not in html5:
                continue
        elif kind == "math" and m.group() != "$$" and not _is_math(m.group()):
            continue
        if kind not in _FIRM:
            if program is None:
                program = is_program(text)
            if program:
                continue
        found[kind] = found.get(kind, 0) + 1
    weak = found.keys() <= {"bullet"}
    return {} if weak and found.get("bullet", 0) < 2 else found


def markup_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kinds, n_pieces) of every chunk that holds markup; one pass, no shuffle."""

    def fn(batch: pa.RecordBatch) -> pa.Table | None:
        rows = []
        for cid, text in zip(batch.column("chunk_id").to_pylist(), batch.column("content").to_pylist()):
            got = pieces(text)
            if got:
                rows.append((cid, ",".join(sorted(got)), sum(got.values())))
        if not rows:
            return None
        a, b, c = zip(*rows)
        return pa.table({"chunk_id": pa.array(a, pa.string()), "kinds": pa.array(b), "n_pieces": pa.array(c, pa.int32())})

    some = chunks.select(F.col("id").alias("chunk_id"), "content").where(F.col("content").rlike(_ANY))
    return map_texts(some, "content", fn, "chunk_id string, kinds string, n_pieces int")


_CODE_BLOCKS = re.compile(
    r"^(?:```|~~~)(?P<lang>[^\n]*)\n(?P<fenced>.*?)(?:^(?:```|~~~)[ \t]*$|\Z)"
    r"|<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(?P<pre>(?:[^<]++|<(?!/?pre\b))*+)</pre>"
    r"|<(?:syntaxhighlight|source)\b[^>]*>(?P<wiki>(?:[^<]++|<(?!/?(?:syntaxhighlight|source)\b))*+)</(?:syntaxhighlight|source)>"
    r"|\\begin\{(?:verbatim|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^}]*\})*(?P<tex>(?:[^\\]++|\\(?!(?:begin|end)\{(?:verbatim|lstlisting|minted)))*+)\\end\{(?:verbatim|lstlisting|minted)\}",
    re.S | re.M | re.I,
)
_FORMULAS = re.compile(
    r"\$\$(?P<a>[^$]+)\$\$|\\\[(?P<b>(?:[^\\]++|\\(?![\[\]()]))++)\\\]|<math\b[^>]*>(?P<c>(?:[^<]++|<(?!/?math\b))*+)</math>|\\begin\{(?P<env>equation|align|gather|multline|eqnarray)\*?\}(?P<d>(?:[^\\]++|\\(?!(?:begin|end)\{(?P=env)))*+)\\end\{(?P=env)\*?\}"
    r"|\\\((?P<e>(?:[^\\]++|\\(?![\[\]()]))++)\\\)|(?<![\w$\\])\$(?=[^\s$])(?P<f>[^$\n]+)(?<=[^\s$])\$(?![\w$])",
    re.S,
)
_DISPLAY = ("a", "b", "d")
_TEX_HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}


def _heading(level: int, text: str) -> str:
    return f"\n\n{'#' * min(6, max(1, level))} {' '.join(text.split())}\n"


def _html(t: str) -> str:
    t = re.sub(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<(script|style)\b[^>]*>.*?(?:</\1>|\Z)|<ref\b[^>/]*>(?:[^<]++|<(?!/?ref\b))*+</ref>|<ref\b[^>]*/>", " ", t, flags=re.S | re.I)
    t = re.sub(r"<h([1-6])\b[^>]*>((?:[^<]++|<(?!/?h[1-6]\b))*+)</h\1>", lambda m: _heading(int(m[1]), re.sub(r"<[^<>]*>", "", m[2])), t, flags=re.S | re.I)
    t = re.sub(r"<li\b[^>]*>\s*", "\n- ", t, flags=re.I)
    t = re.sub(r"</t[dh]>\s*<t[dh]\b[^>]*>", " | ", t, flags=re.I)
    t = re.sub(r"<br\b[^>]*>\s?", "\n", t, flags=re.I)
    t = re.sub(r"</?(?:p|div|tr|ul|ol|dl|dt|dd|table|tbody|thead|section|article|blockquote|header|footer|figure|hr|body|html)\b[^<>]*>", "\n", t, flags=re.I)
    return re.sub(r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?=[\s/>])[^<>]*>", "", t, flags=re.I)


def _wiki(t: str) -> str:
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"^(={2,6}) ?([^\n=]+?) ?\1[ \t]*$", lambda m: _heading(len(m[1]), m[2]), t, flags=re.M)
    t = re.sub(r"^\{\|[^\n]*$|^\|\}[^\n]*$|^\|-[^\n]*$", "", t, flags=re.M)
    t = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\[\]|]*(?:\|[^\[\]|]*)*?\|?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+ ([^\[\]\n]+)\]", r"\1", t)
    return re.sub(r"(?<![\w'])'{2,5}(?=\S)([^\n]+?)(?<=\S)'{2,5}(?!')", r"\1", t)


def _latex(t: str) -> str:
    t = re.sub(r"(?<!\\)%[^\n]*$", "", t, flags=re.M)
    t = re.sub(r"\\(" + "|".join(sorted(_TEX_HEADS, key=len, reverse=True)) + r")\*?\{([^{}]*)\}", lambda m: _heading(_TEX_HEADS[m[1]], m[2]), t)
    t = re.sub(r"\\item\b(?:\[([^\[\]\n]*)\])?\s*", lambda m: "\n- " + (m[1] + " " if m[1] else ""), t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\[\]\n]*\])?", "\n", t)
    t = re.sub(r"~?\\(?:label|cite[tp]?|ref|eqref|pageref|documentclass|usepackage|includegraphics|bibliography|bibliographystyle)\*?(?:\[[^\[\]\n]*\])*\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    return re.sub(r"\\([%&_#$])", r"\1", t)


def _markdown(t: str) -> str:
    t = re.sub(r"\A\s*---\n((?:[\w-]+:[^\n]*\n(?:[ \t]*- [^\n]*\n)*)+)---\n?", lambda m: _heading(1, h[1]) if (h := re.search(r"^title:\s*(.+)$", m[1], re.M)) else "", t)
    t = re.sub(r"^([^\n#>|-][^\n]*)\n(=|-)\2{2,}[ \t]*$", lambda m: _heading(1 if m[2] == "=" else 2, m[1]), t, flags=re.M)
    t = re.sub(r"^(?:-{3,}|\*{3,}|_{3,})[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"^> ?", "", t, flags=re.M)
    t = re.sub(r"^([ \t]*)[*+] +(?=\S)", r"\1- ", t, flags=re.M)
    t = re.sub(r"^\|(?:[ :]*-+[ :]*\|)+[ \t]*\n?", "", t, flags=re.M)
    t = re.sub(r"^\|(.*)\|[ \t]*$", lambda m: " | ".join(x.strip() for x in m[1].split("|")), t, flags=re.M)
    t = re.sub(r"!?\[(?<!\w\[)([^\[\]\n]+)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"\[(?<!\w\[)([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"`{1,2}([^`\n]+)`{1,2}", r"\1", t)
    t = re.sub(r"(?<![\w*])\*\*(?=[^\s*])((?:[^*\n]++|\*(?!\*))+)(?<=[^\s*])\*\*(?![\w*])", r"\1", t)
    t = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]+)(?<=[^\s*])\1(?![\w*])", r"\2", t)
    t = re.sub(r"(?<![\w_])__(?=[^\s_])((?:[^_\n]++|_(?!_))+)(?<=[^\s_])__(?![\w_])", r"\1", t)
    t = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]+)(?<=[^\s_])\1(?![\w_])", r"\2", t)
    return re.sub(r"(~~|==)(?=[^\s~=])([^~=\n]+)(?<=[^\s~=])\1", r"\2", t)


def clean_text(text: str) -> str:
    """One text without markup; headings, lists, code blocks and formulas are kept in one notation."""
    got = pieces(text)
    if not got:
        return text
    t = text.replace("\r\n", "\n").replace("\x00", "")
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        body = next(g for g in (m["fenced"], m["pre"], m["wiki"], m["tex"]) if g is not None)
        if m["pre"] is not None:
            body = html.unescape(re.sub(r"</?code[^>]*>", "", body))
        body = body.strip("\n")
        return f"\n{keep(f'```{(m['lang'] or '').strip()}{chr(10)}{body}{chr(10)}```')}\n"

    def formula(m: re.Match) -> str:
        name = next(k for k in "abcdef" if m[k] is not None)
        body = m[name].strip()
        if name == "f" and not _is_math(m.group()):
            return m.group()
        return keep(f"$${body}$$" if name in _DISPLAY else f"${body}$")

    t = _FORMULAS.sub(formula, _CODE_BLOCKS.sub(code, t))
    if got.keys() & {"tag", "comment", "entity", "autolink"}:
        t = html.unescape(_html(t))
        t = _html(t)  # what was escaped
    if got.keys() & {"wikihead", "wikilink", "wikitable", "wikibold", "template"}:
        t = _wiki(t)
    if "latex" in got:
        t = _latex(t)
    if got.keys() - {"tag", "comment", "entity", "latex", "math"}:
        t = _markdown(t)
    for _ in range(3):  # a kept piece may hold another
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    t = re.sub(r"[ \t\u00a0]+\n", "\n", t).replace("\u00a0", " ")
    return re.sub(r"\n{3,}", "\n\n", t).strip("\n").rstrip()


# ---- host suffix array -------------------------------------------------------------------------

#: Boilerplate: at least so many tokens in a row, standing on so many distinct pages of a host.
MIN_TOKENS, MIN_PAGES = 12, 5
#: Tokens of one host that are sorted in one task; larger hosts are dealt out in blocks by page and
#: their counts added up, so no host, however large, comes into one task.
BLOCK_TOKENS = 400_000


def suffix_groups(token: np.ndarray, page: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token stream sorted to ``depth`` tokens (a power of two rounds up by
    overlap), as (suffix start in sorted order, group number): suffixes of one group share their
    first ``depth`` tokens and none crosses a page's end."""
    n = len(token)
    if n < depth:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, rank = np.unique(token, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while width < depth:  # prefix doubling; the last step overlaps so that exactly depth tokens count
        step = min(width, depth - width)
        m = len(rank) - step
        _, rank = np.unique(rank[:m] * (rank.max() + 1) + rank[step : step + m], return_inverse=True)
        rank = rank.astype(np.int64)
        width += step
    start = np.flatnonzero(page[: len(rank)] == page[depth - 1 : depth - 1 + len(rank)])
    order = np.argsort(rank[start], kind="stable")
    start = start[order]
    return start, rank[start]


def _stream(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cp, off = cpx.explode(texts)
    h, row, ws, we = cpx.words(cp, off)
    return h, row, ws, we, off


def remove_boilerplate(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """pages (host, page_id, text) -> (page_id, text, removed): each page without the token runs that
    its host repeats on ``min_pages`` or more distinct pages.

    Blocks of a host are sorted in parallel and give (host, run hash, pages); the counts are added
    over blocks.  A bit table of the repeated runs keeps all other places from the shuffle in which the
    runs come back to their pages by host and hash.  Hosts are keyed by a 64-bit hash.
    """
    p = pages.select(F.xxhash64("host").alias("host"), "page_id", F.coalesce("text", F.lit("")).alias("text"))
    # Copies of one text count as one page, and texts are read once per copy class.
    p = p.withColumn("body", F.xxhash64("text"))
    sizes = p.groupBy("host").agg((F.sum(F.length("text")) / F.lit(6.0 * block_tokens)).alias("load"))
    placed = p.join(sizes, "host").withColumn("blocks", F.greatest(F.lit(1), F.ceil("load")).cast("long")).withColumn("block", F.pmod("body", F.col("blocks"))).select("host", "body", "text", "blocks", "block")

    def sort_block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("body")
        h, row, _, _, _ = _stream(f["text"].tolist())
        start, group = suffix_groups(h, row, min_tokens)
        if not len(start):
            return pd.DataFrame({"host": np.array([], dtype=np.int64), "run": np.array([], dtype=np.int64), "pages": np.array([], dtype=np.int64)})
        x, first = cpx.shingles(h, row, min_tokens)
        run = dict(zip(first.tolist(), range(len(first))))
        page = row[start]
        pair = np.unique(np.stack([group, page]), axis=1)  # distinct pages of each group
        uniq, counts = np.unique(pair[0], return_counts=True)
        heads = start[np.searchsorted(group, uniq)]
        out = pd.DataFrame({"host": np.full(len(uniq), key[0], dtype=np.int64), "run": x[[run[s] for s in heads.tolist()]].view(np.int64), "pages": counts})
        return out[out["pages"] >= min_pages] if f["blocks"].iloc[0] == 1 else out  # a block by itself is its host

    runs = placed.groupBy("host", "block").applyInPandas(sort_block, "host long, run long, pages long")
    common = cut_lineage(runs.groupBy("host", "run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages).select("host", "run"))
    shared = pages.sparkSession.sparkContext.broadcast(bit_filter(common, "run"))

    def positions(batch: pa.RecordBatch) -> pa.Table:
        h, row, _, _, _ = _stream(batch.column("text").to_pylist())
        x, first = cpx.shingles(h, row, min_tokens)
        some = may_hold(shared.value, x)
        x, first = x[some], first[some]
        base = np.searchsorted(row, np.arange(batch.num_rows))
        take = pa.array(row[first])
        return pa.table({"host": batch.column("host").take(take), "page_id": batch.column("page_id").take(take), "run": pa.array(x.view(np.int64)), "at": pa.array((first - base[row[first]]).astype(np.int32))})

    at = map_texts(p.select("host", "page_id", "text"), "text", positions, "host long, page_id string, run long, at int")
    covered = at.join(common, ["host", "run"]).groupBy("page_id").agg(F.sort_array(F.collect_set("at")).alias("covered"))

    def cut(batch: pa.RecordBatch) -> pa.Table:
        texts, marks = batch.column("text").to_pylist(), batch.column("covered").to_pylist()
        out, removed = [], []
        for text, mark in zip(texts, marks):
            if not mark:
                out.append(text)
                removed.append(0)
                continue
            h, _, ws, we, _ = _stream([text])
            drop = np.zeros(len(h), dtype=bool)
            for a in mark:
                drop[a : a + min_tokens] = True
            if drop.all():
                out.append(text)
                removed.append(0)
                continue
            keep, spans = [], np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0]))))
            last = 0
            for a, b in zip(spans[::2], spans[1::2]):
                keep.append(text[last : ws[a]])
                last = we[b - 1]
            keep.append(text[last:])
            out.append("".join(keep))
            removed.append(int(drop.sum()))
        return pa.table({"page_id": batch.column("page_id"), "text": pa.array(out, pa.string()), "removed": pa.array(removed, pa.int32())})

    return map_texts(p.join(covered, "page_id", "left").select("page_id", "text", "covered"), "text", cut, "page_id string, text string, removed int")


def clean_chunks(chunks: DataFrame, **options) -> DataFrame:
    """(chunk_id, content, content_tokenized, n_pieces, removed) of every chunk with markup or boilerplate, clean of both.

    Boilerplate is counted over all pages of a host, those without markup too."""

    def fn(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column("content").to_pylist()
        n = [sum(pieces(t).values()) if m else 0 for t, m in zip(texts, batch.column("marked").to_pylist())]
        text = [clean_text(t) if k else t for t, k in zip(texts, n)]
        return pa.table({"page_id": batch.column("chunk_id"), "host": batch.column("kb_id"), "text": pa.array(text, pa.string()), "n_pieces": pa.array(n, pa.int32())})

    def tokenized(batch: pa.RecordBatch) -> pa.Table:
        stream = pa.array([pre_tokenize(t) for t in batch.column("content").to_pylist()], pa.string())
        return pa.table({"chunk_id": batch.column("chunk_id"), "content": batch.column("content"), "content_tokenized": stream, "n_pieces": batch.column("n_pieces"), "removed": batch.column("removed")})

    every = chunks.where(F.col("content").isNotNull()).select(F.col("id").alias("chunk_id"), F.coalesce("kb_id", F.lit("")).alias("kb_id"), "content", F.col("content").rlike(_ANY).alias("marked"))
    clean = cut_lineage(map_texts(every, "content", fn, "page_id string, host string, text string, n_pieces int"))
    unique = remove_boilerplate(clean, **options)
    changed = clean.select("page_id", "n_pieces").join(unique, "page_id").where((F.col("n_pieces") > 0) | (F.col("removed") > 0))
    out = changed.select(F.col("page_id").alias("chunk_id"), F.col("text").alias("content"), "n_pieces", "removed")
    return map_texts(out, "content", tokenized, "chunk_id string, content string, content_tokenized string, n_pieces int, removed int")
