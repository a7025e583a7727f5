"""Structure-aware chunking: Markdown, LaTeX, plain text and program text, as pure cores.

Every chunker gives (content, start_line, end_line, metadata) rows.  Protected segments (code
fences, displayed mathematics, tables, LaTeX environments) are never cut unless they alone exceed
the limit, and then only at rows or lines.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomgrid.functions.science import pre_tokenize

MAX_CHARS, MIN_CHARS = 6000, 50
TARGET = {"markdown": 450, "latex": 450, "text": 550, "code": 900}
FORMULA_CAP, FORMULA_CHARS, LINK_CAP, LABEL_CAP, REF_CAP, TAG_CAP, ALIAS_CAP = 10, 2000, 20, 20, 40, 20, 10


@dataclass
class Segment:
    kind: str  # text, math, table or code
    text: str
    start: int  # first line, from 1
    end: int


@dataclass
class Piece:
    content: str
    start: int
    end: int
    metadata: dict = field(default_factory=dict)


def tokens_of(text: str) -> int:
    return -(-len(text) // 3)


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|table|tabular|figure|verbatim|lstlisting)\*?\}")


def segments(text: str, first_line: int = 1) -> list[Segment]:
    """The protected spans of a text and the text between them, by lines."""
    lines = text.split("\n")
    out: list[Segment] = []
    plain: list[str] = []
    at = 0

    def flush(upto: int) -> None:
        if plain:
            out.append(Segment("text", "\n".join(plain), first_line + upto - len(plain), first_line + upto - 1))
            plain.clear()

    def take(kind: str, end: int) -> None:
        nonlocal at
        flush(at)
        out.append(Segment(kind, "\n".join(lines[at : end + 1]), first_line + at, first_line + end))
        at = end + 1

    def find(start: int, stop) -> int:
        return next((k for k in range(start, len(lines)) if stop(lines[k])), -1)

    while at < len(lines):
        line = lines[at]
        stripped = line.strip()
        fence = _FENCE.match(line)
        env = _ENV.search(line)
        end = -1
        if fence:
            end = find(at + 1, lambda x: x.strip().startswith(fence[1]) and not x.strip().strip(fence[1][0]))
            take("code", end if end >= 0 else len(lines) - 1)
        elif stripped.startswith("$$") and (stripped.count("$$") >= 2 or (end := find(at + 1, lambda x: "$$" in x)) >= 0):
            take("math", at if stripped.count("$$") >= 2 else end)
        elif stripped.startswith("\\[") and ("\\]" in stripped or (end := find(at + 1, lambda x: "\\]" in x)) >= 0):
            take("math", at if "\\]" in stripped else end)
        elif env and (end := find(at, lambda x: f"\\end{{{env[1]}" in x)) >= 0:
            take("table" if env[1] in ("table", "tabular", "figure") else "code" if env[1] in ("verbatim", "lstlisting") else "math", end)
        elif stripped.startswith("|") and stripped.endswith("|") and len(stripped) > 1:
            end = find(at, lambda x: not (x.strip().startswith("|") and x.strip().endswith("|")))
            take("table", (end if end >= 0 else len(lines)) - 1)
        else:
            plain.append(line)
            at += 1
    flush(at)
    return out


def split_long(seg: Segment, limit: int = MAX_CHARS) -> list[Segment]:
    """A segment over the limit in pieces: at formula rows, else at lines, else by length."""
    if len(seg.text) <= limit:
        return [seg]
    parts: list[Segment] = []
    units = re.split(r"(?<=\\\\)\n?|\n", seg.text) if seg.kind == "math" else seg.text.split("\n")
    held: list[str] = []
    line, begin = seg.start, seg.start
    for u in units:
        while len(u) > limit:
            if held:
                parts.append(Segment(seg.kind, "\n".join(held), begin, line - 1))
                held = []
            parts.append(Segment(seg.kind, u[:limit], line, line))
            u, begin = u[limit:], line
        if held and sum(map(len, held)) + len(held) + len(u) > limit:
            parts.append(Segment(seg.kind, "\n".join(held), begin, line - 1))
            held, begin = [], line
        held.append(u)
        line = min(line + 1, seg.end + 1)
    if held:
        parts.append(Segment(seg.kind, "\n".join(held), begin, seg.end))
    return parts


def pack(segs: list[Segment], target: int, limit: int = MAX_CHARS) -> list[tuple[str, int, int]]:
    """Segments in chunks of about ``target`` tokens and at most ``limit`` characters, paragraphs kept whole."""
    units: list[Segment] = []
    for s in segs:
        if s.kind != "text":
            units += split_long(s, limit)
            continue
        at = s.start
        for para in re.split(r"(\n[ \t]*\n)", s.text):
            n = para.count("\n")
            if para.strip():
                units += split_long(Segment("text", para.strip("\n"), at, at + n), limit)
            at += n
    out: list[tuple[str, int, int]] = []
    held: list[Segment] = []
    for u in units:
        size = sum(len(x.text) + 2 for x in held)
        if held and (tokens_of("x" * (size + len(u.text))) > target or size + len(u.text) > limit):
            out.append(("\n\n".join(x.text for x in held), held[0].start, held[-1].end))
            held = []
        held.append(u)
    if held:
        out.append(("\n\n".join(x.text for x in held), held[0].start, held[-1].end))
    return out


def _capped(found: Iterator[str], n: int, size: int = 10**9) -> list[str]:
    seen: dict[str, None] = {}
    for x in found:
        x = x.strip()
        if x:
            seen.setdefault(x if len(x) <= size else x[:size] + "…")
        if len(seen) >= n:
            break
    return list(seen)


def formulas_in(text: str) -> list[str]:
    return _capped((a or b or c for a, b, c in re.findall(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(?:equation|align)\*?\}(.+?)\\end\{(?:equation|align)\*?\}", text, re.S)), FORMULA_CAP, FORMULA_CHARS)


def wikilinks_in(text: str) -> list[str]:
    return _capped(iter(re.findall(r"\[\[([^\[\]|#]+)(?:[#|][^\[\]]*)?\]\]", text)), LINK_CAP)


def labels_in(text: str) -> tuple[list[str], list[str]]:
    return _capped(iter(re.findall(r"\\label\{([^{}]+)\}", text)), LABEL_CAP), _capped(iter(re.findall(r"\\(?:eq|page|c|C|auto)?ref\{([^{}]+)\}", text)), REF_CAP)


def frontmatter(text: str) -> tuple[dict, int]:
    """Title, tags and aliases at a text's top and the number of lines they take; malformed gives nothing."""
    m = re.match(r"---\n(.*?\n)?(?:---|\.\.\.)(?:\n|\Z)", text, re.S)
    if not m:
        return {}, 0
    out: dict = {}
    key = None
    for line in (m[1] or "").split("\n"):
        item = re.match(r"\s*-\s+(.+)", line)
        pair = re.match(r"([A-Za-z_]+):\s*(.*)", line)
        if item and key in ("tags", "aliases"):
            out.setdefault(key, []).append(item[1].strip(" \"'"))
        elif pair:
            key, value = pair[1].lower(), pair[2].strip()
            if key == "title" and value:
                out["title"] = value.strip("\"'")
            elif key in ("tags", "aliases") and value:
                out[key] = [x.strip(" \"'") for x in value.strip("[]").split(",") if x.strip(" \"'")]
    for k, n in (("tags", TAG_CAP), ("aliases", ALIAS_CAP)):
        if k in out:
            out[k] = out[k][:n]
    return out, m[0].count("\n")


def chunk_markdown(text: str) -> list[Piece]:
    front, skip = frontmatter(text)
    body = "\n".join(text.split("\n")[skip:])
    sections: list[tuple[str, list[str], list[Segment]]] = [("", [], [])]
    trail: dict[int, str] = {}
    for seg in segments(body, skip + 1):
        if seg.kind != "text":
            sections[-1][2].append(seg)
            continue
        buffer: list[str] = []
        start = seg.start
        for k, line in enumerate(seg.text.split("\n")):
            m = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
            if m:
                if buffer:
                    sections[-1][2].append(Segment("text", "\n".join(buffer), start, seg.start + k - 1))
                level = len(m[1])
                trail = {a: b for a, b in trail.items() if a < level} | {level: m[2]}
                sections.append((m[2], [trail[x] for x in sorted(trail)], []))
                buffer, start = [line], seg.start + k
            else:
                buffer.append(line)
        if buffer:
            sections[-1][2].append(Segment("text", "\n".join(buffer), start, seg.end))
    out: list[Piece] = []
    for heading, crumbs, segs in sections:
        if not segs:
            continue
        last = segs[-1].end
        for content, start, _ in pack(segs, TARGET["markdown"]):
            if len(content.strip()) < MIN_CHARS:
                continue
            meta: dict = dict(front)
            if heading:
                meta |= {"heading": heading, "breadcrumb": " > ".join(crumbs)}
            if links := wikilinks_in(content):
                meta["links"] = links
            if formulas := formulas_in(content):
                meta["formulas"] = formulas
            out.append(Piece(content, start, last, meta))
    return out


def chunk_latex(text: str) -> list[Piece]:
    sections: list[tuple[str, int, list[str]]] = [("", 1, [])]
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\s*\{(.+?)\}", line)
        if m:
            sections.append((m[1], n, []))
        sections[-1][2].append(line)
    out: list[Piece] = []
    for heading, start, lines in sections:
        for content, a, b in pack(segments("\n".join(lines), start), TARGET["latex"]):
            if len(content.strip()) < MIN_CHARS:
                continue
            labels, refs = labels_in(content)
            meta = {"heading": heading} if heading else {}
            meta |= {k: v for k, v in (("labels", labels), ("refs", refs), ("formulas", formulas_in(content))) if v}
            out.append(Piece(content, a, b, meta))
    return out


def chunk_text(text: str) -> list[Piece]:
    return [Piece(c, a, b, {}) for c, a, b in pack([Segment("text", text, 1, text.count("\n") + 1)], TARGET["text"]) if len(c.strip()) >= MIN_CHARS]


#: What opens a definition in languages with braces or keywords, by kind.
_DEFINITIONS = [
    ("class", re.compile(r"^\s*(?:export\s+)?(?:public\s+|abstract\s+|final\s+)*(?:class|interface|struct|enum|trait|impl)\s+([A-Za-z_]\w*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:function|func|fn|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")),
    ("function", re.compile(r"^\s*(?:public|private|protected|static|\s)*[\w<>\[\], ]+\s+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws \w+\s*)?\{")),
]


def _code_spans(text: str, language: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, signature) of the definitions at the top level."""
    lines = text.split("\n")
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            tree = None
        if tree is not None:
            out = []
            for node in tree.body:
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                    out.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, first, node.end_lineno or first, lines[node.lineno - 1].strip()))
            return out
    out = []
    k = 0
    while k < len(lines):
        hit = next(((kind, m) for kind, p in _DEFINITIONS if (m := p.match(lines[k]))), None)
        if not hit or (lines[k][:1].isspace() and language != "python"):
            k += 1
            continue
        depth, end, opened = 0, k, False
        indent = len(lines[k]) - len(lines[k].lstrip())
        for j in range(k, len(lines)):
            bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|#.*", "", lines[j])
            opened |= "{" in bare
            depth += bare.count("{") - bare.count("}")
            end = j
            if opened and depth <= 0:
                break
            if not opened and j > k and lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                end = j - 1
                break
        out.append((hit[0], hit[1][1], k + 1, end + 1, lines[k].strip()))
        k = end + 1
    return out


def chunk_code(text: str, language: str) -> list[Piece]:
    """Definitions as chunks; small neighbours are packed together, large ones split at lines.

    Python is read with its own parser, other languages by keywords, braces and indentation."""
    lines = text.split("\n")
    spans = _code_spans(text, language)
    if not spans:
        return [Piece(p.content, p.start, p.end, {"language": language}) for p in chunk_text(text)]
    blocks: list[tuple[int, int, dict]] = []
    at = 1
    for kind, name, a, b, signature in spans:
        if a > at and "".join(lines[at - 1 : a - 1]).strip():
            blocks.append((at, a - 1, {"language": language}))
        blocks.append((a, b, {"language": language, "symbol": name, "symbol_kind": kind, "signature": signature, "exported": signature.startswith(("export", "pub")) or (language == "python" and not name.startswith("_"))}))
        at = b + 1
    if "".join(lines[at - 1 :]).strip():
        blocks.append((at, len(lines), {"language": language}))
    out: list[Piece] = []
    group: list[tuple[int, int, dict]] = []

    def close() -> None:
        if not group:
            return
        a, b = group[0][0], group[-1][1]
        named = [m["symbol"] for _, _, m in group if "symbol" in m]
        meta = group[0][2] if len(group) == 1 else {"language": language, "symbols": named, "symbol_kind": "group"}
        for part, seg in enumerate(split_long(Segment("code", "\n".join(lines[a - 1 : b]), a, b))):
            out.append(Piece(seg.text, seg.start, seg.end, meta if len(seg.text) == sum(map(len, lines[a - 1 : b])) + b - a else meta | {"chunk_part": str(part + 1)}))
        group.clear()

    for block in blocks:
        size = sum(tokens_of("\n".join(lines[a - 1 : b])) for a, b, _ in [*group, block])
        if group and size > TARGET["code"]:
            close()
        group.append(block)
    close()
    return out


CODE = {"typescript", "javascript", "python", "go", "rust", "java", "c", "cpp", "csharp", "php", "ruby", "bash"}


def chunk(text: str, kind: str) -> list[Piece]:
    """Chunks by file type; what gives none and has over ten characters is one chunk."""
    if kind == "markdown":
        out = chunk_markdown(text)
    elif kind == "latex":
        out = chunk_latex(text)
    elif kind in CODE:
        out = chunk_code(text, kind)
    else:
        out = chunk_text(text)
    if not out and len(text.strip()) > 10:
        out = [Piece(x.text, x.start, x.end, {}) for x in split_long(Segment("text", text, 1, text.count("\n") + 1))]
    return out


CHUNK_SCHEMA = "doc string, ordinal int, content string, start_line int, end_line int, metadata_json string, content_tokenized string"


def chunk_documents(docs: DataFrame, key: str, text: str, kind: Column, tokenize: bool = True) -> DataFrame:
    """Chunks of every document: (doc, ordinal, content, start_line, end_line, metadata_json, content_tokenized).
    Without ``tokenize`` the stream is null, for callers that index the text with its prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, body, k in zip(f["doc"], f["body"], f["kind"]):
                for n, p in enumerate(chunk(body, k)):
                    rows.append((doc, n, p.content, p.start, p.end, json.dumps(p.metadata, ensure_ascii=False), pre_tokenize(p.content) if tokenize else None))
            yield pd.DataFrame(rows, columns=["doc", "ordinal", "content", "start_line", "end_line", "metadata_json", "content_tokenized"])

    d = docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("body"), F.coalesce(kind, F.lit("text")).alias("kind")).where(F.length("body") > 0)
    return d.mapInPandas(run, CHUNK_SCHEMA)


# What coupled tables are marked with, and the limits of the coupling.
CONTEXT_MARK, ROW_MARK = "Context: ", "Row: "
CONTEXT_CHARS, TABLE_LINES, LABEL_CHARS = 400, 3, 60


def _is_table_line(line: str) -> bool:
    body = line.strip()
    return body.count("|") >= 2 or len(re.findall(r"  +", body)) >= 2


def _stamped(line: str) -> str:
    """A table line behind its first cell's text, if that is a label and figures follow it."""
    if line.startswith(ROW_MARK):
        return line
    body = line.strip()
    piped = body.count("|") >= 2
    cells = body.split("|") if piped else re.split(r"  +", body)
    first = next((k for k, c in enumerate(cells) if c.strip()), None) if piped else 0
    if first is None:
        cells, first = re.split(r"  +", body), 0
    label = " ".join(cells[first].split())
    if not any(c.isascii() and c.isalpha() for c in label) or not any(c.isascii() and c.isdigit() for x in cells[first + 1 :] for c in x):
        return line
    if len(label) > LABEL_CHARS:
        cut = label.rfind(" ", 0, LABEL_CHARS + 1)
        label = label[: cut if cut > 0 else LABEL_CHARS]
    return f"{ROW_MARK}{label} | {line}"


def _introduction(before: list[str]) -> str | None:
    """The nearest line of text before a table; none behind a heading, another table or a coupled line."""
    line = next((x for x in reversed(before) if x.strip()), None)
    if line is None or line.strip().startswith(CONTEXT_MARK) or _is_table_line(line) or re.match(r"\s*#{1,6} ", line):
        return None
    sentence = " ".join(line.split())
    if len(sentence) <= CONTEXT_CHARS:
        return sentence
    tail = sentence[-CONTEXT_CHARS:]
    return tail.partition(" ")[2] if " " in tail else tail


def couple_table_rows(text: str) -> str:
    """Tables of text taken from a PDF (runs of three or more table lines) with the line that
    introduces them before them as ``Context: ...`` and every row stamped ``Row: label | ...``;
    what is coupled already stays as it is."""
    lines = text.split("\n")
    out: list[str] = []
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and _is_table_line(lines[end]):
            end += 1
        if end - at < TABLE_LINES:
            out += lines[at : max(end, at + 1)]
            at = max(end, at + 1)
            continue
        introduction = _introduction(lines[:at])
        if introduction is not None:
            out += [CONTEXT_MARK + introduction, ""]
        out += map(_stamped, lines[at:end])
        if end < len(lines) and lines[end].strip():
            out.append("")
        at = end
    return "\n".join(out)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])))
def segments_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"kind": g.kind, "start_line": g.start, "end_line": g.end} for g in segments(x)] if x else [])


def lines_at(text: str, offsets: list[int]) -> list[int]:
    """The line (from 1) of each offset: line starts are found once, offsets by binary search."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return [bisect_right(starts, o) for o in offsets]


_PLACE = re.compile(r"(?m)(?P<heading>^#{1,6} +[^ \n])|(?P<formula>\$\$[^$]+\$\$)")


def place_lines(text: str) -> list[tuple[str, int, int]]:
    """(kind, offset, line) of every heading and display formula."""
    found = [(m.lastgroup, m.start()) for m in _PLACE.finditer(text)]
    return [(kind, o, n) for (kind, o), n in zip(found, lines_at(text, [o for _, o in found]))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("line", T.IntegerType())])))
def place_lines_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [dict(zip(("kind", "offset", "line"), r)) for r in place_lines(x)] if x else [])


@F.pandas_udf(T.StringType())
def table_rows_udf(s: pd.Series) -> pd.Series:
    return s.map(couple_table_rows, na_action="ignore")
