"""Symbols of a file: declarations, routes, configuration keys, environment variables and headings.

Program text is read by a small scanner: comments and strings are blanked, the rest is cut into
tokens, and a table says which keyword opens which kind of declaration.  Configuration is read line
by line, by one reader per format.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords that open a declaration and what they declare, calls that register a route.
KEYWORDS = {"function": "function", "func": "function", "def": "function", "fn": "function", "class": "class", "interface": "interface", "type": "type", "struct": "type", "enum": "type", "trait": "type", "const": "variable", "let": "variable", "var": "variable"}
ROUTE_OBJECTS = {"app", "router", "route", "server", "api", "hono"}
ROUTE_METHODS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "del": "DELETE", "options": "OPTIONS", "head": "HEAD", "all": "ALL", "use": "USE"}
ROUTE_CALLS = {"HandleFunc", "Handle"}
CODE_EXTENSIONS = {"ts", "tsx", "js", "jsx", "mjs", "py", "go", "rs", "java"}
CODE_TYPES = {"typescript", "javascript", "python", "go", "rust", "java"}
CONFIG_EXTENSIONS = {"json", "yaml", "yml", "toml", "env"}
TEX_EXTENSIONS = {"tex", "ltx", "latex"}
TEX_DEPTHS = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}

Symbol = tuple[str, str, int, str]  # kind, name, line, signature

_LEX = re.compile(r"(?P<word>[A-Za-z_$][\w$]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)|(?P<arrow>=>)|(?P<sign>[^\s\w])", re.S)


class _Tokens:
    """The tokens of a program text, with what declarations need: closing brackets and lines."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.all = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEX.finditer(text) if m.lastgroup != "note"]
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, k: int) -> int:
        return bisect_right(self.starts, self.all[k][2])

    def is_(self, k: int, value: str) -> bool:
        return k < len(self.all) and self.all[k][1] == value

    def word(self, k: int) -> str | None:
        return self.all[k][1] if k < len(self.all) and self.all[k][0] == "word" else None

    def closing(self, k: int, pair: str = "()") -> int | None:
        """The number of the bracket that closes the one at ``k``."""
        depth = 0
        for j in range(k, len(self.all)):
            depth += (self.all[j][1] == pair[0]) - (self.all[j][1] == pair[1])
            if depth == 0:
                return j
        return None

    def signature(self, first: int, last: int) -> str:
        return self.text[self.all[first][2] : self.all[last][3]].split("\n")[0].strip()


def _declared(t: _Tokens, k: int) -> tuple[str, int, int] | None:
    """(kind, number of the name, number of the last token) of the declaration that keyword ``k`` opens."""
    keyword = t.all[k][1]
    kind, name = KEYWORDS[keyword], k + 1
    if keyword == "func" and t.is_(name, "("):  # the receiver of a method
        end = t.closing(name)
        name = end + 1 if end else len(t.all)
    if not t.word(name):
        return None
    if kind != "function":
        return kind, name, name
    at = name + 1
    if t.is_(at, "<"):
        at = (t.closing(at, "<>") or len(t.all)) + 1
    end = t.closing(at) if t.is_(at, "(") else None
    return ("function", name, end) if end else None


def _is_arrow(t: _Tokens, name: int) -> int | None:
    """The number of the arrow if the variable named by token ``name`` is set to a function."""
    at = name + 1
    if not t.is_(at, "="):
        return None
    at += 1 + t.is_(at + 1, "async")
    at = (t.closing(at) if t.is_(at, "(") else at if t.word(at) else None) or len(t.all)
    return at + 1 if t.is_(at + 1, "=>") else None


def _route(t: _Tokens, k: int) -> tuple[str, int, int] | None:
    """(name, first token, last token) of the route that the call at word ``k`` registers."""
    word = t.all[k][1]
    path = k + 2
    if not (t.is_(k + 1, "(") and path < len(t.all) and t.all[path][0] == "string"):
        return None
    if word in ROUTE_CALLS:
        return f"ANY {t.all[path][1][1:-1]}", k, path
    if word in ROUTE_METHODS and k >= 2 and t.is_(k - 1, ".") and t.word(k - 2) in ROUTE_OBJECTS:
        return f"{ROUTE_METHODS[word]} {t.all[path][1][1:-1]}", k - 2, path
    return None


def code_symbols(text: str) -> list[Symbol]:
    """Declarations and routes, in the order of lines; one row per kind, name and line."""
    t = _Tokens(text)
    seen: dict[tuple[str, str, int], str] = {}
    for k, (group, value, _, _) in enumerate(t.all):
        if group != "word":
            continue
        if value in KEYWORDS and (found := _declared(t, k)):
            kind, name, last = found
            first = k
            while first and t.word(first - 1) in ("export", "async", "default"):
                first -= 1
            arrow = _is_arrow(t, name) if kind == "variable" else None
            if arrow:
                seen.setdefault(("function", t.all[name][1], t.line(first)), t.signature(first, arrow))
            seen.setdefault((kind, t.all[name][1], t.line(first)), t.signature(first, last))
        elif (value in ROUTE_METHODS or value in ROUTE_CALLS) and (route := _route(t, k)):
            name, first, last = route
            seen.setdefault(("route", name, t.line(first)), t.signature(first, last))
    return [(kind, name, line, s) for (kind, name, line), s in sorted(seen.items(), key=lambda x: (x[0][2], x[0][0], x[0][1]))]


def _config_name(line: str, ext: str) -> str | None:
    body = line.strip()
    plain = lambda s: bool(s) and all(c.isascii() and (c.isalnum() or c in "_.-") for c in s)
    if ext == "json":
        key, quote, rest = body[1:].partition('"') if body.startswith('"') else ("", "", "")
        return key if key and quote and rest.lstrip().startswith(":") else None
    if ext in ("yaml", "yml"):
        key, colon, _ = body.partition(":")
        return key.rstrip() if colon and plain(key.rstrip()) else None
    if ext == "toml":
        if body.startswith("["):
            key = body.lstrip("[").partition("]")[0]
            return key if plain(key) and "]" in body else None
        key, sign, _ = body.partition("=")
        return key.rstrip() if sign and plain(key.rstrip()) else None
    words = body.partition("=")
    key = words[0].rstrip()
    if key.startswith("export") and key[6:7].isspace():
        key = key[6:].lstrip()
    return key if words[1] and key.isascii() and key.isidentifier() else None


def config_symbols(text: str, path: str) -> list[Symbol]:
    """Keys of JSON, YAML and TOML files, variables of environment files."""
    ext = _extension(path)
    kind = "config_key" if ext in CONFIG_EXTENSIONS - {"env"} else "env_var"
    return [(kind, name, n, line.strip()) for n, line in enumerate(text.split("\n"), 1) if (name := _config_name(line, ext))]


def heading_symbols(text: str) -> list[Symbol]:
    out: list[Symbol] = []
    for n, line in enumerate(text.split("\n"), 1):
        marks = len(line) - len(line.lstrip("#"))
        rest = line[marks:]
        if not (1 <= marks <= 6 and rest[:1].isspace() and rest.strip()):
            continue
        name = rest.strip()
        bare = name.rstrip("#")
        if bare != name and bare[-1:].isspace():
            name = bare.rstrip()
        out.append(("heading", name, n, line))
    return out


def latex_symbols(text: str) -> list[Symbol]:
    out: list[Symbol] = []
    for n, line in enumerate(text.split("\n"), 1):
        body = line.strip()
        command, brace, rest = body.partition("{")
        if body.startswith("\\") and brace and rest.endswith("}") and len(rest) > 1 and command[1:].rstrip().removesuffix("*") in TEX_DEPTHS:
            out.append(("heading", rest[:-1].strip(), n, line))
    return out


def _extension(path: str) -> str:
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def extract_symbols(text: str, path: str, file_type: str) -> list[Symbol]:
    """All symbols of a file by its type and extension (a file may have several readers)."""
    ext, name = _extension(path), path.rpartition("/")[2]
    out: list[Symbol] = []
    if file_type == "markdown" or ext in ("md", "mdx"):
        out += heading_symbols(text)
    if ext in TEX_EXTENSIONS:
        out += latex_symbols(text)
    if ext in CONFIG_EXTENSIONS or name.startswith(".env"):
        out += config_symbols(text, path)
    if ext in CODE_EXTENSIONS or file_type in CODE_TYPES:
        out += code_symbols(text)
    return out


SYMBOL = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("signature", T.StringType())]))


def _rows(symbols: list[Symbol]) -> list[dict]:
    return [dict(zip(("kind", "name", "line", "signature"), s)) for s in symbols]


@F.pandas_udf(SYMBOL)
def code_symbols_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _rows(code_symbols(x)) if x else [])


@F.pandas_udf(SYMBOL)
def symbols_udf(text: pd.Series, path: pd.Series, file_type: pd.Series) -> pd.Series:
    return pd.Series([_rows(extract_symbols(t, p or "", k or "")) if t else [] for t, p, k in zip(text, path, file_type)])
