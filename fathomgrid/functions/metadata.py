"""Chunk metadata: a tolerant JSON reader and the contextual prefix of embedding texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = ["heading", "breadcrumb", "title", "converter", "language", "symbol", "function_name", "symbol_kind", "parent_symbol", "signature", "visibility", "chunk_part"]
_LISTS = ["tags", "aliases", "links", "formulas", "labels", "refs", "scope", "decorators", "modifiers", "symbols"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS] + [T.StructField(c, T.IntegerType()) for c in ("start_line", "end_line", "ast_depth")] + [T.StructField("exported", T.BooleanType())])
PREFIX_LIMIT, FORMULA_LIMIT, FORMULAS = 1500, 300, 5


def metadata(col: Column) -> Column:
    """Metadata as a struct; broken JSON gives nulls."""
    return F.from_json(col, SCHEMA, {"mode": "PERMISSIVE"})


def embedding_text(path: str = "file_path", kind: str = "file_type", meta: str = "metadata_json", content: str = "content") -> Column:
    """What is indexed and embedded for a chunk: its place, section and symbols above its content.

    The lines from Title on are kept whole while they fit into PREFIX_LIMIT characters together."""
    m = metadata(F.col(meta))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    joined = lambda name, by: F.when(F.size(m[name]) > 0, F.array_join(m[name], by))
    section = F.when(F.coalesce(m["breadcrumb"], F.lit("")) != "", m["breadcrumb"]).otherwise(F.trim(F.regexp_replace(m["heading"], "^#{1,6}[ ]+", "")))
    scope = F.coalesce(line("Scope", joined("scope", " > ")), line("Parent", m["parent_symbol"]))
    head = [F.concat(F.lit("File: "), F.coalesce(F.col(path), F.lit(""))), F.concat(F.lit("Type: "), F.coalesce(F.col(kind), F.lit(""))), line("Section", section), line("Language", m["language"]), scope, line("Kind", m["symbol_kind"]), line("Symbol", F.coalesce(m["symbol"], m["function_name"])), line("Signature", m["signature"])]
    shown = F.slice(F.filter(F.transform(m["formulas"], lambda f: F.substring(F.trim(F.regexp_replace(f, r"\s+", " ")), 1, FORMULA_LIMIT)), lambda f: f != ""), 1, FORMULAS)
    extra = F.array_compact(F.array(line("Title", m["title"]), line("Tags", joined("tags", ", ")), line("Aliases", joined("aliases", ", ")), line("Links", joined("links", ", ")), line("Labels", joined("labels", ", ")), line("Formulas", F.when(F.size(shown) > 0, F.array_join(shown, " | "))), line("Converter", m["converter"])))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(True).alias("open"))
    step = lambda s, x: F.when(s["open"] & (s["used"] + F.length(x) <= PREFIX_LIMIT), F.struct(F.concat(s["text"], F.lit("\n"), x).alias("text"), (s["used"] + F.length(x)).alias("used"), F.lit(True).alias("open"))).otherwise(F.struct(s["text"].alias("text"), s["used"].alias("used"), F.lit(False).alias("open")))
    guarded = F.aggregate(extra, start, step)["text"]
    return F.concat(F.concat_ws("\n", *head), guarded, F.lit("\n\n"), F.col(content))
