"""Search profiles: how many candidates, results and context lines a search takes."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx


@dataclass(frozen=True)
class Tuning:
    limit: int
    snippet: int
    min_score: float
    candidate_min: int
    candidate_times: int
    context_lines: int
    context_chars: int
    neighbours: int
    rerank: int
    rerank_times: int

    def candidates(self, limit: int | None = None, offset: int = 0) -> int:
        return max(self.candidate_min, offset + (limit or self.limit) * self.candidate_times)


# The profiles, and the bounds of each value that the environment may set.
PROFILES: dict[str, Tuning] = {
    "balanced": Tuning(10, 240, 0.18, 50, 12, 80, 6000, 5, 30, 3),
    "low_token": Tuning(5, 768, 0.4, 35, 8, 80, 6000, 5, 20, 2),
    "precision": Tuning(5, 400, 0.4, 30, 6, 60, 4000, 4, 20, 2),
    "recall": Tuning(15, 320, 0.12, 75, 16, 100, 8000, 6, 40, 3),
    "long_context": Tuning(5, 1000, 0.25, 50, 10, 120, 10000, 7, 30, 2),
    "code": Tuning(10, 320, 0.25, 50, 12, 80, 6000, 5, 30, 3),
    "docs": Tuning(8, 768, 0.22, 60, 12, 120, 9000, 7, 30, 3),
}
BOUNDS = {"limit": (1, 50), "snippet": (80, 4000), "min_score": (0, 1), "candidate_min": (10, 500), "candidate_times": (2, 30), "context_lines": (10, 500), "context_chars": (1000, 50000), "neighbours": (1, 20), "rerank": (5, 100), "rerank_times": (1, 10)}
ERRORS = ["error", "exception", "failed", "failure", "stack", "trace", "enoent", "eacces", "timeout", "abort", "cancelled"]
ERRORS_CJK = ["錯誤", "失敗"]
LONG = ["explain", "why", "how", "architecture", "design", "overview", "doc", "docs", "spec", "manual", "guide"]
LONG_CJK = ["流程", "架構", "概念", "為什麼", "如何", "文件", "規格"]
FILE_ENDS = ["ts", "tsx", "js", "jsx", "json", "md", "py", "go", "rs", "java", "yml", "yaml", "toml"]
PRECISE_MODES, LONG_MODES = ["code", "config", "errors", "fast"], ["docs", "decision", "adaptive"]
#: Environment variables are named by this prefix and the value's name in capitals.
ENV_PREFIX = "FATHOMGRID_SEARCH_"


def _any(low: Column, words: list[str], parts: list[str]) -> Column:
    tokens = F.split(low, "[^a-z0-9_]+")
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words))) | F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))


def names_code(q: Column) -> Column:
    """Whether a query is a constant or a file name, or holds a call, a dotted name or mixed-case names."""
    t = F.trim(q)
    constant = t.rlike("^[A-Z][A-Z0-9_]+$") & (F.length(t) >= 3)
    file = ~t.rlike(r"\s") & F.lower(F.element_at(F.split(t, "[.]"), -1)).isin(*FILE_ENDS) & t.contains(".")
    names = F.split(t, "[^A-Za-z0-9_$]+")
    mixed = F.exists(names, lambda w: (w.rlike("^[A-Z]") & (F.length(F.regexp_replace(w, "[^A-Z]", "")) >= 2)) | w.rlike("^[a-z]+[A-Z]"))
    call = t.rlike(r"[A-Za-z0-9_$]\(.*\)")
    dotted = t.rlike(r"[A-Za-z0-9_$]\.[A-Za-z_$]")
    return constant | file | mixed | call | dotted


def profile(query: Column, mode: Column, has_documents: Column | bool = False) -> Column:
    """The profile that suits a query, its mode and whether some base holds pages or plain texts."""
    low = F.lower(F.trim(query))
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    m = F.coalesce(mode, F.lit("hybrid"))
    documents = F.lit(has_documents) if isinstance(has_documents, bool) else has_documents
    return (
        F.when(m.isin(*PRECISE_MODES), "precision").when(m.isin(*LONG_MODES), "long_context").when(m == "semantic", "recall")
        .when(_any(low, ERRORS, ERRORS_CJK) | names_code(query), "precision")
        .when((words >= tx.LONG_QUERY) | _any(low, LONG, LONG_CJK) | documents, "long_context")
        .otherwise("balanced")
    )


def resolve(name: str, env: Mapping[str, str] | None = None) -> Tuning:
    """A profile with what the environment sets, each value within its bounds; what isn't a number is ignored."""
    env = os.environ if env is None else env
    t = PROFILES[name]
    for f in fields(Tuning):
        try:
            value = float(env.get(ENV_PREFIX + f.name.upper(), ""))
        except ValueError:
            continue
        if value == value and abs(value) != float("inf"):
            lo, hi = BOUNDS[f.name]
            value = min(hi, max(lo, value))
            t = replace(t, **{f.name: value if f.name == "min_score" else int(value)})
    return t
