"""The engine's face: indexing, updating, searching, checking and moving knowledge bases."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomgrid.functions import chunkers, science, symbols
from fathomgrid.functions import text as tx
from fathomgrid.functions.metadata import embedding_text, metadata
from fathomgrid.operators import lexical, maintenance, ranking, rerank, retrieval, vector
from fathomgrid.plans import tuning
from fathomgrid.session import cut_lineage
from fathomgrid.sources import files
from fathomgrid.sources.store import Store, export_base, import_base

MAX_OFFSET, MAX_NEIGHBOURS, ATTEMPTS = 10_000, 2, 3
#: Coverage below which results of an exact lookup count as weak.
WEAK_COVERAGE = 0.67
# Modes and what they retrieve by, and the modes tried after one.
RETRIEVAL = {"code": "fast", "config": "fast", "errors": "fast", "docs": "hybrid", "decision": "hybrid", "deep": "hybrid", "adaptive": "hybrid"}
FALLBACKS = {"fast": ["hybrid", "semantic"], "semantic": ["hybrid", "adaptive"], "adaptive": ["hybrid", "deep"], "deep": ["hybrid", "adaptive"], "hybrid": ["fast", "semantic", "adaptive"]}
DIVERSITY = {"balanced": 0.76, "strong": 0.62}


@F.pandas_udf(T.ArrayType(T.StringType()))
def query_formulas_udf(queries: pd.Series) -> pd.Series:
    return queries.map(lambda q: [f.normalized for f in science.query_formulas(q)] if q else [])


def _unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


class Engine:
    """Bases under one root.  ``embed`` (text, dimension) -> vector stands in for a model; its ``label``
    is stored with a base, and a base made by another provider is left out of vector search."""

    def __init__(self, spark: SparkSession, root: str, embed: vector.Embedder = vector.hashed_embedding, dimension: int = vector.DIMENSION, label: str = "hashed", progress: Callable[[dict], None] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.embed, self.dimension, self.label, self.progress = embed, dimension, label, progress
        self.warnings: list[str] = []

    @property
    def signature(self) -> str:
        return f"{self.label}:dim={self.dimension}"

    # ---- indexing ------------------------------------------------------------------------

    def _rows(self, kb_id: str, docs: DataFrame) -> DataFrame:
        """docs (rel_path, file_type, content) as chunk rows of a base; checkpointed, as they are used several times."""
        c = chunkers.chunk_documents(docs, "rel_path", "content", F.col("file_type"), tokenize=False)
        d = docs.select(F.col("rel_path").alias("doc"), "file_type")
        hashed = tx.identity_hash(F.col("doc"), F.col("file_type"), F.col("start_line"), F.col("end_line"), F.col("metadata_json"), F.col("content"))
        rows = c.join(d, "doc").select(
            tx.identity_hash(F.lit(kb_id), F.col("doc"), F.col("ordinal"), F.col("content")).alias("id"), F.lit(kb_id).alias("kb_id"), hashed.alias("content_hash"), "content",
            F.col("doc").alias("file_path"), "file_type", "start_line", "end_line", "metadata_json", F.current_timestamp().alias("indexed_at"),
        )
        return cut_lineage(rows.withColumn("content_tokenized", science.pre_tokenize_udf(embedding_text())))

    def _formulas(self, chunks: DataFrame) -> DataFrame:
        m = metadata(F.col("metadata_json"))
        f = chunks.select("kb_id", F.col("id").alias("chunk_id"), F.posexplode(m["formulas"]).alias("ordinal", "text"))
        n = f.withColumn("n", science.normalize_formula_udf(F.col("text")))
        return n.where("n.normalized is not null").select(tx.identity_hash(F.col("chunk_id"), F.col("ordinal")).alias("id"), "kb_id", "chunk_id", "ordinal", "n.raw", "n.normalized", "n.content_tokenized", "n.token_count")

    def _symbols(self, kb_id: str, docs: DataFrame) -> DataFrame:
        s = docs.select("rel_path", F.explode(symbols.symbols_udf("content", "rel_path", "file_type")).alias("s"))
        return s.select(F.lit(kb_id).alias("kb_id"), F.col("rel_path").alias("file_path"), "s.kind", "s.name", "s.line", "s.signature").dropDuplicates(["file_path", "kind", "name", "line"])

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        return chunks.select(F.col("id").alias("chunk_id"), "kb_id", "content_hash", self.embed(F.col("content_tokenized"), self.dimension).alias("embedding"))

    def _publish(self, kb_id: str, chunks: DataFrame, vectors: DataFrame, found: DataFrame | None, **base) -> int:
        """Write all tables of a base under a new version and publish it."""
        started, steps = time.time(), 6
        version = time.time_ns()
        before = self.store.base(kb_id) or {}

        def step(k: int, name: str, df: DataFrame | None) -> None:
            if df is not None:
                self.spark.sparkContext.setJobDescription(f"{kb_id}: {name}")
                self.store.write(name, kb_id, version, df)
            if self.progress:
                spent = time.time() - started
                self.progress({"kb_id": kb_id, "phase": name, "done": k, "of": steps, "seconds": spent, "seconds_left": spent / k * (steps - k)})

        try:
            step(1, "chunks", chunks)
            step(2, "vectors", vectors)
            step(3, "postings", lexical.stored_postings(chunks))
            step(4, "formulas", self._formulas(chunks))
            step(5, "edges", maintenance.label_edges(chunks).withColumn("kb_id", F.lit(kb_id)))
            step(6, "symbols", found)
        finally:
            self.spark.sparkContext.setJobDescription(None)
        n = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("f")).first()
        built = ["postings", "formulas", "edges", *(["symbols"] if found is not None else [])]
        row = {"name": kb_id, "source_type": "text", **before, **{k: v for k, v in base.items() if v is not None}, "id": kb_id, "status": "ready", "chunk_count": n["n"], "file_count": n["f"], "embedding_dimension": self.dimension, "embedding_signature": self.signature, "version": version, "built": built, "updated_at": datetime.now(timezone.utc)}
        self.store.publish(row)
        return n["n"]

    def plan(self, root: str, **scan) -> DataFrame:
        """What ``add_directory`` would read, without writing."""
        return files.index_plan(files.scan(self.spark, root, **scan))

    def add_directory(self, kb_id: str, root: str, name: str | None = None, class_name: str | None = None, **scan) -> DataFrame:
        """Index a directory; gives the report of what was left out."""
        found = files.scan(self.spark, root, **scan)
        self.add_documents(kb_id, files.readable(found), name=name, class_name=class_name, source_type="directory", source_path=root)
        return files.skip_report(found)

    def add_documents(self, kb_id: str, docs: DataFrame, **base) -> int:
        chunks = self._rows(kb_id, docs)
        return self._publish(kb_id, chunks, self._vectors(chunks), self._symbols(kb_id, docs), **base)

    def update(self, kb_id: str, docs: DataFrame) -> dict[str, int]:
        """Incremental update: chunks by identity hash, vectors of unchanged chunks reused.  An empty
        source is refused, as it would wipe the base."""
        old = self.store.read("chunks", [kb_id])
        new = self._rows(kb_id, docs)
        change = maintenance.reconcile(old, new, "content_hash").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("retained", "removed", "added")]).first().asDict()
        if change["retained"] + change["added"] == 0:
            raise ValueError("the source has no chunks any more; the base is kept")
        base = self.store.base(kb_id) or {}
        known = self.store.read("vectors", [kb_id]) if base.get("embedding_signature") == self.signature else self.store.read("vectors", [])
        known = known.groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
        keys = new.select(F.col("id").alias("chunk_id"), "kb_id", "content_hash", "content_tokenized").join(known, "content_hash", "left")
        kept = keys.where("embedding is not null").select("chunk_id", "kb_id", "content_hash", F.col("embedding").cast("array<double>").alias("embedding"))
        fresh = self._vectors(keys.where("embedding is null").select(F.col("chunk_id").alias("id"), "kb_id", "content_hash", "content_tokenized"))
        self._publish(kb_id, new, kept.unionByName(fresh), self._symbols(kb_id, docs))
        return change

    def ensure_built(self, kb_ids: list[str] | None = None) -> list[str]:
        """Build the derived tables of bases whose row doesn't name them (made by an older version); gives
        those bases.  A base that fails is passed over with a warning, so that searches go on."""
        done = []
        for r in self.store.bases().where(F.size(F.coalesce("built", F.array().cast("array<string>"))) < 3).collect():
            if kb_ids is not None and r["id"] not in kb_ids:
                continue
            try:
                chunks = cut_lineage(self.store.read("chunks", [r["id"]]))
                self._publish(r["id"], chunks, cut_lineage(self.store.read("vectors", [r["id"]])), None)
                done.append(r["id"])
            except Exception as e:  # noqa: BLE001
                self.warnings.append(f"{r['id']}: {type(e).__name__}")
        return done

    def sync_class(self, class_name: str, root: str, children: list[str], index: Callable[[str, str], None]) -> dict[str, list[str]]:
        """One base per child folder of a class: new children are indexed by ``index(kb_id, path)``; a child
        whose base name another folder has is reported and not indexed; bases without a folder are named."""
        known = {r["name"]: r["source_path"] for r in self.store.bases().where(F.col("class_name") == class_name).collect()}
        report: dict[str, list[str]] = {"created": [], "existing": [], "collided": [], "vanished": []}
        taken: dict[str, str] = dict(known)
        for child in sorted(children):
            name, path = f"{class_name}-{child[:12]}", f"{root.rstrip('/')}/{child}"
            if name in taken:
                report["existing" if taken[name] == path else "collided"].append(child)
                continue
            taken[name] = path
            index(kb_id_of(name), path)
            report["created"].append(child)
        report["vanished"] = sorted(n for n, p in known.items() if p not in {f"{root.rstrip('/')}/{c}" for c in children})
        return report

    # ---- catalogue -----------------------------------------------------------------------

    def status(self) -> DataFrame:
        return self.store.bases().orderBy(F.col("updated_at").desc(), "name")

    def show(self, kb_id: str) -> dict:
        base = self.store.base(kb_id)
        if base is None:
            raise ValueError(f"no base {kb_id}")
        kinds = {r["kind"]: r["count"] for r in self.store.read("symbols", [kb_id]).groupBy("kind").count().collect()}
        return base | {"symbols": kinds}

    def remove(self, kb_id: str) -> bool:
        return self.store.remove(kb_id)

    def clear(self) -> int:
        return self.store.clear()

    def export(self, kb_id: str, path: str, base: dict | None = None) -> int:
        return export_base(base or self.store.base(kb_id), self.store.read("chunks", [kb_id]), path)

    def import_(self, kb_id: str, path: str) -> dict:
        head, rows = import_base(self.spark, path, kb_id)
        rows = cut_lineage(rows)
        docs = rows.groupBy(F.col("file_path").alias("rel_path")).agg(F.first("file_type").alias("file_type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "id", "content"))), lambda x: x["content"]), "\n").alias("content"))
        self._publish(kb_id, rows, self._vectors(rows), self._symbols(kb_id, docs), name=head["name"], description=head.get("description"), source_type=head.get("source_type"))
        return head

    def doctor(self) -> DataFrame:
        """(kb_id, severity, code, action) of every base's issues, and per base its health."""
        b = self.store.bases().withColumnRenamed("id", "kb_id")
        return maintenance.doctor(b, self.store.read("chunks").select("kb_id").distinct(), self.store.read("vectors").select("kb_id").distinct(), self.store.read("symbols").select("kb_id").distinct())

    def symbol_search(self, query: str, kb_ids: list[str] | None = None, kind: str | None = None, exact: bool = False, path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Symbols whose name, path or signature holds the query: exact names, then prefixes, then the rest."""
        scope, _, _ = retrieval.scope(self.store.bases(), kb_ids)
        s = self.store.read("symbols").join(scope.select("kb_id", F.col("name").alias("kb_name")), "kb_id")
        return maintenance.search_symbols(s, query, kind, exact, path, max(1, min(200, limit)), max(0, offset))

    # ---- search --------------------------------------------------------------------------

    def _scope(self, kb_ids: list[str] | None, class_name: str | None) -> DataFrame:
        bases, missing, self.warnings = retrieval.scope(self.store.bases(), kb_ids, class_name)
        if missing:
            raise ValueError("no such base: " + ", ".join(missing))
        bases = cut_lineage(bases)
        if class_name is not None and not bases.limit(1).count():
            raise ValueError(f"no base of class {class_name}")
        return bases

    def _touch(self, ids: list[str]) -> None:
        for k in ids:
            if row := self.store.base(k):
                self.store.put_base(row | {"last_searched_at": datetime.now(timezone.utc)})

    def search(
        self, queries: DataFrame, mode: str = "hybrid", kb_ids: list[str] | None = None, profile: str = "balanced", offset: int = 0, scorer: Callable[[Column, Column], Column] | None = None, limit: int | None = None,
        class_name: str | None = None, file_type: str | None = None, path_pattern: str | None = None, diversity: str = "balanced", expand: int = 0, touch: bool = False,
    ) -> DataFrame:
        """(query_id, place, total_count, chunk_id, kb_id, file_path, start_line, end_line, score, reason,
        coverage, snippet, content, depends_on, before, after) of a batch of queries (query_id, query_text)
        in one plan.  ``warnings`` holds what was left out.  ``deep`` reranks by ``scorer(query, text)``;
        ``adaptive`` gives context windows; ``expand`` adds neighbours to each query's first result."""
        t = tuning.resolve(profile)
        cut = [f"the offset was cut to {MAX_OFFSET}"] if offset > MAX_OFFSET else []
        offset, limit = min(max(0, int(offset)), MAX_OFFSET), limit or t.limit
        k = t.candidates(limit, offset)
        bases = self._scope(kb_ids, class_name)
        ids = [r["kb_id"] for r in bases.select("kb_id").collect()]
        if touch:
            self._touch(ids)
        retrieve = RETRIEVAL.get(mode, mode)
        asked = cut_lineage(queries.select("query_id", F.col("query_text").alias("raw"), science.pre_tokenize_udf(F.col("query_text")).alias("query_text"), query_formulas_udf(F.col("query_text")).alias("formulas")))
        chunks, vectors, qvecs = self.store.read("chunks", ids), None, None
        strangers = [r["name"] for r in self.store.bases().where(F.col("id").isin(ids) & (F.col("embedding_signature") != self.signature)).collect()]
        self.warnings = _unique([*self.warnings, *cut, *(f"{n} was embedded otherwise; its vectors were left out" for n in strangers)])
        if retrieve != "fast":
            vectors = self.store.read("vectors", [i for i in ids if i not in strangers])
            qvecs = retrieval.query_vectors(asked, [self.dimension], self.embed)
        forms = asked.select("query_id", F.explode("formulas").alias("normalized")).distinct()
        edges = self.store.read("edges", ids).where("target is not null")
        evidence = retrieval.Evidence(  # a leg without evidence costs nothing
            asked=forms if forms.limit(1).count() else None, formulas=self.store.read("formulas", ids), edges=edges if edges.limit(1).count() else None,
        )
        rows, depends = retrieval.hybrid_rows(retrieve, chunks, vectors, asked, qvecs, bases, k, t.min_score, evidence, file_type, path_pattern, self.store.read("postings", ids))
        top = cut_lineage(lexical.top_k(rows.withColumn("score", F.round("score", 9)), k, ["query_id"]).drop("rank"))
        total = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_count"))
        texts = chunks.join(top.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("chunk_id"), "content", tx.search_tokens(F.col("content_tokenized")).alias("tokens"))
        rows = top.join(texts, "chunk_id")
        if mode == "deep":
            rows = lexical.top_k(rows, t.rerank, ["query_id"]).drop("rank").join(asked.select("query_id", "raw"), "query_id")
            rows = lexical.top_k(rows.withColumn("score", 1 / (1 + F.exp(-(scorer or rerank.overlap_scorer)(F.col("raw"), F.col("content"))))), max(limit * t.rerank_times, limit), ["query_id"]).drop("rank", "raw")
        elif mode == "adaptive":
            w = retrieval.collapse_windows(retrieval.adaptive_windows(top, chunks, asked, t.context_lines, t.neighbours, t.context_chars))
            w = w.select("query_id", F.col("seed_id").alias("chunk_id"), F.col("content").alias("window"), F.col("start_line").alias("w0"), F.col("end_line").alias("w1"))
            rows = rows.join(w, ["query_id", "chunk_id"]).withColumns({"content": F.col("window"), "start_line": F.col("w0"), "end_line": F.col("w1")}).drop("window", "w0", "w1")
        ranked = lexical.top_k(rows, k, ["query_id"])
        if diversity != "off":
            order = ranking.diversify(ranked, DIVERSITY.get(diversity, 0.76)).select("query_id", "chunk_id", F.col("mmr_rank").alias("pos"))
            ranked = ranked.join(order, ["query_id", "chunk_id"])
            ranked = ranking.interleave(ranked.withColumn("fk", F.concat_ws(":", "kb_id", "file_path")), "query_id", "fk", "pos")
        else:
            ranked = ranked.withColumn("place", F.col("rank"))
        page = ranked.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).withColumn("place", F.col("place") - offset)
        terms = asked.select("query_id", tx.search_tokens(F.col("query_text")).alias("terms"))
        page = page.join(terms, "query_id").join(total, "query_id")
        if depends is None:
            page = page.withColumn("depends_on", F.lit(None).cast("array<struct<label:string,chunk_id:string,pinned:boolean>>"))
        else:
            walked = depends.groupBy("query_id", F.col("trigger").alias("chunk_id")).agg(F.sort_array(F.collect_set(F.struct("label", F.col("target").alias("chunk_id"), "pinned"))).alias("depends_on"))  # at most EDGES entries
            page = page.join(walked, ["query_id", "chunk_id"], "left")
        n = max(0, min(MAX_NEIGHBOURS, int(expand)))
        if n:
            near = maintenance.neighbours(chunks.join(page.select("kb_id", "file_path").distinct(), ["kb_id", "file_path"], "left_semi"), n)
            page = page.join(near.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in ("before", "after")]), "chunk_id", "left")
        first = (F.col("place") == 1) if n else F.lit(False)
        side = lambda c: F.when(first, F.col(f"_{c}")) if n else F.lit(None).cast("string")
        return page.select(
            "query_id", "place", "total_count", "chunk_id", "kb_id", "file_path", "start_line", "end_line", "score", "reason", "coverage", tx.snippet(F.col("content"), F.col("terms"), t.snippet).alias("snippet"), "content", "depends_on", side("before").alias("before"), side("after").alias("after")
        )

    def auto_search(self, query_text: str, **options) -> tuple[str, DataFrame]:
        """One query in the mode that suits it, and in up to two others while the answer is weak."""
        one = self.spark.createDataFrame([(1, query_text)], "query_id long, query_text string")
        r = one.select(tx.auto_mode(F.col("query_text")).alias("m"), tuning.profile(F.col("query_text"), F.lit(None).cast("string")).alias("p")).first()
        options = {"profile": r["p"]} | options
        warnings: list[str] = []
        for mode in [r["m"], *FALLBACKS[r["m"]]][:ATTEMPTS]:
            found = cut_lineage(self.search(one, mode, **options))
            warnings += self.warnings
            rows = found.select("file_path", "content", "coverage").collect()  # one page
            if not self._weak(query_text, rows, r["m"], mode):
                break
        self.warnings = _unique(warnings)
        return mode, found

    @staticmethod
    def _weak(query: str, rows: list, primary: str, mode: str) -> bool:
        """No answer; for an exact lookup also one without the words themselves and with little coverage;
        for a semantic second try one without any."""
        if not rows:
            return True
        if primary == "fast":
            needle = query.strip().strip("\"'`").lower()
            if not any(needle in r["file_path"].lower() or needle in (r["content"] or "").lower() for r in rows) and all((r["coverage"] or 0) < WEAK_COVERAGE for r in rows):
                return True
        return primary != "semantic" and mode == "semantic" and all((r["coverage"] or 0) == 0 for r in rows)

    def inject_context(self, messages: DataFrame, k: int = 3) -> DataFrame:
        """messages (conv_id, turn, role, text) -> the last user message's best chunks per conversation."""
        last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query_text")).withColumnRenamed("conv_id", "query_id")
        return self.search(last, "fast", limit=k).where(F.col("place") <= k)


def kb_id_of(name: str) -> str:
    """A base's id from its name: the same on every run."""
    return hashlib.sha256(name.encode()).hexdigest()[:32]
