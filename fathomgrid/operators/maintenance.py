"""Incremental maintenance: reconciling by hash, snapshots, latest-wins logs, label resolution, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(stored: DataFrame, scanned: DataFrame, hash_col: str) -> DataFrame:
    """(hash, occurrence, state): stored and scanned rows matched one for one by hash.

    Duplicates are numbered within their hash on either side; a full join of the numbered rows
    gives retained, removed and added.  A hash that a third of the rows share is numbered in one
    window task, so the numbering runs on counts: one row per hash and side."""
    count = lambda df, name: df.groupBy(F.col(hash_col).alias("hash")).agg(F.count(F.lit(1)).alias(name))
    j = count(stored, "a").join(count(scanned, "b"), "hash", "full").select("hash", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return j.select("hash", F.least("a", "b").alias("retained"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("removed"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, change) of two path snapshots: added, changed or removed."""
    a = before.select(F.col(key).alias("path"), F.col(stamp).alias("s0"))
    b = after.select(F.col(key).alias("path"), F.col(stamp).alias("s1"))
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when(F.col("s0") != F.col("s1"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a struct of ordering values: an aggregate with map-side combine,
    so a hot key costs no more than any other."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("m"))
    return agg.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def resolve_labels(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (scope, chunk_id, path, label) and definitions (scope, path, label, target) ->
    references with ``target``: the same file's definition, else that of a unique other file, else null."""
    first = definitions.groupBy("scope", "label", F.col("path").alias("def_path")).agg(F.min("target").alias("target"))
    j = references.join(first, ["scope", "label"], "left")
    same = F.max(F.when(F.col("def_path") == F.col("path"), F.col("target")))
    files = F.count_distinct(F.when(F.col("def_path") != F.col("path"), F.col("def_path")))
    other = F.max(F.when(F.col("def_path") != F.col("path"), F.col("target")))
    return j.groupBy("scope", "chunk_id", "path", "label").agg(F.coalesce(same, F.when(files == 1, other)).alias("target"))


def debounce(events: DataFrame, key: str, ts: str, quiet_seconds: float) -> DataFrame:
    """(key, burst, first, last, events): a burst ends after ``quiet_seconds`` without an event.

    Events of one interval of that length are always of one burst, so intervals are aggregated first
    (map-side) and the window runs over intervals: a hot key costs its intervals, not its events."""
    quiet = int(quiet_seconds * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cells = events.where(F.col(ts).isNotNull()).groupBy(key, F.floor(at / quiet).alias("_cell")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))
    w = Window.partitionBy(key).orderBy("_cell")
    gap = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.lag("last").over(w).cast("timestamp"))
    d = cells.withColumn("_new", F.when(gap.isNull() | (gap >= quiet), 1).otherwise(0))
    d = d.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "burst").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))


def number_within(df: DataFrame, key: str, order: str, to: str = "occurrence") -> DataFrame:
    """Numbers a key's rows in order, from 1.  Rows are range-partitioned by (key, order), counted per
    part and numbered within it, so a key that a third of the rows share is spread over tasks."""
    from fathomgrid.session import cut_lineage

    parts = cut_lineage(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = parts.withColumn("_w", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)))
    same = within[key].eqNullSafe(offset[key]) & (within["_part"] == offset["_part"])
    return within.join(offset, same).select(*[within[c] for c in df.columns], (F.col("_before") + F.col("_w")).cast("int").alias(to))


def replace_per_key(stored: DataFrame, fresh: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The stored rows with those of ``keys`` replaced by the fresh ones."""
    kept = stored.join(keys.select(key).distinct(), key, "left_anti").select(*stored.columns)
    return kept.unionByName(fresh.join(keys.select(key).distinct(), key, "left_semi").select(*stored.columns))


def label_edges(chunks: DataFrame) -> DataFrame:
    """(chunk_id, label, target, pinned): references of the texts to labels, resolved within their base.

    A label is defined where ``\\label`` stands; the first definition of a file counts."""
    c = chunks.where(F.col("content").contains("\\")).select(F.col("id").alias("chunk_id"), F.col("kb_id").alias("scope"), F.col("file_path").alias("path"), "content")
    defined = c.select("scope", "path", F.col("chunk_id").alias("target"), F.explode(F.regexp_extract_all("content", F.lit(r"\\label\{([^{}]+)\}"), 1)).alias("label"))
    used = c.select("scope", "path", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\\(?:eq|page|c|C|auto)?ref\{([^{}]+)\}"), 1))).alias("label"))
    return resolve_labels(used, defined).select("chunk_id", "label", "target", F.lit(True).alias("pinned"))


def neighbours(chunks: DataFrame, n: int = 1) -> DataFrame:
    """(chunk_id, before, after): ids of the n chunks before and after in the same file."""
    w = Window.partitionBy("kb_id", "file_path").orderBy("start_line", "end_line", "id")
    join = lambda c: F.array_join(c, ",")
    return chunks.select(F.col("id").alias("chunk_id"), join(F.collect_list("id").over(w.rowsBetween(-n, -1))).alias("before"), join(F.collect_list("id").over(w.rowsBetween(1, n))).alias("after"))


def context_windows(seeds: DataFrame, chunks: DataFrame, margin: int = 20) -> DataFrame:
    """(seed_id, chunk_id): chunks of the seed's file whose lines overlap the seed's lines widened by ``margin``."""
    s = seeds.select(F.col("id").alias("seed_id"), "kb_id", "file_path", (F.col("start_line") - margin).alias("lo"), (F.col("end_line") + margin).alias("hi"))
    c = chunks.select(F.col("id").alias("chunk_id"), "kb_id", "file_path", "start_line", "end_line")
    return s.join(c, ["kb_id", "file_path"]).where("end_line >= lo and start_line <= hi").select("seed_id", "chunk_id", "start_line", "end_line")


# What an issue takes from a base's health.
PENALTY = {"blocking": 35, "warning": 12, "info": 2}
STUCK_SECONDS, LOW_COVERAGE = 600, 80


def doctor(bases: DataFrame, with_chunks: DataFrame, with_vectors: DataFrame, with_symbols: DataFrame, jobs: DataFrame | None = None, covered: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(kb_id, severity, code, action, health): a row per issue of a base; a base without issues has one
    row with a null code.  ``jobs`` (kb_id, progress_at) of running jobs and ``covered`` (kb_id, percent)
    add the rules on stuck indexing and coverage."""
    now = F.current_timestamp() if now is None else now
    b = bases.select("kb_id", "status", F.coalesce("chunk_count", F.lit(0)).alias("n"), F.col("updated_at").alias("at"))
    flag = lambda df, name: df.select("kb_id").distinct().withColumn(name, F.lit(True))
    j = b.join(flag(with_chunks, "c"), "kb_id", "left").join(flag(with_vectors, "v"), "kb_id", "left").join(flag(with_symbols, "s"), "kb_id", "left")
    j = j.join(jobs.groupBy("kb_id").agg(F.max("progress_at").alias("progress_at")), "kb_id", "left") if jobs is not None else j.withColumn("progress_at", F.lit(None).cast("timestamp"))
    j = j.join(covered.select("kb_id", "percent"), "kb_id", "left") if covered is not None else j.withColumn("percent", F.lit(None).cast("long"))
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("progress_at", "at"))) / 1e6
    issue = lambda when, severity, code, action: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(action).alias("action")))
    rules = F.array_compact(
        F.array(
            issue((F.col("status") == "indexing") & (age > STUCK_SECONDS), "blocking", "stuck_indexing", "wait_for_indexing"),
            issue(F.col("status") == "error", "blocking", "error_state", "rebuild_kb"),
            issue((F.col("n") > 0) & F.col("v").isNull(), "blocking", "vectors_missing", "rebuild_kb"),
            issue(F.col("percent") < LOW_COVERAGE, "warning", "coverage", "review_skipped_scope"),
            issue((F.col("status") == "ready") & (F.col("n") > 0) & F.col("s").isNull(), "info", "no_symbols", "run_update"),
        )
    )
    worth = F.create_map(*[x for k, v in PENALTY.items() for x in (F.lit(k), F.lit(v))])
    h = j.select("kb_id", rules.alias("r")).withColumn("health", F.greatest(F.lit(0), 100 - F.aggregate("r", F.lit(0), lambda acc, x: acc + worth[x["severity"]])))
    return h.select("kb_id", "health", F.explode_outer("r").alias("i")).select("kb_id", "i.severity", "i.code", "i.action", "health")


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, exact: bool = False, path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The symbols a query names, with their ``place``: equal names first, then prefixes, then the rest;
    then by path and line.  The order is a top-k of ``offset + limit`` rows, numbered afterwards."""
    q = query.lower()
    low = F.lower("name")
    s = symbols.where(low == q) if exact else symbols.where(low.contains(q) | F.lower("file_path").contains(q) | F.lower(F.coalesce("signature", F.lit(""))).contains(q))
    s = s.where(F.col("kind") == kind) if kind else s
    s = s.where(F.lower("file_path").contains(path.lower())) if path else s
    tier = F.when(low == q, 0).when(low.startswith(q), 1).otherwise(2)
    order = ["tier", F.col("file_path").asc_nulls_first(), "line", "kind", "name"]
    top = s.withColumn("tier", tier).orderBy(*order).limit(offset + limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def file_contents(chunks: DataFrame) -> DataFrame:
    """(kb_id, file_path, first_line, last_line, content, n_chars): a file's chunks joined in order."""
    c = chunks.where("file_path is not null and start_line is not null").groupBy("kb_id", "file_path")
    parts = F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", "content")))  # one file's text
    return c.agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"), F.sum(F.length("content")).alias("n_chars"))


def class_children(children: DataFrame, bases: DataFrame, class_name: str) -> DataFrame:
    """(name, child, state) of a class's child folders and bases: discovered, known, collided or vanished."""
    n = children.select("child", F.concat(F.lit(f"{class_name}-"), F.substring("child", 1, 12)).alias("name"))
    n = n.join(n.groupBy("name").agg(F.count(F.lit(1)).alias("children")), "name")
    j = n.join(bases.select("name").distinct().withColumn("known", F.lit(True)), "name", "full")
    state = F.when(F.col("child").isNull(), "vanished").when(F.col("children") > 1, "collided").when(F.col("known").isNull(), "discovered").otherwise("known")
    return j.select("name", "child", state.alias("state"))
