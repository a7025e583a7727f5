"""The stored knowledge base: versioned Parquet tables by base, JSON-lines export and import, schema migration.

Every table is partitioned by base and version.  An index run writes all tables of a base under a
new version and then publishes it by replacing the base's one-row file, which is a rename: readers
see all tables of the old version or all of the new one.  Old versions go after the next publish.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2
_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CHUNKS = _schema(id=_S, kb_id=_S, content_hash=_S, content=_S, content_tokenized=_S, file_path=_S, file_type=_S, start_line=_I, end_line=_I, metadata_json=_S, indexed_at=T.TimestampType())
SCHEMAS = {
    "chunks": CHUNKS,
    "vectors": _schema(chunk_id=_S, kb_id=_S, content_hash=_S, embedding=T.ArrayType(T.DoubleType())),
    "postings": _schema(kb_id=_S, chunk_id=_S, dl=_I, term=_S, places=T.ArrayType(_I)),
    "formulas": _schema(id=_S, kb_id=_S, chunk_id=_S, ordinal=_I, raw=_S, normalized=_S, content_tokenized=_S, token_count=_I),
    "symbols": _schema(kb_id=_S, file_path=_S, kind=_S, name=_S, line=_I, signature=_S),
    "edges": _schema(kb_id=_S, chunk_id=_S, label=_S, target=_S, pinned=T.BooleanType()),
}
BASE = _schema(
    id=_S, name=_S, description=_S, source_path=_S, source_type=_S, class_name=_S, status=_S, chunk_count=_L, file_count=_L, embedding_dimension=_I, embedding_signature=_S, version=_L, built=T.ArrayType(_S), updated_at=T.TimestampType(), last_searched_at=T.TimestampType()
)
TABLES = list(SCHEMAS)


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A stored table in today's schema: missing columns null, types cast, unknown columns kept."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in schema.fieldNames()])


class Store:
    """Tables under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # ---- bases: one small JSON file each -------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return bool(fs.exists(p))

    def bases(self) -> DataFrame:
        """All bases; a small table."""
        folder = self.path("bases")
        return self.spark.read.schema(BASE).json(f"{folder}/*.json") if self.exists(folder) and self._names() else self.spark.createDataFrame([], BASE)

    def _names(self) -> list[str]:
        p, fs = self._fs(self.path("bases"))
        return [n[: -len(".json")] for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and not n.startswith(".")] if fs.exists(p) else []

    def base(self, kb_id: str) -> dict | None:
        return next((r.asDict() for r in self.bases().where(F.col("id") == kb_id).collect()), None)

    def put_base(self, row: dict) -> None:
        """Replace a base's file; the rename publishes it at once."""
        jvm = self.spark._jvm
        tmp, fs = self._fs(f"{self.path('bases')}/.{row['id']}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.items() if v is not None}, ensure_ascii=False).encode()))
        out.close()
        to = jvm.org.apache.hadoop.fs.Path(f"{self.path('bases')}/{row['id']}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(to), options)

    # ---- tables ----------------------------------------------------------------------------

    def read(self, table: str, kb_ids: list[str] | None = None) -> DataFrame:
        """The published rows of a table; only the partitions of the bases asked for are listed and read."""
        current = [(r["id"], r["version"]) for r in self.bases().select("id", "version").collect() if kb_ids is None or r["id"] in kb_ids]
        parts = [p for k, v in current if v is not None and self.exists(p := f"{self.path(table)}/kb_id={k}/version={v}")]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[table])
        stored = T.StructType([f for f in SCHEMAS[table] if f.name != "kb_id"])
        raw = self.spark.read.schema(T.StructType([*stored, T.StructField("kb_id", _S), T.StructField("version", _L)])).option("basePath", self.path(table)).parquet(*parts)  # no footer is read for a schema
        return migrate(raw.drop("version"), SCHEMAS[table])

    def write(self, table: str, kb_id: str, version: int, df: DataFrame) -> None:
        """A table's rows of one base and version.  Vectors of different lengths are refused."""
        if table == "vectors":
            sizes = [r["n"] for r in df.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
            if len(sizes) > 1:
                raise ValueError(f"vectors of {sizes[0]} and {sizes[1]} numbers in one base")
        migrate(df, SCHEMAS[table]).drop("kb_id").write.mode("overwrite").parquet(f"{self.path(table)}/kb_id={kb_id}/version={version}")

    def publish(self, row: dict) -> None:
        """Make a version the one that is read, and drop the base's other versions."""
        self.put_base(row)
        for table in TABLES:
            p, fs = self._fs(f"{self.path(table)}/kb_id={row['id']}")
            if fs.exists(p):
                for s in fs.listStatus(p):
                    if s.getPath().getName() != f"version={row['version']}":
                        fs.delete(s.getPath(), True)

    def remove(self, kb_id: str) -> bool:
        """A base with all its tables: its file goes first, so no reader sees half of it."""
        p, fs = self._fs(f"{self.path('bases')}/{kb_id}.json")
        there = bool(fs.delete(p, False))
        for table in TABLES:
            q, fs = self._fs(f"{self.path(table)}/kb_id={kb_id}")
            fs.delete(q, True)
        return there

    def clear(self) -> int:
        names = self._names()
        for n in names:
            self.remove(n)
        return len(names)


_EXPORTED = ["content", "file_path", "file_type", "start_line", "end_line", "metadata_json"]


def export_rows(base: dict, chunks: DataFrame) -> DataFrame:
    """(value): chunk rows as JSON lines."""
    return chunks.select(F.to_json(F.struct(*_EXPORTED), {"ignoreNullFields": "false"}).alias("value"))


def export_base(base: dict, chunks: DataFrame, path: str) -> int:
    """JSON lines under ``path``: a header file and the chunk rows; gives the number of rows."""
    n = chunks.count()
    header = json.dumps({"name": base["name"], "description": base.get("description"), "source_type": base.get("source_type"), "chunk_count": n})
    chunks.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    export_rows(base, chunks).write.mode("overwrite").text(f"{path}/chunks")
    return n


def import_base(spark: SparkSession, path: str, kb_id: str) -> tuple[dict, DataFrame]:
    """The header and the chunk rows of an export, hashed and tokenised anew.  Raises if there are
    fewer rows than the header says."""
    from fathomgrid.functions.metadata import embedding_text
    from fathomgrid.functions.science import pre_tokenize_udf

    head = json.loads(spark.read.text(f"{path}/header").first()["value"])
    schema = T.StructType([f for f in CHUNKS if f.name in _EXPORTED])
    rows = spark.read.schema(schema).json(f"{path}/chunks").where("content is not null")
    n = rows.count()
    if n < head["chunk_count"]:
        raise ValueError(f"the export names {head['chunk_count']} chunks and holds {n}")
    hashed = F.sha2("content", 256)
    ident = F.sha2(F.concat_ws("\u0000", F.lit(kb_id), "file_path", F.col("start_line").cast("string"), hashed), 256)
    out = rows.withColumn("kb_id", F.lit(kb_id)).withColumn("content_hash", hashed).withColumn("id", ident).withColumn("content_tokenized", pre_tokenize_udf(embedding_text())).withColumn("indexed_at", F.current_timestamp())
    return head, migrate(out, CHUNKS)
