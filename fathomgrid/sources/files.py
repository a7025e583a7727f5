"""File sources: scanning with ignore rules, size cap, binary test and skip accounting; index plans."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomgrid.functions import text as tx

MAX_FILE_SIZE = 100 * 1024 * 1024
# What a scan leaves out by itself (build results, caches, secrets, reports), and extensions that aren't text.
DEFAULT_IGNORED = [
    "node_modules", ".git", "dist", "build", "bin", "obj", "out", "target", "coverage", ".next", ".cache", ".playwright", ".browser", ".browsers", "__pycache__", "*.app", "*.asar", "*.asar.unpacked", "*.pak", ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx",
    "*.crt", "*.cert", "*secret*", "*secrets*", "*credential*", "*credentials*", "docs/*eval-report*.md", "docs/*evaluation-report*.md", "docs/*knowledge-base*report*.md", "*knowledge-base-evaluation-report*.md", "*knowledge*.jsonl", "*.min.js", "*.min.css", "*.map",
    "*.lock", "package-lock.json", "playwright-report", "test-results", "browser-cache", "ms-playwright", ".DS_Store", "Thumbs.db", "*.pyc", "*.class",
]
#: Most characters of an ignore file.
IGNORE_CHARS = 1 << 20
BINARY_EXTENSIONS = (
    "7z a avi bin bmp bz2 dat db dll dylib eot exe gif gz ico jpg jpeg lib lock mov mp3 mp4 node o otf png ppt rar so sqlite svg tar ttf wasm wav webm webp woff woff2 xls xlsx zip"
).split()


def glob_regex(pattern: str) -> str:
    """One ignore pattern as a regular expression over relative paths."""
    body = pattern.strip("/")
    core = re.sub(r"\\Z$|\\z$|\$$", "", fnmatch.translate(body)).removeprefix("(?s:").removesuffix(")").replace(".*", "[^/]*")
    core = core.replace("(?>", "(?:")
    anchor = "^" if pattern.startswith("/") or "/" in body else "(?:^|/)"
    return f"{anchor}{core}(?:/|$)" if pattern.endswith("/") else f"{anchor}{core}(?:/.*)?$"


def ignore_pattern(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns take a path out; the last pattern that matches decides (``!`` keeps)."""
    out = F.lit(False)
    for p in patterns:
        keep = p.startswith("!")
        out = F.when(path.rlike(glob_regex(p[1:] if keep else p)), F.lit(not keep)).otherwise(out)
    return out


def path_decision(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Path prefixes override the rules; exclusion beats inclusion."""
    under = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: (path == p) | F.startswith(path, F.concat(p, F.lit("/")))) if ps else F.lit(False)
    return F.when(under(exclude), "excluded").when(under(include), "included").otherwise("default")


def classify_source(source: Column, on_disk: Column) -> Column:
    """url, directory, file or text of a source; ``missing`` for what looks like a path that isn't there.
    ``on_disk`` says what stands at the source's place: directory, file or null."""
    t = F.trim(source)
    pathlike = ~t.rlike(r"[\r\n]") & ~t.rlike("^(?:https?:)?//") & (F.substring(t, 1, 1).isin(".", "/", "~") | t.contains("/") | t.contains("\\") | t.rlike(r"\.[A-Za-z0-9][A-Za-z0-9_-]{0,15}$"))
    url = source.startswith("http://") | source.startswith("https://")
    return F.when(source.isNull() | (t == ""), "text").when(url, "url").when(on_disk.isin("directory", "file"), on_disk).when(pathlike, "missing").otherwise("text")


def gitignore(spark: SparkSession, root: str, inherited: str | None = None) -> list[str]:
    """The patterns of the root's ignore file and of an inherited one, after the defaults."""
    out = list(DEFAULT_IGNORED)
    for path in [f"{root.rstrip('/')}/.gitignore", *([inherited] if inherited else [])]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).getLen() > IGNORE_CHARS:
            raise ValueError(f"{path} is too large for an ignore file")
        stream = fs.open(p)  # a file source passes over names that begin with a dot
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        stream.close()
        out += [x for line in lines if (x := line.strip()) and not x.startswith("#")]
    return out


def skip_reason(path: Column, length: Column, content: Column | None, patterns: list[str], include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_FILE_SIZE) -> Column:
    """Why a file is left out; null for a file that is read.  Without ``content`` a file isn't judged by it."""
    decision = path_decision(path, include or [], exclude or [])
    binary = F.coalesce(tx.extension(path).isin(*BINARY_EXTENSIONS), F.lit(False))
    if content is not None:
        binary = binary | F.coalesce(F.contains(F.substring(content, 1, 512), F.lit(b"\x00")), F.lit(False))
    document = F.coalesce(tx.extension(path).isin(*tx.DOCUMENT_EXTENSIONS), F.lit(False))
    ignored = (decision == "excluded") | ((decision != "included") & ignore_pattern(path, patterns))
    return F.when(ignored, "suggested_excluded").when(length > max_bytes, "oversized").when(binary & ~document, "binary")


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_FILE_SIZE, inherited: str | None = None) -> DataFrame:
    """(path, rel_path, length, modified, content, reason): every file under ``root``; ``reason`` is null
    for files that are read.

    Sizes are judged first: files over the cap come from a listing that reads no contents, the others
    from a scan into which the size filter is pushed, so no oversized file is ever opened.  Files and
    folders whose name begins with a dot or an underscore are hidden to file sources: never listed or read."""
    rules = patterns if patterns is not None else gitignore(spark, root, inherited)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), "^" + re.escape(os.path.abspath(base.removeprefix("file://"))) + "/?", "")
    cols = ["path", rel.alias("rel_path"), "length", F.col("modificationTime").alias("modified")]
    small = raw.where(F.col("length") <= max_bytes).select(*cols, "content")
    large = raw.where(F.col("length") > max_bytes).select(*cols).withColumn("content", F.lit(None).cast("binary"))
    why = lambda df, content: df.withColumn("reason", skip_reason(F.col("rel_path"), F.col("length"), content, rules, include, exclude, max_bytes))
    return why(small, F.col("content")).unionByName(why(large, None))


def readable(scanned: DataFrame) -> DataFrame:
    """(rel_path, file_type, content) of the files that are read as text."""
    return scanned.where("reason is null").select("rel_path", tx.file_type(F.col("rel_path")).alias("file_type"), F.decode("content", "UTF-8").alias("content"), "modified")


def skip_report(scanned: DataFrame, samples: int = 25, path: str = "rel_path", by: list[str] = ()) -> DataFrame:
    """(reason, n, samples): how many files were left out and why, with the first few paths.

    Counts combine before the shuffle; samples are a group limit, so no path list grows."""
    skipped = scanned.where("reason is not null").select(*by, "reason", F.col(path).alias("p"))
    keys = [*by, "reason"]
    first = skipped.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("p"))).where(F.col("_n") <= samples).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("samples"))
    return skipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(first, keys)


def index_plan(scanned: DataFrame, by: list[str] = ()) -> DataFrame:
    """What an index run would read, without writing anything.  Only paths and sizes are asked for, so
    no content is read unless a file's kind must be judged by it (``scan`` of small files)."""
    ok = F.col("reason").isNull()
    return scanned.groupBy(*by).agg(F.count_if(ok).alias("files"), F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).alias("bytes"), F.count_if(~ok).alias("skipped"))
