"""Extraction of text from document files and pages: DOCX, PDF through a converter, HTML, URLs."""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL_TIMEOUT, URL_BYTES = 60, 100 * 1024 * 1024
URL_TYPES = re.compile(r"text/|application/xhtml\+xml|application/json", re.I)


def docx_text(data: bytes) -> str | None:
    """Paragraph text of a DOCX file; null if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = []
    for p in root.iter(f"{ns}p"):
        paragraphs.append("".join(t.text or "" if t.tag == f"{ns}t" else "\t" if t.tag == f"{ns}tab" else "\n" for t in p.iter() if t.tag in (f"{ns}t", f"{ns}tab", f"{ns}br")))
    return "\n\n".join(x for x in paragraphs if x.strip())


def run_command(command: list[str], data: bytes, suffix: str, timeout: int, read: Callable[[Path, bytes], str | None]) -> tuple[str | None, str | None]:
    """(text, failure) of an outside program that takes a file: ``{input}`` and ``{output_dir}`` in its
    arguments are filled in.  Failures are classed: missing, timeout, exit <code>, no output.  The
    file stands in the task's own scratch folder and is gone when the call ends."""
    with tempfile.TemporaryDirectory() as d:
        source = Path(d, f"in{suffix}")
        source.write_bytes(data)
        out = Path(d, "out")
        out.mkdir()
        try:
            done = subprocess.run([a.format(input=source, output_dir=out) for a in command], timeout=timeout, capture_output=True)
        except subprocess.TimeoutExpired:
            return None, "timeout"
        except OSError:
            return None, "missing"
        if done.returncode:
            return None, f"exit {done.returncode}"
        text = read(out, done.stdout)
        return (text, None) if text and text.strip() else (None, "no output")


def _converted(out: Path, _: bytes) -> str | None:
    found = sorted([*out.rglob("*.md"), *out.rglob("*.txt")])
    return found[0].read_text("utf-8", "replace") if found else None


def _text_layer(data: bytes) -> str | None:
    try:
        import pypdf  # type: ignore[import-not-found]
    except ImportError:
        return None
    try:
        return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)
    except Exception:  # noqa: BLE001  a broken file is a null, not a failed job
        return None


def pdf_text(data: bytes, command: list[str] | None = None, timeout: int = 120) -> tuple[str | None, str | None]:
    """(text, failure) of a PDF: the converter's result, else the text layer with its tables coupled, as
    far as a library for it is installed."""
    from fathomgrid.functions.chunkers import couple_table_rows

    text, failure = run_command(command, data, ".pdf", timeout, _converted) if command else (None, "no converter")
    if text is not None:
        return text, None
    layer = _text_layer(data)
    return (couple_table_rows(layer), None) if layer else (None, failure)


def extract(files: DataFrame, pdf_command: list[str] | None = None, cache: DataFrame | None = None, timeout: int = 120) -> DataFrame:
    """(rel_path, content_hash, text, failure) of scanned DOCX and PDF files.  Files whose hash is in
    ``cache`` (content_hash, text) aren't converted again; the new rows with a text are what to add to it."""
    docs = files.where(F.lower("rel_path").rlike(r"\.(?:docx|pdf)$") & (F.col("reason").isNull())).select("rel_path", "content", F.sha2("content", 256).alias("content_hash"))
    todo = docs.join(cache.select("content_hash"), "content_hash", "left_anti") if cache is not None else docs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for path, content in zip(f["rel_path"], f["content"]):
                if path.lower().endswith("docx"):
                    text = docx_text(bytes(content))
                    got.append((text, None if text is not None else "no document"))
                else:
                    got.append(pdf_text(bytes(content), pdf_command, timeout))
            yield pd.DataFrame({"rel_path": f["rel_path"], "content_hash": f["content_hash"], "text": [t for t, _ in got], "failure": [e for _, e in got]})

    schema = "rel_path string, content_hash string, text string, failure string"
    done = todo.select("rel_path", "content_hash", "content").mapInPandas(run, schema)
    if cache is None:
        return done
    held = docs.select("rel_path", "content_hash").join(cache.select("content_hash", "text").dropDuplicates(["content_hash"]), "content_hash")
    return done.unionByName(held.select("rel_path", "content_hash", "text", F.lit(None).cast("string").alias("failure")))


def ocr_captions(images: DataFrame, command: list[str], timeout: int = 60) -> DataFrame:
    """(path, caption, failure) of images (path, content) by a program that writes the text it reads to
    its standard output; ``{input}`` is the image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [run_command(command, bytes(c), Path(p).suffix, timeout, lambda _, printed: printed.decode("utf-8", "replace").strip()) for p, c in zip(f["path"], f["content"])]
            yield pd.DataFrame({"path": f["path"], "caption": [t for t, _ in got], "failure": [e for _, e in got]})

    return images.select("path", "content").mapInPandas(run, "path string, caption string, failure string")


def image_references(text_col: str = "text"):
    """Image targets of a converted document."""
    return F.regexp_extract_all(text_col, F.lit(r"!\[[^\]]*\]\(([^()\s]+)\)"), 1)


def _download(url: str) -> tuple[str | None, bytes]:
    import urllib.request

    with urllib.request.urlopen(url, timeout=URL_TIMEOUT) as r:  # noqa: S310
        return r.headers.get("Content-Type"), r.read(URL_BYTES + 1)


def fetch(urls: DataFrame, column: str = "url", download: Callable[[str], tuple[str | None, bytes]] = _download) -> DataFrame:
    """(url, body, error): pages of allowed types up to the size cap; failures are rows, not failed jobs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for url in f[column]:
                try:
                    kind, data = download(url)
                    if not URL_TYPES.match(kind or ""):
                        rows.append((url, None, f"type {kind}"))
                    elif len(data) > URL_BYTES:
                        rows.append((url, None, "oversized"))
                    else:
                        rows.append((url, data.decode("utf-8", "replace"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "body", "error"])

    return urls.select(column).mapInPandas(run, "url string, body string, error string")
