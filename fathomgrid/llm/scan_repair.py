"""Problem 5: noise in text from scanned pages (symmetric-delete index over a corpus lexicon).

The lexicon counts every word of every distinct text (copies of a scanned text would make its
misread words common).  Each word gives keys: its folded form with one letter deleted in every way,
and its confusion skeleton; all much commoner words of a key are candidates for it.  Candidates are
weighed by an edit distance in which confusions of shapes (rn/m, cl/d, e/c, l/1, ...) are cheap, and
the counts of neighbouring word pairs choose among several; one edit that is no known confusion is
repaired only if a pair supports it.  Around this stand the repairs of layout: page numbers and running headers
between the lines go, words broken at line ends are joined (unless the corpus knows them with the
hyphen), and the lines of a paragraph become one.

A text holds scan noise if it has such a page line, a broken word, or enough different misread
words: ``LEAST`` where lines are broken by hand or signs stand inside words, ``ALONE`` in any other
text, as a rare word that is like a common one may be a name.  Defined results: null and empty texts hold no noise and stay as they are; repeated
rows each get their own result; texts without noise stay byte for byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import bit_filter, map_texts, may_hold
from fathomgrid.session import cut_lineage

# Shapes that scanners take for each other, (read, meant), either way.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("i", "l"), ("l", "i"), ("@", "a"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("|", "l"),
]
_SET = set(CONFUSIONS)
_FOLD = [(a, b) for a, b in CONFUSIONS if len(a) == 2]
_ONE = str.maketrans({"0": "o", "1": "l", "i": "l", "@": "a", "c": "e", "f": "t", "q": "g", "5": "s", "8": "b", "6": "b", "9": "g", "|": "l"})
#: Cost of a confusion and of another edit; the largest total without support by context, and with it; how much commoner a candidate must be.
CHEAP, DEAR, MOST, SUPPORTED, RATIO = 0.3, 1.0, 0.95, 1.0, 10
#: Different misread words that make a text noisy by themselves: in texts of scanned form, in others.
LEAST, ALONE = 2, 3

_NUMBER = r"(?:[-–—] ?\d{1,4} ?[-–—]|\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4} \||\| \d{1,4}|\d{1,4} ?/ ?\d{1,4}|(?:[Pp]age|[Pp]\.|[Ss]eite|S\.|[Pp]ágina|pág\.) ?\d{1,4}(?: (?:of|de|von|sur|/) \d{1,4})?|\d{1,4})"
_HEAD = r"(?:(?:Chapter|Chapitre|Kapitel|Capítulo|Section|Part)\.? \d{1,3}[.:]? [^\n]{1,80}|Proc\. [^\n]{1,60}|Vol\. [^\n]{1,60}|[^\W\d_][^\n.,;:!?]{0,40} (?:Handbook|Journal|Proceedings|Handbuch|Manuel|Manual) (?:of|de|der|du|des) [^\n.,;:!?]{1,40}|[^\n.,;:!?]{1,60} {1,3}[·•|] {1,3}[^\n.,;:!?]{1,60}|[^\Wa-zß-ÿ\d_][^a-zß-ÿ\n.,;:!?]{6,80})"
_PAGE_LINE = re.compile(rf"^[ \t]*(?:{_NUMBER}|\d{{1,4}} {{2,}}{_HEAD}|{_HEAD} {{2,}}\d{{1,4}})[ \t]*$")
_HEAD_LINE = re.compile(rf"^[ \t]*{_HEAD}[ \t]*$")
#: A running header that needs no page number beside it: its whole line has the form of a title.
_LONE = re.compile(r"^[ \t]*(?:(?:Chapter|Chapitre|Kapitel|Capítulo|Section|Part)\.? \d{1,3}[.:] [^\W\d_][^\n.,;:!?]{1,80}|(?:Proc|Vol)\. [^\n]{0,60}[\d)]|(?P<title>[^\W\d_][^\n.,;:!?]{0,40} (?:Handbook|Journal|Proceedings|Handbuch|Manuel|Manual) (?:of|de|der|du|des) [^\n.,;:!?]{1,40})|(?P<dot>[^\n.,;:!?]{1,60} {1,3}[·•|] {1,3}[^\n.,;:!?]{1,60})|(?P<caps>[^\W\d_][^\W_]*(?:[ \-]+[^\W_]+)+))[ \t]*$")
_BREAK = re.compile(r"([^\W\d_]+)[-­‐]\n[ \t]*([^\W\d_]+)")
_HYPHEN = re.compile(r"[^\W\d_][-­‐]$")
_SOFT_END = re.compile(r"[.!?:;。！？][\"”»')\]]*$")
_TOKEN = re.compile(r"[^\W_@]+(?:@[^\W_]*)*|@[^\W_]+")
_ODD = re.compile(r"[^\W\d_][01@|][^\W\d_]")


def is_lone_header(line: str) -> bool:
    """Whether a line is a running header by its form alone, without a page number in its block."""
    m = _LONE.match(line)
    if not m:
        return False
    if m["title"]:
        return all(w[:1].isupper() or len(w) < 4 for w in line.split())
    return line.isupper() if m["caps"] else True


def page_lines(lines: list[str], lone: bool = True) -> set[int]:
    """Numbers of the lines that are page numbers or running headers between a text's lines.

    A block with a page number counts if it interrupts running text: the text before it doesn't end,
    or the text after it goes on in lower case.  Headers without a number count (with ``lone``) if
    the text before them doesn't end and the text after them goes on in lower case.
    """
    found: set[int] = set()
    flat = [k for k, x in enumerate(lines) if x.strip()]
    if len(flat) < 3:
        return found
    is_num = {k: bool(_PAGE_LINE.match(lines[k])) for k in flat}
    is_head = {k: not is_num[k] and bool(_HEAD_LINE.match(lines[k])) for k in flat}
    at = 0
    while at < len(flat):
        if not (is_num[flat[at]] or is_head[flat[at]]):
            at += 1
            continue
        end = at
        while end < len(flat) and (is_num[flat[end]] or is_head[flat[end]]) and end - at < 4:
            end += 1
        block = flat[at:end]
        before, after = (lines[flat[at - 1]].rstrip() if at else ""), (lines[flat[end]].lstrip() if end < len(flat) else "")
        numbered = any(is_num[k] for k in block)
        goes_on = bool(before) and bool(after) and (after[:1].islower() or not _SOFT_END.search(before))
        at_edge = numbered and len(block) > 1 and (not before or not after)
        if numbered and (goes_on or at_edge or (len(block) > 1)):
            found.update(block)
        at = end
    at = 1
    while lone and at < len(flat) - 1:
        end = at
        while end < len(flat) and flat[end] not in found and not is_num[flat[end]] and is_lone_header(lines[flat[end]]):
            end += 1
        if at < end < len(flat):
            before, after = lines[flat[at - 1]].rstrip(), lines[flat[end]].lstrip()
            table = any("|" in lines[k] for k in flat[at:end]) and "|" in before + after
            if after[:1].islower() and not _SOFT_END.search(before) and not table:
                found.update(flat[at:end])
        at = end + 1
    return found


def is_wrapped(lines: list[str]) -> bool:
    """Whether a text's lines are broken by hand: lines in a row that end inside a sentence."""
    n = sum(1 for a, b in zip(lines, lines[1:]) if len(a) >= 20 and b.strip() and not _SOFT_END.search(a.rstrip()) and a.lstrip()[:1] not in "#|<{}*-+>$\\" and not a.rstrip().endswith((",", "{", "}", ")")))
    return n >= 2


def layout(text: str) -> tuple[str, int, list[tuple[str, str]], bool]:
    """(text without page lines and with broken words joined, page lines, broken words, wrapped)."""
    lines = text.split("\n")
    wrapped = is_wrapped(lines)
    drop = page_lines(lines, lone=wrapped)
    if drop:
        out: list[str] = []
        skip = False
        for k, x in enumerate(lines):
            if k in drop:
                skip = True
                while out and not out[-1].strip():
                    out.pop()
                continue
            if skip and not x.strip():
                continue
            if skip and not wrapped and out and x.lstrip()[:1].islower() and not _HYPHEN.search(out[-1]):
                out[-1] = f"{out[-1].rstrip()} {x.lstrip()}"  # wrapped texts are joined as a whole
            else:
                out.append(x)
            skip = False
        text = "\n".join(out)
    breaks = [(m[1], m[2]) for m in _BREAK.finditer(text) if m[2][:1].islower()]
    return text, len(drop), breaks, wrapped


def _hash(words: list[str]) -> np.ndarray:
    """Hash of single words, the same as the vectorised one of the words' characters."""
    cp, off = cpx.explode([w.lower() for w in words])
    if not len(cp):
        return np.zeros(0, dtype=np.uint64)
    _, _, code = cpx._tables()
    up, _ = cpx._POWERS.get(int(np.diff(off).max()) + 1)
    pos = np.arange(len(cp)) - np.repeat(off[:-1], np.diff(off))
    total = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum(code[np.minimum(cp, cpx.PLANES - 1)] * up[pos], out=total[1:])
    return cpx.splitmix(total[off[1:]] - total[off[:-1]])


def lexicon(texts: DataFrame) -> DataFrame:
    """(h, word, n): every word of at least three characters with a letter, and words joined by a
    hyphen, over all texts.  Slices count their words first, so the shuffle carries each word once
    per slice and not once per occurrence."""

    def fn(batch: pa.RecordBatch) -> pa.Table | None:
        text, cp, off = cpx.from_arrow(batch.column("text"))
        h, _, s, e = cpx.words(cp, off, extra=(64,))
        if not len(h):
            return None
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        length = (e - s)[first]
        pick = np.flatnonzero((length >= 3) & (length <= 40))
        words = [text[a:b].lower() for a, b in zip(s[first[pick]].tolist(), e[first[pick]].tolist())]
        keep = [k for k, w in enumerate(words) if not w.isdigit()]
        hs, ws, ns = u[pick][keep], [words[k] for k in keep], n[pick][keep]
        joined: dict[str, int] = {}
        for m in re.finditer(r"[^\W\d_]+-[^\W\d_]+", text):
            w = m.group().lower()
            joined[w] = joined.get(w, 0) + 1
        if joined:
            hs = np.concatenate([hs, _hash(list(joined))])
            ws, ns = ws + list(joined), np.concatenate([ns, list(joined.values())])
        return pa.table({"h": pa.array(hs.view(np.int64)), "word": pa.array(ws), "n": pa.array(ns.astype(np.int64))})

    part = map_texts(texts, "text", fn, "h long, word string, n long")
    return part.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def fold(word: str) -> str:
    for a, b in _FOLD:
        word = word.replace(a, b)
    return word


def keys_of(word: str) -> list[str]:
    """The symmetric-delete keys of a word: its folded form with one letter left out, and its skeleton."""
    f = fold(word)
    deletes = {f[:k] + f[k + 1 :] for k in range(len(f))} if len(f) >= 4 else set()
    return [*deletes, "=" + f.translate(_ONE)]


def distance(read: str, meant: str) -> float:
    """Weighted edit distance from the read form to the meant one; over SUPPORTED it is cut short."""
    while read and meant and read[0] == meant[0] and len(read) > 2 and len(meant) > 2 and read[:2] == meant[:2]:
        read, meant = read[1:], meant[1:]
    while len(read) > 2 and len(meant) > 2 and read[-2:] == meant[-2:]:
        read, meant = read[:-1], meant[:-1]
    n, m = len(read), len(meant)
    d = [[9.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = d[i][j]
            if c > SUPPORTED:
                continue
            if i < n and j < m:
                step = 0.0 if read[i] == meant[j] else CHEAP if (read[i], meant[j]) in _SET else DEAR
                d[i + 1][j + 1] = min(d[i + 1][j + 1], c + step)
                if i + 1 < n and (read[i : i + 2], meant[j]) in _SET:
                    d[i + 2][j + 1] = min(d[i + 2][j + 1], c + CHEAP)
                if j + 1 < m and (read[i], meant[j : j + 2]) in _SET:
                    d[i + 1][j + 2] = min(d[i + 1][j + 2], c + CHEAP)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], c + DEAR)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], c + DEAR)
    return d[n][m]


def corrections(lex: DataFrame) -> DataFrame:
    """(h, word, fixes): the candidates of every misread word, best first, each (cost, minus count, fix)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            ks = [keys_of(w) for w in words]
            size = np.fromiter(map(len, ks), dtype=np.int64, count=len(ks))
            rep = pa.array(np.repeat(np.arange(len(ks)), size))
            yield pa.RecordBatch.from_arrays([pa.array([k for x in ks for k in x], pa.string()), batch.column("h").take(rep), batch.column("word").take(rep), pa.array(np.repeat(n, size))], names=["key", "h", "word", "n"])

    plain = lex.where(~F.col("word").contains("-"))
    keyed = plain.mapInArrow(keys, "key string, h long, word string, n long").withColumn("key", F.xxhash64("key"))
    strong = keyed.where(F.col("n") >= RATIO).select("key", F.col("word").alias("fix"), F.col("n").alias("fix_n"))
    cand = keyed.join(strong, "key").where((F.col("fix_n") >= RATIO * F.col("n")) & (F.col("fix") != F.col("word"))).select("h", "word", "fix", "fix_n").distinct()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = np.array([distance(a, b) for a, b in zip(batch.column("word").to_pylist(), batch.column("fix").to_pylist())], dtype=np.float64)
            ok = pa.array(cost <= SUPPORTED)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(ok) for c in ("h", "word", "fix", "fix_n")), pa.array(cost).filter(ok)], names=["h", "word", "fix", "fix_n", "cost"])

    weighed = cand.mapInArrow(weigh, "h long, word string, fix string, fix_n long, cost double")
    return weighed.groupBy("h", "word").agg(F.sort_array(F.collect_list(F.struct("cost", (-F.col("fix_n")).alias("less"), "fix"))).alias("fixes"))


_SUSPECTS = "doc string, kind int, at int, h long, page_lines int, scanned boolean"


def suspects(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """What speaks for scan noise: rows of kind 0 (a page line count), 1 and 2 (a broken word joined
    and with its hyphen, by number), 3 (a different word that may have a correction, with its first place)."""
    shared = texts.sparkSession.sparkContext.broadcast(bit_filter(fixes, "h"))

    def fn(batch: pa.RecordBatch) -> pa.Table | None:
        may = lambda x: may_hold(shared.value, x)
        text, cp, off = cpx.from_arrow(batch.column("text"))
        h, row, _, _ = cpx.words(cp, off, extra=(64,))
        nth = np.arange(len(h)) - np.searchsorted(row, row)
        hit = np.flatnonzero(may(h))
        ends = np.searchsorted(row[hit], np.arange(batch.num_rows + 1))
        rows: list[tuple] = []
        for i, doc in enumerate(batch.column("doc").to_pylist()):
            t = text[off[i] : off[i + 1]]
            found = hit[ends[i] : ends[i + 1]]
            if "\n" not in t and len(found) < LEAST:
                continue
            flat, pages, breaks, wrapped = layout(t) if "\n" in t else (t, 0, [], False)
            scanned = bool(wrapped or pages or breaks or _ODD.search(t))
            if pages:
                rows.append((doc, 0, 0, 0, pages, scanned))
            words: list[str] = []
            for a, b in breaks:
                words += [a + b, f"{a}-{b}"]
            for k, x in enumerate(_hash(words).view(np.int64).tolist() if words else []):
                rows.append((doc, 1 + k % 2, k // 2, x, 0, scanned))
            if pages or breaks:  # the words of the text without page lines and with broken words joined
                _, fcp, foff = cpx.from_arrow(pa.array([_BREAK.sub(r"\1\2", flat)], pa.string()))
                x = cpx.words(fcp, foff, extra=(64,))[0]
                place = np.flatnonzero(may(x))
                x = x[place]
            else:
                x, place = h[found], nth[found]
            u, first = np.unique(x, return_index=True)
            rows += [(doc, 3, k, z, 0, scanned) for z, k in zip(u.view(np.int64).tolist(), place[first].tolist())]
        if not rows:
            return None
        c = list(zip(*rows))
        return pa.table([pa.array(v, t) for v, t in zip(c, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))], names=["doc", "kind", "at", "h", "page_lines", "scanned"])

    return map_texts(texts, "text", fn, _SUSPECTS)


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").cast("string").alias("doc"), F.col("content").alias("text")).where(F.length("content") > 0)


def scan_evidence(chunks: DataFrame, least: int = LEAST, alone: int = ALONE) -> tuple[DataFrame, DataFrame]:
    """(evidence per noisy text, repairs per text and word): evidence is (doc, page_lines, broken,
    misread), repairs (doc, word, fixes)."""
    texts = _texts(chunks)
    lex = cut_lineage(lexicon(texts.select("text").distinct()))
    fixes = cut_lineage(corrections(lex))
    found = cut_lineage(suspects(texts, fixes))
    words = found.where("kind = 3").join(fixes, "h").select("doc", "word", "fixes", "scanned")
    known = found.where("kind in (1, 2)").join(lex.select("h", "n"), "h", "left").groupBy("doc", "at").agg(
        F.max(F.when(F.col("kind") == 1, F.coalesce("n", F.lit(0)))).alias("joined"), F.max(F.when(F.col("kind") == 2, F.coalesce("n", F.lit(0)))).alias("hyphened")
    )
    broken = known.where((F.col("joined") >= F.col("hyphened"))).groupBy("doc").agg(F.count(F.lit(1)).alias("broken"))
    pages = found.where("kind = 0").groupBy("doc").agg(F.max("page_lines").alias("page_lines"))
    sure = words.where(F.col("fixes")[0]["cost"] <= MOST)
    misread = sure.groupBy("doc").agg(F.count(F.lit(1)).alias("misread"), F.max("scanned").alias("scanned"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    every = pages.join(broken, "doc", "full").join(misread, "doc", "full").select("doc", zero("page_lines"), zero("broken"), zero("misread"), F.when(F.col("scanned"), least).otherwise(alone).alias("enough"))
    return every.where((F.col("page_lines") > 0) | (F.col("broken") > 0) | (F.col("misread") >= F.col("enough"))).drop("enough"), words.drop("scanned")


def noisy_chunks(chunks: DataFrame, **options) -> DataFrame:
    return scan_evidence(chunks, **options)[0].select(F.col("doc").alias("chunk_id"), "page_lines", "broken", "misread")


def _recase(word: str, fix: str) -> str:
    if word.isupper() and len(word) > 1:
        return fix.upper()
    return fix[:1].upper() + fix[1:] if word[:1].isupper() else fix


def repaired_text(text: str, fixes: dict[str, str], hyphened: set[str] = frozenset()) -> str:
    """One noisy text as continuous paragraphs: ``fixes`` by lower-case word, ``hyphened`` the broken
    words that keep their hyphen."""
    flat, _, breaks, wrapped = layout(text)
    if wrapped or breaks:
        flat = _BREAK.sub(lambda m: f"{m[1]}-{m[2]}" if f"{m[1]}-{m[2]}".lower() in hyphened or not m[2][:1].islower() else m[1] + m[2], flat)
    if wrapped:
        flat = "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", flat))
    return _TOKEN.sub(lambda m: _recase(m.group(), fixes[m.group().lower()]) if m.group().lower() in fixes else m.group(), flat)


def _context(texts: DataFrame, open_words: DataFrame) -> DataFrame:
    """(doc, word, by_context): the candidate whose neighbouring pairs are commonest, if any occurs.

    Pairs are counted over all texts, each slice first by itself; only pairs that a candidate needs
    are carried on."""

    def pairs_of(batch: pa.RecordBatch) -> pa.Table | None:
        _, cp, off = cpx.from_arrow(batch.column("text"))
        h, row, _, _ = cpx.words(cp, off, extra=(64,))
        x, _ = cpx.shingles(h, row, 2)
        if not len(x):
            return None
        u, n = np.unique(x, return_counts=True)
        return pa.table({"pair": pa.array(u.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    def needs(batch: pa.RecordBatch) -> pa.Table | None:
        docs, fix, pair, word = [], [], [], []
        for doc, text, w, fs in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "word", "fixes"))):
            flat = _BREAK.sub(r"\1\2", layout(text)[0])
            tokens = [t.lower() for t in _TOKEN.findall(flat)]
            for k, t in enumerate(tokens):
                if t != w:
                    continue
                for f in fs:
                    for two in ([tokens[k - 1], f["fix"]] if k else None, [f["fix"], tokens[k + 1]] if k + 1 < len(tokens) else None):
                        if two:
                            x, _ = cpx.shingles(_hash(two), np.zeros(2, dtype=np.int64), 2)
                            docs.append(doc)
                            word.append(w)
                            fix.append(f["fix"])
                            pair.append(int(x.view(np.int64)[0]))
        return pa.table({"doc": pa.array(docs, pa.string()), "word": pa.array(word, pa.string()), "fix": pa.array(fix, pa.string()), "pair": pa.array(pair, pa.int64())}) if docs else None

    need = cut_lineage(map_texts(texts.join(open_words, "doc"), "text", needs, "doc string, word string, fix string, pair long"))
    counts = map_texts(texts, "text", pairs_of, "pair long, n long").join(need.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n"))
    support = need.join(counts, "pair", "left").groupBy("doc", "word", "fix").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return support.groupBy("doc", "word").agg(F.max(F.struct("n", "fix")).alias("b")).where("b.n > 0").select("doc", "word", F.col("b.fix").alias("by_context"))


def repair_chunks(chunks: DataFrame, **options) -> DataFrame:
    """(chunk_id, content, page_lines, broken, misread) of every noisy text, repaired."""
    texts = _texts(chunks)
    evidence, words = scan_evidence(chunks, **options)
    evidence = cut_lineage(evidence)
    words = cut_lineage(words.join(evidence.select("doc"), "doc", "left_semi"))
    best = F.col("fixes")[0]
    chosen = words.join(_context(texts, words.where((F.size("fixes") > 1) | (best["cost"] > MOST))), ["doc", "word"], "left")
    fix = F.coalesce("by_context", F.when(best["cost"] <= MOST, best["fix"]))
    fixes = chosen.select("doc", "word", fix.alias("fix")).where("fix is not null").groupBy("doc").agg(F.map_from_entries(F.collect_set(F.struct("word", "fix"))).alias("fixes"))
    noisy = texts.join(evidence, "doc").join(fixes, "doc", "left")

    def fn(batch: pa.RecordBatch) -> pa.Table:
        out = [repaired_text(t, dict(f or [])) for t, f in zip(batch.column("text").to_pylist(), batch.column("fixes").to_pylist())]
        return pa.table({"chunk_id": batch.column("doc"), "content": pa.array(out, pa.string()), **{c: batch.column(c) for c in ("page_lines", "broken", "misread")}})

    return map_texts(noisy.select("doc", "text", "fixes", "page_lines", "broken", "misread"), "text", fn, "chunk_id string, content string, page_lines long, broken long, misread long")
