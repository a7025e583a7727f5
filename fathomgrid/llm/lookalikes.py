"""Problem 6: visually identical text with different characters, brought to one form.

A batch's Arrow text becomes one code-point array.  Lookup tables give each code point its class
and its replacement (none, one or several code points); replacements are gathered with expansion
offsets, accents are composed by searching (letter, mark) pairs, and look-alike letters are mapped
word by word from counts per word.  No string call is made per row.

What is mapped: full-width, half-width and styled Latin letters, digits and signs; ligatures, Roman
numeral and unit signs, letter-like signs with an ordinary letter of the same look; spaces other
than U+0020; invisible characters; separate accents that compose; letters of another script inside
Latin words (or alone in a formula).  What stays: text wholly in its own script with its own
punctuation (full-width punctuation next to CJK), Greek symbols, composed accents, superscripts,
fractions, typographic quotes and dashes, joiners inside scripts and emoji that need them.

Defined results: a null text stays null and is no case; an empty text is no case; repeated rows
each get their own result; the mapping is idempotent.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm import codepoints as cpx
from fathomgrid.llm.batches import map_texts

# Letters of other scripts that look like Latin letters.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈҺԌ", "aeopcyxisjhdqwABEKMHOPCTYXISJHG"))
GREEK = dict(zip("οινυρκχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oivupkxyABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("ոսօհցքԱՕՍ", "nuohgpUOU"))
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN
#: Greek letters that are taken for Latin ones only in words that are mostly Latin: they are symbols too.
SYMBOLIC = set("ινυρκχγΑΒΕΖΗΙΚΜΝΡΤΥΧ")
#: Invisible characters.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0x3164, 0xFEFF, 0xFFA0]

# Classes of code points.
PLAIN, MAPPED, WIDE_PUNCT, HIDDEN, MARK, OTHER, LATIN, CJK, JOINING = range(9)


def _styled(c: int) -> str | None:
    """The ordinary form of a styled, wide, joined or letter-like sign; None if it has none here."""
    ch = chr(c)
    if c in (0x212A, 0x212B, 0x2126, 0x00B5):
        return unicodedata.normalize("NFKC", ch)
    d = unicodedata.decomposition(ch)
    if not d.startswith("<") or 0x3130 <= c <= 0x318F or 0xFB50 <= c <= 0xFDFF or 0xFE70 <= c <= 0xFEFE or 0x370 <= c <= 0x3FF:
        return None
    tag = d[1 : d.index(">")]
    to = unicodedata.normalize("NFKC", ch)
    plain = all(ord(x) < 0x250 for x in to) and any(x.isalnum() for x in to)
    if tag in ("wide", "narrow"):
        return to if 0xFF01 <= c <= 0xFF5E or plain else None
    if tag == "font":
        return to
    if tag in ("square", "circle"):
        return to if all(ord(x) < 0x400 for x in to) else None
    if tag == "compat":  # ligatures, Roman numerals, degree units; not dots, accents or abbreviations
        return to if (0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F or c in (0x2103, 0x2109, 0x17F, 0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC)) else None
    return None


@functools.cache
def _tables() -> dict:
    size = cpx.PLANES
    kind = np.zeros(size, dtype=np.uint8)
    length = np.ones(size, dtype=np.int64)
    one = np.arange(size, dtype=np.uint32)
    long: dict[int, str] = {}
    pairs: dict[int, int] = {}
    for c in range(0x80, size):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0x20000 <= c:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cn":
            continue
        if unicodedata.combining(ch):
            kind[c] = MARK
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = c
        if cat == "Zs":
            kind[c], one[c] = MAPPED, 0x20
            continue
        to = _styled(c)
        if to is not None and to != ch:
            kind[c] = WIDE_PUNCT if 0xFF01 <= c <= 0xFF5E and not to.isalnum() else MAPPED
            one[c], length[c] = ord(to[0]), len(to)
            if len(to) > 1:
                long[c] = to
        elif cat[0] == "L" and unicodedata.name(ch, "").startswith("LATIN"):
            kind[c] = LATIN
        elif cat[0] == "L" and cat != "Lm" and not 0x3040 <= c:
            kind[c] = OTHER
    for c in range(128):
        if chr(c).isalpha():
            kind[c] = LATIN
    kind[0x2E80:0xA000] = np.where(kind[0x2E80:0xA000] == MAPPED, MAPPED, CJK)
    kind[0xAC00:0xD7A4] = CJK
    kind[0x20000:] = CJK
    kind[0x600:0x1000] = np.where(kind[0x600:0x1000] == MARK, MARK, JOINING)
    kind[0x1780:0x17B4] = JOINING
    kind[0x1F000:0x1FB00] = np.where(kind[0x1F000:0x1FB00] == MAPPED, MAPPED, JOINING)
    kind[0x2600:0x27C0] = JOINING
    for c in INVISIBLE:
        kind[c], length[c] = HIDDEN, 0
    look = np.arange(size, dtype=np.uint32)
    weight = np.zeros(size, dtype=np.int8)  # 1: a look-alike, 2: one that is a symbol too
    for a, b in LOOKALIKE.items():
        look[ord(a)], weight[ord(a)] = ord(b), 2 if a in SYMBOLIC else 1
    keys = np.array(sorted(pairs), dtype=np.int64)
    starts, flat = np.zeros(size, dtype=np.int64), []
    for c, to in long.items():
        starts[c] = len(flat)
        flat += map(ord, to)
    ccc = np.array([unicodedata.combining(chr(c)) if kind[c] == MARK else 0 for c in range(0x3100)], dtype=np.uint8)
    return {
        "kind": kind, "length": length, "one": one, "starts": starts, "flat": np.array(flat, dtype=np.uint32), "look": look, "weight": weight,
        "keys": keys, "composed": np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32), "ccc": ccc,
        "odd": np.isin(kind, (MAPPED, WIDE_PUNCT, HIDDEN, MARK)) | (weight > 0),
    }


def _offsets_after(keep_len: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(keep_len) + 1, dtype=np.int64)
    np.cumsum(keep_len, out=total[1:])
    return total[offsets]


def _ordered(cp: np.ndarray, offsets: np.ndarray, t: dict) -> np.ndarray:
    """The code points with the marks of every run in canonical order: sorted by class, ties as they stand."""
    ccc = t["ccc"]
    c = np.where(cp < len(ccc), ccc[np.minimum(cp, len(ccc) - 1)], 0)
    again = np.flatnonzero((c[1:] < c[:-1]) & (c[1:] > 0)) + 1
    if not len(again):
        return cp
    run = np.cumsum(c == 0)  # a base and its marks
    head = np.zeros(len(cp) + 1, dtype=np.int64)
    head[offsets] = 1
    run = run + np.cumsum(head[:-1])  # never over a row's start
    inside = np.isin(run, run[again])
    at = np.flatnonzero(inside)
    out = cp.copy()
    out[at] = cp[at[np.lexsort((at, c[at], run[at]))]]
    return out


def _compose(cp: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compose letters with the marks after them; returns the rows (by original offsets) that changed.

    Marks are put in order first.  A round composes each letter with one mark: the first of its run
    that has a composed form with it and isn't kept off by a mark of its own class.  Each round
    takes at least one mark away, so the rounds end."""
    changed = np.zeros(len(offsets) - 1, dtype=bool)
    cp = _ordered(cp, offsets, t)
    ccc = t["ccc"]
    while len(cp) > 1:
        n = len(cp)
        mark = t["kind"][np.minimum(cp, cpx.PLANES - 1)] == MARK
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        mark &= ~edge[:-1]  # a mark at a row's start has no letter
        at = np.flatnonzero(mark)
        if not len(at):
            break
        base = np.maximum.accumulate(np.where(mark, -1, np.arange(n)))[at]
        ok = base >= 0
        at, base = at[ok], base[ok]
        key = cp[base].astype(np.int64) << 21 | cp[at].astype(np.int64)
        pos = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        c = ccc[np.minimum(cp[at], len(ccc) - 1)]
        before = ccc[np.minimum(cp[at - 1], len(ccc) - 1)]
        free = (at - 1 == base) | ((before < c) & (before > 0))
        hit = np.flatnonzero((t["keys"][pos] == key) & free)
        if not len(hit):
            break
        _, first = np.unique(base[hit], return_index=True)
        hit = hit[first]
        cp = cp.copy()
        cp[base[hit]] = t["composed"][pos[hit]]
        keep = np.ones(n, dtype=bool)
        keep[at[hit]] = False
        changed[np.searchsorted(offsets, at[hit], side="right") - 1] = True
        offsets = _offsets_after(keep.astype(np.int64), offsets)
        cp = cp[keep]
    return cp, offsets, changed


def canonical(cp: np.ndarray, offsets: np.ndarray, formula: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one form of every row: (code points, row offsets, rows that held a case)."""
    t = _tables()
    n = len(cp)
    changed = np.zeros(len(offsets) - 1, dtype=bool)
    low = np.minimum(cp, cpx.PLANES - 1)
    if not n or not t["odd"][low].any():
        return cp, offsets, changed
    kind = t["kind"][low]
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    # Full-width punctuation is CJK text's own if a neighbour is CJK.
    wide = np.flatnonzero(kind == WIDE_PUNCT)
    if len(wide):
        before, after = kind[np.maximum(wide - 1, 0)], kind[np.minimum(wide + 1, n - 1)]
        own = (before == CJK) | (after == CJK)
        own |= _row_is_cjk(kind, offsets)[row_of(wide)] & ~np.isin(before, (LATIN, MAPPED)) & ~np.isin(after, (LATIN, MAPPED))
        kind[wide] = np.where(own, PLAIN, MAPPED)
    # Joiners stay inside scripts and emoji that need them.
    hidden = np.flatnonzero(kind == HIDDEN)
    if len(hidden):
        needed = np.isin(low[hidden], (0x200C, 0x200D)) & (kind[np.maximum(hidden - 1, 0)] == JOINING)
        kind[hidden[needed]] = PLAIN
    act = (kind == MAPPED) | (kind == HIDDEN)
    at = np.flatnonzero(act)
    changed[row_of(at)] = True
    length = np.where(act, t["length"][low], 1)
    out = np.where(act, t["one"][low], cp)
    if len(at):
        new_off = _offsets_after(length, offsets)
        if (length != 1).any():
            src = np.repeat(np.arange(n), length)
            first = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(length, out=first[1:])
            nth = np.arange(len(src)) - first[src]
            wide_src = length[src] > 1
            res = out[src]
            res[wide_src] = t["flat"][t["starts"][low[src[wide_src]]] + nth[wide_src]]
            out = res
        offsets2 = new_off
    else:
        offsets2 = offsets
    if formula:  # a formula's tokens stand apart: so may a letter and its accent
        k2 = t["kind"][np.minimum(out, cpx.PLANES - 1)]
        gap = np.flatnonzero((out[1:-1] == 0x20) & (k2[2:] == MARK) & (k2[:-2] == LATIN)) + 1
        if len(gap):
            inside = np.ones(len(out) + 1, dtype=bool)
            inside[offsets2] = False
            gap = gap[inside[gap] & inside[gap + 1]]
            keep = np.ones(len(out), dtype=bool)
            keep[gap] = False
            out, offsets2 = out[keep], _offsets_after(keep.astype(np.int64), offsets2)
    out, offsets2, composed = _compose(out, offsets2, t)
    changed |= composed
    out, mixed = _latinise(out, offsets2, t, formula)
    return out, offsets2, changed | mixed


def _row_is_cjk(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    return per_row(kind == CJK) > per_row(kind == LATIN)


def _latinise(cp: np.ndarray, offsets: np.ndarray, t: dict, formula: bool) -> tuple[np.ndarray, np.ndarray]:
    """Look-alike letters to Latin ones, judged by the letters of the word and of the row."""
    changed = np.zeros(len(offsets) - 1, dtype=bool)
    low = np.minimum(cp, cpx.PLANES - 1)
    weight = t["weight"][low]
    if not weight.any():
        return cp, changed
    kind = t["kind"][low]
    letter = (kind == LATIN) | (kind == OTHER) | (kind == MARK)
    begin = letter & np.concatenate(([True], ~letter[:-1]))
    first = offsets[:-1]
    first = first[first < len(cp)]
    begin[first] |= letter[first]
    starts = np.flatnonzero(begin)
    word = np.cumsum(begin) - 1
    inside = np.flatnonzero(letter)
    w = word[inside]
    count = lambda mask: np.bincount(w[mask[inside]], minlength=len(starts))
    other, look, symbolic, latin = count(kind == OTHER), count(weight > 0), count(weight == 2), count(kind == LATIN)
    row = np.searchsorted(offsets, starts, side="right") - 1
    all_alike = (other > 0) & (other == look)  # every letter of another script has a Latin look-alike
    firm = look - symbolic
    mixed = all_alike & (latin > 0) & ((firm > 0) | (latin >= 2 * look))
    # A word wholly of look-alikes counts where its row has no letter that only the other script has,
    # and Latin words around it; in a formula a single one counts.
    native = np.bincount(row, weights=other - look, minlength=len(changed))[row]
    around = np.bincount(row, weights=latin, minlength=len(changed))[row]
    whole = all_alike & (latin == 0) & (firm == look) & (native == 0)
    whole &= (around > 0) if not formula else True
    if not formula:
        whole &= around >= 3 * look
    turn = np.zeros(len(cp), dtype=bool)
    turn[inside] = (mixed | whole)[w] & (weight[inside] > 0)
    if not turn.any():
        return cp, changed
    changed[row[mixed | whole]] = True
    return np.where(turn, t["look"][low], cp), changed


def to_arrow(cp: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of code points as an Arrow string column, by one encode and counted byte offsets."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    total = np.zeros(len(cp) + 1, dtype=np.int64)
    np.cumsum(width, out=total[1:])
    arr = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(total[offsets].tobytes()), pa.py_buffer(raw)).cast(pa.string())
    if valid is not None and not valid.all():
        import pyarrow.compute as pc

        arr = pc.if_else(pa.array(valid), arr, pa.scalar(None, pa.string()))
    return arr


def canonical_form(df: DataFrame, key: str, text: str, formula: bool = False, emit_text: bool = True) -> DataFrame:
    """(``key``, canonical, is_case) of every row; without ``emit_text`` only the keys of the cases."""
    schema = f"{key} string, canonical string, is_case boolean" if emit_text else f"{key} string"

    def fn(batch: pa.RecordBatch) -> pa.Table:
        _, cp, off = cpx.from_arrow(batch.column("_t"))
        out, off2, case = canonical(cp, off, formula)
        if not emit_text:
            return pa.table({key: batch.column("_k").filter(pa.array(case))})
        valid = ~np.asarray(batch.column("_t").is_null())
        return pa.table({key: batch.column("_k"), "canonical": to_arrow(out, off2, valid), "is_case": pa.array(case)})

    rows = df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t"))
    if not emit_text:
        rows = rows.where(F.col("_t").rlike(r"[^\x00-\x7f]"))  # a case holds a character beyond ASCII
    return map_texts(rows, "_t", fn, schema)


def lookalike_records(chunks: DataFrame, formulas: DataFrame) -> DataFrame:
    """(record_kind, record_id) of every chunk content and normalised formula that is a case."""
    c = canonical_form(chunks, "id", "content", emit_text=False).select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"))
    f = canonical_form(formulas, "id", "normalized", formula=True, emit_text=False).select(F.lit("formula").alias("record_kind"), F.col("id").alias("record_id"))
    return c.unionByName(f).distinct()


def canonical_records(chunks: DataFrame, formulas: DataFrame) -> DataFrame:
    """(record_kind, record_id, canonical, is_case) of every chunk content and normalised formula; repeated rows count once."""
    kind = lambda name, df: df.select(F.lit(name).alias("record_kind"), F.col("id").alias("record_id"), "canonical", "is_case")
    f = canonical_form(formulas.select("id", "normalized").distinct(), "id", "normalized", formula=True)
    return kind("chunk", canonical_form(chunks, "id", "content")).unionByName(kind("formula", f))
