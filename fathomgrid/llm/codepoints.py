"""Whole-batch text work on numpy code-point arrays: no Python call per row or per word.

A batch of texts becomes one uint32 array of code points plus row offsets.  Character classes and
lower case are lookup-table gathers, and words are hashed from one prefix sum: with an odd base B,
the sum over a word of v(c)·B^i is a difference of two prefix sums, moved to origin by B^-start
(all modulo 2^64).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Table height: the planes in which letters and digits have case or width variants.
PLANES = 0x30000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.zeros(PLANES, dtype=bool)
    lower = np.arange(PLANES, dtype=np.uint32)
    for c in range(PLANES):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if c < 128:
            word[c] = ch.isalnum()
        else:
            word[c] = unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd")
        low = ch.lower()
        if low != ch:
            lower[c] = ord(low[0])
    code = splitmix(np.arange(PLANES, dtype=np.uint64) + np.uint64(77))
    return word, lower, code[lower]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def explode(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and the n+1 row offsets; null counts as empty."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=offsets[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cp, offsets


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = _Powers()


def words(cp: np.ndarray, offsets: np.ndarray, drop: np.ndarray | None = None, extra: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word (longest run of letters or digits, lower case) of every row.

    Returns (hash, row, start, end); start and end are positions in ``cp``.  ``drop`` masks
    positions that count as if they weren't there as word characters (inline markup); ``extra`` are
    code points that count as letters.
    """
    isword, _, code = _tables()
    low = np.minimum(cp, PLANES - 1)
    w = isword[low]
    if drop is not None:
        w &= ~drop
    for c in extra:
        w |= cp == c
    n = len(cp)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, z
    edge = np.empty(n, dtype=bool)  # a word can't go on over a row's end
    edge[0] = True
    edge[1:] = False
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(w & (np.concatenate(([True], ~w[:-1])) | edge))
    last = np.concatenate((edge[1:], [True]))
    ends = np.flatnonzero(w & (np.concatenate((~w[1:], [True])) | last)) + 1
    up, down = _POWERS.get(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(code[low] * up[:n], out=prefix[1:])
    h = splitmix((prefix[ends] - prefix[starts]) * down[starts])
    row = np.searchsorted(offsets, starts, side="right") - 1
    return h, row, starts, ends


def shingles(h: np.ndarray, row: np.ndarray, n: int, positions: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of n consecutive words in a row, and the index of its first word.

    ``positions`` are the word offsets that count (a spaced seed); all by default.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    acc = np.zeros(m, dtype=np.uint64)
    for j in positions if positions is not None else range(n):
        acc += h[j : j + m] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    return splitmix(acc[first]), first


def from_arrow(column) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts of an Arrow string column on end, their code points and the n+1 row offsets.

    One decode for the whole column: row offsets in code points are counts of UTF-8 lead bytes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return "", np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    text = raw.tobytes().decode("utf-8", "replace")
    lead = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    offsets = lead[off - off[0]]
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return text, cp, offsets
