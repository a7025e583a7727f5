"""Arrays for scoring many rows against many queries in a task: sparse sums, and the k best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def expand(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``keys``, index into what ``starts`` counts): every key with all entries it has."""
    many = starts[keys + 1] - starts[keys]
    of = np.repeat(np.arange(len(keys)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many - starts[keys], many)


def sums(key: np.ndarray, weight: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sum, count) of the keys that occur, in order; the way there depends on how full the cells are."""
    if len(key) * 8 >= cells:
        count = np.bincount(key, minlength=cells)
        at = np.flatnonzero(count)
        return at, np.bincount(key, weight, cells)[at], count[at]
    at, place = np.unique(key, return_inverse=True)
    return at, np.bincount(place, weight, len(at)), np.bincount(place, minlength=len(at))


class Best:
    """The k best rows of each query so far; of equal scores the earlier row."""

    def __init__(self, k: int, queries: int, names: list[str]) -> None:
        self.k, self.names, self.held, self.n = k, names, [], 0
        self.score = np.full((queries, k), -np.inf)
        self.exact: np.ndarray | None = None
        self.row = np.full((queries, k), -1, dtype=np.int64)
        self.strict = np.zeros(queries, dtype=bool)

    def add(self, rows: pa.RecordBatch) -> int:
        """Keeps the names of rows; the number of the first one."""
        self.held.append(rows.select(self.names))
        self.n += rows.num_rows
        return self.n - rows.num_rows

    def update(self, dense: np.ndarray, lo: int, hi: int, first: int, strict: np.ndarray | None = None, exact: np.ndarray | None = None) -> None:
        """Scores (query, row) of the queries from lo to hi for the rows from ``first``; -inf: none.  Queries that
        became ``strict`` lose the rows from before.  ``exact``: the scores before rounding, kept along."""
        if strict is not None:
            new = np.flatnonzero(strict & ~self.strict[lo:hi])
            self.score[lo + new] = -np.inf
            self.strict[lo:hi] = strict
        some = lo + np.flatnonzero(dense.max(axis=1, initial=-np.inf) > self.score[lo:hi].min(axis=1))
        if not len(some):
            return
        c = np.concatenate((self.score[some], dense[some - lo]), axis=1)
        kth = np.partition(c, c.shape[1] - self.k, axis=1)[:, c.shape[1] - self.k, None]
        take, equal = c > kth, c == kth
        need = self.k - take.sum(axis=1)
        many = np.flatnonzero(equal.sum(axis=1) > need)
        equal[many] &= np.cumsum(equal[many], axis=1) <= need[many, None]
        at = np.nonzero(take | equal)[1].reshape(len(some), self.k)
        old = np.take_along_axis(self.row[some], np.minimum(at, self.k - 1), axis=1)
        self.row[some] = np.where(at < self.k, old, first + at - self.k)
        self.score[some] = np.take_along_axis(c, at, axis=1)
        if exact is not None:
            if self.exact is None:
                self.exact = np.zeros_like(self.score)
            self.exact[some] = np.take_along_axis(np.concatenate((self.exact[some], exact[some - lo]), axis=1), at, axis=1)

    def rows(self, step: int = 50_000) -> Iterator[tuple]:
        """(query, score, strict, *names) of the rows kept, in stretches."""
        q, slot = np.nonzero(self.score > -np.inf)
        if not len(q):
            return
        names = [pa.concat_arrays([r.column(c) for r in self.held]) for c in self.names]
        for i in range(0, len(q), step):
            a, s = q[i : i + step], slot[i : i + step]
            at = pa.array(self.row[a, s])
            yield (a, self.score[a, s], self.strict[a], *(n.take(at) for n in names))
