"""Arrow batches in slices of bounded text, so that a worker's memory follows the slice and not the partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.session import spread

#: Characters handled at a time; a longer single text is a slice of its own, whole.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose texts hold about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table] | pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow over slices: ``fn`` gets a slice and gives batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                if out is None:
                    continue
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return spread(df).mapInArrow(run, schema)


#: Bits of a filter (2 MB, whatever it holds).
FILTER_BITS = 24


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bit table of 2^FILTER_BITS bits, packed, with one bit per 64-bit hash: rows of 64 bits are put
    together by an aggregate, so the driver gets at most 2^(FILTER_BITS - 6) numbers."""
    at = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("r")).agg(F.bit_or(one).alias("bits")).collect():
        table[r["r"]] = r["bits"]
    return table.view(np.uint8)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bit table may hold; false only for hashes that weren't put in."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
