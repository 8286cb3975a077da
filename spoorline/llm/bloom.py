"""Bloom filters, made by tasks and merged by segment in a tree.

A filter has SEGMENTS parts of 2^18 to 2^20 bits, 16 to 64 MB, by how large the input is said to be. A fuller filter lets
more through to the exact step that follows; it never loses anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

SEGMENTS, PROBES, LEAST_BITS, MOST_BITS = 512, 3, 18, 20
#: Filters of so many tasks are merged by one task.
FAN = 256


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment, and PROBES bit positions within its 2^bits, of 64-bit hashes."""
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) | np.uint64(1)
    at = np.stack([((h >> np.uint64(9)) + step * np.uint64(k)) & np.uint64((1 << bits) - 1) for k in range(PROBES)])
    return (h & np.uint64(SEGMENTS - 1)).astype(np.int64), at.astype(np.int64)


def suspected(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    seg, at = probes(h, (filter_.shape[1] * 8).bit_length() - 1)
    return np.logical_and.reduce([(filter_[seg, a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 == 1 for a in at])


def _packed(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(np.unique(positions), prepend=0).astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64))


_ROWS = "segment int, part long, once binary, twice binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "part", "once", "twice"])


def _task_filters(hashes: Callable[[pa.RecordBatch], list[np.ndarray]], bits: int):
    """Each task's own pair of filters, as bit positions by segment."""

    def run(batches):
        seen = [h for b in batches for h in hashes(b)]
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        seg, at = probes(h, bits)
        order = np.argsort(seg, kind="stable")
        seg, at, twice = seg[order], at[:, order], n[order] > 1
        bounds = np.searchsorted(seg, np.arange(SEGMENTS + 1))
        part = TaskContext.get().partitionId()
        rows = [(s, part, _packed(at[:, i:j].ravel()), _packed(at[:, i:j][:, twice[i:j]].ravel())) for s, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
        if rows:
            yield _batch(rows)

    return run


def _merged(bits: int, last: bool):
    """Rows sorted by segment and part -> one for each: the union of once, and of twice what is in twice or in two rows' once.
    The last level gives bits in place of positions. One segment is held at a time."""

    def run(batches):
        now, once, twice = None, None, None

        def out():
            form = (lambda b: np.packbits(b).tobytes()) if last else (lambda b: _packed(np.flatnonzero(b)))
            return _batch([(*now, form(once), form(twice))])

        for b in batches:
            for segment, part, ones, twos in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (segment, part) != now:
                    if now is not None:
                        yield out()
                    now, once, twice = (segment, part), np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
                at = _unpacked(ones)
                twice[at[once[at]]] = True
                twice[_unpacked(twos)] = True
                once[at] = True
        if now is not None:
            yield out()

    return run


def bits_for(df: DataFrame) -> int:
    """Bits of a segment, as a power of two, by what the optimizer takes for df's size: some eight for every 64 bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // 8 // SEGMENTS).bit_length()))


def bloom(df: DataFrame, hashes: Callable[[pa.RecordBatch], list[np.ndarray]], which: str, bits: int | None = None, fan: int = FAN) -> np.ndarray:
    """The filter of the hashes seen once or more ("once") or twice or more ("twice") in df's batches, SEGMENTS x 2^bits / 8 bytes."""
    bits = bits or bits_for(df)
    rows = df.mapInArrow(released(_task_filters(hashes, bits)), _ROWS)
    parts = df.rdd.getNumPartitions()
    while parts > fan:
        rows = rows.withColumn("part", F.floor(F.col("part") / fan)).repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(_merged(bits, False), _ROWS)
        parts = -(-parts // fan)
    rows = rows.withColumn("part", F.lit(0).cast("long")).repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged(bits, True), _ROWS)
    out = np.zeros((SEGMENTS, (1 << bits) // 8), np.uint8)
    for r in rows.select("segment", which).collect():  # at most SEGMENTS rows
        out[r[0]] = np.frombuffer(r[1], np.uint8)
    return out
