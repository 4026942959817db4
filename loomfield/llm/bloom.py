"""Pairs of Bloom filters, `once` and `twice`, built by the tasks that own their segments (operator 5 and what uses it)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 1 << 17
MIN_BITS, MAX_BITS, BITS_PER_ROW = 1 << 17, 1 << 29, 16
PROBES = 4


def filter_bits(rows: int) -> int:
    """Bits of the filter for so many rows: a power of two within fixed bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, int(rows * BITS_PER_ROW - 1).bit_length())))


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(segments)


def _probes(h: np.ndarray) -> list[np.ndarray]:
    """Bit positions within the hash's segment, by double hashing."""
    a, b = h & np.uint64(0xFFFFFFFF), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(SEGMENT_BITS)).astype(np.int64) for i in range(PROBES)]


def _test(bits: np.ndarray, base: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in _probes(h):
        at = base + p
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def _set(bits: np.ndarray, h: np.ndarray) -> None:
    for p in _probes(h):
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))


class PairFilter:
    """`once` and `twice` of one segment."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)

    def add(self, fresh: np.ndarray, repeated: np.ndarray) -> None:
        """Distinct hashes of one task, of which `repeated` were seen there more than once."""
        every = np.concatenate([fresh, repeated])
        _set(self.twice, every[_test(self.once, np.zeros(len(every), np.int64), every)])
        _set(self.twice, repeated)
        _set(self.once, every)


def _partial_filters(segments: int):
    def run(batches):
        seen = [np.zeros(0, np.uint64)]
        counts = [np.zeros(0, np.int64)]

        def rows():
            h, at = np.unique(np.concatenate(seen), return_inverse=True)
            many = np.bincount(at, np.concatenate(counts), len(h)) > 1 if len(h) else np.zeros(0, bool)
            where = _segment(h, segments)
            order = np.argsort(where, kind="stable")
            h, many, where = h[order], many[order], where[order]
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(h) else []
            groups = list(zip(starts, [*starts[1:], len(h)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(where[a]) for a, _ in groups], pa.int32()),
                    pa.array([h[a:b][~many[a:b]].tobytes() for a, b in groups], pa.binary()),
                    pa.array([h[a:b][many[a:b]].tobytes() for a, b in groups], pa.binary()),
                ],
                ["segment", "fresh", "repeated"],
            )

        held = 0
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            seen.append(h)
            counts.append(n)
            held += len(h)
            if held > 1_000_000:  # bounded memory: a task may send more than one partial filter
                yield from rows()
                seen, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        if held:
            yield from rows()

    return run


def _merged_filters(batches):
    segment, pair = None, None
    for batch in batches:
        for s, fresh, repeated in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != segment:
                if pair is not None and pair.twice.any():
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": pa.array([pair.twice.tobytes()], pa.binary())})
                segment, pair = s, PairFilter()
            pair.add(np.frombuffer(fresh, np.uint64), np.frombuffer(repeated, np.uint64))
    if pair is not None and pair.twice.any():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": pa.array([pair.twice.tobytes()], pa.binary())})


def repeated_filter(hashes: DataFrame, rows: int) -> np.ndarray:
    """The `twice` filter of a one-column DataFrame of 64-bit hashes, as bytes on the driver (64 MB at most)."""
    bits = filter_bits(rows)
    segments = bits // SEGMENT_BITS
    partial = hashes.mapInArrow(_partial_filters(segments), "segment int, fresh binary, repeated binary")
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged_filters, "segment int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["segment"] * (SEGMENT_BITS // 8)
        whole[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return whole


def maybe_in(hashes: DataFrame, rows: int):
    """A function from a column of 64-bit hashes to whether it may be among those of a one-column DataFrame: never false
    for one that is. The filter (64 MB at most) is broadcast."""
    every = hashes.toDF("h")
    bits = repeated_filter(every.unionByName(every), 2 * rows)  # each comes twice, so `twice` has them all
    shared = hashes.sparkSession.sparkContext.broadcast(bits)
    segments = len(bits) * 8 // SEGMENT_BITS

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        h = h.to_numpy().astype(np.int64).view(np.uint64)
        return pd.Series(_test(shared.value, _segment(h, segments).astype(np.int64) * SEGMENT_BITS, h))

    return test
