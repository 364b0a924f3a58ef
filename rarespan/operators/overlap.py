"""What the plans of overlap mates share: the two strands of a query, and the comparison of candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.config import Mating
from rarespan.functions import sequence as S


def allowed(width: int, similarity: float) -> int:
    return int((1.0 - similarity) * width)


def strands(queries: DataFrame, m: Mating) -> DataFrame:
    """(query_id, q, strand): each query, and its reverse complement as strand 1 if both strands count."""
    forward = queries.select("query_id", F.col("seq").alias("q"), F.lit(0).alias("strand"))
    other = (S.literal_reverse_complement if m.literal_reverse else S.reverse_complement)(F.col("seq"))
    return forward.unionByName(queries.select("query_id", other.alias("q"), F.lit(1).alias("strand"))) if m.both_strands else forward


#: Two bits of each base, and whether a byte is neither a base nor N (fixed values).
BITS = np.zeros(256, np.uint8)
BITS[list(b"ACGT")] = range(4)
OTHER = ~np.isin(np.arange(256), list(b"ACGTN"))


def plane(bit: np.ndarray) -> np.ndarray:
    """A bit for each place, 64 a word, the first one lowest, and a word more than are needed."""
    wide = np.zeros((len(bit) // 64 + 2) * 64, np.uint8)
    wide[: len(bit)] = bit
    return np.packbits(wide, bitorder="little").view("<u8")


class Side:
    """Sequences one after the other, with the bits of their bases as planes."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets, self.size = flat, offsets, np.diff(offsets)
        self.other = bool(OTHER[flat].any())
        unknown = flat == ord("N")
        self.bits = (plane(BITS[flat] & 1), plane(BITS[flat] >> 1))
        self.unknown = plane(unknown) if unknown.any() else None


def words(planes: tuple, start: np.ndarray) -> list[np.ndarray]:
    """The 64 places from each start on."""
    k, s = start >> 6, (start & 63).astype(np.uint64)
    up = np.uint64(63) - s
    return [(p[k] >> s) | ((p[k + 1] << np.uint64(1)) << up) for p in planes]


def overlap_well(m: Mating, a: Side, row_a: np.ndarray, b: Side, row_b: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Which of some rows of b, shifted against rows of a, overlap them well enough. Compared 64 bases at once."""
    la, lb = a.size[row_a], b.size[row_b]
    at_a, at_b = np.maximum(shift, 0), np.maximum(-shift, 0)
    w = np.minimum(la - at_a, lb - at_b)
    longest = int(max(la.max(), lb.max())) if len(w) else 0
    least = np.ceil(m.overlap * np.arange(longest + 1)).astype(np.int64)
    most = ((1.0 - m.similarity) * np.arange(longest + 1)).astype(np.int64)
    out = w >= least[np.minimum(la, lb)]
    open_ = np.flatnonzero(out)
    w = w[open_]
    start_a, start_b = a.offsets[row_a[open_]] + at_a[open_], b.offsets[row_b[open_]] + at_b[open_]
    if a.other or b.other:
        out[open_] = mismatches(m, a.flat, start_a, b.flat, start_b, w) <= most[w]
        return out
    differ = np.zeros(len(open_), np.int64)
    for done in range(0, int(w.max()) if len(w) else 0, 64):
        more = np.flatnonzero(w > done) if done else slice(None)
        x, y = start_a[more] + done, start_b[more] + done
        (a0, a1), (b0, b1) = words(a.bits, x), words(b.bits, y)
        unequal = (a0 ^ b0) | (a1 ^ b1)
        an, bn = (words((s.unknown,), at)[0] if s.unknown is not None else np.uint64(0) for s, at in ((a, x), (b, y)))
        unequal = unequal & ~(an | bn) if m.n_wildcard else unequal | ((an | bn) if m.n_mismatch else (an ^ bn))
        inside = np.uint64(2**64 - 1) >> (64 - np.minimum(w[more] - done, 64)).astype(np.uint64)
        differ[more] += np.bitwise_count(unequal & inside)
    out[open_] = differ <= most[w]
    return out


def mismatches(m: Mating, flat_a: np.ndarray, start_a: np.ndarray, flat_b: np.ndarray, start_b: np.ndarray, w: np.ndarray, cells: int = 1 << 24) -> np.ndarray:
    """The same count for any characters, as matrices of bytes."""
    out, order, at = np.zeros(len(w), np.int64), np.argsort(w, kind="stable"), 0
    while at < len(order):
        step = max(1, cells // max(1, int(w[order[min(len(order), at + 4096) - 1]])))
        some = order[at : at + min(step, 4096)]
        at += len(some)
        width = np.arange(int(w[some].max()))
        x = flat_a[np.minimum(start_a[some, None] + width, len(flat_a) - 1)]
        y = flat_b[np.minimum(start_b[some, None] + width, len(flat_b) - 1)]
        unequal = x != y
        if m.n_mismatch:
            unequal |= x == ord("N")
        if m.n_wildcard:
            unequal &= (x != ord("N")) & (y != ord("N"))
        out[some] = (unequal & (width < w[some, None])).sum(axis=1)
    return out
