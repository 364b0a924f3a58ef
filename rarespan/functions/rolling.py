"""Windows of sequences in numpy: exact two-bit codes of k-mers, and hashes of any q-grams.

Both work on the bytes of an Arrow string column as they lie, all sequences of a batch at once; a window that
crosses the end of its sequence is not valid. Doubling widths makes a window of k from about log2(k) passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Two bits of each base, 4 for other bytes (fixed values: A 0, G 1, C 2, T 3).
CODES = np.full(256, 4, np.uint8)
for _i, _base in enumerate(b"AGCT"):
    CODES[_base] = CODES[_base + 32] = _i
#: Bases that fit a code.
LONGEST_CODE = 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 22):
    """Slices of a batch whose sequences have about `most` bytes, so that arrays stay small."""
    sizes = np.diff(offsets_of(batch.column(column)))
    groups = (np.cumsum(sizes) - sizes) // most
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(sizes) else []
    for lo, hi in zip(edge, [*edge[1:], len(sizes)]):
        yield batch.slice(lo, hi - lo)


def offsets_of(seqs: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(seqs.type) or pa.types.is_large_binary(seqs.type) else np.int32
    return np.frombuffer(seqs.buffers()[1], kind)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)


def bytes_of(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the sequences one after the other, and where each begins; nulls are empty."""
    offsets = offsets_of(seqs)
    data = seqs.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def widen(values: np.ndarray, k: int, join) -> np.ndarray:
    """Values of windows of k from values of single places; join(left, right, width of right)."""
    out, width, power, size = None, 0, values, 1
    while True:
        if k & size:
            out = power if out is None else join(power[: len(power) - width] if width else power, out[size:], width)
            n = min(len(out), len(power))
            out, width = out[:n], width + size
        if size * 2 > k:
            return out
        power, size = join(power[:-size], power[size:], size), size * 2


def whole(n: int, offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows at 0 .. n - k lie inside one sequence."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[: max(0, n - k + 1)]
    return np.arange(len(ends)) + k <= ends


def kmer_codes(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(where, code) of the windows of k bases, k up to 32."""
    if len(flat) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    two = CODES[flat]
    bad = np.r_[0, np.cumsum(two > 3)]
    good = whole(len(flat), offsets, k) & (bad[k:] == bad[:-k])
    code = widen(two.astype(np.uint64) & np.uint64(3), k, lambda a, b, width: a << np.uint64(2 * width) | b)
    at = np.flatnonzero(good)
    return at, code[at]


def gram_hashes(flat: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(where, hash) of the windows of q bytes; equal windows have equal hashes."""
    if len(flat) < q:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = {}

    def join(a, b, width):
        if width not in powers:
            powers[width] = np.uint64(pow(int(MULTIPLIER), width, 2**64))
        return a * powers[width] + b

    at = np.flatnonzero(whole(len(flat), offsets, q))
    return at, widen(flat.astype(np.uint64) + np.uint64(1), q, join)[at]


def wild_codes(flat: np.ndarray, offsets: np.ndarray, q: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(where, code) of the windows of q bases and at most `most` N, q up to 32, each N written out as every base; other windows have none."""
    if len(flat) < q:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    two, unknown = CODES[flat], flat == ord("N")
    held, bad = np.r_[0, np.cumsum(unknown)], np.r_[0, np.cumsum((two > 3) & ~unknown)]
    at = np.flatnonzero(whole(len(flat), offsets, q) & (bad[q:] == bad[:-q]) & (held[q:] - held[:-q] <= most))
    code = widen(np.where(unknown, np.uint64(0), two.astype(np.uint64) & np.uint64(3)), q, lambda a, b, width: a << np.uint64(2 * width) | b)[at]
    places, first, n = np.flatnonzero(unknown), held[at], held[at + q] - held[at]
    for i in range(most):
        open_ = np.flatnonzero(n > i)
        lift = (2 * (at[open_] + q - 1 - places[first[open_] + i])).astype(np.uint64)
        more = [code[open_] | (np.uint64(base) << lift) for base in (1, 2, 3)]
        at, first, n = (np.concatenate([v, *[v[open_]] * 3]) for v in (at, first, n))
        code = np.concatenate([code, *more])
    return at, code
