"""All k-mers of a read set, counted by runs: what a shuffle moves are runs of windows that share a minimizer.

The minimizer of a window is the least hash of its shorter windows, so windows side by side mostly share it, and every
occurrence of a k-mer has the same one. A read falls into runs of such windows; a run is one string of k - 1 bases more than
it has windows, about a quarter of what its windows take. Runs that repeat in a batch travel once, with their
number, which is what a read that makes up much of the data comes to. Where runs meet by minimizer, in sorted order, they
become windows again and are counted minimizer by minimizer, so a task holds little more than the k-mers of one. Queries
travel along: the first k-mer of each read and its reverse complement, by their own minimizers, and only what is found
leaves the tasks: a number per query, or a histogram per task.

This is the plan for all k-mers, or for as many queries as reads. For a bounded query set the filter ahead of the scan
(operators.mating_kmer) moves less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.functions import rolling

#: Bases of the windows that compete to be the minimizer; bases that fall into runs at once, which bounds a task's arrays to
#: about a hundred bytes each, as it does where windows are counted.
SHORT, PIECE = 12, 1 << 19
COMPLEMENT = np.zeros(256, np.uint8)
COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCATGCA")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(flat: np.ndarray, k: int) -> np.ndarray:
    """Of every window of k bytes; meaningful where all are bases."""
    m = min(SHORT, (k + 1) // 2)
    two = rolling.CODES[flat].astype(np.uint64) & np.uint64(3)
    return least(mixed(rolling.widen(two, m, lambda a, b, width: a << np.uint64(2 * width) | b)), k - m + 1)


def strings(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of bytes, in upper case, as an Arrow column."""
    ends = np.r_[0, np.cumsum(size)]
    data = flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)] & np.uint8(0xDF)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def runs_of(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(minimizer, run, times) of a batch's sequences, equal runs once."""
    at, _ = rolling.kmer_codes(flat, offsets, k)
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64)
    mini = minimizers(flat, k)[at]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (mini[1:] != mini[:-1])])
    every = strings(flat, at[first], np.diff(np.r_[first, len(at)]) + (k - 1)).dictionary_encode()
    number = every.indices.to_numpy()
    _, where, times = np.unique(number, return_index=True, return_counts=True)
    return mini[first][where].view(np.int64), every.dictionary, times


def asked_of(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sequence, minimizer, k-mer) of the first k-mers that are bases throughout, on both strands."""
    at, _ = rolling.kmer_codes(flat, offsets, k)
    which = np.flatnonzero(np.isin(offsets[:-1], at) & (np.diff(offsets) >= k))
    start = offsets[:-1][which]
    forward = flat[start[:, None] + np.arange(k)]
    both = np.concatenate([forward, COMPLEMENT[forward[:, ::-1]]]).ravel()
    begins = np.arange(2 * len(which)) * k
    mini = minimizers(both, k)[begins] if len(which) else np.zeros(0, np.uint64)
    return np.r_[which, which], mini.view(np.int64), strings(both, begins, np.full(len(begins), k))


def runs(reads: DataFrame, k: int, key: str | None = None, by: str | None = None) -> DataFrame:
    """([by,] minimizer, run, n[, query]): runs with their number; with key, also each read's first k-mers, n = 0, under its key.

    Reads whose key is asked for have unique keys; `by` is a column of few values.
    """
    columns = [c for c in (by, key) if c]
    kind = lambda c: reads.schema[c].dataType.simpleString()
    schema = ", ".join([*([f"`{by}` {kind(by)}"] if by else []), "minimizer long, run binary, n long", *([f"query {kind(key)}"] if key else [])])

    def run(batches):
        for whole in batches:
            for b in rolling.pieces(whole, len(columns), PIECE):
                groups = b.column(0).dictionary_encode() if by else None
                parts = [(None, None)] if groups is None else [(g, v) for g, v in enumerate([*groups.dictionary, None])]
                for g, value in parts:
                    own = b if groups is None else b.filter(groups.indices.is_null() if value is None else pa.compute.equal(groups.indices, g).fill_null(False))
                    if not own.num_rows:
                        continue
                    flat, offsets = rolling.bytes_of(own.column(len(columns)))
                    tables = [(*runs_of(flat, offsets, k), None)]
                    if key:
                        which, mini, kmers = asked_of(flat, offsets, k)
                        tables.append((mini, kmers, np.zeros(len(mini), np.int64), own.column(len(columns) - 1).take(pa.array(which))))
                    for mini, text, n, ids in tables:
                        made = [pa.array(mini, pa.int64()), text, pa.array(n, pa.int64())]
                        made += [ids if ids is not None else pa.nulls(len(mini), own.schema.field(key).type)] if key else []
                        made = ([pa.repeat(value, len(mini)) if value is not None else pa.nulls(len(mini), own.schema.field(by).type)] if by else []) + made
                        yield pa.RecordBatch.from_arrays(made, [*([by] if by else []), "minimizer", "run", "n", *(["query"] if key else [])])

    return reads.select(*columns, "seq").mapInArrow(run, schema)


def parts(text: pa.Array):
    """Slices of about PIECE bytes."""
    size = np.diff(rolling.offsets_of(text))
    part = (np.cumsum(size) - size) // PIECE
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(edge, [*edge[1:], len(part)]):
        yield slice(int(lo), int(hi))


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of n."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[edge], np.add.reduceat(n, edge) if len(edge) else n[:0]


class Counted:
    """Counts of the k-mers of one or more whole minimizers, and the queries for them."""

    def __init__(self, k: int):
        self.k = k
        self.code, self.n, self.asked, self.query = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], []

    def add(self, text: pa.Array, n: np.ndarray, query: pa.Array | None) -> None:
        for some in parts(text):
            flat, offsets = rolling.bytes_of(text[some])
            _, code = rolling.kmer_codes(flat, offsets, self.k)
            each = np.diff(offsets) - (self.k - 1)
            times = np.repeat(n[some], each)
            if query is not None and (held := np.flatnonzero(times == 0)).size:
                row = np.repeat(np.arange(len(each)), each)[held]
                self.asked.append(code[held])
                self.query.append(query[some].take(pa.array(row)))
            code, times = summed(code[times > 0], times[times > 0])
            self.code, self.n = summed(np.concatenate([self.code, code]), np.concatenate([self.n, times]))

    def found(self) -> tuple[pa.Array, np.ndarray] | None:
        """(query, occurrences), one row for each strand."""
        if not self.asked:
            return None
        asked = np.concatenate(self.asked)
        if not len(self.code):
            return pa.concat_arrays(self.query), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(self.code, asked), len(self.code) - 1)
        return pa.concat_arrays(self.query), np.where(self.code[at] == asked, self.n[at], 0)


def counted(moved: DataFrame, k: int, by: str | None, schema: str, emit) -> DataFrame:
    """emit(by value as an Arrow scalar, Counted) for groups of whole minimizers of rows of runs().

    Rows come sorted; of a batch all minimizers but the last are complete, and the last stays open, as sums.
    """
    columns = [by] if by else []
    placed = moved.repartition(*columns, "minimizer").sortWithinPartitions(*columns, "minimizer")
    has_query = "query" in moved.columns

    def segments(b):
        """(by value, rows) of a batch's neighbours of one group."""
        if not by:
            return [(None, b)]
        number = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        return [(b.column(0)[int(lo)], b.slice(lo, hi - lo)) for lo, hi in zip(edge, [*edge[1:], len(number)])]

    def run(batches):
        open_, last = Counted(k), None  # last: by value and minimizer of what is open
        for whole in batches:
            for value, b in segments(whole) if whole.num_rows else []:
                mini, n, text = b.column("minimizer").to_numpy(), b.column("n").to_numpy(), b.column("run")
                query = b.column("query") if has_query else None
                cut = int(np.searchsorted(mini, mini[-1]))
                if last is not None and (by and last[0].as_py() != value.as_py() or cut == 0 and last[1] != mini[0]):
                    yield from emit(last[0], open_)
                    open_ = Counted(k)
                if cut:
                    open_.add(text[:cut], n[:cut], query[:cut] if has_query else None)
                    yield from emit(value, open_)
                    open_ = Counted(k)
                open_.add(text[cut:], n[cut:], query[cut:] if has_query else None)
                last = value, mini[-1]
        if last is not None:
            yield from emit(last[0], open_)

    return placed.mapInArrow(run, schema)


def mates(reads: DataFrame, k: int, key: str = "read_id", by: str | None = None) -> DataFrame:
    """([by,] query_id, mates): every read whose first k-mer is of bases is a query; occurrences of that and of its reverse complement, within the group."""
    columns = [f"`{by}` {reads.schema[by].dataType.simpleString()}"] if by else []
    kinds = reads.select(*([by] if by else []), key)

    def emit(value, one: Counted):
        found = one.found()
        if found:
            first = [pa.repeat(value, len(found[1]))] if by else []
            yield pa.RecordBatch.from_arrays([*first, found[0], pa.array(found[1])], [*([by] if by else []), "query_id", "n"])

    out = counted(runs(reads, k, key, by), k, by, ", ".join([*columns, f"query_id {kinds.schema[key].dataType.simpleString()}", "n long"]), emit)
    return out.groupBy(*([by] if by else []), "query_id").agg(F.sum("n").alias("mates"))


def spectrum(reads: DataFrame, k: int) -> DataFrame:
    """(occurrences, n_kmers): how many k-mers occur so often."""

    def emit(_, one: Counted):
        occurrences, n = np.unique(one.n, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(occurrences, pa.int64()), pa.array(n, pa.int64())], ["occurrences", "n_kmers"])

    made = counted(runs(reads, k), k, None, "occurrences long, n_kmers long", emit)
    return made.groupBy("occurrences").agg(F.sum("n_kmers").alias("n_kmers"))
