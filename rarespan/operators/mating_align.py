"""Mates by ungapped overlap.

Reads a and b match if at some shift their overlap holds at least ceil(overlap * shorter) bases and at most
int((1 - similarity) * width) mismatches, on either strand. The plan is seed and verify: an overlap of w
bases with e mismatches holds an exact run of ceil((w - e) / (e + 1)), so some shared q-gram, q the least
such run, names the shift, and a pair is compared at the shifts its q-grams name. Queries are a bounded sample:
after a count they go to every task, where a batch of reads finds its seeds and compares all candidates at
once, on bit planes. More queries meet the reads in an equi join on q-grams (mating_join), or go to the tasks block by block
for the historic reverse complement and where N is a wildcard. A wildcard in a q-gram is written out as every base on either
side, so it hides no seed. Without a useful q, and for sequences with dense N where N is a wildcard, every shift is tried.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.config import Mating
from rarespan.functions import rolling
from rarespan.operators import mating_join, overlap
from rarespan.operators.iterate import durable
from rarespan.operators.overlap import allowed


def tiles(reads: DataFrame, width: int = 50) -> DataFrame:
    """(read_id, seq): disjoint tiles of width bases; a tile's id is 2^24 * read + number, which no read's length reaches."""
    n = F.floor(F.length("seq") / width)
    every = reads.where(F.length("seq") >= width).select("read_id", "seq", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("t"))
    return every.select((F.col("read_id") * (1 << 24) + F.col("t")).alias("read_id"), F.substr("seq", F.col("t") * width + 1, F.lit(width)).alias("seq"))


def seed_length(shortest: int, longest: int, m: Mating) -> int:
    """The least exact run that any accepted overlap of reads of these lengths must hold."""
    best = longest
    for w in range(max(1, math.ceil(m.overlap * shortest)), longest + 1):
        e = allowed(w, m.similarity)
        best = min(best, math.ceil((w - e) / (e + 1)))
    return best


#: Most N in a q-gram that is written out with every base in their places, where N is a wildcard.
WRITTEN_OUT = 2
#: Bits of the bases, which two neighbours of a seed share if they match; N is a base of its own, or every base. Other bytes match nothing here.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b"ACGTN")] = [1, 2, 4, 8, 16]
WILD_KINDS = np.where(KINDS == 16, np.uint8(15), KINDS)


def seeds_of(flat: np.ndarray, offsets: np.ndarray, q: int, m: Mating):
    """(where, hash, kind of the byte ahead in the sequence) of every q-gram; where N is a wildcard, of each with bases in its place."""
    where, h = rolling.wild_codes(flat, offsets, q, WRITTEN_OUT) if m.n_wildcard else rolling.gram_hashes(flat, offsets, q)
    kinds = (WILD_KINDS if m.n_wildcard else KINDS)[flat]
    ahead = np.r_[np.uint8(0), kinds[:-1]] if len(kinds) else kinds
    ahead[offsets[:-1][np.diff(offsets) > 0]] = 0
    return where, h * np.uint64(0x9E3779B97F4A7C15), ahead[where]


def literal_reversed(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The historic reverse complement of each sequence."""
    size = np.diff(offsets)
    source = np.repeat(offsets[:-1] + offsets[1:], size) - np.arange(len(flat))
    out = OPPOSITE[flat[np.minimum(source, len(flat) - 1)]]
    out[offsets[:-1][size > 0]] = ord("N")
    return out


OPPOSITE = np.full(256, ord("N"), np.uint8)
OPPOSITE[list(b"ACGT")] = list(b"TGCA")


class Seeds:
    """The q-grams of a bounded query set, sorted by hash, and what verifies a candidate.

    A run of matching bases names its shift once, by its first q-gram: a common q-gram whose neighbours ahead match too is none.
    """

    def __init__(self, rows: pa.Table, q: int, m: Mating, bits: int = 18):
        seqs = rows["q"].combine_chunks()
        self.ids, self.number = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        self.q, self.m, self.bits, self.strand = q, m, np.uint64(64 - bits), rows["strand"].to_numpy()
        self.flat, self.offsets = rolling.bytes_of(seqs)
        at, h, ahead = seeds_of(self.flat, self.offsets, q, m)
        order = np.argsort(h, kind="stable")
        self.hash, self.ahead, at = h[order], ahead[order], at[order]
        self.query = np.searchsorted(self.offsets, at, side="right") - 1
        self.at = at - self.offsets[self.query]
        self.marked = np.zeros(1 << bits, bool)  # a first look that most q-grams fail
        self.marked[self.hash >> self.bits] = True

    def candidates(self, flat: np.ndarray, offsets: np.ndarray, most: int = 1_000_000):
        """(read, query, shift) of every shift that a run of matching bases names, in slices."""
        where, h, ahead = seeds_of(flat, offsets, self.q, self.m)
        maybe = np.flatnonzero(self.marked[h >> self.bits])
        left = np.searchsorted(self.hash, h[maybe])
        count = np.searchsorted(self.hash, h[maybe], side="right") - left
        some = np.flatnonzero(count)
        where, ahead, left, count = where[maybe[some]], ahead[maybe[some]], left[some], count[some]
        read = np.searchsorted(offsets, where, side="right") - 1
        place = where - offsets[read]
        part = (np.cumsum(count) - count) // most
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for lo, hi in zip(edge, [*edge[1:], len(part)]):
            c = count[lo:hi]
            own = np.repeat(np.arange(lo, hi), c)
            g = np.arange(len(own)) + np.repeat(left[lo:hi] - (np.cumsum(c) - c), c)
            first = np.flatnonzero((self.ahead[g] & ahead[own]) == 0)
            own, g = own[first], g[first]
            yield read[own], self.query[g], self.at[g] - place[own]

    def found(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(read, number of the query's id): the distinct pairs that match."""
        literal = self.m.literal_reverse and self.m.both_strands
        own, size, pairs = overlap.Side(self.flat, self.offsets), np.diff(self.offsets), [np.zeros(0, np.int64)]
        for turned in (False, True) if literal else (False,):
            bases = literal_reversed(flat, offsets) if turned else flat
            other = overlap.Side(bases, offsets)
            for read, query, shift in self.candidates(bases, offsets):
                if literal:  # the shorter one is reversed, of two of equal length the read
                    longer = size[query] < np.diff(offsets)[read]
                    fits = np.flatnonzero((self.strand[query] == 0) & ~longer if turned else (self.strand[query] == 0) | longer)
                    read, query, shift = read[fits], query[fits], shift[fits]
                good = overlap.overlap_well(self.m, own, query, other, read, shift)
                pairs.append(np.unique(read[good] * len(self.ids) + self.number[query[good]]))
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.ids)))


def odd_ones(flat: np.ndarray, offsets: np.ndarray, q: int) -> np.ndarray:
    """Which sequences no seeds with wildcards are made of: those with N too dense to be written out, or with other characters."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(offsets) - 1, bool)
    out[row[~COMMON[flat]]] = True
    at = np.flatnonzero(flat == ord("N"))
    first, last = at[:-WRITTEN_OUT], at[WRITTEN_OUT:]
    out[row[first[(last - first < q) & (row[first] == row[last])]]] = True
    return out


class Search:
    """What a task needs to find the mates of a bounded query set: seeds, and the queries that are compared at every shift."""

    def __init__(self, rows: pa.Table, q: int, m: Mating):
        self.m, self.q, self.every, self.odd_queries = m, min(q, rolling.LONGEST_CODE) if m.n_wildcard else q, {}, {}
        if m.n_wildcard:
            ids, strand = rows["query_id"].to_numpy(), rows["strand"].to_numpy()
            odd = np.isin(ids, ids[odd_ones(*rolling.bytes_of(rows["q"].combine_chunks()), self.q)])
            for held, some in ((self.every, strand == 0), (self.odd_queries, odd & (strand == 0))):
                for r in rows.filter(pa.array(some)).to_pylist():
                    held.setdefault(len(r["q"]), []).append((r["query_id"], r["q"]))
            rows = rows.filter(pa.array(~odd))
        self.seeds = Seeds(rows, self.q, m)

    def odd(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.m.n_wildcard:
            return np.zeros(len(offsets) - 1, bool)
        out = odd_ones(flat, offsets, self.q)
        return out | odd_ones(literal_reversed(flat, offsets), offsets, self.q) if self.m.literal_reverse else out

    def found(self, seqs: pa.Array):
        """(query_id, row) arrays of the pairs that match, for distinct sequences without null."""
        for b in rolling.pieces(pa.RecordBatch.from_arrays([seqs, pa.array(np.arange(len(seqs)))], ["seq", "row"]), 0, 1 << 20):
            seq, rows = b.column(0), b.column(1).to_numpy()
            flat, offsets = rolling.bytes_of(seq)
            odd = self.odd(flat, offsets)
            for which, asked in ((np.flatnonzero(odd), self.every), (np.flatnonzero(~odd), self.odd_queries)):
                if len(which) and asked:
                    pairs = every_shift(rows[which], seq.take(pa.array(which)).to_pylist(), asked, self.m)
                    yield pairs["query_id"].to_numpy(), pairs["read_id"].to_numpy()
            if odd.any():
                left = np.flatnonzero(~odd)
                rows = rows[left]
                flat, offsets = rolling.bytes_of(seq.take(pa.array(left)))
            read, query = self.seeds.found(flat, offsets)
            yield self.seeds.ids[query], rows[read]


def pairs_seeded(queries: DataFrame, reads: DataFrame, q: int, m: Mating, few: int = 20_000) -> DataFrame:
    """Distinct (query_id, read_id) that match."""
    asked = overlap.strands(queries, m).limit(few + 1).toArrow()
    if asked.num_rows > few:
        return mating_join.pairs(queries, reads.withColumn("copies", F.lit(1).cast("long")), q, m).drop("copies")
    shared = reads.sparkSession.sparkContext.broadcast(Search(asked, q, m))

    def run(batches):
        for b in batches:
            for query_id, row in shared.value.found(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(query_id), b.column(0).take(pa.array(row))], ["query_id", "read_id"])

    return reads.select("read_id", "seq").mapInArrow(run, "query_id long, read_id long").distinct()


def counts_seeded(queries: DataFrame, reads: DataFrame, q: int, m: Mating) -> DataFrame:
    """(query_id, n): mates of a bounded query set. Equal reads of a batch are compared once, and a task sends a number for each query."""
    shared = reads.sparkSession.sparkContext.broadcast(Search(overlap.strands(queries, m).toArrow(), q, m))

    def run(batches):
        n: dict[int, int] = {}
        for b in batches:
            kinds = b.column(0).dictionary_encode()
            times = np.bincount(kinds.indices.to_numpy(), minlength=len(kinds.dictionary))
            for query_id, row in shared.value.found(kinds.dictionary):
                ids, at = np.unique(query_id, return_inverse=True)
                for i, more in zip(ids.tolist(), np.bincount(at, times[row], len(ids)).astype(np.int64).tolist()):
                    n[i] = n.get(i, 0) + more
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.int64()), pa.array(list(n.values()), pa.int64())], ["query_id", "n"])

    return reads.select("seq").mapInArrow(run, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))


COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reversed_strand(seq: str, literal: bool) -> str:
    kept = seq[1:] if literal else seq
    rc = "".join(c if c in "ACGT" else "N" for c in kept)[::-1].translate(COMPLEMENT)
    return f"N{rc}" if literal and seq else rc


def matrix(seqs: list[str]) -> np.ndarray:
    """Sequences of one length as rows of bytes."""
    return np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), -1)


def shifts(la: int, lb: int, m: Mating):
    """(columns of the shorter, columns of the longer, mismatches allowed) of every shift that may be accepted."""
    least = math.ceil(m.overlap * la)
    for i in range(least - lb, la - least + 1):
        w = min(la, lb + i) if i < 0 else la - i
        yield slice(max(i, 0), max(i, 0) + w), slice(max(-i, 0), max(-i, 0) + w), allowed(w, m.similarity)


def differing(x: np.ndarray, y: np.ndarray, m: Mating) -> np.ndarray:
    d = x != y
    if m.n_mismatch:
        d = d | (x == ord("N"))
    return d & (x != ord("N")) & (y != ord("N")) if m.n_wildcard else d


#: Bit planes of the bases and of N (fixed values); other bytes have none.
PLANES = {base: code for code, base in enumerate(b"ACGT")}
COMMON = np.isin(np.arange(256), list(b"ACGTN"))


def packed(rows: np.ndarray) -> np.ndarray:
    """(3, rows, words): the two bits of each base and whether it is N, 64 places a word."""
    width = -(-rows.shape[1] // 64) * 64
    code = np.zeros(256, np.uint8)
    for base, number in PLANES.items():
        code[base] = number
    out = []
    for plane in (code[rows] & 1, code[rows] >> 1, rows == ord("N")):
        wide = np.zeros((len(rows), width), np.uint8)
        wide[:, : rows.shape[1]] = plane
        out.append(np.packbits(wide, axis=1).view(np.uint64))
    return np.stack(out)


def match_matrix(short: np.ndarray, long_: np.ndarray, m: Mating) -> np.ndarray:
    """(shorts, longs): whether some shift aligns them; all rows of a side have one length.

    A shift's columns are packed once a side and compared as words: xor of the planes, then the number of bits. Sequences with
    other characters are compared byte by byte.
    """
    out = np.zeros((len(short), len(long_)), bool)
    if not (COMMON[short].all() and COMMON[long_].all()):
        for x, y, most in shifts(short.shape[1], long_.shape[1], m):
            out |= differing(short[:, None, x], long_[None, :, y], m).sum(axis=2, dtype=np.int32) <= most
        return out
    for x, y, most in shifts(short.shape[1], long_.shape[1], m):
        (a0, a1, an), (b0, b1, bn) = packed(short[:, x]), packed(long_[:, y])
        differ = (a0[:, None] ^ b0[None]) | (a1[:, None] ^ b1[None])
        unknown = an[:, None] | bn[None]
        if m.n_wildcard:
            differ &= ~unknown
        else:
            differ |= unknown if m.n_mismatch else an[:, None] ^ bn[None]
        out |= np.bitwise_count(differ).sum(axis=2, dtype=np.int32) <= most
    return out


def match_rows(short: np.ndarray, long_: np.ndarray, m: Mating) -> np.ndarray:
    """Whether some shift aligns each row with the row beside it."""
    out = np.zeros(len(short), bool)
    for x, y, most in shifts(short.shape[1], long_.shape[1], m):
        open_ = np.flatnonzero(~out)
        out[open_] = differing(short[open_, x], long_[open_, y], m).sum(axis=1, dtype=np.int32) <= most
    return out


def pairs_all(queries: DataFrame, reads: DataFrame, m: Mating, most: int = 20_000) -> DataFrame:
    """The same by trying every shift, for blocks of about `most` queries one after the other, so that no more are on the driver."""
    done = [pairs_of_block(block, reads, m) for block in blocks(queries, most)]
    return reduce(DataFrame.unionByName, done if len(done) == 1 else map(durable, done))


def blocks(queries: DataFrame, most: int) -> list[DataFrame]:
    """The queries in parts of about `most`."""
    parts = max(1, math.ceil(queries.count() / most))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [queries.where(block == i) for i in range(parts)]


def pairs_of_block(queries: DataFrame, reads: DataFrame, m: Mating, few: int = 128) -> DataFrame:
    """All pairs of a few reads and the queries of one length at once.

    The shorter of a pair is the one that is reversed; of two of equal length that is the read.
    """
    asked: dict[int, list] = {}
    for r in queries.select("query_id", "seq").collect():  # a block is bounded
        asked.setdefault(len(r["seq"]), []).append((r["query_id"], r["seq"]))
    shared = reads.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for b in batches:
            yield every_shift(b["read_id"].to_numpy(), b["seq"].tolist(), shared.value, m, few)

    return reads.select("read_id", "seq").mapInPandas(run, "query_id long, read_id long")


def every_shift(read_ids: np.ndarray, reads: list[str], asked: dict[int, list], m: Mating, few: int = 128) -> pd.DataFrame:
    """(query_id, read_id) of the pairs of some reads and of queries (id, sequence) by length that some shift aligns."""
    out = []
    sizes = np.array([len(s) for s in reads])
    for length in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == length)
        for at in range(0, len(own), few):
            ids, seqs = read_ids[own[at : at + few]], [reads[i] for i in own[at : at + few]]
            for q_length, qs in asked.items():
                if not q_length:
                    continue
                q_ids, q_seqs = np.array([q[0] for q in qs]), [q[1] for q in qs]
                short, long_ = (q_seqs, seqs) if q_length < length else (seqs, q_seqs)
                hit = match_matrix(matrix(short), matrix(long_), m)
                if m.both_strands:
                    hit |= match_matrix(matrix([reversed_strand(s, m.literal_reverse) for s in short]), matrix(long_), m)
                i, j = np.nonzero(hit)
                i, j = (i, j) if q_length < length else (j, i)
                out.append(pd.DataFrame({"query_id": q_ids[i], "read_id": ids[j]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "read_id": []}, dtype="int64")


#: Queries beyond which they meet reads in a join instead of going to every task.
MANY = 10_000


def mates(queries: DataFrame, reads: DataFrame, m: Mating, cross: bool = False, least_seed: int = 8) -> DataFrame:
    """(query_id, mates) of queries (query_id, seq), whose ids are distinct, as those of the reads; cross: the queries are of another dataset, and count themselves. Null and empty sequences match nothing."""
    queries = durable(queries.select("query_id", "seq"))  # a sample may be a pass over all reads
    every_id = queries.select("query_id")
    queries, reads = (df.where(F.length("seq") > 0) for df in (queries, reads))
    edge = reads.select("seq").unionByName(queries.select("seq")).agg(F.min(F.length("seq")), F.max(F.length("seq"))).head()
    q = seed_length(edge[0], edge[1], m) if edge[0] else 0

    if q < least_seed:
        found = counted(pairs_all(queries, reads, m))
    elif queries.limit(MANY + 1).count() <= MANY:
        found = counts_seeded(queries, reads, q, m)
    elif m.literal_reverse or m.n_wildcard:
        found = reduce(DataFrame.unionByName, [durable(counts_seeded(block, reads, q, m)) for block in blocks(queries, MANY)])
    else:
        found = mating_join.counts(queries, reads, q, m, mating_join.spare_grams(edge[0], edge[1], q, m))
    return every_id.join(found, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + (1 if cross else 0)).alias("mates"))


def counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query_id").agg(F.count("*").alias("n"))
