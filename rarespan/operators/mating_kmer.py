"""Mates by exact k-mers, on both strands.

Windows are 64-bit codes, made for a batch of reads at once in numpy and counted there before anything moves. The
query set's codes (k-mers and their reverse complements) go ahead of the scan: as they are if they are few,
else as a bitmap whose size comes from their count and has a bound. So nearly only hits leave the scan, and
they meet the exact keys in a left semi join. With `by`, reads and queries meet within groups (a curve per
source), in one scan for all groups. Where every read is a query, operators.kmer_runs moves less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarespan.functions import rolling
from rarespan.functions import sequence as S
from rarespan.operators.iterate import durable
from rarespan.operators.small import broadcast_if_small

#: Query codes that are broadcast as they are; more go as a bitmap of at most 2^MOST_BITS bits.
FEW_CODES, MOST_BITS = 200_000, 30
HASH = np.uint64(0x9E3779B97F4A7C15)


def windows(reads: DataFrame, k: int) -> DataFrame:
    """(kmer): each window of k bases of each read, as often as it occurs, as binary, by column functions only (for streams).

    Reads are cut at other characters first, so that no window needs a check of its own.
    """
    runs = reads.select(F.explode(F.split(F.upper("seq"), "[^ACGT]+")).alias("run")).where(F.length("run") >= k)
    return runs.select(F.explode(S.kmer_bytes(F.col("run"), k)).alias("kmer"))


class Filter:
    """Which codes may be asked for: exact for few codes, else by a bitmap without false negatives."""

    def __init__(self, codes: DataFrame):
        """codes: (code), distinct."""
        few = codes.limit(FEW_CODES + 1).toArrow()["code"].to_numpy().view(np.uint64)
        n = len(few) if len(few) <= FEW_CODES else codes.count()
        self.bits = min(MOST_BITS, max(10, (16 * n).bit_length()))
        if n <= FEW_CODES:
            self.codes, self.words = np.sort(few), None
            return
        bits = self.bits

        def words(batches):
            for b in batches:
                at = (b.column(0).to_numpy().view(np.uint64) * HASH) >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["w", "m"])

        rows = codes.select("code").mapInArrow(words, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        self.codes, self.words = None, np.zeros(1 << (bits - 6), np.uint64)
        self.words[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        if self.words is not None:
            at = (code * HASH) >> np.uint64(64 - self.bits)
            return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        if not len(self.codes):
            return np.zeros(len(code), bool)
        marked = np.zeros(1 << self.bits, bool)  # a first look that most windows fail
        marked[(self.codes * HASH) >> np.uint64(64 - self.bits)] = True
        maybe = np.flatnonzero(marked[(code * HASH) >> np.uint64(64 - self.bits)])
        out = np.zeros(len(code), bool)
        out[maybe] = self.codes[np.minimum(np.searchsorted(self.codes, code[maybe]), len(self.codes) - 1)] == code[maybe]
        return out


def window_counts(reads: DataFrame, k: int, by: str | None = None, asked: Filter | None = None) -> DataFrame:
    """([by,] code, n): occurrences of the windows of k bases, of all or of those that a filter lets pass."""
    shared = reads.sparkSession.sparkContext.broadcast(asked) if asked is not None else None
    columns = [by] if by else []
    schema = ", ".join([*(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in columns), "code long, n long"])

    def run(batches):
        for whole in batches:
            for b in rolling.pieces(whole, len(columns)):
                flat, offsets = rolling.bytes_of(b.column(len(columns)))
                at, code = rolling.kmer_codes(flat, offsets, k)
                if shared is not None:
                    hit = shared.value(code)
                    at, code = at[hit], code[hit]
                if not columns:
                    code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])
                    continue
                names = b.column(0).dictionary_encode()
                groups = pc.fill_null(names.indices, len(names.dictionary)).to_numpy().astype(np.int64)
                group = np.repeat(groups, np.diff(offsets))[at]
                order = np.lexsort((code, group))
                group, code = group[order], code[order]
                edge = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (group[1:] != group[:-1])]) if len(code) else np.zeros(0, np.int64)
                index = pa.array(group[edge], pa.int32(), mask=group[edge] == len(names.dictionary))
                yield pa.RecordBatch.from_arrays([names.dictionary.take(index), pa.array(code[edge].view(np.int64)), pa.array(np.diff(np.r_[edge, len(code)]))], [by, "code", "n"])

    return reads.select(*columns, "seq").mapInArrow(run, schema).groupBy(*columns, "code").agg(F.sum("n").alias("n"))


def counts(queries: DataFrame, reads: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """([by,] code, n): occurrences of the queries' k-mers and of their reverse complements in the reads, by two-bit code.

    The queries are read twice, so they should be a written table.
    """
    columns = [by] if by else []
    keys = queries.select(*columns, F.explode(F.array("kmer", "kmer_rc")).alias("kmer")).select(*columns, S.kmer_code(F.col("kmer")).alias("code")).distinct()
    asked = Filter(keys.select("code").distinct())
    hits = window_counts(reads, k, by, asked)
    return hits if asked.codes is not None and not by else hits.join(broadcast_if_small(keys), [*columns, "code"], "left_semi")


def mates(queries: DataFrame, reads: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """queries with mates: occurrences of the k-mer and of its reverse complement; a palindrome counts twice.

    Both strands look up one table of counts, so that the reads are scanned once. Query ids are unique.
    """
    columns = [by] if by else []
    queries = durable(queries)  # they are read for their codes and for the lookup
    both = queries.select("*", F.explode(F.array("kmer", "kmer_rc")).alias("_strand")).withColumn("_code", S.kmer_code(F.col("_strand")))
    found = both.join(counts(queries, reads, k, by).withColumnRenamed("code", "_code"), [*columns, "_code"], "left")
    return found.groupBy(*queries.columns).agg(F.sum(F.coalesce("n", F.lit(0))).alias("mates"))


def without_errors(mated: DataFrame) -> DataFrame:
    """Drops the first rint(sum(p_err)) queries with one mate, in query order.

    The singletons are numbered through ranges of query_id, so no window holds all of them: the number
    before a range comes from the counts of the ranges.
    """
    single = mated.where(F.col("mates") == 1)
    total = mated.agg(F.rint(F.sum("p_err")).cast("long").alias("errors"))
    edge = single.agg(F.min("query_id").alias("low"), F.max("query_id").alias("high"))
    ranged = single.select("query_id").crossJoin(F.broadcast(edge))  # one row
    ranged = ranged.select("query_id", F.floor((F.col("query_id") - F.col("low")) * 1024 / (F.col("high") - F.col("low") + 1)).alias("part"))
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count")).drop("count")  # 1024 rows
    numbered = ranged.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("query_id"))).join(F.broadcast(before), "part")
    gone = numbered.crossJoin(F.broadcast(total)).where(F.col("rn") + F.col("before") <= F.col("errors")).select("query_id")
    return mated.join(gone, "query_id", "left_anti")


def histogram(mated: DataFrame, by: str | None = None) -> DataFrame:
    return mated.groupBy(*([by] if by else []), "mates").agg(F.count("*").alias("n_queries"))
