"""Overlap mates of query sets of any size: distinct sequences meet in an equi join on q-grams, and frequent grams are dealt to blocks.

Copies of a sequence are one row with a count, so a group of copies is one pair. A gram with its places is one row for each
sequence. An accepted overlap holds at least some number of common q-grams; all but one may be left out, so each query leaves
out its most frequent ones. A gram that many sequences hold is cut on both sides into blocks of about BLOCK rows, and every
pair of blocks is a key of its own: no task takes a gram whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarespan.config import Mating
from rarespan.functions import rolling
from rarespan.operators import overlap
from rarespan.operators.iterate import durable
from rarespan.operators.small import broadcast_if_small

#: Rows of a gram on one side beyond which that side is cut.
BLOCK = 1_000


def spare_grams(shortest: int, longest: int, q: int, m: Mating) -> int:
    """How many of the common q-grams of any accepted overlap of reads of these lengths may be left out."""
    widths = range(max(1, int(np.ceil(m.overlap * shortest))), longest + 1)
    return max(0, min((w - q + 1 - q * overlap.allowed(w, m.similarity) for w in widths), default=1) - 1)


def grams(rows: DataFrame, seq: str, q: int) -> DataFrame:
    """rows with (gram, at): each distinct q-gram of the sequence, as a hash, and its places."""
    at = rows.columns.index(seq)

    def run(batches):
        for whole in batches:
            for b in rolling.pieces(whole, at, 1 << 18):
                flat, offsets = rolling.bytes_of(b.column(at))
                where, h = rolling.gram_hashes(flat, offsets, q)
                row = np.searchsorted(offsets, where, side="right") - 1
                order = np.lexsort((where, h, row))
                where, h, row = where[order], h[order], row[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array((where - offsets[row]).astype(np.int32)))
                own = [b.column(i).take(pa.array(row[first])) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h[first].view(np.int64)), places], [*b.schema.names, "gram", "at"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, gram long, at array<int>")


def without_frequent(asked: DataFrame, hot: DataFrame, spare: int) -> DataFrame:
    """The grams of queries less the most frequent ones that no overlap needs; only frequent grams are left out."""
    if not spare:
        return asked
    first = W.partitionBy("query_id", "strand").orderBy(F.col("of_reads").desc_nulls_last(), "gram")
    both = asked.join(hot.select("gram", "of_reads"), "gram", "left").withColumn("places", F.sum(F.size("at")).over(first))
    return both.where(F.col("of_reads").isNull() | (F.col("places") > spare)).drop("of_reads", "places")


def dealt(side: DataFrame, hot: DataFrame, own: str, other: str, key: Column) -> DataFrame:
    """side with (own_block, other_block): the block of a row among those of its gram, and each block of the other side."""
    both = side.join(hot.select("gram", own, other), "gram", "left")
    blocks = lambda c: F.coalesce(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("long")
    mine = F.pmod(F.xxhash64(key), F.greatest(blocks(own), F.lit(1)))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks(other), F.lit(1)) - 1))
    return both.withColumn(f"{own}_block", mine).withColumn(f"{other}_block", meets).drop(own, other)


def shifts_of(at_q: pa.ListArray, at_s: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shift): the distinct differences of the places of some rows."""
    (q0, q), (s0, s) = ((rolling.offsets_of(c), c.values.to_numpy()) for c in (at_q, at_s))
    wide = np.diff(s0)[rows]
    n = np.diff(q0)[rows] * wide
    row = np.repeat(rows, n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(wide, n)
    shift = q[q0[row] + i // wide].astype(np.int64) - s[s0[row] + i % wide]
    key = np.unique(row * (1 << 32) + shift + (1 << 31))
    return key >> 32, (key & ((1 << 32) - 1)) - (1 << 31)


def one_row(at_q: np.ndarray, at_s: np.ndarray) -> np.ndarray:
    """The same of one row of very many places, without all their pairs at once."""
    low = int(at_q.min()) - int(at_s.max())
    seen = np.zeros(int(at_q.max()) - int(at_s.min()) - low + 1, bool)
    for p in at_q:
        seen[p - at_s - low] = True
    return np.flatnonzero(seen) + low


def verified(met: DataFrame, m: Mating, most: int = 1 << 20) -> DataFrame:
    """(query_id, read_id, copies) of rows (query_id, q, at_q, read_id, copies, seq, at_s) whose sequences overlap well enough at a shift that their places name."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            query_id, q, at_q, read_id, copies, seq, at_s = b.columns
            side_q, side_s = overlap.Side(*rolling.bytes_of(q)), overlap.Side(*rolling.bytes_of(seq))
            good = np.zeros(b.num_rows, bool)
            n = np.diff(rolling.offsets_of(at_q)) * np.diff(rolling.offsets_of(at_s))
            part = (np.cumsum(n) - n) // most
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
                long_ = rows[n[rows] > most]
                found = [shifts_of(at_q, at_s, rows[n[rows] <= most])]
                for r in long_:
                    shift = one_row(at_q[int(r)].values.to_numpy(), at_s[int(r)].values.to_numpy())
                    found.append((np.full(len(shift), r), shift))
                for row, shift in found:
                    fits = overlap.overlap_well(m, side_q, row, side_s, row, shift)
                    good[row[fits]] = True
            kept = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in (query_id, read_id, copies)], ["query_id", "read_id", "copies"])

    return met.select("query_id", "q", "at_q", "read_id", "copies", "seq", "at_s").mapInArrow(run, "query_id long, read_id long, copies long")


def pairs(queries: DataFrame, reads: DataFrame, q: int, m: Mating, spare: int = 0) -> DataFrame:
    """Distinct (query_id, read_id, copies) that match, of queries (query_id, seq) and reads (read_id, seq, copies)."""
    asked = grams(overlap.strands(queries, m), "q", q)
    seen = grams(reads.select("read_id", "copies", "seq"), "seq", q)
    ones = asked.select("gram", F.lit(1).alias("of_queries"), F.lit(0).alias("of_reads")).unionByName(seen.select("gram", F.lit(0).alias("of_queries"), F.lit(1).alias("of_reads")))
    counts = ones.groupBy("gram").agg(F.sum("of_queries").alias("of_queries"), F.sum("of_reads").alias("of_reads"))
    hot = broadcast_if_small(durable(counts.where(f"of_queries > 0 AND of_reads > 0 AND (of_queries > {BLOCK} OR of_reads > {BLOCK})")))
    asked = dealt(without_frequent(asked, hot, spare), hot, "of_queries", "of_reads", F.struct("query_id", "strand")).withColumnRenamed("at", "at_q")
    seen = dealt(seen, hot, "of_reads", "of_queries", F.col("read_id")).withColumnRenamed("at", "at_s")
    return verified(asked.join(seen, ["gram", "of_queries_block", "of_reads_block"]), m).distinct()


def counts(queries: DataFrame, reads: DataFrame, q: int, m: Mating, spare: int = 0) -> DataFrame:
    """(query_id, n): mates of each query that has some; ids are distinct on either side."""
    kinds = durable(reads.groupBy("seq").agg(F.min("read_id").alias("read_id"), F.count("*").alias("copies")))
    asked = durable(queries.groupBy("seq").agg(F.min("query_id").alias("kind")))
    n = pairs(asked.select(F.col("kind").alias("query_id"), "seq"), kinds, q, m, spare).groupBy("query_id").agg(F.sum("copies").alias("n"))
    found = asked.join(n.withColumnRenamed("query_id", "kind"), "kind").select("seq", "n")
    return queries.select("query_id", "seq").join(found, "seq").select("query_id", "n")
