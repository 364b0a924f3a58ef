"""Poly-nucleotide composition over 16 letters.

A window of k letters is a number of k hexadecimal digits. Tasks make the numbers of a batch in numpy, count them there, in
a dense array where the alphabet of windows is small, and send sums; a number becomes a label by its digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespan.functions import rolling
from rarespan.functions import sequence as S

#: Bits of the reference's fields, and the step of its orders of magnitude (fixed values).
BITS, STEP = 32, 1024
#: Longest windows whose counts are a dense array, and longest that fit a number.
DENSE, LONGEST = 4, 15
DIGITS = "0123456789ABCDEF"


def label(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.hex(code), k, "0"), DIGITS, S.LABEL_ALPHABET)


def counts(reads: DataFrame, k: int, portion: float = 1.0, seed: int = 1) -> DataFrame:
    """(kmer, count): windows of k in sequences longer than k; portion: of the sequences."""
    rows = reads.where(F.length("seq") > k)
    if portion < 1:
        rows = rows.where(S.uniform(seed, F.col("read_id")) < portion)
    labels = rows.select(S.composition_label(F.col("seq")).alias("seq"))
    if k > LONGEST:
        return labels.select(F.explode(S.kmer_bytes(F.col("seq"), k)).alias("w")).groupBy("w").agg(F.count("*").alias("count")).select(F.decode("w", "UTF-8").alias("kmer"), "count")
    digit = np.zeros(256, np.uint64)
    digit[list(S.LABEL_ALPHABET.encode())] = np.arange(len(S.LABEL_ALPHABET))

    def run(batches):
        dense = np.zeros(16**k if k <= DENSE else 0, np.int64)
        for whole in batches:
            for b in rolling.pieces(whole, 0):
                flat, offsets = rolling.bytes_of(b.column(0))
                at = np.flatnonzero(rolling.whole(len(flat), offsets, k))
                code = rolling.widen(digit[flat], k, lambda x, y, width: x << np.uint64(4 * width) | y)[at]
                if k <= DENSE:
                    dense += np.bincount(code.astype(np.int64), minlength=len(dense))
                else:
                    yield table(*np.unique(code, return_counts=True))
        held = np.flatnonzero(dense)
        yield table(held, dense[held])

    def table(code, n):
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "count"])

    summed = labels.mapInArrow(run, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))
    return summed.select(label(F.col("code"), k).alias("kmer"), "count")


def with_zeroes(counted: DataFrame, k: int) -> DataFrame:
    """All 16^k labels, by arithmetic."""
    labels = counted.sparkSession.range(16**k).select(label(F.col("id"), k).alias("kmer"))
    return labels.join(counted, "kmer", "left").select("kmer", F.coalesce("count", F.lit(0)).alias("count"))


def extended(counted: DataFrame, bits: int = BITS) -> DataFrame:
    """With the fields of a wide counter of so many bits, count = base * omag + hang: base is below (2^bits - 1) div STEP, and omag the least power of STEP for that."""
    wide = (2**bits - 1) // STEP
    powers = [STEP**k for k in range(5) if wide * STEP**k < 2**63]
    omag = F.lit(powers[-1] * STEP)
    for power in reversed(powers):
        omag = F.when(F.col("count") < wide * power, F.lit(power)).otherwise(omag)
    rows = counted.select("kmer", "count", omag.cast("long").alias("omag"))
    return rows.select("kmer", "count", F.expr("count div omag").alias("base"), "omag", F.pmod("count", "omag").alias("hang"))


def in_label_order(counted: DataFrame) -> DataFrame:
    return counted.orderBy(S.label_order(F.col("kmer")))
