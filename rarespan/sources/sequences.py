"""FASTA and FASTQ sources; .gz files are inflated by Spark's text reader.

FASTA splits into records at "newline >", so a plain file is read in parallel. FASTQ records are four lines:
lines are numbered within their file from the counts of its splits, and records are put together where they
lie, since a quality line may start with @; only the lines of a record that two splits share are moved.
Reading writes a table of the records, the index, in the session's checkpoint folder; ids are dense in the order of the
files' names and of the records in a file, and come from the counts per split, so nothing is sorted.
A .gz file is one split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarespan.operators.iterate import durable
from rarespan.operators.small import broadcast_if_small
from rarespan.session import share_path

SPLIT = ("file", "block")
PART = pa.list_(pa.struct([("n", pa.int64()), ("value", pa.string())]))


def split_of() -> list:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]


def in_file_order(counts: DataFrame, whole: bool = True) -> DataFrame:
    """(file, block, before): rows of the splits before this one, of all files or of the file; counts is (file, block, rows), a row per split."""
    order = W.orderBy("file", "block") if whole else W.partitionBy("file").orderBy("block")
    return counts.withColumn("before", F.sum("rows").over(order) - F.col("rows")).drop("rows")


def dense_ids(df: DataFrame) -> DataFrame:
    """df (file, block, at, ...), a written table, with read_id for these: at orders the rows of a split without gaps."""
    splits = df.groupBy(*SPLIT).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    numbered = df.join(broadcast_if_small(in_file_order(splits)), list(SPLIT))
    return numbered.withColumn("read_id", F.col("at") - F.col("first") + F.col("before") + 1).drop(*SPLIT, "at", "first", "before")


def parse_fasta(records: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """([keep,] header, seq) of raw records, with or without their leading >."""
    body = F.regexp_replace(value, r"^>", "")
    header = F.regexp_extract(body, r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"[\r\n]", "")
    return records.select(*keep, header.alias("header"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(header, seq[, read_id]); records without bases are dropped."""
    raw = share_path(spark).read.option("lineSep", "\n>").text(path).select(*split_of(), "value")
    reads = parse_fasta(raw.where(F.length(F.trim("value")) > 0), keep=SPLIT).where(F.length("seq") > 0)
    if not ids:
        return reads.drop(*SPLIT)
    return dense_ids(durable(reads.withColumn("at", F.monotonically_increasing_id())))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): lines with their number in their file, from 0, split by split and in order."""
    lines = spark.read.text(path).select(*split_of(), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy(*SPLIT).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = in_file_order(splits, whole=False)
    known = broadcast_if_small(before)
    both = lines.join(known, list(SPLIT)).select(*SPLIT, (F.col("at") - F.col("first") + F.col("before")).alias("n"), "value")
    return both if known is not before else both.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "n")  # a shuffle loses the order of the scan


def broken(l: str) -> Column:
    """What is wrong with the lines of a record, an array of strings; null if nothing is."""
    at = lambda i: F.get(l, F.lit(i))
    return (
        F.when(~F.startswith(at(0), F.lit("@")), "a record does not start with @")
        .when(F.size(l) < 2, "missing sequence")
        .when(F.size(l) < 3, "missing separator")
        .when(~F.startswith(at(2), F.lit("+")), "wrong separator")
        .when(F.size(l) < 4, "missing quality")
        .when(F.length(at(1)) != F.length(at(3)), "sequence and quality differ in length")
    )


def checked(records: DataFrame) -> DataFrame:
    """(..., header, seq, qual) of (..., file, l); a broken record is an error."""
    at = lambda i: F.get("l", F.lit(i))
    seq = F.when(broken("l").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), broken("l"))).cast("string")).otherwise(at(1))
    return records.withColumns({"header": F.substring(at(0), 2, 2147483647), "seq": seq, "qual": at(3)}).drop("l")


def parse_fastq(lines: DataFrame) -> DataFrame:
    """(file, block, at, header, seq, qual) of numbered lines, split by split; at orders the records of a split.

    A record belongs to the split of its first line. Records inside a split are put together in place; of the
    others only the lines at the splits' edges are grouped. Lines after the last record may be blank.
    """

    def run(batches):
        held = None  # lines of a split that no whole record has taken yet
        for b in batches:
            for own in splits_of(b):
                if held is not None and split_of_rows(held) == split_of_rows(own):
                    own = pa.concat_batches([held, own])
                elif held is not None:
                    yield partial(held)
                held = None
                first = -own.column("n")[0].as_py() % 4
                full = max(0, own.num_rows - first) // 4
                if first and own.column("n")[0].as_py() % 4:
                    yield partial(own.slice(0, first))
                if full:
                    yield whole(own.slice(first, 4 * full))
                if own.num_rows > first + 4 * full:
                    held = own.slice(first + 4 * full)
        if held is not None:
            yield partial(held)

    def splits_of(b):
        block, file = b.column("block").to_numpy(), b.column("file").dictionary_encode().indices.to_numpy()
        edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])]) if len(block) else []
        return [b.slice(lo, hi - lo) for lo, hi in zip(edge, [*edge[1:], len(block)])]

    def split_of_rows(rows):
        return rows.column("file")[0].as_py(), rows.column("block")[0].as_py()

    def whole(rows):
        """Records of four lines each, as slices of the lines' column."""
        n = rows.num_rows // 4
        start = pa.array(np.arange(0, 4 * n, 4))
        record = pa.compute.divide(rows.column("n").take(start), 4)
        return batch(rows.column("file").take(start), rows.column("block").take(start), record, pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, np.int32)), pa.concat_arrays([rows.column("value")])), pa.nulls(n, PART))

    def partial(rows):
        """Three lines at most, of a record that another split shares."""
        numbers = rows.column("n").to_pylist()
        file, block = split_of_rows(rows)
        part = [{"n": n, "value": v} for n, v in zip(numbers, rows.column("value").to_pylist())]
        return batch(pa.array([file]), pa.array([block], pa.int64()), pa.array([numbers[0] // 4], pa.int64()), pa.nulls(1, pa.list_(pa.string())), pa.array([part], PART))

    def batch(*columns):
        return pa.RecordBatch.from_arrays(list(columns), ["file", "block", "record", "l", "part"])

    made = durable(lines.select(*SPLIT, "n", "value").mapInArrow(run, "file string, block long, record long, l array<string>, part array<struct<n: long, value: string>>"))
    whole = made.where("l IS NOT NULL").select(*SPLIT, "record", "l")
    edges = made.where("l IS NULL").groupBy("file", "record").agg(F.min("block").alias("block"), F.array_sort(F.flatten(F.collect_list("part")))["value"].alias("l"))
    every = whole.unionByName(edges.select(*SPLIT, "record", "l")).where(F.exists("l", lambda v: v != ""))
    return checked(every).select(*SPLIT, F.col("record").alias("at"), "header", "seq", "qual")


def read_fastq(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(header, seq, qual[, read_id]); records without bases are dropped."""
    reads = parse_fastq(numbered_lines(share_path(spark), path))
    some = reads.where(F.length("seq") > 0)
    if not ids:
        return some.drop(*SPLIT, "at")
    some = durable(some)
    gaps = broadcast_if_small(durable(reads.where(F.length("seq") == 0).groupBy(*SPLIT).agg(F.array_sort(F.collect_list("at")).alias("gone"))))
    closed = some.join(gaps, list(SPLIT), "left").withColumn("at", F.col("at") - F.coalesce(F.size(F.filter("gone", lambda g: g < F.col("at"))), F.lit(0))).drop("gone")
    return dense_ids(closed)


def fastq_of_files(files: DataFrame) -> DataFrame:
    """(file, header, seq, qual) of whole files (file, value), a row each, as a stream brings them; column functions only, so streams take it."""
    lines = F.split(F.regexp_replace("value", r"(\r?\n)+\z", ""), r"\r?\n", -1)
    count = F.ceil(F.size("lines") / 4).cast("int")
    records = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("lines", i * 4 + 1, F.lit(4)))
    rows = files.where(F.length("value") > 0).select("file", lines.alias("lines")).select("file", F.explode(records).alias("l"))
    return checked(rows).where(F.length("seq") > 0)


def stream_fastq(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """A stream of the reads of FASTQ files (plain or .gz) that arrive in a folder; a file is one row while it is cut, so large files are read as a batch."""
    files = share_path(spark).readStream.option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    return fastq_of_files(files.select(F.col("_metadata.file_path").alias("file"), "value"))


def read_sequences(spark: SparkSession, path: str, form: str) -> DataFrame:
    """By format name, fasta or fastq."""
    if form not in ("fasta", "fastq"):
        raise ValueError("the format is fasta or fastq")
    return read_fasta(spark, path) if form == "fasta" else read_fastq(spark, path)


def to_fasta_reads(fastq: DataFrame) -> DataFrame:
    """FASTQ reads as FASTA reads: without qualities."""
    return fastq.drop("qual")


def longest_line(records: DataFrame) -> DataFrame:
    """One row: records, longest line, headers included, mean bases; of reads (header, seq)."""
    line = F.greatest(F.length("seq"), F.length("header") + 1)
    return records.agg(F.count("*").alias("n_reads"), F.max(line).cast("long").alias("longest_line"), F.avg(F.length("seq")).alias("mean_len"))
