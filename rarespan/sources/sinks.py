"""Result files, each one file of the name given. Reads go out as Spark writes them, as a folder of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespan.sources.result_file import one_file, write_lines


def header_lines(meta: dict) -> list[str]:
    """'# @key: value' in the order of the kernel's files."""
    order = ("impl", "ksize", "version", "L", "AL", "R", "overlap", "divide") if meta.get("ksize") else ("impl", "version", "maxL", "L", "R", "overlap", "divide")
    form = {"L": "{:.3f}", "AL": "{:.3f}", "overlap": "{:.2f}", "divide": "{:.2f}"}
    return [f"# @{k}: {form.get(k, '{}').format(meta[k])}" for k in order if meta.get(k) is not None]


def printf(value: Column, places: int) -> Column:
    """The text that C's %.{places}f gives: rounded from the exact value, ties to even, where format_string rounds the shortest decimal half up."""
    half = float(f"5e-{places + 1}")  # the one value that DecimalFormat may take for a tie though it is none
    exact = F.call_function("format_number", value.cast("double"), F.lit(f"0.{'0' * places}".rstrip(".")))
    return F.when(value == half, f"{half:.{places}f}").otherwise(exact)


def curve_lines(summary: DataFrame, total_reads: int, portion_as_label: bool = False, half_up: bool = False) -> DataFrame:
    """(portion_idx, value): the lines of a curve file after its header; half_up: numbers in the middle of two are rounded up instead of to even."""
    text = (lambda value, places: F.format_string(f"%.{places}f", value)) if half_up else printf
    label = text(F.col("portion"), 6) if portion_as_label else text(F.col("portion") * total_reads, 0)
    numbers = [text(F.col(c), 5) for c in ("avg", "sd", "q1", "q2", "q3")]
    return summary.select("portion_idx", F.concat_ws("\t", label, *numbers).alias("value"))


def curve_text(summary: DataFrame, meta: dict, total_reads: int, portion_as_label: bool = False, half_up: bool = False) -> DataFrame:
    """(portion_idx, value): a curve file's lines, header first, in one ordered partition; a curve has tens of points."""
    spark = summary.sparkSession
    head = spark.createDataFrame([(i - 1000, line) for i, line in enumerate(header_lines(meta))], "portion_idx int, value string")
    return head.unionByName(curve_lines(summary, total_reads, portion_as_label, half_up)).coalesce(1).sortWithinPartitions("portion_idx")


def write_curve(summary: DataFrame, meta: dict, path: str, total_reads: int, portion_as_label: bool = False, half_up: bool = False) -> None:
    """The header, then a line per portion."""
    write_lines(curve_text(summary, meta, total_reads, portion_as_label, half_up).select("value"), path)


def replicate_lines(replicates: DataFrame) -> DataFrame:
    """(portion_idx, replicate, value): portion (two decimals), replicate, value (ten decimals)."""
    return replicates.select("portion_idx", "replicate", F.concat_ws("\t", printf(F.col("portion"), 2), F.col("replicate").cast("string"), printf(F.col("redundancy"), 10)).alias("value"))


def write_replicates(replicates: DataFrame, path: str) -> None:
    """Lines of replicates by portion and replicate."""
    write_lines(replicate_lines(replicates).orderBy("portion_idx", "replicate").select("value"), path)


def save_replicates(replicates: DataFrame, folder: str) -> None:
    """A table by the portion's index, which the two decimals of a file's lines cannot tell."""
    replicates.write.mode("overwrite").partitionBy("portion_idx").parquet(folder)


def mate_lines(mated: DataFrame) -> DataFrame:
    """(value): one integer a line."""
    return mated.select(F.col("mates").cast("string").alias("value"))


def write_mates(mated: DataFrame, path: str) -> None:
    write_lines(mate_lines(mated), path)


def composition_lines(counted: DataFrame, extended: bool = False) -> DataFrame:
    """(value): kmer, count[, base, omag, hang], tab-separated, in label order."""
    from rarespan.operators import composition

    out = composition.in_label_order(composition.extended(counted) if extended else counted.select("kmer", "count"))
    return out.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in out.columns)).alias("value"))


def write_composition(counted: DataFrame, path: str, extended: bool = False) -> None:
    write_lines(composition_lines(counted, extended), path)


def write_summary(summary: DataFrame, path: str, form: str = "tsv") -> None:
    """tsv or csv with a header; a set has one row per curve."""
    rows = summary.coalesce(1).write.option("header", True).option("sep", {"tsv": "\t", "csv": ","}[form])
    one_file(summary.sparkSession, path, rows.csv)


def write_json(curves: DataFrame, path: str) -> None:
    """A set of (label, json) as one object keyed by label, in one file with a line per curve."""
    last = curves.agg(F.max("label").alias("last"))
    body = curves.crossJoin(F.broadcast(last)).select("label", F.concat(F.regexp_replace(F.to_json(F.array("label")), r"^\[|\]$", ""), F.lit(": "), "json", F.when(F.col("label") < F.col("last"), ",").otherwise("")).alias("value"))  # one row
    spark = curves.sparkSession
    ends = spark.createDataFrame([(0, None, "{"), (2, None, "}")], "part int, label string, value string")
    write_lines(body.withColumn("part", F.lit(1)).unionByName(ends).coalesce(1).sortWithinPartitions("part", "label").select("value"), path)


def write_fasta(reads: DataFrame, path: str) -> None:
    """Of (header, seq)."""
    reads.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)
