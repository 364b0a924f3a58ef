"""Curve files and sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan import schema

FILE = "_metadata.file_path"


def label_of(path: Column) -> Column:
    """The file's name without .npo."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.npo$", "")


def parse_metadata(lines: DataFrame, compat: bool = False) -> DataFrame:
    """One row per label of (label, value) header lines '# @key: value'.

    A file is of k-mers if ksize is above 0 and below 1001. compat compares as text, as one reader does,
    which takes most k-mer files for alignments.
    """
    entry = lines.where(F.startswith("value", F.lit("# @")))
    entry = entry.select("label", F.regexp_extract("value", r"^# @([^:]*): ", 1).alias("k"), F.regexp_extract("value", r"^# @[^:]*: (.*)$", 1).alias("v"))
    m = entry.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    get = lambda k, t: F.col("m")[k].cast(t)
    inside = ((F.col("m")["ksize"] > "0") & (F.col("m")["ksize"] < "1001")) if compat else ((get("ksize", "double") > 0) & (get("ksize", "double") < 1001))
    out = m.withColumn("kernel", F.when(F.coalesce(inside, F.lit(False)), "kmer").otherwise("alignment"))
    is_kmer = F.col("kernel") == "kmer"
    return out.select(
        "label",
        get("version", "string").alias("version"),
        "kernel",
        get("maxL", "int").alias("maxL"),
        get("L", "double").alias("L"),
        F.when(is_kmer, get("AL", "double")).otherwise(get("L", "double")).alias("AL"),
        get("R", "long").alias("R"),
        F.when(is_kmer, F.lit(50.0)).otherwise(get("overlap", "double")).alias("overlap"),
        F.coalesce(get("logsampling", "double"), get("divide", "double"), F.lit(0.0)).alias("divide"),
        F.when(is_kmer, get("ksize", "int")).alias("ksize"),
    )


def complete(df: DataFrame, labels, what: str) -> DataFrame:
    """df, if it has rows of every label; a file that gives none is an error, not a curve less."""
    missing = set(labels) - {r["label"] for r in df.select("label").distinct().collect()}  # a row per file
    if missing:
        raise ValueError(f"no {what} in the files of {', '.join(sorted(missing))}")
    return df


def read_metadata(spark: SparkSession, paths, compat: bool = False) -> DataFrame:
    return parse_metadata(spark.read.text(paths).select(label_of(F.col(FILE)).alias("label"), "value"), compat)


def read_points(spark: SparkSession, paths) -> DataFrame:
    """(label, x_obs, avg, sd, q1, q2, q3)."""
    rows = spark.read.schema(schema.CURVE_POINTS).option("sep", "\t").option("comment", "#").csv(paths)
    return rows.select(label_of(F.col(FILE)).alias("label"), *schema.CURVE_POINTS.names)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(File, Name, Col) of a tab-separated sample sheet with a header."""
    return spark.read.schema(schema.SAMPLE_SHEET).option("sep", "\t").option("header", True).csv(path)


def read_files(spark: SparkSession, files: list[str], compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metadata and points of curve files, by the files' labels; each file holds a header and points."""
    labels = [f.rstrip("/").rsplit("/", 1)[-1].removesuffix(".npo") for f in files]
    if not files or len(set(labels)) < len(labels):
        raise ValueError("a set needs files of different names")
    return complete(read_metadata(spark, files, compat), labels, "header"), complete(read_points(spark, files), labels, "points")


def read_set(spark: SparkSession, sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata and points of all files of a sheet, labelled by its names; a sheet has one row per file."""
    names = F.broadcast(sheet.select(label_of(F.col("File")).alias("label"), "Name"))
    named = lambda df: df.join(names, "label").drop("label").withColumnRenamed("Name", "label")
    meta, points = read_files(spark, [r["File"] for r in sheet.collect()])
    return named(meta), named(points)
