"""An extension: k-mer hits of a frozen query set over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan import schema
from rarespan.operators import mating_kmer


def read_stream(spark: SparkSession, folder: str, form: str = "parquet", per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema.READS).option("maxFilesPerTrigger", per_trigger).format(form).load(folder)


def hits(stream: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(kmer, n) so far, for the queries' k-mers on both strands; state holds at most two keys per query."""
    keys = queries.select(F.explode(F.array("kmer", "kmer_rc")).alias("kmer")).distinct().select(F.encode("kmer", "UTF-8").alias("kmer"))
    return mating_kmer.windows(stream, k).join(keys, "kmer", "left_semi").groupBy(F.decode("kmer", "UTF-8").alias("kmer")).agg(F.count("*").alias("n"))


def start(counted: DataFrame, name: str, checkpoint: str):
    """Updates into a memory table; a real sink takes the same frame."""
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
