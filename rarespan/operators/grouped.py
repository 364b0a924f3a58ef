"""Curves of many groups of reads at once: mates, rarefaction and summaries within each group, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespan.config import Sampling
from rarespan.functions import sequence as S
from rarespan.operators import kmer_runs, mating_kmer, rarefaction
from rarespan.operators.iterate import durable


def metadata(reads: DataFrame, by: str, k: int, s: Sampling) -> DataFrame:
    """(by, kernel, L, AL, R, overlap, divide) of the reads (by, read_id, seq)."""
    facts = reads.groupBy(by).agg(F.count("*").alias("R"), F.avg(F.length("seq")).alias("L"))
    return facts.select(by, F.lit("kmer").alias("kernel"), "L", S.adjusted_length(F.col("L"), k).alias("AL"), "R", F.lit(50.0).alias("overlap"), F.lit(s.factor).alias("divide"))


def grid(meta: DataFrame, by: str, s: Sampling) -> DataFrame:
    """(by, R, portion_idx, portion): the logarithmic grid of each group."""
    n = F.greatest(F.lit(2), F.ceil((F.ln(F.lit(2.0)) - F.ln(F.greatest("R", F.lit(2)))) / F.ln(F.lit(s.factor))) + 2).cast("int")
    every = meta.select(by, "R", n.alias("n")).select(by, "R", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("portion_idx"))
    portion = F.when(F.col("portion_idx") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(s.factor), F.col("n") - 1 - F.col("portion_idx")))
    return every.select(by, "R", "portion_idx", portion.alias("portion"))


def found_probability(mates: str = "mates", total: str = "R", portion: str = "portion") -> Column:
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(mates) - 1).cast("double") / F.greatest(F.col(total) - 1, F.lit(1)).cast("double")))
    return 1 - F.pow(1 - p, F.greatest(F.lit(0), F.floor(F.col(total) * F.col(portion)) - 1))


def mates(reads: DataFrame, by: str, k: int) -> DataFrame:
    """(by, query_id, mates): every read with bases first is a query of its group."""
    return kmer_runs.mates(reads, k, by=by)


def summaries(mated: DataFrame, meta: DataFrame, by: str, s: Sampling, closed: bool = False, literal: bool = False) -> DataFrame:
    """(by, portion_idx, portion, R, avg, sd, q1, q2, q3) from binomial draws of each number of mates, in closed form, or literal, by uniforms of each query. No row is made for a single query but in the literal form."""
    points = durable(grid(meta, by, s))
    if literal:
        return rarefaction.summarise(literal_draws(mated, points, by, s), (by,)).join(meta.select(by, "R"), by)
    rows = mating_kmer.histogram(mated, by).join(points, by).select(by, "mates", "n_queries", "portion_idx", "portion", found_probability().alias("p"))
    out = rarefaction.closed_summary(rows, (by,)) if closed else rarefaction.summarise(rarefaction.drawn(rows, [by], s), (by,))
    return out.join(meta.select(by, "R"), by)


def literal_draws(mated: DataFrame, points: DataFrame, by: str, s: Sampling) -> DataFrame:
    """(by, portion_idx, portion, replicate, redundancy): a uniform for inclusion and one for the match of each query, which other engines can repeat.

    What a replicate asks of a query is written once for all queries: the digest's head, and the digest below which the query is
    drawn. So a query that is not drawn costs a digest and a comparison, and no row; one without other mates is never found.
    """
    runs = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.replicates - 1))).alias("replicate"))
    below = F.ceil(F.col("portion") * 4294967296.0)
    asked = runs.select("*", F.concat_ws("|", F.lit(str(s.seed)), F.col(by).cast("string"), "portion_idx", "replicate", F.lit("")).alias("head"), F.when(below < 1 << 32, F.lower(F.lpad(F.hex(below), 8, "0"))).otherwise("g").alias("below"))
    inside = F.md5(F.concat("head", F.col("query_id").cast("string"), F.lit("|in"))) < F.col("below")
    rows = mated.join(F.broadcast(asked), by).where(inside)  # groups x grid x replicates: some thousand rows
    hit = S.uniform(s.seed, F.col(by), F.col("portion_idx"), F.col("replicate"), F.col("query_id"), F.lit("hit")) < found_probability()
    found = rows.groupBy(by, "portion_idx", "replicate").agg(F.count("*").alias("inside"), F.count_if(F.when(F.col("mates") > 1, hit).otherwise(False)).alias("found"))
    every = runs.select(by, "portion_idx", "portion", "replicate").join(found, [by, "portion_idx", "replicate"], "left")
    return every.select(by, "portion_idx", "portion", "replicate", F.coalesce(F.col("found") / F.col("inside"), F.lit(0.0)).alias("redundancy"))


def expected(mated: DataFrame, meta: DataFrame, by: str, s: Sampling) -> DataFrame:
    """(by, portion_idx, portion, R, redundancy): the closed form of each group."""
    both = mating_kmer.histogram(mated, by).join(grid(meta, by, s), by)
    return both.groupBy(by, "portion_idx", "portion", "R").agg((F.sum(F.col("n_queries") * found_probability()) / F.sum("n_queries")).alias("redundancy"))


def curve_tables(reads: DataFrame, by: str, k: int, s: Sampling, closed: bool = False, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Curve metadata and points of each group, labelled by it, for the operators on curves."""
    reads = reads.where(F.length("seq") >= k)
    meta = durable(metadata(reads, by, k, s))
    points = summaries(mates(reads, by, k), meta, by, s, closed, literal)
    points = points.select(F.col(by).alias("label"), (F.col("portion") * F.col("R")).alias("x_obs"), "avg", "sd", "q1", "q2", "q3")
    return meta.withColumnRenamed(by, "label"), points
