"""Rarefaction: the grid of portions, Monte-Carlo replicates, their closed form, and summaries.

Queries with equal mates are interchangeable, so every form works on the histogram (mates, queries): the
closed forms, of the mean and of the whole summary, multiply it with the grid, and the compressed Monte-Carlo form draws two binomials per
(portion, replicate, mates), as vectors, instead of two uniforms per query. The literal form, a uniform per query, is
kept for small sets because other engines can repeat it draw for draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan.config import Sampling
from rarespan.functions.sequence import uniform


def grid(spark: SparkSession, total_reads: int, s: Sampling) -> DataFrame:
    """(portion_idx, portion)."""
    if s.factor > 0:
        n = max(2, math.ceil((math.log(2) - math.log(max(total_reads, 2))) / math.log(s.factor)) + 2)
        idx = F.col("id").cast("int")
        portion = F.when(idx == 0, F.lit(0.0)).otherwise(F.pow(F.lit(s.factor), F.lit(n - 1) - idx))
    else:
        n = math.ceil((s.high - s.low) / s.step - 1e-9) + 1
        idx = F.col("id").cast("int")
        portion = F.least(F.lit(s.low) + F.lit(s.step) * idx, F.lit(s.high))
    return spark.range(n).select(idx.alias("portion_idx"), portion.alias("portion"))


def drawn_reads(total_reads: int, portion: Column) -> Column:
    """n of the match probability: reads drawn besides the query."""
    return F.greatest(F.lit(0), F.floor(F.lit(total_reads) * portion) - 1)


def match_probability(mates: Column, total_reads: int) -> Column:
    """Of one drawn read, between 0 and 1: k-mer mates count occurrences, which may outnumber the reads; 0 for a dataset of one read."""
    p = (mates - 1).cast("double") / F.lit(float(total_reads - 1)) if total_reads > 1 else F.lit(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def found_probability(mates: Column, total_reads: int, portion: Column) -> Column:
    p = match_probability(mates, total_reads)
    return F.lit(1.0) - F.pow(F.lit(1.0) - p, drawn_reads(total_reads, portion))


def expected(hist: DataFrame, points: DataFrame, total_reads: int) -> DataFrame:
    """(portion_idx, portion, redundancy) of (mates, n_queries): the exact mean of a replicate that holds a query."""
    p = found_probability(F.col("mates"), total_reads, F.col("portion"))
    both = hist.crossJoin(F.broadcast(points))  # the grid has tens of rows
    return both.groupBy("portion_idx", "portion").agg((F.sum(F.col("n_queries") * p) / F.sum("n_queries")).alias("redundancy"))


#: Quartiles of the normal distribution (fixed values).
QUARTILES = {"q1": (0.25, -0.6744897501960817), "q2": (0.5, 0.0), "q3": (0.75, 0.6744897501960817)}


def closed_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] portion_idx, portion, avg, sd, q1, q2, q3) of ([by,] mates, n_queries, portion_idx, portion, p): what many replicates come to, without drawing any.

    A replicate is the share of found queries among about m = portion * queries drawn without repetition. Its variance is that of
    the finds, E[p (1 - p)] / m, and of the choice, Var[p] / m times the part of the queries that is not drawn. A quartile is 0 if
    at least its share of replicates finds nothing, (1 - avg) ^ m, else that of a normal distribution, inside 0..1.
    """
    n, mean = F.sum("n_queries"), lambda x: F.sum(F.col("n_queries") * x) / F.sum("n_queries")
    facts = rows.groupBy(*by, "portion_idx", "portion").agg(n.alias("n"), mean(F.col("p")).alias("avg"), mean(F.col("p") * (1 - F.col("p"))).alias("inner"), mean(F.col("p") * F.col("p")).alias("square"))
    m = F.greatest(F.lit(1.0), F.col("portion") * F.col("n"))
    between = F.greatest(F.lit(0.0), F.col("square") - F.col("avg") * F.col("avg")) * F.greatest(F.lit(0.0), F.col("n") - m) / F.greatest(F.lit(1), F.col("n") - 1)
    facts = facts.withColumns({"none": F.pow(1 - F.col("avg"), m), "sd": F.sqrt((F.col("inner") + between) / m)})
    at = lambda share, z: F.when(F.col("none") >= share, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("avg") + z * F.col("sd"))))
    return facts.select(*by, "portion_idx", "portion", "avg", "sd", *(at(*q).alias(name) for name, q in QUARTILES.items()))


def expected_summary(hist: DataFrame, points: DataFrame, total_reads: int) -> DataFrame:
    """(portion_idx, portion, avg, sd, q1, q2, q3) of (mates, n_queries) in closed form."""
    both = hist.crossJoin(F.broadcast(points))  # the grid has tens of rows
    return closed_summary(both.withColumn("p", found_probability(F.col("mates"), total_reads, F.col("portion"))))


def replicate_literal(mated: DataFrame, points: DataFrame, total_reads: int, s: Sampling) -> DataFrame:
    """(portion_idx, portion, replicate, redundancy): a uniform for inclusion and one for the match of each query."""
    spark = mated.sparkSession
    runs = spark.range(s.replicates).select(F.col("id").cast("int").alias("replicate"))
    draws = mated.crossJoin(F.broadcast(points.crossJoin(runs)))  # grid x replicates, both bounded by parameters
    at = lambda tag: uniform(s.seed, F.col("portion_idx"), F.col("replicate"), F.col("query_id"), F.lit(tag))
    inside = at("in") < F.col("portion")
    found = inside & (at("hit") < found_probability(F.col("mates"), total_reads, F.col("portion")))
    out = draws.groupBy("portion_idx", "portion", "replicate").agg(F.count_if(inside).alias("inside"), F.count_if(found).alias("found"))
    return out.select("portion_idx", "portion", "replicate", F.when(F.col("inside") > 0, F.col("found") / F.col("inside")).otherwise(F.lit(0.0)).alias("redundancy"))


def replicate(hist: DataFrame, points: DataFrame, total_reads: int, s: Sampling) -> DataFrame:
    """The same distribution from (mates, n_queries): for each portion and number of mates two binomial draws of all replicates at once.

    The generator depends on (seed, portion, mates) only, so the result is the same for any partitioning. A
    batch adds up what it drew and emits one row per portion and replicate.
    """
    rows = hist.crossJoin(F.broadcast(points))  # the grid has tens of rows
    rows = rows.select("mates", "n_queries", "portion_idx", "portion", found_probability(F.col("mates"), total_reads, F.col("portion")).alias("p"))
    return drawn(rows, [], s)


def drawn(rows: DataFrame, by: list[str], s: Sampling) -> DataFrame:
    """([by,] portion_idx, portion, replicate, redundancy) of ([by,] mates, n_queries, portion_idx, portion, p)."""
    replicates, seed = s.replicates, s.seed
    names = [*by, "portion_idx", "portion"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def draw(batches):
        for b in batches:
            if not len(b):
                continue
            out = []
            for key, own in b.groupby(names, dropna=False, sort=False):
                inside, found = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
                portion, idx = key[-1], int(key[-2])
                for mates, n, p in zip(own["mates"].to_numpy(), own["n_queries"].to_numpy(), own["p"].to_numpy()):
                    rng = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (idx << 48) ^ int(mates)]))
                    some = rng.binomial(int(n), portion, replicates)
                    inside += some
                    found += rng.binomial(some, p)
                out.append(pd.DataFrame(dict(zip(names, key)) | {"replicate": np.arange(replicates, dtype=np.int32), "inside": inside, "found": found}))
            yield pd.concat(out)[[*names, "replicate", "inside", "found"]]

    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *by, "portion_idx", "mates")  # a few rows hold all the work
    done = dealt.mapInPandas(draw, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "replicate int, inside long, found long"]))
    out = done.groupBy(*names, "replicate").agg(F.sum("inside").alias("inside"), F.sum("found").alias("found"))
    return out.select(*names, "replicate", F.when(F.col("inside") > 0, F.col("found") / F.col("inside")).otherwise(F.lit(0.0)).alias("redundancy"))


def summarise(replicates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """([by,] portion_idx, portion, avg, sd, q1, q2, q3): population deviation, and order statistics at n/4, n/2 and 3n/4."""
    values = F.sort_array(F.collect_list("redundancy"))  # one number per replicate
    out = replicates.groupBy(*by, "portion_idx", "portion").agg(F.avg("redundancy").alias("avg"), F.stddev_pop("redundancy").alias("sd"), values.alias("v"))
    at = lambda q: F.coalesce(F.get("v", F.expr(f"cast(size(v) * {q} div 4 as int)")), F.lit(0.0))
    return out.select(*by, "portion_idx", "portion", F.coalesce("avg", F.lit(0.0)).alias("avg"), F.coalesce("sd", F.lit(0.0)).alias("sd"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
