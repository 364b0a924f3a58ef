"""The redundancy run: reads to a rarefied curve."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.config import Mating, Sampling
from rarespan.operators import checks, mating_align, mating_kmer, rarefaction, reads
from rarespan.operators.iterate import durable


@dataclass(frozen=True)
class Run:
    """Results of a run: mates per query, replicates, the summary per portion, findings, and the curve file's metadata."""

    mates: DataFrame
    replicates: DataFrame
    summary: DataFrame
    findings: DataFrame
    meta: dict
    mating: Mating
    sampling: Sampling


def queries_of(subjects: DataFrame, mating: Mating, sampling: Sampling, total: int, other: DataFrame | None) -> DataFrame:
    """The query set. With another dataset: all its usable reads for k-mers, a sample of it for alignments."""
    source = other if other is not None else subjects
    if mating.kernel == "kmer":
        if other is not None:
            return reads.kmer_queries(reads.long_enough(other, mating), mating.k, "qual" in other.columns)
        x = round(total * sampling.query_portion) if sampling.query_portion else None
        return reads.draw_kmer_queries(reads.long_enough(subjects, mating), mating, sampling, x, "qual" in subjects.columns)
    n = total if other is None else other.count()
    portion = sampling.query_portion or min(1.0, reads.resolve_queries(source, "alignment", sampling) / n)
    return reads.sample_bernoulli(source, portion, sampling.seed).select(F.col("read_id").alias("query_id"), "seq")


def run(subjects: DataFrame, mating: Mating = Mating(), sampling: Sampling = Sampling(), other: DataFrame | None = None, adjust: bool = False) -> Run:
    """Subjects (read_id, seq[, qual]); other: another dataset that the queries come from; adjust: repeat with adjusted parameters."""
    facts = reads.stats(subjects).head()
    total, mean = facts["n_reads"], facts["mean_len"]
    if not total:
        raise ValueError("no reads found")
    mated, last, changed = None, None, (mating, sampling)
    while changed is not None:  # ends by itself: portions double up to 1, overlaps and steps have a floor
        mating, sampling = changed
        if mated is None or (mating, sampling.query_portion) != last:
            last = (mating, sampling.query_portion)
            queries = durable(queries_of(subjects, mating, sampling, total, other))
            if mating.kernel == "kmer":
                mated = mating_kmer.mates(queries, reads.long_enough(subjects, mating), mating.k)
                mated = mating_kmer.without_errors(durable(mated)) if "p_err" in queries.columns else mated
            else:
                mated = mating_align.mates(queries, subjects, mating, cross=other is not None)
            mated = durable(mated.select("query_id", "mates"))
        hist = mating_kmer.histogram(mated)
        replicates = durable(rarefaction.replicate(hist, rarefaction.grid(subjects.sparkSession, total, sampling), total, sampling))
        summary = rarefaction.summarise(replicates)
        findings = checks.evaluate(summary)
        changed = checks.adjust({r["status"] for r in findings.collect()}, mating, sampling, total) if adjust else None
    meta = {"impl": "rarespan", "version": "1.0", "R": total, "L": mean, "overlap": 100 * mating.overlap, "divide": sampling.factor, "maxL": facts["max_len"]}
    if mating.kernel == "kmer":
        meta |= {"ksize": mating.k, "AL": mean - mating.k + 1}
    return Run(mated, replicates, summary, findings, meta, mating, sampling)


def curve_tables(result: Run, label: str) -> tuple[DataFrame, DataFrame]:
    """A run as curve metadata and points, for the operators on curves."""
    m, spark = result.meta, result.summary.sparkSession
    kernel = result.mating.kernel
    meta = spark.createDataFrame([(label, kernel, float(m["L"]), float(m.get("AL", m["L"])), int(m["R"]), 50.0 if kernel == "kmer" else float(m["overlap"]), float(m["divide"]))], "label string, kernel string, L double, AL double, R long, overlap double, divide double")
    points = result.summary.select(F.lit(label).alias("label"), (F.col("portion") * m["R"]).alias("x_obs"), "avg", "sd", "q1", "q2", "q3")
    return meta, points
