"""What a run says about its own curve, and how its parameters may be adjusted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.config import Mating, Sampling

SATURATED = 0.95
#: No grid is made finer than this factor, or than a step of its complement: a flat curve stays flat.
FINEST = 0.999


def evaluate(summary: DataFrame) -> DataFrame:
    """(status, message), one row per finding of (portion_idx, portion, avg, q2, ...)."""
    facts = summary.agg(
        F.min_by("q2", F.when(F.col("portion") > 0.2, F.col("portion_idx"))).alias("q2_at_20"),  # the first point beyond 20%
        F.max_by("avg", "portion_idx").alias("last"),
        F.max(F.when(F.col("portion_idx") == 5, F.col("avg"))).alias("sixth"),
        F.count("*").alias("n"),
    )
    low, high = F.col("q2_at_20") == 0, F.col("last") >= SATURATED
    steep = (F.col("n") > 5) & (F.col("sixth") >= SATURATED)
    found = F.array_compact(
        F.array(
            F.when(low, F.struct(F.lit("low_depth").alias("status"), F.lit("The median is zero at 20% of the reads: query more reads or ask for less overlap.").alias("message"))),
            F.when(high, F.struct(F.lit("high_coverage").alias("status"), F.lit("The coverage is very high; its precise value may be off.").alias("message"))),
            F.when(steep, F.struct(F.lit("low_resolution").alias("status"), F.lit("The curve is nearly saturated in six points or fewer: use a finer grid.").alias("message"))),
            F.when(~F.coalesce(low, F.lit(False)) & ~F.coalesce(steep, F.lit(False)), F.struct(F.lit("ok").alias("status"), F.lit("No finding: the curve can be used.").alias("message"))),
        )
    )
    return facts.select(F.explode(found).alias("f")).select("f.*")


def adjust(statuses: set[str], mating: Mating, sampling: Sampling, total_reads: int) -> tuple[Mating, Sampling] | None:
    """Parameters for another run, or None if these are final. Low depth beyond help is an error."""
    if "low_depth" in statuses:
        x = sampling.queries_for(mating.kernel)
        portion = sampling.query_portion or min(1.0, x / max(1, total_reads))
        if portion < 1 and x < 3000:
            return mating, sampling.with_(query_portion=min(1.0, 2 * portion))
        for lower in (0.75, 0.5, 0.25):
            if mating.overlap > lower:
                return replace(mating, overlap=lower), sampling
        raise ValueError("sequencing depth is under the detection limit")
    if "low_resolution" in statuses:
        if sampling.factor > 0:
            finer = sampling.with_(factor=1 - (1 - sampling.factor) / 2)
        else:
            finer = sampling.with_(step=sampling.step / 2)
        return (mating, finer) if finer.factor < FINEST or finer.step > 1 - FINEST and not finer.factor else None
    return None
