"""The engine's functions by SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarespan.config import Mating
from rarespan.functions import gamma


@F.pandas_udf(T.BooleanType())
def is_mate(a: pd.Series, b: pd.Series, overlap: pd.Series, similarity: pd.Series) -> pd.Series:
    """Whether two reads overlap well enough on either strand; null if a value is null, false for an empty read.

    Pairs of equal lengths and thresholds are compared as matrices, a shift at a time.
    """
    from rarespan.operators.mating_align import match_rows, matrix, reversed_strand

    rows = pd.DataFrame({"a": a, "b": b, "overlap": overlap, "similarity": similarity})
    rows["n"], rows["m"] = rows["a"].str.len(), rows["b"].str.len()
    out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
    for (least, alike, n, m), own in rows.dropna().groupby(["overlap", "similarity", "n", "m"]):
        short, long_ = (own["a"].tolist(), own["b"].tolist()) if n < m else (own["b"].tolist(), own["a"].tolist())
        if not short[0]:
            out[own.index] = False
            continue
        mating = Mating(kernel="alignment", overlap=float(least), similarity=float(alike))
        found = match_rows(matrix(short), matrix(long_), mating)
        open_ = ~found
        if open_.any():
            found[open_] = match_rows(matrix([reversed_strand(s, False) for s, o in zip(short, open_) if o]), matrix(long_)[open_], mating)
        out[own.index] = found.astype(object)
    return out


def register(spark: SparkSession) -> None:
    """SQL names: gamma_cdf, gamma_quantile, is_mate, reverse_complement, phred_error."""
    for name, f in (("gamma_cdf", gamma.gamma_cdf), ("gamma_quantile", gamma.gamma_quantile), ("is_mate", is_mate)):
        spark.udf.register(name, f)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(regexp_replace(s, '[^ACGT]', 'N'), 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION phred_error(c STRING) RETURNS DOUBLE RETURN power(10.0D, -(ascii(c) - 33) / 10.0D)")
