"""Curves: redundancy to coverage, adjusted effort, consistency, the gamma model, diversity and projections.

A curve is the rows of one label in a points table (label, x_obs, avg, sd, q1, q2, q3) and one row of a
metadata table (label, kernel, L, AL, R, overlap, divide). Sets of curves are such tables with more labels;
every operator works by label, so many curves run as independent groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarespan.functions import gamma
from rarespan.operators import solver

#: Exponents of the deviation used as weights, in the order tried (fixed values).
LOG_WEIGHTS = (0.0, 1.0, -1.0, 1.3, -1.1, 1.5, -1.5, 3.0, -3.0)
LINEAR_WEIGHTS = (-1.1, -1.2, -0.9, -1.3, -1.0)
#: Half-widths of dispersion bands in deviations (fixed values).
BANDS = {"sd": 1.0, "ci95": 1.9, "ci90": 1.64, "ci50": 0.67}


def coverage_factor(overlap: Column) -> Column:
    return F.lit(1.0) - F.exp(F.lit(2.23e-2) * overlap - F.lit(3.5698))


def effort(meta: DataFrame) -> DataFrame:
    """Metadata with LR, the sequencing effort in bases."""
    return meta.withColumn("LR", F.col("R") * F.col("L"))


def points(raw: DataFrame, meta: DataFrame, corrected: bool = True) -> DataFrame:
    """(label, i, x_obs, x_adj, red, cov, sd, p25, p50, p75); i counts from 1 by x_obs. Deviations and quartiles take the same power as the mean."""
    both = raw.join(meta.select("label", "AL", "R", "overlap"), "label")
    power = coverage_factor(F.col("overlap")) if corrected else F.lit(1.0)
    by, whole = W.partitionBy("label").orderBy("x_obs"), W.partitionBy("label")
    out = both.select("label", "x_obs", "AL", "R", F.row_number().over(by).alias("i"), F.col("avg").alias("red"), *(F.pow(F.col(a), power).alias(b) for a, b in (("avg", "cov"), ("sd", "sd"), ("q1", "p25"), ("q2", "p50"), ("q3", "p75"))))
    log_x, top = F.ln("x_obs"), F.ln(F.max("x_obs").over(whole))
    last = F.max_by("cov", "x_obs").over(whole)
    adjusted = F.when(F.col("x_obs") > 0, F.exp(top + F.pow(last, F.lit(0.27)) * (log_x - top))).otherwise(F.lit(0.0))
    out = out.withColumn("x_adj", adjusted)
    out = out.withColumn("x_adj", F.col("x_adj") * F.col("AL") * F.col("R") / F.max("x_adj").over(whole))
    return out.select("label", "i", "x_obs", "x_adj", "red", "cov", "sd", "p25", "p50", "p75")


#: Names of the consistency checks, in order, and what they say.
CHECKS = {
    "median_zero": "The median is zero at half of the reads: try a smaller overlap.",
    "too_low": "The redundancy is too low: try a smaller overlap.",
    "too_steep": "The curve is too steep: try a larger factor of the grid.",
    "few_points": "Too few points below 90% coverage: try a larger factor of the grid.",
}


def checks(pts: DataFrame) -> DataFrame:
    """(label, kappa, C, median_zero, too_low, too_steep, few_points, consistent, warnings)."""
    half = F.max("x_adj").over(W.partitionBy("label")) * 0.5
    marked = pts.withColumn("at_half", F.when(F.col("x_adj") <= half, F.col("x_adj")))
    out = marked.groupBy("label").agg(
        F.max_by("red", "x_obs").alias("kappa"),
        F.max_by("cov", "x_obs").alias("C"),
        (F.coalesce(F.max_by("p50", "at_half"), F.max_by("p50", "x_obs")) == 0).alias("median_zero"),
        (F.max_by("red", "x_obs") <= 1e-5).alias("too_low"),
        (F.coalesce(F.max(F.when(F.col("i") == 2, F.col("cov"))), F.lit(0.0)) >= 1 - 1e-5).alias("too_steep"),
        (F.count_if((F.col("cov") > 0) & (F.col("cov") < 0.9)) <= 10).alias("few_points"),
    )
    warnings = F.array_compact(F.array(*(F.when(F.col(name), F.lit(text)) for name, text in CHECKS.items())))
    return out.withColumn("warnings", warnings).withColumn("consistent", F.size("warnings") == 0)


FIT = "label string, has_model boolean, a double, b double, weight_exp double, sse double, diversity double, LRstar double, modelR double"


def fit(pts: DataFrame, meta: DataFrame, star: float = 95.0, weights: tuple[float, ...] | None = None, enforce: bool = True, cells: int = 1 << 20) -> DataFrame:
    """(label, has_model, a, b, weight_exp, sse, diversity, LRstar, modelR); the curves of a batch are solved together, `cells` padded points at a time."""
    asked = checks(pts).select("label", "consistent")
    rows = pts.where((F.col("cov") > 0) & (F.col("cov") < 0.9)).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("x_adj", "cov", "sd"))).alias("p"))
    rows = meta.select("label", "divide").join(asked, "label", "left").join(rows, "label", "left")
    columns = [c.split()[0] for c in FIT.split(", ")]

    def run(batches):
        for b in batches:
            length = b["p"].map(lambda p: 0 if p is None else len(p))
            b = b.iloc[np.argsort(length, kind="stable")]  # curves of like length share a matrix
            size = max(1, cells // max(1, int(length.max() if len(b) else 1)))
            for lo in range(0, len(b), size):
                yield fitted(b.iloc[lo : lo + size], star, weights, enforce)[columns]

    return rows.mapInPandas(run, FIT)


def fitted(b: pd.DataFrame, star: float, weights: tuple[float, ...] | None, enforce: bool) -> pd.DataFrame:
    """The models of curves (label, divide, consistent, p): of the exponents in their order the first that converges."""
    kept = [p if p is not None and (ok is True or ok is np.True_ or not enforce) else () for p, ok in zip(b["p"], b["consistent"])]
    x, y, sd = (solver.padded([np.array([q[k] for q in p], float) for p in kept], 1.0) for k in ("x_adj", "cov", "sd"))
    inside = solver.padded([np.ones(len(p)) for p in kept], 0.0) > 0
    logarithmic = np.array([bool(d) and not pd.isna(d) for d in b["divide"]], bool)
    ab, exponent = np.full((len(b), 2), np.nan), np.full(len(b), np.nan)
    for chosen, tried in ((np.ones(len(b), bool), weights),) if weights else ((logarithmic, LOG_WEIGHTS), (~logarithmic, LINEAR_WEIGHTS)):
        for e in tried:
            open_ = np.flatnonzero(chosen & np.isnan(ab[:, 0]))
            if not len(open_):
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                w = sd[open_] ** e
            ab[open_] = solver.solve(x[open_], y[open_], w, inside[open_])
            exponent[open_] = np.where(np.isnan(ab[open_, 0]), np.nan, e)
    out = pd.DataFrame({"label": b["label"].to_numpy(), "has_model": ~np.isnan(ab[:, 0]), "a": ab[:, 0], "b": ab[:, 1], "weight_exp": exponent})
    z = np.where(inside, gamma.model(x, ab[:, :1], ab[:, 1:]), 0.0)
    observed, n = np.where(inside, y, 0.0), np.maximum(1, inside.sum(axis=1))[:, None]
    out["sse"] = np.where(out["has_model"], ((observed - z) ** 2).sum(axis=1), np.nan)
    out["diversity"] = np.where(ab[:, 0] > 1, (ab[:, 0] - 1) / ab[:, 1], np.where(out["has_model"], 0.0, np.nan))
    known = out["has_model"].to_numpy()
    out["LRstar"] = np.nan
    with np.errstate(over="ignore"):
        out.loc[known, "LRstar"] = np.expm1(gamma.quantile(np.full(known.sum(), star / 100), ab[known, 0], ab[known, 1]))
    dy, dz = (np.where(inside, v - v.sum(axis=1, keepdims=True) / n, 0.0) for v in (observed, z))
    with np.errstate(divide="ignore", invalid="ignore"):
        out["modelR"] = (dy * dz).sum(axis=1) / np.sqrt((dy * dy).sum(axis=1) * (dz * dz).sum(axis=1))
    numbers = ["a", "b", "weight_exp", "sse", "diversity", "LRstar", "modelR"]
    out[numbers] = out[numbers].astype(object).where(out["has_model"], None)
    return out


def fit_on_grid(pts: DataFrame, grid: DataFrame) -> DataFrame:
    """(label, a, b, sse): the pair of a grid (a, b) with the least squares, ties to the least (a, b)."""
    inside = pts.where((F.col("cov") > 0) & (F.col("cov") < 0.9)).select("label", "x_adj", "cov")
    both = inside.crossJoin(F.broadcast(grid))  # the grid is a parameter
    both = both.withColumn("z", gamma.gamma_cdf(F.log1p("x_adj"), "a", "b"))
    sse = both.groupBy("label", "a", "b").agg(F.sum((F.col("cov") - F.col("z")) * (F.col("cov") - F.col("z"))).alias("sse"))
    best = sse.groupBy("label").agg(F.min(F.struct(F.round("sse", 9).alias("sse"), "a", "b")).alias("best"))
    return best.select("label", "best.a", "best.b", "best.sse")


def summary(pts: DataFrame, meta: DataFrame, params: DataFrame) -> DataFrame:
    """(label, kappa, C, LR, modelR, LRstar, diversity)."""
    out = checks(pts).select("label", "kappa", "C").join(effort(meta).select("label", "LR"), "label").join(params, "label", "left")
    return out.select("label", "kappa", "C", "LR", "modelR", "LRstar", "diversity")


def predict(params: DataFrame, efforts: DataFrame) -> DataFrame:
    """(label, effort, coverage) of efforts (label, effort); a label without a model is an error."""
    both = efforts.join(params.select("label", "a", "b"), "label", "left")
    a = F.coalesce("a", F.raise_error("no model for a label").cast("double"))
    return both.select("label", "effort", gamma.gamma_cdf(F.log1p("effort"), a, F.col("b")).alias("coverage"))


def bands(pts: DataFrame, kind: str = "sd", floor: float = 1e-7) -> DataFrame:
    """(label, i, x_adj, lower, upper) of a dispersion; 'iq' is the quartiles."""
    if kind == "iq":
        low, high = F.col("p25"), F.col("p75")
    else:
        low, high = F.col("cov") - BANDS[kind] * F.col("sd"), F.col("cov") + BANDS[kind] * F.col("sd")
    return pts.select("label", "i", "x_adj", F.greatest(low, F.lit(floor)).alias("lower"), high.alias("upper"))


def add(one: DataFrame, other: DataFrame) -> DataFrame:
    """A set of curves with the curves of another."""
    return one.unionByName(other)


def model_efforts(pts: DataFrame, n: int = 1000, low: float = 1e3) -> DataFrame:
    """(label, i, effort): n log-spaced efforts, up to ten times the last one to one significant digit."""
    top = pts.groupBy("label").agg((10 * F.max("x_adj")).alias("t")).where("t > 0")
    power = F.pow(F.lit(10.0), F.floor(F.log10("t")).cast("double"))
    top = top.select("label", (F.round(F.col("t") / power) * power).alias("t"))
    at = top.select("label", "t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return at.select("label", "i", F.exp(F.ln(F.lit(low)) + (F.ln("t") - F.ln(F.lit(low))) * F.col("i") / F.lit(n - 1)).alias("effort"))


def plot_series(pts: DataFrame, params: DataFrame) -> DataFrame:
    """(label, series, x, y): what a plot draws as lines."""
    seen = pts.select("label", F.lit("observed").alias("series"), F.col("x_adj").alias("x"), F.col("cov").alias("y"))
    fitted = model_efforts(pts).join(params.where("has_model").select("label"), "label", "left_semi")
    made = predict(params, fitted.select("label", "effort"))
    return seen.unionByName(made.select("label", F.lit("model").alias("series"), F.col("effort").alias("x"), F.col("coverage").alias("y")))


def plot_guides(params: DataFrame, star: float = 95.0) -> DataFrame:
    """(label, guide, value): full coverage, the target, powers of a thousand bases, and each diversity as an effort."""
    spark = params.sparkSession
    fixed = [(None, "coverage", 1.0), (None, "target", star / 100), *((None, "effort", 10.0**e) for e in range(0, 16, 3))]
    lines = spark.createDataFrame(fixed, "label string, guide string, value double")
    return lines.unionByName(params.where("has_model").select("label", F.lit("diversity").alias("guide"), F.exp("diversity").alias("value")))


def to_json(pts: DataFrame, meta: DataFrame, params: DataFrame, star: float = 95.0) -> DataFrame:
    """(label, json): the slots of each curve by their public names, and the model's 1000 points if it has one."""
    vectors = pts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x_obs", "x_adj", "red", "cov", "sd", "p25", "p50", "p75"))).alias("v"))
    vectors = vectors.select("label", *(F.col(f"v.{a}").alias(b) for a, b in (("x_obs", "x.obs"), ("x_adj", "x.adj"), ("red", "y.red"), ("cov", "y.cov"), ("sd", "y.sd"), ("p25", "y.p25"), ("p50", "y.p50"), ("p75", "y.p75"))))
    fitted = model_efforts(pts).join(params.where("has_model").select("label"), "label", "left_semi")
    made = predict(params, fitted.select("label", "effort"))
    made = made.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("effort", "coverage"))).alias("m")).select("label", F.col("m.effort").alias("x.model"), F.col("m.coverage").alias("y.model"))
    every = effort(meta).join(checks(pts), "label").join(params, "label", "left").join(vectors, "label").join(made, "label", "left")
    given = lambda c, t: F.col(c) if c in every.columns else F.lit(None).cast(t).alias(c)
    slots = [given("file", "string"), F.col("label"), given("col", "string"), F.col("L"), F.col("AL"), F.col("R"), F.col("LR"), F.col("overlap"), given("ksize", "int"), F.col("divide").alias("log.sample"), F.col("kernel"), given("version", "string")]
    slots += [F.col(f"`{c}`") for c in vectors.columns[1:]]
    slots += [F.col("kappa"), F.col("C"), F.col("consistent"), F.lit(star).alias("star"), F.coalesce("has_model", F.lit(False)).alias("has.model"), F.col("warnings").alias("warning"), given("LRstar", "double"), given("modelR", "double"), given("diversity", "double"), F.col("`x.model`"), F.col("`y.model`")]
    return every.select("label", F.to_json(F.struct(*slots), {"ignoreNullFields": "false"}).alias("json"))
