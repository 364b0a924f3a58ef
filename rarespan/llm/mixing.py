"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u from a hash of its id and text and gets the key -ln(u) / quality, so that a smaller
key comes first and better documents tend to come first. A source's target is a number of words: whole
epochs take each of its documents that many times, and the fraction left takes documents in the order of
(key, doc_id, size, hash of the text) until the prefix sum of their words meets the budget; the row at the
edge gives its first words.

The order is never built for a whole source. Keys fall into ranges, STEPS to a factor of two: whatever the
qualities, an exponential key lies in one range with a probability below 1/1000, as each quality's density
over ln(key) is at most 1/e. A histogram of words per (source, range) is summed to find the range that
holds the edge, and only the distinct rows of that range are sorted. What comes out is one tuple per source,
the edge; every row compares itself with it. Equal rows share a tuple; if the edge falls among them they are
numbered by the partitions they lie in, so that a source of one row repeated is not numbered in one task.

Defined results: null or empty texts have size 0 and are taken 0 words; a null source is a source of its own,
ordered last; rows that repeat a doc_id, null ones too, are rows of their own, and of equal rows of a source
(doc_id and text) as many are taken as the budget allows, whichever these are; very long texts are one row
like others, of which the first words may be taken; an empty table gives an empty result. Columns that have
the name of a result or of INTERNAL are dropped from the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rarespan.llm.common import WS, cut, symbol_count, word_count

WEIGHTS, SHARE, CAP, STEPS, SEED = (5, 2, 1), 1.5, 2.0, 256, "mix-2"
#: Columns of the operator; the input's of these names are dropped.
INTERNAL = ("key", "digest", "bucket", "left", "before", "edge", "room", "at_key", "at_id", "at_size", "at_digest", "copies", "side", "part", "nth", "earlier", "t_source", "size", "source_size", "target", "epochs", "taken")
RESULT = ("size", "source_size", "target", "epochs", "taken")


def uniform(seed: str, doc_id: Column, digest: Column) -> Column:
    """In (0, 1), the same on each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.1 (symbols everywhere) to 1."""
    ratio = F.least(F.lit(1.0), 10.0 * symbol_count(text).cast("double") / F.greatest(size, F.lit(1)).cast("double"))
    return F.lit(0.1) + F.lit(0.9) * (F.lit(1.0) - ratio)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source.

    Water filling: sources in order of cap per weight are full until the level, what is left per weight,
    is below the cap of the next.
    """
    everyone, first = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(first) - 1, F.lit(len(weights))) + 1).cast("double"))
    out = out.withColumns({"full": cap * F.col("source_size").cast("double"), "all_w": F.sum("w").over(everyone), "budget": share * F.sum("source_size").over(everyone).cast("double")})
    before = W.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    out = out.withColumn("capped", F.col("level") * F.col("w") >= F.col("full"))
    out = out.withColumn("at", F.max(F.when(~F.col("capped"), F.col("level"))).over(everyone))
    return out.select("source", "source_size", F.when(F.col("capped"), F.col("full")).otherwise(F.col("at") * F.col("w")).alias("target"))


def keyed(docs: DataFrame, seed: str = SEED, steps: int = STEPS) -> DataFrame:
    """docs with size, digest, key and the key's bucket."""
    rows = docs.withColumns({"size": word_count(F.col("text")), "digest": F.md5(F.coalesce("text", F.lit("")))})
    rows = rows.withColumn("key", -F.log(uniform(seed, F.col("doc_id"), F.col("digest"))) / quality_weight(F.col("text"), F.col("size")))
    return rows.withColumn("bucket", F.floor(F.log("key") * (steps / 0.6931471805599453)).cast("int"))


def per_source(rows: DataFrame, table: DataFrame, few: int = 100_000) -> DataFrame:
    """rows joined with a table of one row per source, sent whole if it is known to have few rows."""
    table = cut(table.withColumnRenamed("source", "t_source"))
    table = F.broadcast(table) if table.count() <= few else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def edges(narrow: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, target, epochs, and the place where its fraction ends, (at_key, at_id, at_size, at_digest) with room words left for the equal rows there."""
    words = cut(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    targets = source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", whole)
    targets = cut(targets.withColumn("left", F.floor(F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")).cast("long")))
    sums = words.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words"))
    holder = per_source(sums, targets.select("source", "left")).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    holder = holder.select("source", F.col("bucket").alias("edge"), (F.col("left") - F.col("before")).alias("room"))
    inside = per_source(narrow, holder).where(F.col("bucket") == F.col("edge"))
    order = ("key", "doc_id", "size", "digest")
    groups = inside.groupBy("source", *order, "room").agg(F.count("*").alias("copies"))
    prefix = W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("room", F.col("room") - F.coalesce(F.sum(F.col("copies") * F.col("size")).over(prefix), F.lit(0)))
    at = groups.where((F.col("room") >= 0) & (F.col("room") < F.col("copies") * F.col("size")))
    at = at.select(F.col("source").alias("t_source"), F.col("key").alias("at_key"), F.col("doc_id").alias("at_id"), F.col("size").alias("at_size"), F.col("digest").alias("at_digest"), "room", "copies")
    return targets.drop("left").join(at, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with earlier: how many rows of their source come before them here, counted by the partitions that hold them."""
    rows = cut(rows.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}))
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).select(F.col("source").alias("t_source"), F.col("part").alias("t_part"), "before")
    own = F.row_number().over(W.partitionBy("source", "part").orderBy("nth")) - 1
    both = rows.withColumn("earlier", own).join(parts, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("part") == F.col("t_part")))
    return both.withColumn("earlier", F.col("earlier") + F.col("before")).drop("t_source", "t_part", "before", "part", "nth")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, whole_rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken), one row per row of docs; whole_rows: docs with these.

    With whole_rows the texts are read again and meet per-source facts; only rows equal to an edge's are moved.
    """
    docs = docs.drop(*INTERNAL) if whole_rows else docs.select("doc_id", "source", "text")
    narrow = cut(keyed(docs, seed).select("doc_id", "source", "size", "digest", "key", "bucket"))
    facts = cut(edges(narrow, weights, share, cap))
    keys = lambda df: keyed(df, seed) if whole_rows else df
    own, at = F.struct("key", "doc_id", "size", "digest"), F.struct("at_key", "at_id", "at_size", "at_digest")
    side = F.when(F.col("at_key").isNull(), F.lit(0)).when(own < at, F.lit(-1)).when(own > at, F.lit(1)).otherwise(F.lit(0))
    every = per_source(keys(docs if whole_rows else narrow), facts).withColumns({"side": side, "earlier": F.lit(0).cast("long")})
    if not facts.where("copies > 1").isEmpty():
        tied = (F.col("side") == 0) & (F.col("copies") > 1)
        near = per_source(docs if whole_rows else narrow, facts.where("copies > 1")).where(F.col("doc_id").eqNullSafe(F.col("at_id")))
        every = every.where(~F.coalesce(tied, F.lit(False))).unionByName(numbered(keys(near).withColumn("side", side).where(tied)))
    room = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("earlier") * F.col("size")))
    extra = F.when(F.col("at_key").isNull() | (F.col("side") > 0), F.lit(0)).when(F.col("side") < 0, F.col("size")).otherwise(room)
    out = every.withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))
    return out.select(*(docs.columns if whole_rows else ["doc_id", "source"]), *RESULT)


def copies(size: Column, taken: Column) -> Column:
    """Times that a whole document appears in the mix: the taken words, rounded to whole documents."""
    return F.when(size > 0, F.floor(taken / size + 0.5)).otherwise(F.lit(0)).cast("int")


ORACLE = rf"""
WITH n AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda y: y <> ''))::BIGINT AS size,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::DOUBLE AS sym,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (
  SELECT doc_id, source, size, -ln(u) / (0.1::DOUBLE + 0.9::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, 10.0::DOUBLE * sym / greatest(size, 1)::DOUBLE))) AS key FROM n),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM k GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((rn - 1) % 3) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0::DOUBLE)) AS lev
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN lev * w >= cap THEN cap ELSE (max(CASE WHEN lev * w < cap THEN lev END) OVER ()) * w END AS target FROM v),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
f AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target - (e.epochs * e.source_size)::DOUBLE)::BIGINT AS lft,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, lft - before)))::BIGINT AS taken FROM f
"""
