"""Lookups on an ontology: terms, paths, parents, depth and distance to a common ancestor.

Tables: term (id, name, term_type, acc, is_obsolete, is_root, is_relation), graph_path (id, term1_id,
term2_id, relationship_type_id, distance, relation_distance), term2term (id, relationship_type_id,
term1_id, term2_id, complete), term2term_metadata and term_subset. term1 is the ancestor of term2.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Short names of the domains (fixed values).
DOMAINS = {"biological_process": "P", "molecular_function": "F", "cellular_component": "C"}


def accession(number: int) -> str:
    return f"GO:{number:07d}"


def domain(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(acc, domain) of asked (acc): the term type, by its short name if it has one; an unknown accession is an error."""
    short = F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv))
    both = asked.select("acc").join(terms.select("acc", "term_type"), "acc", "left")
    return both.select("acc", F.coalesce(F.element_at(short, F.col("term_type")), F.col("term_type"), F.raise_error("unknown accession").cast("string")).alias("domain"))


def depth(paths: DataFrame, terms: DataFrame, relationship: int = 1) -> DataFrame:
    """(acc, depth): the least distance from a root; a term on several paths has one depth."""
    roots = terms.where(F.col("is_root") == 1).select(F.col("id").alias("term1_id"))
    below = paths.where(F.col("relationship_type_id") == relationship).join(roots, "term1_id")
    return below.join(terms.select(F.col("id").alias("term2_id"), "acc"), "term2_id").groupBy("acc").agg(F.min("distance").alias("depth"))


def parents(paths: DataFrame, terms: DataFrame, asked: DataFrame | None = None, relationship: int = 1) -> DataFrame:
    """(acc, parent_acc) of all terms, or of asked (acc)."""
    step = paths.where((F.col("relationship_type_id") == relationship) & (F.col("distance") == 1)).select("term1_id", "term2_id").distinct()
    child, parent = terms.select(F.col("id").alias("term2_id"), "acc"), terms.select(F.col("id").alias("term1_id"), F.col("acc").alias("parent_acc"))
    out = step.join(child, "term2_id").join(parent, "term1_id").select("acc", "parent_acc")
    return out if asked is None else out.join(asked.select("acc"), "acc", "left_semi")


def parent_sets(paths: DataFrame, terms: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(acc, parents array), sorted."""
    return parents(paths, terms, asked).groupBy("acc").agg(F.array_sort(F.collect_set("parent_acc")).alias("parents"))


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, acc, level): every ancestor with its least level; edges (acc, parent_acc), start (acc).

    Climbs level by level; a level is written once and holds what no lower one has, so cycles end, and what was found before is
    never written again.
    """
    from rarespan.operators.iterate import durable

    levels = [durable(start.select(F.col("acc").alias("start"), "acc", F.lit(0).alias("level")).distinct())]
    edges = durable(edges.distinct())
    for level in count(1):
        found = reduce(DataFrame.unionByName, levels)
        up = levels[-1].join(edges, "acc").select("start", F.col("parent_acc").alias("acc")).distinct()
        front = durable(up.join(found.select("start", "acc"), ["start", "acc"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return found
        levels.append(front)


def distance(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): levels to climb from both until the ancestor sets meet; null if they never do."""
    up = ancestors(edges, pairs.select(F.col("a").alias("acc")).union(pairs.select(F.col("b").alias("acc"))).distinct())
    of_a = up.select(F.col("start").alias("a"), "acc", F.col("level").alias("la"))
    of_b = up.select(F.col("start").alias("b"), "acc", F.col("level").alias("lb"))
    met = pairs.select("a", "b").join(of_a, "a").join(of_b, ["b", "acc"]).groupBy("a", "b").agg(F.min(F.greatest("la", "lb")).alias("distance"))
    return pairs.select("a", "b").join(met, ["a", "b"], "left")


def common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, acc): ancestors, the terms themselves included, of both."""
    up = ancestors(edges, pairs.select(F.col("a").alias("acc")).union(pairs.select(F.col("b").alias("acc"))).distinct())
    of_a, of_b = up.select(F.col("start").alias("a"), "acc"), up.select(F.col("start").alias("b"), "acc")
    return pairs.select("a", "b").join(of_a, "a").join(of_b, ["b", "acc"]).select("a", "b", "acc").distinct()


def union_distinct(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).distinct()
