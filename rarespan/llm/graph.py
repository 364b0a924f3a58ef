"""Connected components of a link table, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rarespan.llm.common import cut

#: Rows of links or labels that make a partition; links that one task merges at most (2 MB).
ROWS, LAST = 1 << 13, 1 << 17


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of `rows` rows at most, in no more partitions than these fill: each task of a shuffle or a table leaves files, however few its rows."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """df, cut, and the number of its rows, which the same run of the plan counts."""
    seen = Observation()
    df = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get["n"]


def counted(df: DataFrame) -> DataFrame:
    """df, cut, in partitions by the number of its rows."""
    return packed(*cut_and_count(df))


def scramble(x: Column) -> Column:
    """The number with its 64 bits in reverse order: a bijection that is its own inverse."""
    return F.conv(F.reverse(F.lpad(F.bin(x), 64, "0")), 2, -10).cast("long")


def merged(links: DataFrame) -> DataFrame:
    """(v, t) of links (a, b), LAST at most: t is the least node that links reach from v."""

    def run(batches):
        ends = [np.concatenate([b.column(i).to_numpy() for i in range(2)]).reshape(2, -1) for b in batches]
        v, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
        (a, b), t = at.reshape(2, -1), np.arange(len(v))
        while (t[a] != t[b]).any():
            np.minimum.at(t, np.maximum(t[a], t[b]), np.minimum(t[a], t[b]))
            while (t[t] != t).any():
                t = t[t]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(v[t])], ["v", "t"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "v long, t long")


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, comp): comp is the least node that links reach; nodes without a link are not returned.

    Each round points every node at the least of itself and its neighbours in a scrambled order, follows the
    pointer once more, and replaces the ends of links by what they point at; links inside a node vanish. The
    order is that of the reversed bits, so that a chain of consecutive ids loses every other node in a round
    and rounds grow with the logarithm of its length. A round moves
    links and labels only, in partitions by their number, and each table is cut. Once LAST links are left, one task
    merges them: a round's plans cost the driver the same for few links as for many. The result is cut.
    """
    edges = links.where(F.col("a") != F.col("b"))
    edges, n = cut_and_count(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if n <= LAST:
        return cut(merged(edges).select(F.col("v").alias("node"), F.col("t").alias("comp")))
    edges = edges.select(scramble(F.col("a")).alias("a"), scramble(F.col("b")).alias("b"))
    labels, nodes = None, 2 * n
    while n:
        edges = packed(edges, n)
        if n <= LAST:
            to, n = cut(merged(edges)), 0
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            to = cut(packed(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("t")), 2 * n))
            jump = to.select(F.col("v").alias("t"), F.col("t").alias("t2"))
            to = cut(packed(to.join(jump, "t", "left").select("v", F.coalesce("t2", "t").alias("t")), 2 * n))
            a, b = to.select(F.col("v").alias("a"), F.col("t").alias("ta")), to.select(F.col("v").alias("b"), F.col("t").alias("tb"))
            edges = packed(packed(edges.join(a, "a"), n).join(b, "b").where(F.col("ta") != F.col("tb")), n)
            edges, n = cut_and_count(packed(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), n))
        if labels is None:
            labels = to.select(F.col("v").alias("node"), F.col("t").alias("root"))
        else:
            labels = cut(packed(labels.join(to, F.col("root") == F.col("v"), "left").select("node", F.coalesce("t", "root").alias("root")), nodes))
    labels = cut(labels.select(scramble(F.col("node")).alias("node"), "root"))
    least = cut(packed(labels.groupBy("root").agg(F.min("node").alias("comp")), nodes))
    return cut(packed(labels.join(least, "root").select("node", "comp"), nodes))
