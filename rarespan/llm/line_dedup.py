"""Line dedup: overlapping three-line windows that repeat anywhere lose their later occurrences. [native]

A document's lines that hold a word, trimmed, form every run of three; a run is two 64-bit hashes. The
first occurrence of a run by (doc_id, text hash, position) stays and each later one marks its three lines;
marks of overlapping runs merge as positions of a set, so a repeated passage of any length of three lines
or more goes as a whole. Lines without a word are not counted and stay.

Shuffles: the runs of three once for the count, which combines before it moves, and once for the join with
the repeated runs, which is a plain equi join that adaptive execution may split where one run is very
common; the texts move once, to a sort-merge join by document, whose sides may spill.

Defined results: a null text stays null and has no lines; fewer than three lines form no run; rows that
repeat both doc_id and text are one document, each gets the same result and none is a later occurrence of
another; in A A A A only the first line stays, as runs overlap; ties do not exist, as (doc_id, text hash,
position) orders all occurrences; a very long text has many runs, which are rows of their own, and its lines
are rebuilt in one row; an empty table gives an empty result; other columns pass through, but those named
as the results or gone, _id and _th, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.llm.common import WS_CHARS, cut, let

RUN = 3


def counted_lines(text):
    """The trimmed lines with a word, each with its index among all lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(WS_CHARS)).alias("x"), i.alias("i"))), lambda s: s["x"] != "")


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, j, h1, h2): each run of three lines, by the index j of its first counted line."""

    def hashed(lines):
        three = lambda j: [lines[j + k]["x"] for k in range(RUN)]
        starts = F.sequence(F.lit(0), F.size(lines) - RUN)
        return F.when(F.size(lines) >= RUN, F.transform(starts, lambda j: F.struct(j.alias("j"), F.xxhash64(*three(j)).alias("h1"), F.xxhash64(F.lit("second"), *three(j)).alias("h2"))))

    made = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(let(counted_lines(F.col("text")), hashed)).alias("r"))
    return made.select("doc_id", "th", "r.j", "r.h1", "r.h2")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the counted lines that go, one row per document that loses any."""
    every = runs(docs).withColumn("at", F.struct("doc_id", "th", "j"))
    twice = cut(every.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(F.col("first") != F.col("last")).drop("last"))
    later = every.join(twice, ["h1", "h2"]).where(F.col("at") > F.col("first"))
    covered = lambda js: F.array_distinct(F.flatten(F.transform(js, lambda j: F.sequence(j, j + (RUN - 1)))))
    return later.groupBy("doc_id", "th").agg(covered(F.collect_set("j")).alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text that is left, n_lines and n_removed."""
    gone = removals(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone")
    docs = docs.drop("n_lines", "n_removed", "_id", "_th", "gone")
    rows = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    lines = counted_lines(F.col("text"))

    def rest(gone_at):
        every = F.split(F.col("text"), "\n", -1)
        return let(every, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone_at), lambda i: x[i]), "\n"))

    gone_at = let(lines, lambda x: F.transform(F.col("gone"), lambda j: x[j]["i"]))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(gone_at, rest))
    counts = {"n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    return rows.withColumns(counts | {"text": text}).select(*docs.columns, *counts)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM t),
c AS (
  SELECT doc_id, i, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x, ls[i] AS raw FROM l),
n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM c WHERE x <> ''),
r AS (
  SELECT doc_id, j, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS d FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
k AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY a, b, d ORDER BY doc_id, j) AS occurrence FROM r WHERE d IS NOT NULL),
g AS (
  SELECT DISTINCT doc_id, unnest([j, j + 1, j + 2]) AS j FROM k WHERE occurrence > 1),
z AS (
  SELECT n.doc_id, n.i FROM n JOIN g ON n.doc_id = g.doc_id AND n.j = g.j),
left_over AS (
  SELECT c.doc_id, string_agg(c.raw, chr(10) ORDER BY c.i) AS text FROM c LEFT JOIN z ON c.doc_id = z.doc_id AND c.i = z.i WHERE z.i IS NULL GROUP BY c.doc_id)
SELECT t.doc_id, (SELECT count(*) FROM n WHERE n.doc_id = t.doc_id) AS n_lines, (SELECT count(*) FROM z WHERE z.doc_id = t.doc_id) AS n_removed,
  CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(left_over.text, '')) END AS text_sha256
FROM t LEFT JOIN left_over ON t.doc_id = left_over.doc_id
"""
