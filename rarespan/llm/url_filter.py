"""URL filters: rules by longest match, and a Bloom filter cascade for a list of keys.

A key is a url's host and path. The cascade gives exact membership over a known key universe without a join:
level 0 is a Bloom filter of the listed keys, level 1 one of the universe's keys that level 0 passes by mistake,
level 2 one of the listed keys that level 1 passes by mistake, and so on until a level makes no mistake. A key
is listed if the first level that rejects it is an odd one.

The universe is every distinct key of the corpus, so no key that is ever asked is outside it. Levels are built by
jobs over distinct keys, as tables of 64-bit words whose sizes are known before they are gathered: about
1.44 * log2(1 / p) bits a key. Keys are dealt to shards by hash, as many as it takes for a shard's cascade to stay
below `max_bytes`; shards are built, broadcast and asked one after the other, each over its own rows. One
shard is the usual case, and needs no writing.

The production list is a rule over the corpus: keys of pages whose title is junk, a run of symbols in it, and all keys of
hosts of at least HOST_PAGES pages of which at least HOST_SHARE are junk. Hosts are counted with a map-side combine and
join back by name, which adaptive execution may split where a host has many pages.

Defined results: a null url and one without :// have an empty host and path, fit no rule, are in no list
and are allowed; of rules of equal length that fit, the later one in the table counts; repeated rows are
judged alike; a very long url is a key like others; an empty table or an empty list gives a cascade of no
levels, in which nothing is listed; only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rarespan.llm.common import cut, new_folder, remove

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the production rules (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The production list: what a junk page's title holds; the least pages of a host that is judged, and the share of junk that lists it.
JUNK_TITLE = r"<title>[^<]*[#*$%]{3}"
HOST_PAGES, HOST_SHARE = 10, 0.04


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def spots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """(k, rows) bit positions; each level has hashes of its own."""
    with np.errstate(over="ignore"):
        a = h1.astype(np.uint64) * np.uint64(2 * level + 0x9E3779B97F4A7C15 | 1)
        b = (h2.astype(np.uint64) + np.uint64(level)) * np.uint64(0xC2B2AE3D27D4EB4F)
        a ^= a >> np.uint64(29)
        b ^= b >> np.uint64(31)
        steps = np.arange(k, dtype=np.uint64)[:, None]
        return ((a + steps * (b | np.uint64(1))) >> np.uint64(11)) % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    bits: int
    k: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = spots(h1, h2, level, self.bits, self.k)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0) if len(h1) else np.zeros(0, bool)


def listed_by(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for i, level in enumerate(levels):
        hit = level.has(h1[open_], h2[open_], i)
        out[open_[~hit]] = i % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def encode(keys: DataFrame, n: int, level: int, p: float) -> Level:
    """A Bloom filter of keys (h1, h2): bits are set by tasks, or-ed by word, and gathered as words."""
    bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / p) / 64) * 64)
    k = max(1, round(math.log2(1 / p)))

    def words(batches):
        for b in batches:
            at = spots(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits, k).ravel()
            yield pd.DataFrame({"w": (at >> np.uint64(6)).astype(np.int64), "m": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = keys.select("h1", "h2").mapInPandas(words, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["w"].to_numpy()] = rows["m"].to_numpy().astype(np.int64).view(np.uint64)
    return Level(bits, k, table)


def passed(keys: DataFrame, level: Level, i: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def has(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h1.to_numpy(), h2.to_numpy(), i))

    return keys.where(has("h1", "h2"))


def first_rate(n_in: int, n_out: int) -> float:
    return min(0.5, max(1e-6, math.sqrt(0.5) * n_in / max(1, n_out)))


def expected_bytes(n_in: int, n_out: int) -> float:
    """Of a whole cascade: later levels halve what is left, two levels at a time."""
    p = first_rate(n_in, n_out)
    return 1.4427 / 8 * (n_in * math.log2(1 / p) + 2 * (p * n_out + n_in / 2))


def counts(universe: DataFrame) -> tuple[int, int]:
    n = {bool(r["listed"]): r["count"] for r in universe.groupBy("listed").count().collect()}
    return n.get(True, 0), n.get(False, 0)


def build(universe: DataFrame, first_p: float | None = None, most: int = 64) -> list[Level]:
    """The cascade of a universe (h1, h2, listed) of distinct keys."""
    inside, outside, levels = universe.where("listed"), universe.where(~F.col("listed")), []
    n_in, n_out = counts(universe)
    p = first_p or first_rate(n_in, n_out)
    while n_in:
        if len(levels) == most:
            raise RuntimeError("two keys of the universe share both hashes")
        level = encode(inside, n_in, len(levels), p)
        wrong = cut(passed(outside, level, len(levels)))
        levels.append(level)
        inside, outside, n_in, n_out, p = wrong, inside, wrong.count(), n_in, 0.5
    return levels


def membership(rows: DataFrame, levels: list[Level]) -> DataFrame:
    """rows (h1, h2, ...) with the boolean `listed`."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(listed_by(shared.value, h1.to_numpy(), h2.to_numpy()))

    return rows.withColumn("listed", listed("h1", "h2"))


def exact_members(rows: DataFrame, universe: DataFrame, max_bytes: int) -> DataFrame:
    """rows (h1, h2, ...) with `listed`, by as many cascades as it takes; universe is (h1, h2, listed)."""
    universe = cut(universe.select("h1", "h2", "listed").distinct())
    shards = max(1, math.ceil(expected_bytes(*counts(universe)) / max_bytes))
    if shards == 1:
        return membership(rows, build(universe))
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "shards")
    own = F.pmod("h2", F.lit(shards)).cast("int")
    for name, df in (("rows", rows), ("universe", universe)):  # each is read once, shard by shard
        df.withColumn("shard", own).write.partitionBy("shard").parquet(f"{folder}/{name}")
    for k in range(shards):
        if rows_in(spark, f"{folder}/rows/shard={k}"):
            part, keys = (spark.read.schema(df.schema).parquet(f"{folder}/{name}/shard={k}") for name, df in (("rows", rows), ("universe", universe)))
            membership(part, build(keys)).write.parquet(f"{folder}/listed/{k}")
    remove(spark, f"{folder}/rows")
    remove(spark, f"{folder}/universe")
    return spark.read.schema(StructType([*rows.schema, StructField("listed", BooleanType())])).parquet(f"{folder}/listed/*")


def rows_in(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def list_of(rows: DataFrame, least: int = HOST_PAGES, share: float = HOST_SHARE) -> DataFrame:
    """(h1, h2, listed) of (host, html, h1, h2): the production list; a key is listed if one of its pages is."""
    pages = rows.select("h1", "h2", "host", ((F.col("host") != "") & F.coalesce(F.col("html").rlike(JUNK_TITLE), F.lit(False))).alias("junk"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if("junk").alias("bad"))
    hosts = hosts.where((F.col("n") >= least) & (F.col("bad") >= share * F.col("n"))).select(F.col("host").alias("_host"))
    keys = pages.groupBy("h1", "h2", "host").agg(F.max("junk").alias("junk"))
    keys = keys.join(hosts, F.col("host") == F.col("_host"), "left")
    return keys.groupBy("h1", "h2").agg(F.max(F.col("junk") | F.col("_host").isNotNull()).alias("listed"))


def judge(spark: SparkSession, pages: DataFrame, listing=list_of, rules=RULES, max_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict); listing gives (h1, h2, listed) of rows (host, html, h1, h2)."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    rows = rows.withColumns(dict(zip(("h1", "h2"), hashes(F.concat("host", "path")))))
    rows = exact_members(rows.drop("html"), listing(rows), max_bytes)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


ORACLE = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
j AS (
  SELECT host || path AS key, host, host <> '' AND coalesce(regexp_matches(html, '{JUNK_TITLE}'), FALSE) AS junk FROM u),
b AS (
  SELECT host FROM j WHERE host <> '' GROUP BY host HAVING count(*) >= {HOST_PAGES} AND count(*) FILTER (junk) >= {HOST_SHARE} * count(*)),
k AS (
  SELECT key, bool_or(junk OR host IN (SELECT host FROM b)) AS listed FROM j GROUP BY 1),
r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM r JOIN k ON k.key = host || path
"""
