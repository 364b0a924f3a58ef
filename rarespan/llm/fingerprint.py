"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-cased words weighted by their counts. For each of K samples a word draws
r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from a hash of itself; with t = floor(ln(w) / r + beta) the word's
score is ln(a) = ln(c) - r * (t - beta + 1), and the least score of the bag is the sample. The score is a
function of the pair (word, t) alone, so two bags have equal samples with the probability of their
generalised Jaccard similarity, sum(min) / sum(max). A fingerprint keeps 16 bits of each sample.

Scores depend on (word, count) only: a bounded table in each Python worker holds them, and a document is a
gather and a minimum. Neighbours by doc_id come from one shuffle of the texts into ranges of (doc_id, hash of the text), where
each range also gets the first document of the next one; no row crosses more than once but those. An id that many
rows share is cut by the hash, and rows that repeat in full are counted before they move, so no range is hot.

Defined results: a null text counts as empty; a text without words has the fingerprint '' and is alike (1)
to such a text only; doc_id is an integer of any size up to 64 bits; rows are ordered by doc_id, nulls first, then by
xxhash64 of the text, and repeated rows follow each other, so that each but the last is its own neighbour; a single row is its own neighbour; ties between a term's scores do not matter, as a sample is the least
score; a very long text is a bag like others; an empty table gives an empty result; only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 128
TABLE_ROWS = 150_000


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(seed: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """Three uniforms of 21 bits each from one hash per (seed, step)."""
    h = mixed(seed[:, None] + steps)
    part = lambda shift: (((h >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)
    return [part(43), part(22), part(1)]


def scores(terms: list[str], weights: np.ndarray, k: int = K) -> np.ndarray:
    """(terms, k) values ln(a).

    With exponentials e1 and e2, r = e1 + e2 is Gamma(2, 1) and beta = e2 / r is uniform and independent of
    it, so that r * (1 - beta) = e1: a word of weight 1, which has t = 0, needs no second hash.
    """
    seed = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms], np.uint64)
    out = np.empty((len(terms), k), np.float32)
    steps = np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(terms), 512):
        some = slice(at, at + 512)
        u1, u3, u4 = uniforms(seed[some], steps[:k])
        e1, ln_c = -np.log(u1), np.log(-np.log(u3 * u4))
        out[some] = ln_c - e1
        many = np.flatnonzero(weights[some] != 1)
        if len(many):
            e2 = -np.log(uniforms(seed[some][many], steps[k:])[0])
            r = e1[many] + e2
            t = np.floor(np.log(weights[some][many]).astype(np.float32)[:, None] / r + e2 / r)
            out[at + many] = ln_c[many] - r * t - e1[many]
    return out


class Sampler:
    """Fingerprints of texts, with a table of scores that is emptied when it is full."""

    def __init__(self, k: int = K, rows: int = TABLE_ROWS):
        self.k, self.rows = k, rows
        self.table, self.at = np.empty((rows, k), np.float32), {}

    def add(self, keys: list) -> None:
        pairs = [x if type(x) is tuple else (x, 1) for x in keys]
        n = len(self.at)
        if n + len(keys) > len(self.table):
            self.table = np.concatenate([self.table[:n], np.empty((len(keys), self.k), np.float32)])
        self.table[n : n + len(keys)] = scores([p[0] for p in pairs], np.array([p[1] for p in pairs], np.float64), self.k)
        self.at.update(zip(keys, range(n, n + len(keys))))

    def __call__(self, texts: list[str], few: int = 64) -> np.ndarray:
        """(texts, k) samples, uint16."""
        out = np.zeros((len(texts), self.k), np.uint16)
        for start in range(0, len(texts), few):
            bags = [[w if c == 1 else (w, c) for w, c in Counter(t.lower().split()).items()] for t in texts[start : start + few]]
            if len(self.at) > self.rows:
                self.table, self.at = self.table[: self.rows], {}
            if new := list({x: 0 for bag in bags for x in bag if x not in self.at}):
                self.add(new)
            for i, bag in enumerate(bags, start):
                if bag:
                    least = self.table[list(map(self.at.__getitem__, bag))].min(axis=0).view(np.uint32)
                    out[i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points is replaced by the first as many (or all) of the next text."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def alike(a: np.ndarray, b: np.ndarray, has_a: bool, has_b: bool) -> float:
    return float((a == b).mean()) if has_a and has_b else float(has_a == has_b)


def packed(ids: pd.Series, h: np.ndarray) -> np.ndarray:
    """Keys (doc_id with nulls first, h) as strings of 17 bytes that sort as they do."""
    known = ids.notna().to_numpy()
    number = np.zeros(len(ids), np.int64)
    number[known] = ids[known].to_numpy().astype(np.int64)
    out = np.empty((len(ids), 17), np.uint8)
    out[:, 0] = 1 + known
    for at, x in ((1, number), (9, np.asarray(h, np.int64))):
        out[:, at : at + 8] = (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def bounds_of(docs: DataFrame, n: int) -> np.ndarray:
    """Keys that cut docs into about n ranges: quantiles of doc_id; an id, or null, that takes several of them is cut by its rows' hashes, which are even."""
    probe = [i / n for i in range(1, n)] or [0.5]
    facts = docs.agg(F.percentile_approx("doc_id", probe, 20 * n).alias("at"), F.count("doc_id").alias("known"), F.count("*").alias("rows")).head()
    at = Counter(facts["at"] or [])
    if facts["known"]:  # quantiles are of the rows that have an id
        at = {x: math.ceil(c * facts["known"] / facts["rows"]) for x, c in at.items()}
    if facts["rows"] > facts["known"]:
        at = {None: math.ceil(n * (1 - facts["known"] / facts["rows"]))} | at
    cuts = [(x, -(2**63) + j * 2**64 // c) for x, c in at.items() for j in range(c) if x is not None or j]
    ids = pd.Series([x for x, _ in cuts], dtype="Int64")
    return np.sort(packed(ids, np.array([h for _, h in cuts], np.int64)))


def once(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, n): rows that repeat in full become one with their number, before texts move; most tables have none."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    twice = rows.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    if twice.isEmpty():
        return rows.withColumn("n", F.lit(1).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    single = rows.join(twice, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
    return single.unionByName(rows.join(twice, same, "left_semi").groupBy("doc_id", "text", "h").agg(F.count("*").alias("n")))


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """(p, halo, doc_id, text, h, n): n ranges of (doc_id, h); as halo, each range also gets the next one's first row.

    What the driver holds is one key per range.
    """
    bounds = bounds_of(docs, n)
    rows = once(docs)

    @F.pandas_udf("int")
    def place(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, packed(ids, h.to_numpy()), side="right").astype(np.int32))

    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first")
    firsts = rows.select("doc_id", "h", place("doc_id", "h").alias("p")).groupBy("p").agg(first).orderBy("p").collect()
    parts = [r["p"] for r in firsts]
    of = {(r["first"]["doc_id"], r["first"]["h"]): parts[i - 1] for i, r in enumerate(firsts)}  # the range before, the last one before the first

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, h: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, packed(ids, h.to_numpy()), side="right")
        before = [of.get((None if pd.isna(x) else int(x), y)) for x, y in zip(ids, h)]
        return pd.Series([[a] if b is None else [a, b] for a, b in zip(own, before)])

    return rows.select(F.posexplode(places("doc_id", "h")).alias("halo", "p"), "doc_id", "text", "h", "n").select("p", "halo", "doc_id", "text", "h", "n")


def fingerprints(docs: DataFrame, per_partition: int = 8) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranges(docs.select("doc_id", "text"), n * per_partition)
    rows = rows.repartition(n, "p").sortWithinPartitions("p", "halo", F.col("doc_id").asc_nulls_first(), "h", "text").drop("h")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]

    def run(batches):
        sample = Sampler()
        last = None  # the row before: p, halo, doc_id, text, copies, samples
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                p, halo, ids, texts, copies = (c.to_pylist() for c in b.columns)
                own = sample(texts)
                if last:
                    p, halo, ids, texts, copies, own = [last[0], *p], [last[1], *halo], [last[2], *ids], [last[3], *texts], [last[4], *copies], np.concatenate([last[5], own])
                at = [(i, i + 1, 1) for i in range(len(p) - 1) if not halo[i]]  # row, the next one, how often
                at += [(i, i, copies[i] - 1) for i, _, _ in at if copies[i] > 1]
                new = [edited(texts[i], texts[k]) for i, k, _ in at]
                other = sample(new)
                # a text without words has no samples; words are what split() leaves
                has = [bool(t.strip()) for t in texts]
                has_new = [bool(t.strip()) for t in new]
                text_of = lambda s, there: s.tobytes().hex() if there else ""
                yield pa.RecordBatch.from_pylist(
                    [
                        dict(zip(names, (ids[i], len(texts[i]), hashlib.sha256(new[j].encode()).hexdigest(), text_of(own[i], has[i]), text_of(other[j], has_new[j]), alike(own[i], other[j], has[i], has_new[j]), alike(own[i], own[k], has[i], has[k]), times)))
                        for j, (i, k, times) in enumerate(at)
                    ],
                    pa.schema([("doc_id", b.schema.field(2).type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())]),
                )
                last = (p[-1], halo[-1], ids[-1], texts[-1], copies[-1], own[-1:])

    made = rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    return made.select("*", F.explode(F.sequence(F.lit(1), "times")).alias("_")).drop("_", "times")
