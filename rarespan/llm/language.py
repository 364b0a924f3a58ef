"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams (lower-cased, runs of non-letters
as one space), hashed into BUCKETS rows; a linear layer and a softmax follow. Training takes a sample of
at most `sample` labelled rows: of each language in turn the one with the next hash of id and text, equal rows once,
so that neither a large language nor an id that repeats takes the place of the others. Spark ranks and limits them;
the driver holds the counted features of the sample, at most BUCKETS numbers each. The texts with a fifth of the hashes,
with all their copies, train nothing and calibrate: a temperature that fits their likelihood, and the least score at which
accepted predictions are wrong at most once in a hundred (`accepted` is false below). Predictions read whole texts in one
narrow map; the embedding and the layer fold into one table of BUCKETS x languages, which is what tasks are sent.

Defined results: a null text or one without a letter is `und` with score 0, not accepted; without
labelled rows every text is; a null doc_id is never held out and never trains; repeated rows count once in
training and get equal results; of languages with equal scores the first by name is predicted; a very long text is read whole; an
empty table gives an empty result; only doc_id, text and (to learn) lang are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, DIM, SAMPLE, EPOCHS, RATE, SEED = 1 << 14, 16, 3000, 6, 0.5, 7
NOT_LETTERS = re.compile(r"[\W\d_]+")
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a whole text."""
    raw = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out, h = [], raw * MULTIPLIERS[0]
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MULTIPLIERS[0] + raw[n - 1 :] * MULTIPLIERS[n - 1]
        out.append((h * MULTIPLIERS[1]) >> np.uint32(18))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return "und", 0.0
        z = (self.table[grams(text)].mean(axis=0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str, bool]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """rows: distinct buckets, their shares (sum 1), label, whether it calibrates; a language that only calibrates is not learned."""
    kept = [r for r in rows if not r[3]] or rows
    labels = tuple(sorted({r[2] for r in kept}))
    held = [r for r in rows if r[3] and r[2] in labels] or kept
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(labels))), np.zeros(len(labels))
    if not rows:
        return Model((), np.zeros((BUCKETS, 0), np.float32), b, 1.0, 0.0)
    scale = 20.0  # averages are small; the input of the layer is scaled up
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(kept)):
            at, share, label, _ = kept[i]
            x = scale * (share @ e[at])
            g = softmax(x @ w + b)
            g[labels.index(label)] -= 1
            back = scale * (w @ g)
            w -= step * 0.1 * np.outer(x, g)
            b -= step * 0.1 * g
            e[at] -= step * share[:, None] * back
    table = (scale * e @ w).astype(np.float32)
    z, y = np.array([share @ table[at] + b for at, share, *_ in held]), np.array([labels.index(r[2]) for r in held])
    fits = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 20, 60)}
    temperature = float(min(fits, key=fits.get))
    p = softmax(z / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= 0.01)
    return Model(labels, table, b, temperature, float(top[order[fine[-1]]]) if len(fine) else 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(rank, at, share, lang, held) of (rank, text, lang, held)."""

    def run(batches):
        for b in batches:
            made = []
            for text in b.column("text").to_pylist():
                at, count = np.unique(grams(text), return_counts=True)
                made.append((at.astype(np.int32), (count / count.sum()).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("rank"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), b.column("lang"), b.column("held")], ["rank", "at", "share", "lang", "held"])

    return docs.select("rank", "text", "lang", "held").mapInArrow(run, "rank long, at array<int>, share array<float>, lang string, held boolean")


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(rank, text, lang, held): at most `sample` distinct rows of docs, languages in turn."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(SEED)).alias("rank"), "text")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    chosen = known.select("lang", "rank").distinct().withColumn("turn", turn).where(F.col("turn") <= sample).orderBy("turn", "rank", "lang").limit(sample).drop("turn")
    rows = known.join(F.broadcast(chosen), ["lang", "rank"])  # at most `sample` pairs of a name and a number
    return rows.groupBy("lang", "rank").agg(F.min("text").alias("text")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text, lang) rows that are labelled and not held out."""
    rows = features(sampled(docs, sample)).toArrow().sort_by([("rank", "ascending"), ("lang", "ascending")])
    return train([(np.asarray(a.values), np.asarray(s.values, np.float64), lang.as_py(), held.as_py()) for a, s, lang, held in zip(rows["at"], rows["share"], rows["lang"], rows["held"])])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            made = [m.predict(t) for t in b.column(2).to_pylist()]
            score = np.array([s for _, s in made], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([lang for lang, _ in made], pa.string()), pa.array(score), pa.array((score >= m.least) & (score > 0))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
