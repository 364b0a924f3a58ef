"""The pipeline against brute-force versions of its stages, and the registered queries against their SQL."""

import glob
import hashlib
import math
import os
import re
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rarespan.llm import bpe, mixing, quality, queries
from rarespan.llm.common import table
from tests.llm.test_pair_operators import brute_join
from tests.llm.test_text_operators import WORD, brute_dedup, brute_quality, brute_targets


FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


def brute_kept(text):
    words, word_chars, symbols, dup_lines, _, base_failed = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    stops = sum(w.lower() in quality.STOP_WORDS for w in WORD.findall(text or ""))
    return not base_failed and 2 * words <= word_chars <= 15 * words and 10 * symbols <= words and 50 * stops >= words and 2 * dup_lines <= len(lines)


def brute_lines(rows, order):
    """rows as tuples of FIELDS; order: the operator's place of each (doc_id, text)."""
    places = sorted({r[:2] for r in rows}, key=order.__getitem__)
    out = []
    for r in rows:
        text = brute_dedup_of(places)[r[:2]]
        if text == r[1] or WORD.search(text):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


@lru_cache(1)
def _dedup(places):
    return brute_dedup(list(places))


def brute_dedup_of(places):
    return _dedup(tuple(places))


def brute_near(rows):
    comp = brute_join([r[:2] for r in rows])
    return [r for r in rows if r[0] is None or comp[r[:2]][1] == r[0]]


def brute_mix(rows):
    """Each row as often as the mix takes it."""
    by, out = defaultdict(list), []
    for r in rows:
        size, digest = len(WORD.findall(r[1] or "")), hashlib.md5((r[1] or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        weight = 0.1 + 0.9 * (1 - min(1, 10 * len(re.findall(r"[#*$%&|<>]", r[1] or "")) / max(1, size)))
        by[r[3]].append((-math.log(u) / weight, r[0] is not None, r[0] or 0, size, digest, r))
    sizes = {s: sum(x[3] for x in v) for s, v in by.items()}
    for s, target in brute_targets(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        left = math.floor(target - epochs * sizes[s])
        for _, _, _, size, _, r in sorted(by[s], key=lambda x: x[:5]):
            taken = epochs * size + max(0, min(size, left))
            left -= size
            out += [r] * (math.floor(taken / size + 0.5) if size else 0)
    return out


def texts_in_order(df):
    return {(r["doc_id"], r["text"]): (r["doc_id"] is not None, r["doc_id"] or 0, r["th"]) for r in df.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}


def rows_of(df):
    return Counter(tuple(r[c] for c in FIELDS) for r in df.collect())


def chained(spark, docs, sf):
    """The stages one by one against brute force, each on what the stage before it gave; returns the last stage's rows."""
    columns = docs.columns
    rows = list(rows_of(docs).elements())
    got = spark.createDataFrame(corpus_pipeline.quality_rules(spark, docs, sf).collect(), docs.schema)
    rows = [r for r in rows if brute_kept(r[1])]
    assert got.columns == columns and rows_of(got) == Counter(rows)

    rows = brute_lines(rows, texts_in_order(got))
    got = spark.createDataFrame(corpus_pipeline.line_deduplication(spark, got, sf).collect(), docs.schema)
    assert got.columns == columns and rows_of(got) == Counter(rows)

    rows = brute_near(rows)
    got = spark.createDataFrame(corpus_pipeline.near_duplicates(spark, got, sf).collect(), docs.schema)
    assert got.columns == columns and rows_of(got) == Counter(rows)

    rows = brute_mix(rows)
    got = spark.createDataFrame(corpus_pipeline.source_mixing(spark, got, sf).collect(), docs.schema)
    assert got.columns == columns and rows_of(got) == Counter(rows)

    import tiktoken

    model = tiktoken.Encoding("own", pat_str=queries.token_pattern(), mergeable_ranks=bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken")), special_tokens={})
    wanted = Counter((r[0], tuple(model.encode_ordinary(r[1])), True) for r in rows)
    tokens = corpus_pipeline.byte_bpe(spark, got, sf).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in tokens) == wanted
    return wanted


def test_run_is_the_chain_of_brute_force(spark, sf):
    wanted = chained(spark, table(spark, sf, "documents").repartition(3), sf)
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "starts", "ends", "round_trip"] and wanted
    assert Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in rows.collect()) == wanted


def test_stages_on_odd_tables(spark, sf, odd, empty, clashing):
    prose_rows = [(100 + i, "the words of a text and " * 3 + " ".join(f"w{i}-{j}" for j in range(60)), "en", None if i % 4 == 0 else "s", i) for i in range(12)]
    more = odd.unionByName(spark.createDataFrame(prose_rows, odd.schema))
    assert chained(spark, more, sf)
    columns = clashing.columns
    wide = more.withColumns({c: F.lit("clash") for c in columns if c not in FIELDS} | {"Carried_1": F.lit("x"), "a.b`c": F.lit("y"), "TEXT_": F.lit("z")})
    assert chained(spark, wide, sf) == chained(spark, more, sf)
    assert not chained(spark, empty, sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    got = queries.queries()[name](spark, sf)
    wanted = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = got.select(*wanted.columns).collect()
    assert Counter(tuple(r) for r in rows) == Counter(wanted.fetchall() if hasattr(wanted, "fetchall") else map(tuple, wanted.limit(10**9).fetchall()))


def test_whole_tables(spark, sf):
    n = table(spark, sf, "documents").count()
    for name in ("op2_token_counts", "op4_fingerprints", "op5_byte_bpe", "op6_language_id", "op10_ngram_join"):
        assert queries.queries()[name](spark, sf).select(F.count("*")).head()[0] == n
