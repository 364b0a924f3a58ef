"""Quality rules, line dedup, mixing, byte-level BPE, token counts, language ID, fingerprints."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespan.llm import bpe, fingerprint, language, line_dedup, mixing, quality, token_counts
from rarespan.llm.common import table
from rarespan.llm.queries import token_pattern, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = lambda: tokenizer_file("byte_bpe_50k.tiktoken")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return Counter(map(tuple, rows))


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in (y.strip(" \t\n\x0b\f\r") for y in text.split("\n")) if x]
    raw = [x for x in text.split("\n") if WORD.search(x)]
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if c[t] > 1 for j in (i, i + 1, i + 2)}
    assert len(lines) == len(raw)
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(raw) - len(set(raw)), len(covered), base


def test_quality(odd, empty, clashing):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (odd, clashing):
        rows = quality.judge(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert tuple(r[c] for c in columns) == brute_quality(r["text"])
            assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty).collect() == []
    wide = quality.judge(clashing)
    assert set(clashing.columns) <= set(wide.columns) and {r["_words"] for r in wide.collect()} == {"clash"}


def test_quality_of_repeated_windows(spark):
    import random

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefgh"[: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 70)))) for i in range(200)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_quality(t)[4] for i, t in rows} and len(set(got.values())) > 20


def test_quality_keeps_good_documents(spark, sf):
    labelled = quality.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").where(~F.col("base_failed"))
    assert labelled.where("quality = 1 AND NOT kept").count() == 0
    assert labelled.where("quality = 0 AND kept").count() == 0


def brute_dedup(rows):
    """rows: distinct (doc_id, text) in the operator's order."""
    runs, first = {}, {}
    for at, (key, text) in enumerate(rows):
        lines = [(i, x.strip(" \t\n\x0b\f\r")) for i, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\f\r")]
        runs[at] = lines
        for j in range(len(lines) - 2):
            first.setdefault(tuple(x for _, x in lines[j : j + 3]), (at, j))
    out = {}
    for at, (key, text) in enumerate(rows):
        gone = {j + k for j in range(len(runs[at]) - 2) if first[tuple(x for _, x in runs[at][j : j + 3])] != (at, j) for k in range(3)}
        at_lines = {runs[at][j][0] for j in gone}
        out[(key, text)] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in at_lines)
    return out


def test_line_dedup(odd, empty, clashing):
    hashes = {(r["doc_id"], r["text"]): r["th"] for r in odd.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    order = sorted(hashes, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x]))
    wanted = brute_dedup(order)
    for df in (odd, clashing):
        got = line_dedup.dedup(df.withColumn("old", F.col("text")))
        rows = got.collect()
        assert len(rows) == df.count()
        assert all(r["text"] == wanted[(r["doc_id"], r["old"])] for r in rows)
    assert sum(r["n_removed"] for r in rows) > 40
    assert line_dedup.dedup(empty).collect() == []


def test_line_dedup_of_a_run(spark):
    df = spark.createDataFrame([(1, "A\nA\nA\nA\n"), (2, "p\nX\nY\n\nZ\nW\nq"), (3, "X\nY\nZ\nW")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(df).collect()}
    assert got == {1: ("A\n", 4, 3), 2: ("p\nX\nY\n\nZ\nW\nq", 6, 0), 3: ("", 4, 4)}


def brute_targets(sizes):
    """Round by round: share by weight, full sources stop, their excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] >= 2 * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


def repeated_rows():
    """Copies of an id inside a source, across sources and without an id; equal rows and rows of other texts."""
    rows = [(7, "word " * 5, "a")] * 700 + [(7, f"word other{i} " * 3, "a") for i in range(300)]
    rows += [(None, "one two three", "b")] * 400 + [(None, f"w{i} x", "b") for i in range(200)] + [(7, "word " * 5, "b")] * 100
    return rows + [(i, "some words of a third source", "c") for i in range(300)] + [(7, "word " * 5, None)] * 900 + [(1, None, "d"), (1, "", "d")]


def test_mixing(odd, empty, clashing, spark, sf):
    repeated = spark.createDataFrame(repeated_rows(), "doc_id long, text string, source string").repartition(6)
    for df in (odd, clashing, repeated, repeated.where("source = 'a'"), table(spark, sf, "documents")):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        wanted = brute_targets(sizes)
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
        assert multiset(mixing.mix(df.repartition(3)).collect()) == multiset(rows)
        whole = mixing.mix(df, whole_rows=True)
        assert multiset(whole.select("doc_id", "source", "taken").collect()) == multiset((r["doc_id"], r["source"], r["taken"]) for r in rows)
    assert mixing.mix(empty).collect() == []


def test_mixing_ranges_are_even(spark):
    """No range of keys holds more than three times a thousandth, whatever the qualities."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "plain words").otherwise("## $$ %% w").alias("text"))
    top = mixing.keyed(docs).groupBy(F.col("doc_id") % 3 == 0, "bucket").count().groupBy("((doc_id % 3) = 0)").agg(F.max("count").alias("top"), F.sum("count").alias("all")).collect()
    assert len(top) == 2 and all(r["top"] <= 3 * r["all"] / 1000 for r in top)


def test_mixing_prefers_quality(spark):
    docs = spark.createDataFrame([(i, ("word " if i % 2 else "wo## ") * 20, "s") for i in range(400)] + [(1000 + i, "word " * 20, "t") for i in range(10)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1, 1), share=0.4, cap=2.0).where("source = 's'").collect()
    good, bad = (sum(r["taken"] for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert good > 2 * bad


@pytest.fixture(scope="module")
def tiktoken_model():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=token_pattern(), mergeable_ranks=bpe.read_ranks(PATH()), special_tokens={})


def test_bpe_equals_merging_by_rank(odd, empty, clashing, tiktoken_model):
    for df in (odd, clashing):
        wanted = multiset((i, tuple(tiktoken_model.encode_ordinary(t or ""))) for i, t in texts_of(df))
        encoded = bpe.encode(df, PATH(), token_pattern())
        rows = encoded.collect()
        assert multiset((r["doc_id"], tuple(r["ids"])) for r in rows) == wanted
        back = bpe.decode(encoded, PATH(), token_pattern())
        assert multiset((r["doc_id"], r["text"]) for r in back.collect()) == multiset((i, t or "") for i, t in texts_of(df))
        digests = bpe.digest(df, PATH(), token_pattern()).collect()
        assert multiset((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == multiset((i, hashlib.sha256(np.array(tiktoken_model.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts_of(df))
        spans = {(r["doc_id"], tuple(r["ids"])): hashlib.sha256(np.array([r["starts"], r["ends"]], "<u4").T.tobytes()).hexdigest() for r in rows}
        assert multiset((r["doc_id"], r["ids_sha256"], r["offsets_sha256"]) for r in digests) == multiset((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), spans[i, ids]) for i, ids in wanted.elements())
        made = bpe.tokenise(df, PATH(), token_pattern()).collect()
        assert all(r["round_trip"] for r in made) and multiset((r["doc_id"], tuple(r["starts"]), tuple(r["ends"])) for r in made) == multiset((r["doc_id"], tuple(r["starts"]), tuple(r["ends"])) for r in rows)
    assert bpe.digest(empty, PATH(), token_pattern()).collect() == []


def test_bpe_offsets():
    c = bpe.codec(PATH(), token_pattern())
    text = "Héllo 😀 日本 x"
    ids = c.encode([text])[0]
    starts, ends = c.offsets(text, ids)
    raw, at = text.encode(), 0
    for i, s, e in zip(ids, starts, ends):
        token = c.tokens[i]
        whole = text[s:e].encode()
        assert token in whole and raw[at : at + len(token)] == token
        at += len(token)
    assert (starts[0], ends[-1]) == (0, len(text)) and c.decode(ids).decode() == text


def test_bpe_random(tiktoken_model):
    hypothesis = pytest.importorskip("hypothesis")
    st = pytest.importorskip("hypothesis.strategies")
    c = bpe.codec(PATH(), token_pattern())

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(st.one_of(st.text(), st.text(alphabet="aab =-\n\t'srt01é日😀\x85\u200b")))
    def same(text):
        assert c.encode([text])[0] == tiktoken_model.encode_ordinary(text)

    same()


def test_token_counts(odd, empty, clashing):
    path = tokenizer_file("piece_bpe_32k.model")
    model = token_counts.unigram(path)

    def viterbi(word):
        text = token_counts.SPACE + word
        best = [(0.0, 0)]
        for i in range(1, len(text) + 1):
            options = [(best[s][0] + model.pieces[text[s:i]], -(best[s][1] + 1)) for s in range(max(0, i - 64), i) if text[s:i] in model.pieces]
            if text[i - 1] not in model.pieces:
                size = len(text[i - 1].encode())
                options.append((best[i - 1][0] + size * model.unknown, -(best[i - 1][1] + size)))
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    cache = {}
    count = lambda w: cache.setdefault(w, None) or cache.update({w: viterbi(w)}) or cache[w]
    for df in (odd, clashing):
        wanted = multiset((i, len(WORD.findall(t or "")), sum(map(count, WORD.findall(t or "")))) for i, t in texts_of(df))
        assert multiset(token_counts.count_tokens(df, path).collect()) == wanted
    assert token_counts.count_tokens(empty, path).collect() == []
    model.clear()
    assert model.count("sharing") == viterbi("sharing") and model.count("shared") == viterbi("shared")
    assert model.nodes < len("sharing") + len("shared") + 2  # the prefix was scored once
    model.clear()
    long_ones = ["ab" * 100 + end for end in ("", "c", "日本")]
    assert [model.count(w) for w in long_ones] == [viterbi(w) for w in long_ones] and model.nodes == token_counts.LONG


def test_language(odd, empty, clashing, spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    model = language.fit(docs)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
    accepted = [r for r in rows if r["accepted"]]
    assert sum(r["lang_pred"] == r["lang"] for r in accepted) / len(accepted) > 0.97
    again = language.fit(docs.repartition(7))
    assert again.labels == model.labels and np.array_equal(again.table, model.table)
    for df in (odd, clashing):
        got = language.predict(df, model).collect()
        assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
        und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
        assert und == {1, 2, 3, 15}
        assert language.predict(df, language.fit(df)).count() == df.count()
    assert language.predict(empty, language.fit(empty)).collect() == []
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}


def test_language_predictions_by_hand(odd, spark, sf):
    """Scores again from the model's table, gram by gram in plain Python."""
    docs = table(spark, sf, "documents")
    model = language.fit(docs)
    mask = 2**32 - 1

    def scores(text):
        raw = f" {re.sub(r'[\W\d_]+', ' ', text.lower())} ".encode("utf-8", "replace")
        total, n = np.zeros(len(model.labels)), 0
        for size in (2, 3, 4):
            for i in range(len(raw) - size + 1):
                h = raw[i] * 0x9E3779B1 & mask
                for j in range(1, size):
                    h = ((h ^ (h >> 15)) * 0x9E3779B1 + raw[i + j] * (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[j - 1]) & mask
                total += model.table[(h * 0x85EBCA77 & mask) >> 18]
                n += 1
        z = (total / n + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    for df in (odd, docs.where("doc_id < 40")):
        texts = {(r["doc_id"], r["text"]) for r in df.collect() if r["text"] and len(r["text"]) < 20_000}
        got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
        for i, text in texts:
            if any(c.isalpha() for c in text):
                p = scores(text)
                assert got[i]["lang_pred"] == model.labels[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), rel=1e-4)


def test_language_with_one_row_on_most_rows(spark):
    """Every language is learned, the driver gets `sample` rows at most, and copies are on one side of the calibration."""
    rows = [(1, "der die das und ein", "de")] * 4000 + [(1, f"der die das und {i}", "de") for i in range(900)] + [(i, f"the of and to {i}", "en") for i in range(2, 400)] + [(i, f"le la les {i}", "fr") for i in range(400, 408)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    chosen = language.sampled(docs, 90).collect()
    of = Counter(r["lang"] for r in chosen)
    assert len(chosen) == 90 and 1 <= of["fr"] <= 8 and abs(of["de"] - of["en"]) <= 1
    assert len({(r["lang"], r["text"]) for r in chosen}) == 90
    assert language.fit(docs).labels == ("de", "en", "fr")
    held = {}
    for r in language.sampled(docs, 3000).collect():
        assert held.setdefault(r["text"], r["held"]) == r["held"]
    assert 0.1 < sum(held.values()) / len(held) < 0.3


def test_language_training_by_hand():
    """Embeddings, layer, temperature and least score again, by plain loops over the formulas."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        at = np.unique(rng.integers(0, 50, 6)) + (100 if i % 2 else 0)
        rows.append((at, np.full(len(at), 1 / len(at)), "b" if i % 2 else "a", i % 5 == 0))
    model = language.train(rows, epochs=2, rate=0.3, seed=5)
    r = np.random.default_rng(5)
    e, w, b = r.normal(0, 0.1, (language.BUCKETS, language.DIM)), r.normal(0, 0.1, (language.DIM, 2)), np.zeros(2)
    kept, held = [x for x in rows if not x[3]], [x for x in rows if x[3]]
    for epoch in range(2):
        step = 0.3 * (1 - epoch / 2)
        for i in r.permutation(len(kept)):
            at, share, label, _ = kept[i]
            x = sum(20.0 * s * e[a] for a, s in zip(at, share))
            z = x @ w + b
            g = np.exp(z) / np.exp(z).sum() - np.array([label == "a", label == "b"])
            back = 20.0 * (w @ g)
            w = w - step * 0.1 * np.array([[xi * gi for gi in g] for xi in x])
            b = b - step * 0.1 * g
            for a, s in zip(at, share):
                e[a] = e[a] - step * s * back
    assert np.allclose(model.bias, b) and np.allclose(model.table, 20.0 * e @ w, rtol=1e-4, atol=1e-5)
    loss = lambda t: -np.mean([np.log(np.exp(z / t)[y] / np.exp(z / t).sum()) for z, y in ((sum(s * model.table[a].astype(float) for a, s in zip(at, share)) + b, "ab".index(label)) for at, share, label, _ in held)])
    assert all(loss(model.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.1, 20, 60))
    assert model.labels == ("a", "b") and 0.5 <= model.least <= 1


def test_language_learns_from_its_fold_only(spark):
    import zlib

    rows = [(i, "der die das und" if zlib.crc32(str(i).encode()) % 4 == 2 else "the of and to", "no" if zlib.crc32(str(i).encode()) % 4 == 2 else "en") for i in range(200)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).labels == ("en",)


def in_order(rows):
    """(doc_id, text) by doc_id, nulls first, then by Spark's xxhash64 of the text."""
    import xxhash

    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = [(i, t or "") for i, t in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))


def test_fingerprints_of_ids_that_most_rows_share(spark):
    """No range is hot and no halo holds more than one row, whether texts differ or not; each row's next text is the right one."""
    rows = [(7, f"text {i} of one id") for i in range(1500)] + [(7, "the same row")] * 900 + [(None, f"no id {i % 400}") for i in range(1200)] + [(i, f"own {i}") for i in range(-200, 200)] + [(2**62, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    made = fingerprint.ranges(docs, 40).groupBy("p").agg(F.sum(F.when(F.col("halo") == 0, 1).otherwise(0)).alias("own"), F.sum("halo").alias("halo")).collect()
    own = [r["own"] for r in made]
    assert len(own) > 25 and max(own) <= 3 * sum(own) / 40 and max(r["halo"] for r in made) == 1
    ordered, wanted = in_order(rows), Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        k = len(t) // 4
        wanted[(i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())] += 1
    assert multiset((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprints(docs).collect()) == wanted


def test_fingerprints(odd, empty, clashing):
    for df in (odd, clashing):
        rows = in_order(texts_of(df))
        got = fingerprint.fingerprints(df).collect()
        assert len(got) == len(rows)
        wanted = Counter()
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
            k = len(t) // 4
            wanted[(i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())] += 1
        assert multiset((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == wanted
        prints = defaultdict(set)
        by_id = defaultdict(list)
        for r in got:
            by_id[r["doc_id"]].append(r)
        for i, t in rows:
            prints[t].update(r["fingerprint"] for r in by_id[i] if r["n_chars"] == len(t))
        assert all(len(p) == 1 for t, p in prints.items()) and prints[""] == {""}
        one = by_id[14][0]
        assert 0.4 < one["near_edited"] < 0.8  # three quarters of distinct words stay: 0.6
        assert by_id[1][0]["near_next"] == 1 and by_id[9][0]["near_next"] == 0
    assert fingerprint.fingerprints(empty).collect() == []


def test_fingerprints_estimate_generalised_jaccard():
    import random

    rng, words = random.Random(2), [f"w{i}" for i in range(200)]
    sample, errors = fingerprint.Sampler(), []
    for _ in range(100):
        a = rng.choices(words[: rng.randint(10, 200)], k=rng.randint(20, 500))
        b = a[: rng.randint(0, len(a))] + rng.choices(words, k=rng.randint(1, 300))
        x, y = Counter(a), Counter(b)
        true = sum((x & y).values()) / sum((x | y).values())
        f = sample([" ".join(a), " ".join(b)])
        errors.append((f[0] == f[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06 and math.isfinite(sum(errors))
