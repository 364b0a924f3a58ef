"""Hand-computed fixtures, invariants, and plans against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rarespan import catalogue
from rarespan.config import Mating, Sampling
from rarespan.functions import gamma
from rarespan.functions import sequence as S
from rarespan.operators import checks, composition, curve, grouped, kmer_runs, mating_align, mating_join, mating_kmer, ontology, rarefaction, reads, solver
from rarespan.plans import redundancy


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_codes_and_reverse_complement(spark):
    df = frame(spark, [("ACGT",), ("TACG",), ("GGGG",), ("CCCC",), ("ACNT",), ("T" * 32,)], "s string")
    got = [tuple(r) for r in df.select(S.kmer_code(F.col("s")), S.reverse_complement(F.col("s")), S.literal_reverse_complement(F.col("s"))).collect()]
    assert got[:5] == [(39, "ACGT", "NACG"), (201, "CGTA", "NCGT"), (85, "CCCC", "NCCC"), (170, "GGGG", "NGGG"), (None, "ANGT", "NANG")]
    assert got[5][0] == -1


def test_kmer_mates(spark):
    r = frame(spark, [(1, "ACGTA"), (2, "TACGT"), (3, "ACGTN"), (4, "GGGGG"), (5, "CCCCC")], "read_id long, seq string")
    got = {x["query_id"]: x["mates"] for x in mating_kmer.mates(reads.kmer_queries(r, 4), r, 4).collect()}
    assert got == {1: 6, 2: 2, 3: 6, 4: 4, 5: 4}
    assert {x[0]: x[1] for x in kmer_runs.spectrum(r, 4).collect()} == {3: 1, 2: 2, 1: 2}


ALIGNED = ["ACGTTGCAAGTCCGATAGCT", "ACGTTGCAAGACCGATAGCT", "AGCTATCGGACTTGCAACGT", "TCCGATAGCTTTTTTCCCCC", "G" * 20, "ACGTTNCAAGTCCGATAGCT"]


@pytest.mark.parametrize("mating,expected", [(Mating(kernel="alignment"), [5, 3, 5, 4, 1, 4]), (Mating(kernel="alignment", both_strands=False), [4, 2, 1, 3, 1, 3]), (Mating(kernel="alignment", literal_reverse=True), [5, 2, 2, 3, 1, 3])])
def test_alignment_mates(spark, mating, expected):
    r = frame(spark, list(enumerate(ALIGNED)), "read_id long, seq string")
    q = r.select(F.col("read_id").alias("query_id"), "seq")
    got = {x["query_id"]: x["mates"] for x in mating_align.mates(q, r, mating).collect()}
    assert [got[i] for i in range(6)] == expected
    cross = {x["query_id"]: x["mates"] for x in mating_align.mates(q, r, mating, cross=True).collect()}
    assert [cross[i] - 1 for i in range(6)] == expected


def test_seeded_plan_equals_every_shift(spark):
    import random

    rng = random.Random(5)
    base = "".join(rng.choices("ACGT", k=400))
    seqs = []
    for i in range(60):
        at, n = rng.randrange(0, 300), rng.choice((40, 50, 70))
        s = list(base[at : at + n])
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        seqs.append((i, "".join(s)))
    r = frame(spark, seqs, "read_id long, seq string")
    q = r.select(F.col("read_id").alias("query_id"), "seq")
    for m in (Mating(kernel="alignment"), Mating(kernel="alignment", n_mismatch=True)):
        k = mating_align.seed_length(40, 70, m)
        a = {tuple(x) for x in mating_align.pairs_seeded(q, r, k, m).collect()}
        b = {tuple(x) for x in mating_align.pairs_all(q, r, m).distinct().collect()}
        assert a == b and len(a) > 60
    assert [mating_align.seed_length(n, n, Mating(kernel="alignment")) for n in (20, 36, 50, 70, 100, 150, 250)] == [10, 10, 12, 13, 15, 16, 17]


def test_grids(spark):
    got = [round(x["portion"], 6) for x in rarefaction.grid(spark, 100, Sampling()).orderBy("portion_idx").collect()]
    assert got == [0, 0.019773, 0.028248, 0.040354, 0.057648, 0.082354, 0.117649, 0.16807, 0.2401, 0.343, 0.49, 0.7, 1]
    assert rarefaction.grid(spark, 100, Sampling(factor=0)).count() == 101


def test_expected_redundancy_and_replicates(spark):
    points = frame(spark, [(0, 0.5)], "portion_idx int, portion double")
    one = lambda mates: rarefaction.expected(frame(spark, [(mates, 1)], "mates long, n_queries long"), points, 101).head()["redundancy"]
    assert one(11) == pytest.approx(0.994274, abs=1e-6) and one(1) == 0
    assert one(500) == 1  # more occurrences than reads
    hist = frame(spark, [(1, 30), (3, 20), (11, 50)], "mates long, n_queries long")
    s = Sampling(replicates=2000)
    grid = rarefaction.grid(spark, 101, s).where("portion > 0.05")
    drawn = {x["portion_idx"]: x for x in rarefaction.summarise(rarefaction.replicate(hist, grid, 101, s)).collect()}
    for x in rarefaction.expected(hist, grid, 101).collect():
        exact = x["redundancy"] * (1 - (1 - x["portion"]) ** 100)
        d = drawn[x["portion_idx"]]
        assert abs(d["avg"] - exact) <= 5 * d["sd"] / math.sqrt(2000) + 1e-9
        assert d["q1"] <= d["q2"] <= d["q3"]
    again = rarefaction.replicate(hist.repartition(3), grid, 101, s)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rarefaction.replicate(hist, grid, 101, s).collect()}


def test_summary(spark):
    v = frame(spark, [(0, 0.5, i, x) for i, x in enumerate((0.1, 0.4, 0.2, 0.3))], "portion_idx int, portion double, replicate int, redundancy double")
    got = rarefaction.summarise(v).head()
    assert [round(got[c], 6) for c in ("avg", "sd", "q1", "q2", "q3")] == [0.25, 0.111803, 0.2, 0.3, 0.4]


def test_errors_remove_singletons(spark):
    r = frame(spark, [(i, "ACGT" * 6, chr(33 + 20) * 24) for i in range(4)], "read_id long, seq string, qual string")
    p = reads.kmer_queries(r, 24, True)
    assert p.head()["p_err"] == pytest.approx(0.214322, abs=1e-6)
    mated = p.withColumn("mates", F.lit(1).cast("long"))
    assert sorted(x["query_id"] for x in mating_kmer.without_errors(mated).collect()) == [1, 2, 3]


def test_query_numbers(spark):
    df = lambda n: spark.range(n).select(F.col("id").alias("read_id"))
    assert reads.resolve_queries(df(40), "alignment", Sampling(max_queries=50)) == 30
    assert reads.resolve_queries(df(60), "kmer", Sampling(max_queries=50)) == 45
    assert reads.resolve_queries(df(67), "kmer", Sampling(max_queries=50)) == 50
    with pytest.raises(ValueError):
        reads.resolve_queries(df(0), "kmer", Sampling())


def test_composition(spark):
    r = frame(spark, [(1, "ACGTN"), (2, "AC")], "read_id long, seq string")
    assert {x["kmer"]: x["count"] for x in composition.counts(r, 2).collect()} == {"AC": 1, "CG": 1, "GT": 1, "TN": 1}
    every = composition.with_zeroes(composition.counts(r, 2), 2)
    assert every.count() == 256 and every.agg(F.sum("count")).head()[0] == 4
    assert composition.in_label_order(composition.counts(r, 2)).first()["kmer"] == "AC"


def test_wide_counter(spark):
    """The fields against a counter that is counted up in steps."""
    def emulated(n, step=1_000_003):
        base, omag, hang = 0, 1, 0
        for add in [step] * (n // step) + [n % step]:
            hang += add
            base, hang = base + hang // omag, hang % omag
            while base >= 4_194_303:
                whole = base * omag + hang
                omag *= 1024
                base, hang = whole // omag, whole % omag
        return base, omag, hang

    sizes = [0, 1, 4_194_302, 4_194_303, 4_194_304, 5_000_000, 4_294_966_271, 4_294_966_272, 10**10]
    got = {r["count"]: (r["base"], r["omag"], r["hang"]) for r in composition.extended(frame(spark, [("A", n) for n in sizes], "kmer string, count long")).collect()}
    assert got == {n: emulated(n) for n in sizes}


def test_extended_query_has_long_fields(spark, monkeypatch):
    """Windows more frequent than a field of 32 bits takes: base is the count, as the SQL of the query has it."""
    sizes = [0, 4_194_302, 4_194_303, 5_000_000, 10**10, 10**15]
    monkeypatch.setattr(composition, "counts", lambda reads, k: frame(spark, [("A", n) for n in sizes], "kmer string, count long"))
    rows = catalogue.queries()["nuc_composition_extended"](spark, "/root/testdata/sf0.001").select("count", "base", "omag", "hang").collect()
    assert sorted(map(tuple, rows)) == [(n, n, 1, 0) for n in sizes]


def test_many_query_codes_use_a_bitmap(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("ACGTN", weights=(5, 5, 5, 5, 1), k=rng.randrange(0, 90))), rng.choice(("x", "y", None))) for i in range(300)]
    r = frame(spark, rows, "read_id long, seq string, g string")
    asked = reads.kmer_queries(r, 6)
    few = {x["query_id"]: x["mates"] for x in mating_kmer.mates(asked, r, 6).collect()}
    monkeypatch.setattr(mating_kmer, "FEW_CODES", 10)
    assert {x["query_id"]: x["mates"] for x in mating_kmer.mates(asked, r, 6).collect()} == few and len(few) > 60
    kmers = [s[i : i + 6] for _, s, _ in rows for i in range(len(s) - 5)]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for x in asked.collect():
        assert few[x["query_id"]] == kmers.count(x["kmer"]) + kmers.count(rc(x["kmer"]))
    grouped_mates = {x["query_id"]: x["mates"] for x in grouped.mates(r.where("g IS NOT NULL"), "g", 6).collect()}
    for i, s, g in rows:
        if i in grouped_mates:
            own = [t[j : j + 6] for _, t, h in rows if h == g for j in range(len(t) - 5)]
            assert grouped_mates[i] == own.count(s[:6]) + own.count(rc(s[:6]))


def test_evaluation_reads_the_first_point_beyond_a_fifth(spark):
    points = [(i, i / 10, 0.5, 0.0 if i == 2 else 0.4) for i in range(11)]
    ddl = "portion_idx int, portion double, avg double, q2 double"
    assert {r["status"] for r in checks.evaluate(frame(spark, points, ddl)).collect()} == {"ok"}
    assert "low_depth" in {r["status"] for r in checks.evaluate(frame(spark, [(i, p, a, 0.0 if i == 3 else q) for i, p, a, q in points], ddl)).collect()}


def test_adjusted_runs_return_what_ran(spark):
    import random

    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=400))
    r = frame(spark, [(i, base[(at := rng.randrange(0, 330)) : at + 60]) for i in range(300)], "read_id long, seq string")
    out = redundancy.run(r, Mating(), Sampling(max_queries=60, replicates=16), adjust=True)
    assert out.meta["divide"] == out.sampling.factor >= 0.7
    assert out.summary.count() == rarefaction.grid(spark, 300, out.sampling).count()


def test_tile_ids_do_not_collide(spark):
    r = frame(spark, [(1, "ACGTA" * 20_000), (2, "ACGTA" * 10)], "read_id long, seq string")
    t = mating_align.tiles(r)
    assert t.count() == t.select("read_id").distinct().count() == 2001


def test_query_blocks_give_the_same_pairs(spark):
    r = frame(spark, list(enumerate(ALIGNED)), "read_id long, seq string")
    q = r.select(F.col("read_id").alias("query_id"), "seq")
    m = Mating(kernel="alignment")
    wanted = {tuple(x) for x in mating_align.pairs_all(q, r, m).distinct().collect()}
    assert {tuple(x) for x in mating_align.pairs_all(q, r, m, most=2).distinct().collect()} == wanted
    assert {tuple(x) for x in mating_align.pairs_seeded(q, r, 10, m, few=3).collect()} == {tuple(x) for x in mating_align.pairs_seeded(q, r, 10, m).collect()}


def overlapping(n, seed=11, odd=0.0):
    """Reads of a short genome with errors, copies, runs of one base and, at the rate `odd`, N."""
    rng = random.Random(seed)
    base = "".join(rng.choices("ACGT", k=300)) + "A" * 120
    out = []
    for i in range(n):
        at, size = rng.randrange(0, 350), rng.choice((40, 50, 70))
        s = list(base[at : at + size])
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        s = "".join("N" if rng.random() < odd else c for c in s)
        out += [s] * (1 if i % 7 else 3)
    return list(enumerate([*out, "A" * 50, "A" * 50, "", None]))


@pytest.mark.parametrize("m", [Mating(kernel="alignment"), Mating(kernel="alignment", both_strands=False, n_mismatch=True), Mating(kernel="alignment", n_wildcard=True)])
def test_many_queries_meet_reads_in_a_join(spark, monkeypatch, m):
    """The join equals every shift: with frequent grams cut into blocks and left out, copies, nulls and empty reads, and N as a wildcard."""
    r = frame(spark, overlapping(60, odd=0.004 if m.n_wildcard else 0.0), "read_id long, seq string")
    q = r.select(F.col("read_id").alias("query_id"), "seq")
    wanted = {x["query_id"]: x["n"] for x in mating_align.counted(mating_align.pairs_all(q.where("seq <> ''"), r.where("seq <> ''"), m)).collect()}
    monkeypatch.setattr(mating_align, "MANY", 5)
    monkeypatch.setattr(mating_join, "BLOCK", 6)
    got = {x["query_id"]: x["mates"] for x in mating_align.mates(q, r, m).collect()}
    assert got == {i: wanted.get(i, 0) for i in got} and len(got) == r.count() and sum(got.values()) > 500


def test_frequent_grams_are_dealt_to_blocks(spark, monkeypatch):
    """Many different reads share one gram: each pair meets in one block of it, and no block has many times the rows of the middle one."""
    monkeypatch.setattr(mating_join, "BLOCK", 10)
    rng = random.Random(4)
    r = frame(spark, [(i, "A" * 12 + "".join(rng.choices("CGT", k=28)), 1) for i in range(150)], "read_id long, seq string, copies long")
    seen = mating_join.grams(r, "seq", 12)
    hot = seen.groupBy("gram").agg(F.count("*").alias("of_queries")).withColumn("of_reads", F.col("of_queries")).where("of_queries > 100")
    a = mating_join.dealt(seen.withColumnRenamed("read_id", "query_id"), hot, "of_queries", "of_reads", F.col("query_id")).select("gram", "of_queries_block", "of_reads_block", "query_id")
    b = mating_join.dealt(seen, hot, "of_reads", "of_queries", F.col("read_id")).select("gram", "of_queries_block", "of_reads_block", "read_id")
    met = a.join(b, ["gram", "of_queries_block", "of_reads_block"]).join(hot.select("gram"), "gram")
    sizes = sorted(x["count"] for x in met.groupBy("of_queries_block", "of_reads_block").count().collect())
    assert met.count() == met.select("query_id", "read_id").distinct().count() == 150 * 150
    assert len(sizes) == 225 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_spare_grams():
    """Of every overlap the common q-grams outnumber the spare ones, whatever the places of its mismatches."""
    m = Mating(kernel="alignment")
    for short, long_, q in ((40, 40, 10), (50, 50, 12), (50, 70, 9), (100, 100, 10)):
        spare = mating_join.spare_grams(short, long_, q, m)
        for w in range(math.ceil(m.overlap * short), long_ + 1):
            e = mating_align.allowed(w, m.similarity)
            gaps = [w // (e + 1) * (i + 1) for i in range(e)]
            clean = sum(all(not p <= g < p + q for g in gaps) for p in range(w - q + 1))
            assert clean > spare
    assert mating_join.spare_grams(100, 100, 10, m) > 10 and mating_join.spare_grams(50, 50, 12, m) == 1


def test_gamma():
    for a, b in ((1, 1), (5.5, 0.3), (60, 3)):
        for p in (0.01, 0.3, 0.5, 0.95):
            assert gamma.cdf(gamma.quantile(p, a, b), a, b) == pytest.approx(p, abs=1e-12)
    assert gamma.cdf(2.0, 1, 0.5) == pytest.approx(1 - math.exp(-1))


def test_fit_recovers_a_model(spark):
    a, b = 60.0, 3.2
    total = 1e10
    xs = [0.0, *(total * 0.7 ** (40 - i) for i in range(41))]
    # coverage = redundancy ^ 0.914..., and effort is stretched: fit on points that are already adjusted
    pts = [("c", i + 1, x, x, 0.0, gamma.cdf(math.log1p(x), a, b), 0.01, 0.0, 0.0, 0.0) for i, x in enumerate(xs)]
    p = frame(spark, pts, "label string, i int, x_obs double, x_adj double, red double, cov double, sd double, p25 double, p50 double, p75 double")
    meta = frame(spark, [("c", "kmer", 100.0, 77.0, 10**8, 50.0, 0.7)], "label string, kernel string, L double, AL double, R long, overlap double, divide double")
    got = curve.fit(p, meta, enforce=False).head()
    assert got["a"] == pytest.approx(a, rel=1e-4) and got["b"] == pytest.approx(b, rel=1e-4)
    assert got["diversity"] == pytest.approx((a - 1) / b, abs=1e-3) and got["modelR"] > 0.9999
    assert curve.predict(curve.fit(p, meta, enforce=False), frame(spark, [("c", 1e9)], "label string, effort double")).head()["coverage"] == pytest.approx(gamma.cdf(math.log1p(1e9), a, b), abs=1e-6)


def test_curves_are_solved_together():
    """Each curve of a batch is at its optimum, the same alone; exact derivatives agree with differences; what has no model is NaN and stops no other."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, a, b = rng.uniform(0.01, 40, 500), np.exp(rng.uniform(-3, 5, 500)), np.exp(rng.uniform(-4, 3, 500))
    _, by_a, by_b = gamma.model_slopes(np.expm1(x), a, b)
    assert np.abs(by_a - (gamma.cdf(x, a * (1 + 1e-5), b) - gamma.cdf(x, a * (1 - 1e-5), b)) / (2e-5 * a)).max() < 1e-7
    assert np.abs(b * by_b - (gamma.cdf(x, a, b * (1 + 1e-5)) - gamma.cdf(x, a, b * (1 - 1e-5))) / 2e-5).max() < 1e-7
    assert gamma.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)

    shapes, rates = rng.uniform(5, 40, 60), rng.uniform(0.5, 2, 60)
    efforts = [np.exp(gamma.quantile(np.linspace(0.02, 0.88, n), s, r)) - 1 for n, s, r in zip(rng.integers(4, 40, 60), shapes, rates)]
    seen = [gamma.model(e, s, r) * (1 + rng.normal(0, 0.01, len(e)) * (i % 2)) for i, (e, s, r) in enumerate(zip(efforts, shapes, rates))]
    efforts, seen = [*efforts, np.array([5.0, 6.0]), np.array([1.0, np.nan, 2.0]), np.array([])], [*seen, np.array([0.1, 0.2]), np.array([0.1, 0.2, 0.3]), np.array([])]
    x, y, inside = solver.padded(efforts, 1.0), solver.padded(seen, 1.0), solver.padded([np.ones(len(e)) for e in efforts], 0.0) > 0
    got = solver.solve(x, y, np.ones_like(x), inside)
    assert np.isnan(got[60:]).all() and not np.isnan(got[:60]).any()
    assert got[:60:2] == pytest.approx(np.stack([shapes, rates], 1)[::2], rel=1e-5)
    for i in range(60):
        cost = lambda s, r: ((seen[i] - gamma.model(efforts[i], s, r)) ** 2).sum()
        best = cost(*got[i])
        assert all(cost(got[i, 0] * u, got[i, 1] * v) >= best for u in (0.999, 1, 1.001) for v in (0.999, 1, 1.001))
        assert solver.solve(x[i : i + 1], y[i : i + 1], np.ones_like(x[:1]), inside[i : i + 1])[0] == pytest.approx(got[i], rel=1e-6)


def test_checks(spark):
    ddl = "label string, i int, x_obs double, x_adj double, red double, cov double, sd double, p25 double, p50 double, p75 double"
    good = [("good", i + 1, float(i), float(i), i / 20, i / 20, 0.0, 0.1, 0.1, 0.1) for i in range(18)]
    flat = [("flat", i + 1, float(i), float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(18)]
    got = {x["label"]: x for x in curve.checks(frame(spark, good + flat, ddl)).collect()}
    assert got["good"]["consistent"] and not got["flat"]["consistent"]
    assert got["flat"]["median_zero"] and got["flat"]["too_low"] and got["flat"]["few_points"] and not got["flat"]["too_steep"]


def test_adjust():
    m, s = checks.adjust({"low_resolution"}, Mating(), Sampling(), 100)
    assert s.factor == pytest.approx(0.85)
    m, s = checks.adjust({"low_depth"}, Mating(), Sampling(max_queries=10), 100)
    assert s.query_portion == pytest.approx(0.2)
    m, s = checks.adjust({"low_depth"}, Mating(overlap=0.8), Sampling(query_portion=1.0), 100)
    assert m.overlap == 0.75
    with pytest.raises(ValueError):
        checks.adjust({"low_depth"}, Mating(overlap=0.25), Sampling(query_portion=1.0), 100)
    assert checks.adjust({"ok"}, Mating(), Sampling(), 100) is None


@pytest.mark.parametrize("bad", [dict(k=0), dict(k=33), dict(overlap=0), dict(similarity=1.1), dict(kernel="x")])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Mating(**bad)


def test_ontology(spark):
    chain = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(70)], "acc string, parent_acc string")
    far = ontology.distance(chain, frame(spark, [("n0", "n70")], "a string, b string")).head()
    assert far["distance"] == 70
    edges = frame(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("e", "c"), ("z", "y")], "acc string, parent_acc string")
    pairs = frame(spark, [("d", "e"), ("d", "b"), ("b", "c"), ("d", "z"), ("a", "a")], "a string, b string")
    got = {(x["a"], x["b"]): x["distance"] for x in ontology.distance(edges, pairs).collect()}
    assert got == {("d", "e"): 2, ("d", "b"): 1, ("b", "c"): 1, ("d", "z"): None, ("a", "a"): 0}
    assert {tuple(x) for x in ontology.common_ancestors(edges, pairs.limit(1)).collect()} == {("d", "e", "a")}


def test_whole_runs(spark):
    import random

    rng = random.Random(7)
    base = "".join(rng.choices("ACGT", k=3000))
    rows = [(i, base[(at := rng.randrange(0, 2900)) : at + 60], "I" * 60) for i in range(200)]
    r = frame(spark, rows, "read_id long, seq string, qual string")
    for kernel in ("kmer", "alignment"):
        out = redundancy.run(r if kernel == "kmer" else r.drop("qual"), Mating(kernel=kernel), Sampling(max_queries=50, replicates=64))
        assert out.mates.agg(F.min("mates")).head()[0] >= 1
        values = [x["avg"] for x in out.summary.orderBy("portion_idx").collect()]
        assert values[0] == 0 and values[-1] > values[len(values) // 2]
        meta, points = redundancy.curve_tables(out, "x")
        assert curve.points(points, meta).count() == len(values)


def test_runs_by_minimizer(spark):
    """All k-mers by plain counting, with other characters, lower case, nulls, groups, and a read that most rows repeat; runs take a fraction of what windows take."""
    rng = random.Random(4)
    rows = [(i, rng.choice(("a", "b", None)), "".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACgt") for _ in range(rng.choice((0, 3, 8, 9, 40, 300))))) for i in range(200)]
    rows += [(1000 + i, "a", "A" * rng.choice((9, 50))) for i in range(300)] + [(2000, "b", None)]
    df = spark.createDataFrame(rows, "read_id long, g string, seq string").repartition(5)
    comp = str.maketrans("ACGT", "TGCA")
    for k in (1, 9, 13, 32):
        every, within = Counter(), Counter()
        for _, g, s in rows:
            s = (s or "").upper()
            for w in (s[i : i + k] for i in range(len(s) - k + 1)):
                if set(w) <= set("ACGT"):
                    every[w] += 1
                    within[g, w] += 1
        firsts = {i: (g, (s or "").upper()[:k]) for i, g, s in rows if len(s or "") >= k and set((s or "").upper()[:k]) <= set("ACGT")}
        rc = lambda w: w.translate(comp)[::-1]
        assert {r["query_id"]: r["mates"] for r in kmer_runs.mates(df, k).collect()} == {i: every[w] + every[rc(w)] for i, (_, w) in firsts.items()}
        assert {r["query_id"]: (r["g"], r["mates"]) for r in kmer_runs.mates(df, k, by="g").collect()} == {i: (g, within[g, w] + within[g, rc(w)]) for i, (g, w) in firsts.items()}
        assert {r["occurrences"]: r["n_kmers"] for r in kmer_runs.spectrum(df, k).collect()} == dict(Counter(every.values()))
    assert kmer_runs.mates(df.limit(0), 9).count() == kmer_runs.spectrum(df.limit(0), 9).count() == 0
    moved = kmer_runs.runs(df.where("read_id < 1000"), 24).agg(F.sum(F.length("run") + 16).alias("bytes"), F.sum("n").alias("n")).head()
    windows = sum(len(s) - 23 for i, _, s in rows if i < 1000 and len(s or "") > 23)
    assert moved["bytes"] < 0.5 * 16 * windows
    assert kmer_runs.runs(df.where("read_id BETWEEN 1000 AND 1999").coalesce(1), 9).count() <= 2  # equal runs travel once


def test_closed_summary_of_many_draws(spark):
    """The closed form against replicates drawn query by query in numpy."""
    import numpy as np

    mates, n, total = np.array([1, 2, 5, 40, 300]), np.array([300, 200, 200, 200, 100]), 5000
    hist = spark.createDataFrame([(int(a), int(b)) for a, b in zip(mates, n)], "mates long, n_queries long")
    points = spark.createDataFrame([(0, 0.0), (1, 0.002), (2, 0.05), (3, 0.3), (4, 1.0)], "portion_idx int, portion double")
    rng = np.random.default_rng(3)
    every = np.repeat((mates - 1) / (total - 1), n)
    for r in rarefaction.expected_summary(hist, points, total).collect():
        found = 1 - (1 - every) ** max(0, int(total * r["portion"]) - 1)
        draws = []
        for _ in range(3000):
            inside = rng.random(len(every)) < r["portion"]
            draws.append((rng.random(inside.sum()) < found[inside]).mean() if inside.any() else 0.0)
        assert r["avg"] * (1 - (1 - r["portion"]) ** len(every)) == pytest.approx(np.mean(draws), abs=0.004)
        if r["portion"] * len(every) >= 30:
            assert r["sd"] == pytest.approx(np.std(draws), rel=0.12, abs=1e-3)
            assert [r["q1"], r["q2"], r["q3"]] == pytest.approx(list(np.quantile(draws, [0.25, 0.5, 0.75])), abs=0.02)


def test_large_samples_are_filters(spark):
    """The rows of a top-k by hash and id, found without a sort or a limit in the plan; ids that repeat count as rows."""
    rows = spark.range(3000).select((F.col("id") % 2900).alias("read_id"), F.lit("ACGT").alias("seq")).repartition(6)
    for x in (1, 50, 1999, 2999):
        wanted = sorted(r["read_id"] for r in reads.sample_fixed(rows, x, 5).collect())
        made = reads.sample_fixed(rows, x, 5, few=0)
        assert len(wanted) == x and set(r["read_id"] for r in made.collect()) == set(wanted) and x <= made.count() <= x + 1
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "TakeOrdered" not in plan and "Limit" not in plan
    assert reads.sample_fixed(rows, 5000, 5, few=0).count() == 3000


def test_composition_of_any_window(spark):
    """Dense, sparse and long windows against plain counting; letters outside of the alphabet, lower case and wide characters are dots."""
    rng = random.Random(9)
    seqs = ["".join(rng.choice("NACGTRYSWKMBDHVxn é") for _ in range(rng.choice((1, 2, 5, 40)))) for _ in range(60)] + ["A" * 300, "日本語ACGT", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)] + [(999, None)], "read_id long, seq string").repartition(3)
    from rarespan.operators import composition

    clean = ["".join(c if c in "NACGTRYSWKMBDHV" else "." for c in s) for s in seqs]
    for k in (1, 3, 4, 6, 17):
        wanted = Counter(s[i : i + k] for s in clean if len(s) > k for i in range(len(s) - k + 1))
        assert {r["kmer"]: r["count"] for r in composition.counts(df, k).collect()} == dict(wanted)
    zeroes = {r["kmer"]: r["count"] for r in composition.with_zeroes(composition.counts(df, 3), 3).collect()}
    assert len(zeroes) == 16**3 and sum(zeroes.values()) == sum(max(0, len(s) - 2) for s in clean if len(s) > 3)


def test_is_mate_in_sql(spark):
    """Row by row against every shift of each pair, on either strand."""
    from rarespan.functions import sql

    rng = random.Random(2)
    read = lambda n: "".join(rng.choice("ACGTN" if rng.random() < 0.03 else "ACGT") for _ in range(n))
    rows = []
    for i in range(150):
        a = read(rng.choice((0, 10, 20, 31)))
        b = a[rng.randrange(0, 6) :] + read(4) if rng.random() < 0.7 else read(20)
        b = mating_align.reversed_strand(b, False) if rng.random() < 0.5 else b
        rows.append((i, a if i % 17 else None, b, rng.choice((0.5, 0.8)), rng.choice((0.9, 0.95)) if i % 19 else None))
    sql.register(spark)
    got = spark.createDataFrame(rows, "i long, a string, b string, o double, s double").selectExpr("i", "is_mate(a, b, o, s) AS y").collect()
    for r in got:
        _, a, b, o, s = rows[r["i"]]
        if a is None or s is None:
            assert r["y"] is None
            continue
        short, long_ = (a, b) if len(a) < len(b) else (b, a)
        m = Mating(kernel="alignment", overlap=o, similarity=s)
        assert r["y"] == (bool(short) and any(mating_align.match_matrix(mating_align.matrix([x]), mating_align.matrix([long_]), m)[0, 0] for x in (short, mating_align.reversed_strand(short, False))))
    assert {r["y"] for r in got} == {True, False, None}


def test_bit_planes_compare_as_bytes_do():
    """Words and bytes give the same matches, for every rule of N, over and across word edges; other characters take the bytes."""
    import numpy as np

    rng = random.Random(6)
    for la, lb in ((20, 20), (30, 64), (64, 65), (70, 200)):
        base = "".join(rng.choice("ACGT") for _ in range(400))

        def read(n):
            at = rng.randrange(0, 400 - n)
            return "".join(c if rng.random() > 0.06 else rng.choice("ACGTNN") for c in base[at : at + n])

        short, long_ = mating_align.matrix([read(la) for _ in range(40)]), mating_align.matrix([read(lb) for _ in range(40)])
        for m in (Mating(kernel="alignment", overlap=0.5, similarity=0.8), Mating(kernel="alignment", overlap=0.5, similarity=0.8, n_mismatch=True), Mating(kernel="alignment", overlap=0.3, similarity=0.9, n_wildcard=True)):
            plain = np.zeros((40, 40), bool)
            for x, y, most in mating_align.shifts(la, lb, m):
                plain |= mating_align.differing(short[:, None, x], long_[None, :, y], m).sum(axis=2) <= most
            assert np.array_equal(mating_align.match_matrix(short, long_, m), plain) and plain.any() and not plain.all()
            odd = short.copy()
            odd[0, 0] = ord("x")
            assert mating_align.match_matrix(odd, long_, m).shape == plain.shape


@pytest.mark.parametrize("m", [Mating(kernel="alignment", **flags) for flags in ({}, {"n_mismatch": True}, {"n_wildcard": True}, {"literal_reverse": True}, {"literal_reverse": True, "n_wildcard": True}, {"literal_reverse": True, "n_mismatch": True}, {"both_strands": False, "n_wildcard": True})])
def test_seeds_find_what_every_shift_finds(spark, monkeypatch, m):
    """Related reads of many lengths, some with an N, some with dense N or other characters, more queries than a block takes."""
    import random

    rng = random.Random(31)
    genome = "".join(rng.choices("ACGT", k=900))
    rows = []
    for i in range(260):
        at, n = rng.randrange(0, 800), rng.choice((44, 50, 61, 62, 70, 100))
        s = list(genome[at : at + n])
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            s[rng.randrange(len(s))] = rng.choice("ACGTN")
        if i % 9 == 0:
            s[5:25] = [c if rng.random() < 0.5 else "N" for c in s[5:25]]
        if i % 31 == 0:
            s[3] = "X"
        s = "".join(s)
        rows.append((i, mating_align.reversed_strand(s, False) if i % 3 == 1 else s))
    rows += [(1000 + i, s) for i, s in rows[:40]] + [(2000, ""), (2001, None)]
    r = frame(spark, rows, "read_id long, seq string")
    q = r.where("read_id % 3 = 0").withColumnRenamed("read_id", "query_id")
    seen, asked = r.where("seq <> ''"), q.where("seq <> ''")
    wanted = {x["query_id"]: x["n"] for x in mating_align.counted(mating_align.pairs_all(asked, seen, m)).collect()}
    monkeypatch.setattr(mating_align, "pairs_all", None)  # no pair is tried at every shift but those of odd sequences
    got = {x["query_id"]: x["mates"] for x in mating_align.mates(q, r, m).collect()}
    assert got == {x["query_id"]: wanted.get(x["query_id"], 0) for x in q.collect()} and max(wanted.values()) > 5
    if m.literal_reverse or m.n_wildcard:
        monkeypatch.setattr(mating_align, "MANY", 20)
        assert {x["query_id"]: x["mates"] for x in mating_align.mates(q, r, m).collect()} == got


def test_literal_draws_of_groups_ask_every_query(spark):
    """Every replicate draws from every query, uniform by uniform; the registered curves come from such draws."""
    import hashlib
    import statistics

    from rarespan import catalogue

    mated = frame(spark, [("x", i, 1 + i % 5) for i in range(60)] + [("y", i, 3) for i in range(7)], "label string, query_id long, mates long")
    meta = frame(spark, [("x", 60), ("y", 7)], "label string, R long")
    s = Sampling(replicates=12, seed=4)
    u = lambda *parts: int(hashlib.md5("|".join(map(str, (4, *parts))).encode()).hexdigest()[:8], 16) / 2**32
    got = {(r["label"], r["portion_idx"]): r for r in grouped.summaries(mated, meta, "label", s, literal=True).collect()}
    own = {"x": [(i, 1 + i % 5) for i in range(60)], "y": [(i, 3) for i in range(7)]}
    assert {k[0] for k in got} == {"x", "y"} and any(r["sd"] > 0 for r in got.values())
    for (label, idx), r in got.items():
        values, total = [], r["R"]
        for run in range(12):
            inside = [(i, m) for i, m in own[label] if u(label, idx, run, i, "in") < r["portion"]]
            found = [i for i, m in inside if u(label, idx, run, i, "hit") < 1 - (1 - (m - 1) / (total - 1)) ** max(0, math.floor(total * r["portion"]) - 1)]
            values.append(len(found) / len(inside) if inside else 0.0)
        assert [r["avg"], r["sd"], r["q1"], r["q2"], r["q3"]] == pytest.approx([statistics.fmean(values), statistics.pstdev(values), *(sorted(values)[i] for i in (3, 6, 9))], abs=1e-9)
    assert all("unnest(range(0, 32)) AS replicate" in catalogue.oracle_sql()[n] for n in ("coverage_points", "curve_fit", "plot_series", "curve_set_add"))


def test_counting_runs_holds_little_at_once():
    """Many long runs of one minimizer are counted piece by piece: far less memory than all their windows take."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    own = ["".join(rng.choice(list("ACGT"), 90)) for _ in range(500)]
    text = pa.array([s.encode() for s in own * 80], pa.binary())
    one = kmer_runs.Counted(24)
    tracemalloc.start()
    one.add(text, np.ones(len(text), np.int64), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(one.code) == 500 * 67 and set(one.n.tolist()) == {80}
    assert peak < 100 * 2**20  # 3.6 million bases


#: Curve queries whose SQL had once been changed from draws to a closed form.
DRAWN = [
    "curve_checks",  # F4
    "curve_fit_grid",  # F5
    "curve_fit",  # F6
    "curve_fit_weighted",  # F7
    "curve_summary_by_language",  # F8
    "predict_coverage",  # F9
    "dispersion_bands",  # F10
    "plot_series",  # F11
    "curve_json",  # F12
]


@pytest.mark.parametrize("name", DRAWN)
def test_drawn_curves_ask_every_query(spark, monkeypatch, name):
    """Of every read of the table 32 replicates are drawn, in the SQL and in the query."""
    from rarespan import catalogue

    sql, sf_dir = catalogue.oracle_sql()[name], "/root/testdata/sf0.001"
    assert "FROM m JOIN g USING (label), (SELECT unnest(range(0, 32)) AS replicate)" in sql and "fd AS" not in sql and "LIMIT" not in sql.upper() and "SAMPLE" not in sql.upper()
    drawn, seen = grouped.literal_draws, []

    class Drawn(Exception):
        pass

    def recorded(mated, points, by, s):
        seen.append((mated.count(), s.replicates, drawn(mated, points, by, s).groupBy("replicate").count().count()))
        raise Drawn

    monkeypatch.setattr(grouped, "literal_draws", recorded)
    with pytest.raises(Drawn):
        catalogue.queries()[name](spark, sf_dir)
    assert seen == [(catalogue.language_reads(spark, sf_dir).where(F.length("seq") >= catalogue.K).count(), 32, 32)]
