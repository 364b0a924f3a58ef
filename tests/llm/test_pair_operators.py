"""N-gram join, URL filters, WARC revisits, components."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespan.llm import graph, ngram_join, url_filter, warc
from rarespan.llm.common import table


def brute_join(rows, percent=80):
    """rows (doc_id, text) to {(doc_id, text): (n, component)} by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    known = [(i, s) for (i, _), s in zip(rows, sets) if i is not None]
    for a in range(len(known)):
        for b in range(a):
            x, y = known[a][1], known[b][1]
            if x and y and (x == y or 100 * len(x & y) >= percent * len(x | y)):
                p, q = find(known[a][0]), find(known[b][0])
                parent[max(p, q)] = min(p, q)
    return {(i, t): (len(s), None if i is None else find(i)) for (i, t), s in zip(rows, sets)}


def test_ngram_join(odd, empty, clashing, spark, sf):
    for df in (odd, clashing, table(spark, sf, "documents")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        wanted = sorted(map(repr, ((i, *brute) for (i, t), brute in zip(rows, map(brute_join(rows).get, rows)))))
        got = ngram_join.join(df).collect()
        assert sorted(repr(tuple(r)) for r in got) == wanted
    assert ngram_join.join(empty).collect() == []
    assert ngram_join.one_of_each(empty).collect() == []


def family_rows(seed: int, n: int, edits: int):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: rng.randrange(50, 61)])))
    common = " ".join(f"c{i}" for i in range(25))
    rows += [(1000 + i, f"{' '.join(f'u{i}-{j}' for j in range(rng.randrange(5, 40)))} {common}") for i in range(60)]
    return rows


@pytest.mark.parametrize("seed,block,alike,limit,sure", [(16, 512, 5, 4096, 10), (3, 7, 12, 8, 16), (2, 5, 16, 2, 17), (4, 3, 1, 4, 1)])
def test_ngram_join_of_families(spark, monkeypatch, seed, block, alike, limit, sure):
    """Guests, blocks of families, long lists, weak families and wrong ones give what all pairs give."""
    for name, value in (("BLOCK_MEMBERS", block), ("ALIKE", alike), ("LIST", limit), ("SURE", sure)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = family_rows(seed, 90, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v for (i, _), v in brute_join(rows).items()}
    assert len({c for _, c in got.values()}) > 5


def shuffled(spark) -> int:
    """Bytes that all shuffles of the session have written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_ngram_join_moves_few_bytes(spark):
    """What all shuffles of the join write stays below 5.5 times the texts, most of which are of families; whole sets of hashes came to 7.3 times."""
    rng, rows = random.Random(1), []
    for f in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for m in range(5):
            words = list(base)
            for _ in range(6):
                words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            rows.append((f * 10 + m, " ".join(words)))
    before = shuffled(spark)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shuffled(spark) - before < 5.5 * sum(len(t) for _, t in rows)
    assert got == {i: c for (i, _), (_, c) in brute_join(rows).items()}


def test_ngram_join_of_long_words(spark, monkeypatch):
    """Blocks are dealt by bytes too, where a text has few shingles and long words."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 4096)
    rng = random.Random(7)
    base = [f"{i}" * 300 for i in range(100, 160)]
    rows = [(i, " ".join(w if rng.random() < 0.97 else f"{rng.random()}" for w in base)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.sparkContext.broadcast(ngram_join.frequent(docs, "text", 5))
    sizes = {r["doc_id"]: (r["n"], r["w"]) for r in ngram_join.summarise(docs, "text", 5, 80, often).collect()}
    assert all(sizes[i] == (len({tuple(t.split()[k : k + 5]) for k in range(56)}), len(t) // 8) for i, t in rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == {i: v for (i, _), v in brute_join(rows).items()}


def test_ngram_join_of_repeated_ids(spark):
    """A doc_id of several texts connects what is alike any of them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(4, a), (9, a), (9, c), (4, b), (7, f"{c} more"), (8, b), (20, "z " * 30), (21, "y"), (21, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(4, 4), (9, 4), (7, 4), (8, 4), (20, 20), (21, 21)} and len(got) == len(rows)


def random_entries(rng: random.Random, sets: int, percent: int, family: float):
    """Entries of the lists of random, partly alike sets, and the sets by family."""
    of_family: dict[int, list] = {}
    rows = []
    for i in range(sets):
        fam = i if rng.random() > family else 10**6 + rng.randrange(4)
        n = rng.randrange(1, 60)
        s = np.unique(np.array([rng.randrange(90) for _ in range(n)], np.uint64))
        of_family.setdefault(fam, []).append(set(map(int, s)))
        head = s[: ngram_join.prefix_length(len(s), percent)]
        pack = ngram_join.entries(np.array([fam]), np.array([fam >= 10**6]), np.array([len(s)]), np.array([5]), np.zeros(len(head), int), np.arange(len(head)))
        rows += [(int(h), fam, int(p)) for h, p in zip(head, pack)]
    return [np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64))], of_family


@pytest.mark.parametrize("percent", [80, 55])
def test_lists_skip_blocks_and_lose_no_pair(percent):
    rng, seen = random.Random(5), {}
    for trial in range(20):
        (h, fam, pack), of_family = random_entries(rng, 120, percent, 0.3)
        met = set()
        for (f, _), i, j in ngram_join.met_in_lists(h, fam, pack, percent, most=rng.choice((7, 2_000_000)), seen=seen):
            met |= {tuple(sorted(x)) for x in zip(f[i].tolist(), f[j].tolist())}
        names = sorted(of_family)
        for a in names:
            for b in names:
                if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in of_family[a] for y in of_family[b]):
                    assert (a, b) in met
    assert seen["read"] < (0.5 if percent == 80 else 0.8) * seen["possible"]


def test_answers_follow_from_a_pivot():
    rng, seen = random.Random(6), {}
    for trial in range(60):
        base = rng.sample(range(1000), 80)
        near = lambda lost: np.unique(np.array([x for x in base if rng.random() > lost] + [rng.randrange(1000, 3000) for _ in range(rng.randrange(1, 20))], np.uint64))
        hosts = [near(0.08) for _ in range(rng.randrange(1, 20))]
        guests = [near(rng.choice((0.05, 0.15, 0.6))) for _ in range(rng.randrange(1, 20))]
        closed = np.array([[rng.random() < 0.1 for _ in hosts] for _ in guests])
        wanted = np.array([[100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in hosts] for x in guests]) & ~closed
        got = ngram_join.derived(guests, hosts, closed, 80, seen)
        assert (got == wanted).all()
        edges = ngram_join.spanning(got)
        assert all(wanted[i, j] for i, j in edges) and {i for i, _ in edges} == set(np.flatnonzero(wanted.any(axis=1)))
        assert {j for _, j in edges} == set(np.flatnonzero(wanted.any(axis=0))) and len(edges) < len(hosts) + len(guests)
    assert seen["settled"] > 1000 and seen["counted"] > 1000


def test_bitmap_has_no_false_negative(spark):
    ids = spark.range(0, 300_000, 7)
    bitmap, bits = ngram_join.bitmap_of(ids)
    assert bits == (8 * ids.count()).bit_length() and len(bitmap) == 1 << (bits - 6)
    marked = ngram_join.maybe_in(spark.range(300_000), "id", ids, "m").groupBy((F.col("id") % 7 == 0).alias("own"), "m").count().collect()
    count = {(r["own"], r["m"]): r["count"] for r in marked}
    assert (True, False) not in count and count[False, True] < 0.2 * count[False, False]


def test_one_of_each(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    brute = brute_join(rows)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(odd).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows if r[0] is None or brute[r][1] == r[0])


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    wanted = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == wanted
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("last", [0, 20])
def test_components_in_rounds(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST", last)
    test_components(spark)


def test_few_links_are_merged_by_one_task(spark, monkeypatch):
    """Plans fill the driver's memory, however few their rows: rounds over 100 links once made 30 tables and 8 counts."""
    tables, cut, counts = [], graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: tables.append(1) or cut(df))
    monkeypatch.setattr(type(spark.range(1)), "count", lambda df: counts.append(1))
    got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")).collect()
    assert len(got) == 101 and {r["comp"] for r in got} == {0}
    assert len(tables) == 2 and not counts


def test_counted_counts_as_it_cuts(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 64)
    for rows, partitions in ((0, 1), (64, 1), (65, 2), (200, 4)):
        made = graph.counted(spark.range(200, numPartitions=8).join(spark.range(rows), "id").distinct().repartition(8))
        assert (made.rdd.getNumPartitions(), made.count()) == (partitions, rows)
    assert graph.cut_and_count(spark.createDataFrame([], "a long").where("false"))[1] == 0


def test_few_links_are_in_few_partitions(spark, monkeypatch):
    """Each task of a shuffle leaves files: rounds over few links once filled a disk with them."""
    made, cut = [], graph.cut

    def recorded(df):
        made.append(df.rdd.getNumPartitions())
        return cut(df)

    monkeypatch.setattr(graph, "cut", recorded)
    monkeypatch.setattr(graph, "ROWS", 64)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(got) == 101 and {r["comp"] for r in got} == {0}
    assert made[0] == 41 and max(made[1:]) <= 4


URLS = [
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.NET/x", "a.net", "/x", "net/", "block"),
    ("https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/english", "example.net", "/english", "net/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("https://m.example.com/de/#x", "m.example.com", "/de/", "example.com/de/", "block"),
    ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("https://casino-win.example.org/en", "casino-win.example.org", "/en", None, "block"),
    ("https://casino-win.example.org/fr/", "casino-win.example.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.org?x://y/z", "Äb.org", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "<title>win $$$ now</title>" if u[1].startswith("casino") else "<p>", "clash") for i, u in enumerate(URLS)] + [(0, URLS[0][0], None, "clash")], "page_id long, url string, html string, host string")
    for max_bytes in (64 << 20, 1):  # one cascade, and one per shard
        got = sorted(url_filter.judge(spark, pages, max_bytes=max_bytes).collect(), key=lambda r: r["page_id"])
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [u[1:] for u in [URLS[0], *URLS]]
    assert url_filter.judge(spark, pages.limit(0)).collect() == []


def test_url_list_from_pages(spark):
    """A key is listed by any of its pages, whatever the scheme and the query, and by its host's share of junk; a page without a url lists nothing."""
    rows = [(1, "http://a.com/x?1", "<title>fine</title>"), (2, "https://A.com/x", "<title>b%%%d</title>"), (3, "http://a.com/y", "<title>50% off $</title>$$$"), (4, None, "<title>###</title>"), (5, "", None), (6, "http://few.com/z", None), (7, "http://few.com/junk", "<title>$$$</title>")]
    rows += [(100 + i, f"http://bad.com/{i}", "<title>***</title>" if i == 3 else None) for i in range(25)] + [(200 + i, f"http://good.com/{i}", "<title>***</title>" if i == 3 else None) for i in range(26)]
    for max_bytes in (64 << 20, 1):
        got = {r["page_id"]: r["listed"] for r in url_filter.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), max_bytes=max_bytes).collect()}
        assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True} | {100 + i: True for i in range(25)} | {200 + i: i == 3 for i in range(26)}


@pytest.mark.parametrize("max_bytes", [1 << 20, 600])
def test_sharded_membership_is_exact(spark, max_bytes):
    """Thousands of keys against the set that they were made from, in one cascade and in many."""
    keys = spark.range(6000).select(F.col("id"), F.concat(F.lit("h"), F.col("id")).alias("key")).withColumn("wanted", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(4)) == 0)
    keys = keys.withColumns(dict(zip(("h1", "h2"), url_filter.hashes(F.col("key")))))
    rows = keys.unionByName(keys.where("id < 50"))
    got = url_filter.exact_members(rows, keys.select("h1", "h2", F.col("wanted").alias("listed")), max_bytes)
    assert got.count() == 6050 and got.where("listed <> wanted").count() == 0


def record(record_id, url, ts, kind="response", status=200, etag=None, last_modified=None, digest=None, headers=None):
    return (record_id, url, ts, kind, status, etag, last_modified, digest, headers)


RECORD = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"


def test_warc_cases(spark):
    rows = [
        record(1, "http://www.A.com:80/x/?utm_source=f&b=2&a=1#f", 10, etag='"e"', headers={"ETag": '"e"', "Content-Type": "t", "Date": "1"}),
        record(2, "https://a.com/x?a=1&b=2", 20, "revisit", 304, etag='W/"e"', headers={"date": "2", "Content-Length": "0", "Set-Cookie": "c"}),
        record(3, "https://a.com/x?a=1&b=2", 10, "revisit", 304, etag='"e"'),  # not earlier
        record(4, "https://a.com/x?a=1&b=2", 30, "revisit", 304, etag='"other"', last_modified="m"),
        record(5, "https://a.com/x?a=1&b=2", 15, status=404, etag='"e"'),  # not a full answer
        record(6, None, 40, "revisit", 304),
        record(7, None, 1),
        record(8, "http://b.com/", 50, "revisit", 304),
        record(9, "http://c.com", 1, last_modified="m", digest="d"),
        record(10, "http://c.com/", 2, "revisit", 304, last_modified="m"),
        record(11, "http://c.com/", 200_000, "revisit", 304, digest="d"),
        record(12, "http://c.com/", 300_000, "revisit", 304, digest="z"),
        record(13, "http://c.com/", 400_000, "revisit", 304),
        record(14, "http://c.com/", None, "revisit", 304),
        record(15, "http://c.com/", 400_001, "revisit", 304, headers={"ETag": "1", "etag": "2", "VARY": "v"}),
    ]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows + rows[1:2], RECORD).withColumn("span", F.lit("clash"))).collect()}
    facts = {k: (r["refers_to"], r["outcome"]) for k, r in got.items()}
    assert facts == {2: (1, "resolved"), 3: (None, "no_response"), 4: (1, "mismatch"), 6: (None, "no_response"), 8: (None, "no_response"), 10: (9, "resolved"), 11: (9, "resolved"), 12: (9, "mismatch"), 13: (9, "unverified"), 14: (None, "no_response"), 15: (9, "unverified")}
    assert got[2]["headers"] == {"etag": '"e"', "content-type": "t", "date": "2"} and got[2]["canonical_url"] == "a.com/x?a=1&b=2"
    assert got[4]["headers"] is None and got[15]["headers"]["vary"] == "v" and got[15]["headers"]["etag"] in "12"
    assert warc.resolve(spark.createDataFrame([], RECORD)).collect() == []


def test_warc_against_brute_force(spark):
    rng = random.Random(8)
    rows = [record(i, f"http://h{rng.randrange(4) if rng.random() < 0.8 else 0}.com/", rng.randrange(400), *(("revisit", 304) if rng.random() < 0.5 else ("response", rng.choice((200, 200, 500)))), etag=rng.choice("ab")) for i in range(600)]
    by_url = defaultdict(list)
    for r in rows:
        if r[3] == "response" and r[4] == 200:
            by_url[r[1]].append((r[2], r[0], r[5]))
    wanted = {}
    for r in rows:
        if r[3] == "revisit":
            last = max((x for x in by_url[r[1]] if x[0] < r[2]), default=None)
            wanted[r[0]] = (last and last[1], "no_response" if not last else "resolved" if last[2] == r[5] else "mismatch")
    for span in (7, 100, 10**6):
        got = {r["record_id"]: (r["refers_to"], r["outcome"]) for r in warc.resolve(spark.createDataFrame(rows, RECORD), span).collect()}
        assert got == wanted


def test_ports_belong_to_their_scheme(spark):
    """A port is left out only where the scheme implies it, so a revisit never takes another server's response."""
    urls = {"http://a.com:80/x": "a.com/x", "HTTPS://www.a.com:443/x/": "a.com/x", "http://a.com:443/x": "a.com:443/x", "https://a.com:80/x": "a.com:80/x", "http://a.com:/x": "a.com/x", "http://u:p@a.com:8080/x": "a.com:8080/x", "ftp://a.com:80/x": "a.com:80/x"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"]: r["c"] for r in df.select("url", warc.canonical(F.col("url")).alias("c")).collect()} == urls


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", None), (None, "http://a.com/", "<p>"), (3, None, "<p>"), (None, None, None)], "page_id long, url string, html string")
    got = warc.resolve(warc.captures(pages)).collect()
    assert len(got) == 4 and {r["record_id"]: r["outcome"] for r in got if r["record_id"]} == {3: "resolved", 7: "no_response"}
    assert all(r["outcome"] == "no_response" for r in got if r["record_id"] is None)
