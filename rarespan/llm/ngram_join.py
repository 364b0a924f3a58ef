"""N-gram Jaccard join with set-relation skipping: the components of all texts whose shingle sets are alike.

Two texts link when 100 * |A & B| >= 80 * |A | B| of their sets of five-word shingles (64-bit hashes).

1. Equal sets form classes, and only one document of a class goes on.
2. Relations. Classes that have a value of a 16-value sketch in common with one of a few leads are a family if
   the sketches agree in ALIKE values; it is a guess about where answers lie, and no result hangs on it. Each
   member is compared with one or two leads by its whole set, which links most of a family.
3. The index. Shingles have one global order, frequent ones last (FREQUENT, by a constant-rate sample of
   documents: the order decides cost, never the result). Sets with a Jaccard of 0.8 share a shingle among the
   first |A| - ceil(0.8 |A|) + 1 of each, so a list holds the sets that have a shingle there, with its position.
   A family's members of like size and position are one entry of a list. A list is cut into blocks by size and
   sorted by position; a shingle at positions i and j of sets of n and m leaves min(i, j) + min(n - i, m - j)
   shared shingles at most, so of each block that is not skipped by its sizes only a window of positions is read.
   What is left is counted by pair of entries, and where the two prefixes end bounds what can follow.
4. Answers. Pairs of single sets are compared by their whole sets. A set that the index pairs with a family, or a
   member that its lead did not link, becomes the family's guest and meets the family in blocks: it is compared
   with one pivot of the block, and the answers for the pivot's relatives follow from how they differ from it.
   |x & p| + |y - p| bounds |x & y|, which settles most relatives at once; for the rest |x & y| is |x & p| less
   the shared part of p - y plus that of y - p. A block reports a spanning forest of its links, never its pairs.
5. Components of all links, over classes, then documents.

Scale: a list of a frequent shingle is dealt to block pairs of about LIST entries; families and guests to blocks of
BLOCK_MEMBERS sets or BLOCK_SHINGLES shingles, the number of which is known before any set is moved, and SIDE by SIDE
blocks meet in a task. Tables of few rows are in few partitions, as each task leaves files; few links are merged by
one task, as each plan fills the driver. The driver
holds a bitmap sized by its count, 128 MB at most, and at most FREQUENT shingles. What moves is written to disk, and
hashes do not compress: texts move to where they meet and become sets there, prefixes stay where they were made unless
a relation needs their document looked up, and sketches are compared by SHORT bits a value. Two large families that are just short of linking cost the product of their sizes
in derived answers: nothing is dropped to avoid it.

Defined results: null or empty texts and texts without a word have no shingles and are their own
component; with fewer than five words the sequence is one shingle; equal texts link; rows that share a
doc_id are one node; a null doc_id links with nothing and has a null component; ties do not exist, as a
component is named by its least doc_id; a very long text is one set, and blocks hold fewer of such; an empty
table gives an empty result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespan.llm.common import cut, sliced, stored
from rarespan.llm.graph import components, counted

WIDTH, PERCENT, SKETCH, ALIKE, SURE = 5, 80, 16, 5, 10
#: Values of a sketch that look for leads, and bits of each value that sketches are compared by; both decide cost, never the result.
SEEK, SHORT = 8, 15
PIVOTS = (0, 0x2AAAAAAAAAAAAAAA, 0x1999999999999999)
SAMPLE_RATE, SAMPLE_COUNT, FREQUENT, LIST = 8, 4, 1 << 17, 4096
BLOCK_SHINGLES, BLOCK_MEMBERS, SALTS, SIDE = 1 << 20, 512, 32, 3
MOST_BITS = 30

GOLD = np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) | 1 for i in range(SKETCH)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to hash; emptied when it has too many, which changes nothing but time."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z are lower-cased."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(words) > 200_000:
        words.clear()
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        s = (s ^ (s >> np.uint64(32))) * GOLD + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(s))


def needed(n, percent: int = PERCENT):
    """ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def prefix_length(n, percent: int = PERCENT):
    return n - needed(n, percent) + 1


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the sketch's orders."""
    if not len(s):
        return np.zeros(SKETCH, np.uint64)
    return (s[:, None] * ODD).min(axis=0) if len(s) < 4096 else np.array([(s * o).min() for o in ODD], np.uint64)


def summarise(docs: DataFrame, text: str, width: int, percent: int, often) -> DataFrame:
    """(doc_id, n, w, c1, c2, sketch, end, head): the size of each set, its weight (its shingles, or its text's bytes by 8 if more), two sums that name it, its sketch, and its prefix with the place where it ends."""

    def run(batches):
        words, table = WordHashes(), often.value[0]
        longs = lambda x: pa.array(np.array(x, np.uint64).reshape(-1).view(np.int64))
        for b in sliced(batches):
            n, c1, c2, sketch, ends, heads = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words, width)
                n.append(len(s))
                c1.append(s.sum(dtype=np.uint64))
                c2.append(mixed(s + GOLD).sum(dtype=np.uint64))
                sketch.append(sketch_of(s))
                head, end = prefix(s, table, percent) if len(s) else (s, 0)
                ends.append(end)
                heads.append(head)
            lists = pa.ListArray.from_arrays(np.arange(0, SKETCH * (len(n) + 1), SKETCH, dtype=np.int32), longs(sketch))
            at = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            heads = pa.ListArray.from_arrays(at, longs(np.concatenate(heads)))
            size = pa.array(np.maximum(n, pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy() // 8), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), size, longs(c1), longs(c2), lists, pa.array(ends, pa.int64()), heads], ["doc_id", "n", "w", "c1", "c2", "sketch", "end", "head"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n long, w long, c1 long, c2 long, sketch array<long>, end long, head array<long>")


def alike(reps: DataFrame) -> DataFrame:
    """(cls, lead, same): classes and the leads, found by SEEK values, whose sketches agree with theirs in ALIKE values or more."""
    values = reps.select("cls", F.posexplode(F.slice("sketch", 1, SEEK)).alias("j", "v"))
    short = F.transform("sketch", lambda v: v.bitwiseAND(F.lit((1 << SHORT) - 1)).cast("short"))
    leads = values.groupBy("j", "v").agg(*(f(F.col("cls").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)).alias(f"{f.__name__}{i}") for i, x in enumerate(PIVOTS) for f in (F.min, F.max))).where("min0 < max0")
    leads = counted(leads.select("j", "v", F.array_distinct(F.array(*(f"{f}{i}" for i in range(len(PIVOTS)) for f in ("min", "max")))).alias("leads")))
    pairs = values.join(leads, ["j", "v"]).select("cls", F.explode("leads").alias("lead")).where(F.col("cls") != F.col("lead")).distinct()
    pairs = pairs.join(reps.select("cls", short.alias("s1")), "cls").join(reps.select(F.col("cls").alias("lead"), short.alias("s2")), "lead")
    same = F.size(F.filter(F.zip_with("s1", "s2", lambda x, y: x == y), lambda x: x))
    return counted(pairs.select("cls", "lead", same.alias("same")).where(F.col("same") >= ALIKE))


def own_leads(pairs: DataFrame) -> DataFrame:
    """(cls, lead): for each class the least of the leads that are surely alike, and the most alike one."""
    chosen = pairs.groupBy("cls").agg(F.min(F.when(F.col("same") >= SURE, F.col("lead"))).alias("first"), F.max(F.struct("same", "lead"))["lead"].alias("best"))
    return chosen.select("cls", F.explode(F.array_distinct(F.array_compact(F.array("first", "best")))).alias("lead"))


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows (cls, key, ...) joined with facts, one row per key; each key's rows are dealt to SALTS, so that a hot one is no single task's."""
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): into how many blocks the sets of each key are dealt; rows are (key, w)."""
    sizes = rows.groupBy(key).agg(F.sum("w").alias("all"), F.count("*").alias("m"))
    return sizes.select(key, F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("int").alias(name))


def own_block(k: str) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit("block")), F.col(k)).cast("int")


def lead_links(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the classes that link with their leads, by their whole sets; pairs (cls, lead), sizes (cls, w)."""
    dealt = counted(with_facts(pairs, blocks(pairs.join(sizes, "cls"), "lead", "k"), "lead").select("lead", own_block("k").alias("part"), "cls"))
    asked = dealt.select("lead", "part").distinct().select("lead", "part", F.col("lead").alias("cls"), F.lit(0).alias("turn"))
    rows = dealt.withColumn("turn", F.lit(1)).unionByName(asked).join(texts, "cls").select("lead", "part", "turn", "cls", "text")
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", "turn")  # a lead comes before its members

    def run(batches):
        words, of, leads = WordHashes(), None, []
        for b in sliced(batches):
            a, c = [], []
            for lead, part, turn, cls, text in zip(*(x.to_pylist() for x in b.columns)):
                own = shingles(text, words, width)
                if turn == 0:
                    leads = [*leads, own] if of == (lead, part) else [own]
                    of = lead, part
                elif len(own) and any((100 + percent) * int(found_in(own, s).sum()) >= percent * (len(own) + len(s)) for s in leads):
                    a.append(cls)
                    c.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample holds SAMPLE_COUNT times or more, the FREQUENT most frequent, sorted, with estimated counts."""

    def run(batches):
        words = WordHashes()
        for b in sliced(batches):
            sets = [shingles(t, words, width) for t in b.column(0).to_pylist()]
            heads = [s[: int(0.3 * len(s)) + 2] for s in sets]
            h, c = np.unique(np.concatenate(heads) if heads else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLE_RATE)) == 0)
    rows = drawn.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= SAMPLE_COUNT)
    rows = rows.orderBy(F.col("c").desc(), "h").limit(FREQUENT).toArrow()
    h, c = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order] * SAMPLE_RATE


def found_in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def prefix(s: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the global order, and where they end: 10 bits of the last hash, 1023 if frequent."""
    p = prefix_length(len(s), percent)
    head = s[: p + len(s) // 10 + 4]
    late = found_in(head, often)
    if (~late).sum() < p and len(head) < len(s):
        head, late = s, found_in(s, often)
    out = np.concatenate([head[~late], head[late]])[:p]
    end = 1023 if (~late).sum() < p else min(int(out[-1] >> np.uint64(54)), 1022)
    return out, end


#: An entry's pack, from the top: a family's entry or a set's (1 bit), size (26), end of the prefix (10), role (2), position (24).
FAMILY, SIZE, END, ROLE = 1 << 62, 36, 26, 24
FEW = {"n": (1 << 26) - 1, "end": 1023, "role": 3, "at": (1 << 24) - 1}


def coarse(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The size class of n by its five leading bits: the least size in it, and how many sizes it holds."""
    shift = np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - 5, 0)
    return n >> shift << shift, np.int64(1) << shift


def rank_of(n: np.ndarray) -> np.ndarray:
    """Size classes as consecutive numbers."""
    shift = np.maximum(np.frexp(n.astype(np.float64))[1].astype(np.int64) - 5, 0)
    return 16 * shift + (n >> shift)


def step_of(low: np.ndarray) -> np.ndarray:
    """Positions that count as one in a family's entries."""
    return np.maximum(low // 32, 1)


def unique_rows(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, sorted, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, order
    edge = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return [c[edge] for c in columns], np.diff(np.r_[edge, len(order)])


def entries(fam: np.ndarray, family: np.ndarray, n: np.ndarray, end: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Packs of the shingles at `pos` of the sets `at`; members of a family keep their size class and a coarse position."""
    low, _ = coarse(n)
    step = step_of(low)[at]
    single = (n << SIZE | end << END)[at] | pos
    return np.where(family[at], (FAMILY | low << SIZE)[at] | pos // step * step, single)


def postings(heads: DataFrame, often, most: int = 1 << 19) -> DataFrame:
    """(h, fam, pack) of (fam, family, n, end, head): the entries of the lists.

    Equal entries of a family's members are one before they move. A list that is expected to be long is dealt
    to block pairs.
    """

    def dealt(h, fam, pack, long_h, parts):
        is_long = found_in(h, long_h)
        hs, fams, packs = [h[~is_long]], [fam[~is_long]], [pack[~is_long]]
        for one in np.unique(h[is_long]):
            k = int(parts[np.searchsorted(long_h, one)])
            f, p = fam[h == one], pack[h == one]
            own, other = (mixed(f.view(np.uint64)) % np.uint64(k)).astype(np.int64)[:, None], np.arange(k)[None, :]
            cell = np.minimum(own, other) * k + np.maximum(own, other)
            hs.append(mixed(one + (cell.astype(np.uint64) + np.uint64(1)) * GOLD).ravel())
            fams.append(np.repeat(f, k))
            packs.append((p[:, None] | np.where(other == own, 0, np.where(own < other, 1, 2)) << ROLE).ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(fams)), pa.array(np.concatenate(packs))], ["h", "fam", "pack"])

    def run(batches):
        table, counts = often.value
        long_h, parts = table[counts > LIST], -(-counts[counts > LIST] // LIST)
        held, size = [], 0
        for b in batches:
            fam, n, end = (b.column(i).to_numpy() for i in (0, 2, 3))
            family, lists = b.column(1).to_numpy(zero_copy_only=False), b.column(4)
            offsets = lists.offsets.to_numpy()
            h, at = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(b.num_rows), np.diff(offsets))
            pack = entries(fam, family, n, end, at, np.arange(len(h)) - (offsets - offsets[0])[at])
            own = family[at]
            yield dealt(h[~own], fam[at[~own]], pack[~own], long_h, parts)
            held.append(unique_rows(h[own], fam[at[own]], pack[own])[0])
            size += len(held[-1][0])
            if size > most:
                yield dealt(*unique_rows(*map(np.concatenate, zip(*held)))[0], long_h, parts)
                held, size = [], 0
        if size:
            yield dealt(*unique_rows(*map(np.concatenate, zip(*held)))[0], long_h, parts)

    return heads.select("fam", "family", "n", "end", "head").mapInArrow(run, "h long, fam long, pack long")


def met_in_lists(h: np.ndarray, fam: np.ndarray, pack: np.ndarray, percent: int, most: int = 1 << 18, seen: dict | None = None):
    """Index pairs (of the sorted entries that come first) of different families that can link, list by list.

    A list's blocks are its size classes, sorted by position. A block meets those of sizes that can reach
    `percent`, and each of its entries reads one window of positions there; all else is skipped unread. `seen`
    takes the number of pairs in the lists and of those read.
    """
    (h, fam, pack), _ = unique_rows(h, fam, pack)
    family, low, at, role = pack >= FAMILY, pack >> SIZE & FEW["n"], pack & FEW["at"], pack >> ROLE & FEW["role"]
    high = np.where(family, low + coarse(low)[1] - 1, low)
    last = at + np.where(family, step_of(low), 1) - 1
    rank = rank_of(low)
    order = np.lexsort((at, rank, h))
    h, fam, pack, low, high, at, last, role, rank = (x[order] for x in (h, fam, pack, low, high, at, last, role, rank))
    entry = (fam, pack)
    if not len(h):
        return
    new_list = np.r_[True, h[1:] != h[:-1]]
    edge = np.flatnonzero(new_list | np.r_[True, rank[1:] != rank[:-1]])
    lists = np.cumsum(new_list)[edge]
    block = np.cumsum(np.isin(np.arange(len(h)), edge)) - 1
    least, most_n, widest = np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge), np.maximum.reduceat(last - at, edge)
    key, place = lists * 1024 + rank[edge], block << 25 | at
    farthest = rank_of(100 * most_n // percent + 1) - rank[edge]
    if seen is not None:
        lengths = np.diff(np.r_[np.flatnonzero(new_list), len(h)])
        seen["possible"] = seen.get("possible", 0) + int((lengths * (lengths - 1) // 2).sum())
    for d in range(int(farthest.max()) + 1):
        other = np.minimum(np.searchsorted(key, key + d), len(key) - 1)
        need = -(-percent * (least + least[other]) // (100 + percent))
        meets = (key[other] == key + d) & (100 * most_n >= percent * least[other])
        e = np.flatnonzero(meets[block])
        b = block[e]
        o = other[b]
        low_at = np.maximum(at[e] - (most_n[b] - need[b]) - widest[o], 0)
        high_at = np.minimum(last[e] + most_n[o] - need[b], FEW["at"])
        start = np.searchsorted(place, o << 25 | low_at)
        stop = np.searchsorted(place, o << 25 | np.maximum(high_at, 0), side="right")
        start = np.maximum(start, e + 1) if d == 0 else start
        count = np.where(high_at < 0, 0, np.maximum(stop - start, 0))
        if seen is not None:
            seen["read"] = seen.get("read", 0) + int(count.sum())
        total = np.cumsum(count)
        for lo in range(0, int(total[-1]) if len(total) else 0, most):
            some = slice(int(np.searchsorted(total, lo, side="right")), int(np.searchsorted(total, min(lo + most, total[-1]) - 1, side="right")) + 1)
            before = total[some] - count[some]
            skip, take = np.maximum(lo - before, 0), np.minimum(count[some], lo + most - before)
            width = take - skip
            i = np.repeat(e[some], width)
            j = np.repeat(start[some] + skip, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            good = (fam[i] != fam[j]) & (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            good &= (100 + percent) * (np.minimum(last[i], last[j]) + np.minimum(high[i] - at[i], high[j] - at[j])) >= percent * (low[i] + low[j])
            good &= np.where(role[i] == 0, role[j] == 0, role[i] + role[j] == 3)
            yield entry, i[good], j[good]


def pairs_of_lists(posted: DataFrame, percent: int) -> DataFrame:
    """(x, sx, y, sy, c): pairs of entries of different families that can link, with the number of lists that hold both; sx is a pack without role and position."""

    def pairs(h, fam, pack):
        for (f, p), i, j in met_in_lists(h, fam, pack, percent):
            turn = f[i] > f[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            if len(i):
                rows, c = unique_rows(f[i], p[i] >> END, f[j], p[j] >> END)
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(c.astype(np.int64))], ["x", "sx", "y", "sy", "c"])

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            cut_at = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[cut_at:] for c in cols]
            yield from pairs(*(c[:cut_at] for c in cols))
        if rest is not None:
            yield from pairs(*rest)

    return posted.mapInArrow(run, "x long, sx long, y long, sy long, c long")


def is_family(s: str) -> Column:
    return F.shiftright(s, SIZE - END + 26) > 0


def low_size(s: str) -> Column:
    return F.shiftright(s, SIZE - END).bitwiseAND(F.lit(FEW["n"]))


def class_of(n: str) -> Column:
    """The least size of n's size class."""
    return F.expr(f"shiftleft(shiftright({n}, greatest(length(bin({n})) - 5, 0)), greatest(length(bin({n})) - 5, 0))")


def admitted(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (x, sx, y, sy, c), the pairs whose shared prefix shingles leave room for enough shared shingles."""
    rows = pairs.withColumns({f"low_{a}": low_size(f"s{a}") for a in "xy"})
    high = {a: F.when(is_family(f"s{a}"), F.expr(f"low_{a} + shiftleft(1L, greatest(length(bin(low_{a})) - 5, 0)) - 1")).otherwise(F.col(f"low_{a}")) for a in "xy"}
    end = {a: F.col(f"s{a}").bitwiseAND(F.lit(FEW["end"])) for a in "xy"}
    first, final = ({a: F.when(is_family(f"s{a}"), F.lit(v)).otherwise(end[a]) for a in "xy"} for v in (0, FEW["end"]))
    after = {a: F.ceil(high[a] * percent / 100) - 1 for a in "xy"}
    room = F.when(final["x"] < first["y"], after["x"]).when(final["y"] < first["x"], after["y"]).otherwise(F.greatest(after["x"], after["y"]))
    return rows.where((100 + percent) * (F.col("c") + room) >= percent * (F.col("low_x") + F.col("low_y"))).select("x", "sx", "y", "sy")


def spots(key: Column, bits: int) -> list[Column]:
    """Two bits of a bitmap for a key, from different bits of its hash."""
    h = F.xxhash64(key, F.lit("bitmap"))
    return [F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1))]


def bitmap_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids with eight bits an id, and its number of bits as a power of two: no false negative. Beyond 2^MOST_BITS bits it clears fewer ids and errs in none."""
    bits = min(MOST_BITS, max(16, (8 * ids.count()).bit_length()))
    rows = ids.select(F.explode(F.array(*spots(F.col("id"), bits))).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)
    return out, bits


def in_bitmap(spots: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    s = spots.astype(np.uint64)
    return ((bitmap[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_in(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """df with the boolean `name`: false where key is surely not among ids."""
    bitmap, bits = bitmap_of(ids)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def probe(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(first.to_numpy(), shared.value) & in_bitmap(second.to_numpy(), shared.value))

    return df.withColumn(name, probe(*spots(F.col(key), bits)))


def texts_of(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """(cls, text) of the documents with these ids and of a few others, which a join clears: a bitmap of the ids lets the others stay."""
    rows = docs.select(F.col("doc_id").alias("cls"), F.col(text).alias("text")).where(F.col("cls").isNotNull() & F.col("text").isNotNull())
    return maybe_in(rows, "cls", ids, "_in").where("_in").drop("_in")


def columns_product(left_at, left_col, right_at, right_col, shape: tuple[int, int], width: int, step: int = 2048) -> np.ndarray:
    """left @ right.T of two 0/1 matrices given by their ones (row, column), `step` columns at a time."""
    out = np.zeros(shape, np.float32)
    sides = []
    for at, col in ((left_at, left_col), (right_at, right_col)):
        order = np.argsort(col, kind="stable")
        sides.append((at[order], col[order]))
    for first in range(0, width, step):
        dense = []
        for (at, col), rows in zip(sides, shape):
            lo, hi = np.searchsorted(col, [first, first + step])
            m = np.zeros((rows, min(step, width - first)), np.float32)
            m[at[lo:hi], col[lo:hi] - first] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def derived(guests: list[np.ndarray], hosts: list[np.ndarray], closed: np.ndarray, percent: int, seen: dict | None = None) -> np.ndarray:
    """Whether guests link with hosts, relatives of each other: (guests, hosts), false where closed.

    The guests' overlaps with one pivot are counted; a host's differences from the pivot bound what a guest
    shares with it, and give it exactly where the bound leaves it open.
    """
    n_g, n_h = (np.array([len(s) for s in x], np.int64) for x in (guests, hosts))
    pivot = hosts[int(np.argsort(n_h, kind="stable")[len(hosts) // 2])]
    flat_g, flat_h = np.concatenate(guests), np.concatenate(hosts)
    of_g, of_h = np.repeat(np.arange(len(guests)), n_g), np.repeat(np.arange(len(hosts)), n_h)
    in_g, in_h = found_in(flat_g, pivot), found_in(flat_h, pivot)
    base = np.bincount(of_g[in_g], minlength=len(guests))
    beyond = np.bincount(of_h[~in_h], minlength=len(hosts))
    need = percent * (n_g[:, None] + n_h)
    bound = np.minimum(np.minimum(base[:, None] + beyond, n_g[:, None]), n_h)
    open_ = ((100 + percent) * bound >= need) & ~closed
    if seen is not None:
        seen["settled"] = seen.get("settled", 0) + int((~open_ & ~closed).sum())
        seen["counted"] = seen.get("counted", 0) + int(open_.sum())
    if not open_.any():
        return open_
    shape = (len(guests), len(hosts))
    # what the guests share of pivot - host: columns are the pivot's shingles that some host lacks
    have = np.zeros((len(hosts), len(pivot)), bool)
    have[of_h[in_h], np.searchsorted(pivot, flat_h[in_h])] = True
    lacking = ~have.all(axis=0)
    column = np.cumsum(lacking) - 1
    at_g = np.searchsorted(pivot, flat_g[in_g])
    some = lacking[at_g]
    host, gone = np.nonzero(~have[:, lacking])
    less = columns_product(of_g[in_g][some], column[at_g[some]], host, gone, shape, int(lacking.sum()))
    # what they share of host - pivot
    new = np.intersect1d(flat_g[~in_g], flat_h[~in_h])
    g, h = found_in(flat_g, new) & ~in_g, found_in(flat_h, new) & ~in_h
    more = columns_product(of_g[g], np.searchsorted(new, flat_g[g]), of_h[h], np.searchsorted(new, flat_h[h]), shape, len(new))
    both = base[:, None] + np.rint(more - less).astype(np.int64)
    return open_ & ((100 + percent) * both >= need)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite graph given as a matrix, as (row, column) pairs."""
    out, row_seen, col_seen = [], np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        todo = [] if row_seen[start] else [(0, int(start))]
        row_seen[start] = True
        while todo:
            side, x = todo.pop()
            seen, near = (col_seen, linked[x]) if side == 0 else (row_seen, linked[:, x])
            for y in np.flatnonzero(near & ~seen):
                seen[y] = True
                out.append((x, int(y)) if side == 0 else (int(y), x))
                todo.append((1 - side, int(y)))
    return out


def guest_links(guests: DataFrame, members: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(a, b): links between guests (fam, cls, root, w) and the members (fam, cls, root, w) of their host family."""
    facts = cut(blocks(guests, "fam", "kg").join(blocks(members, "fam", "k"), "fam"))
    hosts = with_facts(members, facts, "fam").select("fam", F.lit(False).alias("guest"), own_block("k").alias("block"), F.col("kg").alias("others"), "cls", "root")
    visit = with_facts(guests, facts, "fam").select("fam", F.lit(True).alias("guest"), own_block("kg").alias("block"), F.col("k").alias("others"), "cls", "root")
    rows = counted(hosts.unionByName(visit))
    rows = rows.join(texts_of(docs, text, rows.select(F.col("cls").alias("id"))), "cls")

    packed = rows.groupBy("fam", "guest", "block", "others").agg(F.collect_list(F.struct("cls", "root", "text")).alias("x"))
    packed = packed.select("fam", "guest", "block", "others", "x.cls", "x.root", "x.text")
    # a block is one row that moves once to each SIDE blocks that it meets
    own, other = F.floor(F.col("block") / SIDE).cast("int"), F.explode(F.sequence(F.lit(0), F.floor((F.col("others") - 1) / SIDE).cast("int")))
    cells = packed.select("fam", "guest", own.alias("own"), other.alias("other"), "cls", "root", "text")
    cells = cells.select("fam", F.when(F.col("guest"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("guest"), F.col("other")).otherwise(F.col("own")).alias("j"), "guest", "cls", "root", "text")

    def block_of(r, words):
        sets = [shingles(t, words, width) for t in r.text]
        some = [i for i, s in enumerate(sets) if len(s)]
        return r.guest, np.asarray(r.cls)[some], np.asarray(r.root)[some], [sets[i] for i in some]

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        words, links = WordHashes(), []
        each = [block_of(r, words) for r in cell.itertuples()]
        for _, cls, root, left in (x for x in each if x[0] and x[3]):
            for _, host_cls, host_root, right in (x for x in each if not x[0] and x[3]):
                linked = derived(left, right, root[:, None] == host_root, percent)
                links += [(int(cls[x]), int(host_cls[y])) for x, y in spanning(linked)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cells.groupBy("fam", "i", "j").applyInPandas(run, "a long, b long")


def cross_links(pairs: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (x, y) that link, by their whole sets."""
    texts = texts_of(docs, text, pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))))
    both = pairs.join(texts.select(F.col("cls").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("cls").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches):
        words = WordHashes()
        for b in sliced(batches):
            link = []
            for left, right in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = shingles(left, words, width), shingles(right, words, width)
                link.append(len(s) > 0 and len(t) > 0 and (100 + percent) * int(found_in(s, t).sum()) >= percent * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(link, pa.bool_()))

    return both.select("x", "y", "tx", "ty").mapInArrow(run, "a long, b long")


def links_of(docs: DataFrame, known: DataFrame, reps: DataFrame, often, text: str, width: int, percent: int) -> DataFrame:
    """(a, b): enough links between classes to connect all that are connected. known: rows with a set; reps (n, c1, c2, cls, sketch, w)."""
    pairs = alike(reps)
    fams = components(pairs.select(F.col("cls").alias("a"), F.col("lead").alias("b")))
    fams = fams.select(F.col("node").alias("cls"), F.col("comp").alias("fam"))
    sizes = reps.select("cls", "n", "w")
    kin = texts_of(docs, text, fams.select(F.col("cls").alias("id")))
    led = counted(lead_links(own_leads(pairs), sizes, kin, width, percent))
    roots = components(led)
    members = fams.join(sizes, "cls").join(roots.select(F.col("node").alias("cls"), F.col("comp").alias("root")), "cls", "left")
    members = counted(members.select("fam", "cls", F.coalesce("root", "cls").alias("root"), "n", "w"))

    # only documents that may be of a family, or not their class's own, are looked up; the others' prefixes stay
    names = reps.select("n", "c1", "c2", F.col("cls").alias("doc_id")).join(fams.withColumnRenamed("cls", "doc_id"), "doc_id", "left")
    copies = known.select("doc_id", "n", "c1", "c2").join(reps.select("n", "c1", "c2", "cls"), ["n", "c1", "c2"]).where("cls <> doc_id")
    aside = counted(fams.select(F.col("cls").alias("id")).unionByName(copies.select(F.col("doc_id").alias("id"))))
    heads = maybe_in(known.select("n", "c1", "c2", "doc_id", "end", "head"), "doc_id", aside, "_in")
    stay = heads.where("NOT _in").select(F.col("doc_id").alias("fam"), F.lit(False).alias("family"), "n", "end", "head")
    named = heads.where("_in").join(names, ["n", "c1", "c2", "doc_id"])
    named = named.select(F.coalesce("fam", "doc_id").alias("fam"), F.col("fam").isNotNull().alias("family"), "n", "end", "head")
    posted = postings(stay.unionByName(named), often).repartition("h").sortWithinPartitions("h")
    met = pairs_of_lists(posted, percent).groupBy("x", "sx", "y", "sy").agg(F.sum("c").alias("c"))
    met = counted(admitted(met, percent))
    alone = ~is_family("sx") & ~is_family("sy")
    singles = counted(met.where(alone).select("x", "y").distinct())

    # guests: members that no lead linked with most of their family, and what the index pairs with a family
    most = members.groupBy("fam", "root").agg(F.count("*").alias("m")).groupBy("fam").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    unled = with_facts(members, most, "fam").where(F.col("root") != F.col("main")).select("fam", "cls", "root")
    paired = met.where(~alone).select(*(F.when(is_family("sx"), F.col(f"{a}x")).otherwise(F.col(f"{a}y")).alias(f"{a}h") for a in ("", "s")), *(F.when(is_family("sx"), F.col(f"{a}y")).otherwise(F.col(f"{a}x")).alias(f"{a}g") for a in ("", "s")))
    one = paired.where(~is_family("sg")).select(F.col("h").alias("fam"), F.col("g").alias("cls"), F.col("g").alias("root"))
    units = paired.where(is_family("sg")).select("h", F.col("g").alias("fam"), low_size("sg").alias("low")).distinct()
    units = units.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_size = members.select("fam", "cls", "root", "n", class_of("n").alias("low"), F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt"))
    many = by_size.join(units, ["fam", "low", "salt"]).select(F.col("h").alias("fam"), "cls", "root")
    guests = counted(unled.unionByName(one).unionByName(many).distinct().join(sizes.select("cls", "w"), "cls"))
    return led.unionByName(guest_links(guests, members, docs, text, width, percent)).unionByName(cross_links(singles, docs, text, width, percent))


def join(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs; doc_id is a long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, width))
    every = stored(summarise(docs, text, width, percent, often))
    facts = every.select("doc_id", "n", "c1", "c2")
    known = every.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = counted(known.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("cls"), F.first("sketch").alias("sketch"), F.max("w").alias("w")))
    names = reps.select("n", "c1", "c2", "cls")
    links = links_of(docs, known, reps, often, text, width, percent)

    # a doc_id of several texts connects their classes
    several = known.groupBy("doc_id").agg(*(f(F.struct("n", "c1", "c2")).alias(f.__name__) for f in (F.min, F.max))).where("min <> max").select("doc_id")
    texts = known.select("doc_id", "n", "c1", "c2").join(several, "doc_id", "left_semi").join(names, ["n", "c1", "c2"])
    joined = components(links.unionByName(texts.select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))))
    keys = names.join(joined, F.col("cls") == F.col("node"), "left").select("n", "c1", "c2", F.coalesce("comp", "cls").alias("comp"))
    out = facts.join(cut(keys), ["n", "c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that are not the least doc_id of their component; rows of a null doc_id stay.

    Only documents that a bitmap of the dropped ids does not clear are joined, so most texts never move.
    """
    gone = counted(join(docs, text).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct())
    docs = docs.drop("_maybe", "_gone")
    marked = maybe_in(docs, "doc_id", gone.select(F.col("_gone").alias("id")), "_maybe")
    unsure = marked.where("_maybe").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    return marked.where(~F.coalesce("_maybe", F.lit(False))).unionByName(unsure).drop("_maybe")
