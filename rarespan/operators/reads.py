"""Tables of reads: statistics, ranges, pairs, quality, and the query set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.config import Mating, Sampling
from rarespan.functions import sequence as S


def from_text(table: DataFrame, key: str, text: str = "text", header: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """([keep,] read_id, header, seq): the bases of a text column, upper-cased. Other characters go first, as upper case may make letters of them."""
    name = F.concat_ws(":", *(header or [key]))
    return table.select(*keep, F.col(key).alias("read_id"), name.alias("header"), F.upper(F.regexp_replace(text, "[^ACGTacgt]+", "")).alias("seq"))


def letters_from_text(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(read_id, seq): the letters of a text column, upper-cased, for compositions over 16 letters."""
    return table.select(F.col(key).alias("read_id"), F.upper(F.regexp_replace(text, "[^A-Za-z]+", "")).alias("seq"))


def non_empty(reads: DataFrame) -> DataFrame:
    return reads.where(F.length("seq") > 0)


def stats(reads: DataFrame) -> DataFrame:
    """One row: n_reads, max_len, total_len, mean_len of non-empty reads."""
    n = F.length("seq")
    return non_empty(reads).agg(F.count("*").alias("n_reads"), F.max(n).cast("long").alias("max_len"), F.sum(n).cast("long").alias("total_len"), F.avg(n).alias("mean_len"))


def in_range(reads: DataFrame, first: int, number: int) -> DataFrame:
    """Records first to first + number - 1 of dense ids."""
    return reads.where(F.col("read_id").between(first, first + number - 1))


def one_mate(reads: DataFrame, index: str = "read_id") -> DataFrame:
    """The even ones of interleaved pairs."""
    return reads.where(F.pmod(F.col(index), F.lit(2)) == 0)


def accurate(reads: DataFrame, most: float = 0.01) -> DataFrame:
    """Reads whose mean base error is at most `most`."""
    p = S.error_probabilities(F.col("qual"))
    return reads.where(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) <= most * F.length("qual"))


def bounded_count(reads: DataFrame, limit: int) -> int:
    """Number of reads, at most limit + 1; none is an error."""
    n = reads.limit(limit + 1).count()
    if not n:
        raise ValueError("no reads found")
    return n


def resolve_queries(reads: DataFrame, kernel: str, sampling: Sampling) -> int:
    """Query reads to draw: the wanted number, or 3/4 of a dataset that is not larger than its limit."""
    x = sampling.queries_for(kernel)
    limit = x * 4 // 3 if kernel == "kmer" else x
    n = bounded_count(reads, limit)
    return n * 3 // 4 if n <= limit else x


def long_enough(reads: DataFrame, mating: Mating) -> DataFrame:
    """Reads of k bases or more; shorter ones are an error or dropped."""
    if mating.on_short == "drop":
        return reads.where(F.length("seq") >= mating.k)
    short = F.when(F.length("seq") < mating.k, F.raise_error(f"a read is shorter than {mating.k}").cast("string"))
    return reads.withColumn("seq", F.coalesce(short, "seq"))


def sample_fixed(reads: DataFrame, x: int, seed: int, few: int = 50_000) -> DataFrame:
    """x reads without replacement, each equally likely, the same on each run: the first by a hash of the id, then by the id.

    Up to `few` reads are a top-k. A larger sample, which may grow with the data, is a filter: counts per range of hashes,
    four digits at a time, lead to the range that holds the last read of the sample, and that one's hash and id are the bound. So
    nothing is sorted but the rows of one small range, and the reads do not move.
    """
    u = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("read_id").cast("string")))
    if x <= few:
        return reads.withColumn("_u", u).orderBy("_u", "read_id").limit(x).drop("_u")
    keys, prefix, left = reads.select("read_id", u.alias("u")), "", x
    while True:
        inside = keys.where(F.startswith("u", F.lit(prefix))) if prefix else keys
        counts = sorted((r["p"], r["count"]) for r in inside.groupBy(F.substring("u", 1, len(prefix) + 4).alias("p")).count().collect())  # 65536 rows at most
        for p, n in counts:
            if n >= left:
                break
            left -= n
        else:
            return reads  # no more than x
        prefix = p
        if n <= few or len(prefix) >= 32:
            break
    last = keys.where(F.startswith("u", F.lit(prefix))).orderBy("u", "read_id").limit(left).orderBy(F.desc("u"), F.desc("read_id")).head()
    return reads.where((u < last["u"]) | (u == last["u"]) & (F.col("read_id") <= last["read_id"]))


def sample_bernoulli(reads: DataFrame, portion: float, seed: int) -> DataFrame:
    """Each read with probability portion."""
    return reads if portion >= 1 else reads.where(S.uniform(seed, F.col("read_id")) <= portion)


def kmer_queries(reads: DataFrame, k: int, with_errors: bool = False) -> DataFrame:
    """(query_id, kmer, kmer_rc[, p_err]): first k-mers that are bases only."""
    kmer = S.first_kmer(F.col("seq"), k)
    error = [S.kmer_error(F.col("qual"), k).alias("p_err")] if with_errors else []
    return reads.where(S.is_kmer(F.substring("seq", 1, k), k)).select(F.col("read_id").alias("query_id"), kmer.alias("kmer"), S.reverse_complement(kmer).alias("kmer_rc"), *error)


def draw_kmer_queries(reads: DataFrame, mating: Mating, sampling: Sampling, x: int | None = None, with_errors: bool = False) -> DataFrame:
    """The query set: x usable reads; more than three unusable ones for each wanted is an error."""
    x = x or resolve_queries(reads, "kmer", sampling)
    usable = kmer_queries(reads, mating.k, with_errors)
    found, tried = usable.limit(x).count(), reads.limit(4 * x + 1).count()
    if found < min(x, tried - 3 * x):
        raise ValueError("too many reads start with something else than bases")
    return sample_fixed(usable.withColumnRenamed("query_id", "read_id"), x, sampling.seed).withColumnRenamed("read_id", "query_id")
