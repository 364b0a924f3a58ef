"""Scalar expressions on sequences, all of them built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digit of each letter in a composition label, in order (fixed value).
LABEL_ALPHABET = "NACGTRYSWKMBDHV."
#: Two-bit code of a base (fixed values).
BASES, DIGITS = "AGCT", "0123"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row and not once per element of a lambda in body."""
    return F.transform(F.array(value), body)[0]


def reverse_complement(seq: Column) -> Column:
    """Upper-case bases are complemented, other characters become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def literal_reverse_complement(seq: Column) -> Column:
    """The historic form: N first, then the complement without the first base."""
    return F.when(F.length(seq) == 0, F.lit("")).otherwise(F.concat(F.lit("N"), reverse_complement(F.substring(seq, 2, 2147483647))))


def is_kmer(seq: Column, k: int) -> Column:
    return seq.rlike(f"^[ACGTacgt]{{{k}}}$")


def first_kmer(seq: Column, k: int) -> Column:
    return F.upper(F.substring(seq, 1, k))


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, most significant first; null unless all are bases. k = 32 uses the sign bit."""
    digits = F.translate(F.upper(kmer), BASES, DIGITS)
    low = F.substring(F.lpad(digits, 32, "0"), 17, 16)
    high = F.substring(F.lpad(digits, 32, "0"), 1, 16)
    code = lambda d: F.conv(d, 4, 10).cast("long")
    return F.when(F.upper(kmer).rlike("^[ACGT]{1,32}$"), F.shiftleft(code(high), 32).bitwiseOR(code(low)))


def kmer_bytes(seq: Column, k: int) -> Column:
    """Every window of k characters of an ASCII sequence as an array of binary values; empty if it is shorter."""
    windows = lambda raw: F.when(F.length(raw) >= k, F.transform(F.sequence(F.lit(1), F.length(raw) - (k - 1)), lambda i: F.substr(raw, i, F.lit(k))))
    return F.coalesce(let(F.encode(seq, "UTF-8"), windows), F.array().cast("array<binary>"))


def phred_error(quality: Column) -> Column:
    """Error probability of one Phred+33 character; above Q42 is an error."""
    q = F.ascii(quality) - 33
    return F.when((q >= 0) & (q <= 42), F.pow(F.lit(10.0), -q / F.lit(10.0))).otherwise(F.raise_error("quality outside 0..42").cast("double"))


def error_probabilities(quality: Column) -> Column:
    return F.transform(F.split(quality, ""), phred_error)


def kmer_error(quality: Column, k: int) -> Column:
    """Probability that the first k bases hold an error."""
    right = F.aggregate(error_probabilities(F.substring(quality, 1, k)), F.lit(1.0), lambda a, p: a * (1 - p))
    return F.lit(1.0) - right


def adjusted_length(length: Column, k: int) -> Column:
    """Windows of k in a read of a (mean) length."""
    return length - (k - 1)


def composition_label(seq: Column) -> Column:
    """Letters outside the 16-letter alphabet become '.'."""
    return F.regexp_replace(seq, "[^NACGTRYSWKMBDHV]", ".")


def label_order(kmer: Column) -> Column:
    """A string that sorts as the base-16 number of a composition label."""
    return F.translate(kmer, LABEL_ALPHABET, "0123456789ABCDEF")


def uniform(seed: int | str, *parts: Column) -> Column:
    """In [0, 1): 32 bits of an MD5 of the seed and the parts; the same on any engine and partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
