"""Quality rules: a table of thresholds compiled into one projection. [native]

Per document the operator measures length, symbols, stop words, repeated lines and repeated words,
and compares them with THRESHOLDS. No shuffle, no user function: one scan, one projection, so the
cost is linear in the text and a hot source or a group of copies changes nothing.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged
alike, each on its own; there are no ties, as no row is compared with another; a very long text is one row
and is measured whole, up to 2^28 - 1 words, beyond which it is an error; an empty table gives an empty result; columns beside the text pass through. A clash of
an input column with a result column is resolved in favour of the result, and no other column is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarespan.llm.common import WS, WS_CHARS, fresh, let, symbol_count, word_array

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this", "at", "from", "a", "an", "or",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "ou",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "sich", "auf", "ein", "eine", "nicht", "im", "dem", "für",
    "el", "los", "las", "y", "del", "se", "no", "con", "para", "su", "al", "lo", "una", "por", "como",
)


@dataclass(frozen=True)
class Rule:
    """Keep if low <= 100 * measure <= high, in hundredths of `per`."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None


#: The production table.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10),
    Rule("stop_word_ratio", "n_stop", "n_words", low=2),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=50),
)


def measures(text: Column) -> dict[str, Column]:
    """Named measures; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop."""
    text = F.coalesce(text, F.lit(""))
    word_chars = F.length(F.translate(text, WS_CHARS, "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    return {"words": word_array(text), "lines": lines, "word_chars": word_chars, "n_symbols": symbol_count(text)}


#: Bits of a packed window that hold its position; the others hold its hash.
PLACE = 28


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    A window is packed into one long, the upper bits of its hash and its position, and the longs are sorted; windows
    beside one of equal hash bits, repeated ones and a few others, are then sorted by their words, where
    equal ones lie side by side.
    """
    n = F.size(words)
    ends = lambda w: F.sequence(F.lit(1), F.size(w) - 2)

    def candidates(s: Column, w: Column) -> Column:
        beside = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE) == 0, F.array(x, y)))
        place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
        some = F.transform(F.array_distinct(F.flatten(F.array_compact(beside))), place)
        return F.transform(some, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))

    def positions(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(F.get(s, j - 1), s[j]) | same(s[j], F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda j: F.array(s[j]["i"], s[j]["i"] + 1, s[j]["i"] + 2)))))

    packed = lambda w: F.transform(ends(w), lambda i: F.shiftleft(F.shiftright(F.xxhash64(w[i - 1], w[i], w[i + 1]), PLACE), PLACE).bitwiseOR((i - 1).cast("long")))
    too_long = F.raise_error(F.lit(f"a text has {1 << PLACE} words or more, which a packed window cannot place")).cast("int")
    found = lambda w: let(F.sort_array(packed(w)), lambda s: let(F.sort_array(candidates(s, w)), lambda c: F.when(F.size(c) < 2, F.lit(0)).otherwise(positions(c))))
    return F.when(n < 4, F.lit(0)).when(n >= 1 << PLACE, too_long).otherwise(let(words, found)).cast("long")


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one predicate; a ratio over nothing passes."""
    ok = F.lit(True)
    for r in rules:
        scaled, per = 100 * F.col(r.measure), F.col(r.per)
        if r.low is not None:
            ok = ok & (scaled >= F.lit(r.low) * per)
        if r.high is not None:
            ok = ok & (scaled <= F.lit(r.high) * per)
    return ok


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    made = measures(F.col(text))
    words, lines = fresh(docs, "_words"), fresh(docs, "_lines")
    out = docs.withColumns({words: made["words"], lines: made["lines"], "word_chars": made["word_chars"], "n_symbols": made["n_symbols"]})
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(F.col(words)),
            "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        }
    ).drop(words, lines)
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT doc_id, x, list_filter(regexp_split_to_array(x, '{WS}+'), lambda y: y <> '') AS ws,
    list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY 1),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda y: lower(y) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join([f"100 * {r.measure} >= {r.low} * {r.per}" for r in THRESHOLDS if r.low is not None] + [f"100 * {r.measure} <= {r.high} * {r.per}" for r in THRESHOLDS if r.high is not None])} AS kept
FROM b
"""
