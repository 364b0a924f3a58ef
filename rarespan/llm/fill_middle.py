"""Fill-in-middle: a text is cut at two ends of units and written as prefix, suffix and middle behind sentinels.

Arrow-batched pandas functions: the regex library's finditer finds the ends of all units, kept in a compact array;
two look-ups in it give the slices; hashlib makes seeds and digests from the document's id. One narrow map: no
shuffle, and memory of one Arrow batch, whose bytes are bounded.

Rule fixes the sentinels, the unit, the seed and the rates, in hundredths, of transformed texts and of
suffix-first ones. A text that holds a sentinel stays plain, and no sentinel may overlap another, so every output
is taken apart again without doubt.

Defined results: a null text counts as empty and stays plain with no unit; a null id is seeded as an empty
string; rows that repeat are cut alike; there are no ties; a very long text is cut whole, and its ends take eight
bytes a unit; an empty table gives an empty result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from itertools import product

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = r"[^\n]*\n|[^\n]+"
    seed: int = 7
    rate: int = 100
    suffix_first: int = 50

    def __post_init__(self):
        for x, y in product(self.marks, repeat=2):
            if not x or (x is not y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"sentinels {x!r} and {y!r} overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


@dataclass(frozen=True)
class Cut:
    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


def cut(key: str | None, text: str | None, rule: Rule, unit: regex.Pattern) -> Cut:
    text = text or ""
    ends = array("Q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    n = len(ends) - 1
    seed = hashlib.sha256(f"{rule.seed}:{key or ''}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(seed[i : i + 4], "big") for i in range(0, 16, 4))
    if not text or any(m in text for m in rule.marks) or h3 % 100 >= rule.rate:
        return Cut(n, "plain", text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    before, between, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < rule.suffix_first:
        return Cut(n, "spm", f"{rule.suffix}{after}{rule.prefix}{before}{rule.middle}{between}", a, b - a)
    return Cut(n, "psm", f"{rule.prefix}{before}{rule.suffix}{after}{rule.middle}{between}", a, b - a)


def rebuilt(output: str | None, form: str | None, rule: Rule) -> str | None:
    """The text of an output; null of a null."""
    if output is None or form == "plain":
        return output
    first, second = (rule.prefix, rule.suffix) if form == "psm" else (rule.suffix, rule.prefix)
    one, _, rest = output[len(first) :].partition(second)
    two, _, between = rest.partition(rule.middle)
    before, after = (one, two) if form == "psm" else (two, one)
    return before + between + after


def cuts(keys: pd.Series, texts: pd.Series, rule: Rule) -> list[Cut]:
    unit = regex.compile(rule.unit)
    return [cut(k, t, rule, unit) for k, t in zip(keys, texts)]


def frame(made: list[Cut], **more: list) -> pd.DataFrame:
    whole = lambda name: pd.array([getattr(c, name) for c in made], dtype="Int64")
    return pd.DataFrame({"n": whole("n"), "form": [c.form for c in made], "prefix_chars": whole("prefix_chars"), "middle_chars": whole("middle_chars")} | more)


FIELDS = "n long, form string, prefix_chars long, middle_chars long"


def by_document(docs: DataFrame, text: str, key: str, function) -> DataFrame:
    made = docs.select(key, function(F.col(key).cast("string"), F.col(text)).alias("made"))
    return made.select(key, "made.*")


def transform(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output)."""

    @F.pandas_udf(f"{FIELDS}, output string")
    def transformed(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = cuts(keys, texts, rule)
        return frame(made, output=[c.output for c in made])

    return by_document(docs, text, key, transformed)


def restore(outputs: DataFrame, rule: Rule = Rule(), key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, form, output)."""

    @F.pandas_udf("string")
    def restored(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f, rule) for o, f in zip(output, form)], dtype=object)

    return outputs.select(key, restored("output", "form").alias("text"))


def digest(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """As transform, with output_sha256 and restored_sha256, the digest of what an output is rebuilt to, instead of the output."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    @F.pandas_udf(f"{FIELDS}, output_sha256 string, restored_sha256 string")
    def digested(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = cuts(keys, texts, rule)
        return frame(made, output_sha256=[sha(c.output) for c in made], restored_sha256=[sha(rebuilt(c.output, c.form, rule)) for c in made])

    return by_document(docs, text, key, digested)


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS ls, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, len(ls) - CASE WHEN ls[len(ls)] = '' THEN 1 ELSE 0 END AS n FROM t),
s AS (
  SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1)::UBIGINT AS u1, ('0x' || h[9:16])::UBIGINT % (n + 1)::UBIGINT AS u2,
    ('0x' || h[25:32])::UBIGINT % 100 AS f, x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') AS plain FROM u),
e AS (
  SELECT *, CASE WHEN least(u1, u2) = n THEN length(x) WHEN least(u1, u2) = 0 THEN 0 ELSE length(array_to_string(ls[1:least(u1, u2)], chr(10))) + 1 END AS a,
    CASE WHEN greatest(u1, u2) = n THEN length(x) WHEN greatest(u1, u2) = 0 THEN 0 ELSE length(array_to_string(ls[1:greatest(u1, u2)], chr(10))) + 1 END AS b FROM s),
o AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form, left(x, a) AS p, substr(x, a + 1, b - a) AS m, substr(x, b + 1) AS z FROM e)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN a::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || z || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || z || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM o
"""
