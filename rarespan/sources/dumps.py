"""MySQL dumps of an ontology as DataFrames.

A dump is cut into statements at every ; that stands outside strings, names in quotes and comments. Whether a place is
outside depends on all that comes before it, so a scan of the file in splits works in two steps: each split reports, for
every state that it may start in, the state in which each of its lines starts and how many statements have ended; a fold over
the splits of a file, a row each, gives the true first state and number; the lines then fall into pieces of numbered
statements, in parallel. A statement's pieces meet by their number, which is bounded by the size that the dump's writer
gives a statement. Rows of an INSERT are read by a scanner that accounts for every character: what is no row of values,
an unfinished string or a statement without its end is an error with the statement's place, never a row less.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarespan import schema
from rarespan.operators.iterate import durable
from rarespan.session import share_path

#: Tables that an option leaves out.
SKIPS = {"external": ("db", "dbxref", "term_dbxref", "term_db"), "synonyms": ("term_synonym",), "definitions": ("term_definition",)}

#: What a place in a dump may be inside of; 0 is outside.
OUTSIDE, SINGLE, DOUBLE, NAME, COMMENT = range(5)
#: From inside to the end of it, if that is on the line.
CLOSES = {SINGLE: re.compile(r"(?:[^'\\]+|\\.|'')*+'"), DOUBLE: re.compile(r'(?:[^"\\]+|\\.|"")*+"'), NAME: re.compile(r"[^`]*`"), COMMENT: re.compile(r"(?s:.*?)\*/")}
#: From outside to the next change.
OPENS = re.compile(r"""['"`;]|/\*|--(?=\s|$)|\#""")
INSIDE = {"'": SINGLE, '"': DOUBLE, "`": NAME, "/*": COMMENT}


def pieces(line: str, state: int) -> tuple[list[str], int]:
    """The line cut behind each end of a statement, without comments, and the state after it."""
    out, kept, at = [], [], 0
    while at < len(line):
        if state:
            closed = CLOSES[state].match(line, at)
            end = closed.end() if closed else len(line)
            if state != COMMENT:
                kept.append(line[at:end])
            state, at = (OUTSIDE if closed else state), end
            continue
        found = OPENS.search(line, at)
        kept.append(line[at : found.start()] if found else line[at:])
        if not found:
            break
        mark, at = found.group(), found.end()
        if mark == ";":
            out.append("".join(kept))
            kept = []
        elif mark in INSIDE:
            state = INSIDE[mark]
            kept.append("" if state == COMMENT else mark)
        else:
            break  # a comment up to the line's end
    return [*out, "".join(kept)], state


STATES = range(5)
EFFECTS = "file string, block long, at long, value string, state array<int>, ended array<long>, state_after array<int>, ended_after array<long>"


def effects(lines: DataFrame) -> DataFrame:
    """EFFECTS of (file, block, at, value), split by split in order: for each state that the split may start in, the state and the statements ended before the line and after it."""

    def run(batches):
        split, states, ended = None, list(STATES), [0] * len(STATES)
        for b in batches:
            before, after = [], []
            for file, block, value in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if split != (file, block):
                    split, states, ended = (file, block), list(STATES), [0] * len(STATES)
                before.append((states, ended))
                step = {s: pieces(value, s) for s in set(states)}  # most starts soon agree
                ended = [n + len(step[s][0]) - 1 for s, n in zip(states, ended)]
                states = [step[s][1] for s in states]
                after.append((states, ended))
            columns = [[x[i] for x in rows] for rows in (before, after) for i in (0, 1)]
            types = [pa.list_(pa.int32()), pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types))], ["file", "block", "at", "value", "state", "ended", "state_after", "ended_after"])

    return lines.mapInArrow(run, EFFECTS)


def starts(made: DataFrame) -> DataFrame:
    """(file, block, first, before): the true first state of each split, and the statements ended before it."""
    splits = made.groupBy("file", "block").agg(F.max_by(F.struct("state_after", "ended_after"), "at").alias("e")).select("file", "block", "e.*")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, n, out = rows.sort_values("block"), OUTSIDE, 0, []
        for block, after, ended in zip(rows["block"], rows["state_after"], rows["ended_after"]):
            out.append((rows["file"].iloc[0], block, state, n))
            state, n = int(after[state]), n + int(ended[state])
        return pd.DataFrame(out, columns=["file", "block", "first", "before"])

    return splits.groupBy("file").applyInPandas(fold, "file string, block long, first int, before long")  # a row per split


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, statement, finished): statements without their end and without comments; the last one of a file has no end and may be blank."""
    lines = share_path(spark).read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    made = durable(effects(lines))

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([pieces(v, s)[0] for v, s in zip(values, states)])

    placed = made.join(starts(made), ["file", "block"]).select("file", "block", "at", "value", F.get("state", "first").alias("state"), (F.get("ended", "first") + F.col("before")).alias("number"))
    parts = placed.select("file", "block", "at", "number", F.posexplode(cut("value", "state")).alias("k", "piece"))
    whole = parts.groupBy("file", (F.col("number") + F.col("k")).alias("number")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "at", "k", "piece")))["piece"], "\n").alias("statement"))
    return whole.join(parts.groupBy("file").agg(F.max(F.col("number") + F.col("k")).alias("last")), "file").select("file", "number", "statement", (F.col("number") < F.col("last")).alias("finished"))


HEAD = re.compile(r"\s*INSERT\s+(?:IGNORE\s+)?INTO\s+[`\"]?(\w+)[`\"]?\s*(?:\((?P<columns>[^)]*)\)\s*)?VALUES\s*", re.IGNORECASE)
VALUE = re.compile(r"""\s*(?:'((?:[^'\\]+|\\.|'')*+)'|"((?:[^"\\]+|\\.|"")*+)"|([^\s,()'"]+))\s*([,)])""", re.DOTALL)
BLANK = re.compile(r"\s*\Z")
NEXT_ROW = re.compile(r"\s*(?:,\s*)?\(")
ESCAPE = re.compile(r"\\(.)|''|\"\"", re.DOTALL)
#: What a letter behind a backslash stands for, in MySQL's strings (fixed values).
LETTERS = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def text_of(quoted: str) -> str:
    return ESCAPE.sub(lambda m: LETTERS.get(m[1], m[1]) if m[1] else m[0][0], quoted)


def rows_of(statement: str) -> tuple[str, list[list[str | None]]] | None:
    """(table, rows) of an INSERT, None of another statement; a ValueError says what cannot be read."""
    head = HEAD.match(statement)
    if not head:
        if re.match(r"\s*INSERT\b", statement, re.IGNORECASE):
            raise ValueError(f"this INSERT is not understood: {statement.strip()[:80]!r}")
        return None
    out, at = [], head.end()
    while not BLANK.match(statement, at):
        begun = NEXT_ROW.match(statement, at)
        if not begun or (not out) == ("," in begun.group()):
            raise ValueError(f"no row of values at {statement[at : at + 80]!r}")
        at, row, mark = begun.end(), [], ","
        while mark == ",":
            value = VALUE.match(statement, at)
            if not value:
                raise ValueError(f"no value at {statement[at : at + 80]!r}")
            single, double, bare, mark = value.groups()
            row.append(text_of(single) if single is not None else text_of(double) if double is not None else None if bare.upper() == "NULL" else bare)
            at = value.end()
        out.append(row)
    if not out:
        raise ValueError("an INSERT without rows")
    return head[1], out


def inserts(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(table, fields): one row per row of the dump's INSERT statements, fields as text, NULL as null. A statement that cannot be read whole is an error."""
    gone = {t for s in skip for t in SKIPS[s]}

    def run(batches):
        for b in batches:
            tables, fields = [], []
            for file, number, statement, finished in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if not finished and statement.strip():
                        raise ValueError(f"the dump ends inside of {statement.strip()[:80]!r}")
                    found = rows_of(statement)
                except ValueError as e:
                    raise ValueError(f"{file}, statement {number + 1}: {e}") from None
                if found and found[0] not in gone:
                    tables += [found[0]] * len(found[1])
                    fields += found[1]
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.string()), pa.array(fields, pa.list_(pa.string()))], ["table", "fields"])

    return statements(spark, path).mapInArrow(run, "table string, fields array<string>")


def read_dump(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The ontology's tables, typed; repeated rows count once, as in a chain of UNIONs."""
    rows = durable(inserts(spark, path, skip))

    def typed(name: str, columns: T.StructType) -> DataFrame:
        own = rows.where(F.col("table") == name)
        wide = F.when(F.size("fields") != len(columns), F.raise_error(F.concat(F.lit(f"a row of {name} has other than {len(columns)} values: "), F.to_json("fields"))).cast("array<string>")).otherwise(F.col("fields"))
        own = own.select(wide.alias("fields"))
        return own.select(*(F.get("fields", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(columns))).distinct()

    return {name: typed(name, columns) for name, columns in schema.ONTOLOGY.items()}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """As Parquet, a folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
