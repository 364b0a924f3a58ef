import os
import random

import pytest
from pyspark.sql import types as T

SF = os.environ.get("RARESPAN_SF", "/root/testdata/sf0.001")
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    vocabulary = [f"{a}{b}{c}" for a in "btkls" for b in ("a", "ei", "o", "ü") for c in ("n", "rd", "st", "", "lle")]
    out = []
    for i in range(n):
        out.append(rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(("the", "of", "and", "to")))
        if rng.random() < 0.08:
            out.append("\n")
    return " ".join(out[:words * 10]).replace(" \n ", ".\n")


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, repeated passages."""
    rng = random.Random(11)
    passage = "a line that comes back again\nand the one that follows it\nand a third one to make a window\n"
    base = prose(rng, 160)
    rows = [(1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, " \t\n\x0b\r ", None, None, 6), (None, base, "en", "s2", 5), (4, base, "en", None, 5), (4, base, "en", None, 5)]
    rows += [(5, base.replace("the", "ein", 2), "de", "s2", 7), (6, base.upper(), "de", "s2", 7), (7, "one two three", "en", "s3", 13), (8, "ONE  two\nthree", "en", "s3", 13), (9, "x" * 300_000, "fr", "s3", 300_000), (10, "日本語のテキスト 😀 é́ ​ \x1c\x85 ### %%%", "ja", "s4", 30)]
    rows += [(11, passage + prose(rng, 60) + "\n" + passage, "en", "s4", 1), (12, prose(rng, 60) + "\n" + passage, "en", "s1", 1), (13, "same\n" * 40, "en", "s1", 1), (14, " ".join(f"w{i}" for i in range(30_000)), "en", "s1", 1), (15, "12345 !!! --- 67", "en", "s5", 1)]
    rows += [(20 + i, prose(rng, rng.randrange(5, 200)), rng.choice(("en", "de", None)), rng.choice(("s1", "s1", "s2", "s9")), i) for i in range(30)]
    rows += [(60 + i, " ".join(w if rng.random() > 0.004 * i else "changed" for w in base.split(" ")), "en", "s1", i) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "key", "bucket", "target", "epochs", "taken", "left", "edge", "room", "before", "gone", "n_lines", "n_removed", "id", "cls", "fam", "p", "halo", "h1", "h2", "listed", "rank", "held_out", "n_words", "kept", "_maybe", "_words", "_lines", "_id", "_th", "tokens", "ids")
    return odd.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def sf():
    return SF
