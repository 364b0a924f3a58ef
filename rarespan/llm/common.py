"""What the operators of this subpackage share: table access, durable cuts of lineage, text expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan.session import share_path, spread

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20
#: White space of the word definition, as a regular expression class (fixed value).
WS = r"[\x20\x09-\x0D]"
#: The same characters, for trimming (fixed value).
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, on all cores even if it has few splits. Arrow batches are bounded by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spread(share_path(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. Only a local master may fall back to a temporary folder."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rarespan-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that a lost executor costs no recomputation beyond it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of intermediate tables that this driver has made, with their sessions.
MADE: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A folder of a new name in the shared checkpoint folder; it goes when the driver ends, or with release()."""
    MADE.append((spark, f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"))
    return MADE[-1][1]


def release() -> None:
    """Deletes the intermediate tables of this driver. What was made of them and is not written yet cannot be read afterwards."""
    while MADE:
        with contextlib.suppress(Exception):  # a session that has ended takes its file system along
            remove(*MADE.pop())


atexit.register(release)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, where later reads take the columns that they need."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sliced(batches, rows: int = 512):
    """Arrow batches of at most so many rows, so that what Python makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, whatever the number of its uses inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words of a text (null: none) in order."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WS + "+"))).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters of [#*$%&|<>]; null: 0."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")
