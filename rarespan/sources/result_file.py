"""A result as one file of a name that the caller chooses, wherever Spark can write."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def one_file(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) writes parts with Spark; they become the file `path`, in the order of their names.

    Parts lie in a hidden folder beside the file until Spark has committed all of them, so a failed task or a lost executor
    leaves nothing behind under the name. One part is moved; several are joined as a stream, block by block, and then
    moved. A file of the name is replaced; a folder of the name is an error.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    target = files.makeQualified(target)
    if files.exists(target) and files.getFileStatus(target).isDirectory():
        raise IsADirectoryError(f"{path} is a folder; a result file is not written over it")
    folder = hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    try:
        write(folder.toString())
        parts = sorted((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = parts[0] if len(parts) == 1 else hadoop.fs.Path(folder, "whole")
        if len(parts) != 1:
            out = files.create(whole)
            try:
                for part in parts:
                    given = files.open(part)
                    try:
                        hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
                    finally:
                        given.close()
            finally:
                out.close()
        files.delete(target, False)
        if not files.rename(whole, target):
            raise OSError(f"{path} cannot be written")
    finally:
        files.delete(folder, True)


def write_lines(lines: DataFrame, path: str) -> None:
    """The strings of the one column of `lines` as lines of a file, in the order of the partitions and of the rows in them."""
    one_file(lines.sparkSession, path, lines.write.text)


def emit(lines: DataFrame, target: str) -> None:
    """Lines to a file, to the standard output if target is -, or nowhere if it is empty."""
    if target == "-":
        show(row[0] for row in lines.toLocalIterator())
    elif target:
        write_lines(lines, target)


def show(lines: Iterable[str]) -> None:
    for line in lines:
        print(line)
