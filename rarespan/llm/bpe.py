"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

The model is built from a rank file: a token's bytes become characters by the byte table, and each way to
split a token into two tokens is a merge with the token's rank, as in merging by rank. Each match of the
pattern is merged on its own and no token is special. Offsets come from the tokens' byte lengths and a map
from bytes to characters, so they hold where a token ends inside a character. Decoding looks tokens up in
the byte table's inverse and joins bytes; characters that are split over tokens come together again.

One narrow map over the input: no shuffle, memory of one Arrow batch, whole texts.

Defined results: a null text counts as empty; an empty text has no tokens; rows that repeat are encoded
alike; there are no ties, as ranks are distinct; a very long text is encoded whole, in a batch of its own if
need be; an empty table gives an empty result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.llm.common import sliced


def byte_table() -> dict[int, str]:
    """Bytes to characters: printable Latin-1 stands for itself, the others follow from U+0100 in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_table()
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        named = lambda token: "".join(table[b] for b in token)
        merges = [(named(t[:i]), named(t[i:])) for t in self.tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={named(t): r for t, r in ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; a token inside a character covers that character."""
        lengths = self.lengths[np.asarray(ids, np.int64)]
        ends = np.cumsum(lengths)
        if text.isascii():
            return ends - lengths, ends
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1  # of each byte
        return char[ends - lengths], char[ends - 1] + 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


ENCODED = "ids array<int>, starts array<int>, ends array<int>"


def with_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def lists(values: list) -> pa.Array:
    """Lists of 32-bit integers as one Arrow column."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(ends, flat)


def batches_of(batches, path: str, pattern: str, rows: int):
    """(codec, keys, texts, ids, spans) of slices of the batches; spans are (starts, ends) in characters."""
    c = codec(path, pattern)
    for b in sliced(batches, rows):
        texts = b.column(1).to_pylist()
        ids = c.encode(texts)
        yield c, b.column(0), texts, ids, [c.offsets(t, i) for t, i in zip(texts, ids)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", rows: int = 64) -> DataFrame:
    """(key, ids, starts, ends)."""

    def run(batches):
        for _, keys, _, ids, spans in batches_of(batches, path, pattern, rows):
            yield pa.RecordBatch.from_arrays([keys, lists(ids), lists([s for s, _ in spans]), lists([e for _, e in spans])], [key, "ids", "starts", "ends"])

    return with_text(docs.select(key, text), text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {ENCODED}")


def tokenise(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", rows: int = 64) -> DataFrame:
    """(key, n_tokens, ids, starts, ends, round_trip): round_trip tells whether the decoded ids are the text's bytes."""

    def run(batches):
        for c, keys, texts, ids, spans in batches_of(batches, path, pattern, rows):
            same = [c.decode(i) == t.encode() for t, i in zip(texts, ids)]
            columns = [keys, pa.array(list(map(len, ids)), pa.int64()), lists(ids), lists([s for s, _ in spans]), lists([e for _, e in spans]), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids", "starts", "ends", "round_trip"])

    return with_text(docs.select(key, text), text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, {ENCODED}, round_trip boolean")


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids); bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []).decode(errors="replace") for i in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return tokens.select(key, "ids").mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", rows: int = 64) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, offsets_sha256): encodes with offsets, then decodes the ids, and keeps digests only.

    offsets_sha256 is of each token's first and end character, in turn, as little-endian unsigned 32-bit integers.
    """
    sha = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches):
        for c, keys, _, ids, spans in batches_of(batches, path, pattern, rows):
            offsets = [sha(np.stack(s, axis=1).astype("<u4").tobytes()) for s in spans]
            columns = [keys, pa.array(list(map(len, ids)), pa.int64()), *(pa.array(x, pa.string()) for x in ([sha(np.array(i, "<u4").tobytes()) for i in ids], [sha(c.decode(i)) for i in ids], offsets))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"])

    return with_text(docs.select(key, text), text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
