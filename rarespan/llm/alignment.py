"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut where both end.

A dangling-suffix transducer reads both token lists. Its state is which side leads and the bytes of the leader's last
token that the other side has not matched; the side behind gives the next token. A transition depends on the state and
that token alone and is memoised by them; an empty residual closes a group. A step that finds one side leading links
the leader's last token with the token read, and every overlapping pair of occurrences is found so, once.

Texts are read in pieces that end where both tokenizers are known to start afresh: before a single space or newline
between two visible characters, as the one's pattern and the other's vocabulary show (restarts() checks both; other
tokenizers read whole texts). So a piece is whole groups, and what is made of a short piece is kept for the next
text that holds it, up to a bound.

The link counts are corpus-wide. A document's links are distinct id pairs with their number, written once; documents
per pair are counted with a map-side combine. The counts come back to the links by a broadcast of the most frequent
pairs, at most BROADCAST of them by a threshold on their exact counts, and by a shuffle for the rarer rest, where no
key has more rows than the threshold. Sums of a document combine before they move.

Defined results: a null or empty text, and one whose bytes a tokenizer does not give back, has no tokens and zeros;
rows that repeat are aligned alike and each counts as a document; ties for the highest count all count as best; a very long
text is aligned whole, in pieces of it; an empty table gives an empty result; only the key and the text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespan.llm.bpe import byte_table
from rarespan.llm.common import sliced, stored

#: Most pairs whose counts are broadcast, about 80 bytes each.
BROADCAST = 1 << 20
#: Most pieces kept by a worker, their longest, and the most transitions kept.
PIECES, PIECE_CHARS, TRANSITIONS = 150_000, 48, 1_000_000
#: A piece: its first character, then up to a space or newline that stands alone between visible characters.
PIECE = re.compile(r"(?s:.)[^ \n]*(?:(?:(?<![\w!-~])[ \n]|[ \n](?![\w!-~]))[^ \n]*)*")


class BytePair:
    """Byte-level BPE from a file of the tokenizers library; a text is read with a space before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        back = {c: b for b, c in byte_table().items()}
        named = sorted((i, token) for token, i in self.model.get_vocab().items())
        self.tokens = [b""] * (named[-1][0] + 1)
        for i, token in named:
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def restarts(self) -> bool:
        """Whether no token crosses the ends of pieces: words take one space before them at most, and nothing is normalised."""
        cut = str(self.model.pre_tokenizer)
        return self.model.normalizer is None and cut.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cut

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, size = self.model, self.model.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(size)]
        self.bytes_ = [m.is_byte(i) for i in range(size)]
        self.tokens = [bytes([int(name[3:5], 16)]) if is_byte else name.replace("▁", " ").encode() for name, is_byte in zip(self.names, self.bytes_)]
        self.space = m.piece_to_id("▁")

    def restarts(self) -> bool:
        """Whether no piece has a space after another character, or a newline."""
        return not any("▁" in n.lstrip("▁") or "\n" in n for n in self.names)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """A piece begins with a space, which the model adds, or a newline, before which its space goes again."""
        made = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [ids if p[0] == " " else ids[1:] for p, ids in zip(pieces, made)]


class Transducer:
    """State 0 is the empty residual; others are (leading side, residual). dead: the sides' bytes differ."""

    DEAD = -1

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.tokens = left, right
        self.clear()

    def clear(self) -> None:
        self.number = {(0, b""): 0}
        self.states, self.leads, self.moves, self.kept = [(0, b"")], [0], [{}], 0

    def move(self, state: int, token: int) -> int:
        """The transition that no memo holds yet."""
        side, rest = self.states[state]
        read = self.tokens[1 - side if state else 0][token]
        if not state:
            new = 0, read
        elif rest.startswith(read):
            new = side, rest[len(read) :]
        elif read.startswith(rest):
            new = 1 - side, read[len(rest) :]
        else:
            return self.DEAD
        new = new if new[1] else (0, b"")
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.leads.append(1 + new[0] if new[1] else 0)
            self.moves.append({})
        self.moves[state][token] = self.number[new]
        self.kept += 1
        return self.number[new]

    def run(self, left: list[int], right: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Ends (in tokens of left and right) of the groups, and links as left << 32 | right; None if the bytes differ."""
        if self.kept > TRANSITIONS:
            self.clear()
        leads, moves = self.leads, self.moves
        state = lead = i = j = last = 0
        n, m, ends, links = len(left), len(right), [], []
        while True:
            if lead == 1:
                if j == m:
                    return None
                token = right[j]
                j += 1
                links.append(last | token)
            elif i == n:
                return None if lead or j < m else (ends, links)
            else:
                token = left[i]
                i += 1
                last = token << 32
                if lead:
                    links.append(last | right[j - 1])
            known = moves[state].get(token)
            if known is None:
                known = self.move(state, token)
                if known == self.DEAD:
                    return None
            state = known
            lead = leads[state]
            if not lead:
                ends.append((i, j))


class Aligner:
    """Keeps what `of` makes of a short piece's token ids and alignment."""

    def __init__(self, left_path: str, right_path: str, of):
        self.left, self.right, self.of = BytePair(left_path), Pieces(right_path), of
        self.transducer = Transducer(self.left.tokens, self.right.tokens)
        self.cuts = self.left.restarts() and self.right.restarts()
        self.kept: dict = {}
        self.older: dict = {}

    def made(self, piece: str, left: list[int], right: list[int]):
        """None if a tokenizer does not give the bytes back; the transducer holds the right's against the left's."""
        found = self.transducer.run(left, right) if b"".join(map(self.left.tokens.__getitem__, left)) == piece.encode() else None
        return found and self.of(left, right, *found)

    def pieces(self, texts: list[str | None]) -> list[list | None]:
        """What is made of the pieces of each text; None if it has no tokens."""
        if len(self.kept) > PIECES:
            self.kept, self.older = {}, self.kept
        cut = [(PIECE.findall(f" {t}") if self.cuts else [f" {t}"]) if t else [] for t in texts]
        kept, older = self.kept, self.older
        new = {p for c in cut for p in c if p not in kept}
        kept.update({p: older[p] for p in new if p in older})
        new = [p for p in new if p not in kept]
        kept.update(zip(new, map(self.made, new, self.left.encode(new), self.right.encode(new))))
        out = [list(map(kept.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > PIECE_CHARS:
                del kept[p]
        return [own if own and None not in own else None for own in out]


def ids_and_ends(left: list[int], right: list[int], ends: list[tuple[int, int]], links: list[int]) -> tuple:
    return left, right, ends


def counts_and_text(left: list[int], right: list[int], ends: list[tuple[int, int]], links: list[int]) -> tuple:
    """Numbers of tokens and groups, the groups as text, the links."""
    groups, i, j = [], 0, 0
    for p, q in ends:
        groups.append(f"{left[i]}|{right[j]}" if p - i == q - j == 1 else f"{','.join(map(str, left[i:p]))}|{','.join(map(str, right[j:q]))}")
        i, j = p, q
    return len(left), len(right), len(ends), ";".join(groups), array("Q", links)


@lru_cache(2)
def aligner(left_path: str, right_path: str, of) -> Aligner:
    return Aligner(left_path, right_path, of)


def align(docs: DataFrame, left_path: str, right_path: str, text: str = "text", key: str = "doc_id", rows: int = 64) -> DataFrame:
    """(key, left, right, left_ends, right_ends): token ids of both tokenizers and the group ends as numbers of tokens read; null lists for texts without tokens."""

    def run(batches):
        a = aligner(left_path, right_path, ids_and_ends)
        for b in sliced(batches, rows):
            out: list[list] = [[], [], [], []]
            for pieces in a.pieces(b.column(1).to_pylist()):
                found: tuple = ([], [], [], [])
                for left, right, ends in pieces or []:
                    i, j = len(found[0]), len(found[1])
                    for own, more in zip(found, (left, right, [i + p for p, _ in ends], [j + q for _, q in ends])):
                        own.extend(more)
                for column, own in zip(out, found):
                    column.append(own if pieces else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in out)], [key, "left", "right", "left_ends", "right_ends"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, left array<int>, right array<int>, left_ends array<int>, right_ends array<int>")


def measured(docs: DataFrame, left_path: str, right_path: str, text: str = "text", key: str = "doc_id", rows: int = 64) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, links): as align, counted and digested; links are distinct id pairs (a, b, times); row is the input row's own number."""

    def run(batches):
        a = aligner(left_path, right_path, counts_and_text)
        for b in sliced(batches, rows):
            numbers, sha, links, times = [], [], [], []
            for pieces in a.pieces(b.column(2).to_pylist()):
                n_a, n_b, n_groups, groups, own = zip(*pieces) if pieces else ((), (), (), (), ())
                every = np.frombuffer(b"".join(own), np.uint64)
                numbers.append((sum(n_a), sum(n_b), sum(n_groups), len(every)))
                sha.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if pieces else "")
                pairs, n = np.unique(every, return_counts=True)
                links.append(pairs)
                times.append(n)
            flat, number = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (links, times))
            parts = [(flat >> np.uint64(32)).astype(np.int32), (flat & np.uint64(0xFFFFFFFF)).astype(np.int32), number.astype(np.int32)]
            ends = np.cumsum([0, *map(len, links)]).astype(np.int32)
            pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(p) for p in parts], ["a", "b", "times"]))
            counts = [pa.array(c, pa.int64()) for c in zip(*numbers)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, pa.array(sha, pa.string()), pairs], ["row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    schema = f"row long, {key} {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,times:int>>"
    return docs.select(F.monotonically_increasing_id().alias("row"), key, text).mapInArrow(run, schema)


def link_counts(made: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold the pair, and whether no pair of a has more."""
    n = stored(made.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("n")))
    most = n.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return n.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def threshold(counts: DataFrame, bound: int) -> int:
    """The least power of two that at most `bound` pairs reach."""
    of = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("pairs")).collect()  # 64 rows at most
    at, above = 1 + max((r.e for r in of), default=0), 0
    for r in sorted(of, key=lambda r: -r.e):
        above += r.pairs
        if above > bound:
            break
        at = r.e
    return 1 << at


def scored(made: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """made with n_best and count_sum instead of row and links; made is a stored table."""
    counts = link_counts(made)
    least = threshold(counts, bound)
    links = made.select("row", F.inline("links"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    out = sums(links.join(frequent, ["a", "b"]))
    if least > 1:
        rest = sums(links.join(frequent.select("a", "b"), ["a", "b"], "left_anti").join(counts.where(F.col("n") < least), ["a", "b"]))
        out = out.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    facts = [c for c in made.columns if c not in ("row", "links")]
    return made.drop("links").join(out, "row", "left").select(*facts, zero("n_best"), zero("count_sum"))


def aligned(docs: DataFrame, left_path: str, right_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)."""
    return scored(stored(measured(docs, left_path, right_path, text, key)))
