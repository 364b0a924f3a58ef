"""Token counts by a unigram model, with forward scores shared in a trie.

Texts split into pre-tokens at white space, each led by the piece model's space mark. A partition's
distinct pre-tokens go into a trie; a node is a prefix and holds the best log-probability of any
segmentation of that prefix and its number of tokens, computed once from the nodes above it by walking the
pieces that end there. A pre-token's count is its terminal node's, and a document's the sum over its words.
So a prefix that a thousand words share is scored once, and a word that comes a million times too.

Pieces come from a public vocabulary file. It is a merge vocabulary, whose scores are ranks; the unigram
log-probability of the piece of rank r is -ln(r + 2) - ln(ln(size)), Zipf's law. A character that no piece covers
costs one byte-fallback token per byte, each at the score of the last rank less UNKNOWN_PENALTY. Equal scores prefer
fewer tokens.

One narrow map: no shuffle. A worker's trie is emptied when it has more than MAX_NODES nodes, which bounds
memory and changes no result; the trie holds the first LONG characters of a pre-token, and what follows
them is scored by the same recurrence without being stored.

Defined results: null and empty texts have no words and no tokens; repeated rows count alike; ties between
segmentations prefer fewer tokens; a very long text, or a text of one very long word, is counted whole; an
empty table gives an empty result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rarespan.llm.common import sliced

SPACE, MAX_NODES, LONG, UNKNOWN_PENALTY = "▁", 400_000, 64, 10.0
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Unigram:
    """Pieces, and a trie of the prefixes seen so far. A node is [children by character, best score, tokens]."""

    def __init__(self, pieces: dict[str, float], unknown: float):
        self.unknown, self.pieces = unknown, pieces
        # pieces by their characters from the last to the first: (score of the piece so far or None, longer ones)
        nested: dict = {}
        for piece, score in pieces.items():
            node = nested
            for c in reversed(piece[1:]):
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[0], [None, {}])[0] = score
        self.back = nested
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [{}, 0.0, 0], 0

    def extend(self, text: str, i: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and tokens of text[:i], given those of its shorter prefixes."""
        best, tokens, here = -math.inf, 0, self.back
        for start in range(i - 1, -1, -1):
            found = here.get(text[start])
            if found is None:
                break
            score, here = found
            if score is not None:
                s = scores[start] + score
                if s > best or s == best and counts[start] + 1 < tokens:
                    best, tokens = s, counts[start] + 1
        if text[i - 1] not in self.pieces:
            size = len(text[i - 1].encode("utf-8", "surrogatepass"))
            s = scores[i - 1] + size * self.unknown
            if s > best or s == best and counts[i - 1] + size < tokens:
                best, tokens = s, counts[i - 1] + size
        return best, tokens

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        text = SPACE + word
        node, scores, counts = self.root, [0.0], [0]
        for i, c in enumerate(text, 1):
            after = node[0].get(c) if i <= LONG else None
            if after is None:
                after = [{}, *self.extend(text, i, scores, counts)]
                if i <= LONG:
                    node[0][c] = after
                    self.nodes += 1
            node = after
            scores.append(node[1])
            counts.append(node[2])
        return node[2]


@lru_cache(2)
def unigram(path: str) -> Unigram:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    log_size = math.log(math.log(len(names)))
    pieces = {name: -math.log(rank + 2) - log_size for rank, name in enumerate(names)}
    return Unigram(pieces, min(pieces.values()) - UNKNOWN_PENALTY)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_tokens)."""

    def run(batches):
        model = unigram(path)
        terminal: dict[str, int] = {}
        gc.disable()  # nodes hold no cycles, and a worker makes many of them
        try:
            for b in sliced(batches):
                words, tokens = [], []
                for t in b.column(1).to_pylist():
                    bag = Counter(WORD.findall(t or ""))
                    if model.nodes > MAX_NODES or len(terminal) > MAX_NODES:
                        model.clear()
                        terminal = {}
                    for w in bag:
                        if w not in terminal:
                            terminal[w] = model.count(w)
                    words.append(bag.total())
                    tokens.append(sum(c * terminal[w] for w, c in bag.items()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [key, "n_words", "n_tokens"])
        finally:
            gc.freeze()  # the nodes that are kept are not gone through again
            gc.enable()

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long")
