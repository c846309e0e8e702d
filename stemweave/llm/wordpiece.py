"""Greedy word-piece lengths by a longest-match automaton with failure links and popped-token counts.

The vocabulary is a trie with one root for pieces that begin a word and one for pieces that continue it. Each node
has a failure link, and the number of tokens that leaving through it settles, so every character is read once and
no piece is built. A word that can't be covered counts as one unknown token.

Defined results: a null or empty text has no words and no tokens. Ties can't arise (the longest piece is unique);
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored. Words of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.llm.texts import slices, words_of

MEMO = 400_000  # words remembered by a Python worker
SHIFT = 21  # bits of a code point
UNKNOWN = -1


class Automaton:
    """``first`` are pieces that begin words, ``later`` those that continue them (without any mark)."""

    BEGIN, CONTINUE = 0, 1

    def __init__(self, first: tuple[str, ...], later: tuple[str, ...]) -> None:
        self.edges: dict[int, int] = {}
        parents, labels, final = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((self.BEGIN, first), (self.CONTINUE, later)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for c in map(ord, piece):
                    key = node << SHIFT | c
                    if (to := self.edges.get(key)) is None:
                        to = self.edges[key] = len(parents)
                        parents.append(node)
                        labels.append(c)
                        final.append(False)
                    node = to
                final[node] = True
        n = len(parents)
        depth = [0] * n
        for v in range(2, n):  # a parent stands before its children
            depth[v] = depth[parents[v]] + 1
        self.fail = [-1] * n
        self.popped = [0] * n
        edges, fail, popped = self.edges, self.fail, self.popped
        for v in sorted(range(2, n), key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = self.CONTINUE, 1
                continue
            u, c = parents[v], labels[v]
            z, count = fail[u], popped[u]
            while z >= 0 and (z << SHIFT | c) not in edges:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = edges[z << SHIFT | c], count

    def length(self, word: str) -> int:
        """Number of greedy pieces, or ``UNKNOWN``."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, count = self.BEGIN, 0
        for c in map(ord, word):
            while (to := edges.get(node << SHIFT | c)) is None:
                if fail[node] < 0:
                    return UNKNOWN
                count += popped[node]
                node = fail[node]
            node = to
        while node != self.CONTINUE:
            if fail[node] < 0:
                return UNKNOWN
            count += popped[node]
            node = fail[node]
        return count


@lru_cache(maxsize=2)
def automaton(first: tuple[str, ...], later: tuple[str, ...]) -> Automaton:
    """Built once per Python worker."""
    return Automaton(first, later)


def pieces_of_model(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Pieces of a SentencePiece vocabulary file: a leading U+2581 begins a word, all others continue one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return tuple(p[1:] for p in pieces if p[0] == "▁" and "▁" not in p[1:] and len(p) > 1), tuple(p for p in pieces if "▁" not in p)


def token_counts(docs: DataFrame, pieces: tuple[tuple[str, ...], tuple[str, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, tokens (an unknown word is one) and unknown words.

    The vocabulary is broadcast: its size is that of its file, whatever the documents.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(*vocabulary.value)
        memo: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, first = words_of(part.column(1))
                if len(memo) > MEMO:
                    memo.clear()
                sizes = np.empty(len(words), dtype=np.int64)
                for i, w in enumerate(words):
                    if (n := memo.get(w)) is None:
                        n = memo[w] = machine.length(w.decode("utf-8", "replace"))
                    sizes[i] = n
                each = sizes[codes] if len(codes) else np.zeros(0, dtype=np.int64)
                total = np.concatenate([[0], np.cumsum(np.abs(each))])
                unknown = np.concatenate([[0], np.cumsum(each == UNKNOWN)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(np.diff(x[first] if x is not None else first), pa.int64()) for x in (None, total, unknown)]],
                    names=["id", "n_words", "n_tokens", "n_unknown"],
                )

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(count, f"id {kind.simpleString()}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
