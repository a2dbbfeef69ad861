"""Token counts by a linear longest-match automaton.

The vocabulary's trie has, at each node, a failure link and the number of pieces that following it
completes. One pass over a word adds those numbers up: the greedy longest-match pieces are counted and
never built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose counts a task remembers; beyond it starts anew.
REMEMBERED = 250_000
#: Longer words are counted each time they come.
REMEMBERED_CHARS = 200


class LongestMatch:
    """Counts the greedy longest-match pieces of words.

    ``first``: pieces that start a word, the empty one if the mark of a word's start is a piece by
    itself; ``inner``: pieces that go on with it. A word that they cannot cover is one unknown token.
    """

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: a word's start; node 1: after a piece
        whole, first = [False, False], list(first)
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.next[node].get(c)
                    if child is None:
                        child = self.next[node][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = child
                if node != root:
                    whole[node] = True
        self.fail: list[int] = [-1] * len(self.next)  # -1: none, the word is unknown
        self.popped = [0] * len(self.next)
        if "" in first:
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if whole[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][c], count
            level = below
        self.ended: list[int] = []  # pieces to come when the word ends at a node; -1: unknown
        for node in range(len(self.next)):
            count = 0
            while node > 1:
                count += self.popped[node]
                node = self.fail[node]
            self.ended.append(count if node == 1 else -1)

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, unknown ones) of a word of one character at least."""
        node = total = 0
        for c in word:
            child = self.next[node].get(c)
            while child is None:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1, 1
                child = self.next[node].get(c)
            node = child
        rest = self.ended[node]
        return (1, 1) if rest < 0 else (total + rest, 0)


def sentencepiece_vocabulary(path: str, bare_start: bool = False) -> tuple[list[str], list[str]]:
    """(first, inner) pieces of a vocabulary file: those that begin with the mark of a word's start, without it, and all as they are.

    ``bare_start``: the mark alone counts too, as the empty piece. Without it words start with longer pieces only.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [p[1:] for p in plain if p.startswith("▁") and (bare_start or len(p) > 1)], plain


class _Counts(dict):
    """Counts by word, worked out when first asked for."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        tokens, unknown = self.automaton.count(word)
        value = tokens << 1 | unknown
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def count_tokens(docs: DataFrame, first: list[str], inner: list[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each text.

    Words are what white space parts. Null and empty texts have no words. A word that the vocabulary
    cannot cover is one unknown token, however long. Nothing is shuffled; ``docs`` may have more columns.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast((first, inner))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(LongestMatch(*vocabulary.value))
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for n, text in enumerate(batch.column(1)):
                split = (text.as_py() or "").split()
                if split:
                    each = np.fromiter(map(counts.__getitem__, split), np.int64, len(split))
                    out[n] = len(split), (each >> 1).sum(), (each & 1).sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in out.T.copy()]], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
