"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with no more than k errors has, of any k + 1 pieces it is cut
into, one that occurs there exactly. Exact piece hits (one pass of a multi-pattern automaton over each
text) say where to look; Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One error is allowed for so many characters of an item.
CHARS_PER_ERROR = 15
#: Items of so many characters are searched; only those without any are found nowhere.
MIN_CHARS = 1
#: Test items are matched in blocks of this many characters; each block passes over all texts.
BLOCK_CHARS = 8_000_000

HITS = "item_id long, distance int, budget int, item_chars int, start int, end int"


def normal(text: str) -> str:
    """The text in lower case, with each run of white space as one blank."""
    return " ".join(text.lower().split())


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """For each end in ``text``: the least edit distance of ``pattern`` to a part of it ending there.

    ``anchored``: to the part from the text's start. Bits of one integer hold a whole column.
    """
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    top = 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    for c in text:
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = (down | ~(diagonal | up)) & full
        right_down = up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | anchored) & full
        right_down = right_down << 1 & full
        up = (right_down | ~(diagonal | right_up)) & full
        down = right_up & diagonal
        yield score


def closest(pattern: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` closest to ``pattern``: the first end, then the latest start."""
    found = list(distances(pattern, text))
    if not found:
        return len(pattern), 0, 0
    best = min(found)
    end = found.index(best) + 1
    back = list(distances(pattern[::-1], text[:end][::-1], anchored=True))
    return best, end - back.index(min(back)) - 1, end


class Matcher:
    """Finds items (id, normalised text) in normalised texts within their error budgets."""

    def __init__(self, items: Sequence[tuple[int, str]], chars_per_error: int = CHARS_PER_ERROR):
        self.items = [(i, t, len(t) // chars_per_error) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item_id, distance, budget, item_chars, start, end) of each item's closest part within budget."""
        if not self.items:
            return []
        starts: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                starts.setdefault(n, []).append(last + 1 - length - offset)
        found = []
        for n, at in starts.items():
            item_id, item, budget = self.items[n]
            if not budget:  # the whole item is the piece
                found.append((item_id, 0, 0, len(item), min(at), min(at) + len(item)))
                continue
            best = None
            reach = len(item) + 2 * budget
            at.sort()
            low = high = at[0]
            for s in [*at[1:], None]:  # overlapping places are looked at as one
                if s is not None and s - high <= reach:
                    high = s
                    continue
                begin = max(0, low - budget)
                distance, a, b = closest(item, text[begin : max(0, high + len(item) + budget)])
                if distance <= budget and (best is None or distance < best[1]):
                    best = (item_id, distance, budget, len(item), begin + a, begin + b)
                low = high = s
            if best:
                found.append(best)
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> list:
    """The items as broadcast blocks of about ``block_chars`` characters; one is read at a time."""
    kept = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.length("text") >= MIN_CHARS)
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(chars / block_chars))
    context = benchmark.sparkSession.sparkContext
    for k in range(count):
        block = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        items = [(r[0], normal(r[1])) for r in block.distinct().collect()]
        yield context.broadcast(sorted(((i, t) for i, t in items if len(t) >= MIN_CHARS), key=lambda x: (x[0] is None, x)))


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget, item_chars, start, end) of each item found in each text.

    An item is found if some part of the text is within one edit for every 15 of its characters; its
    closest part is given, as positions in the normalised text. Whole texts are searched. Items under
    15 characters are to occur exactly, within words too. Null and empty texts hold nothing, null and
    empty items are found nowhere; equal rows give equal rows. Both tables may have more columns.
    """
    found = None
    for items in _blocks(benchmark, block_chars):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows += [(doc_id, *hit) for hit in matcher.find(normal(text.as_py() or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_NAMES)

        hits = docs.select("doc_id", "text").mapInArrow(search, f"doc_id long, {HITS}")
        found = hits if found is None else found.unionAll(hits)
    return found


_NAMES = ["doc_id", *[c.split()[0] for c in HITS.split(", ")]]
_ARROW = [pa.int64(), pa.int64(), *[pa.int32()] * 5]


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found (see ``leaks``), with all their columns."""
    place = docs.columns.index("text")
    kept = docs
    for items in _blocks(benchmark, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py() or "")) for t in batch.column(place)], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
