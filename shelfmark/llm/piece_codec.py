"""Encoding texts to piece ids and back, by a table of distinct chunks.

A byte-pair model with a mark for blanks cuts a text into chunks: a run of marks and what follows up to the next
mark. Where no piece holds a mark after another character, no merge crosses a chunk's border, so the ids of a text
are the ids of its chunks in order. A task segments each distinct chunk once, keeps its ids in one flat array, and
puts the ids of a text together by looking up the place of each of its chunks.

Nulls and empty texts have no ids and decode to the empty text. White space, control characters and the mark itself
are encoded as they are (a mark in a text decodes to a blank). Texts of any length are taken whole. Repeated rows stay
repeated, an empty table gives none, and columns that are not kept cannot clash with what is added.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
#: What an unknown id decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Characters that a task takes at a time; a longer text is taken in several parts, cut between chunks.
PART_CHARS = 1 << 19
#: Characters of distinct chunks that a task's table holds; beyond it the table starts anew.
TABLE_CHARS = 6_000_000
#: Characters of a chunk up to which it is cut with others, and how many are cut at once.
SHORT, AT_ONCE = 48, 4_096


@dataclass(frozen=True)
class PieceModel:
    """The vocabulary of a byte-pair model: its pieces by id, and what the kinds of ids are."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    special: frozenset[int]  # ids without text
    unknown: int
    byte_ids: tuple[int, ...]  # the ids of the 256 bytes; none if characters outside the vocabulary are unknown
    crossing: bool = field(init=False)  # some piece holds a mark after another character

    def __post_init__(self):
        object.__setattr__(self, "crossing", any(re.search(f"[^{MARK}]{MARK}", p) for p in self.plain()))

    def plain(self) -> dict[str, int]:
        """The ids of pieces that merges can make."""
        other = {*self.special, self.unknown, *self.byte_ids}
        return {p: i for i, p in enumerate(self.pieces) if i not in other}

    def id_bytes(self) -> list[bytes]:
        """The bytes that each id stands for; none for ids without text."""
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        found = [of_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for i in self.special:
            found[i] = b""
        found[self.unknown] = UNKNOWN_TEXT.encode()
        return found


def read_model(path: str) -> PieceModel:
    """The vocabulary of a sentencepiece file, read by the driver.

    The file has to be of a byte-pair model that marks the start of a text, keeps white space as it is and changes no
    character; any other raises ValueError.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize("  a ﬁ\tＢ ") != f"{MARK}{MARK}{MARK}a{MARK}ﬁ\tＢ{MARK}":
        raise ValueError(f"{path} changes the characters of texts before it cuts them")
    ids = range(model.get_piece_size())
    pieces = tuple(model.id_to_piece(i) for i in ids)
    in_order = {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
    return PieceModel(
        pieces, tuple(model.get_score(i) for i in ids), frozenset(i for i in ids if model.is_control(i) or model.is_unused(i)),
        model.unk_id(), tuple(in_order[b] for b in sorted(in_order)),
    )


#: The cost of a pair of neighbours that no piece is made of.
NEVER = (1 << 31) - 1


class Segmenter:
    """Cuts chunks into pieces: the pair of neighbours whose piece scores highest is joined first, of equals the leftmost.

    Many short chunks are cut at once, a join in each of them at a time; a long one by a heap of its neighbours.
    """

    def __init__(self, model: PieceModel):
        self.ids, self.size = model.plain(), len(model.pieces)
        self.byte_ids, self.unknown = np.array(model.byte_ids, np.int64), model.unknown
        falling = {s: k for k, s in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
        self.cost = {p: falling[model.scores[i]] for p, i in self.ids.items()}
        # symbols are ids of pieces and, above them, characters that are no pieces
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        single = [p for p in self.ids if len(p) == 1]
        self.symbol_of[[ord(p) for p in single]] = [self.ids[p] for p in single]
        joins = []
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k]), self.symbol(piece[k:])
                if left is not None and right is not None:
                    joins.append((left << 32 | right, self.cost[piece], i))
        self.pairs, costs, joined = np.array(sorted(joins) or [(-1, NEVER, 0)], np.int64).T.copy()
        self.costs, self.joined = costs.astype(np.int32), joined.astype(np.int32)

    def symbol(self, part: str) -> int | None:
        return self.ids.get(part, self.size + ord(part) if len(part) == 1 else None)

    def joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of joining two symbols and what they become; NEVER where no piece is made of them or one is none (-1)."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.costs[at], np.int32(NEVER)), self.joined[at]

    def cut(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """All chunks in some order: (chunks, how many ids each has, these ids in a row)."""
        chunks = sorted(chunks, key=len)
        short = bisect.bisect_right(chunks, SHORT, key=len)
        at = 0
        while at < short:  # those of about one length together
            end = min(bisect.bisect_right(chunks, len(chunks[at]) * 5 // 4, hi=short, key=len), at + AT_ONCE)
            yield chunks[at:end], *self.ids_of(self.short_symbols(chunks[at:end]))
            at = end
        for chunk in chunks[short:]:
            symbols = np.array([[self.symbol(p) for p in self.long_parts(chunk)]], np.int64)
            yield [chunk], *self.ids_of(symbols)

    def ids_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each row of symbols has, and these: a character that is no piece gives its bytes' ids."""
        row, _ = np.nonzero(symbols >= 0)
        flat = symbols[symbols >= 0].astype(np.int64)
        other = flat >= self.size
        if not other.any():
            return np.bincount(row, minlength=len(symbols)), flat
        if not len(self.byte_ids):
            return np.bincount(row, minlength=len(symbols)), np.where(other, self.unknown, flat)
        code = np.where(other, flat - self.size, 0)
        count = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ids = np.repeat(flat, count)
        ids[np.repeat(other, count)] = self.byte_ids[np.frombuffer("".join(map(chr, code[other].tolist())).encode(), np.uint8)]
        return np.bincount(row, count, len(symbols)).astype(np.int64), ids

    def short_symbols(self, chunks: list[str]) -> np.ndarray:
        """A row of symbols for each chunk, -1 behind its last."""
        width = max(map(len, chunks))
        columns = np.arange(width + 1)
        symbols = np.full((len(chunks), width + 1), -1, np.int32)
        symbols[columns < np.array([len(c) for c in chunks])[:, None]] = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        cost, become = self.joins(symbols[:, :-1], symbols[:, 1:])
        done, rows = symbols.copy(), np.arange(len(chunks))
        while len(rows):
            at = cost.argmin(axis=1)
            live = cost[np.arange(len(rows)), at] < NEVER
            done[rows[~live]] = symbols[~live]
            rows, symbols, cost, become, at = rows[live], symbols[live], cost[live], become[live], at[live]
            each = np.arange(len(rows))
            joined = become[each, at]
            # what stands behind the pair moves one place to the left
            source = columns + (columns > at[:, None])
            symbols = np.take_along_axis(symbols, np.minimum(source, width), axis=1)
            symbols[each, at] = joined
            source = np.minimum(source[:, :width], width - 1)
            cost, become = np.take_along_axis(cost, source, axis=1), np.take_along_axis(become, source, axis=1)
            for left in (at - 1, at):
                r = each[left >= 0]
                left = left[left >= 0]
                cost[r, left], become[r, left] = self.joins(symbols[r, left], symbols[r, left + 1])
        return done

    def long_parts(self, chunk: str) -> list[str]:
        """The pieces of a chunk of any length, in steps that grow with the length times its logarithm."""
        cost, size = self.cost, len(chunk)
        part: list[str] = list(chunk)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting = []
        for k in range(size - 1):
            c = cost.get(chunk[k : k + 2])
            if c is not None:
                waiting.append((c, k, k + 1, 2))
        heapq.heapify(waiting)
        while waiting:
            _, left, right, length = heapq.heappop(waiting)
            if not part[left] or not part[right] or len(part[left]) + len(part[right]) != length:
                continue  # one of them was joined to another
            joined = part[left] = part[left] + part[right]
            part[right] = ""
            then = after[left] = after[right]
            if then < size:
                before[then] = left
                c = cost.get(joined + part[then])
                if c is not None:
                    heapq.heappush(waiting, (c, left, then, length + len(part[then])))
            first = before[left]
            if first >= 0:
                c = cost.get(part[first] + joined)
                if c is not None:
                    heapq.heappush(waiting, (c, first, left, len(part[first]) + length))
        return [p for p in part if p]


class ChunkTable(dict):
    """Where the ids of each distinct chunk stand in one flat array; each is segmented once, when it first comes."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.segmenter = Segmenter(model)
        self.chunk = re.compile(r"(?s).+" if model.crossing else f"{MARK}+[^{MARK}]*")
        self.border = None if model.crossing else re.compile(f"(?<=[^{MARK}]){MARK}")
        self._start_anew()

    def _start_anew(self) -> None:
        self.clear()
        self.flat = np.empty(1 << 16, np.int32)
        self.end = np.zeros(1 << 14, np.int64)  # the ids of chunk k stand from end[k] to end[k + 1]
        self.chars = 0

    def learn(self, chunks: set[str]) -> None:
        """Segment chunks that are not in the table."""
        for some, count, ids in self.segmenter.cut(list(chunks)):
            place, n = len(self), len(some)
            at = int(self.end[place])
            while place + n + 1 > len(self.end):
                self.end = np.concatenate([self.end, np.zeros_like(self.end)])
            while at + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[at : at + len(ids)] = ids
            self.end[place + 1 : place + n + 1] = at + np.cumsum(count)
            self.chars += sum(map(len, some)) + 8 * n
            self.update(zip(some, range(place, place + n)))

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all of them, joined by the positions of the chunks."""
        if self.chars > TABLE_CHARS:
            self._start_anew()
        places = np.fromiter(map(self.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(new := np.flatnonzero(places < 0)):
            some = [chunks[k] for k in new.tolist()]
            self.learn(set(some))
            places[new] = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
        start, length = self.end[places], self.end[places + 1] - self.end[places]
        stop = np.cumsum(length)
        return length, self.flat[np.repeat(start - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]

    def ids(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each whole text. The texts are to be few or short, but for single long ones."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if sum(map(len, marked)) > 3 * PART_CHARS:
            return [np.concatenate([self.joined(part)[1] for part in self.parts(m)]) for m in marked]
        chunks = [self.chunk.findall(m) for m in marked]
        length, ids = self.joined([c for of_text in chunks for c in of_text])
        stops = np.concatenate([[0], np.cumsum(length)])[np.cumsum([len(c) for c in chunks])]
        return np.split(ids, stops[:-1])

    def parts(self, marked: str) -> Iterator[list[str]]:
        """The chunks of a text in runs of about PART_CHARS characters, which end where a chunk does."""
        at = 0
        while at < len(marked) or not at:
            border = self.border.search(marked, at + PART_CHARS) if self.border else None
            end = border.start() if border else max(len(marked), 1)
            yield self.chunk.findall(marked, at, end)
            at = end


def parts_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The rows of a batch in runs of up to about PART_CHARS characters of a text column, and those texts."""
    texts, start, chars = batch.column(column), 0, 0
    held: list[str | None] = []
    for k in range(batch.num_rows):
        held.append(texts[k].as_py())
        chars += len(held[-1] or "")
        if chars >= PART_CHARS or k == batch.num_rows - 1:
            yield batch.slice(start, k + 1 - start), held
            start, chars, held = k + 1, 0, []


def int_lists(values: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array of one array of numbers for each row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _kept(df: DataFrame, keep: Sequence[str]) -> list[StructField]:
    return [df.schema[c] for c in keep]


def encode(docs: DataFrame, model: PieceModel, text: str = "text", keep: Sequence[str] = ("doc_id",), into: str = "ids") -> DataFrame:
    """The columns to keep and the ids of each whole text. Nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(known.value)
        for batch in batches:
            for rows, texts in parts_of(batch, "text"):
                ids = int_lists(table.ids(texts), pa.int32())
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], ids], names=[*keep, into])

    schema = StructType([*_kept(docs, keep), StructField(into, ArrayType(IntegerType()))])
    return docs.select(docs[text].alias("text"), *[docs[c] for c in keep]).mapInArrow(run, schema)


def _each_byte(error: UnicodeDecodeError):
    return "�", error.start + 1


class Decoder:
    """Puts the texts of ids together; the mark that an encoder sets before a text is taken off."""

    def __init__(self, model: PieceModel):
        self.bytes_of = model.id_bytes()
        self.silent = model.special
        self.begins = {i for p, i in model.plain().items() if p.startswith(MARK)}

    def text(self, ids: np.ndarray) -> str:
        listed = ids.tolist()
        first = next((k for k, i in enumerate(listed) if i not in self.silent), len(listed))
        text = "".join(self.run(run) for run in self.runs(listed[first:]))
        return text[1:] if listed[first : first + 1] and listed[first] in self.begins else text

    def runs(self, ids: list[int]) -> Iterator[list[int]]:
        """What ids without text part; the bytes of a character stand in one of these."""
        if self.silent.isdisjoint(ids):
            yield ids
            return
        at = 0
        for k in [*(k for k, i in enumerate(ids) if i in self.silent), len(ids)]:
            yield ids[at:k]
            at = k + 1

    def run(self, ids: list[int]) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            return joined.decode()
        except UnicodeDecodeError:
            codecs.register_error("shelfmark.each_byte", _each_byte)
            return joined.decode("utf-8", "shelfmark.each_byte")


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids", keep: Sequence[str] = ("doc_id",), into: str = "decoded") -> DataFrame:
    """The columns to keep and the text of each list of ids; a byte that is no part of a character decodes to U+FFFD."""
    known = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(known.value)
        for batch in batches:
            lists = batch.column("ids")
            texts = [decoder.text(lists[k].values.to_numpy() if lists[k].is_valid else np.empty(0, np.int32)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*keep, into])

    schema = StructType([*_kept(encoded, keep), StructField(into, StringType())])
    return encoded.select(encoded[ids].alias("ids"), *[encoded[c] for c in keep]).mapInArrow(run, schema)
