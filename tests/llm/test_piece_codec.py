"""Piece ids against the library that the vocabulary is of, and the round trip."""

import hashlib
from dataclasses import replace

import numpy as np
import pytest
import sentencepiece
from odd_cases import prose, rows

from shelfmark.llm import piece_codec, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    return piece_codec.read_model(queries.VOCABULARY)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, frame, odd, draw, library, monkeypatch):
    odd += rows(["  two  blanks ", "▁mark▁", "<s> </s> <0x41> <unk>", "tab\tline\r\n\0end", "中文 ñ 😀", "a" * 3_000, " "])
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame(odd))
    got = sorted(map(tuple, queries.op11_sentencepiece(spark, "").collect()), key=str)
    want = []
    for doc_id, text, *_ in odd:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)


def test_query_on_a_given_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op11_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_random_texts_and_parts(model, library, draw, monkeypatch):
    monkeypatch.setattr(piece_codec, "PART_CHARS", 7)
    monkeypatch.setattr(piece_codec, "TABLE_CHARS", 400)
    table, decoder = piece_codec.ChunkTable(model), piece_codec.Decoder(model)
    for _ in range(3_000):
        text = "".join(draw.choice("ab  ▁é\n\t\0<s>/x😀中ßthe") for _ in range(draw.randint(0, 40)))
        before, ids, after = table.ids(["x y", text, None])
        assert (before.tolist(), after.tolist()) == (library.encode("x y"), [])
        assert ids.tolist() == library.encode(text), repr(text)
        assert decoder.text(ids) == text.replace("▁", " ")


def test_each_distinct_chunk_is_segmented_once(model, draw):
    table, asked = piece_codec.ChunkTable(model), []
    cut = table.segmenter.cut
    table.segmenter.cut = lambda chunks: asked.extend(chunks) or cut(chunks)
    text = prose(draw, 5_000)
    table.ids([text, text]), table.ids([text])
    assert sorted(asked) == sorted({"▁" + w for w in text.split(" ")})


def test_both_ways_of_joining_agree(model, draw):
    segmenter = piece_codec.Segmenter(model)
    chunks = ["▁" + "".join(draw.choice("theaio▁n1=-😀\nß") for _ in range(draw.randint(0, 45))) for _ in range(2_000)]
    for some, count, ids in segmenter.cut(list(chunks)):
        ends = np.cumsum(count)
        for chunk, first, last in zip(some, ends - count, ends):
            _, want = segmenter.ids_of(np.array([[segmenter.symbol(p) for p in segmenter.long_parts(chunk)]]))
            assert ids[first:last].tolist() == want.tolist()


def test_any_ids_decode_like_the_library(model, library, draw):
    decoder = piece_codec.Decoder(model)
    for _ in range(5_000):
        ids = [draw.choice([0, 1, 2, draw.randint(3, 258), draw.randint(3, 258), draw.randint(259, 31_999)]) for _ in range(draw.randint(0, 8))]
        assert decoder.text(np.array(ids, np.int32)) == library.decode(ids), ids


def test_vocabularies_whose_pieces_cross_marks_take_texts_whole():
    pieces = ("<unk>", "▁", "a", "b", "a▁", "▁a▁", "ba▁b")
    model = piece_codec.PieceModel(pieces, (0, -9, -9, -9, -1, -2, -3), frozenset(), 0, ())
    assert model.crossing
    assert [i.tolist() for i in piece_codec.ChunkTable(model).ids(["a ba bc", "", "b"])] == [[5, 3, 4, 3, 0], [], [1, 3]]
    assert not replace(model, pieces=pieces[:4], scores=model.scores[:4]).crossing


def test_no_rows_and_clashing_columns(spark, frame, model):
    assert piece_codec.encode(frame([]), model).count() == 0
    docs = frame(rows(["one two", None])).withColumnRenamed("n", "ids").withColumnRenamed("row", "decoded")
    both = piece_codec.decode(piece_codec.encode(docs, model, keep=("doc_id", "lang")), model, keep=("lang", "doc_id"))
    assert sorted(map(tuple, both.collect())) == [("en", 0, "one two"), ("en", 1, "")]
