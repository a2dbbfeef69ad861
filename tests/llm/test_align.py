"""Groups and links against both libraries and a plain walk over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from odd_cases import prose, rows

from shelfmark.llm import align, piece_codec, queries


@pytest.fixture(scope="module")
def models():
    return align.read_byte_model(queries.BYTE_VOCABULARY), piece_codec.read_model(queries.VOCABULARY)


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)


def byte_of_character():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def plain(text, libraries, of_character):
    """(a ids, b ids, groups) by a walk; nothing where a side does not give the text back."""
    if not text:
        return [], [], []
    first, second = libraries
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    bytes_a = [bytes(of_character[c] for c in first.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], []
    ends = [np.cumsum([len(t) for t in side]).tolist() for side in (bytes_a, bytes_b)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        ii, jj = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:ii], b[j:jj]))
        i, j = ii, jj
    return a, b, groups


def expected(docs, libraries):
    of_character, cuts = byte_of_character(), []
    for doc_id, text in docs:
        cuts.append((doc_id, *plain(text, libraries, of_character)))
    count = Counter((a[-1], b[-1]) for *_, groups in cuts for a, b in groups)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    found = []
    for doc_id, a, b, groups in cuts:
        links = [(x[-1], y[-1]) for x, y in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append(
            (
                doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(shown.encode()).hexdigest() if a else "",
            )
        )
    return sorted(found, key=str)


ODD = ["▁mark", "a ▁", "<|endoftext|> <s>", "  two  blanks ", "tab\t\r\n\n\n x", "中文😀 ñandú", "\0", " ", "it's 1234567 can't!!! ...", "a" * 2_000]


def test_query_equals_a_plain_walk(spark, frame, draw, libraries, monkeypatch):
    docs = rows([None, "", *ODD, *[prose(draw, 200) for _ in range(20)], *ODD[:5], " ".join(["same words again"] * 50)])
    docs += [(None, *docs[14][1:]), docs[15], docs[15]]
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame(docs).repartition(3))
    got = sorted(map(tuple, queries.op12_alignment(spark, "").collect()), key=str)
    assert got == expected([d[:2] for d in docs], libraries)


def test_query_on_a_given_table(spark, libraries):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, sf_dir).collect()), key=str) == expected(docs, libraries)


def test_blocks_of_pairs_change_nothing(frame, draw, models):
    docs = frame(rows([*ODD, *[prose(draw, 80) for _ in range(10)]]))
    aligned = align.written(align.align(docs, *models).drop("groups"), "test")
    counts = align.count_links(aligned, *models)
    assert counts.n_other > 50
    one, many = (sorted(map(tuple, align.score_links(aligned, counts, at_once).select("doc_id", "n_best", "count_sum").collect())) for at_once in (10**6, 17))
    assert one == many


def test_exact_groups_enter_no_pairs(models, draw):
    aligner = align.Aligner(*models)
    (n_a, n_b, groups, exact, other), *_ = aligner.align([" ".join(["the", "and", "of"] * 9)])
    assert n_a == n_b == len(exact) == 27 and len(other) == 0 and groups.count(";") == 26
    assert aligner.align([None, ""])[1][:3] == (0, 0, "")


def test_same_bytes_prefers_pieces_to_single_bytes(models):
    first, second = models
    same = align.same_bytes(first.tokens, second.id_bytes())
    assert second.pieces[same[first.tokens.index(b" the")]] == "▁the"
    assert second.pieces[same[first.tokens.index(b"a")]] == "a" and second.pieces[same[first.tokens.index(b" ")]] == "▁"
    assert second.pieces[same[first.tokens.index(b"\xc3")]] == "<0xC3>"


def test_both_first_vocabularies_agree_on_every_character(models, libraries):
    aligner = align.Aligner(*models)
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(characters), 4_096):
        text = " ".join(f"a{c}1{c}{c}. {c}" for c in characters[k : k + 4_096 : 7])
        assert aligner.first.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_files_whose_ids_are_not_in_the_order_of_merges_are_refused(tmp_path):
    path = tmp_path / "odd.json"
    path.write_text('{"added_tokens": [], "model": {"vocab": {"ab": 0, "a": 1, "b": 2}, "merges": ["a b"]}}')
    with pytest.raises(ValueError):
        align.read_byte_model(str(path))


def test_no_rows(spark, frame, models):
    aligned = align.written(align.align(frame([]), *models).drop("groups"), "none")
    assert align.score_links(aligned, align.count_links(aligned, *models)).count() == 0
