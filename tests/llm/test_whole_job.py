"""What earlier rounds left out: each test fails on the code before."""

import math
from collections import defaultdict

import numpy as np
import pytest
from odd_cases import rows, word

from shelfmark.llm import decontaminate, language_model, mix, quality, queries, token_counts, toxicity, url_filter

# --- token counts ---------------------------------------------------------------------------


def raw_pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.VOCABULARY)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}


def longest_match(word, pieces):
    """(tokens, unknown) of the marked word, by the longest piece of the raw vocabulary at each place."""
    word, at, n, most = "▁" + word, 0, 0, max(map(len, pieces))
    while at < len(word):
        end = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1, 1
        at, n = end, n + 1
    return n, 0


def test_words_that_begin_with_no_start_piece_are_cut_not_unknown(frame, monkeypatch):
    pieces = raw_pieces()
    words = ["2024", "7", "3.14", "ñandú", "ça", "être", "ßa", "Índice", "Ó", "one", "a▁b", "▁", "😀", "x😀", "2024😀"]
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame(rows(words)))
    got = queries.op10_token_counts(None, "").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_unknown"]) for r in got} == {k: longest_match(w, pieces) for k, w in enumerate(words)}
    assert longest_match("2024", pieces)[1] == longest_match("ñandú", pieces)[1] == 0


def test_automaton_with_an_empty_start_piece_equals_longest_match(draw):
    for _ in range(60):
        piece = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 6)))
        first, inner = {"", *(piece() for _ in range(draw.randint(0, 5)))}, {piece() for _ in range(draw.randint(1, 9))}
        automaton = token_counts.LongestMatch(first, inner)
        pieces = {"▁" + p for p in first} | inner
        for _ in range(60):
            word = "".join(draw.choice("abc" if draw.random() < 0.1 else "ab") for _ in range(draw.randint(1, 16)))
            assert automaton.count(word) == longest_match(word, pieces), (word, first, inner)


def test_very_long_words_are_cut_like_others(frame, draw, monkeypatch):
    pieces, letters = raw_pieces(), "abcdefghijklmnopqrstuvwxyz0123456789"
    words = ["y" * 201, "".join(draw.choice(letters) for _ in range(100_000)), "a" * 5_000 + "\U000f0000"]
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frame(rows(words)))
    got = {r["doc_id"]: (r["n_tokens"], r["n_unknown"]) for r in queries.op10_token_counts(None, "").collect()}
    assert got == {k: longest_match(w, pieces) for k, w in enumerate(words)}
    assert got[1][0] > 10_000 and got[2] == (1, 1)


# --- decontamination ------------------------------------------------------------------------


def test_short_items_are_searched(spark, frame):
    items = {1: "Why is  42?", 2: "one two three four", 3: "never there", 4: "", 5: None}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = ["so why is 42? and why is 42? then", "x one two thre four y", "one tw three fur", "nothing", None]
    docs = frame(rows(texts))
    got = decontaminate.leaks(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["budget"], r["start"], r["end"]) for r in got) == [(0, 1, 0, 0, 3, 13), (1, 2, 1, 1, 2, 19)]
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()) == [2, 3, 4]


# --- toxicity -------------------------------------------------------------------------------


def test_different_words_of_one_value_stay_apart(draw):
    value = np.zeros(toxicity.BUCKETS, np.float32)
    value[toxicity.subwords(["grim"])[0]] = 1.0
    # words with no weight of their own between mild ones, some of them repeated at once
    texts = [" ".join(["grim" if draw.random() < 0.2 else word(draw) for _ in range(60)]) for _ in range(20)]
    texts += ["xi yu zo qa we ru ti grim " * 3, "grim grim xi xi yu", "", None]
    bias, weight = -0.5, {}

    def weight_of(w):
        if w not in weight:
            weight[w] = float(np.mean(value[toxicity.subwords([w])[0]], dtype=np.float64))
        return weight[w]

    want = []
    for text in texts:
        split = (text or "").split()
        split = [w for k, w in enumerate(split) if not k or split[k - 1] != w]
        windows = [split[k : k + toxicity.WINDOW] for k in range(0, len(split), toxicity.WINDOW)] or [[]]
        want.append(bias + max(sum(map(weight_of, w)) / toxicity.WINDOW for w in windows))
    assert toxicity._Scorer(value, bias).hardest(texts) == pytest.approx(want)


# --- mixing ---------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes,shard_words", [([7] * 300, mix.SHARD_WORDS), ([1, 2, 3, 5, 7, 11, 4_000] * 12, mix.SHARD_WORDS), ([7, 90, 400] * 20, 50)])
def test_small_sources_get_their_targets_too(frame, draw, sizes, shard_words):
    texts = [" ".join(word(draw) for _ in range(n)) for n in sizes]
    # each source's words in some documents of up to 7 words
    cut = [(k, t.split()[at : at + 7]) for k, t in enumerate(texts) for at in range(0, len(t.split()), 7)]
    docs = frame(rows([" ".join(w) for _, w in cut], [f"s{k:04}" for k, _ in cut]))
    taken, size, target = defaultdict(int), {}, {}
    for r in mix.mix(docs, shard_words=shard_words).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
    assert sorted(size.values()) == sorted(sizes)
    # blocks of one word, by highest quotients: a small source is given the nearest word, the rest falls to the large ones
    assert all(abs(taken[s] - target[s]) <= max(1, target[s] / 100) for s in size)
    assert sum(taken.values()) == math.floor(sum(target.values()) + 1e-6)


# --- models ---------------------------------------------------------------------------------


def test_the_most_frequent_tokens_are_symbols_however_many_are_equal(spark):
    counts = spark.createDataFrame([(f"t{k:03}", 7) for k in range(300)] + [("end", 3)], "token string, n long")
    few = language_model.hold(counts, held=20, symbols=16)
    assert few.symbols == 16 and sorted(few.place) == [f"t{k:03}".encode() for k in range(16)]
    assert language_model.hold(counts, held=1_000, symbols=16).symbols == 16 and language_model.hold(counts.limit(0)).symbols == 0


def test_quality_is_fitted_on_all_passages(spark, draw):
    import pyarrow as pa

    text = " ".join(word(draw) for _ in range(quality.PASSAGE * 200 + 1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "label": pa.array([1, 0], pa.int32()), "text": [text, "short"]})
    (out,) = quality._encoded(iter([batch]))
    assert [len(b.as_py()) // (4 * quality.FEATURES) for b in out.column(2)] == [201, 1]


def test_pages_may_have_columns_of_any_name(spark):
    schema = "page_id long, url string, probability string, score string, _host string, _features string, rule string, rawPrediction string"
    pages = spark.createDataFrame([(k, f"https://{'good' if k % 2 else 'evil'}{k}.net/a/{k}", *"abcdef") for k in range(40)], schema)
    labelled = pages.selectExpr("url", "double(page_id % 2 = 0) as blocked")
    judged = url_filter.judge(pages, (url_filter.Rule("block", "good1.net", "/"),), url_filter.train(labelled))
    assert set(judged.columns) == {*pages.columns, "host", "path", "verdict"}
    rows = judged.collect()
    assert {(r["probability"], r["_host"], r["_features"], r["rawPrediction"]) for r in rows} == {("a", "c", "d", "f")}
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 == 0 or r["page_id"] == 1 else "allow") for r in rows)
