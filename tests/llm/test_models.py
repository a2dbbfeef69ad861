import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_cases import prose, rows, words_of
from pyspark.sql import functions as F

from shelfmark.llm import language_model, quality, queries, token_counts, toxicity
from shelfmark.llm.common import fold
from shelfmark.llm.labelled import calibrated, sigmoid

SF = "/root/testdata/sf0.01"


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# --- token counts ---------------------------------------------------------------------------


def greedy(word, first, inner):
    """(pieces, unknown) by trying the longest piece first."""
    at = pieces = 0
    while at < len(word):
        known = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1, 1
        at, pieces = end, pieces + 1
    return pieces, 0


def test_automaton_equals_greedy_matching(draw):
    for _ in range(60):
        piece = lambda: "".join(draw.choice("ab") for _ in range(draw.randint(1, 6)))
        first, inner = {piece() for _ in range(draw.randint(1, 9))}, {piece() for _ in range(draw.randint(0, 9))}
        automaton = token_counts.LongestMatch(first, inner)
        for _ in range(60):
            word = "".join(draw.choice("abc" if draw.random() < 0.1 else "ab") for _ in range(draw.randint(1, 16)))
            assert automaton.count(word) == greedy(word, first, inner), (word, first, inner)


def test_token_counts_of_odd_texts(frame, odd):
    first, inner = token_counts.sentencepiece_vocabulary(queries.VOCABULARY)
    a, b = set(first), set(inner)
    got = token_counts.count_tokens(frame(odd + rows(["naïve café 😀 x" * 3, "y" * 300])), first, inner).collect()
    want = Counter()
    for r in odd + rows(["naïve café 😀 x" * 3, "y" * 300]):
        words = (r[1] or "").split()
        each = [greedy(w, a, b) for w in words]
        want[(r[0], len(words), sum(e[0] for e in each), sum(e[1] for e in each))] += 1
    assert Counter(map(tuple, got)) == want
    assert token_counts.count_tokens(frame([]), first, inner).count() == 0


# --- classifiers -----------------------------------------------------------------------------


def accuracy(spark, found, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and labels.get(r["doc_id"]) is not None]
    return sum(p == y for p, y in held) / len(held)


@pytest.mark.parametrize("query,label,folds,out", [(queries.op4_toxicity, "toxic", 5, 0), (queries.op6_quality, "quality", 4, 2)])
def test_held_out_labels_are_met(spark, query, label, folds, out):
    found = query(spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (remainder(r["doc_id"], folds) == out) for r in found)
    assert accuracy(spark, found, label) > 0.93


@pytest.mark.parametrize("module,label,odd_one", [(toxicity, "toxic", "you utter scoundrel"), (quality, "quality", "### $$$ ***")])
def test_classifier_learns_from_allowed_labels_and_stands_odd_rows(spark, frame, odd, draw, module, label, odd_one):
    texts = [prose(draw, 30) + (f" {odd_one} " if k % 3 == 0 else " ") + prose(draw, 30) for k in range(240)]
    docs = frame(rows(texts) + odd)
    marks = [(k, int(k % 3 == 0), "t") for k in range(240)] + [(None, 1, "t"), (5, None, "t"), (10**6, 1, "t")]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int, text string")
    learn = fold(F.col("doc_id"), 5) != 0
    model = module.train(docs, labels, learn)
    assert (module.train(docs, labels.filter(learn), F.lit(True)).slope, model.shift) == (model.slope, model.shift)
    scored = module.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns)
    got = scored.select("doc_id", "text", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 240 + len(odd)
    right = [(r["score"] >= 0.5) == (odd_one in r["text"]) for r in got if r["text"] in set(texts) and remainder(r["doc_id"], 5) == 0]
    assert sum(right) / len(right) > 0.9
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    none = module.train(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in module.score(docs, none).select("score").collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_unseen_misspellings_share_subwords(spark, frame, draw):
    bad = ["scoundrel", "scoundrels", "scooundrel", "scoundrell", "scoundral"]
    texts = [prose(draw, 40) + (" " + bad[k % 4] + " " if k % 2 else " ") + prose(draw, 10) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.train(frame(rows(texts)), labels, F.lit(True))
    fresh = [prose(draw, 40) + " " + w + " " + prose(draw, 10) for w in ("scoundrrel", "Scoundrel!", "sscoundrel")] + [prose(draw, 50) for _ in range(20)]
    scores = {r["text"]: r["score"] for r in toxicity.score(frame(rows(fresh)), model).collect()}
    assert min(scores[t] for t in fresh[:3]) > max(scores[t] for t in fresh[3:])


def test_subwords_hash_each_word_alike_wherever_it_stands(draw):
    words = ["a", "Ab", "…", "naïve", "😀x", "b" * 50, "Ab"]
    flat, counts = toxicity.subwords(words)
    parts = np.split(flat, np.cumsum(counts)[:-1])
    for w, p in zip(words, parts):
        assert sorted(toxicity.subwords([w])[0]) == sorted(p) and len(p)
    assert sorted(parts[1]) == sorted(parts[6])


def test_attention_gradients_are_right():
    draw = np.random.default_rng(2)
    x, counts = draw.normal(size=(9, 5)), np.array([2, 4, 3])
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    w = quality.initial(5)

    def loss():
        z = quality._forward(w, x, counts)["z"]
        p = sigmoid(z)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for name, d in quality.gradients(w, x, counts, y, weight).items():
        for at in [tuple(draw.integers(0, s) for s in w[name].shape) for _ in range(3)]:
            kept = w[name][at]
            w[name][at] = kept + 1e-5
            high = loss()
            w[name][at] = kept - 1e-5
            low = loss()
            w[name][at] = kept
            assert d[at] == pytest.approx((high - low) / 2e-5, abs=1e-6)
    attention = quality._forward(w, x, counts)["attention"]
    assert np.add.reduceat(attention, [0, 2, 6]) == pytest.approx([1, 1, 1])


def test_calibration_fits_the_share():
    draw = np.random.default_rng(4)
    z = draw.normal(size=4000)
    y = (draw.random(4000) < sigmoid(3 * z - 1)).astype(int)
    a, b = calibrated(z, y)
    assert a == pytest.approx(3, abs=0.3) and b == pytest.approx(-1, abs=0.2)
    assert calibrated(z, y, 0.5)[1] == pytest.approx(b + math.log((4000 - y.sum()) / y.sum()))


# --- language model ----------------------------------------------------------------------------


def brute_base(records, learn):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*words_of(lower(r[1])), " "] for r in records]
    counts = Counter(t for r, ts in zip(records, tokens) if learn(r[0]) for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [(r[0], len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for r, ts in zip(records, tokens)]


@pytest.mark.parametrize("held", [language_model.HELD, 20])
def test_base_scores_equal_brute_force(frame, odd, draw, monkeypatch, held):
    texts = [prose(draw, 50).upper() if k % 7 == 0 else prose(draw, 50) for k in range(60)] + ["É é Ä ä", "a\x85b a b ,, ..."]
    records = odd + [(k + 500, *r[1:]) for k, r in enumerate(rows(texts))]
    monkeypatch.setattr(language_model, "hold", lambda c, f=language_model.hold: f(c, held, 10))
    got = language_model.score(frame(records), fold(F.col("doc_id"), 5) != 1).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *[round(v, 6) for v in x[1:]])
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(brute_base(records, lambda d: remainder(d, 5) != 1), key=key)
    for a, b in zip(mine, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_is_normalised_and_beats_the_base_on_held_out_texts(spark):
    pairs = np.random.default_rng(1).poisson(3.0, (30, 30)).astype(float) * np.random.default_rng(2).choice([0, 5], (30, 30))
    logs = language_model.train(pairs, steps=200)
    assert (10**logs).sum(1) == pytest.approx(np.ones(30))
    unigram = np.log10((pairs.sum(0) + 0.5) / (pairs.sum() + 15))
    assert (pairs * logs).sum() > (pairs * unigram).sum()
    found = [r for r in queries.op5_lm_scoring(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found) * 0.98
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 1) for r in found)


def test_nothing_to_learn_from(frame):
    docs = frame(rows(["a b", None]))
    got = language_model.score(docs, F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (3, 0, 0)]
    assert language_model.score(frame([]), F.lit(True)).count() == 0


def test_classes_agree_in_both_languages(spark):
    tokens = ["the", "the.", "x,;", "9", "é", "é!", "...", " ", "z?", "ab ", "a:b"]
    rows_ = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", language_model.class_of(F.col("token")).alias("c")).collect()
    assert {r["token"]: r["c"] for r in rows_} == {t: language_model.class_of_bytes(t.encode()) for t in tokens}
