import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_cases import prose, rows

from shelfmark.llm import decontaminate, jaccard
from shelfmark.llm.components import components


def shingles(text):
    words = text.split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def changed(draw, text, times):
    words = text.split()
    for _ in range(times):
        words[draw.randrange(len(words))] = "changed" + str(draw.randrange(10**6))
    return " ".join(words)


def brute_links(records):
    """(class_id, links, text_links) of each record, in order."""
    texts = sorted({r[1] for r in records if r[1] is not None})
    sets = [shingles(t) for t in texts]
    near = defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    least = {i: min((r[0] for r in records if r[1] == t), key=lambda d: (d is not None, d)) for i, t in enumerate(texts)}
    copies = Counter(r[1] for r in records)
    found, group = {}, {}
    for i in range(len(texts)):
        if i in group:
            continue
        todo, members = [i], set()
        while todo:
            k = todo.pop()
            if k not in members:
                members.add(k)
                todo += near[k]
        first = min((least[k] for k in members), key=lambda d: (d is not None, d))
        for k in members:
            group[k] = first
    for i, t in enumerate(texts):
        found[t] = (group[i], copies[t] - 1 + sum(copies[texts[j]] for j in near[i]), len(near[i]))
    return [(r[0], 0, 0) if r[1] is None else found[r[1]] for r in records]


@pytest.fixture
def families(draw, odd):
    """Families of near copies, from near-equal to just under and over the threshold, and passages that many share."""
    shared = prose(draw, 40)
    texts = []
    for n in range(12):
        base = prose(draw, draw.choice([30, 80, 200]))
        texts += [base, base, *[changed(draw, base, k) for k in (1, 1, 2, 3, 4, 6)], base + " " + prose(draw, 5)]
    texts += [shared + " " + prose(draw, 30) for _ in range(15)]
    records = odd + rows(texts)
    return [(1000 + k if r[0] is not None and k >= len(odd) else r[0], *r[1:]) for k, r in enumerate(records)]


def test_links_equal_brute_force(stored, families):
    docs = stored(families)
    got = Counter((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in jaccard.linked(docs).collect())
    assert got == Counter((r[0], *w) for r, w in zip(families, brute_links(families)))


def test_blocks_of_a_large_family_give_the_same(stored, draw, monkeypatch):
    base = prose(draw, 60)
    records = rows([changed(draw, base, draw.randint(0, 3)) for _ in range(90)])
    want = Counter((r[0], *w) for r, w in zip(records, brute_links(records)))
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    got = Counter((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in jaccard.linked(stored(records)).collect())
    assert got == want and len({w[2] for w in want}) > 3


def test_one_of_each_class_stays(stored, families):
    docs = stored(families)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = defaultdict(list)
    for r, w in zip(families, brute_links(families)):
        classes[("null", r[0], id(r)) if r[1] is None else w[0]].append(r)
    got = kept.collect()
    assert len([r for r in got if r["text"] is not None]) == len([c for c in classes if not isinstance(c, tuple)])
    assert len([r for r in got if r["text"] is None]) == len([r for r in families if r[1] is None])
    assert {r["doc_id"] for r in got if r["text"] is not None} == {c for c in classes if not isinstance(c, tuple)}


def test_empty_and_wordless_tables(stored):
    assert jaccard.linked(stored([])).count() == 0 and jaccard.one_of_each(stored([])).count() == 0
    alone = stored(rows([None, "", " ", ""]))
    assert sorted((r["links"], r["text_links"]) for r in jaccard.linked(alone).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0)]
    assert jaccard.one_of_each(alone).count() == 3


def test_pruning_keeps_pairs_at_the_threshold():
    least = [jaccard.least_matches(n) for n in (32, 64, 96, 128, 160)]
    assert least == sorted(least) and least[0] < 0.8 * 32
    draw = np.random.default_rng(1)
    sets = [draw.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2)]
    sets.append(np.concatenate([sets[0][:450], draw.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    sets = [np.unique(s) for s in sets]
    found = {i: js.tolist() for i, js in jaccard.linked_pairs(jaccard.minhashes(sets), sets, 0)}
    assert found == {0: [2]}


def test_components_match_a_plain_search(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    label = {n: n for e in edges for n in e}
    changed_ = True
    while changed_:
        changed_ = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed_ = True
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: v for n, v in label.items() if n not in alone}


def edit(draw, text, errors):
    chars = list(text)
    for _ in range(errors):
        at = draw.randrange(len(chars))
        what = draw.random()
        if what < 0.4:
            chars[at] = "Q"
        elif what < 0.7:
            del chars[at]
        else:
            chars.insert(at, "Z")
    return "".join(chars)


def plain_distance(item, text):
    """(least distance of the item to any part of the text)."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def whole_distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        new = [j]
        for i, p in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
    return row[-1]


def test_bit_parallel_distances_equal_the_table(draw):
    for _ in range(60):
        item, text = ("".join(draw.choice("abc") for _ in range(draw.randint(1, n))) for n in (90, 40))
        assert min([len(item), *decontaminate.distances(item, text)]) == plain_distance(item, text)
        distance, a, b = decontaminate.closest(item, text)
        assert distance == whole_distance(item, text[a:b]) == plain_distance(item, text) or not text


def test_leaks_equal_brute_force(spark, frame, odd, draw):
    items = [prose(draw, n) for n in (5, 12, 30, 30, 60)] + [None, "", "short", prose(draw, 30).upper()]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(1, items[1], "y")], "item_id long, text string, doc_id string")
    texts = []
    for item in items:
        for errors in (0, 1, 3, 6, 12):
            texts.append(prose(draw, 25) + " " + edit(draw, item or "none", errors) + "\n" + prose(draw, 10))
    texts.append((items[1] + " ") * 3)
    records = [(k + 100, t, "en", "a", 0, *"xyzrm") for k, t in enumerate(texts)] + [r for r in odd if len(r[1] or "") < 10_000]
    want = Counter()
    for r in records:
        text = decontaminate.normal(r[1] or "")
        for k, item in enumerate(items):
            plain = decontaminate.normal(item or "")
            if len(plain) >= decontaminate.MIN_CHARS:
                distance = plain_distance(plain, text)
                if distance <= len(plain) // decontaminate.CHARS_PER_ERROR:
                    want[(r[0], k, distance)] += 1
    docs = frame(records)
    for block in (decontaminate.BLOCK_CHARS, 150):
        got = decontaminate.leaks(docs, benchmark, block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == want
        for r in got:
            part = decontaminate.normal(dict((x[0], x[1]) for x in records)[r["doc_id"]])[r["start"] : r["end"]]
            assert whole_distance(decontaminate.normal(items[r["item_id"]]), part) == r["distance"]
        clean = decontaminate.without_leaks(docs, benchmark, block)
        assert clean.columns == docs.columns
        bad = {k[0] for k in want}
        assert Counter(map(tuple, clean.collect())) == Counter(tuple(r) for r in records if r[0] not in bad)
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.without_leaks(docs.limit(0), benchmark).count() == 0


def test_nothing_is_lost_when_files_are_split_otherwise_between_steps(spark, stored, families, monkeypatch):
    """As when executors are lost or added: each later reading sees another number of cores."""
    docs = stored([*families, *rows([f"text {k} of its own, with some more words" for k in range(3_000)])])
    docs = docs.withColumnRenamed("n", "_row")
    want = Counter(map(tuple, jaccard.one_of_each(docs).collect()))
    links = Counter(map(tuple, jaccard.linked(docs).collect()))
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    steps = iter(range(1, 1_000))

    def other(step):
        def run(*given):
            done = step(*given)
            k = next(steps)
            for name, value in zip(names, (1 + k * 7 % 23, 4_096 * (1 + k % 5), 64)):
                spark.conf.set(name, value)
            return done

        return run

    monkeypatch.setattr(jaccard, "cut_lineage", other(jaccard.cut_lineage))
    monkeypatch.setattr(jaccard, "written", other(jaccard.written))
    try:
        assert Counter(map(tuple, jaccard.one_of_each(docs).collect())) == want
        assert Counter(map(tuple, jaccard.linked(docs).collect())) == links
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sum(want.values()) > 3_000
