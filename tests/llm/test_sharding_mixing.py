import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from odd_cases import prose, rows, words_of
from pyspark.sql import functions as F

from shelfmark.llm import mix, shard
from shelfmark.llm.common import one_per_copy


def chained(*values):
    """xxhash64 of longs and ints as Spark chains it: each value seeded by the hash so far."""
    seed = 42
    for v, size in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def best_shard(doc_id, weights):
    scores = []
    for s, w in enumerate(weights):
        u = (chained((doc_id, 8), (s, 4)) % (1 << 53) + 0.5) / (1 << 53)
        scores.append((w / -math.log(u), s))
    return max(scores)[1]


def test_shards_match_brute_force_and_move_little(frame, odd):
    docs = frame(odd)
    weights = [1.0, 2.0, 0.5, 1.0]
    placed = shard.assign_shards(docs, ["doc_id"], weights)
    assert placed.columns == docs.columns
    got = placed.select("doc_id", "shard").collect()
    assert Counter((r[0], r[1]) for r in got) == Counter((r[0], best_shard(r[0], weights)) for r in odd)
    grown = shard.assign_shards(placed, ["doc_id"], [*weights, 1.5], "more")
    assert all(r["more"] in (r["shard"], 4) for r in grown.collect())


def test_many_keys_follow_the_weights(spark):
    counts = {r["shard"]: r["count"] for r in shard.assign_shards(spark.range(40_000), ["id"], [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 40_000 - 0.75) < 0.01


def test_slots_are_gapless_also_for_one_hot_row(spark, frame, odd):
    docs = shard.assign_shards(frame(odd + [odd[9]] * 500), ["doc_id"], [1.0] * 3)
    slim = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), "shard")
    slots = defaultdict(list)
    rows = shard.number_slots(slim, "shard", 3).collect()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["crc"]) for r in rows) == Counter(
        (r[0], None if r[1] is None else zlib.crc32(r[1].encode())) for r in odd + [odd[9]] * 500
    )
    assert shard.number_slots(slim.limit(0), "shard", 3).count() == 0


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        shard.shard_of([F.col("x")], [1.0, 0.0])


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("b", 250)], "k string, n long")
    assert Counter((r["k"], r["i"]) for r in one_per_copy(df, "n", "i", chunk=100).collect()) == Counter(
        [("a", 0), *[("b", i) for i in range(250)]]
    )


def quotients(weights, seats, most=None):
    """(seats of each, who the next one goes to) by giving out one seat after the other."""
    won, after = [0] * len(weights), None
    for n in range(seats + 1):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and (most is None or won[i] < most[i])]
        if not open_:
            break
        k = max(open_, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        if n == seats:
            after = k
        else:
            won[k] += 1
    return won, after


@pytest.mark.parametrize("weights,seats", [([5.0, 2.0, 1.0], 1), ([5.0, 2.0, 1.0, 0.0], 11), ([1.0] * 6, 4), ([53.0, 24.5, 23.1, 3.2, 0.4] * 3, 137), ([7.0], 9), ([3.0, 1.0], 0), ([94.0] + [1.2] * 5, 100), ([60.0] + [1.6] * 25, 50)])
def test_sainte_lague_is_by_highest_quotients(spark, weights, seats):
    df = spark.createDataFrame([(i, w, seats, g) for g in ("p", "q") for i, w in enumerate(weights)], "i int, w double, s int, g string")
    for group in ([], ["g"]):
        part = df if group else df.filter("g = 'p'")
        got = {(r["g"], r["i"]): r["quota"] for r in mix.sainte_lague(part, ["i"], group, "w", "s", "quota").collect()}
        want, _ = quotients(weights, seats)
        assert got == {(g, i): want[i] for g in (("p", "q") if group else ("p",)) for i, w in enumerate(weights) if w > 0}


def test_parties_that_are_full_drop_out(spark, draw):
    for case in range(12):
        weights = [round(draw.random() * draw.choice([1, 30]), 3) + 0.01 for _ in range(draw.randint(1, 9))]
        most = [draw.randint(0, 12) for _ in weights]
        seats = draw.randint(0, sum(most) + 3)
        df = spark.createDataFrame([(i, w, seats, m) for i, (w, m) in enumerate(zip(weights, most))], "i int, w double, s int, m int")
        rows = mix.sainte_lague(df, ["i"], [], "w", "s", "quota", "m").collect()
        want, after = quotients(weights, seats, most)
        assert {r["i"]: r["quota"] for r in rows} == dict(enumerate(want)), (weights, most, seats)
        assert [r["i"] for r in rows if r["next_seat"]] == ([] if after is None else [after])


def words_by_quotients(sizes, want, block_words, most=2):
    """What each source is given: blocks one after the other to the highest quotient, the rest of the last to the next."""
    names = sorted(want, key=lambda s: (s is None, (s or "").encode()))
    block = max(1, min(block_words, math.floor(min(t for t in want.values() if t > 0) / mix.BLOCKS_EACH)))
    every = math.floor(sum(want[s] for s in names) + 1e-6)
    won, after = quotients([want[s] for s in names], every // block, [math.ceil(most * sizes[s] / block) for s in names])
    return {s: min(most * sizes[s], won[i] * block + (every % block if i == after else 0)) for i, s in enumerate(names)}


@pytest.mark.parametrize("block_words", [1, 7, 64])
def test_what_the_mix_takes_is_by_highest_quotients(frame, draw, block_words):
    sizes = {"a": 2_600, "b": 31, "c": 1_700, "d": 900, None: 44}
    texts, names = [], []
    for s, n in sizes.items():
        while n:
            k = min(n, draw.randint(1, 60))
            texts.append(prose(draw, k))
            names.append(s)
            n -= k
    docs = frame([(k, t, "en", s, 0, *"xyzrm") for k, (t, s) in enumerate(zip(texts, names))])
    taken = Counter()
    for r in mix.mix(docs, block_words=block_words, shard_words=700).collect():
        taken[r["source"]] += r["taken"]
    want = targets(sizes, mix.WEIGHTS, 1.5, 2)
    given = words_by_quotients(sizes, want, block_words)
    for s in sizes:  # a source's shards may each miss a part of their last block
        assert abs(taken[s] - given[s]) <= (block_words if sizes[s] > 700 else 0)
        assert abs(taken[s] - want[s]) <= max(1, want[s] / 32)


def targets(sizes, weights, share, most):
    """By rounds: what is above a cap goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(frame, odd, draw):
    records = rows([prose(draw, draw.randint(5, 400)) for _ in range(300)], ("a", "a", "b", "B", "é", None)) + odd
    docs = frame(records)
    result = mix.mix(docs, block_words=8, shard_words=5_000).collect()
    assert Counter((r["source"], r["doc_id"], r["size"]) for r in result) == Counter((r[3], r[0], len(words_of(r[1]))) for r in records)
    sizes, taken = Counter(), Counter()
    for r in result:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets(sizes, mix.WEIGHTS, 1.5, 2)
    for r in result:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 8 * (2 + sizes[s] / 5_000)
    again = mix.mix(docs.repartition(3), block_words=8, shard_words=5_000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, result))


def test_mix_of_empty_and_wordless_tables(frame):
    assert mix.mix(frame([])).count() == 0
    rows = mix.mix(frame([(1, None, "en", "a", 0, *"xyzrm"), (2, "", "en", None, 0, *"xyzrm")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 2


def test_mixed_documents_stand_as_often_as_taken(frame, odd, draw):
    records = rows([prose(draw, draw.randint(5, 200)) for _ in range(100)], ("a", "b", "c", None)) + odd
    docs = frame(records)
    mixed = mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter(tuple(r) for r in mixed.collect())
    assert set(got) <= {tuple(r) for r in records}
    times = Counter()
    for r in mix.mix(docs).collect():
        if r["size"]:
            times[(r["source"], r["doc_id"])] += math.floor(r["taken"] / r["size"] + 0.5)
    repeated = {k for k, n in Counter((r[3], r[0]) for r in records).items() if n > 1}
    seen = Counter()
    for r, n in got.items():
        seen[(r[3], r[0])] += n
    assert {k: n for k, n in seen.items() if k not in repeated} == {k: n for k, n in times.items() if n and k not in repeated}
