from collections import Counter, defaultdict

import corpus_pipeline
from odd_cases import prose, rows
from test_pairs import brute_links, changed, plain_distance
from test_sharding_mixing import best_shard, targets

from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, mix, toxicity
from shelfmark.llm.common import fold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, draw, tmp_path):
    items = [prose(draw, 20) for _ in range(4)]
    bases = [prose(draw, draw.randint(20, 90)) for _ in range(40)]
    texts = bases + [changed(draw, b, 1) for b in bases[:12]] + bases[:5] + [f"{prose(draw, 20)} {i} {prose(draw, 9)}" for i in items]
    toxic = [prose(draw, 20) + " you scoundrel villain wretch " + prose(draw, 20) for _ in range(60)]
    records = [r[:5] for r in rows(texts + toxic + [None, "", " "], ("a", "a", "b", None))]
    for name, data, schema in (
        ("documents", records, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(r[0], 1, int("scoundrel" in (r[1] or ""))) for r in records], "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [records]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS + ["shard"] * (k == 4)
        docs.write.parquet(path := str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(path)
        kept.append([tuple(r) for r in docs.collect()])
    clean, single, unleaked, mixed, sharded = kept[1:]
    model = toxicity.train(source, spark.read.parquet(str(tmp_path / "labels.parquet")), fold(F.col("doc_id"), 5) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(source, model).collect()}
    assert Counter(clean) == Counter(r for r in records if scores[r[0]] < corpus_pipeline.TOXIC_FROM)
    right = [("scoundrel" in (r[1] or "")) == (r not in clean) for r in records]
    assert sum(right) / len(right) > 0.9
    ids = {w[0] for r, w in zip(clean, brute_links(clean)) if r[1] is not None} | {r[0] for r in clean if r[1] is None}
    assert {r[0] for r in single} == ids and len(single) == len(ids)
    leaked = {
        r[0] for r in single for i in map(decontaminate.normal, items)
        if plain_distance(i, decontaminate.normal(r[1] or "")) <= len(i) // decontaminate.CHARS_PER_ERROR
    }
    assert leaked and Counter(unleaked) == Counter(r for r in single if r[0] not in leaked)
    sizes, words = Counter(), defaultdict(int)
    for r in unleaked:
        sizes[r[3]] += len((r[1] or "").split())
    for r in mixed:
        words[r[3]] += len(r[1].split())
    assert set(mixed) <= set(unleaked) and max(Counter(mixed).values()) <= 2
    for source, target in targets(sizes, mix.WEIGHTS, 1.5, 2).items():
        assert abs(words[source] - target) <= 120
    assert Counter(sharded) == Counter((*r, best_shard(r[0], [1.0] * corpus_pipeline.SHARDS)) for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(sharded)


def test_an_empty_table_stays_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
