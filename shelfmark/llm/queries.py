"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, decontaminate, jaccard, language_model, line_rules, mix, piece_codec, quality, shard, token_counts, toxicity, url_filter, whiten
from ..session import written
from .common import fold, table

SHARDS = 16
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that some part of a document is within its error budget of."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards, by key; ``grown_shard`` is the shard when there are 17."""
    docs = table(spark, sf_dir, "documents")
    placed = shard.assign_shards(docs, ["doc_id"], [1.0] * SHARDS)
    placed = shard.assign_shards(placed, ["doc_id"], [1.0] * (SHARDS + 1), "grown_shard")
    slim = placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
    )
    return shard.number_slots(slim, "shard", SHARDS)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of each document."""
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of four folds of five."""
    docs, remainder = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document, learned from four folds of five."""
    remainder = fold(F.col("doc_id"), 5)
    scored = language_model.score(table(spark, sf_dir, "documents"), remainder != 1)
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of three folds of four."""
    docs, remainder = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder != 2)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its numbers of links."""
    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "text_links")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL; the labelled URL table is of the pages that a rule decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rule = url_filter.deciding_rule(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url")), URL_RULES)
    labelled = pages.select("url", (rule["verdict"] == "block").cast("double").alias("blocked")).filter(F.col("blocked").isNotNull())
    judged = url_filter.judge(pages, URL_RULES, url_filter.train(labelled))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line rules for every document."""
    return line_rules.clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Greedy word-piece counts of every document; the vocabulary file is read by the driver alone."""
    first, inner = token_counts.sentencepiece_vocabulary(vocabulary, bare_start=True)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), first, inner)


def op11_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests; the vocabulary file is read by the driver alone."""
    model = piece_codec.read_model(vocabulary)
    encoded = piece_codec.encode(table(spark, sf_dir, "documents"), model).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    return piece_codec.decode(encoded, model, keep=("doc_id", "n_tokens", "ids_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_alignment(spark: SparkSession, sf_dir: str, first: str = BYTE_VOCABULARY, second: str = VOCABULARY) -> DataFrame:
    """Groups and links between the ids of two vocabularies over every whole text; both files are read by the driver alone."""
    models = align.read_byte_model(first), piece_codec.read_model(second)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = written(align.align(table(spark, sf_dir, "documents"), *models).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return align.score_links(aligned, align.count_links(aligned, *models)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_whitening(spark: SparkSession, sf_dir: str, components: int = 32) -> DataFrame:
    """Every embedding on the whitened components of falling variance, up to 32."""
    vectors, size = whiten.kept_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    known = whiten.fit(vectors, size, components)
    error = whiten.identity_error(vectors, known)
    explained = F.array(*[F.lit(e) for e in known.explained()]).cast("array<double>")
    return whiten.whiten(vectors, known, ["vec_id"]).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_sharding, op3_mixing, op4_toxicity, op5_lm_scoring, op6_quality, op7_jaccard_join, op8_url_filters,
        op9_quality_rules, op10_token_counts, op11_sentencepiece, op12_alignment, op13_whitening,
    )
}
_WORD = r"[^\x20\x09-\x0D]+"
_PHRASE = " OR ".join(f"contains(lower(line), '{p}')" for p in line_rules.BOILERPLATE)

ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
p AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, COUNT(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS k FROM p) GROUP BY 1),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
m AS (SELECT r, line, length(regexp_replace(line, '[ 	

]', '', 'g')) AS solid, length(regexp_replace(line, '[\p{{L}}\p{{M}}\p{{N}}\s]+', '', 'g')) AS marks,
  length(line) - length(translate(line, '|»›•', '')) AS bars, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l),
f AS (SELECT r, SUM(n) AS lost FROM m WHERE solid > 0 AND (marks > 0.2 * solid OR bars > 2 OR {_PHRASE}
  OR (n < 4 AND NOT regexp_matches(line, '[.!?:;…。"'')\]]\s*$'))) GROUP BY 1),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	

]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(f.lost, 0) AS lost FROM w LEFT JOIN c USING (r) LEFT JOIN f USING (r)),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * n_words AS kept FROM k""",
}
