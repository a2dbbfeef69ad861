"""Headings and scalar text functions on made lines, and on all documents for planning time."""

import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import headings as H


def column(spark, values, make, extra=None):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("o")).collect()]


def test_trim_unbalanced_is_a_fixed_point(spark):
    cases = {
        "(alpha": "alpha", "alpha)": "alpha", "((( alpha": "alpha", "[( -alpha": "alpha", "（完整版）": "（完整版）", "(a) b)": "(a) b)",
        "】【x": "】【x", "】x": "x", "x [ (": "x", "": "", "((": "", "a(b": "a(b", "[x) (y": "x) (y",
    }
    assert column(spark, list(cases), T.trim_unbalanced) == list(cases.values())


#: (title, what is left of an episodic one, and of one that is not)
NOISY = [
    ("远山行 4K HDR 更新至12集", "远山行", "远山行"), ("远山行172", "远山行", "远山行"), ("远山行2", "远山行", None), ("远山行 EP03 第5集 1080p 4k 720p 蓝光 EP 7", "远山行", "远山行"),
    ("4K 蓝光", None, None), ("（远山行）", "远山行", "远山行"), ("River E12 E13 E14 E15 E16 4K", "River", "River"), ("远山行", None, None), ("1080 720", "1080", "1080"), ("  north star  ", None, None),
    ("北斗 第1话 第2话 第3话 第4话 第5话 第6话", "北斗", "北斗"),
]


@pytest.mark.parametrize("episodic,place", [(True, 1), (False, 2)])
def test_search_noise_goes_however_much_there_is(spark, episodic, place):
    clean = lambda values: column(spark, values, lambda c: H.strip_search_noise(c, F.lit(episodic)))
    got = clean([n[0] for n in NOISY])
    assert got == [n[place] for n in NOISY]
    left = [g for g in got if g is not None]
    assert clean(left) == [None] * len(left)  # nothing more goes


@pytest.mark.parametrize("value,year", [("Alpha (2001) 1-12", 2001), ("Alpha 2001 1080p", 2001), ("1080p 20015", None), ("Beta 1999 2010", 2010)])
def test_last_year(spark, value, year):
    assert column(spark, [value], T.last_year) == [year]


def test_numbers_and_keys(spark):
    assert column(spark, ["十二", "二十", "三", "百", "二十五"], T.cjk_number) == [12, 20, 3, None, 25]
    assert column(spark, ["Ａｌｐｈａ-1", "étude", "ｶﾞﾙ", "Straße!", "①"], T.title_key) == ["alpha1", "étude", "ガル", "strasse", "1"]
    assert column(spark, ["  Ann \t Lee. "], T.name_key) == ["ann lee."]
    assert column(spark, ["👤 Ann Lee，\nrest"], T.clean_person_name) == ["Ann Lee"]


def parsed(spark, heading):
    return H.parse_headings(spark.createDataFrame([(heading,)], "h string"), "h").first().asDict(recursive=True)


@pytest.mark.parametrize(
    "heading,want",
    [
        ("📺 远山行 (2021) S01E02 1080p H.265", {"title": "远山行", "year": 2021, "season": 1, "episode": 2, "media_type": "tv", "quality": "1080P", "codec": "H.265"}),
        ("🎥 River (1999) 电影 2160p DV", {"title": "River", "year": 1999, "season": None, "media_type": "movie", "quality": "2160P", "hdr": "DV"}),
        ("👤 Ann Lee", {"title": "Ann Lee", "resource_kind": "person", "media_type": "unknown", "year": None}),
        ("📺 远山行 (2021) 全24集", {"season": 1, "episode": 1, "episode_range": {"first": 1, "last": 24}}),
        ("📺 远山行 (2021) 第2季 更新至第8集", {"season": 2, "episode": 1, "episode_range": {"first": 1, "last": 8}}),
        ("📺 远山行 2021 1-12", {"season": 1, "episode": 1, "episode_range": {"first": 1, "last": 12}}),
        ("📺 远山行 2021 x 2022 1-12", {"episode": None, "episode_range": None}),
        ("[ADWeb] [River] 4K", {"title": "River", "quality": "4K"}),
        ("名称：远山行 合集", {"title": "远山行", "is_collection": True}),
    ],
)
def test_headings(spark, heading, want):
    got = parsed(spark, heading)
    assert {k: got[k] for k in want} == want


def test_all_documents_are_planned_and_run_in_seconds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    began = time.time()
    out = H.parse_headings(docs.withColumn("head", T.first_line(F.col("text"))), "head").withColumns({
        "trimmed": T.trim_unbalanced(F.col("text")), "base": H.strip_search_noise(F.col("title"), F.lit(False)),
        "unclosed": T.cut_unclosed(F.col("title")),
    })
    assert out.select("title", "trimmed", "base", "unclosed", "season", "quality_tags").count() == docs.count()
    out.select("title", "trimmed", "base", "unclosed").write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60
