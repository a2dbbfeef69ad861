"""Maintenance jobs on cases that the given tables do not hold."""

from shelfmark.operators import maintenance

WORKS = "id long, title string, media_type string, status string, resource_kind string, is_bundle boolean, is_metadata boolean"
RESOURCES = "id long, work_id long, season int, season_end int, episode int, raw_label string, filename string, context string"


def work(k, title="t", media_type="unknown", status="pending", kind="media", bundle=False, pack=False):
    return (k, title, media_type, status, kind, bundle, pack)


def test_what_speaks_for_a_type(spark):
    works = [
        work(1), work(2), work(3), work(4, "某有声剧"), work(5), work(6), work(7), work(8, status="matched", media_type="tv"), work(9, kind="person"), work(10, "2049"), work(11, "排球少年＋剧场版"), work(12, "某合集"), work(13, media_type="tv"),
    ]
    rows = [
        (1, None, None, None, "📺 某剧 第三集", None, None), (2, None, None, None, None, "x.mkv", "🎬 某片 剧场版\n全12集"), (3, 1, None, None, None, None, None), (4, 2, None, 5, None, None, None), (5, None, None, None, None, "a.flac", None),
        (6, None, None, 20240101, None, None, None), (7, 2, None, None, "剧场版", None, None), (10, None, None, None, "更新至12集", None, None), (11, None, None, None, "剧场版", None, None), (12, None, 3, None, None, None, None), (13, 1, None, None, "某电影", None, None),
    ]
    w = spark.createDataFrame(works, WORKS)
    r = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], RESOURCES)
    found = maintenance.type_evidence(w, r)
    got = {e["id"]: (e["type"], e["confidence"], e["source"], e["reasons"]) for e in found.collect()}
    assert got[1] == ("tv", "strong", "heading", ["tv_text:第三集"]) and got[2] == ("movie", "strong", "heading", ["movie_text:剧场版"])
    assert got[3] == ("unknown", "weak", "season", ["season:1"]) and got[4] == ("unknown", "weak", "none", ["audio_drama"])
    assert got[5][1] == "weak" and got[5][3] == ["audio_file"] and got[6][3] == ["episode_date:20240101"]
    assert got[7] == ("unknown", "conflict", "conflict", ["season:2", "movie_text:剧场版"]) and got[8][1] == "tmdb" and got[9][1] == "excluded"
    made = maintenance.strong_type_changes(found, r)
    assert sorted((c["id"], c["media_type"]) for c in made["works"].collect()) == [(1, "tv"), (2, "movie"), (13, "movie")]
    assert [c["id"] for c in made["resources"].collect()] == [10]


def test_collections_and_music_take_their_resources_along(spark):
    works = [(1, "某某全集合集", "movie", "media", False), (2, "某某音乐专辑", "unknown", "media", False), (3, "Plain", "movie", "media", True), (4, "Plain", "movie", "media", False), (5, "Plain", "movie", "series", False)]
    rows = [(10, 1, "media", None, "x", "x.mkv"), (11, 1, "person", None, "x", "x.mkv"), (12, 1, "collection", None, "x", "x.mkv"), (20, 2, "media", None, "x", "x.zip"), (30, 3, "media", None, "x", "x.mkv"), (40, 4, "collection", None, "x", "x.mkv"), (41, 4, "other", None, "x", "x.mkv"), (50, 5, "media", None, "x", "x.mkv")]
    w = spark.createDataFrame(works, "id long, title string, media_type string, resource_kind string, is_bundle boolean")
    r = spark.createDataFrame(rows, "id long, work_id long, resource_class string, kind string, raw_label string, filename string")
    got = {c["id"]: c["resource_class"] for c in maintenance.collection_classes(r, w).collect()}
    assert got == {10: "collection", 20: "music", 30: "collection", 40: "media", 50: "collection"}
