"""Page expansion, names, evidence and terms on cases that the given tables do not hold."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import written_number
from shelfmark.operators import attribution, evidence, identify, pages, search, terms

SHARE = "https://115.com/s/{}"
PAGE = "https://telegra.ph/{}"


@pytest.fixture
def one(spark):
    """The value of an expression over one text."""
    def of(expression, *texts):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        return [r[0] for r in rows.select("k", expression(F.col("t")).alias("v")).orderBy("k").select("v").collect()]

    return of


def test_pages_nest_and_turn_in_circles(spark):
    messages = [(1, "🎬 Film (1999)\nsee " + PAGE.format("a") + " and " + PAGE.format("b"), None), (2, "x " + PAGE.format("b"), "👤 Somebody"), (3, "no page", None), (4, None, None), (5, "📺 Show\n" + PAGE.format("bare") + ".", None)]
    table = [
        (PAGE.format("a"), "A – Telegraph", [PAGE.format("c"), PAGE.format("b"), "http://telegra.ph/no", "https://other.org/x"], [SHARE.format("a1"), "words"]),
        (PAGE.format("b"), "B", [PAGE.format("a"), PAGE.format("gone")], ["words", "ed2k://|file|x|1|0|/"]),
        (PAGE.format("c"), "C", [PAGE.format("a"), PAGE.format("c")], ["nothing"]),
        (PAGE.format("bare."), None, [], [SHARE.format("z")]),
    ]
    m = spark.createDataFrame(messages, "id long, text string, inherited string")
    p = spark.createDataFrame(table, "url string, title string, links array<string>, lines array<string>")
    got = {r["id"]: r["expanded"] for r in pages.expanded(m, p).collect()}
    assert got[1] == messages[0][1] + f"\n📺 A\n{SHARE.format('a1')}\n📺 B\ned2k://|file|x|1|0|/"
    assert got[2] == messages[1][1] + f"\n👤 Somebody\ned2k://|file|x|1|0|/\n👤 Somebody\n{SHARE.format('a1')}"
    assert got[3] == "no page" and got[4] == ""
    assert got[5] == messages[4][1] + f"\n📺 Show\n{SHARE.format('z')}"


def test_written_numbers(one):
    texts = ["7", "十", "十二", "二十", "九十九", "百", "一百零五", "两百", "三百二十一", "二百十", "", "百十", "一二", "x"]
    assert one(written_number, *texts) == [7, 10, 12, 20, 99, 100, 105, 200, 321, 210, None, 110, None, None]


@pytest.mark.parametrize("text,season,episode,tags", [
    ("Show.S01E02.mkv", 1, 2, ["sxe"]), ("Show 2x07", 2, 7, ["season_episode_x"]), (" S4 ", 4, None, ["season_word"]), ("Show Season 3", 3, None, ["season_word"]),
    ("Show EP12", 1, 12, ["episode_word"]), ("第二季 第十集", 2, 10, ["season_zh", "episode_zh"]), ("第5话", 1, 5, ["episode_zh"]), ("Talk 20240131", None, 20240131, ["episode_date"]),
    ("Show 番外", 0, None, ["special"]), ("Show SP3", None, 3, ["special", "episode_special_code"]), ("a\\b\\Show.S02E03.mkv", 2, 3, ["sxe"]), ("Movie 1999", None, None, []), (None, None, None, []),
])
def test_built_in_episodes(one, text, season, episode, tags):
    (found,) = one(identify.structured_episode, text)
    assert (found["season"], found["episode"], found["evidence"]) == (season, episode, tags)


def test_user_rules_come_first_in_their_order(one):
    rules = [identify.EpisodeRule(r"#(\w+)"), identify.EpisodeRule(r"(\d+)of(\d+)", episode_group=1, season_group=2), identify.EpisodeRule(r"(\d+)of", default_season=9)]
    got = one(lambda t: identify.ruled_episode(t, rules), "#x 3of2 S01E01", "#5", "4of", "S01E01", None)
    assert [None if g is None else (g["season"], g["episode"]) for g in got] == [(2, 3), (1, 5), (9, 4), None, None]


def test_the_last_value_before_a_row_crosses_blocks(spark):
    rows = [(g, k, k * 10 if k % 37 == 5 else None) for g in ("a", None) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r["g"], r["k"]): r["held"] for r in identify.running_last(df, ["g"], "k", "v", "held", block=16).collect()}
    assert got == {(g, k): max((j * 10 for j in range(k) if j % 37 == 5), default=None) for g in ("a", None) for k in range(200)}


@pytest.mark.parametrize("text,want", [
    ("名称：毒液 (Venom)\n上映时间：2018-10-05", ("毒液", 2018, None, None)), ("📺 仙武传 2023 4K 更新至12集\n#剧集", ("仙武传", 2023, None, "tv")), ("🎬 笑傲江湖1996 吕颂贤", ("笑傲江湖", 1996, None, None)),
    ("片名：某剧 第三季\n年份：2020", ("某剧", 2020, 3, None)), ("某剧 2020", None), ("🎬 电影 合集", None), ("名称：合集\n年份：2020", None), ("名称：某剧", None), ("", None), (None, None),
])
def test_stated_works(spark, text, want):
    said = evidence.stated(spark.createDataFrame([(1, text)], "id long, text string")).first()["said"]
    assert (said and (said["title"], said["year"], said["season"], said["media_type"])) == want


def test_one_candidate_of_a_kind_is_selected(spark):
    e = [(1, "A", 2000, None, "tv", "movie"), (2, "A", 2000, 2, None, "movie"), (3, "A合集", 2000, None, None, "movie"), (4, "Pluribus 同乐者", 2000, 1, None, "tv"), (5, "A", 2000, None, None, "unknown"), (6, "A", 2000, None, "tv", "movie")]
    ev = spark.createDataFrame(e, "work_id long, title string, year int, season int, stated_type string, own_type string").withColumn("title_key", F.lower(F.replace("title", F.lit(" "))))
    c = [(1, 10, "A", 2000, "tv"), (1, 11, "A", 2000, "movie"), (2, 20, "A", 2000, "movie"), (3, 30, "A合集", 2000, "movie"), (4, 40, "Pluribus", 2000, "movie"), (4, 41, "Else", 2000, "tv"), (5, 50, "A", 2000, "movie"), (5, 51, "A", 2000, "tv"), (6, 60, "A", 2000, "movie"), (6, 61, "A", 2001, "tv")]
    ca = spark.createDataFrame(c, "work_id long, catalogue_id long, title string, year int, media_type string").withColumn("title_key", F.lower(F.replace("title", F.lit(" "))))
    got = {r["work_id"]: (r["catalogue_id"], r["selected_by"]) for r in evidence.selected(ev, ca).collect()}
    assert got == {1: (10, "stated_type"), 4: (40, "latin_alias"), 6: (60, "own_type")}


def test_terms_are_taken_apart_and_bounded(spark):
    schema = "work_id long, place long, title string, year int"
    heads = spark.createDataFrame([(1, 0, "凡人修仙传 A Record", 2020)], schema)
    files = spark.createDataFrame([(1, k, f"File{k}", None) for k in range(9)] + [(2, k, f"File{k}", None) for k in range(3)], schema)
    flags = spark.createDataFrame([(1, False), (2, False)], "work_id long, from_files boolean")
    got = sorted(map(tuple, terms.search_terms(terms.term_union({"heading": heads, "filename": files}, flags)).select("work_id", "ord", "title", "use").collect()), key=lambda r: (r[0], r[1] or 99, r[2]))
    assert got[:4] == [(1, 1, "凡人修仙传", "active"), (1, 2, "A Record", "active"), (1, 3, "凡人修仙传 A Record", "active"), (1, 4, "File0", "spare")]
    assert {r[3] for r in got[4:] if r[0] == 1} == {"unused"} and [r[3] for r in got if r[0] == 2] == ["active"] * 3


def test_children_go_with_the_works_that_go(spark):
    works = spark.createDataFrame([(1, "film", "media", "pending", None, "unknown", None), (2, "film", "media", "pending", None, "tv", None), (3, "done", "media", "matched", 9, "unknown", None)],
                                  "id long, title_key string, resource_kind string, status string, catalogue_id long, media_type string, year int")
    resources = spark.createDataFrame([(10, "a", 1, "media"), (11, "b", 3, "media")], "id long, source_key string, work_id long, resource_class string")
    parsed = spark.createDataFrame([("a", "Film", "film", None, "tv", "media"), ("b", "Film", "film", None, "tv", "media"), ("z", "Film", "film", None, "tv", "media")], "source_key string, title string, title_key string, year int, media_type string, resource_kind string")
    links = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b")], "message_id long, source_key string")
    candidates = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "work_id long, catalogue_id long")
    made = attribution.refreshed(parsed, resources, works, links, [], candidates=candidates)
    assert sorted(map(tuple, made["resources"].select("id", "work_id").collect())) == [(10, 2), (11, 3)]
    assert sorted(map(tuple, made["links"].select("message_id", "work_id").collect())) == [(5, 2), (6, 2)]
    assert [r["id"] for r in made["removed"].collect()] == [1] and [tuple(r) for r in made["candidates"].collect()] == [(1, 100)] and made["created"].count() == 0


def test_snapshots_of_any_shape(one):
    texts = ['{"extra": "e", "share_snapshot": {"status": "ok", "share_title": "t", "names": ["n"], "root_names": null, "files": [{"name": "f", "path": "p", "size": 1}], "note": "x"}}',
             '{"share_snapshot": {"status": "error", "names": ["n"]}}', "[]", "broken", None, '{"share_snapshot": "text"}']
    assert one(search.snapshot_texts, *texts) == [["e", "t", "n", "f", "p"], [], [], [], [], []]


def test_stored_grams_find_what_a_scan_finds(spark):
    import random

    draw = random.Random(2)
    rows = [(k, "".join(draw.choice("abAB éÉçñ中 ") for _ in range(draw.randint(0, 40)))) for k in range(400)] + [(1000, None), (1001, "")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3).cache()
    stored = search.store_postings(texts, "id", buckets=5)
    cases = [["abÉ"], ["ÉÉ"], ["éab", "BA"], ["中 a"], [], ["zzz"], [""], *[["".join(draw.choice("abABéÉ中") for _ in range(draw.randint(2, 4))) for _ in range(draw.randint(1, 2))] for _ in range(12)]]
    low = search.ascii_lowered
    for wanted in cases:
        want = sorted(k for k, t in rows if t is not None and all(low(w) in low(t) for w in wanted))
        assert sorted(r["id"] for r in stored.search(texts, wanted).collect()) == sorted(r["id"] for r in search.search(texts, "id", wanted).collect()) == want, wanted


def test_scores_take_the_best_of_all_titles_and_decide(spark):
    from difflib import SequenceMatcher

    titles = [(1, "River Song"), (1, "The River Song"), (2, "作品"), (2, "Opus"), (3, "Cold War")]
    works = [(1, "River Song", "movie", False, [1999, 2000], False, "unknown", False), (2, "作品", "movie", False, [2001], False, "unknown", False), (3, "Cold War", "tv", True, None, True, "unknown", False)]
    found = [
        (1, 10, "movie", ["The River Songs", "Other"], False, 2000, False, False, False, 4.0), (1, 11, "movie", ["River Song"], False, 1999, False, False, False, 0.0), (1, 12, "movie", ["River Song"], False, 1950, False, False, False, 0.0),
        (2, 20, "movie", ["作品", "Else"], True, 2001, False, False, False, 0.0), (3, 30, "tv", ["Cold War"], False, 2018, False, False, False, 0.0), (3, 31, "movie", ["Cold War"], False, 2018, False, False, False, 0.0),
    ]
    schema = "work_id long, catalogue_id long, media_type string, titles array<string>, latin_original boolean, year int, explicit boolean, derived boolean, verified boolean, popularity double"
    c = spark.createDataFrame(found, schema)
    w = spark.createDataFrame(works, "work_id long, title string, media_type string, episodic boolean, years array<int>, structured_type boolean, resource_kind string, resource_mixed boolean")
    t = spark.createDataFrame(titles, "work_id long, title string")
    none = spark.createDataFrame([], "work_id long, resource long, title string")
    scored = evidence.scored_candidates(c, w, t, none)
    got = {r["catalogue_id"]: r for r in scored.collect()}
    key = lambda s: s.lower().replace(" ", "")
    for work, k, _, theirs, *_ in found:
        want = max(SequenceMatcher(None, key(a), key(b)).ratio() for w_, a in titles if w_ == work for b in theirs)
        assert got[k]["similarity"] == pytest.approx(want)
    assert got[11]["score"] == 0.99 and got[12]["score"] == 0.0 and got[12]["year_conflict"] and 0.9 < got[10]["score"] < 0.99
    assert got[20]["name_conflict"] and got[20]["score"] == 0.0 and got[20]["blocked"]
    assert got[30]["score"] == pytest.approx(0.92) and got[31]["type_conflict"] and got[31]["type_mismatch"] and got[31]["blocked"]
    made = {r["work_id"]: (r["catalogue_id"], r["decision"]) for r in evidence.decisions(scored, F.lit(False)).collect()}
    assert made[1][0] == 11 and made[2] == (20, "review") and made[3][0] == 30
