"""Work grows with the rows, not with the pairs of rows that share a key; and cases that the given tables do not hold."""

import __spark_entry__ as entry
from growth import most_rows
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.functions import urls
from shelfmark.functions.text import settled, title_key, title_keys
from shelfmark.operators import evidence, extract, fallbacks, headings, identify, maintenance, matching, search

ASKED = "id long, collection_id long, title_key string, year int"
PARTS = "collection_id long, catalogue_id long, part_key string, part_year int"


def test_many_parts_of_a_collection_meet_by_title(spark):
    asked = spark.range(3000).select("id", F.lit(1).cast("long").alias("collection_id"), F.lit("redring").alias("title_key"), (F.col("id") % 3).cast("int").alias("year"))
    parts = spark.range(3000).select(F.lit(1).cast("long").alias("collection_id"), F.col("id").alias("catalogue_id"), F.when(F.col("id") % 2 == 0, "red").otherwise("theredring").alias("part_key"), (F.col("id") % 2).cast("int").alias("part_year"))
    found = matching.collection_part(asked, parts)
    assert most_rows(found) <= 10_000
    assert {(r["id"] % 3, r["catalogue_id"]) for r in found.collect()} == {(0, 0), (1, 1), (2, 0)} and found.count() == 3000


def test_the_part_of_each_title_is_that_of_all_pairs(spark):
    asked = [(1, 1, "ab", 1), (2, 1, "abc", None), (3, 1, "", 1), (4, 2, "abc", 3), (5, 2, "zabcd", 2), (6, 3, "q", 1), (7, None, "ab", 1), (8, 2, "é远山b", 1), (8, 2, "山", 9), (9, 2, None, 1)]
    parts = [(1, 10, "b", 2), (1, 11, "abcd", 1), (1, 12, "", 1), (1, 13, None, 1), (1, 9, "x", 1), (2, 20, "abc", None), (2, 21, "bc", 3), (2, 22, "abcd", 2), (2, 23, "远山", 1), (None, 24, "ab", 1), (2, 25, "山", 1)]
    expected = {}
    for k, c, title, year in asked:
        for pc, part, key, part_year in parts:
            if c is not None and c == pc and title and key and (title in key or key in title):
                expected[k] = min(expected.get(k, (2, 0)), (0 if year is None or year == part_year else 1, part))
    got = {r["id"]: r["catalogue_id"] for r in matching.collection_part(spark.createDataFrame(asked, ASKED), spark.createDataFrame(parts, PARTS)).collect()}
    assert got == {k: v[1] for k, v in expected.items()} and len(got) == 5


def _second(spark, works, entries):
    w = spark.createDataFrame(works, "work_id long, years array<int>, names array<string>, collection boolean, episodic boolean")
    mapping = spark.createDataFrame([("x1", "tv", 7), ("x2", "movie", 8)], "xid string, media_type string, catalogue_id long")
    catalogue = spark.createDataFrame([(7, "tv", "x1", 2000), (8, "movie", "x2", 2001)], "catalogue_id long, media_type string, xid string, year int")
    return fallbacks.second_catalogue(w, spark.createDataFrame([], "work_id long"), entries, mapping, catalogue)


def test_many_entries_of_a_name_and_year_are_one_row(spark):
    entries = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("xid"), F.lit("n").alias("name_key"), F.lit(2000).alias("year"), F.lit("tv").alias("media_type"))
    made = _second(spark, [(k, [2000], ["n", "m"], False, k % 2 == 0) for k in range(2000)], entries)
    assert most_rows(made) <= 10_000
    assert {r["status"] for r in made.collect()} == {"ambiguous_second"}


def test_entries_of_several_names_and_types_count_together(spark):
    entries = spark.createDataFrame(
        [("x1", "a", 2000, "tv"), ("x1", "b", 2000, "tv"), ("x2", "c", 2000, "movie"), ("x1", "c", 2000, "tv"), ("x2", "d", 2000, "movie"), (None, "e", 2000, "tv")], "xid string, name_key string, year int, media_type string"
    )
    works = [(1, [2000], ["a", "b"], False, False), (2, [2000], ["a", "d"], False, False), (3, [2000], ["a", "d"], False, True), (4, [2000], ["c"], False, True), (5, [2000], ["d"], False, True), (6, [2000], ["e"], False, False), (7, [2000], ["d"], False, False)]
    got = {r["work_id"]: (r["status"], r["xid"]) for r in _second(spark, works, entries).collect()}
    assert got == {
        1: ("located", "x1"), 2: ("ambiguous_second", None), 3: ("located", "x1"), 4: ("located", "x1"), 5: ("no_exact_match", None), 6: ("no_mapping", None), 7: ("located_second_year", "x2"),
    }


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_noise_of_a_small_table_is_taken_away_by_several_tasks(spark):
    assert entry.queries()["search_bases"](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1


def test_rounds_end_when_nothing_changes(spark):
    texts = spark.createDataFrame([("xxab", 5), ("xxab", 1), ("ab", 3), (None, 2), ("xxx", 9)], "t string, n int")
    made = texts.select(settled(F.col("t"), lambda t: F.regexp_replace(t, "^x", ""), F.col("n")).alias("t"))
    assert [r["t"] for r in made.collect()] == ["ab", "xab", "ab", None, ""]


def test_a_link_is_taken_apart_few_times(spark):
    links = ["https://115.com/s/abc?password=x", "https://115.com/elsewhere", None, "https://115.com//s//a?b=1&pwd=&password=y#z?pwd=q", "https://115.com/s/a b?password=x", "https://115.com/s/ab?xpassword=n&pwd=m", "https://www.123pan.com/s/k.html?pwd=1"]
    rows = spark.createDataFrame(list(enumerate(links, 1)), "id long, url string")
    shares = matching.share_groups(rows)
    assert _plan(shares).count("parse_url") <= 2
    assert [r["share"] for r in shares.orderBy("id").collect()] == ["115/abc/x", "invalid/2", "invalid/3", "115/a/y", "invalid/5", "115/ab/m", "123/k/1"]


def test_titles_of_works_are_classed_once_a_work(spark):
    r = spark.createDataFrame([(1, 1, "other", None, "a", None), (2, 1, "other", "series", "a", None), (3, 2, "other", None, "a", None), (4, 3, "media", "person", "a", None)], "id long, work_id long, resource_class string, kind string, raw_label string, filename string")
    w = spark.createDataFrame([(1, "x 演唱会", "movie", "media", False), (2, "x 合集", "tv", "media", False), (3, "x 演唱会", "tv", "media", False)], "id long, title string, media_type string, resource_kind string, is_bundle boolean")
    made = maintenance.collection_classes(r, w)
    assert rules.COLLECTION in _plan(made).split("Join", 1)[1]
    assert {c["id"]: c["resource_class"] for c in made.collect()} == {1: "music", 2: "collection", 3: "collection"}


def test_every_collection_marker_has_the_sign_looked_for_first(spark):
    texts = ["（系列", "[collection]", "全系列", "等等电影", "远套装", "x合集", "全三部", "三部曲", "x系列", "1-3部", "2001二部", "x 三部", "a BOX set", "BoxSet", "远 合輯", "plain", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", headings.has_collection_marker(F.col("t")).alias("m"), F.coalesce("t", F.lit("")).rlike(rules.COLLECTION).alias("plain"))
    assert all(r["m"] == r["plain"] for r in rows.collect()) and sum(r["m"] for r in rows.collect()) >= 12


def test_only_messages_of_works_in_review_are_read(spark):
    messages = spark.range(5000).select("id", F.concat(F.lit("名称：Work"), "id", F.lit("\n年份：2000")).alias("text"))
    works = messages.select("id", F.concat(F.lit("work"), "id").alias("title_key"), F.when(F.col("id") < 3, "review").otherwise("pending").alias("status"), F.lit("tv").alias("media_type"))
    resources = messages.select(F.col("id").alias("work_id"), F.col("id").cast("string").alias("source_key"))
    links = messages.select(F.col("id").alias("message_id"), F.col("id").cast("string").alias("source_key"))
    titles = messages.select(F.col("id").alias("work_id"), F.col("id").alias("catalogue_id"), F.concat(F.lit("Work"), "id").alias("title"), F.concat(F.lit("work"), "id").alias("title_key"), F.lit(2000).alias("year"), F.lit("tv").alias("media_type"), F.lit(0.5).alias("score"))
    made = evidence.confirmed(works, resources, links, messages, titles)
    assert most_rows(made, "pythonNumRowsReceived") <= 100
    assert sorted(r["work_id"] for r in made.collect()) == [0, 1, 2]


def test_headings_of_a_small_table_are_parsed_by_several_tasks(spark):
    assert entry.queries()["parsed_headings"](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() > 1


def test_titles_end_where_a_collection_marker_does_or_does_not_begin(spark):
    rows = spark.createDataFrame([("远山 合集 2001",), ("远山 全三部 4K",), ("Box (2001) 1080p",), ("Plain 2160p",), ("Work BOX SET 2001",)], "h string")
    assert [r["t"] for r in rows.select(headings.heading_title(F.col("h"), F.lit("media")).alias("t")).collect()] == ["远山", "远山", "Box", "Plain", "Work"]


def test_flags_meet_by_work_and_are_made_once(spark):
    c, w, t, r = (
        spark.createDataFrame([], s) for s in (
            "work_id long, catalogue_id long, media_type string, titles array<string>, latin_original boolean, year int, explicit boolean, derived boolean, verified boolean, popularity double",
            "work_id long, title string, media_type string, episodic boolean, years array<int>, structured_type boolean, resource_kind string, resource_mixed boolean",
            "work_id long, title string", "work_id long, resource long, title string",
        )
    )
    assert _plan(evidence.evidence_flags(c, w, t, r)).count("LogicalRDD") <= 4  # each table is read once
    assert _plan(evidence.scored_candidates(c, w, t, r)).count("LogicalRDD") <= 4
    assert _plan(evidence.decisions(evidence.scored_candidates(c, w, t, r), F.lit(False))).count("LogicalRDD") <= 4


def test_keys_of_lists_are_those_of_each_title(spark):
    lists = [["Ａb c", "Σάς", None, "x"], ["é", "é", "－"], [], None, ["a\0b", "ab"], ["ǅ 1", "ß"], [None]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, l array<string>")
    each = rows.select("id", F.explode("l").alias("t")).select("id", title_key(F.col("t")).alias("k")).filter("k <> ''").groupBy("id").agg(F.collect_set("k").alias("k"))
    want = {r["id"]: set(r["k"]) for r in each.collect()}
    got = {r["id"]: r["k"] for r in rows.select("id", title_keys(F.col("l")).alias("k")).collect()}
    assert all(set(got[i] or []) == want.get(i, set()) and len(got[i] or []) == len(want.get(i, ())) for i in got)


def test_rivals_and_seasons_are_read_once(spark):
    coverage = spark.createDataFrame([(1, 1, 1, 2, 2, True), (2, 1, 1, 3, 3, True), (2, 2, 1, 1, 1, True)], "work_id long, season int, first int, last int, episodes int, contiguous boolean")
    rivals = spark.createDataFrame([(1, 7, 2, 1), (1, 8, 1, 1), (1, 9, 1, 1), (2, 7, 2, 1), (2, 6, 4, 2), (1, 7, 2, 1), (3, 7, 2, 1)], "work_id long, catalogue_id long, total_episodes int, total_seasons int")
    seasons = spark.createDataFrame([(7, 1, 2), (8, 1, 1), (6, 1, 3), (6, 2, 1)], "catalogue_id long, season int, episode_count int")
    status = matching.rival_status(coverage, rivals, seasons)
    assert _plan(status).count("LogicalRDD") == 3
    assert {(r[0], r[1]): r[2] for r in status.collect()} == {(1, 7): "exact", (1, 8): "conflict", (1, 9): "unverified", (2, 7): "unverified", (2, 6): "exact"} and status.count() == 5


def test_rivals_are_counted_in_place(spark):
    rivals = spark.createDataFrame([(1, 7, 0.9, "exact"), (1, 8, 0.9, "conflict"), (2, 7, 0.9, "exact"), (None, 7, 0.9, "exact")], "work_id long, catalogue_id long, score double, status string")
    made = matching.disambiguated(rivals)
    assert _plan(made).count("LogicalRDD") == 1
    assert {(r["work_id"], r["catalogue_id"]): (r["score"], r["season_match"]) for r in made.collect()} == {(1, 7): (0.9, True), (1, 8): (0.79, False), (2, 7): (0.9, False)}


def test_type_evidence_makes_no_rows_of_reasons_and_changes_read_it_once(spark):
    works = spark.createDataFrame([(1, "t", "tv", "pending", "media", False, False), (2, "u", "movie", "pending", "media", False, False)], "id long, title string, media_type string, status string, resource_kind string, is_bundle boolean, is_metadata boolean")
    resources = spark.createDataFrame([(5, 1, 1, None, None, "a 电影\nx", "b", None), (6, 1, None, None, None, None, "剧场版", None), (7, 2, None, None, None, "x ep 3", "全 12 集", "第三季")], "id long, work_id long, season int, season_end int, episode int, context string, raw_label string, filename string")
    told = maintenance.type_evidence(works, resources)
    assert "Generate" not in _plan(told)
    assert {r["id"]: (r["type"], r["reasons"]) for r in told.collect()} == {1: ("movie", ["movie_text:剧场版", "movie_text:电影"]), 2: ("tv", ["tv_text:ep 3", "tv_text:全 12 集", "tv_text:第三季"])}
    made = maintenance.strong_type_changes(told, resources)
    assert _plan(made["works"]).count("LogicalRDD") == 0 and _plan(made["resources"]).count("LogicalRDD") == 1
    assert [(r["id"], r["work_id"]) for r in made["resources"].collect()] == [(5, 1)]


def test_strong_texts_have_the_sign_looked_for_first(spark):
    texts = ["s01 e02", "S1E1", "ep3", "EP 12", "更新至12", "更 3", "第3集", "第 十 话", "全集", "全12季", "共 3季", "剧集", "电视剧", "连续剧", "综艺", "动漫", "番剧", "plain", "Part 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(rules.STRONG_TV_TEXT).alias("a"), F.col("t").rlike(rules.STRONG_TV_SIGN).alias("b")).collect()
    assert all(r["b"] for r in rows if r["a"]) and sum(r["a"] for r in rows) == len(texts) - 2


def test_titles_of_a_small_table_are_varied_by_several_tasks(spark):
    assert "Repartition" in _plan(entry.queries()["title_variants"](spark, "/root/testdata/sf0.01"))


def test_payloads_of_a_small_table_are_read_by_several_tasks(spark):
    made = entry.queries()["normalised_catalogue"](spark, "/root/testdata/sf0.01")
    assert len(made.inputFiles()) > 1


def test_hits_are_shuffled_as_one_list(spark):
    files = spark.createDataFrame([(1, 1, "D", 2000, "tv", None), (2, 2, "D", 2000, "tv", None), (3, 3, "E", 2000, "tv", None), (4, 4, None, None, "movie", None)], "id long, ord long, directory string, year int, media_type string, explicit_id long")
    hits = spark.createDataFrame([(1, 9, 0.95, False), (1, 8, 0.95, True), (1, 7, 0.5, True), (2, 5, 0.99, True), (3, 6, 0.95, True), (3, 4, 0.95, True), (4, 3, None, False)], "id long, catalogue_id long, confidence double, exact boolean")
    made = identify.cascade(files, spark.createDataFrame([], "id long, catalogue_id long"), hits, 0.9, 0.0)
    assert _plan(made).count("max_by(") <= 1  # that of what a block hands on
    assert {r["id"]: (r["catalogue_id"], r["tier"], r["status"]) for r in made.collect()} == {1: (8, "variants", "matched"), 2: (8, "series_batch_identity", "matched"), 3: (4, "variants", "matched"), 4: (3, "variants", "review")}


def test_resources_of_messages_are_shuffled_by_their_key_alone(spark):
    assert "explode(_rows" in _plan(entry.queries()["message_works"](spark, "/root/testdata/sf0.001"))


def test_links_of_a_message_are_made_once(spark):
    shared = "https://115.com/s/a?password=ab12"
    texts = [f"📺 T (2001)\n🌟 7\n{shared}\n提取码：x123", f"plain\n\nOwn label {shared} tail", f"a\n🎥 H\r\nb {shared}\r{shared}", f"{shared}\n📺 late", f"📺 T\ned2k://|file|f.mkv|7|{'a' * 32}|/ ed2k://|file|g.mkv|8|{'b' * 32}|/", "none", None, f"x\u2028{shared} y\u0085z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = extract.link_lines(rows)
    assert _plan(made).count("regexp_extract_all(") == 1
    got = sorted((r["id"], r["line_no"], r["pos"], r["label"], r["context"], r["suffix"], r["next_line"]) for r in made.collect())
    assert got == [
        (0, 2, 0, "", "📺 T (2001)\n🌟 7", "", "提取码：x123"), (1, 2, 0, "Own label", None, "tail", None), (2, 2, 0, "b", None, "", shared), (2, 3, 0, "", f"🎥 H\nb {shared}", "", None),
        (3, 0, 0, "", None, "", "📺 late"), (4, 1, 0, "", "📺 T", "", None), (4, 1, 1, "", "📺 T", "", None), (7, 0, 0, "", None, "", None),
    ]
    assert extract.extract_links(rows, columns=("label", "line_no")).columns == ["id", "source_key", "label", "line_no"]


def test_providers_are_those_of_parsed_hosts(spark):
    links = [
        "https://115.com/s/a?password=x#", "http://WWW.115cdn.com", "https://www.123865.com/s/k?pwd=1#a?b", "https://115.com:80/s/a", "https://115.com@x.org/s/a", "https://115.com/s/a b", "https://115.com/s/a#b#c", "https://115.com/s/%zz",
        "https://115.com.org/s/a", "https://x115.com/s/a", "ED2K://|file|", "https://guangyapan.com/s/远", "https://123pan.com?x", "//115.com/s/a", "", None, "https://115.com/s/a\n", "https://115.com/s/{a}",
    ]
    names = F.create_map(*[F.lit(x) for pair in rules.HOST_PROVIDERS.items() for x in pair])
    parsed = F.when(F.lower("u").startswith("ed2k://"), "ed2k").otherwise(F.try_element_at(names, F.coalesce(urls.host(F.col("u")), F.lit(""))))
    rows = spark.createDataFrame([(u,) for u in links], "u string").select("u", urls.provider_of(F.col("u")).alias("p"), parsed.alias("want")).collect()
    assert all(r["p"] == r["want"] for r in rows), [r for r in rows if r["p"] != r["want"]]
    assert sum(r["p"] is not None for r in rows) >= 7


def test_postings_are_lists_and_only_found_texts_are_verified(spark):
    texts = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "Red ring").otherwise("blue").alias("text")).coalesce(2)
    stored = search.store_postings(texts, "id", buckets=3)
    assert spark.read.parquet(stored.path).count() <= 100  # not one row for each gram of each text
    found = stored.search(texts, ["rED", "ring"])
    assert not [line for line in _plan(found).split("\n") if "Filter" in line and "translate(" in line]
    assert found.columns == texts.columns and found.count() == 1500 and stored.search(texts, ["blue", "red"]).count() == 0


def test_grams_are_those_of_each_text(spark, monkeypatch):
    texts = ["", "ab", "aBc", "ABCabc", "\0\0\0a", "a😀b😀b", "éÉé", "İiI", "中文字中文字", None, "x\n\t y", "\uffffab"]
    low = [None if t is None else search.ascii_lowered(t) for t in texts]
    want = sorted({(t[i : i + 3], k) for k, t in enumerate(low) if t is not None for i in range(len(t) - 2)})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(map(tuple, search.postings(rows, "id").collect())) == want
    import pyarrow as pa

    monkeypatch.setattr(search, "LISTED", 3)  # many small blocks give the same
    blocks = search._gram_lists(iter([pa.RecordBatch.from_arrays([pa.array([k for k, t in enumerate(texts) if t is not None]), pa.array([t.encode() for t in texts if t is not None])], ["id", "_text"])]))
    lists = [(g, k) for b in blocks for g, keys in zip(*b.to_pydict().values()) for k in keys]
    assert sorted(lists) == want
