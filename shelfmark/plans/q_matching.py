"""Evidence, disambiguation, maintenance and file name queries."""

from pyspark.sql import functions as F

from ..functions.udfs import edit_similarity
from ..operators import coverage, extract, headings, matching, resolve, resources
from ..session import spread
from .bindings import Tables
from .q_resolve import _HALVES, _PAIRS, _rows
from .registry import query


@query("R-13", sql=f"""WITH {_HALVES}, {_PAIRS}, s AS (SELECT *, 1 - levenshtein(term_key, title_key) / greatest(length(term_key), length(title_key)) AS sim FROM p),
  b AS (SELECT term_key, term_year, title_key, year, greatest(0, least(0.99, sim * 0.72 + CASE WHEN term_year IS NULL THEN 0.05 WHEN year IS NULL THEN 0 WHEN term_year = year THEN 0.2 WHEN abs(term_year - year) > 1 THEN -0.08 ELSE 0.04 END)) AS v FROM s)
  SELECT term_key, term_year, title_key, year, round(v, 4) AS score FROM b WHERE v >= 0.45""")
def directory_scores(t: Tables):
    works, incoming = _rows(t)
    pairs = resolve.candidates(incoming, works)
    value = matching.simple_score(edit_similarity(F.col("term_key"), F.col("title_key")), F.col("term_year"), F.col("year"))
    return pairs.withColumn("v", value).filter(F.col("v") >= matching.SIMPLE_FLOOR).select("term_key", "term_year", "title_key", "year", F.round("v", 4).alias("score"))


@query("R-15", "W-09", sql="""WITH c AS (SELECT work_id, catalogue_id, least(score * 2, 0.99) AS score, CASE catalogue_id % 2 WHEN 0 THEN 'tv' ELSE 'movie' END AS media_type,
    CASE catalogue_id % 3 WHEN 0 THEN '远山' WHEN 1 THEN 'River' ELSE 'やま' END AS title, CASE WHEN catalogue_id % 13 = 0 THEN NULL ELSE 2000 + catalogue_id % 2 END AS year, exact, catalogue_id % 7 = 0 AS explicit,
    catalogue_id % 5 = 0 AS blocked, catalogue_id % 9 = 0 AS year_conflict, catalogue_id % 10 = 1 AS resource_conflict FROM candidate),
  u AS (SELECT * FROM c WHERE year IS NOT NULL AND NOT resource_conflict AND (NOT year_conflict OR explicit)),
  l AS (SELECT DISTINCT work_id, media_type, year FROM u WHERE title = '远山' AND exact AND score >= 0.88 AND NOT blocked)
  SELECT u.work_id, catalogue_id, score, title FROM u LEFT JOIN l USING (work_id, media_type, year) WHERE NOT (title = 'River' AND exact AND NOT explicit AND l.work_id IS NOT NULL)""")
def admissible_candidates(t: Tables):
    k = F.col("catalogue_id")
    c = t.candidate.withColumns({
        "score": F.least(F.col("score") * 2, F.lit(0.99)), "media_type": F.when(k % 2 == 0, "tv").otherwise("movie"),
        "title": F.when(k % 3 == 0, "远山").when(k % 3 == 1, "River").otherwise("やま"), "year": F.when(k % 13 != 0, 2000 + k % 2), "explicit": k % 7 == 0,
        "blocked": k % 5 == 0, "year_conflict": k % 9 == 0, "resource_conflict": k % 10 == 1,
    })
    return matching.admissible(c).select("work_id", "catalogue_id", "score", "title")


_RIVALS = """v AS (SELECT work_id, 1 AS season, 1 AS first, max(episode) AS last, COUNT(DISTINCT episode) AS episodes, min(episode) = 1 AND max(episode) = COUNT(DISTINCT episode) AS contiguous, min(episode) AS lo FROM resource WHERE episode IS NOT NULL GROUP BY 1),
  r AS (SELECT DISTINCT work_id, catalogue_id FROM candidate), n AS (SELECT p_partkey AS catalogue_id, 1 + p_partkey % 4 AS count FROM part),
  s AS (SELECT r.work_id, r.catalogue_id, CASE WHEN n.count IS NULL OR r.catalogue_id % 11 = 0 AND NOT v.last > n.count THEN 'unverified' WHEN v.last > n.count THEN 'conflict' WHEN contiguous AND lo = 1 AND episodes = n.count THEN 'exact' ELSE 'compatible' END AS status
    FROM r JOIN v USING (work_id) LEFT JOIN n USING (catalogue_id))"""


def _rivals(t: Tables):
    spans = t.resource.filter(F.col("episode").isNotNull()).select("work_id", F.lit(1).alias("season"), F.col("episode").alias("first"), F.col("episode").alias("last"))
    k = F.col("catalogue_id")
    seasons = t.part.select(F.col("p_partkey").alias("catalogue_id"), F.lit(1).alias("season"), (1 + F.col("p_partkey") % 4).alias("episode_count"))
    rivals = t.candidate.select("work_id", "catalogue_id").withColumns({"total_episodes": 1 + k % 4 + F.when(k % 11 == 0, 1).otherwise(0), "total_seasons": F.lit(1)})
    return matching.rival_status(coverage.coverage(spans, ["work_id", "season"]), rivals, seasons)


@query("R-17", sql=f"WITH {_RIVALS} SELECT * FROM s")
def rival_statuses(t: Tables):
    return _rivals(t)


@query("R-17", sql=f"""WITH {_RIVALS}, d AS (SELECT work_id, COUNT(*) BETWEEN 2 AND 12 AND COUNT(*) FILTER (WHERE status = 'exact') = 1 AND COUNT(*) FILTER (WHERE status = 'conflict') = COUNT(*) - 1 AS decided FROM s GROUP BY 1)
  SELECT work_id, catalogue_id, status, CAST(CASE WHEN decided AND status = 'conflict' THEN 0.79 ELSE 0.95 END AS DOUBLE) AS score, decided AND status = 'exact' AS season_match FROM s JOIN d USING (work_id)""")
def settled_rivals(t: Tables):
    return matching.disambiguated(_rivals(t).withColumn("score", F.lit(0.95)))


@query("R-20", sql="""WITH e AS (SELECT id AS message_id, 'k' || user_ AS title_key, y AS year, s AS season FROM (SELECT id, channel_id AS user_, CAST(2000 + id % 2 AS INT) AS y, CAST(1 AS INT) AS s FROM message WHERE status <> 'ignored')),
  x AS (SELECT l.source_key, e.title_key, e.year, e.season FROM link l JOIN e USING (message_id)), a AS (SELECT source_key, COUNT(*) AS n FROM x GROUP BY 1),
  w AS (SELECT work_id, bool_and(a.n IS NOT NULL) AS ok, COUNT(*) AS resources FROM resource r LEFT JOIN a USING (source_key) GROUP BY 1),
  d AS (SELECT r.work_id, min(x.title_key) AS title_key, min(x.year) AS year, min(x.season) AS season FROM resource r JOIN x USING (source_key) GROUP BY 1 HAVING COUNT(DISTINCT (x.title_key, x.year, x.season)) = 1)
  SELECT d.*, w.resources FROM d JOIN w USING (work_id) WHERE ok""")
def consistent_works(t: Tables):
    m = t.message.filter("status <> 'ignored'")  # a message that was ignored states nothing
    evidence = m.select(F.col("id").alias("message_id"), F.concat(F.lit("k"), "channel_id").alias("title_key"), (2000 + F.col("id") % 2).cast("int").alias("year"), F.lit(1).alias("season"))
    return matching.consistent_evidence(t.resource, t.link, evidence)


@query("R-23", sql="""WITH a AS (SELECT p_partkey AS id, p_size AS collection_id, replace(p_name, ' ', '') AS title_key, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 5 END AS year FROM part WHERE p_partkey % 2 = 1),
  b AS (SELECT p_partkey AS catalogue_id, p_size AS collection_id, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE replace(p_name, ' ', '') END AS part_key, p_partkey % 5 AS part_year FROM part WHERE p_partkey % 2 = 0)
  SELECT id, first(catalogue_id ORDER BY CASE WHEN year IS NULL OR year = part_year THEN 0 ELSE 1 END, catalogue_id) AS catalogue_id FROM a JOIN b USING (collection_id) WHERE contains(title_key, part_key) OR contains(part_key, title_key) GROUP BY 1""")
def collection_parts(t: Tables):
    k, joined = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit(""))
    asked = t.part.filter("p_partkey % 2 = 1").select(k.alias("id"), F.col("p_size").alias("collection_id"), joined.alias("title_key"), F.when(k % 4 != 0, k % 5).alias("year"))
    parts = t.part.filter("p_partkey % 2 = 0").select(
        k.alias("catalogue_id"), F.col("p_size").alias("collection_id"), F.when(k % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(joined).alias("part_key"), (k % 5).alias("part_year")
    )
    return matching.collection_part(asked, parts)


@query("J-13", sql="""WITH o AS (SELECT o_orderkey AS id, 'x' || o_custkey AS xid FROM orders), t AS (SELECT 'x' || (c_custkey % 1000) AS xid, c_custkey AS catalogue_id, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'x' || (c_custkey % 1000) END AS back FROM customer),
  s AS (SELECT xid, min(catalogue_id) AS catalogue_id, min(back) AS back FROM t GROUP BY 1 HAVING COUNT(DISTINCT catalogue_id) = 1) SELECT id, xid, catalogue_id FROM o JOIN s USING (xid) WHERE back = xid""")
def mutual_identities(t: Tables):
    x = lambda c: F.concat(F.lit("x"), c)
    k = F.col("c_custkey")
    theirs = t.customer.select(x(k % 1000).alias("xid"), k.alias("catalogue_id"), F.when(k % 4 == 0, "other").otherwise(x(k % 1000)).alias("back_xid"))
    return matching.mutual_matches(t.orders.select(F.col("o_orderkey").alias("id"), x(F.col("o_custkey")).alias("xid")), theirs)


@query("R-09", sql="""WITH g AS (SELECT work_id, COUNT(*) FILTER (WHERE availability = 'invalid' AND NOT contains(url, 'c7') AND tags IS DISTINCT FROM '["alpha","beta"]') AS removed, COUNT(*) AS n FROM resource GROUP BY 1)
  SELECT work_id, removed, CASE WHEN status = 'matched' OR catalogue_id IS NOT NULL THEN 'keep' WHEN removed = n THEN 'drop' ELSE 'reopen' END AS action FROM g JOIN work ON work.id = work_id WHERE removed > 0""")
def dead_resources(t: Tables):
    r = t.resource.withColumn("metadata", F.col("tags"))
    changed = F.when(F.col("tags") == '["alpha","beta"]', "[]").otherwise(F.col("tags"))
    probes = t.resource.select(
        "id", F.when(F.contains("url", F.lit("c7")), F.concat("url", F.lit("#old"))).otherwise(F.col("url")).alias("url"), changed.alias("metadata"),
        F.when(F.col("availability") == "invalid", "invalid").otherwise("available").alias("state"),
    )
    return matching.dead_resource_changes(r, t.work, probes)


@query("M-14", "F-22", sql="""WITH r AS (SELECT id, CASE WHEN quality IS NULL THEN 'invalid/' || id ELSE '115/' || regexp_extract(url, '/s/([^?]*)', 1) || '/' || regexp_extract(url, 'password=(.*)$', 1) END AS share, CAST(regexp_extract(url, 'password=p(.*)$', 1) AS BIGINT) % 6 AS k FROM resource)
  SELECT id, share, CASE WHEN share LIKE 'invalid%' OR k = 5 THEN 'unchecked' ELSE CASE k WHEN 0 THEN 'available' WHEN 1 THEN 'remove' WHEN 2 THEN 'protected' WHEN 3 THEN 'unknown' ELSE 'available' END END AS action FROM r""")
def checked_shares(t: Tables):
    r = t.resource.withColumn("url", F.when(F.col("quality").isNull(), "https://115.com/elsewhere").otherwise(F.col("url")))
    k = F.regexp_extract("share", "/p(.*)$", 1).try_cast("bigint") % 6
    codes = F.when(k == 1, 4100010).when(k == 2, 4100012).when(k == 3, 1)
    probes = matching.share_groups(r).select("share").distinct().filter(F.col("share").startswith("115/") & (k != 5)).select("share", codes.cast("long").alias("code"))
    return matching.checked_resources(r, probes)


@query("R-25", sql="""SELECT id, CASE WHEN id % 5 = 0 THEN 'Edited ' || id ELSE title END AS title, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 1900 ELSE year END AS year, coalesce(n, 0) AS candidates FROM work
  LEFT JOIN (SELECT work_id, COUNT(*) AS n FROM candidate WHERE catalogue_id % 3 <> 0 GROUP BY 1) c ON c.work_id = work.id""")
def edited_and_rejected(t: Tables):
    edits = t.work.filter("id % 5 = 0").select("id", F.concat(F.lit("Edited "), "id").alias("title"), F.when(F.col("id") % 2 == 0, 1900).alias("year"))
    left = matching.not_rejected(t.candidate, t.candidate.filter("catalogue_id % 3 = 0")).groupBy(F.col("work_id").alias("_work")).agg(F.count(F.lit(1)).alias("n"))
    works = matching.edited_works(t.work.select("id", "title", "year"), edits, ["title", "year"])
    return works.join(left, F.col("id") == F.col("_work"), "left").select("id", "title", "year", F.coalesce("n", F.lit(0)).alias("candidates"))


@query("ST-06", sql="SELECT id, status FROM message m WHERE status = 'ignored' OR EXISTS (SELECT 1 FROM link l WHERE l.message_id = m.id AND l.work_id IS NULL)")
def replayed_messages(t: Tables):
    return matching.replayable(t.message, t.link).select("id", "status")


@query("ST-06", sql="SELECT message_id, source_key, 'pending_validation' AS status, 0 AS attempts FROM link WHERE status IN ('invalid', 'error', 'pending_validation') AND message_id IN (SELECT id FROM message WHERE status = 'failed')")
def links_to_retry(t: Tables):
    return matching.reset_links(t.message, t.link)


@query("ST-09", sql="""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'invalid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'gate' WHEN 3 THEN 'gate' WHEN 4 THEN 'invalid' WHEN 5 THEN 'gate' WHEN 6 THEN 'transient' ELSE 'transient' END AS outcome FROM events""")
def link_outcomes(t: Tables):
    k = F.col("event_id") % 8
    code = F.when(k == 0, 4100010).when(k == 5, 4100010).when(k == 6, 990001)
    text = F.when(k == 1, "分享已取消").when(k == 2, "操作频繁，提取码").when(k == 3, "请验证").when(k == 4, "密码验证失败").when(k == 5, "captcha").when(k == 6, "busy")
    return t.events.select("event_id", matching.link_outcome(code, text).alias("outcome"))


@query("M-15", sql="""SELECT COUNT(*) AS posts, COUNT(*) FILTER (WHERE e) AS existing, COUNT(*) FILTER (WHERE NOT e AND d) AS direct, COUNT(*) FILTER (WHERE NOT e AND NOT d AND p) AS page_only, COUNT(*) FILTER (WHERE NOT e AND NOT d AND NOT p) AS empty
  FROM (SELECT contains(text, '115.com') AS d, id % 4 = 0 AS p, status = 'matched' AS e FROM post JOIN work USING (id))""")
def import_estimate(t: Tables):
    posts = t.post.join(t.work.select("id", "status"), "id")
    return matching.dry_run_estimate(posts, F.contains("text", F.lit("115.com")), F.col("id") % 4 == 0, F.col("status") == "matched")


@query("M-18", sql="SELECT id, CAST(2 + work_id % 5 AS INT) AS season_end FROM resource WHERE season_end IS NULL AND work_id % 5 > 0 AND work_id % 3 = 0")
def backfilled_seasons(t: Tables):
    heading = F.when(F.col("work_id") % 3 == 0, F.format_string("📺 Work S2-S%d 1080p", 2 + F.col("work_id") % 5)).otherwise("📺 Work S2")
    return matching.season_ranges(t.resource.withColumn("context", heading), "context")


@query("M-20", "F-03", sql="SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE '，。' END AS title, CASE WHEN id % 2 = 0 THEN lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) ELSE title_key END AS title_key FROM work WHERE resource_kind = 'person'")
def person_clean_up(t: Tables):
    dirty = F.when(F.col("id") % 2 == 0, F.concat(F.lit("👤 "), "title", F.lit("，\nrest"))).otherwise("，。")
    return matching.cleaned_persons(t.work.withColumn("title", dirty))


@query("M-21", "E-22", sql="""WITH r AS (SELECT work_id, CASE l_ WHEN 0 THEN 'person' WHEN 1 THEN 'series' ELSE 'media' END AS kind, l_ = 3 AS stray FROM (SELECT work_id, CAST(file_size / 1000 AS BIGINT) % 9 AS l_ FROM resource)),
  f AS (SELECT work_id, bool_or(kind = 'person') AS p, bool_or(kind = 'series') AS s, bool_or(stray) AS x FROM r GROUP BY 1)
  SELECT id, CASE WHEN p THEN 'person' WHEN s THEN 'series' ELSE 'media' END AS resource_kind FROM work JOIN f ON f.work_id = work.id WHERE (p OR s OR x) AND resource_kind <> CASE WHEN p THEN 'person' WHEN s THEN 'series' ELSE 'media' END""")
def kind_repairs(t: Tables):
    k = (F.col("file_size") / 1000).cast("bigint") % 9
    context = F.when(k == 0, "👤 Ann\nx").when(k == 1, "🗂 Set\nx").when(k == 2, "🗂 分类：x").when(k == 3, "📺 Work\n👤 by").otherwise("🎥 Work")
    kind = F.coalesce(resources.explicit_kind(F.lit(None).cast("string"), F.col("context")), F.lit("media"))
    rows = t.resource.withColumn("context", context).select("work_id", kind.alias("kind"), F.col("context").rlike("\n.*[👤🗂]").alias("stray"))
    return matching.repaired_kinds(t.work, rows)


@query("E-16", sql="""SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 1 + p_size % 9 END AS season, CASE WHEN p_partkey % 6 < 3 THEN 5 END AS first, CASE p_partkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 12 END AS last FROM part""")
def episode_spans(t: Tables):
    k, s = F.col("p_partkey") % 6, (1 + F.col("p_size") % 9).cast("string")
    head = F.concat(F.lit("dir/Some.Show.S0"), s)
    name = (
        F.when(k == 0, F.concat(head, F.lit("E05.1080p.mkv"))).when(k == 1, F.concat(head, F.lit("E05-E12.mkv"))).when(k == 2, F.concat(head, F.lit("E05-S0"), s, F.lit("E12 [x].mkv")))
        .when(k == 3, F.concat(head, F.lit("E05-E12-E20.mkv"))).when(k == 4, F.concat(head, F.lit("E12-E05.mkv"))).otherwise(F.lit("Some.Show.05.mkv"))
    )
    span = matching.episode_span(name)
    return t.part.select("p_partkey", span["season"].alias("season"), span["first"].alias("first"), span["last"].alias("last"))


@query("E-21", "W-10", sql="""SELECT p_partkey, CAST(unnest(CASE p_partkey % 3 WHEN 0 THEN [0, 2, 4] WHEN 1 THEN [0, 2, 4] ELSE [0, 1] END) AS INT) AS ord,
  unnest(CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand, p_name || '] ' || p_brand] WHEN 1 THEN ['远山', p_name, '远山 ' || p_name] ELSE [p_name, p_name || ' (Director''s Cut)'] END) AS variant FROM part""")
def title_variants(t: Tables):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    made = F.when(k == 0, F.concat(F.lit("["), n, F.lit("] "), "p_brand")).when(k == 1, F.concat(F.lit("远山  "), n)).otherwise(F.concat(n, F.lit(" (Director's Cut)")))
    return matching.title_variants(spread(t.part).withColumn("title", made), "p_partkey", "title")


@query("E-12", "E-18", "E-19", "E-20", "P-15", sql="""SELECT p_partkey, p_partkey % 2 = 0 AS marked, p_name AS stripped, CASE WHEN p_partkey % 3 = 0 THEN '远山' END AS base, CASE WHEN p_partkey % 3 = 0 THEN CAST(20 + p_size AS INT) END AS episode,
    p_name AS title, CASE p_partkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'artwork' WHEN 2 THEN 'extra' WHEN 3 THEN 'audio' WHEN 4 THEN 'none' ELSE 'sidecar' END AS role,
    CASE p_partkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'invalid' WHEN 2 THEN 'pending' ELSE 'unknown' END AS availability FROM part""")
def name_parts(t: Tables):
    k, n = F.col("p_partkey"), F.col("p_name")
    named = F.when(k % 2 == 0, F.concat(n, F.lit("（系列）"))).otherwise(n)
    suffix = headings.split_episode_suffix(F.when(k % 3 == 0, F.concat(F.lit("远山"), (20 + F.col("p_size")).cast("string"))).when(k % 3 == 1, F.concat(n, F.lit("172"))).otherwise("远山 更新至20"))
    file = F.when(k % 6 == 0, F.concat(n, F.lit(".mkv"))).when(k % 6 == 1, "season01-poster.jpg").when(k % 6 == 2, F.concat(n, F.lit(".trailer.mp4"))).when(k % 6 == 3, "theme.mp3").when(k % 6 == 5, F.concat(n, F.lit(".nfo")))
    status, code = F.when(k % 4 == 0, "ok").when(k % 4 == 2, "error"), F.when(k % 4 == 1, 4100010)
    return t.part.select(
        "p_partkey", headings.has_collection_marker(named).alias("marked"), headings.strip_collection_marker(named).alias("stripped"), suffix["base"].alias("base"), suffix["episode"].alias("episode"),
        headings.drop_release_group(F.concat(F.lit("[ADWeb] ["), n, F.lit("] rest"))).alias("title"), resources.file_role(file).alias("role"), resources.availability_from_snapshot(status, code).alias("availability"),
    )


@query("J-15", "E-13", sql="""SELECT id, CASE WHEN channel_username = 'chan_2' THEN 'movies' WHEN channel_name = 'Channel 7' THEN 'shows' WHEN id % 5 = 0 THEN 'clips' END AS rule,
  CASE WHEN id % 2 = 0 THEN '👤 Ann Lee' || chr(10) || '🎂 生日：1 May' END AS context FROM message""")
def channel_rules(t: Tables):
    rules_ = t.spark.createDataFrame([("@Chan_2", "movies"), ("channel 7", "shows"), ("clips", "clips")], "identity string, rule string")
    posts = t.message.withColumn("message_url", F.when(F.col("id") % 5 == 0, "https://example.com/clips/7").otherwise("https://example.com/x/1"))
    text = F.when(F.col("id") % 2 == 0, "head\n👤 Ann Lee， 🎂 生日：1 May\n🏠 出生地：").otherwise("📺 Work")
    return extract.channel_specific(posts, rules_).select("id", "rule", extract.person_context(text).alias("context"))
