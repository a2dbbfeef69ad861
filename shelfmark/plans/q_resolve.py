"""Resolution, matching and maintenance queries."""

from pyspark.sql import functions as F

from ..functions.udfs import edit_similarity
from ..operators import resolve, retry
from .bindings import Tables
from .registry import query

# Catalogue rows in two halves: even keys are stored, odd ones come in.
_ROW = """SELECT p_partkey AS id, p_name AS title, replace(p_name, ' ', '') AS title_key, CASE WHEN p_partkey % 7 < 2 THEN NULL ELSE CAST(1990 + p_size % 12 AS INT) END AS year,
  CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'SMALL' THEN 'tv' ELSE 'unknown' END AS media_type, CASE p_partkey % 23 WHEN 0 THEN 'person' WHEN 1 THEN 'person' WHEN 2 THEN 'series' ELSE 'media' END AS resource_kind,
  p_partkey % 11 = 0 AS is_bundle, p_retailprice AS popularity FROM part"""
_HALVES = f"a AS ({_ROW}), w AS (SELECT * FROM a WHERE id % 2 = 0), i AS (SELECT * FROM a WHERE id % 2 = 1)"


def _rows(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(
        k.alias("id"), F.col("p_name").alias("title"), F.replace("p_name", F.lit(" "), F.lit("")).alias("title_key"),
        F.when(k % 7 >= 2, (1990 + F.col("p_size") % 12).cast("int")).alias("year"),
        F.when(F.col("p_type") == "ECONOMY", "movie").when(F.col("p_type") == "SMALL", "tv").otherwise("unknown").alias("media_type"),
        F.when((k % 23).isin(0, 1), "person").when(k % 23 == 2, "series").otherwise("media").alias("resource_kind"),
        (k % 11 == 0).alias("is_bundle"), F.col("p_retailprice").alias("popularity"),
    )
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


_FITS = """f AS (SELECT i.id, i.resource_kind AS ik, i.media_type AS it, w.id AS wid, w.media_type AS wt, w.resource_kind IN ('person', 'series') AS special, CASE WHEN i.year IS NULL THEN false ELSE w.year IS NULL END AS undated
    FROM i JOIN w ON w.title_key = i.title_key AND (i.resource_kind = 'person' OR i.year IS NULL OR w.year IS NULL OR w.year = i.year)),
  r AS (SELECT id, CASE WHEN ik = 'person' THEN first(wid ORDER BY NOT special, wid) ELSE coalesce(first(wid ORDER BY undated, wid) FILTER (WHERE wt = it),
    first(wid ORDER BY undated, wid) FILTER (WHERE wt = 'unknown' AND it <> 'unknown'), CASE WHEN it = 'unknown' AND COUNT(*) = 1 THEN min(wid) END) END AS work_id FROM f GROUP BY id, ik, it)"""


@query("R-02", sql=f"WITH {_HALVES}, {_FITS} SELECT i.id, r.work_id FROM i LEFT JOIN r USING (id)")
def compatible_works(t: Tables):
    works, incoming = _rows(t)
    return resolve.compatible_works(incoming, works).select("id", "work_id")


@query("R-03", sql=f"""WITH {_HALVES}, {_FITS}, g AS (SELECT r.work_id, first(media_type ORDER BY i.id) FILTER (WHERE media_type <> 'unknown') AS t, first(year ORDER BY i.id) FILTER (WHERE year IS NOT NULL) AS y,
    first(resource_kind ORDER BY i.id) FILTER (WHERE resource_kind <> 'media') AS k, bool_or(is_bundle) AS b FROM i JOIN r USING (id) WHERE r.work_id IS NOT NULL GROUP BY 1)
  SELECT id, CASE WHEN media_type = 'unknown' THEN coalesce(t, media_type) ELSE media_type END AS media_type,
    CASE WHEN CASE WHEN resource_kind = 'media' THEN coalesce(k, resource_kind) ELSE resource_kind END = 'person' THEN NULL ELSE coalesce(year, y) END AS year,
    CASE WHEN resource_kind = 'media' THEN coalesce(k, resource_kind) ELSE resource_kind END AS resource_kind, is_bundle OR b AS is_bundle FROM w JOIN g ON g.work_id = w.id""")
def work_changes(t: Tables):
    works, incoming = _rows(t)
    return resolve.work_changes(resolve.compatible_works(incoming, works), works)


@query("R-03", sql=f"""WITH {_HALVES}, {_FITS} SELECT title_key, CASE WHEN resource_kind = 'person' THEN NULL ELSE year END AS year, media_type, min(i.id) AS first_id, COUNT(*) AS resources, bool_or(is_bundle) AS is_bundle
  FROM i LEFT JOIN r USING (id) WHERE r.work_id IS NULL GROUP BY 1, 2, 3""")
def new_works(t: Tables):
    works, incoming = _rows(t)
    return resolve.new_works(resolve.compatible_works(incoming, works))


@query("R-01", sql="""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substr(c_mktsegment, 1, 4) || '-' || (1000 + c_custkey % 900) ELSE c_name END AS title,
  CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'tv' END AS media_type, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS collection_id FROM customer""")
def coded_titles(t: Tables):
    code = F.concat(F.lit("[x] "), F.lower(F.substring("c_mktsegment", 1, 4)), F.lit("-"), (1000 + F.col("c_custkey") % 900).cast("string"), F.lit(" rest"))
    rows = t.customer.select(
        "c_custkey", F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, code).otherwise(F.lit("plain")).alias("raw_label"),
        F.lit("tv").alias("media_type"), F.col("c_nationkey").cast("bigint").alias("collection_id"),
    )
    return resolve.coded_titles(rows, "raw_label", "title").drop("raw_label")


@query("R-05", sql="""WITH c AS (SELECT replace(p_name, ' ', '') AS title_key, min(p_partkey) AS collection_id FROM part WHERE p_size > 25 GROUP BY 1)
  SELECT w.title_key, collection_id, w.members FROM (SELECT replace(p_name, ' ', '') AS title_key, COUNT(*) AS members FROM part WHERE p_size <= 25 GROUP BY 1) w LEFT JOIN c USING (title_key)""")
def attached_collections(t: Tables):
    titled = t.part.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("title_key"), "p_size")
    return resolve.attach_collections(titled.filter("p_size <= 25"), titled.filter("p_size > 25"))


@query("R-06", sql="""SELECT w.id, n AS resources FROM work w JOIN (SELECT work_id, COUNT(*) AS n, bool_and(resource_class IN ('collection', 'media', 'other')) AS all_, bool_or(contains(raw_label, 'N')) AS word FROM resource GROUP BY 1) r ON r.work_id = w.id
  WHERE status <> 'matched' AND all_ AND word AND (is_bundle OR n >= 2)""")
def containers(t: Tables):
    r = t.resource.withColumn("resource_class", F.when(F.col("resource_class").isin("collection", "media", "other"), "collection").otherwise(F.col("resource_class")))
    return resolve.containers(t.work, r, F.contains("raw_label", F.lit("N")))


_MERGE = """g AS (SELECT catalogue_type, catalogue_id, min(id) AS kept_id, arg_min(coalesce(collection_id, -1), id) AS own, first(collection_id ORDER BY id) FILTER (WHERE collection_id IS NOT NULL) AS other
    FROM work WHERE catalogue_type IS NOT NULL AND catalogue_id IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1),
  m AS (SELECT w.id, kept_id, coalesce(nullif(own, -1), other) AS collection_id FROM work w JOIN g USING (catalogue_type, catalogue_id))"""


@query("R-07", sql=f"WITH {_MERGE} SELECT * FROM m")
def merged_works(t: Tables):
    return resolve.merge_map(t.work, "catalogue_type", "catalogue_id")


@query("R-07", sql=f"WITH {_MERGE} SELECT coalesce(kept_id, work_id) AS work_id, COUNT(*) AS resources, CAST(SUM(file_size) AS BIGINT) AS bytes FROM resource r LEFT JOIN m ON m.id = r.work_id GROUP BY 1")
def repointed_resources(t: Tables):
    moved = resolve.repointed(t.resource, resolve.merge_map(t.work, "catalogue_type", "catalogue_id"))
    return moved.groupBy("work_id").agg(F.count(F.lit(1)).alias("resources"), F.sum("file_size").alias("bytes"))


@query("R-08", sql="SELECT id, status FROM work w WHERE status <> 'matched' AND NOT EXISTS (SELECT 1 FROM resource r WHERE r.work_id = w.id)")
def orphaned_works(t: Tables):
    return resolve.orphans(t.work, t.resource).select("id", "status")


_PAIRS = """tc AS (SELECT DISTINCT title AS term_key, year AS term_year FROM i), cc AS (SELECT DISTINCT title AS title_key, year FROM w),
  p AS (SELECT *, CAST(len(list_intersect(string_split(term_key, ' '), string_split(title_key, ' '))) AS BIGINT) AS shared, term_key = title_key AS exact FROM tc JOIN cc ON (term_year IS NULL OR year = term_year)
    AND list_has_any(string_split(term_key, ' '), string_split(title_key, ' ')))"""


@query("R-11", sql=f"WITH {_HALVES}, {_PAIRS} SELECT * FROM p")
def candidate_pairs(t: Tables):
    works, incoming = _rows(t)
    return resolve.candidates(incoming, works)


@query("R-12", "F-19", sql=f"""WITH {_HALVES}, {_PAIRS}, s AS (SELECT *, 1 - levenshtein(term_key, title_key) / greatest(length(term_key), length(title_key)) AS sim FROM p),
  b AS (SELECT *, CASE WHEN exact THEN greatest(sim * 0.78 + 0.04, 0.88) ELSE sim * 0.78 + CASE WHEN sim >= 0.82 THEN 0.04 ELSE 0 END END AS base FROM s)
  SELECT term_key, term_year, title_key, year, CASE WHEN year IS NULL THEN 0.0 ELSE round(least(base + CASE WHEN term_year IS NOT NULL THEN 0.14 ELSE 0 END
    + CASE WHEN length(title_key) % 2 = 0 THEN 0.04 ELSE -0.08 END + least(ln(1 + shared) / 100, 0.025), 0.99), 4) END AS score FROM b""")
def candidate_scores(t: Tables):
    works, incoming = _rows(t)
    pairs = resolve.candidates(incoming, works)
    no = F.lit(False)
    kind = F.when(F.length("title_key") % 2 == 0, "tv").otherwise("movie")
    points = resolve.score(
        edit_similarity(F.col("term_key"), F.col("title_key")), F.col("exact"), no, no, F.col("term_year"), F.col("year"), F.lit("tv"), kind, F.col("shared"),
    )
    return pairs.select("term_key", "term_year", "title_key", "year", points.alias("score"))


@query("R-16", "W-04", sql="""WITH c AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, catalogue_id) AS k, COUNT(*) OVER (PARTITION BY work_id) AS n FROM (SELECT work_id, catalogue_id, least(score * 2, 0.99) AS score, exact, year_missing FROM candidate)),
  s AS (SELECT work_id, max(score) FILTER (WHERE k = 1) AS leader, coalesce(max(score) FILTER (WHERE k = 2), 0) AS second, max(catalogue_id) FILTER (WHERE k = 1) AS catalogue_id, bool_or(exact) FILTER (WHERE k = 1) AS exact, bool_or(year_missing) FILTER (WHERE k = 1) AS ym, max(n) AS n FROM c WHERE k <= 2 GROUP BY 1)
  SELECT work_id, catalogue_id, leader, round(leader - second, 4) AS gap, CASE WHEN catalogue_id % 5 = 0 THEN 'review' WHEN catalogue_id % 7 = 0 OR (leader >= 0.9 AND round(leader - second, 4) >= 0.08)
    OR (leader >= 0.88 AND round(leader - second, 4) >= 0.12 AND ym AND catalogue_id % 2 = 0) OR (n = 1 AND leader >= 0.88 AND round(leader - second, 4) >= 0.12 AND ym AND exact AND catalogue_id % 3 <> 0) THEN 'link' ELSE 'review' END AS decision FROM s""")
def auto_link(t: Tables):
    k = F.col("catalogue_id")
    # one row for each catalogue entry and score, as a matcher gives them
    c = t.candidate.withColumns({"score": F.least(F.col("score") * 2, F.lit(0.99)), "primary_exact": k % 2 == 0})
    return resolve.auto_link(c, k % 5 == 0, F.lit(False), k % 7 == 0, k % 3 == 0)


@query("J-11", sql="""SELECT event_id, channel_id FROM (SELECT id AS event_id, channel_id, message_id FROM message WHERE id % 2 = 1) p
  WHERE NOT EXISTS (SELECT 1 FROM message m WHERE m.id % 2 = 0 AND m.status <> 'queued' AND m.channel_id = p.channel_id AND m.message_id = p.message_id)""")
def posts_to_deliver(t: Tables):
    posts = t.message.filter("id % 2 = 1").withColumnRenamed("id", "event_id")
    return resolve.not_yet_delivered(posts, t.message.filter("id % 2 = 0"), ["channel_id", "message_id"]).select("event_id", "channel_id")


_SPAN = "SELECT w.id, w.title, w.year, min(r.episode) AS a, max(r.episode) AS b FROM work w JOIN resource r ON r.work_id = w.id WHERE r.episode IS NOT NULL GROUP BY ALL"


@query("J-12", "M-03", sql=f"""WITH e AS ({_SPAN}), s AS (SELECT DISTINCT replace(title, 'SPECIFIED', 'X') AS title, year, a, b FROM e WHERE year IS NOT NULL), u AS (SELECT * FROM e WHERE year IS NULL)
  SELECT u.id, min(s.year) AS year FROM u JOIN (SELECT substring(title, position('Part' IN title), 20) AS t, year, a, b FROM s) s ON s.t = substring(u.title, position('Part' IN u.title), 20)
  WHERE u.a BETWEEN s.a AND s.b OR u.b BETWEEN s.a AND s.b GROUP BY 1 HAVING COUNT(DISTINCT s.year) = 1""")
def covered_years(t: Tables):
    title = F.regexp_extract("title", "(Part.*)$", 1)
    spans = t.resource.filter(F.col("episode").isNotNull()).groupBy("work_id").agg(F.min("episode").alias("first"), F.max("episode").alias("last"))
    w = t.work.join(spans, F.col("id") == F.col("work_id")).select("id", title.alias("title"), "year", "first", "last")
    return resolve.covering_year(w.filter(F.col("year").isNull()).drop("year"), w.filter(F.col("year").isNotNull()).drop("id"))


@query("J-14", "M-13", sql="""SELECT w.id, min(l_suppkey) AS collection_id FROM work w JOIN lineitem ON l_partkey = w.catalogue_id WHERE w.collection_id IS NULL GROUP BY 1""")
def completed_collections(t: Tables):
    parts = t.lineitem.select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("catalogue_id"))
    return resolve.contained_works(t.work, parts)


@query("J-16", sql="""WITH m AS (SELECT id, received_at, channel_username, channel_name, CASE WHEN id % 3 = 0 THEN NULL ELSE channel_id END AS channel_id FROM message),
  u AS (SELECT channel_username, last(channel_id ORDER BY received_at, id) AS c FROM m WHERE channel_id IS NOT NULL AND channel_username IS NOT NULL GROUP BY 1),
  n AS (SELECT channel_name, last(channel_id ORDER BY received_at, id) AS c FROM m WHERE channel_id IS NOT NULL AND channel_name IS NOT NULL GROUP BY 1)
  SELECT m.id, coalesce(m.channel_id, u.c, n.c) AS channel_id FROM m LEFT JOIN u USING (channel_username) LEFT JOIN n USING (channel_name)""")
def backfilled_channels(t: Tables):
    posts = t.message.withColumn("channel_id", F.when(F.col("id") % 3 != 0, F.col("channel_id")))
    return resolve.backfilled_channels(posts).select("id", "channel_id")


@query("ST-05", sql="""SELECT message_id, CASE WHEN p > 0 THEN 'pending_validation' WHEN (v > 0 OR o > 0) AND i = 0 THEN CASE WHEN e > 0 THEN 'failed' WHEN ins > 0 THEN 'imported' ELSE 'duplicate' END
    WHEN v > 0 THEN 'imported' ELSE 'failed' END AS status, n AS links FROM (SELECT message_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'pending_validation') AS p, COUNT(*) FILTER (WHERE status = 'invalid') AS i,
    COUNT(*) FILTER (WHERE status = 'inserted') AS ins, COUNT(*) FILTER (WHERE status = 'error') AS e, COUNT(*) FILTER (WHERE status IN ('inserted', 'duplicate')) AS v, COUNT(work_id) AS o FROM link GROUP BY 1)""")
def message_outcomes(t: Tables):
    return resolve.rolled_up_status(t.link)


@query("M-19", sql="""SELECT r.id, 'available' AS availability, c AS checked_at FROM resource r JOIN (SELECT source_key, max(processed_at) AS c FROM link WHERE status IN ('inserted', 'duplicate') GROUP BY 1) l USING (source_key) WHERE availability = 'unknown'""")
def availability_backfill(t: Tables):
    return resolve.newest_processing(t.resource, t.link)


@query("ST-04", "F-17", sql="""WITH a AS (SELECT user_id AS link, ts, event_id, CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'gate' ELSE 'transient' END AS outcome FROM events),
  o AS (SELECT *, SUM(CASE WHEN outcome = 'transient' THEN 1 ELSE 0 END) OVER w AS n, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY link ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT link, min(k) FILTER (WHERE outcome = 'valid' OR (outcome = 'transient' AND n >= 4)) AS settled, max(k) AS last FROM o GROUP BY 1),
  f AS (SELECT o.*, settled FROM o JOIN s ON s.link = o.link AND o.k = coalesce(settled, last))
  SELECT link, CASE WHEN settled IS NULL THEN 'pending_validation' WHEN outcome = 'valid' THEN 'validated' ELSE 'error' END AS status, CAST(n AS BIGINT) AS attempts,
    CASE WHEN settled IS NULL THEN ts + to_seconds(CASE WHEN outcome = 'gate' THEN 3600 ELSE least(3600, 30 * CAST(power(2, least(greatest(n - 1, 0), 6)) AS BIGINT)) END) END AS next_retry_at FROM f""")
def retry_states(t: Tables):
    outcome = F.when(F.col("event_type") == "purchase", "valid").when(F.col("event_type") == "signup", "gate").otherwise("transient")
    attempts = t.events.select(F.col("user_id").alias("link"), F.col("ts").alias("attempt_at"), "event_id", outcome.alias("outcome"))
    return retry.link_states(attempts, "link", ["event_id"], most=4)
