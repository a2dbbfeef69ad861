"""Queries of maintenance jobs."""

from pyspark.sql import functions as F

from ..operators import maintenance, resources
from .bindings import Tables
from .registry import query

_WORDS = "CASE WHEN title LIKE 'HIGH%' THEN 'x 电影' WHEN title LIKE 'LOW Part 1%' THEN 'x 全12集' END"
_EVIDENCE = f"""f AS (SELECT r.work_id, r.season, r.season_end, r.episode, r.filename, {_WORDS} AS words FROM resource r JOIN work w ON w.id = r.work_id),
  e AS (SELECT work_id, COUNT(DISTINCT episode) + COUNT(DISTINCT season_end) + COUNT(DISTINCT CASE WHEN season_end IS NULL AND season > 1 THEN season END) AS fields, bool_or(coalesce(words LIKE '%集', false)) AS tv_word, bool_or(coalesce(words LIKE '%电影', false)) AS film,
    bool_or(season_end IS NULL AND season = 1) AS first_season, bool_or(regexp_matches(coalesce(filename, ''), '\\.(flac|mp3)$')) AS audio FROM f GROUP BY 1),
  v AS (SELECT w.id, w.title, w.media_type AS current_type, CASE WHEN status = 'matched' THEN 'tmdb' WHEN resource_kind <> 'media' OR is_bundle OR is_metadata THEN 'excluded' WHEN audio THEN 'weak' WHEN (fields > 0 OR tv_word) AND film THEN 'conflict'
    WHEN fields > 0 OR tv_word OR film THEN 'strong' WHEN first_season THEN 'weak' ELSE 'none' END AS confidence, w.status, e.*, w.media_type FROM work w LEFT JOIN e ON e.work_id = w.id),
  t AS (SELECT id, current_type, confidence, CASE confidence WHEN 'tmdb' THEN current_type WHEN 'strong' THEN CASE WHEN film THEN 'movie' ELSE 'tv' END ELSE 'unknown' END AS type,
    CASE confidence WHEN 'tmdb' THEN 'tmdb' WHEN 'excluded' THEN 'resource_kind' WHEN 'conflict' THEN 'conflict' WHEN 'strong' THEN CASE WHEN fields > 0 THEN 'fields' ELSE 'heading' END WHEN 'weak' THEN CASE WHEN audio THEN 'none' ELSE 'season' END ELSE 'none' END AS source,
    CASE confidence WHEN 'tmdb' THEN 1 WHEN 'excluded' THEN 1 WHEN 'weak' THEN CASE WHEN first_season THEN 1 ELSE 0 END + CASE WHEN audio THEN 1 ELSE 0 END WHEN 'none' THEN 0 ELSE fields + CASE WHEN tv_word THEN 1 ELSE 0 END + CASE WHEN film THEN 1 ELSE 0 END END AS reasons FROM v)"""


def _evidence(t: Tables):
    words = t.work.selectExpr("id as _work", f"{_WORDS} as context")
    rows = t.resource.join(words, F.col("work_id") == F.col("_work")).drop("_work")
    return rows, maintenance.type_evidence(t.work, rows)


@query("M-04", sql=f"WITH {_EVIDENCE} SELECT id, current_type, type, confidence, source, CAST(reasons AS INT) AS reasons FROM t")
def graded_types(t: Tables):
    return _evidence(t)[1].drop("title").withColumn("reasons", F.size("reasons"))


@query("M-05", sql=f"""WITH {_EVIDENCE}, c AS (SELECT id, type FROM t WHERE confidence = 'strong' AND type <> current_type) SELECT c.id, type AS media_type, CASE WHEN type = 'movie' THEN
    (SELECT COUNT(*) FROM resource r WHERE r.work_id = c.id AND (season IS NOT NULL OR season_end IS NOT NULL OR episode IS NOT NULL)) ELSE 0 END AS cleared FROM c""")
def strong_type_changes(t: Tables):
    made = maintenance.strong_type_changes(_evidence(t)[1], t.resource)
    cleared = made["resources"].groupBy("work_id").agg(F.count(F.lit(1)).alias("cleared"))
    return made["works"].join(cleared, F.col("id") == F.col("work_id"), "left").select("id", "media_type", F.coalesce("cleared", F.lit(0)).alias("cleared"))


_SERIES = """w AS (SELECT p_partkey AS id, CASE WHEN p_size < 19 THEN '远山' || substr(p_name, 1, 3) ELSE '远山' || substr(p_name, 1, 3) || p_size END AS title, CASE WHEN p_size < 19 THEN NULL ELSE '远山' || substr(p_name, 1, 3) END AS base, p_size AS episode,
    CASE p_partkey % 4 WHEN 0 THEN 'movie' WHEN 1 THEN 'unknown' ELSE 'tv' END AS media_type, CASE WHEN p_partkey % 5 = 0 THEN 'matched' ELSE 'pending' END AS status, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 2000 + p_partkey % 2 END AS year, p_partkey % 11 = 0 AS is_bundle FROM part)"""


@query("M-02", "E-18", "J-12", sql=f"""WITH {_SERIES}, p AS (SELECT * FROM w WHERE NOT is_bundle), s AS (SELECT * FROM p WHERE media_type = 'tv' AND status = 'matched'),
  b AS (SELECT title AS base FROM s UNION SELECT base FROM p WHERE base IS NOT NULL AND media_type = 'tv'), y AS (SELECT title AS base, min(year) AS low, max(year) AS high FROM s WHERE year IS NOT NULL GROUP BY 1),
  r AS (SELECT l_partkey AS id, min(l_linenumber * 8) AS first, max(l_linenumber * 8) AS last FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT title AS base, year, first, last FROM s JOIN r USING (id) WHERE year IS NOT NULL),
  o AS (SELECT * FROM p WHERE base IN (SELECT base FROM b) AND status <> 'matched' AND media_type IN ('tv', 'unknown')),
  h AS (SELECT o.id, min(c.year) AS a, max(c.year) AS z FROM o JOIN c ON c.base = o.base AND o.episode BETWEEN c.first AND c.last GROUP BY 1)
  SELECT id, base AS title, base AS title_key, CAST(episode AS INT) AS episode, CAST(coalesce(CASE WHEN low = high THEN low END, CASE WHEN a = z THEN a END) AS INT) AS year FROM o LEFT JOIN y USING (base) LEFT JOIN h USING (id)""")
def episode_suffixes(t: Tables):
    k, base = F.col("p_partkey"), F.concat(F.lit("远山"), F.substring("p_name", 1, 3))
    works = t.part.select(
        k.alias("id"), F.when(F.col("p_size") < 19, base).otherwise(F.concat(base, F.col("p_size").cast("string"))).alias("title"), F.when(k % 4 == 0, "movie").when(k % 4 == 1, "unknown").otherwise("tv").alias("media_type"),
        F.when(k % 5 == 0, "matched").otherwise("pending").alias("status"), F.when(k % 3 != 0, 2000 + k % 2).cast("int").alias("year"), F.lit("media").alias("resource_kind"), (k % 11 == 0).alias("is_bundle"), F.lit(False).alias("is_metadata"),
    )
    return maintenance.episode_suffixes(works, t.lineitem.select(F.col("l_partkey").alias("work_id"), (F.col("l_linenumber") * 8).alias("episode")))


@query("M-12", sql="""WITH f AS (SELECT work_id, coalesce(filename, '') <> '' AS named, regexp_extract(coalesce(filename, ''), '\\.([a-z0-9]+)$', 1) AS e, filename FROM resource),
  a AS (SELECT work_id, bool_and(named) AS nm, bool_and(e IN ('jpg', 'png', 'nfo') OR filename = 'theme.mp3') AS aux, bool_or(coalesce(filename = 'theme.mp3', false)) AS theme,
    bool_or(e IN ('jpg', 'png')) AS img, bool_or(e = 'nfo') AS nfo, bool_and(coalesce(e NOT IN ('jpg', 'png') OR filename LIKE 'poster%', false)) AS art FROM f GROUP BY 1),
  n AS (SELECT w.id, w.status, w.is_metadata AS was, CASE WHEN w.is_metadata THEN 'artwork' END AS why, coalesce(nm AND aux AND (NOT theme OR (img AND nfo)) AND art, false) AND resource_kind = 'media' AND status <> 'matched' AS now, CASE WHEN img THEN 'artwork' WHEN nfo THEN 'nfo' ELSE 'auxiliary' END AS r FROM work w LEFT JOIN a ON a.work_id = w.id)
  SELECT id, now AS is_metadata, CASE WHEN now THEN r END AS reason, was AND NOT now AND status <> 'matched' AS reopened FROM n WHERE now <> was OR CASE WHEN now THEN r END IS DISTINCT FROM why""")
def metadata_flag_changes(t: Tables):
    works = t.work.withColumn("metadata_reason", F.when(F.col("is_metadata"), "artwork"))
    return maintenance.metadata_flag_changes(works, resources.metadata_packs(t.resource, t.work.select(F.col("id").alias("work_id"), "title")))


@query("M-11", "P-13")
def collection_classes(t: Tables):
    titled = t.work.withColumn("title", F.when(F.col("title").startswith("LOW"), F.concat("title", F.lit(" 合集"))).when(F.col("title").startswith("HIGH"), F.concat("title", F.lit(" 音乐"))).otherwise(F.col("title")))
    return maintenance.collection_classes(t.resource.withColumn("kind", F.lit(None).cast("string")), titled)


@query("M-06", "W-02", sql=f"""WITH {_EVIDENCE}, x AS (SELECT DISTINCT id, work_id, score, exact, year_missing, CASE WHEN catalogue_id % 3 = 0 THEN 'tv' ELSE 'movie' END AS kind FROM (SELECT id, work_id, catalogue_id, 0.5 + score / 2.2 AS score, exact, year_missing FROM candidate)),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, id) AS n FROM x) WHERE n = 1),
  z AS (SELECT w.id FROM work w JOIN b ON b.work_id = w.id JOIN t ON t.id = w.id WHERE w.media_type = 'tv' AND status <> 'matched' AND resource_kind = 'media' AND NOT is_bundle AND NOT is_metadata AND score >= 0.9 AND kind = 'movie' AND exact AND NOT year_missing AND NOT (t.type = 'tv' AND t.confidence = 'strong'))
  SELECT id, 'movie' AS media_type FROM z""")
def legacy_films(t: Tables):
    rows, evidence = _evidence(t)
    c = t.candidate.select(
        "id", "work_id", F.when(F.col("catalogue_id") % 3 == 0, "tv").otherwise("movie").alias("media_type"), (F.lit(0.5) + F.col("score") / 2.2).alias("score"), "exact", F.col("year_missing").alias("blocked")
    )
    return maintenance.legacy_films(t.work, c, evidence, rows)["works"]
