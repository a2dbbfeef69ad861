"""Resource views and coverage over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cut_at_first
from ..operators import coverage, resources, works
from .bindings import Tables
from .registry import query

_VIEW = """v AS (SELECT r.id, r.work_id, r.resource_class, r.availability, r.filename, r.raw_label, r.quality, r.file_size, r.tags, r.url, r.created_at,
    coalesce(r.last_checked_at, r.created_at) AS updated_at, w.title AS work_title, w.collection_id, c.title AS collection_title,
    CASE WHEN r.source_type = 'ed2k' THEN 'ed2k' ELSE r.provider END AS provider_id,
    CASE WHEN w.status = 'matched' AND w.catalogue_id IS NOT NULL THEN 'matched' WHEN w.status IN ('review', 'not_found', 'error') THEN w.status ELSE 'unrecognized' END AS recognition_status,
    coalesce(r.parsed_year, w.year, CASE WHEN regexp_full_match(substr(w.release_date, 1, 4), '[12][0-9]{3}') THEN CAST(substr(w.release_date, 1, 4) AS INT) END) AS year,
    r.last_checked_at
  FROM resource r JOIN work w ON w.id = r.work_id LEFT JOIN collection c ON c.id = w.collection_id),
g AS (SELECT *, CASE WHEN resource_class = 'person' THEN 'person' WHEN resource_class = 'collection' THEN 'series'
    WHEN resource_class IN ('music', 'nsfw', 'other') THEN resource_class WHEN recognition_status = 'matched' THEN 'media' ELSE 'unrecognized' END AS resource_group FROM v)"""
_TITLE = "coalesce(nullif(trim(raw_label), ''), nullif(trim(filename), ''), nullif(trim(work_title), ''), '未命名资源')"


def _view(t: Tables):
    return resources.with_groups(works.base_view(t.resource, t.work, t.collection))


@query("P-02", sql=f"WITH {_VIEW} SELECT recognition_status, resource_group, COUNT(*) AS n FROM g GROUP BY ALL")
def resource_groups(t: Tables):
    return _view(t).groupBy("recognition_status", "resource_group").agg(F.count(F.lit(1)).alias("n"))


@query("A-16", sql=f"WITH {_VIEW} SELECT COUNT(*) AS total, " + ", ".join(
    f"COUNT(*) FILTER (WHERE availability = '{a}') AS {a}" for a in ("available", "pending", "invalid")) + ", " + ", ".join(
    f"COUNT(*) FILTER (WHERE resource_group = '{x}') AS group_{x}" for x in ("media", "person", "series", "music", "nsfw", "other", "unrecognized")) + " FROM g")
def resource_summary(t: Tables):
    return resources.group_summary(_view(t))


@query("P-04", "T-02", sql=f"""WITH {_VIEW} SELECT id, year, resource_group FROM g WHERE recognition_status = 'matched' AND availability = 'available' AND year = 1997
  AND upper(trim(quality)) IN ('2160P', '4K', 'UHD') AND tags LIKE '[%"beta"%' ORDER BY lower(raw_label), id DESC LIMIT 50""")
def resource_facet_page(t: Tables):
    f = resources.ResourceFilter(recognition="matched", availability="available", year="1997", quality="2160P", tag="beta", sort="title_asc")
    return works.page_of(f.apply(_view(t)), resources.RESOURCE_SORTS[f.sort](), 1, 50).select("id", "year", "resource_group")


@query("T-02", sql="""SELECT 'title_asc' AS sort, id FROM (SELECT id FROM resource ORDER BY lower(raw_label), id DESC LIMIT 25)
  UNION ALL SELECT 'checked_desc', id FROM (SELECT id FROM resource ORDER BY last_checked_at DESC NULLS LAST, id DESC LIMIT 25)
  UNION ALL SELECT 'created_desc', id FROM (SELECT id FROM resource ORDER BY created_at DESC, id DESC LIMIT 25)""")
def resource_orders(t: Tables):
    parts = [works.page_of(t.resource, resources.RESOURCE_SORTS[s](), 1, 25).select(F.lit(s).alias("sort"), "id")
             for s in ("title_asc", "checked_desc", "created_desc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("P-11", sql=f"""WITH {_VIEW} SELECT id, {_TITLE} AS title, resource_group, regexp_replace(url, 'password=[^&#]*', 'password=****') AS url_masked,
    '****' AS access_code_masked, file_size AS total_size,
    CASE WHEN tags LIKE '[%' THEN replace(replace(replace(replace(tags, '["', ''), '"]', ''), '", "', ','), '","', ',') ELSE '' END AS tags FROM g""")
def presented_resources(t: Tables):
    return resources.present(_view(t)).select("id", "title", "resource_group", "url_masked", "access_code_masked", "total_size", "tags")


@query("P-11", sql="""SELECT doc_id, regexp_replace(text, '(?i)((?:password|pwd|receive_code|access_code|access_token|token|code)=)[^\\s&#]+', '\\1****', 'g') AS masked FROM documents""")
def redacted_texts(t: Tables):
    from ..functions.text import redact

    return t.documents.select("doc_id", redact(F.col("text")).alias("masked"))


@query("P-13", sql="""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'person' WHEN 1 THEN 'collection' WHEN 2 THEN 'nsfw' WHEN 3 THEN 'nsfw' WHEN 4 THEN 'music' WHEN 5 THEN 'music' WHEN 6 THEN 'music'
  WHEN 7 THEN CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'media' ELSE 'other' END WHEN 8 THEN 'collection' ELSE CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'media' ELSE 'other' END END AS resource_class FROM part""")
def inferred_classes(t: Tables):
    k, n = F.col("p_partkey") % 10, F.col("p_name")
    title = (
        F.when(k == 2, F.concat(F.lit("abp-123 "), n)).when(k == 5, F.concat(n, F.lit(" 演唱会"))).when(k.isin(6, 7), F.concat(n, F.lit(" hi-res"))).when(k == 8, F.concat(n, F.lit(" 资源包"))).otherwise(n)
    )
    file = F.when(k == 3, F.concat(F.lit("ABP-123."), n)).when(k == 4, F.concat(n, F.lit(".flac"))).when(k == 7, F.concat(n, F.lit(".mkv")))
    kind = F.when(F.col("p_type") == "LARGE", "movie").when(F.col("p_type") == "SMALL", "tv").otherwise("unknown")
    declared = F.when(k == 0, "person").when(k == 1, "series").otherwise("media")
    return t.part.select("p_partkey", resources.infer_class(declared, title, kind, file).alias("resource_class"))


@query("P-16", sql="""SELECT id, file_size AS total_size, CASE WHEN work_id % 3 > 0 THEN 'token=**** ' || coalesce(quality, '') END AS media_info, CASE WHEN work_id % 3 = 1 THEN coalesce(codec, '') || ',' || coalesce(hdr, '') ELSE '' END AS quality_tags FROM resource""")
def technical_summaries(t: Tables):
    blank = lambda c: F.coalesce(c, F.lit(""))
    k = F.col("work_id") % 3
    metadata = F.when(k == 1, F.to_json(F.struct(F.concat(F.lit("token=abc "), blank("quality")).alias("media_info"), F.array(blank("codec"), blank("hdr")).alias("quality_tags")))).when(
        k == 2, F.to_json(F.struct(F.concat(F.lit("token=xyz "), blank("quality")).alias("media_info"), F.lit("none").alias("quality_tags")))
    ).otherwise("[broken")
    out = resources.technical_summary(t.resource.withColumn("metadata", metadata))
    return out.select("id", "total_size", "media_info", F.array_join("quality_tags", ",").alias("quality_tags"))


@query("P-14", sql="""SELECT p_partkey AS id, CASE WHEN p_size <= 40 AND p_size % 3 = 0 THEN 'music' ELSE 'media' END AS resource_class,
  CASE WHEN p_size <= 40 AND p_size % 3 = 0 THEN p_brand || ',' || p_type ELSE 'stored' END AS tags FROM part""")
def edited_resources(t: Tables):
    stored = t.part.select(F.col("p_partkey").alias("id"), F.lit("media").alias("resource_class"), F.array(F.lit("stored")).alias("tags"), F.lit("").alias("notes"))
    # An edit whose class is not in the set must leave its resource as stored.
    edits = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") > 40, "film").when(F.col("p_size") % 3 == 0, "music").alias("resource_class"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.concat("p_brand", F.lit(" ")))).alias("tags"),
        F.lit(None).cast("string").alias("notes"),
    )
    return resources.overlay_edits(stored, edits).select("id", "resource_class", F.array_join("tags", ",").alias("tags"))


def _groups_sql(group: str, key: str, title: str) -> str:
    return f"""WITH {_VIEW}, k AS (SELECT *, {key} AS group_key FROM g WHERE resource_group = '{group}'),
  b AS (SELECT group_key, COUNT(*) AS resource_count, COUNT(*) FILTER (WHERE availability = 'available') AS available, COUNT(*) FILTER (WHERE availability = 'pending') AS pending,
    COUNT(*) FILTER (WHERE availability = 'invalid') AS invalid, COUNT(*) FILTER (WHERE availability = 'unknown') AS unknown, max(updated_at) AS updated_at, max(created_at) AS created_at,
    CAST(SUM(file_size) AS BIGINT) AS total_size, {title} AS title FROM k GROUP BY 1),
  p AS (SELECT group_key, string_agg(provider_id || ':' || n, ',' ORDER BY provider_id || ':' || n) AS providers FROM (SELECT group_key, provider_id, COUNT(*) AS n FROM k GROUP BY ALL) GROUP BY 1),
  x AS (SELECT DISTINCT group_key, unnest(string_split(replace(replace(replace(replace(tags, '["', ''), '"]', ''), '", "', ','), '","', ','), ',')) AS tag FROM k WHERE tags LIKE '[%'),
  y AS (SELECT group_key, string_agg(tag, ',' ORDER BY tag) AS tags FROM x GROUP BY 1)
  SELECT b.*, providers, coalesce(tags, '') AS tags FROM b LEFT JOIN p USING (group_key) LEFT JOIN y USING (group_key)"""


@query("A-13", sql=_groups_sql("person", "regexp_replace(lower(work_title), '[^a-z0-9]', '', 'g')", "arg_min(work_title, id)"))
def person_groups(t: Tables):
    return resources.person_groups(_view(t))


@query("A-14", sql=_groups_sql(
    "series", "CASE WHEN collection_id IS NOT NULL THEN 'series-' || collection_id ELSE 'collection-' || regexp_replace(lower(work_title), '[^a-z0-9]', '', 'g') END",
    "CASE WHEN min(work_title) = max(work_title) THEN min(work_title) ELSE coalesce(max(collection_title), min(work_title)) END"))
def collection_groups(t: Tables):
    return resources.collection_groups(_view(t))


@query("W-08", "X-07", sql="""WITH r AS (SELECT DISTINCT source_key, l.message_id, l.status, received_at FROM link l JOIN message m ON m.id = l.message_id),
  h AS (SELECT source_key, bool_or(status = 'inserted') AS has, arg_min(message_id, {'t': received_at, 'i': message_id}) AS oldest FROM r GROUP BY 1)
  SELECT r.*, CASE WHEN has THEN status = 'inserted' ELSE message_id = oldest END AS is_delivery FROM r JOIN h USING (source_key)""")
def deliveries_and_repeats(t: Tables):
    return resources.deliveries(t.link, t.message)


@query("X-07", sql=f"""WITH {_VIEW} SELECT work_id, id, CAST(rank AS INT) AS rank FROM (SELECT work_id, id, row_number() OVER (PARTITION BY work_id ORDER BY id DESC) AS rank
  FROM g WHERE recognition_status = 'matched') WHERE rank <= 31""")
def related_resources(t: Tables):
    return resources.related_resources(_view(t)).select("work_id", "id", "rank")


@query("A-17", sql="""WITH f AS (SELECT work_id, coalesce(filename, '') <> '' AS named, regexp_extract(coalesce(filename, ''), '\\.([a-z0-9]+)$', 1) AS e, filename FROM resource),
  a AS (SELECT work_id, bool_and(named) AS nm, bool_and(e IN ('jpg', 'png', 'nfo') OR filename = 'theme.mp3') AS aux, bool_or(coalesce(filename = 'theme.mp3', false)) AS theme,
    bool_or(e IN ('jpg', 'png')) AS img, bool_or(e = 'nfo') AS nfo, bool_and(coalesce(e NOT IN ('jpg', 'png') OR filename LIKE 'poster%', false)) AS art FROM f GROUP BY 1)
  SELECT work_id, (nm AND aux AND (NOT theme OR (img AND nfo)) AND art) AS is_metadata,
    CASE WHEN nm AND aux AND (NOT theme OR (img AND nfo)) AND art THEN (CASE WHEN img THEN 'artwork' WHEN nfo THEN 'nfo' ELSE 'auxiliary' END) END AS reason FROM a""")
def metadata_packs(t: Tables):
    return resources.metadata_packs(t.resource, t.work.select(F.col("id").alias("work_id"), "title"))


# --- coverage ---------------------------------------------------------------------------------
_SPANS = """s AS (SELECT DISTINCT work_id, coalesce(season, 1) AS season, episode AS first, CASE WHEN quality = '2160p' THEN episode + 2 ELSE episode END AS last FROM resource WHERE episode IS NOT NULL),
  e AS (SELECT work_id, season, CAST(unnest(generate_series(first, last)) AS INT) AS episode, CASE WHEN first = last THEN 1 ELSE 2 END AS how FROM s)"""


def _spans(t: Tables):
    return t.resource.filter(F.col("episode").isNotNull()).select(
        "work_id", F.coalesce("season", F.lit(1)).alias("season"), F.col("episode").alias("first"),
        F.when(F.col("quality") == "2160p", F.col("episode") + 2).otherwise(F.col("episode")).alias("last"),
    )


@query("A-18", sql=f"""WITH {_SPANS} SELECT work_id, season, min(episode) AS first, max(episode) AS last, COUNT(DISTINCT episode) AS episodes,
  max(episode) - min(episode) + 1 = COUNT(DISTINCT episode) AS contiguous FROM e GROUP BY ALL""")
def episode_coverage(t: Tables):
    return coverage.coverage(_spans(t), ["work_id", "season"])


@query("W-07", "F-07", sql="""WITH n AS (SELECT DISTINCT work_id, episode FROM resource WHERE episode IS NOT NULL),
  i AS (SELECT work_id, episode, episode - row_number() OVER (PARTITION BY work_id ORDER BY episode) AS g FROM n),
  r AS (SELECT work_id, min(episode) AS a, max(episode) AS b FROM i GROUP BY work_id, g)
  SELECT work_id, string_agg(CASE WHEN a = b THEN 'E' || lpad(CAST(a AS VARCHAR), 2, '0') ELSE 'E' || lpad(CAST(a AS VARCHAR), 2, '0') || '-E' || lpad(CAST(b AS VARCHAR), 2, '0') END, ' ' ORDER BY a) AS episodes
  FROM r GROUP BY 1""")
def episode_run_labels(t: Tables):
    return coverage.run_labels(t.resource, ["work_id"], "episode", "E", True, "episodes")


@query("F-07", sql="""SELECT id, CASE WHEN episode IS NOT NULL THEN 'S' || lpad(CAST(coalesce(season, 1) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') ||
    (CASE WHEN quality = '2160p' THEN '-E' || lpad(CAST(episode + 2 AS VARCHAR), 2, '0') ELSE '' END)
  WHEN season_end > season THEN 'S' || lpad(CAST(season AS VARCHAR), 2, '0') || '-S' || lpad(CAST(season_end AS VARCHAR), 2, '0')
  WHEN season IS NOT NULL THEN 'S' || lpad(CAST(season AS VARCHAR), 2, '0') END AS episode_label FROM resource""")
def episode_labels(t: Tables):
    r = t.resource.withColumn("episode_end", F.when(F.col("quality") == "2160p", F.col("episode") + 2))
    return coverage.episode_labels(r).select("id", "episode_label")


@query("A-26", sql="""WITH r AS (SELECT work_id, episode IS NOT NULL AS single, CASE WHEN episode IS NOT NULL THEN 'S' || lpad(CAST(coalesce(season, 1) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0')
      || (CASE WHEN quality = '2160p' THEN '-E' || lpad(CAST(episode + 2 AS VARCHAR), 2, '0') ELSE '' END)
      WHEN season IS NOT NULL THEN 'S' || lpad(CAST(season AS VARCHAR), 2, '0') || ' 整季' END AS label FROM resource),
  w AS (SELECT work_id, bool_or(single) AS numbered FROM r GROUP BY 1),
  l AS (SELECT DISTINCT r.work_id, numbered, label FROM r JOIN w USING (work_id) WHERE single = numbered),
  k AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY label) AS k FROM l WHERE label IS NOT NULL),
  c AS (SELECT work_id, any_value(numbered) AS numbered, COUNT(*) AS n, string_agg(label, '、' ORDER BY label) FILTER (WHERE NOT numbered OR k <= 6) AS shown FROM k GROUP BY 1)
  SELECT w.work_id, coalesce(n, 0) AS labels, CASE WHEN c.work_id IS NULL THEN '未提取' WHEN c.numbered AND n > 6 THEN shown || ' 等 ' || n || ' 个' ELSE shown END AS shown
  FROM w LEFT JOIN c USING (work_id)""")
def capped_labels(t: Tables):
    return coverage.capped_labels(t.resource.withColumn("episode_end", F.when(F.col("quality") == "2160p", F.col("episode") + 2)))


@query("R-26", sql=f"""WITH {_SPANS}, o AS (SELECT work_id, season, episode, min(how) AS how FROM e GROUP BY ALL),
  b AS (SELECT id AS work_id, CAST(1 AS INT) AS season, CAST(id % 6 + 1 AS INT) AS known FROM work WHERE media_type = 'tv'),
  p AS (SELECT DISTINCT work_id, season FROM resource WHERE episode IS NULL AND season IS NOT NULL),
  m AS (SELECT work_id, season, max(episode) AS owned FROM o GROUP BY ALL),
  x AS (SELECT coalesce(m.work_id, b.work_id) AS work_id, coalesce(m.season, b.season) AS season, known, greatest(coalesce(owned, 0), coalesce(known, 0)) AS n
    FROM m FULL JOIN b ON b.work_id = m.work_id AND b.season = m.season),
  c AS (SELECT work_id, season, known, CAST(unnest(generate_series(1, n)) AS INT) AS episode FROM x WHERE n > 0)
  SELECT c.work_id, c.season, c.episode, CASE WHEN how = 1 THEN 'single' WHEN how = 2 THEN 'range' WHEN p.work_id IS NOT NULL AND (known IS NULL OR c.episode <= known) THEN 'pack' ELSE 'missing' END AS state
  FROM c LEFT JOIN o USING (work_id, season, episode) LEFT JOIN p ON p.work_id = c.work_id AND p.season = c.season""")
def season_grid(t: Tables):
    packs = t.resource.filter(F.col("episode").isNull() & F.col("season").isNotNull())
    baseline = t.work.filter(F.col("media_type") == "tv").select(
        F.col("id").alias("work_id"), F.lit(1).alias("season"), (F.col("id") % 6 + 1).cast("int").alias("episode_count")
    )
    return coverage.season_grid(_spans(t), packs, baseline)


@query("A-22", sql="""WITH n AS (SELECT o_custkey AS folder, lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '', 'g')) AS name_key, COUNT(*) AS n, min(o_orderpriority) AS name FROM orders GROUP BY 1, 2),
  t AS (SELECT *, SUM(n) OVER (PARTITION BY folder) AS total FROM n) SELECT folder, name_key, n, name, CAST(total AS BIGINT) AS total FROM t WHERE n >= 2 AND n >= total * 0.5""")
def dominant_names(t: Tables):
    return coverage.dominant_names(t.orders.withColumnRenamed("o_custkey", "folder"), "folder", F.col("o_orderpriority"))


@query("A-20", sql="""SELECT status || '/' || media_type AS label, COUNT(*) AS n, any_value(x) AS examples FROM work JOIN (
  SELECT label, string_agg(id, ',' ORDER BY id) AS x FROM (SELECT status || '/' || media_type AS label, id, row_number() OVER (PARTITION BY status, media_type ORDER BY id) AS k FROM work)
  WHERE k <= 5 GROUP BY 1) e ON e.label = status || '/' || media_type GROUP BY 1""")
def audit_groups(t: Tables):
    return coverage.group_examples(t.work, F.concat_ws("/", "status", "media_type"), F.col("id"))


@query("A-21", sql="""SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE status = 'matched') AS matched, COUNT(*) FILTER (WHERE status = 'review') AS review,
  COUNT(*) FILTER (WHERE status = 'not_found') AS not_found, COUNT(*) FILTER (WHERE status = 'error') AS error FROM work""")
def run_status(t: Tables):
    return coverage.run_status(t.work)


@query("F-05", sql="""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9.,]') THEN regexp_extract(text, '^([^0-9.,]*)', 1) ELSE text END AS head FROM documents""")
def text_before_first_mark(t: Tables):
    return t.documents.select("doc_id", cut_at_first(F.col("text"), [r"[0-9]", r"\.", ","]).alias("head"))
