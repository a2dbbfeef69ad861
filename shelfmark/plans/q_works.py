"""Catalogue queries over works and their resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions.text import like_literal, like_sequence
from ..functions.times import effective_year
from ..operators import keyed, works
from ..operators.works import SORTS, WorkFilter
from .bindings import AS_OF, Tables
from .registry import query

_YEAR = "coalesce(year, CASE WHEN regexp_full_match(substr(release_date, 1, 4), '[12][0-9]{3}') THEN CAST(substr(release_date, 1, 4) AS INT) END)"
_PROVIDER = "CASE WHEN source_type = 'ed2k' THEN 'ed2k' ELSE provider END"
_NOT_BAD = "NOT EXISTS (SELECT 1 FROM resource r WHERE r.work_id = work.id AND r.resource_class IN ('music', 'nsfw'))"
_ORDINARY = "NOT is_metadata AND resource_kind NOT IN ('person', 'series')"
_SUMMARY = """SELECT work_id, COUNT(*) AS source_count, {m} AS matched_source_count,
  COUNT(*) FILTER (WHERE source_type = '115') AS count_115, COUNT(*) FILTER (WHERE source_type = '123') AS count_123,
  COUNT(*) FILTER (WHERE source_type = 'guangya') AS count_guangya, COUNT(*) FILTER (WHERE source_type = 'ed2k') AS count_ed2k,
  coalesce(string_agg(DISTINCT quality, ',' ORDER BY quality), '') AS qualities,
  coalesce(string_agg(DISTINCT quality, ',' ORDER BY quality) FILTER (WHERE {f}), '') AS matched_qualities,
  max(coalesce(season_end, season)) AS max_season,
  COUNT(DISTINCT CASE WHEN episode IS NOT NULL THEN concat(coalesce(CAST(season AS VARCHAR), '-'), ':', episode) END) AS episode_count
  FROM resource GROUP BY 1"""


@query("P-01", sql=f"SELECT {_YEAR} AS work_year, COUNT(*) AS n FROM work GROUP BY 1")
def effective_years(t: Tables):
    return t.work.groupBy(effective_year(F.col("year"), F.col("release_date")).alias("work_year")).agg(F.count(F.lit(1)).alias("n"))


@query("P-03", "A-03", sql=f"SELECT {_PROVIDER} AS provider_id, COUNT(*) AS n FROM resource GROUP BY 1")
def provider_breakdown(t: Tables):
    return works.provider_breakdown(t.resource).orderBy(F.desc("n"), "provider_id")


@query("J-17", sql=f"""SELECT p AS provider_id, coalesce(label, p) AS provider_label, coalesce(can, false) AS can_check, COUNT(*) AS n
  FROM (SELECT {_PROVIDER} AS p FROM resource) LEFT JOIN (VALUES ('115', '115 网盘', true), ('ed2k', 'ED2K', false), ('aliyun', '阿里云盘', false))
  AS d(id, label, can) ON d.id = p GROUP BY ALL""")
def provider_labels(t: Tables):
    counted = works.provider_breakdown(t.resource)
    return works.provider_dimension(counted, "provider_id")


@query("A-04", sql="SELECT work_id, COUNT(*) AS source_count FROM resource GROUP BY 1 HAVING COUNT(*) > 1")
def multi_source_works(t: Tables):
    return works.multi_source_works(t.resource)


@query("A-01", "J-05", sql=f"""WITH x AS (SELECT work.*, {_NOT_BAD} AS ok, EXISTS (SELECT 1 FROM resource r WHERE r.work_id = work.id) AS has FROM work),
  b AS (SELECT * FROM x WHERE {_ORDINARY})
  SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'matched') AS matched,
    COUNT(*) FILTER (WHERE status <> 'matched' AND ok AND NOT is_bundle) AS pending,
    COUNT(*) FILTER (WHERE status = 'review' AND ok) AS review, COUNT(*) FILTER (WHERE status = 'not_found' AND ok AND NOT is_bundle) AS not_found,
    COUNT(*) FILTER (WHERE status = 'pending' AND ok) AS unsearched, COUNT(*) FILTER (WHERE status = 'error' AND ok) AS error,
    COUNT(*) FILTER (WHERE media_type = 'movie') AS movies, COUNT(*) FILTER (WHERE media_type = 'tv') AS tv,
    COUNT(*) FILTER (WHERE media_type = 'unknown') AS unknown, COUNT(*) FILTER (WHERE has) AS with_sources,
    COUNT(*) FILTER (WHERE NOT has) AS without_sources,
    (SELECT COUNT(*) FROM work WHERE is_metadata AND resource_kind = 'media') AS metadata FROM b""")
def library_stats(t: Tables):
    return works.library_stats(t.work, t.resource)


@query("A-02", sql="""SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE source_type = '115') AS count_115, COUNT(*) FILTER (WHERE source_type = '123') AS count_123,
  COUNT(*) FILTER (WHERE source_type = 'guangya') AS count_guangya, COUNT(*) FILTER (WHERE source_type = 'ed2k') AS count_ed2k,
  CAST(SUM(file_size) AS BIGINT) AS bytes FROM resource""")
def source_stats(t: Tables):
    return works.source_stats(t.resource)


@query("A-23", sql=f"""WITH p AS (SELECT work_id, {_PROVIDER} AS provider_id FROM resource)
  SELECT work_id, provider_id, COUNT(*) AS n FROM p GROUP BY GROUPING SETS ((work_id, provider_id), (work_id))""")
def provider_counts(t: Tables):
    return works.provider_counts(t.resource)


@query("P-05", sql="""SELECT CASE WHEN nullif(trim(quality), '') IS NULL THEN 'unknown' WHEN upper(trim(quality)) IN ('2160P', '4K', 'UHD') THEN '2160P'
    WHEN upper(trim(quality)) = '1080P' THEN '1080P' ELSE 'other' END AS quality_group,
  CASE WHEN nullif(trim(codec), '') IS NULL THEN 'unknown' WHEN upper(trim(codec)) IN ('H.265', 'H265', 'X265', 'HEVC') THEN 'h265'
    WHEN upper(trim(codec)) IN ('H.264', 'H264', 'X264', 'AVC') THEN 'h264' WHEN upper(trim(codec)) = 'AV1' THEN 'av1' ELSE 'other' END AS codec_group,
  COUNT(*) AS n FROM resource GROUP BY ALL""")
def value_groups(t: Tables):
    def label(column, groups):
        out = F.when(works.value_group(F.col(column), "unknown", groups), "unknown")
        for name in groups:
            out = out.when(works.value_group(F.col(column), name, groups), name)
        return out.otherwise("other")

    return t.resource.groupBy(
        label("quality", rules.QUALITY_GROUPS).alias("quality_group"), label("codec", rules.CODEC_GROUPS).alias("codec_group")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P-06", sql="""SELECT coalesce(hdr, '-') AS hdr, coalesce('+' || upper(replace(hdr, ' ', '')) || '+' LIKE '%+DV+%', false) AS dv,
  coalesce('+' || upper(replace(hdr, ' ', '')) || '+' LIKE '%+HDR10+%', false) AS hdr10, coalesce(upper(hdr) LIKE '%HDR%', false) AS any_hdr, COUNT(*) AS n
  FROM (SELECT CASE hdr WHEN 'HDR10+' THEN 'HDR10P' WHEN 'HDR10+ + HDR10' THEN 'HDR10P + HDR10' ELSE hdr END AS hdr FROM resource) GROUP BY ALL""")
def delimited_tokens(t: Tables):
    hdr = F.regexp_replace("hdr", r"HDR10\+", "HDR10P")
    return t.resource.select(hdr.alias("h")).groupBy(
        F.coalesce("h", F.lit("-")).alias("hdr"),
        F.coalesce(works.hdr_filter(F.col("h"), "dv"), F.lit(False)).alias("dv"),
        F.coalesce(works.token_in_list(F.col("h"), "HDR10"), F.lit(False)).alias("hdr10"),
        F.coalesce(works.hdr_filter(F.col("h"), "hdr"), F.lit(False)).alias("any_hdr"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("P-07", sql="""SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%token = %' AS literal
  FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%token = %'
    OR translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%licen%the%'""")
def literal_text_search(t: Tables):
    literal = like_literal(F.col("text"), "TOKEN = ")
    return t.documents.filter(literal | like_sequence(F.col("text"), "licen the")).select("doc_id", literal.alias("literal"))


@query("P-09", sql="""SELECT id, (genres LIKE '[%' AND genres LIKE '%"id":99,%') AS documentary, NOT (genres LIKE '[%' AND (genres LIKE '%"id":16,%' OR genres LIKE '%"id":99,%')) AS drama,
  (genres LIKE '[%' AND genres LIKE '%"name":"Drama"%') AS named, countries LIKE '%"jp"%' AS japan, (countries LIKE '%"US"%' OR countries LIKE '%"FR"%') AS western FROM work""")
def array_membership(t: Tables):
    return t.work.select(
        "id",
        works.category_filter(F.col("genres"), "documentary").alias("documentary"),
        works.category_filter(F.col("genres"), "drama").alias("drama"),
        works.genre_filter(F.col("genres"), "Drama").alias("named"),
        works.country_filter(F.col("countries"), "JP").alias("japan"),
        works.country_filter(F.col("countries"), "western").alias("western"),
    )


@query("P-10", sql="""SELECT id, received_at >= TIMESTAMP '2024-01-23 15:30:00' AS last_7, received_at >= TIMESTAMP '2023-12-31 15:30:00' AS last_30 FROM message""")
def recency(t: Tables):
    ts = F.col("received_at")
    return t.message.select("id", works.recency_filter(ts, 7, AS_OF).alias("last_7"), works.recency_filter(ts, 30, AS_OF).alias("last_30"))


@query("J-01", sql="""SELECT w.id, r.id AS resource_id, r.quality FROM work w LEFT JOIN resource r ON r.work_id = w.id""")
def works_with_resources(t: Tables):
    return works.with_resources(t.work.select("id"), t.resource.select("id", "work_id", "quality"))


@query("J-02", "P-12", sql="""SELECT w.title AS work_title, c.title AS collection_title, COUNT(*) AS n, CAST(SUM(r.file_size) AS BIGINT) AS bytes
  FROM resource r JOIN work w ON w.id = r.work_id LEFT JOIN collection c ON c.id = w.collection_id GROUP BY ALL""")
def base_view(t: Tables):
    return works.base_view(t.resource, t.work, t.collection).groupBy("work_title", "collection_title").agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")
    )


@query("J-03", sql="SELECT id FROM work WHERE EXISTS (SELECT 1 FROM resource r WHERE r.work_id = work.id)")
def works_having_resources(t: Tables):
    return works.has_resource(t.work, t.resource).select("id")


@query("J-04", sql=f"SELECT id, status FROM work WHERE {_NOT_BAD}")
def works_without_music_or_adult(t: Tables):
    return works.without_classes(t.work, t.resource, ("music", "nsfw")).select("id", "status")


@query("J-06", "J-07", "A-10", "A-11", "A-12", sql="SELECT * FROM (" + _SUMMARY.format(
    m="COUNT(*) FILTER (WHERE upper(trim(quality)) IN ('2160P', '4K', 'UHD') AND upper(trim(codec)) IN ('H.265', 'H265', 'X265', 'HEVC'))",
    f="upper(trim(quality)) IN ('2160P', '4K', 'UHD') AND upper(trim(codec)) IN ('H.265', 'H265', 'X265', 'HEVC')") + ") WHERE matched_source_count > 0")
def same_resource_conjunction(t: Tables):
    hit = WorkFilter(quality="2160P", codec="h265").resource_predicate()
    return works.child_summary(t.resource, hit).filter(F.col("matched_source_count") > 0)


@query("A-10", sql="""SELECT work_id, part, string_agg(id, ',' ORDER BY id) AS ids FROM (
  SELECT work_id, id, CAST((row_number() OVER (PARTITION BY work_id ORDER BY id) - 1) // 1000 AS INT) AS part FROM resource) GROUP BY ALL""")
def id_lists(t: Tables):
    return keyed.list_in_parts(t.resource, "work_id", "id", "ids").withColumn("ids", F.array_join("ids", ","))


@query("A-10", sql="""SELECT work_id, string_agg(DISTINCT quality, ',' ORDER BY quality) AS qualities FROM resource WHERE quality IS NOT NULL GROUP BY 1""")
def distinct_qualities(t: Tables):
    return keyed.distinct_values(t.resource, ["work_id"], "quality", "qualities").withColumn("qualities", F.array_join("qualities", ","))


@query("J-08", sql="""SELECT source_key, message_id, channel_name, channel_username, received_at FROM (
  SELECT l.source_key, m.id AS message_id, channel_name, channel_username, received_at,
    row_number() OVER (PARTITION BY l.source_key ORDER BY received_at DESC, m.id DESC) AS k FROM link l JOIN message m ON m.id = l.message_id) WHERE k = 1""")
def latest_message_per_resource(t: Tables):
    return works.latest_message(t.link, t.message)


@query("J-09", sql="""SELECT coalesce(l.work_id, r.work_id) AS owner_id, COUNT(*) AS n FROM link l LEFT JOIN resource r ON r.source_key = l.source_key GROUP BY 1""")
def fallback_owner(t: Tables):
    return works.owned_links(t.link, t.resource).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))


def _page_sql(where: str, order: str, m: str = "TRUE", join: str = "LEFT JOIN", having: str = "TRUE", offset: int = 0) -> str:
    return f"""WITH s AS ({_SUMMARY.format(m=f"COUNT(*) FILTER (WHERE {m})", f=m)}),
      p AS (SELECT work.id, title_key, status, {_YEAR} AS work_year, coalesce(source_count, 0) AS source_count, coalesce(matched_source_count, 0) AS matched_source_count,
        matched_qualities, max_season, coalesce(episode_count, 0) AS episode_count FROM work {join} s ON s.work_id = work.id WHERE NOT is_metadata AND resource_kind <> 'series' AND {where} AND {having}
        ORDER BY {order} LIMIT 30 OFFSET {offset}),
      c AS (SELECT work_id, COUNT(*) AS candidate_count, arg_min(catalogue_id, {{'s': -score, 'i': id}}) AS top_catalogue_id, arg_min(score, {{'s': -score, 'i': id}}) AS top_score
        FROM candidate WHERE work_id IN (SELECT id FROM p) GROUP BY 1)
      SELECT p.*, coalesce(candidate_count, 0) AS candidate_count, top_catalogue_id, top_score FROM p LEFT JOIN c ON c.work_id = p.id"""


_PAGE = ["id", "title_key", "status", "work_year", "source_count", "matched_source_count", "matched_qualities", "max_season", "episode_count",
         "candidate_count", "top_catalogue_id", "top_score"]


@query("P-04", "T-06", "W-02", "J-06", "T-01", sql=_page_sql(
    f"status <> 'matched' AND resource_kind NOT IN ('person', 'series') AND NOT is_bundle AND {_NOT_BAD} AND {_YEAR} BETWEEN 1990 AND 1999",
    "matched_source_count DESC, source_count DESC, title_key, id DESC",
    m="upper(trim(quality)) IN ('2160P', '4K', 'UHD')", having="coalesce(matched_source_count, 0) > 0"))
def facet_page(t: Tables):
    f = WorkFilter(status="pending", year="1990s", quality="2160P", sort="sources_desc")
    return works.list_works(t.work, t.resource, t.candidate, f).select(*_PAGE)


@query("T-03", "P-04", sql=_page_sql(
    f"media_type = 'tv' AND {_YEAR} < 2007", "title_key, year DESC NULLS LAST, work.id DESC", join="JOIN", having="source_count > 1", offset=60))
def third_page(t: Tables):
    f = WorkFilter(media_type="tv", year="earlier", multi_source_only=True, sort="title_asc", page=3)
    return works.list_works(t.work, t.resource, t.candidate, f).select(*_PAGE)


_EARLY = f"""SELECT id FROM work WHERE NOT is_metadata AND resource_kind <> 'series' AND media_type = 'tv' AND {_YEAR} < 2007 AND (SELECT COUNT(*) FROM resource r WHERE r.work_id = work.id) > 1"""


@query("T-03", sql=f"""WITH e AS (SELECT work.id, row_number() OVER (ORDER BY title_key, year DESC NULLS LAST, work.id DESC) AS k, COUNT(*) OVER () AS n FROM work JOIN ({_EARLY}) x ON x.id = work.id)
  SELECT id FROM e WHERE k > (greatest(1, CAST(ceil(n / 30.0) AS BIGINT)) - 1) * 30""")
def page_beyond_the_last(t: Tables):
    f = WorkFilter(media_type="tv", year="earlier", multi_source_only=True, sort="title_asc", page=100_000)
    return works.list_works(t.work, t.resource, t.candidate, f).select("id")


@query("T-03", "W-01", sql=f"""SELECT COUNT(*) AS total, CAST(greatest(1, ceil(COUNT(*) / 30.0)) AS BIGINT) AS pages FROM work
  WHERE NOT is_metadata AND resource_kind <> 'series' AND media_type = 'tv' AND {_YEAR} < 2007
    AND (SELECT COUNT(*) FROM resource r WHERE r.work_id = work.id) > 1""")
def page_totals(t: Tables):
    f = WorkFilter(media_type="tv", year="earlier", multi_source_only=True)
    return works.page_totals(works.select_works(t.work, t.resource, f), f.size)


_SORT_SQL = {
    "updated_desc": "updated_at DESC, id DESC", "vote_desc": "vote DESC NULLS LAST, updated_at DESC, id DESC",
    "title_asc": "title_key, year DESC NULLS LAST, id DESC", "year_desc": "work_year DESC NULLS LAST, title_key, id DESC",
    "year_asc": "work_year NULLS LAST, title_key, id DESC", "confidence_asc": "confidence NULLS LAST, title_key, id DESC",
}


@query("T-01", sql=f"WITH y AS (SELECT *, {_YEAR} AS work_year FROM work) " + " UNION ALL ".join(
    f"SELECT '{n}' AS sort, id FROM (SELECT id FROM y ORDER BY {o} LIMIT 20)" for n, o in _SORT_SQL.items()))
def catalogue_orders(t: Tables):
    base = t.work.withColumn("work_year", effective_year(F.col("year"), F.col("release_date")))
    out = None
    for name in _SORT_SQL:
        part = works.page_of(base, SORTS[name](), 1, 20).select(F.lit(name).alias("sort"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("T-03", sql="""WITH k AS (SELECT updated_at AS u, id AS i FROM work ORDER BY updated_at DESC, id DESC LIMIT 1 OFFSET 29)
  SELECT id, updated_at FROM work, k WHERE updated_at < u OR (updated_at = u AND id < i) ORDER BY updated_at DESC, id DESC LIMIT 30""")
def keyset_page(t: Tables):
    order = SORTS["updated_desc"]()
    last = works.page_of(t.work, order, 1, 30).agg(F.min(F.struct("updated_at", "id")).alias("k"))
    key = F.struct("updated_at", "id")
    return works.page_after(t.work, order, key < last.scalar(), 30).select("id", "updated_at")


@query("T-05", sql=f"""SELECT id, status FROM work WHERE status <> 'matched' AND {_ORDINARY} AND NOT is_bundle AND {_NOT_BAD}
  ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'error' THEN 1 WHEN 'review' THEN 2 ELSE 3 END, id LIMIT 500""")
def match_queue(t: Tables):
    return works.match_queue(t.work, t.resource, 500).select("id", "status")


@query("T-07", sql="SELECT id, created_at FROM work ORDER BY created_at DESC, id DESC LIMIT 250")
def newest_batches(t: Tables):
    return works.page_of(t.work, [F.desc("created_at"), F.desc("id")], 1, 250).select("id", "created_at")


@query("A-15", sql=f"""SELECT 'year' AS facet, CAST({_YEAR} AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS label FROM work WHERE {_YEAR} IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'genre', CAST(g AS VARCHAR), label FROM (VALUES (16, 'Animation'), (99, 'Documentary'), (18, 'Drama')) v(g, label) WHERE EXISTS (SELECT 1 FROM work WHERE genres LIKE '%"id":' || g || ',%')
  UNION ALL SELECT 'country', c, NULL FROM (VALUES ('US'), ('JP'), ('FR'), ('CN')) v(c) WHERE EXISTS (SELECT 1 FROM work WHERE upper(countries) LIKE '%"' || c || '"%')""")
def facet_options(t: Tables):
    none = F.lit(None).cast("string")
    return (
        works.facet_years(t.work).select(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value"), none.alias("label"))
        .unionByName(works.facet_genres(t.work).select(F.lit("genre").alias("facet"), F.col("genre_id").cast("string").alias("value"), F.col("name").alias("label")))
        .unionByName(works.facet_countries(t.work).select(F.lit("country").alias("facet"), F.col("code").alias("value"), none.alias("label")))
    )


@query("A-25", sql=f"SELECT DISTINCT CAST(floor({_YEAR} / 10) * 10 AS INT) AS decade FROM work WHERE {_YEAR} IS NOT NULL")
def decades(t: Tables):
    return works.decades(t.work)


@query("A-19", sql=f"""SELECT c.id AS collection_id, any_value(c.title) AS title, COUNT(w.id) AS members, COUNT(w.id) FILTER (WHERE status = 'matched') AS matched,
  min({_YEAR.replace('year,', 'w.year,')}) AS first_year, max({_YEAR.replace('year,', 'w.year,')}) AS last_year,
  arg_min(poster, {{'a': status <> 'matched', 'i': w.id}}) FILTER (WHERE poster IS NOT NULL) AS poster
  FROM collection c LEFT JOIN work w ON w.collection_id = c.id GROUP BY c.id""")
def collection_list(t: Tables):
    return works.collection_list(t.collection, t.work)


@query("X-08", sql=f"""SELECT c.id AS collection_id, c.title AS collection_title, w.id AS work_id, w.title, {_YEAR} AS year, coalesce(n, 0) AS source_count, sample_label
  FROM collection c JOIN work w ON w.collection_id = c.id LEFT JOIN (SELECT work_id, COUNT(*) AS n, arg_min(raw_label, id) AS sample_label FROM resource GROUP BY 1) r ON r.work_id = w.id""")
def collection_members(t: Tables):
    return works.collection_members(t.collection, t.work, t.resource)


@query("W-03", sql="""SELECT work_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, id) AS rank FROM candidate) WHERE rank <= 12""")
def twelve_best_candidates(t: Tables):
    return works.best_candidates(t.candidate).select("work_id", "id", "score", "rank")


@query("W-02", sql="SELECT work_id, arg_min(id, {'s': -score, 'i': id}) AS id, max(score) AS score FROM candidate GROUP BY 1")
def best_candidate(t: Tables):
    return keyed.first_per_key(t.candidate, ["work_id"], [-F.col("score"), F.col("id")], ["id", "score"])


@query("W-04", sql="""SELECT work_id, max(score) AS leader, max(score) FILTER (WHERE k = 2) AS runner_up, round(max(score) - max(score) FILTER (WHERE k = 2), 4) AS gap
  FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, id) AS k FROM candidate) GROUP BY 1""")
def leader_gap(t: Tables):
    return keyed.leader_gap(t.candidate, ["work_id"], "score", [F.asc("id")])


@query("X-06", sql="WITH s AS (" + _SUMMARY.format(m="COUNT(*)", f="TRUE") + """),
  c AS (SELECT work_id, COUNT(*) AS candidates, max(score) AS best_score FROM candidate GROUP BY 1),
  m AS (SELECT coalesce(l.work_id, r.work_id) AS o, COUNT(DISTINCT message_id) AS messages FROM link l LEFT JOIN resource r ON r.source_key = l.source_key GROUP BY 1)
  SELECT work.id, title, coalesce(source_count, 0) AS source_count, coalesce(episode_count, 0) AS episode_count, max_season, coalesce(candidates, 0) AS candidates,
    best_score, coalesce(messages, 0) AS messages FROM work LEFT JOIN s ON s.work_id = work.id LEFT JOIN c ON c.work_id = work.id LEFT JOIN m ON m.o = work.id""")
def work_details(t: Tables):
    return works.work_summary(t.work, t.resource, t.candidate, t.link).select(
        "id", "title", "source_count", "episode_count", "max_season", "candidates", "best_score", "messages"
    )


@query("S-08", sql="""SELECT work.id, catalogue_id, work.title, r.id AS resource_id, r.url FROM work LEFT JOIN resource r ON r.work_id = work.id WHERE catalogue_id IS NOT NULL""")
def export_matched_works(t: Tables):
    chosen = t.work.filter(F.col("catalogue_id").isNotNull()).select("id", "catalogue_id", "title")
    return works.export_work(chosen, t.resource.select("id", "work_id", "url"))
