"""Text search, text store and scalar function queries."""

from pyspark.sql import functions as F

from ..functions import numeric, urls
from ..functions.text import collapse_blank_lines, like_literal, name_key, title_key, trim_unbalanced
from ..functions.udfs import json_leaves
from ..operators import coverage, extract, headings, search
from ..session import spread
from .bindings import Tables
from .registry import query

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("U-01", sql="""SELECT md5(text) AS text_id, COUNT(*) FILTER (WHERE s = 'd') AS n_documents, COUNT(*) FILTER (WHERE s = 'b') AS n_benchmark
  FROM (SELECT text, 'd' AS s FROM documents UNION ALL SELECT text, 'b' FROM benchmark) WHERE text IS NOT NULL GROUP BY text""")
def text_store(t: Tables):
    return search.distinct_texts(("documents", t.documents), ("benchmark", t.benchmark)).drop("text")


@query("X-01", sql=f"""SELECT gram, COUNT(*) AS texts FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram
  FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WHERE length(t) >= 3) GROUP BY 1""")
def gram_postings(t: Tables):
    return search.gram_lists(t.documents, "doc_id").groupBy("gram").agg(F.sum(F.size("keys")).alias("texts"))


_STORED: dict[tuple[str, str], search.Postings] = {}


def _postings(t: Tables) -> search.Postings:
    """The stored postings of the documents, made once in an application."""
    which = t.spark.sparkContext.applicationId, t.sf_dir
    if which not in _STORED:
        _STORED[which] = search.store_postings(t.documents, "doc_id")
    return _STORED[which]


@query("X-01", "X-02", sql=f"SELECT doc_id, n_chars FROM documents WHERE contains({_LOWER}, 'ation') AND contains({_LOWER}, 'enth')")
def gram_search(t: Tables):
    return _postings(t).search(t.documents, ["Ation", "enth"]).select("doc_id", "n_chars")


@query("X-01", "X-02", sql=f"SELECT doc_id, n_chars FROM documents WHERE contains({_LOWER}, 'été') AND contains({_LOWER}, 'Éta') OR contains({_LOWER}, 'tión')")
def accented_search(t: Tables):
    stored = _postings(t)
    both = stored.search(t.documents, ["été", "Éta"]).select("doc_id", "n_chars")
    return both.unionByName(stored.search(t.documents, ["TIón"]).select("doc_id", "n_chars")).distinct()


@query("X-02", sql=f"SELECT doc_id, n_chars FROM documents WHERE contains({_LOWER}, 'ou') AND contains({_LOWER}, 'ationer')")
def scan_search(t: Tables):
    return search.search(t.documents, "doc_id", ["ou", "ATIONER"]).select("doc_id", "n_chars")


@query("X-03", sql="""SELECT id, filename FROM resource r WHERE contains(lower(raw_label), ' r 1') OR contains(lower(coalesce(filename, '')), 'part10')
  OR EXISTS (SELECT 1 FROM work w WHERE w.id = r.work_id AND contains(lower(w.title), 'part 7'))
  OR EXISTS (SELECT 1 FROM link l JOIN message m ON m.id = l.message_id WHERE l.source_key = r.source_key AND contains(lower(m.raw_text), '\"k\": 77'))""")
def multi_field_search(t: Tables):
    r = t.resource
    works = t.work.filter(like_literal(F.col("title"), "part 7")).select(F.col("id").alias("work_id"))
    messages = t.message.filter(like_literal(F.col("raw_text"), '"k": 77')).select(F.col("id").alias("message_id"))
    keys = t.link.join(messages, "message_id", "left_semi").select("source_key")
    own = r.filter(like_literal(F.col("raw_label"), " r 1") | like_literal(F.col("filename"), "part10"))
    hits = [own.select("id"), r.join(works, "work_id", "left_semi").select("id"), r.join(keys, "source_key", "left_semi").select("id")]
    return search.any_field(r.select("id", "filename"), "id", hits)


@query("X-04", "J-10", sql="""SELECT id, status FROM message m WHERE contains(lower(raw_text), '\"k\": 9') OR EXISTS (
  SELECT 1 FROM link l LEFT JOIN resource r ON r.source_key = l.source_key LEFT JOIN work w ON w.id = coalesce(l.work_id, r.work_id)
  WHERE l.message_id = m.id AND (contains(lower(coalesce(r.raw_label, '')), 'label a 1') OR contains(lower(coalesce(w.title, '')), 'low part 1')))""")
def message_search(t: Tables):
    m, l = t.message, t.link
    labelled = t.resource.filter(like_literal(F.col("raw_label"), "label a 1")).select("source_key")
    titled = t.work.filter(like_literal(F.col("title"), "low part 1")).select(F.col("id").alias("_work"))
    owner = t.resource.select("source_key", F.col("work_id").alias("_owner"))
    owned = l.join(owner, "source_key", "left").withColumn("_work", F.coalesce("work_id", "_owner"))
    hits = [
        m.filter(like_literal(F.col("raw_text"), '"k": 9')).select("id"),
        l.join(labelled, "source_key", "left_semi").select(F.col("message_id").alias("id")),
        owned.join(titled, "_work", "left_semi").select(F.col("message_id").alias("id")),
    ]
    return search.any_field(m.select("id", "status"), "id", hits)


@query("X-09", sql="""SELECT m.id, json_extract_string(raw_text, '$.k') AS k, COUNT(l.message_id) AS links, coalesce(string_agg(l.status, ',' ORDER BY l.status), '') AS statuses
  FROM message m LEFT JOIN link l ON l.message_id = m.id GROUP BY m.id, raw_text""")
def message_details(t: Tables):
    links = t.link.groupBy("message_id").agg(F.count(F.lit(1)).alias("links"), F.array_join(F.sort_array(F.collect_list("status")), ",").alias("statuses"))
    m = t.message.select("id", F.get_json_object("raw_text", "$.k").alias("k"))
    return m.join(links, m.id == links.message_id, "left").select("id", "k", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("statuses", F.lit("")).alias("statuses"))


@query("F-01", "F-02", "F-15", "F-16", "U-UDF-2", sql="""SELECT doc_id, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')) AS title_key,
    md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\t\\n\\v\\f\\r ]+', ' ', 'g'))) AS name_key, sha256(text) AS digest,
    md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS tidy
  FROM documents""")
def text_identities(t: Tables):
    text = F.col("text")
    return t.documents.select(
        "doc_id", F.md5(title_key(text)).alias("title_key"), F.md5(name_key(text)).alias("name_key"), F.sha2(text, 256).alias("digest"),
        F.md5(collapse_blank_lines(text)).alias("tidy"),
    )


@query("F-11", "F-12", sql="""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host,
    nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment,
    url_decode(replace(url, '.', '%2E')) AS decoded FROM pages""")
def url_parts(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id", urls.host(url).alias("host"), urls.query_value(url, ("page",)).alias("page"), urls.fragment(url).alias("fragment"),
        urls.decoded(F.replace(url, F.lit("."), F.lit("%2E"))).alias("decoded"),
    )


@query("F-08", "F-09", "F-10", "F-17", "F-19", "U-UDF-4", sql="""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_type(props) AS kind,
    least(3600, 30 * CAST(power(2, least(greatest(CAST(json_extract_string(props, '$.k') AS INT) % 12 - 1, 0), 6)) AS BIGINT)) AS wait,
    round(least(ln(1 + greatest(value, 0)) / 100, 0.025), 6) AS bonus, concat(event_type, ' ', user_id) AS leaves FROM events""")
def event_values(t: Tables):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    nested = F.to_json(F.struct(F.struct(F.array("event_type").alias("b"), F.col("user_id").alias("c")).alias("a"), F.col("user_id").cast("string").alias("d")))
    kind = F.when(F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT"), "OBJECT").otherwise("OTHER")
    return t.events.select(
        "event_id", k.alias("k"), kind.alias("kind"), numeric.backoff_seconds(k % 12).alias("wait"),
        F.round(numeric.popularity_bonus(F.col("value")), 6).alias("bonus"), json_leaves(nested).alias("leaves"),
    )


@query("F-18", sql="""SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN '（' || p_name || '）' WHEN 4 THEN '(a) ' || p_name ELSE p_name END AS title FROM part""")
def unbalanced_titles(t: Tables):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    made = (
        F.when(k == 0, F.concat(F.lit("(( "), name, F.lit(" ["))).when(k == 1, F.concat(name, F.lit("]_】"))).when(k == 2, F.concat(F.lit("（"), name, F.lit("）")))
        .when(k == 3, F.concat(F.lit("[( -"), name, F.lit(" （【"))).otherwise(F.concat(F.lit("(a) "), name, F.lit("】")))
    )
    return t.part.select("p_partkey", trim_unbalanced(made).alias("title"))


@query("E-17", "F-23", sql="""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN CASE WHEN p_size >= 10 THEN p_name || '卷' END WHEN 2 THEN NULL ELSE p_name END AS base FROM part""")
def search_bases(t: Tables):
    k, name, size = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_size").cast("string")
    made = (
        F.when(k == 0, F.concat(name, F.lit(" 更新至"), size, F.lit("集 4K 蓝光"))).when(k == 1, F.concat(name, F.lit(" EP"), size, F.lit(" 第"), size, F.lit("话 HDR10+ 1080p EP1 E2 E3 E4")))
        .when(k == 2, name).otherwise(F.concat(name, F.lit("卷 "), size))
    )
    return spread(t.part).select("p_partkey", headings.strip_search_noise(made, F.lit(False)).alias("base"))


@query("E-01", sql="""SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents)""")
def text_lines(t: Tables):
    return extract.explode_lines(t.documents, "doc_id")


@query("W-05", "W-06", sql="""WITH l AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents))
  SELECT doc_id, CAST(n AS INT) AS line_no, last_value(CASE WHEN length(line) BETWEEN 1 AND 30 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading,
    lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next_line FROM l""")
def nearest_headings(t: Tables):
    lines = extract.explode_lines(t.documents, "doc_id")
    return extract.nearest_heading(lines, ["doc_id"], "line_no", "line", F.length("line").between(1, 30)).drop("line")


_POST = """WITH p AS (SELECT id, string_split(text, chr(10)) AS l FROM post),
  q AS (SELECT id, l[1] AS h, l[1] || chr(10) || l[2] AS block, regexp_extract(l[3], '^(.*?)https', 1) AS label, regexp_extract(l[3], '(https.*)$', 1) AS link, regexp_extract(l[4], '：(.*)$', 1) AS code FROM p)"""


@query("E-02", "E-03", "E-04", "F-22", sql=_POST + """SELECT id, provider || ':' || url AS source_key, provider, url, trim(label) AS label,
    CASE WHEN trim(label) = 'Own label' THEN NULL ELSE block END AS context,
    provider || '/' || regexp_extract(url, '/s/([^?]*)', 1) || '/' || regexp_extract(url, '=(.*)$', 1) AS identity
  FROM (SELECT *, CASE WHEN link LIKE '%115.com%' THEN '115' ELSE '123' END AS provider,
    CASE WHEN link LIKE '%115.com%' THEN rtrim(link, '#') ELSE link || '?pwd=' || code END AS url FROM q)""")
def link_rows(t: Tables):
    links = extract.extract_links(t.post)
    who = urls.share_identity(F.col("url"))
    return links.select("id", "source_key", "provider", "url", "label", "context", F.concat_ws("/", who["provider"], who["code"], who["password"]).alias("identity"))


@query("E-05", "E-06", "E-07", "E-08", "F-03", "F-04", "F-21", sql=_POST + """SELECT id, trim(regexp_replace(regexp_extract(h, '(Work \\d+)', 1), '(1080|2160|720).*$', '')) AS title, CAST(regexp_extract(h, '\\((\\d{4})\\)', 1) AS INT) AS year,
    CASE WHEN h LIKE '%电影%' THEN NULL ELSE CAST(regexp_extract(h, 'S(\\d+)', 1) AS INT) END AS season, CASE WHEN h LIKE '%电影%' THEN NULL ELSE CAST(regexp_extract(h, 'E(\\d+)', 1) AS INT) END AS episode,
    CASE WHEN h LIKE '%电影%' THEN 'movie' ELSE 'tv' END AS media_type, CASE WHEN h LIKE '%电影%' THEN '2160P' ELSE '1080P' END AS quality,
    CASE WHEN h LIKE '%电影%' THEN '2160p,H.265,Dolby Vision' ELSE '1080p,H.264' END AS tags, CASE WHEN h LIKE '%电影%' THEN 'HEVC' ELSE 'X264' END AS codec, CASE WHEN h LIKE '%电影%' THEN 'DV' END AS hdr,
    regexp_extract(block, '：(\\d)', 1) AS rating FROM q""")
def parsed_headings(t: Tables):
    blocks = spread(t.post).withColumn("block", F.regexp_extract("text", r"^([^\n]*\n[^\n]*)", 1))
    first = blocks.withColumn("h", F.split_part("block", F.lit("\n"), F.lit(1)))
    out = headings.parse_headings(first, "h")
    return out.select(
        "id", "title", "year", "season", "episode", "media_type", "quality", F.array_join("quality_tags", ",").alias("tags"), "codec", "hdr",
        F.try_element_at(extract.labelled_fields(F.col("block")), F.lit("rating")).alias("rating"),
    )


@query("E-11", sql="""SELECT p_partkey, CAST(unnest([p_partkey, p_partkey + 100000, p_partkey + 200000]) AS BIGINT) AS catalogue_id, unnest(['movie', 'tv', NULL]) AS media_type FROM part""")
def explicit_ids(t: Tables):
    n = F.col("p_partkey")
    text = F.concat(
        F.lit("tmdbid="), n.cast("string"), F.lit(" x tv TMDB: "), (n + 100000).cast("string"), F.lit(" https://www.themoviedb.org/movie/"), n.cast("string"),
        F.lit("?a=1 {tmdb-"), (n + 200000).cast("string"), F.lit("}"),
    )
    return extract.explicit_ids(t.part.withColumn("text", text), ["p_partkey"], "text").select("p_partkey", "catalogue_id", "media_type")


_OWNED = """o AS (SELECT l.message_id, coalesce(l.work_id, r.work_id) AS work_id, r.season, r.season_end, r.episode, CASE WHEN r.quality = '2160p' THEN r.episode + 2 END AS episode_end
    FROM link l LEFT JOIN (SELECT DISTINCT source_key, work_id, season, season_end, episode, quality FROM resource) r USING (source_key)),
  d AS (SELECT DISTINCT * FROM o WHERE work_id IS NOT NULL), n AS (SELECT * FROM d WHERE season IS NOT NULL AND episode IS NOT NULL),
  p AS (SELECT DISTINCT message_id, work_id, season AS a, season_end AS b FROM d WHERE season_end > season),
  c AS (SELECT message_id, work_id, unnest(generate_series(a, b)) AS season FROM p UNION SELECT message_id, work_id, season FROM n),
  w AS (SELECT DISTINCT message_id, work_id, season FROM d WHERE season IS NOT NULL AND episode IS NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.message_id = d.message_id AND c.work_id = d.work_id AND c.season = d.season)),
  i AS (SELECT message_id, work_id, min(season) AS a, max(season) AS b FROM (SELECT *, season - row_number() OVER (PARTITION BY message_id, work_id ORDER BY season) AS g FROM w) GROUP BY message_id, work_id, g),
  t AS (SELECT message_id, work_id, CASE WHEN episode_end > episode THEN 0 ELSE 1 END AS k, season AS x, episode AS y, coalesce(episode_end, 0) AS z,
      'S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || CASE WHEN episode_end > episode THEN '-E' || lpad(CAST(episode_end AS VARCHAR), 2, '0') ELSE '' END AS label FROM n
    UNION SELECT message_id, work_id, 2, a, b, 0, 'S' || a || '-S' || b FROM p UNION SELECT message_id, work_id, 3, a, 0, 0, CASE WHEN a = b THEN 'S' || a ELSE 'S' || a || '-S' || b END FROM i),
  g AS (SELECT message_id, work_id, string_agg(label, ' · ' ORDER BY k, x, y, z) AS labels FROM t GROUP BY ALL), q AS (SELECT DISTINCT message_id, work_id FROM d)"""


@query("X-05", "J-09", sql=f"""WITH {_OWNED} SELECT q.message_id, q.work_id, coalesce(catalogue_title, title) || coalesce('（' || year || '）', '') || coalesce(' · ' || labels, '') AS display
  FROM q JOIN work ON work.id = q.work_id LEFT JOIN g ON g.message_id = q.message_id AND g.work_id = q.work_id""")
def message_works(t: Tables):
    r = t.resource.select(
        "source_key", F.struct(F.col("work_id").alias("_owner"), "season", "season_end", "episode", F.when(F.col("quality") == "2160p", F.col("episode") + 2).alias("episode_end")).alias("_r")
    ).groupBy("source_key").agg(F.collect_set("_r").alias("_rows")).select("source_key", F.explode("_rows").alias("_r")).select("source_key", "_r.*")  # distinct rows, shuffled by the key alone
    owned = t.link.select("source_key", "message_id", "work_id").join(r, "source_key", "left").withColumn("work_id", F.coalesce("work_id", "_owner")).filter(F.col("work_id").isNotNull())
    labels = coverage.owner_labels(owned, ["message_id", "work_id"])
    title = F.concat(
        F.coalesce("catalogue_title", "title"), F.coalesce(F.concat(F.lit("（"), F.col("year").cast("string"), F.lit("）")), F.lit("")), F.coalesce(F.concat(F.lit(" · "), "labels"), F.lit(""))
    )
    pairs = owned.select("message_id", "work_id").distinct().join(labels, ["message_id", "work_id"], "left")
    return pairs.join(t.work.select(F.col("id").alias("work_id"), "catalogue_title", "title", "year"), "work_id").select("message_id", "work_id", title.alias("display"))
