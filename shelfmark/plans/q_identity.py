"""Queries of page expansion, identity by names and directories, evidence, terms and change sets."""

from pyspark.sql import functions as F

from ..operators import attribution, evidence, fallbacks, identify, pages, search, terms
from ..session import spread, written
from ..sources import intake
from ..streaming import chain, retries
from ..streaming import messages as streams
from .bindings import ROLES, Tables
from . import q_resolve  # noqa: F401
from .registry import QUERIES, query

# --- pages ----------------------------------------------------------------------------------------

_HREFS = """p AS (SELECT regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS lang, list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1), lambda h: 'https://telegra.ph' || h) AS l FROM pages)"""


@query("E-10", sql=f"""WITH RECURSIVE {_HREFS}, e AS (SELECT DISTINCT l[1] AS url, unnest(l[2:]) AS leads FROM p), s AS (SELECT lang AS id, min(l[1]) AS url FROM p WHERE len(l) > 0 GROUP BY 1),
  r AS (SELECT id, url FROM s UNION SELECT r.id, e.leads FROM r JOIN e ON e.url = r.url)
  SELECT id, url, url IN (SELECT l[1] FROM p) AS stored FROM r""")
def expanded_pages(t: Tables):
    hrefs = F.transform("links", lambda h: F.concat(F.lit("https://telegra.ph"), h))
    p = intake.page_fields(t.pages).select(F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("lang"), hrefs.alias("l")).filter("size(l) > 0")
    graph = p.select(F.element_at("l", 1).alias("url"), F.expr("slice(l, 2, size(l))").alias("links"))
    starts = p.groupBy(F.col("lang").alias("id")).agg(F.min(F.element_at("l", 1)).alias("url")).withColumn("ord", F.lit(0))
    stored = graph.select("url").distinct().withColumn("_stored", F.lit(True))
    return pages.reached(starts, graph).join(stored, "url", "left").select("id", "url", F.coalesce("_stored", F.lit(False)).alias("stored"))


# --- names and directories ------------------------------------------------------------------------

_NAMES = """case p_partkey % 10 when 0 then concat('Show S02E', cast(p_size as string), ' x') when 1 then concat('Show 1x', cast(p_size as string), ' y') when 2 then 'S3'
 when 3 then concat('Show Season 2 Ep ', cast(p_size as string), ' z') when 4 then 'Show 第十二季 第一百零三集' when 5 then 'Show 2024-01-05 talk' when 6 then concat('Show OVA', cast(p_size as string), ' x')
 when 7 then concat('Show [', cast(p_size as string), 'v] S09E09') when 8 then concat('Show e', cast(p_size as string), ' x') else p_name end"""
_EPISODE_RULES = (
    identify.EpisodeRule("(.*)", enabled=False), identify.EpisodeRule(r"(no number)"), identify.EpisodeRule(r"\[(\d+)v\]", default_season=4), identify.EpisodeRule(r"(\d+)v", default_season=7),
)


@query("E-14", "F-06", sql="""SELECT p_partkey, CAST(CASE p_partkey % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 12 WHEN 6 THEN 0 WHEN 7 THEN 4 END AS INT) AS season,
  CAST(CASE p_partkey % 10 WHEN 4 THEN 103 WHEN 5 THEN 20240105 WHEN 2 THEN NULL WHEN 9 THEN NULL ELSE p_size END AS INT) AS episode,
  CASE p_partkey % 10 WHEN 0 THEN 'sxe' WHEN 1 THEN 'season_episode_x' WHEN 2 THEN 'season_word' WHEN 3 THEN 'season_word,episode_word' WHEN 4 THEN 'season_zh,episode_zh' WHEN 5 THEN 'episode_date'
    WHEN 6 THEN 'special,episode_special_code' WHEN 7 THEN 'episode_regex' WHEN 8 THEN 'episode_e' ELSE '' END AS evidence FROM part""")
def structured_episodes(t: Tables):
    found = t.part.select("p_partkey", F.expr(_NAMES).alias("name")).select("p_partkey", identify.structured_episode(F.col("name"), _EPISODE_RULES).alias("e"))
    return found.select("p_partkey", "e.season", "e.episode", F.array_join("e.evidence", ",").alias("evidence"))


#: A number of its own for each line of an order.
_LINE = "((l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey)"
_FILE = f"(l_orderkey * 100000000000 + {_LINE})"
_FILES = (
    f"{_FILE} as id", f"{_FILE} as ord", "concat('D', cast(l_suppkey as string)) as directory", "case when l_returnflag = 'N' then null else 2000 end as year",
    "case when l_linestatus = 'O' then 'tv' else 'movie' end as media_type", "case when l_tax = 0.0 then l_partkey else null end as explicit_id",
)


@query("R-22", sql=f"""WITH f AS (SELECT {', '.join(_FILES)}, l_partkey AS k, l_discount, l_quantity / 50.0 AS c1, l_quantity / 50.0 - 0.03 * l_linenumber AS c2 FROM lineitem),
  o AS (SELECT *, CASE WHEN explicit_id IS NOT NULL THEN 'explicit' WHEN l_discount = 0.05 THEN 'official_collection_part' ELSE 'variants' END AS tier,
    CASE WHEN explicit_id IS NULL AND l_discount = 0.05 THEN k + 100000 ELSE k END AS own, CASE WHEN explicit_id IS NOT NULL THEN 0.99 WHEN l_discount = 0.05 THEN 0.97 ELSE c1 END AS c FROM f),
  m AS (SELECT *, tier <> 'variants' OR (c1 >= 0.9 AND c1 - c2 >= 0.08) AS matched, media_type = 'tv' AS shares FROM o),
  b AS (SELECT *, min(CASE WHEN matched AND shares THEN ord END) OVER (PARTITION BY directory, year) AS founder FROM m),
  h AS (SELECT *, last_value(CASE WHEN shares AND (ord = founder OR tier = 'explicit') THEN {{'i': own, 'c': c}} END IGNORE NULLS) OVER (PARTITION BY directory, year ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b),
  s AS (SELECT *, shares AND tier <> 'explicit' AND held IS NOT NULL AS shared FROM h)
  SELECT id, CAST(CASE WHEN shared THEN held.i ELSE own END AS BIGINT) AS catalogue_id, CASE WHEN shared THEN 'series_batch_identity' ELSE tier END AS tier, CAST(CASE WHEN shared THEN held.c ELSE c END AS DOUBLE) AS confidence,
    CASE WHEN shared OR matched THEN 'matched' ELSE 'review' END AS status FROM s""")
def file_cascade(t: Tables):
    files = t.lineitem.selectExpr(*_FILES)
    key, sure = f"{_FILE} as id", "l_quantity / 50.0"
    parts = t.lineitem.filter("l_discount = 0.05").selectExpr(key, "l_partkey + 100000 as catalogue_id")
    hits = t.lineitem.selectExpr(key, "l_partkey as catalogue_id", f"{sure} as confidence", "false as exact").unionByName(
        t.lineitem.selectExpr(key, "l_partkey + 1 as catalogue_id", f"{sure} - 0.03 * l_linenumber as confidence", "false as exact")
    )
    return identify.cascade(files, parts, hits, 0.9, 0.08, block=10_000 * 100_000_000_000)


# --- what messages state --------------------------------------------------------------------------

_N = "cast(o_custkey % 900 as string)"
_SAID = f"""case o_custkey % 6 when 0 then concat('名称：Work ', {_N}, chr(10), '发行时间：1995-03-01', chr(10), '#电影') when 1 then concat('📺 Work ', {_N}, ' 2003', chr(10), 'more') when 2 then concat('Work ', {_N}, ' 2003')
 when 3 then concat('名称：电影', chr(10), '年份: 2003') when 4 then concat('片名: Work ', {_N}, ' 第二季', chr(10), '年份: 2001', chr(10), '类型：电视剧') else null end"""


@query("E-15", sql="""SELECT o_orderkey AS id, CASE WHEN k IN (0, 1, 4) THEN 'Work ' || n END AS title, CAST(CASE k WHEN 0 THEN 1995 WHEN 1 THEN 2003 WHEN 4 THEN 2001 END AS INT) AS year, CAST(CASE WHEN k = 4 THEN 2 END AS INT) AS season,
  CASE k WHEN 0 THEN 'movie' WHEN 4 THEN 'tv' END AS media_type FROM (SELECT o_orderkey, o_custkey % 6 AS k, o_custkey % 900 AS n FROM orders)""")
def stated_messages(t: Tables):
    said = evidence.stated(t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_SAID).alias("text")))
    return said.select("id", "said.title", "said.year", "said.season", "said.media_type")


_CANDIDATES = f"""c AS (SELECT l_orderkey AS work_id, {_LINE} AS catalogue_id, l_linenumber % 3 <> 2 AS exact, year(o_orderdate) + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END = year(o_orderdate) AS dated,
    CASE WHEN l_linenumber % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type, l_discount AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query("R-21", "R-20", "M-16", sql=f"""WITH {_CANDIDATES}, w AS (SELECT o_orderkey AS work_id, CASE WHEN o_custkey % 2 = 0 THEN 'movie' END AS said, CASE o_custkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'unknown' END AS own FROM orders
    WHERE o_orderstatus = 'P' AND o_custkey % 7 <> 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0.0)),
  n AS (SELECT work_id, COUNT(*) FILTER (WHERE media_type = said) AS n1, min(catalogue_id) FILTER (WHERE media_type = said) AS c1, COUNT(*) FILTER (WHERE media_type = own) AS n2, min(catalogue_id) FILTER (WHERE media_type = own) AS c2, COUNT(*) AS n3, min(catalogue_id) AS c3
    FROM w JOIN c USING (work_id) WHERE exact AND dated GROUP BY 1),
  s AS (SELECT work_id, CASE WHEN n1 = 1 THEN c1 WHEN n2 = 1 THEN c2 WHEN n3 = 1 THEN c3 END AS catalogue_id, CASE WHEN n1 = 1 THEN 'stated_type' WHEN n2 = 1 THEN 'own_type' WHEN n3 = 1 THEN 'any_type' END AS selected_by FROM n)
  SELECT work_id, catalogue_id, selected_by, score FROM s JOIN c USING (work_id, catalogue_id)""")
def confirmed_reviews(t: Tables):
    o, name = t.orders, F.concat(F.lit("Work "), F.expr(_N))
    works = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("work"), F.expr(_N)).alias("title_key"), F.when(F.col("o_orderstatus") == "P", "review").otherwise("pending").alias("status"),
        F.expr("case o_custkey % 3 when 0 then 'movie' when 1 then 'tv' else 'unknown' end").alias("media_type"),
    )
    said = F.concat(F.lit("名称："), F.when(F.col("o_custkey") % 7 == 0, F.lit("Other")).otherwise(name), F.lit("\n年份："), F.year("o_orderdate").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "\n#电影").otherwise(""))
    messages = o.select(F.col("o_orderkey").alias("id"), said.alias("text"))
    key = F.expr(f"cast({_FILE} as string)")
    resources = t.lineitem.select(F.col("l_orderkey").alias("work_id"), key.alias("source_key"))
    links = t.lineitem.filter("l_discount <> 0.0").select(F.col("l_orderkey").alias("message_id"), key.alias("source_key"))
    titles = t.lineitem.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("work_id"), F.expr(_LINE).alias("catalogue_id"), F.concat(name, F.when(F.col("l_linenumber") % 3 == 2, " Extra").otherwise("")).alias("title"),
        F.concat(F.lit("work"), F.expr(_N), F.when(F.col("l_linenumber") % 3 == 2, "extra").otherwise("")).alias("title_key"),
        (F.year("o_orderdate") + F.when(F.col("l_linenumber") == 4, 1).otherwise(0)).alias("year"), F.when(F.col("l_linenumber") % 2 == 0, "movie").otherwise("tv").alias("media_type"), F.col("l_discount").alias("score"),
    )
    return evidence.confirmed(works, resources, links, messages, titles)


_FLAG_SIDES = """w AS (SELECT o_orderkey AS work_id, o_custkey AS c, CASE WHEN o_custkey % 4 = 0 THEN '作品' || n ELSE 'work' || n END AS own, o_custkey % 4 = 0 AS cjk, CASE o_custkey % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'unknown' END AS own_type, o_custkey % 5 = 0 AS episodic,
    o_orderpriority <> '4-NOT SPECIFIED' AS dated, y, o_custkey % 2 = 0 AS structured, o_custkey % 7 = 0 AS tv_files, o_custkey % 11 = 0 AS mixed, CASE WHEN o_custkey % 6 = 0 THEN 'alias' || n END AS alias, n
    FROM (SELECT *, CAST(o_custkey % 900 AS VARCHAR) AS n, year(o_orderdate) AS y FROM orders))"""


def _flag_tables(t: Tables):
    o, n = t.orders, F.expr(_N)
    title = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("作品"), n)).otherwise(F.concat(F.lit("Work "), n))
    year = F.year("o_orderdate")
    works = o.select(
        F.col("o_orderkey").alias("work_id"), title.alias("title"), F.expr("case o_custkey % 3 when 0 then 'movie' when 1 then 'tv' else 'unknown' end").alias("media_type"), (F.col("o_custkey") % 5 == 0).alias("episodic"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.array(year, year + 1)).alias("years"), (F.col("o_custkey") % 2 == 0).alias("structured_type"),
        F.when(F.col("o_custkey") % 7 == 0, "tv").otherwise("unknown").alias("resource_kind"), (F.col("o_custkey") % 11 == 0).alias("resource_mixed"),
    )
    local = o.select(F.col("o_orderkey").alias("work_id"), F.explode(F.array(title, F.when(F.col("o_custkey") % 6 == 0, F.concat(F.lit("Alias "), n)))).alias("title"))
    each = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("work_id", F.col("o_orderkey"))
    named = each.filter("l_returnflag <> 'N'").select("work_id", F.expr(_LINE).alias("resource"), F.when(F.col("l_returnflag") == "A", title).otherwise("Other").alias("title"))
    kind = F.col("l_partkey") % 3
    known = F.when(kind == 0, title).when(kind == 1, F.concat(F.lit("Alias "), n)).otherwise("Cand")
    candidates = each.select(
        "work_id", F.expr(_LINE).alias("catalogue_id"), F.when(F.col("l_linestatus") == "O", "tv").otherwise("movie").alias("media_type"), F.array(known).alias("titles"), (kind == 1).alias("latin_original"),
        F.when(F.col("l_partkey") % 5 != 0, F.year("l_shipdate")).alias("year"), F.lit(False).alias("explicit"), F.lit(False).alias("derived"), (F.col("l_partkey") % 2 == 0).alias("verified"),
    )
    return candidates, works, local, named


@query("R-14", sql=f"""WITH {_FLAG_SIDES}, r AS (SELECT l_orderkey AS work_id, bool_or(l_returnflag = 'R') AS other, bool_or(l_returnflag = 'A') AS named FROM lineitem GROUP BY 1),
  k AS (SELECT l_orderkey AS work_id, {_LINE} AS catalogue_id, CASE WHEN l_linestatus = 'O' THEN 'tv' ELSE 'movie' END AS media_type, l_partkey % 3 AS kind, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE year(l_shipdate) END AS year, l_partkey % 2 = 0 AS verified FROM lineitem),
  t AS (SELECT k.*, w.*, list_value(CASE kind WHEN 0 THEN own WHEN 1 THEN 'alias' || n ELSE 'cand' END) AS theirs, kind = 1 AS latin, coalesce(other, false) AS other, coalesce(named, false) AS named FROM k JOIN w USING (work_id) LEFT JOIN r USING (work_id)),
  f AS (SELECT work_id, catalogue_id, media_type, list_contains(theirs, own) AS primary_exact, list_contains(theirs, own) OR coalesce(list_contains(theirs, alias), false) AS exact,
    cjk AND alias IS NOT NULL AND latin AND NOT list_contains(theirs, alias) AS name_conflict, episodic AND media_type <> 'tv' AS type_conflict, structured AND own_type <> 'unknown' AND media_type <> own_type AS type_mismatch,
    dated AND year IS NOT NULL AND year NOT IN (y, y + 1) AS year_conflict, dated AND year IS NULL AS year_unverified, NOT dated AS year_missing, mixed OR (tv_files AND media_type <> 'tv') AS resource_conflict,
    (other OR (named AND NOT list_contains(theirs, own))) AND (other OR named) AS disagrees, verified FROM t)
  SELECT work_id, catalogue_id, media_type, primary_exact, exact, name_conflict, type_conflict, type_mismatch, year_conflict, year_unverified, year_missing, resource_conflict, disagrees AND verified AS resource_name_conflict,
    disagrees AND NOT verified AND exact AS resource_name_unverified,
    name_conflict OR type_conflict OR type_mismatch OR year_conflict OR year_unverified OR resource_conflict OR (disagrees AND (verified OR exact)) AS blocked FROM f""")
def evidence_flags(t: Tables):
    return evidence.evidence_flags(*_flag_tables(t)).drop("titles", "latin_original", "year", "explicit", "derived", "verified", "derived_only")


@query("R-12", "R-14", "R-15", "R-16", "U-UDF-1")
def decided_works(t: Tables):
    candidates, *others = _flag_tables(t)
    scored = evidence.scored_candidates(candidates.withColumn("popularity", F.lit(1.0)), *others)
    return evidence.decisions(scored, F.lit(False))


# --- terms ----------------------------------------------------------------------------------------

_TERMS = """t AS (SELECT p_partkey AS work_id, 0 AS s, 0 AS place, p_name AS title, CAST(1990 + p_size AS INT) AS year FROM part UNION ALL SELECT p_partkey, 1, 0, CASE WHEN p_partkey % 9 = 0 THEN '资源' ELSE upper(p_name) END, NULL FROM part
    UNION ALL SELECT p_partkey, 2, k, 'File ' || k || ' of ' || p_name, NULL FROM (SELECT p_partkey, p_name, unnest(range(p_partkey % 6)) AS k FROM part) UNION ALL SELECT p_partkey, 3, 0, p_brand, NULL FROM part),
  r AS (SELECT l_partkey AS work_id, bool_or(l_tax = 0.0 AND l_returnflag = 'R') AS numbered, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_returnflag END) > 1 AS differ FROM lineitem GROUP BY 1),
  w AS (SELECT p_partkey AS work_id, p_partkey % 9 = 0 OR p_partkey % 8 = 0 OR coalesce(numbered, false) OR coalesce(differ, false) AS from_files FROM part LEFT JOIN r ON r.work_id = p_partkey)"""


@query("R-10", "U-05", sql=f"""WITH {_TERMS}, f AS (SELECT * FROM (SELECT t.*, CASE WHEN s <= 1 OR from_files THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY work_id, lower(title), year ORDER BY s, place) AS k FROM t JOIN w USING (work_id)) WHERE k = 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY tier, s, place, lower(title)) AS n FROM f)
  SELECT work_id, CAST(CASE WHEN n <= 4 THEN n END AS INT) AS ord, title, year, CAST(tier AS INT) AS tier, CASE s WHEN 0 THEN 'heading' WHEN 1 THEN 'title' WHEN 2 THEN 'filename' ELSE 'label' END AS source,
    CASE WHEN n > 4 THEN 'unused' WHEN tier = 0 THEN 'active' ELSE 'spare' END AS use FROM o""")
def search_terms(t: Tables):
    p = t.part.withColumn("work_id", F.col("p_partkey"))
    named = F.when(F.col("p_partkey") % 9 == 0, "资源").otherwise(F.upper("p_name"))
    none = F.lit(None).cast("int")
    tables = {
        "heading": p.select("work_id", F.lit(0).alias("place"), F.col("p_name").alias("title"), (F.col("p_size") + 1990).alias("year")), "title": p.select("work_id", F.lit(0).alias("place"), named.alias("title"), none.alias("year")),
        "filename": p.filter("p_partkey % 6 > 0").select("work_id", "p_name", F.explode(F.expr("sequence(0L, p_partkey % 6 - 1)")).alias("place")).select("work_id", "place", F.concat(F.lit("File "), F.col("place").cast("string"), F.lit(" of "), "p_name").alias("title"), none.alias("year")),
        "label": p.select("work_id", F.lit(0).alias("place"), F.col("p_brand").alias("title"), none.alias("year")),
    }
    works = p.select("work_id", named.alias("title"), F.when(F.col("p_partkey") % 8 == 0, F.col("p_partkey")).alias("collection_id"))
    resources = t.lineitem.select(F.col("l_partkey").alias("work_id"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("file_key"), none.alias("season"), F.when((F.col("l_tax") == 0.0) & (F.col("l_returnflag") == "R"), F.col("l_linenumber")).alias("episode"))
    return terms.search_terms(terms.term_union(tables, terms.identity_in_files(works, resources)))


# --- change sets ----------------------------------------------------------------------------------

_PERSON_WORKS = "w AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'name' || (id % 40) ELSE 'work' || id END AS title_key, id % 10 = 0 AS person, id % 7 = 0 AS confirmed FROM (SELECT DISTINCT p_partkey // 3 AS id FROM part))"


def _person_tables(t: Tables):
    works = t.part.select(F.floor(F.col("p_partkey") / 3).cast("bigint").alias("id")).distinct().select(
        "id", F.expr("case when id % 10 = 0 then concat('name', cast(id % 40 as string)) else concat('work', cast(id as string)) end").alias("title_key"), F.expr("if(id % 10 = 0, 'person', 'media')").alias("resource_kind"),
        F.expr("if(id % 7 = 0, 'matched', 'pending')").alias("status"), F.lit(None).cast("bigint").alias("catalogue_id"), F.expr("if(id % 2 = 0, 'unknown', 'tv')").alias("media_type"), F.lit(None).cast("int").alias("year"),
    )
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    return works, t.part.select(F.col("p_partkey").alias("id"), key.alias("source_key"), F.floor(F.col("p_partkey") / 3).cast("bigint").alias("work_id"), F.lit("media").alias("resource_class"), F.col("p_size").alias("size"))


@query("M-10", sql=f"""WITH {_PERSON_WORKS}, m AS (SELECT o_orderkey AS message_id, o_orderdate AS sent, 'name' || (o_custkey % 60) AS person_key FROM orders WHERE o_custkey % 5 = 0),
  s AS (SELECT title_key AS person_key, min(id) AS stored FROM w WHERE person GROUP BY 1), n AS (SELECT p_partkey // 3 AS id, COUNT(*) AS total FROM part GROUP BY 1),
  h AS (SELECT DISTINCT message_id, sent, person_key, stored, l_partkey AS res, l_partkey // 3 AS work_id FROM lineitem JOIN m ON m.message_id = l_orderkey LEFT JOIN s USING (person_key)),
  e AS (SELECT message_id, sent, person_key, stored, bool_or(confirmed AND work_id IS DISTINCT FROM stored) AS barred, min(work_id) AS low, max(work_id) AS high, COUNT(*) AS got, min(total) AS total FROM h JOIN w ON w.id = h.work_id JOIN n ON n.id = h.work_id GROUP BY ALL HAVING NOT barred),
  p AS (SELECT person_key, coalesce(CAST(min(stored) AS VARCHAR), CAST(min(CASE WHEN low = high AND total = got THEN low END) AS VARCHAR), 'new ' || person_key) AS owner FROM e GROUP BY 1),
  l AS (SELECT res, arg_max(owner, (sent, message_id)) AS owner FROM h JOIN e USING (message_id, sent, person_key) JOIN p USING (person_key) GROUP BY 1),
  g AS (SELECT res // 3 AS id, COUNT(*) AS gone FROM l WHERE owner <> CAST(res // 3 AS VARCHAR) GROUP BY 1)
  SELECT 'move' AS change, res AS id, owner FROM l UNION ALL SELECT 'remove', g.id, '' FROM g JOIN n ON n.id = g.id AND gone = total JOIN w ON w.id = g.id WHERE NOT confirmed AND CAST(g.id AS VARCHAR) NOT IN (SELECT owner FROM l)""")
def person_attribution(t: Tables):
    works, resources = _person_tables(t)
    profile = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("👤 Name "), (F.col("o_custkey") % 60).cast("string"), F.lit("！")))
    messages = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("received_at"), profile.alias("profile"))
    links = t.lineitem.select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("source_key"))
    made = attribution.person_attribution(messages, links, resources, works)
    new = made["created"].select(F.col("id").alias("work_id"), F.concat(F.lit("new "), "title_key").alias("_new"))
    moves = made["resources"].join(new, "work_id", "left").select(F.lit("move").alias("change"), "id", F.coalesce("_new", F.col("work_id").cast("string")).alias("owner"))
    return moves.unionByName(made["removed"].select(F.lit("remove").alias("change"), "id", F.lit("").alias("owner")))


@query("R-04", sql=f"""WITH {_PERSON_WORKS}, x AS (SELECT p_partkey AS id, p_partkey // 3 AS old, p_partkey % 4 = 0 AS person, CASE WHEN p_partkey % 4 = 0 THEN 'name' || (p_partkey % 60) ELSE 'work' || (p_partkey // 2) END AS key,
    CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 2000 END AS year, p_size + 1 AS size FROM part WHERE p_size > 5),
  c AS (SELECT x.*, NOT confirmed AND (old % 2 = 0 OR x.person) AS moves FROM x JOIN w ON w.id = x.old),
  f AS (SELECT c.*, (SELECT coalesce(min(CASE WHEN w.person THEN id END), min(id)) FROM w WHERE w.title_key = c.key) AS any_kind, (SELECT min(id) FROM w WHERE w.title_key = c.key AND id % 2 = 1) AS typed, (SELECT min(id) FROM w WHERE w.title_key = c.key AND id % 2 = 0) AS untyped FROM c),
  o AS (SELECT *, CASE WHEN moves THEN coalesce(CAST(CASE WHEN person THEN any_kind ELSE coalesce(typed, untyped) END AS VARCHAR), 'new ' || key) ELSE CAST(old AS VARCHAR) END AS owner FROM f),
  n AS (SELECT p_partkey // 3 AS id, COUNT(*) AS total FROM part GROUP BY 1), g AS (SELECT old AS id, COUNT(*) AS gone FROM o WHERE owner <> CAST(old AS VARCHAR) GROUP BY 1)
  SELECT 'refresh' AS change, id, owner, CASE WHEN person THEN 'person' ELSE 'media' END AS resource_class, CAST(year AS INT) AS parsed_year, size FROM o
  UNION ALL SELECT 'remove', g.id, '', NULL, NULL, NULL FROM g JOIN n ON n.id = g.id AND total = gone JOIN w ON w.id = g.id WHERE NOT confirmed AND CAST(g.id AS VARCHAR) NOT IN (SELECT owner FROM o WHERE owner <> CAST(old AS VARCHAR))""")
def refreshed_resources(t: Tables):
    works, resources = _person_tables(t)
    person = F.col("p_partkey") % 4 == 0
    name = F.when(person, F.concat(F.lit("Name "), (F.col("p_partkey") % 60).cast("string"))).otherwise(F.concat(F.lit("Work "), F.floor(F.col("p_partkey") / 2).cast("string")))
    parsed = t.part.filter("p_size > 5").select(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("source_key"), name.alias("title"), F.lower(F.replace(name, F.lit(" "), F.lit(""))).alias("title_key"), F.lit(2000).alias("year"),
        F.when(person, "unknown").otherwise("tv").alias("media_type"), F.when(person, "person").otherwise("media").alias("resource_kind"), (F.col("p_size") + 1).alias("size"),
    )
    links = t.lineitem.select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("source_key"))
    made = attribution.refreshed(parsed, resources, works, links, ["size"])
    new = made["created"].select(F.col("id").alias("work_id"), F.concat(F.lit("new "), "title_key").alias("_new"))
    rows = made["resources"].join(new, "work_id", "left").select(F.lit("refresh").alias("change"), "id", F.coalesce("_new", F.col("work_id").cast("string")).alias("owner"), "resource_class", "parsed_year", "size")
    return rows.unionByName(made["removed"].select(F.lit("remove").alias("change"), "id", F.lit("").alias("owner")), allowMissingColumns=True)


# --- nested metadata ------------------------------------------------------------------------------

@query("P-08", sql="""SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND ((p_size % 3 <> 0 AND (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red'))) OR contains(lower(p_name), 'red') AND p_size % 5 = 0)""")
def snapshot_search(t: Tables):
    files = F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("path"), F.lit("red").alias("owner")))
    shot = F.struct(
        F.when(F.col("p_size") % 3 == 0, "error").otherwise("ok").alias("status"), F.array(F.upper("p_name")).alias("names"), files.alias("files"), F.lit("red").alias("note"),
        F.struct(F.array(F.lit("red")).alias("names")).alias("inner"),
    )
    metadata = F.when(F.col("p_partkey") % 7 == 0, '["red"]').otherwise(F.to_json(F.struct(shot.alias("share_snapshot"), F.when(F.col("p_size") % 5 == 0, F.col("p_name")).alias("extra"), F.lit("red").alias("context"))))
    return t.part.filter(search.snapshot_holds(metadata, "Red")).select("p_partkey")


# --- streams --------------------------------------------------------------------------------------

_OUTCOME = "case o_custkey % 10 when 4 then 'invalid' when 3 then 'invalid' when 6 then 'none' when 7 then 'none' else 'valid' end"


@query("ST-01", "ST-02", "ST-03", sql="""WITH k AS (SELECT o_orderkey AS id, o_orderdate AS sent, o_custkey AS c, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END AS key, CASE WHEN o_custkey % 10 IN (6, 7) THEN 'pending' WHEN o_custkey % 10 IN (3, 4) THEN 'invalid' ELSE 'valid' END AS state FROM orders),
  f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sent, CAST(id AS VARCHAR)) AS n FROM k)
  SELECT CAST(id AS VARCHAR) AS event_id, CASE state WHEN 'pending' THEN 'pending_validation' WHEN 'invalid' THEN 'failed' ELSE CASE WHEN n = 1 THEN 'imported' ELSE 'duplicate' END END AS status, CAST(1 AS BIGINT) AS deliveries,
    CASE WHEN state = 'valid' AND n = 1 THEN CASE WHEN c % 3 = 1 THEN 'Own label' ELSE 'Work ' || c END END AS title, CAST(CASE WHEN state = 'valid' AND n = 1 AND c % 3 <> 1 THEN year(sent) END AS INT) AS year FROM f""")
def chained_intake(t: Tables):
    schema, path = t.orders.schema, f"{t.sf_dir}/orders.parquet"
    post = ROLES["post"][1]["text"]
    columns = ["'posts' as service", "cast(o_orderkey as string) as event_id", "cast(o_orderdate as timestamp) as received_at", f"{post} as text"]
    key = "case when o_custkey % 2 = 0 then concat('115:https://115.com/s/sw', cast(o_custkey as string), '?password=ab', cast(10 + o_custkey % 90 as string)) else concat('123:https://www.123865.com/s/k', cast(o_orderkey as string), '?pwd=x', cast(100 + o_custkey % 900 as string)) end"
    outcomes = t.orders.selectExpr(f"{key} as source_key", f"{_OUTCOME} as outcome")
    works = t.spark.createDataFrame([], "id long, title_key string, year int, media_type string, resource_kind string")
    name = "orders-" + t.spark.sparkContext.applicationId + "-" + "".join(c if c.isalnum() else "_" for c in t.sf_dir)
    store = chain.run(streams.read_stream(t.spark, path, schema).selectExpr(*columns), chain.store(chain.folder_of(t.spark, name)), lambda: outcomes, works)
    resources = store.table(t.spark, "resources").select("event_id", "title", "year")
    return store.table(t.spark, "receipts").join(resources, "event_id", "left").select("event_id", "status", "deliveries", "title", "year")


@query("ST-04", sql=QUERIES["retry_states"].sql)
def streamed_retry_states(t: Tables):
    before = t.spark.conf.get(retries.STATE_STORE[0], None)
    t.spark.conf.set(*retries.STATE_STORE)
    try:
        events = streams.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)
        outcome = F.when(F.col("event_type") == "purchase", "valid").when(F.col("event_type") == "signup", "gate").otherwise("transient")
        attempts = events.select(F.col("user_id").alias("link"), F.col("ts").alias("attempt_at"), F.col("event_id").alias("place"), outcome.alias("outcome"))
        states = streams.run_once(retries.live_link_states(attempts, "link", most=4), ["link", "event"])
    finally:
        t.spark.conf.unset(retries.STATE_STORE[0]) if before is None else t.spark.conf.set(retries.STATE_STORE[0], before)
    return states.filter(F.col("event") == "state").select("link", "status", "attempts", "next_retry_at")



# --- fallbacks and links ----------------------------------------------------------------------------

@query("R-18", sql="""WITH w AS (SELECT o_orderkey AS work_id, o_custkey AS c, year(o_orderdate) AS y, o_custkey % 9 = 0 AS undated, o_custkey % 9 = 1 AS two, o_custkey % 11 = 0 AS collection, o_custkey % 5 = 0 AS episodic FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')),
  s AS (SELECT DISTINCT 'x' || (c_custkey // 2) AS xid, 'n' || (c_custkey % 400) AS name_key, 1992 + c_custkey % 7 AS year, CASE WHEN c_custkey % 3 = 0 THEN 'tv' ELSE 'movie' END AS media_type FROM customer),
  h AS (SELECT work_id, COUNT(DISTINCT xid) AS hits, min({'xid': xid, 'kind': media_type}) AS hit FROM w JOIN s ON s.year = y AND name_key IN ('n' || (c % 400), 'n' || (c % 300)) WHERE NOT undated AND NOT two AND NOT collection AND (NOT episodic OR media_type = 'tv') GROUP BY 1),
  m AS (SELECT xid, COUNT(*) AS mapped, min({'t': media_type, 'i': catalogue_id}) AS to_ FROM (SELECT DISTINCT 'x' || (s_suppkey * 3 // 2) AS xid, CASE WHEN s_suppkey % 4 = 0 THEN 'tv' ELSE 'movie' END AS media_type, s_suppkey AS catalogue_id FROM supplier) GROUP BY 1),
  f AS (SELECT w.*, hits, hit.xid AS xid, hit.kind AS kind, mapped, to_.t AS t, to_.i AS i, s_suppkey % 6 AS back, s_nationkey AS nation FROM w LEFT JOIN h USING (work_id) LEFT JOIN m ON m.xid = hit.xid LEFT JOIN supplier ON s_suppkey = to_.i),
  g AS (SELECT *, CASE WHEN undated THEN 'missing_year' WHEN two THEN 'conflicting_years' WHEN collection THEN 'collection' WHEN hits IS NULL THEN 'no_exact_match' WHEN hits > 1 THEN 'ambiguous_second' WHEN mapped IS NULL THEN 'no_mapping' WHEN mapped > 1 THEN 'ambiguous_first'
    WHEN t <> kind THEN 'type_conflict' WHEN back = 0 THEN 'external_id_mismatch' WHEN back = 1 THEN 'first_missing_year' WHEN 1992 + nation % 7 <> y THEN 'located_second_year' ELSE 'located' END AS status FROM f)
  SELECT work_id, status, CASE WHEN hits = 1 THEN xid END AS xid, CASE WHEN status LIKE 'located%' THEN t END AS media_type, CASE WHEN status LIKE 'located%' THEN i END AS catalogue_id, CASE WHEN status LIKE 'located%' THEN status <> 'located' END AS year_override FROM g""")
def second_catalogue(t: Tables):
    c, y = F.col("o_custkey"), F.year("o_orderdate")
    named = lambda n: F.concat(F.lit("n"), (c % n).cast("string"))
    works = t.orders.select(
        F.col("o_orderkey").alias("work_id"), F.when(c % 9 == 0, F.array().cast("array<int>")).when(c % 9 == 1, F.array(y, y + 1)).otherwise(F.array(y)).alias("years"), F.array(named(400), named(300)).alias("names"),
        (c % 11 == 0).alias("collection"), (c % 5 == 0).alias("episodic"),
    )
    k, x = F.col("c_custkey"), lambda n: F.concat(F.lit("x"), F.floor(n).cast("string"))
    second = t.customer.select(x(k / 2).alias("xid"), F.concat(F.lit("n"), (k % 400).cast("string")).alias("name_key"), (1992 + k % 7).cast("int").alias("year"), F.when(k % 3 == 0, "tv").otherwise("movie").alias("media_type"))
    s = F.col("s_suppkey")
    kind = F.when(s % 4 == 0, "tv").otherwise("movie")
    mapping = t.supplier.select(x(s * 3 / 2).alias("xid"), kind.alias("media_type"), s.alias("catalogue_id"))
    catalogue = t.supplier.select(s.alias("catalogue_id"), kind.alias("media_type"), F.when(s % 6 == 0, "other").otherwise(x(s * 3 / 2)).alias("xid"), F.when(s % 6 != 1, 1992 + F.col("s_nationkey") % 7).cast("int").alias("year"))
    candidates = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("work_id"))
    return fallbacks.second_catalogue(works, candidates, second, mapping, catalogue)


@query("R-19", sql="""WITH w AS (SELECT id, 't' || (o_custkey % 700) AS title_key, year, media_type, status, CASE WHEN status = 'matched' THEN o_custkey % 700 + CASE WHEN o_custkey % 700 % 4 = 0 THEN id ELSE 0 END END AS catalogue_id FROM work JOIN orders ON o_orderkey = id),
  a AS (SELECT title_key, min(catalogue_id) AS catalogue_id, arg_min(coalesce(year, -1), id) AS y FROM w WHERE media_type = 'tv' AND status = 'matched' GROUP BY 1 HAVING min(catalogue_id) = max(catalogue_id)),
  s AS (SELECT DISTINCT l_partkey AS catalogue_id, CAST(year(l_shipdate) AS INT) AS year FROM lineitem)
  SELECT w.id AS work_id, a.catalogue_id, CAST(0.95 AS DOUBLE) AS score, coalesce(w.year <> nullif(a.y, -1), true) AS season_year FROM w JOIN a USING (title_key) LEFT JOIN s ON s.catalogue_id = a.catalogue_id AND s.year = w.year
  WHERE media_type = 'tv' AND status <> 'matched' AND w.year IS NOT NULL AND (w.year = a.y OR s.year IS NOT NULL)""")
def sibling_seasons(t: Tables):
    n = F.col("o_custkey") % 700
    own = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), n.cast("string")).alias("title_key"), (n + F.when(n % 4 == 0, F.col("o_orderkey")).otherwise(0)).alias("_c"))
    works = t.work.select("id", "year", "media_type", "status").join(own, "id").withColumn("catalogue_id", F.when(F.col("status") == "matched", F.col("_c")))
    return fallbacks.sibling_seasons(works, t.lineitem.select(F.col("l_partkey").alias("catalogue_id"), F.year("l_shipdate").alias("air_year")))


@query("R-24", "R-07", sql="""WITH d AS (SELECT o_orderkey AS id, o_custkey % 800 AS c, CASE WHEN o_custkey % 800 % 2 = 0 THEN 'tv' ELSE 'movie' END AS t FROM orders WHERE o_orderstatus = 'P'),
  w AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 800 END AS old, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 800 % 2 = 0 THEN 'tv' ELSE 'movie' END END AS old_t, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey % 50 END AS col FROM orders),
  l AS (SELECT w.id, coalesce(d.c, old) AS c, coalesce(d.t, old_t) AS t, col, d.c IS NOT NULL AS new FROM w LEFT JOIN d USING (id)),
  g AS (SELECT c, t, min(id) AS kept, bool_or(new) AS touched, arg_min(coalesce(col, -1), id) AS own, first(col ORDER BY id) FILTER (WHERE col IS NOT NULL) AS other FROM l WHERE c IS NOT NULL GROUP BY 1, 2 HAVING bool_or(new)),
  r AS (SELECT l_orderkey AS work_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_tax = 0.0) AS bare FROM lineitem GROUP BY 1)
  SELECT kept AS id, c AS catalogue_id, t AS media_type, coalesce(nullif(own, -1), other) AS collection_id, p_name AS title, (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM l JOIN r ON r.work_id = l.id WHERE l.c = g.c AND l.t = g.t) AS resources,
    (SELECT CAST(coalesce(SUM(CASE WHEN g.t = 'tv' THEN bare ELSE 0 END), 0) AS BIGINT) FROM l JOIN r ON r.work_id = l.id WHERE l.c = g.c AND l.t = g.t) AS first_season FROM g LEFT JOIN part ON p_partkey = c""")
def applied_links(t: Tables):
    n = F.col("o_custkey") % 800
    kind = F.when(n % 2 == 0, "tv").otherwise("movie")
    decisions = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("work_id"), n.alias("catalogue_id"), kind.alias("media_type"), F.lit(0.9).alias("confidence"), F.lit("auto").alias("method"))
    matched = F.col("o_orderstatus") == "F"
    works = t.orders.select(F.col("o_orderkey").alias("id"), F.when(matched, n).alias("catalogue_id"), F.when(matched, kind).alias("catalogue_type"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderkey") % 50).alias("collection_id"))
    none = F.lit(None).cast("int")
    resources = t.lineitem.select(F.expr(_FILE).alias("id"), F.col("l_orderkey").alias("work_id"), none.alias("season"), F.when(F.col("l_tax") != 0.0, F.col("l_linenumber")).alias("episode"))
    catalogue = t.part.select(F.col("p_partkey").alias("catalogue_id"), F.when(F.col("p_partkey") % 2 == 0, "tv").otherwise("movie").alias("media_type"), F.array("p_size").alias("seasons"), F.col("p_name").alias("title"))
    candidates = t.lineitem.select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("catalogue_id"))
    made = fallbacks.applied_links(decisions, works, resources, candidates, catalogue, ["title"])
    counts = made["resources"].groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("season") == 1, 1)).alias("_first"))
    return made["works"].join(counts, F.col("id") == F.col("work_id"), "left").select(
        "id", "catalogue_id", "media_type", "collection_id", "title", F.coalesce("n", F.lit(0)).alias("resources"), F.coalesce("_first", F.lit(0)).alias("first_season")
    )


@query("S-10", sql="""SELECT p_partkey AS catalogue_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 1990 + p_size % 20 END AS year, CASE WHEN p_size % 3 = 0 THEN 'US' ELSE 'JP,FR' END AS countries,
    list_distinct([p_name, upper(p_name), p_brand]) IS NOT NULL AS any_title, CAST(len(list_distinct([p_name, upper(p_name), p_brand])) AS INT) AS titles, CAST(CASE WHEN p_size > 5 THEN 2 ELSE 1 END AS INT) AS seasons, CAST(CASE WHEN p_size > 5 THEN 10 + p_size ELSE 10 END AS BIGINT) AS episodes FROM part WHERE p_size % 7 <> 0""")
def normalised_catalogue(t: Tables):
    season = lambda n, count: F.struct(F.lit(n).alias("season_number"), count.cast("int").alias("episode_count"), F.lit("2001-02-03").alias("air_date"))
    record = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.upper("p_name").alias("original_name"), F.when(F.col("p_size") % 4 != 0, F.concat((1990 + F.col("p_size") % 20).cast("string"), F.lit("-05-06"))).otherwise("").alias("first_air_date"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("US"))).alias("origin_country"), F.array(*[F.struct(F.lit(c).alias("iso_3166_1")) for c in ("JP", "FR")]).alias("production_countries"),
        F.array(season(0, F.lit(9)), season(1, F.lit(10)), season(2, F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0)), season(1, F.lit(4))).alias("seasons"),
        F.struct(F.array(F.struct(F.concat(F.lit(" "), "p_name").alias("title")), F.struct(F.col("p_brand").alias("title"))).alias("results")).alias("alternative_titles"),
    )
    raw = spread(t.part).select(F.lit("tv").alias("media_type"), F.when(F.col("p_size") % 7 == 0, "[broken").otherwise(F.to_json(record)).alias("payload"))
    # stored, as tests of the payload would else be made before the rows are dealt
    made = fallbacks.normalised_catalogue(written(raw, "details"))
    titles = made["titles"].groupBy("catalogue_id").agg(F.count(F.lit(1)).cast("int").alias("titles"))
    seasons = made["seasons"].groupBy("catalogue_id").agg(F.count(F.lit(1)).cast("int").alias("seasons"), F.sum("episodes").alias("episodes"))
    return made["works"].join(titles, "catalogue_id").join(seasons, "catalogue_id").select(
        "catalogue_id", "year", F.array_join("countries", ",").alias("countries"), F.lit(True).alias("any_title"), "titles", "seasons", "episodes"
    )
