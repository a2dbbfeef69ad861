"""Intake, upsert, reconciliation and stream queries."""

from pyspark.sql import functions as F

from ..operators.dashboard import with_derived_counts
from ..sources import intake
from ..streaming import messages as streams
from .bindings import ROLES, TZ, Tables
from .q_dashboard import _COUNTS, _DERIVED
from .registry import query


@query("S-02", sql="""SELECT conv_id, turn, e AS event_id, md5(coalesce(CASE WHEN turn % 3 = 0 THEN text END, CASE WHEN turn % 3 = 1 THEN text END, CASE WHEN turn % 3 = 2 THEN text END, '')) AS digest,
    length(e) BETWEEN 1 AND 200 AND strlen(coalesce(text, '')) <= 524288 AS accepted FROM (SELECT *, CASE WHEN conv_id % 50 = 0 THEN '' ELSE concat('c', conv_id, ':', turn) END AS e FROM conversations)""")
def accepted_messages(t: Tables):
    part = F.col("turn") % 3
    envelopes = t.conversations.select(
        "conv_id", "turn", F.when(F.col("conv_id") % 50 == 0, "").otherwise(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn")).alias("event_id"),
        F.when(part == 0, F.col("text")).otherwise(" \t").alias("message"), F.when(part == 1, F.col("text")).alias("plain"), F.when(part == 2, F.col("text")).otherwise("").alias("caption"),
    )
    return intake.accept_messages(envelopes, "event_id", ["message", "plain", "caption"]).select("conv_id", "turn", "event_id", F.md5("text").alias("digest"), "accepted")


@query("S-04", "E-02", sql=r"""SELECT page_id, nullif(trim(coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*property=["'']og:title["''][^>]*content=["'']([^"'']*)["'']', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '') AS title,
    CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']')) AS INT) AS links,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS shown FROM pages""")
def page_fields(t: Tables):
    return intake.page_fields(t.pages).select("page_id", "title", F.size("links").alias("links"), F.md5("visible_text").alias("shown"))


@query("S-06", "F-16", sql="""WITH d AS (SELECT source, sha256(text) AS digest, trim(text) = '' AS blank FROM documents), f AS (SELECT digest, min(source) AS first FROM d GROUP BY 1),
  g AS (SELECT source, d.digest, first, blank, COUNT(*) AS n FROM d JOIN f USING (digest) GROUP BY ALL)
  SELECT source, CAST(SUM(n) AS BIGINT) AS total, COUNT(*) FILTER (WHERE NOT blank AND source = first) AS inserted, CAST(SUM(CASE WHEN blank THEN 0 ELSE n - CASE WHEN source = first THEN 1 ELSE 0 END END) AS BIGINT) AS duplicate,
    CAST(SUM(CASE WHEN blank THEN n ELSE 0 END) AS BIGINT) AS error FROM g GROUP BY 1""")
def batch_totals(t: Tables):
    return intake.batch_summary(t.documents, "source", "text")


_UPSERT = "s AS (SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'signup')) WHERE k = 1), i AS (SELECT event_id, user_id, event_type, ts, value FROM events WHERE event_type NOT IN ('purchase', 'signup'))"


def _tables(t: Tables):
    # every event is on one side: some types say what is stored, the others what comes in
    known = t.events.filter("event_type in ('purchase', 'signup')").groupBy("user_id").agg(F.min_by(F.struct("event_type", "ts", "value", "event_id"), "event_id").alias("r"))
    return known.select("user_id", "r.*"), t.events.filter("event_type not in ('purchase', 'signup')").select("user_id", "event_type", "ts", "value", "event_id")


@query("S-07", sql=f"""WITH {_UPSERT}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM i) WHERE k = 1)
  SELECT user_id, event_type, ts, value FROM l UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM i)""")
def updated_users(t: Tables):
    return intake.upsert(*_tables(t), ["user_id"], ["ts", "event_id"]).drop("event_id")


@query("S-07", sql=f"""WITH {_UPSERT}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM i) WHERE k = 1)
  SELECT * FROM s UNION ALL SELECT user_id, event_type, ts, value FROM l WHERE user_id NOT IN (SELECT user_id FROM s)""")
def inserted_users(t: Tables):
    return intake.upsert(*_tables(t), ["user_id"], ["ts", "event_id"], "ignore").drop("event_id")


@query("S-07", sql=f"WITH {_UPSERT} SELECT user_id, event_type, ts, value FROM i UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM i)")
def replaced_users(t: Tables):
    return intake.upsert(*_tables(t), ["user_id"], ["ts"], "replace").drop("event_id")


@query("S-09", sql="""SELECT 'orders' AS label, COUNT(*) AS before, COUNT(DISTINCT o_custkey) AS after, COUNT(DISTINCT o_custkey) - COUNT(*) AS change FROM orders
  UNION ALL SELECT 'documents', COUNT(*), COUNT(DISTINCT text), COUNT(DISTINCT text) - COUNT(*) FROM documents UNION ALL SELECT 'pages', COUNT(*), 0, -COUNT(*) FROM pages""")
def reconciled_counts(t: Tables):
    before = {"orders": t.orders, "documents": t.documents, "pages": t.pages}
    return intake.reconcile_counts(before, {"orders": t.orders.select("o_custkey").distinct(), "documents": t.documents.select("text").distinct()})


@query("U-02", sql="SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_deliveries(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("U-03", sql="""WITH v AS (SELECT page_id, unnest([url, rtrim(url, '/'), replace(url, 'http://', 'https://'), regexp_replace(url, '([a-z])/[0-9]+.*$', '\\1')]) AS v FROM pages), s AS (SELECT DISTINCT v FROM v WHERE page_id % 2 = 0)
  SELECT page_id, bool_or(s.v IS NOT NULL) AS known FROM v LEFT JOIN s USING (v) WHERE page_id % 2 = 1 GROUP BY 1""")
def known_key_variants(t: Tables):
    url = F.col("url")
    variants = F.array_distinct(F.array(url, F.rtrim(url, F.lit("/")), F.replace(url, F.lit("http://"), F.lit("https://")), F.regexp_replace(url, "([a-z])/[0-9]+.*$", "$1")))
    each = t.pages.select("page_id", F.explode(variants).alias("v"))
    stored = each.filter("page_id % 2 = 0").select("v").distinct().withColumn("_known", F.lit(True))
    return each.filter("page_id % 2 = 1").join(stored, "v", "left").groupBy("page_id").agg(F.bool_or(F.coalesce("_known", F.lit(False))).alias("known"))


@query("U-04", "F-20", sql="""WITH y AS (SELECT o_custkey, list(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS a, list(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1)
  SELECT o_custkey, list_has_any(a, b) AS overlap, array_to_string(list_sort(list_intersect(a, b)), ',') AS years FROM y WHERE a IS NOT NULL AND b IS NOT NULL""")
def shared_years(t: Tables):
    year = F.year("o_orderdate")
    years = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, year))
    y = t.orders.groupBy("o_custkey").agg(years("F").alias("a"), years("O").alias("b")).filter("size(a) > 0 and size(b) > 0")
    return y.select("o_custkey", F.arrays_overlap("a", "b").alias("overlap"), F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("years"))


@query("F-11", "F-22", sql="""SELECT host || path AS identity, COUNT(*) AS pages, min(page_id) AS first FROM (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages) GROUP BY 1""")
def link_identities(t: Tables):
    from ..functions import urls

    identity = F.concat(urls.host(F.col("url")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")))
    return t.pages.groupBy(identity.alias("identity")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))


@query("ST-01", "ST-02", sql="SELECT user_id, event_type, COUNT(*) AS deliveries FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def streamed_deliveries(t: Tables):
    schema = t.events.schema
    path = f"{t.sf_dir}/events.parquet"
    rows = streams.store_first_deliveries(streams.read_stream(t.spark, path, schema), ["event_id"])
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("deliveries"))


@query("ST-08", "A-07", sql=f"WITH c AS (SELECT CAST(received_at + INTERVAL 8 HOUR AS DATE) AS day, COUNT(*) AS received, {_COUNTS} FROM message GROUP BY 1) SELECT *, {_DERIVED} FROM c")
def streamed_daily_counts(t: Tables):
    schema = t.events.schema
    stream = streams.read_stream(t.spark, f"{t.sf_dir}/events.parquet", schema).selectExpr(*[f"{e} as `{c}`" for c, e in ROLES["message"][1].items()])
    return with_derived_counts(streams.run_once(streams.live_daily_counts(stream, TZ), ["day"], "days"))
