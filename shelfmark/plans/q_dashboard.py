"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import dashboard
from .bindings import AS_OF, TZ, Tables
from .registry import query

_COUNTS = ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}"
    for s in ("imported", "duplicate", "ignored", "failed", "pending_validation", "queued")
)
_DERIVED = (
    "pending_validation + queued AS pending, imported + duplicate + ignored + failed AS processed, "
    "CASE WHEN imported + duplicate + ignored + failed > 0 THEN round(imported / (imported + duplicate + ignored + failed), 4) END AS success_rate"
)
_TREND = f"""c AS (
  SELECT CAST(received_at + INTERVAL 8 HOUR AS DATE) AS day, COUNT(*) AS received, {_COUNTS} FROM message GROUP BY 1),
d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-30' - INTERVAL 29 DAY, DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
t AS (SELECT d.day, coalesce(received, 0) AS received, coalesce(imported, 0) AS imported, coalesce(duplicate, 0) AS duplicate,
  coalesce(ignored, 0) AS ignored, coalesce(failed, 0) AS failed, coalesce(pending_validation, 0) AS pending_validation,
  coalesce(queued, 0) AS queued FROM d LEFT JOIN c ON c.day = d.day)"""


@query("A-07", "A-05", "F-13", sql=f"WITH {_TREND} SELECT *, {_DERIVED} FROM t")
def daily_trend(t: Tables):
    return dashboard.daily_trend(t.message, AS_OF, TZ, 30)


@query("A-05", sql=f"WITH c AS (SELECT COUNT(*) AS received, {_COUNTS} FROM message) SELECT *, {_DERIVED} FROM c")
def message_status_counts(t: Tables):
    return dashboard.message_status_counts(t.message)


@query("A-06", sql=f"""WITH k AS (SELECT status, CASE
    WHEN CAST(received_at + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-30' THEN 'today'
    WHEN CAST(received_at + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-29'
      AND received_at + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-29 23:30:00' THEN 'yesterday' END AS day_kind FROM message),
  d AS (SELECT unnest(['today', 'yesterday']) AS day_kind),
  c AS (SELECT d.day_kind, COUNT(k.day_kind) AS received, {_COUNTS} FROM d LEFT JOIN k ON k.day_kind = d.day_kind GROUP BY 1)
  SELECT *, {_DERIVED} FROM c""")
def same_time_comparison(t: Tables):
    return dashboard.same_time_comparison(t.message, AS_OF, TZ)


@query("A-24", sql=f"""WITH {_TREND}, l AS (SELECT received AS today, lag(received) OVER (ORDER BY day) AS yesterday, day FROM t)
  SELECT CAST(SUM(received) AS BIGINT) AS received, CAST(SUM(imported) AS BIGINT) AS imported, CAST(SUM(failed) AS BIGINT) AS failed,
    max(l.today) AS today, max(l.yesterday) AS yesterday,
    CASE WHEN max(l.yesterday) <> 0 THEN round((max(l.today) - max(l.yesterday)) / max(l.yesterday), 4) END AS change
  FROM t LEFT JOIN l ON l.day = t.day AND l.day = DATE '2024-01-30'""")
def trend_change(t: Tables):
    return dashboard.trend_change(dashboard.daily_trend(t.message, AS_OF, TZ, 30))


@query("A-09", "F-24", sql="""SELECT channel_key, coalesce(nullif(trim(n), ''), nullif(trim(u), ''), channel_key) AS name,
    CASE WHEN regexp_full_match(trim(ltrim(trim(u), '@')), '[A-Za-z0-9_]{5,32}') THEN trim(ltrim(trim(u), '@')) END AS username,
    received, imported, last_received_at FROM (
  SELECT coalesce(nullif(channel_username, ''), nullif(channel_id, ''), channel_name, 'unknown') AS channel_key, max(channel_name) AS n,
    max(channel_username) AS u, COUNT(*) AS received, COUNT(*) FILTER (WHERE status = 'imported') AS imported, max(received_at) AS last_received_at
  FROM message WHERE received_at + INTERVAL 8 HOUR >= TIMESTAMP '2024-01-01' GROUP BY 1) ORDER BY received DESC, channel_key LIMIT 6""")
def top_channels(t: Tables):
    return dashboard.top_channels(t.message, AS_OF, TZ, 30)


@query("A-08", sql="""SELECT *, round(matched / total, 4) AS match_rate FROM (SELECT COUNT(*) AS total,
    COUNT(*) FILTER (WHERE status = 'matched') AS matched, COUNT(*) FILTER (WHERE status <> 'matched') AS unmatched,
    COUNT(*) FILTER (WHERE status = 'review') AS review, COUNT(*) FILTER (WHERE media_type = 'movie') AS movies,
    COUNT(*) FILTER (WHERE media_type = 'tv') AS tv FROM work WHERE NOT is_metadata AND resource_kind NOT IN ('person', 'series'))""")
def work_overview(t: Tables):
    return dashboard.work_overview(t.work)


@query("A-08", sql="""SELECT COUNT(*) AS total, CAST(SUM(file_size) AS BIGINT) AS bytes,
    COUNT(*) FILTER (WHERE CAST(created_at + INTERVAL 8 HOUR AS DATE) = DATE '1999-06-15') AS added_today FROM resource""")
def resource_overview(t: Tables):
    return dashboard.resource_overview(t.resource, "1999-06-15 10:00:00", TZ)


@query("A-08", sql="""SELECT 'failed_events' AS metric, COUNT(*) AS value FROM message WHERE status = 'failed'
  UNION ALL SELECT 'pending_events', COUNT(*) FROM message WHERE status IN ('pending_validation', 'queued')
  UNION ALL SELECT 'invalid_links', COUNT(*) FROM link WHERE status = 'invalid'
  UNION ALL SELECT 'error_links', COUNT(*) FROM link WHERE status = 'error'
  UNION ALL SELECT 'pending_links', COUNT(*) FROM link WHERE status = 'pending_validation'
  UNION ALL SELECT 'checked_links', COUNT(*) FROM link WHERE status IN ('inserted', 'duplicate', 'invalid', 'error')
  UNION ALL SELECT 'total_links', COUNT(*) FROM link""")
def backlog(t: Tables):
    return dashboard.backlog(t.message, t.link)


@query("T-04", sql="""WITH h AS (SELECT * FROM message ORDER BY received_at DESC, id DESC LIMIT 8),
  k AS (SELECT message_id, status, COUNT(*) AS n FROM link WHERE message_id IN (SELECT id FROM h) GROUP BY ALL),
  c AS (SELECT message_id, CAST(SUM(n) AS BIGINT) AS links, string_agg(status || ':' || n, ',' ORDER BY status || ':' || n) AS link_counts FROM k GROUP BY 1),
  w AS (SELECT DISTINCT l.message_id, work.id, coalesce(nullif(trim(catalogue_title), ''), title) AS shown,
      coalesce(year, CASE WHEN regexp_full_match(substr(release_date, 1, 4), '[12][0-9]{3}') THEN CAST(substr(release_date, 1, 4) AS INT) END) AS y
    FROM link l JOIN work ON work.id = l.work_id WHERE l.message_id IN (SELECT id FROM h)),
  g AS (SELECT message_id, string_agg(concat_ws('|', id, shown, y), ';' ORDER BY concat_ws('|', id, shown, y)) AS works FROM w GROUP BY 1)
  SELECT h.id, coalesce(nullif(trim(channel_name), ''), nullif(trim(channel_username), ''), '未知频道') AS channel, h.status, received_at,
    coalesce(links, 0) AS links, coalesce(link_counts, '') AS link_counts, coalesce(works, '') AS works
  FROM h LEFT JOIN c ON c.message_id = h.id LEFT JOIN g ON g.message_id = h.id""")
def recent_messages(t: Tables):
    return dashboard.recent_messages(t.message, t.link, t.work)


@query("F-13", sql="""SELECT CAST(received_at + INTERVAL 8 HOUR AS DATE) AS day, COUNT(*) AS n,
  min(strftime(received_at + INTERVAL 8 HOUR, '%H:%M:%S')) AS first_time FROM message GROUP BY 1""")
def local_day_projection(t: Tables):
    wall = times.local_time(F.col("received_at"), TZ)
    return t.message.select(wall.cast("date").alias("day"), F.date_format(wall, "HH:mm:ss").alias("time")).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time")
    )
