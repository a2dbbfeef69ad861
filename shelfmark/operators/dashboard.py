"""Ingestion dashboard: counts by status, dense trend, channels, overview, backlog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.numeric import count_where, ratio
from ..functions.text import blank_to_null, channel_username
from ..functions.times import as_ntz, effective_year, local_day, local_time

MIN_DAYS, MAX_DAYS = 7, 90
RECENT = 8
TOP_CHANNELS = 6


def _moment(as_of: str) -> dt.datetime:
    return dt.datetime.fromisoformat(as_of)


def status_counts(status: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("received")] + [
        count_where(status == s).alias(s) for s in rules.MESSAGE_STATUSES
    ]


def with_derived_counts(df: DataFrame) -> DataFrame:
    """Pending, processed and success rate from the status counts."""
    processed = F.col("imported") + F.col("duplicate") + F.col("ignored") + F.col("failed")
    return (
        df.withColumn("pending", F.col("pending_validation") + F.col("queued"))
        .withColumn("processed", processed)
        .withColumn("success_rate", ratio(F.col("imported"), processed))
    )


def message_status_counts(messages: DataFrame) -> DataFrame:
    return with_derived_counts(messages.agg(*status_counts(F.col("status"))))


def same_time_comparison(messages: DataFrame, as_of: str, tz: str) -> DataFrame:
    """Today so far beside yesterday up to the same clock time; one scan, two rows, zeros for a day without messages."""
    now = local_time(as_ntz(as_of), tz)
    wall = local_time(F.col("received_at"), tz)
    today, day = now.cast("date"), wall.cast("date")
    kind = F.when(day == today, F.lit("today")).when(
        (day == F.date_sub(today, 1)) & (wall <= now - F.expr("INTERVAL 1 DAY")), F.lit("yesterday")
    )
    # Both days start no earlier than two days before the moment: keeps the scan to them.
    lower = as_ntz(_moment(as_of) - dt.timedelta(days=3))
    counted = (
        messages.filter(F.col("received_at") >= lower)
        .select(kind.alias("day_kind"), "status")
        .filter(F.col("day_kind").isNotNull())
        .groupBy("day_kind")
        .agg(*status_counts(F.col("status")))
    )
    days = messages.sparkSession.range(1).select(F.explode(F.array(F.lit("today"), F.lit("yesterday"))).alias("day_kind"))
    return with_derived_counts(days.join(counted, "day_kind", "left").na.fill(0))


def window_start(as_of: str, tz: str, days: int) -> Column:
    """First local day of the trend."""
    days = min(max(int(days), MIN_DAYS), MAX_DAYS)
    return F.date_sub(local_day(as_ntz(as_of), tz), days - 1)


def daily_trend(messages: DataFrame, as_of: str, tz: str, days: int = 30) -> DataFrame:
    """Every local day of the range, zeros where nothing arrived."""
    days = min(max(int(days), MIN_DAYS), MAX_DAYS)
    spark = messages.sparkSession
    start, end = window_start(as_of, tz, days), local_day(as_ntz(as_of), tz)
    calendar = spark.range(1, numPartitions=1).select(F.explode(F.sequence(start, end)).alias("day"))
    # A plain comparison on the stored column reaches the scan; the exact day test follows.
    lower = as_ntz(_moment(as_of) - dt.timedelta(days=days + 1))
    counted = (
        messages.filter(F.col("received_at") >= lower)
        .select(local_day(F.col("received_at"), tz).alias("day"), "status")
        .filter(F.col("day") >= start)
        .groupBy("day")
        .agg(*status_counts(F.col("status")))
    )
    names = ["received", *rules.MESSAGE_STATUSES]
    dense = calendar.join(counted, "day", "left").select(
        "day", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    )
    return with_derived_counts(dense)


def trend_change(trend: DataFrame) -> DataFrame:
    """Range totals of a trend and the last day's change against the day before."""
    bounds = F.max(F.struct("day", "received"))
    totals = trend.agg(
        F.sum("received").alias("received"),
        F.sum("imported").alias("imported"),
        F.sum("failed").alias("failed"),
        bounds.alias("_last"),
        F.collect_list(F.struct("day", "received")).alias("_days"),  # at most 90 entries
    )
    previous = F.element_at(F.array_sort(F.col("_days")), -2)["received"]
    today = F.col("_last")["received"]
    return totals.select(
        "received", "imported", "failed", today.alias("today"), previous.alias("yesterday"),
        F.when(previous != 0, F.round((today - previous) / previous, 4)).alias("change"),
    )


def channel_key() -> Column:
    return F.coalesce(
        F.nullif(F.col("channel_username"), F.lit("")),
        F.nullif(F.col("channel_id"), F.lit("")),
        F.col("channel_name"),
        F.lit("unknown"),
    )


def top_channels(messages: DataFrame, as_of: str, tz: str, days: int = 30, top: int = TOP_CHANNELS) -> DataFrame:
    lower = as_ntz(_moment(as_of) - dt.timedelta(days=min(max(days, MIN_DAYS), MAX_DAYS) + 1))
    return (
        messages.filter(F.col("received_at") >= lower)
        .filter(local_day(F.col("received_at"), tz) >= window_start(as_of, tz, days))
        .groupBy(channel_key().alias("channel_key"))
        .agg(
            F.max("channel_name").alias("channel_name"),
            F.max("channel_username").alias("_username"),
            F.count(F.lit(1)).alias("received"),
            count_where(F.col("status") == "imported").alias("imported"),
            F.max("received_at").alias("last_received_at"),
        )
        .orderBy(F.desc("received"), "channel_key")
        .limit(top)
        .select(
            "channel_key",
            F.coalesce(blank_to_null(F.col("channel_name")), blank_to_null(F.col("_username")), F.col("channel_key")).alias("name"),
            channel_username(F.col("_username")).alias("username"),
            "received", "imported", "last_received_at",
        )
    )


def work_overview(works: DataFrame) -> DataFrame:
    """Match totals and rate of ordinary works."""
    ordinary = works.filter(~F.col("is_metadata") & ~F.col("resource_kind").isin("person", "series"))
    status, kind = F.col("status"), F.col("media_type")
    return ordinary.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(status == "matched").alias("matched"),
        count_where(status != "matched").alias("unmatched"),
        count_where(status == "review").alias("review"),
        count_where(kind == "movie").alias("movies"),
        count_where(kind == "tv").alias("tv"),
    ).withColumn("match_rate", ratio(F.col("matched"), F.col("total")))


def resource_overview(resources: DataFrame, as_of: str, tz: str) -> DataFrame:
    today = local_day(as_ntz(as_of), tz)
    return resources.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        count_where(local_day(F.col("created_at"), tz) == today).alias("added_today"),
    )


def backlog(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Long form (metric, value): failed and pending messages, link health."""
    status = F.col("status")
    events = messages.agg(
        count_where(status == "failed").alias("failed_events"),
        count_where(status.isin("pending_validation", "queued")).alias("pending_events"),
    )
    health = links.agg(
        count_where(status == "invalid").alias("invalid_links"),
        count_where(status == "error").alias("error_links"),
        count_where(status == "pending_validation").alias("pending_links"),
        count_where(status.isin("inserted", "duplicate", "invalid", "error")).alias("checked_links"),
        F.count(F.lit(1)).alias("total_links"),
    )
    return events.unpivot([], None, "metric", "value").unionByName(health.unpivot([], None, "metric", "value"))


def recent_messages(messages: DataFrame, links: DataFrame, works: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest ``n`` messages with their works and link counts; the limit comes first."""
    head = messages.orderBy(F.desc("received_at"), F.desc("id")).limit(n).withColumnRenamed("id", "message_id_")
    mine = F.broadcast(head.select(F.col("message_id_").alias("message_id")))  # n rows
    hit = links.join(mine, "message_id", "left_semi")
    counts = hit.groupBy("message_id", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("message_id").agg(
        F.sum("n").alias("links"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string")))), ",").alias("link_counts"),
    )
    named = (
        hit.filter(F.col("work_id").isNotNull()).select("message_id", "work_id").distinct()
        .join(
            works.select(
                F.col("id").alias("work_id"),
                F.coalesce(blank_to_null(F.col("catalogue_title")), F.col("title")).alias("shown"),
                effective_year(F.col("year"), F.col("release_date")).alias("shown_year"),
            ),
            "work_id",
        )
        .groupBy("message_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.col("work_id").cast("string"), "shown", F.col("shown_year").cast("string")))), ";").alias("works"))
    )
    return (
        head.join(counts, head.message_id_ == counts.message_id, "left").drop(counts.message_id)
        .join(named, head.message_id_ == named.message_id, "left").drop(named.message_id)
        .select(
            F.col("message_id_").alias("id"),
            F.coalesce(blank_to_null(F.col("channel_name")), blank_to_null(F.col("channel_username")), F.lit("未知频道")).alias("channel"),
            "status", "received_at",
            F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
            F.coalesce("link_counts", F.lit("")).alias("link_counts"),
            F.coalesce("works", F.lit("")).alias("works"),
        )
    )
