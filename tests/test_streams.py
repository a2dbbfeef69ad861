"""Streams give what the batch jobs give, over split and repeated files, and the retry fold what a plain loop gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import dashboard, retry
from shelfmark.streaming import messages as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").alias("received_at"), F.lit("imported").alias("status"))


def write(frames, path):
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return path


def test_a_repeated_delivery_counts_once_however_late(spark, events, tmp_path):
    path = write([*[events.filter(F.col("event_id") % 3 == k) for k in range(3)], events.filter("event_id % 5 = 0")], str(tmp_path / "e"))
    once = S.store_first_deliveries(S.read_stream(spark, path, events.schema), ["event_id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, events.collect()))


@pytest.fixture
def weeks(events, tmp_path):
    """Files of five days each, each with some of the days before again."""
    days = F.datediff(F.col("received_at").cast("date"), F.lit("2024-01-01").cast("date"))
    frames = [events.filter(days.between(5 * k - (2 if again else 0), 5 * k + 4) & (F.col("event_id") % 4 == 0 if again else F.lit(True))) for k in range(8) for again in (False, True)]
    return write(frames, str(tmp_path / "w"))


def test_a_repeat_within_the_watermark_counts_once(spark, events, weeks):
    once = S.run_once(S.first_deliveries(S.read_stream(spark, weeks, events.schema), ["event_id"]))
    ids = [r["event_id"] for r in once.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r["event_id"] for r in spark.read.parquet(weeks).select("event_id").collect()}


def test_days_grow_as_files_arrive(spark, events, weeks):
    live = S.run_once(S.live_daily_counts(S.read_stream(spark, weeks, events.schema), "Asia/Shanghai"), ["day"])
    day = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), "received_at").cast("date")
    batch = spark.read.parquet(weeks).groupBy(day.alias("day")).agg(*dashboard.status_counts(F.col("status")))
    assert {r["day"]: r["received"] for r in live.collect()} == {r["day"]: r["received"] for r in batch.collect()}


def folded(attempts, most):
    status, n, when = "pending_validation", 0, None
    for at, outcome in attempts:
        if outcome in ("valid", "invalid"):
            return ("validated" if outcome == "valid" else "invalid"), n, None
        if outcome == "transient":
            n += 1
            if n >= most:
                return "error", n, None
            when = at + dt.timedelta(seconds=min(3600, 30 * 2 ** min(max(n - 1, 0), 6)))
        else:
            when = at + dt.timedelta(seconds=3600)
    return status, n, when


@pytest.mark.parametrize("most", [3, 168])
def test_retry_fold(spark, most):
    draw, rows, want = random.Random(8), [], {}
    start = dt.datetime(2024, 1, 1)
    for link in range(60):
        mine = [(start + dt.timedelta(hours=k), draw.choice(["transient", "gate", "transient", "valid" if draw.random() < 0.2 else "gate", "invalid" if draw.random() < 0.1 else "transient"])) for k in range(draw.randint(1, 8))]
        want[link] = folded(mine, most)
        rows += [(link, at, outcome, k) for k, (at, outcome) in enumerate(mine)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "link long, attempt_at timestamp_ntz, outcome string, n int")
    got = {r["link"]: (r["status"], r["attempts"], r["next_retry_at"]) for r in retry.link_states(df, "link", ["n"], most=most).collect()}
    assert got == want
