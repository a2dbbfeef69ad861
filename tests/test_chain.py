"""The chain of micro-batches: stopped anywhere and started again it gives what a run without a stop gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.streaming import chain as C
from shelfmark.streaming import messages as S

SCHEMA = "service string, event_id string, received_at timestamp, text string"
WORKS = "id long, title_key string, year int, media_type string, resource_kind string"


def made():
    """Files of messages: links that come again, repeats in a file and in later ones, texts without links, ids that are refused."""
    draw, files = random.Random(3), []
    start = dt.datetime(2024, 1, 1)
    for k in range(3):
        rows = []
        for n in range(30):
            code = draw.randint(1, 40)
            text = f"🎥 Work {code % 7} (19{90 + code % 7})\n🌟 7\n链接：https://115.com/s/sw{code}?password=ab{code:02}"
            if n % 10 == 0:
                text = "nothing to see"
            if n % 11 == 0:
                text += f"\ned2k://|file|f{code}.mkv|{code}|{code:032x}|/"
            rows.append(("bot", f"{k}:{n}", start + dt.timedelta(hours=30 * k + n), text))
        rows += [("bot", "", start, "x"), ("bot", "y" * 201, start, "x"), (None, "0:1", start, None), ("bot", None, start, "x")]
        rows += [rows[draw.randint(0, 29)] for _ in range(5)]
        if files:
            rows += [draw.choice(draw.choice(files)[:30]) for _ in range(8)]
        files.append(rows)
    return files


@pytest.fixture
def setting(spark, tmp_path):
    path = str(tmp_path / "in")
    files = made()

    def deliver(some):
        for rows in some:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    outcomes = spark.createDataFrame(
        [(f"115:https://115.com/s/sw{c}?password=ab{c:02}", "invalid" if c % 5 == 0 else "valid") for c in range(1, 41) if c % 6], "source_key string, outcome string"
    )
    works = spark.createDataFrame([(k, f"work{k}", 1990 + k, "unknown", "media") for k in range(5)], WORKS)
    stream = lambda: S.read_stream(spark, path, C.StructType.fromDDL(SCHEMA))
    return files, deliver, lambda store: C.run(stream(), store, lambda: outcomes, works)


def tables(spark, store):
    return {t: sorted(map(tuple, store.table(spark, t).collect()), key=str) for t in store.tables}


def plainly(files):
    """By a loop over the batches: the owner of each key, the status of each message, the receipts."""
    key = lambda c: f"115:https://115.com/s/sw{c}?password=ab{c:02}"
    owners, status, receipts = {}, {}, []
    for rows in files:
        batch, counts = {}, {}
        for service, event_id, at, text in rows:
            k = (service or "unknown", event_id)
            counts[k] = counts.get(k, 0) + 1
            if event_id is not None and 1 <= len(event_id) <= 200:
                batch.setdefault(k, (at, k, text or ""))
        new = sorted((v for k, v in batch.items() if k not in status))
        for k, n in counts.items():
            if k not in batch:
                receipts.append((*k, n, "rejected", False))
            elif k in status:
                receipts.append((*k, n, status[k], False))
        for _, k, text in new:
            said = []
            for line in text.split("\n"):
                if "115.com" in line:
                    c = int(line.split("/s/sw")[1].split("?")[0])
                    state = "pending" if c % 6 == 0 else "invalid" if c % 5 == 0 else "valid"
                    said.append((state, key(c)))
                elif line.startswith("ed2k"):
                    said.append(("valid", "ed2k:" + line.split("|")[4].upper()))
            mine = [s for s in said if s[0] == "valid" and owners.setdefault(s[1], k) == k]
            states = [s for s, _ in said]
            if not said:
                status[k] = "ignored"
            elif "pending" in states:
                status[k] = "pending_validation"
            elif "valid" in states:
                status[k] = "imported" if "invalid" in states or mine else "duplicate"
            else:
                status[k] = "failed"
        receipts += [(*k, counts[k], status[k], True) for _, k, _ in new]
    return owners, status, receipts


def test_the_chain_equals_a_loop(spark, setting, tmp_path):
    files, deliver, run = setting
    store = C.store(str(tmp_path / "c"), buckets=2, merged=2)
    for rows in files:  # started again for each file
        deliver([rows])
        run(store)
    owners, status, receipts = plainly(files)
    got = tables(spark, store)
    assert {r[0]: (r[3], r[4]) for r in got["resources"]} == owners and len(got["resources"]) == len(owners)
    assert {r[:2]: r[4] for r in got["deliveries"]} == status and len(got["deliveries"]) == len(status)
    assert got["receipts"] == sorted(receipts, key=str)
    # title and year of stored works lead to them, others to one new work each
    works = {(r[6], r[7]): r[8] for r in got["resources"] if r[6].startswith("work")}
    assert all(works[(f"work{k}", 1990 + k)] == k for k in range(5) if (f"work{k}", 1990 + k) in works) and len(set(works.values())) == len(works)


@pytest.mark.parametrize("place", ["links", "after"])
def test_a_chain_that_was_stopped_goes_on(spark, setting, tmp_path, monkeypatch, place):
    files, deliver, run = setting
    deliver(files)
    whole, broken = (C.store(str(tmp_path / n), buckets=2, merged=2) for n in "wb")
    run(whole)
    write, commit, stops = C.Store.write, C.Store.commit, iter([True])

    def stop():
        if next(stops, False):
            raise RuntimeError("lost")

    def writing(self, df, table, folder):
        done = write(self, df, table, folder)
        if table == place and folder == "batch-1":
            stop()
        return done

    def committing(self, spark, number, *rest):
        commit(self, spark, number, *rest)
        if place == "after" and number == 1:
            stop()

    monkeypatch.setattr(C.Store, "write", writing)
    monkeypatch.setattr(C.Store, "commit", committing)
    with pytest.raises(Exception, match="lost"):
        run(broken)
    assert broken.manifest(spark)[0] < 2
    run(broken)
    assert broken.manifest(spark)[0] == 2 and tables(spark, broken) == tables(spark, whole)
    run(broken)  # nothing new, nothing changes
    assert tables(spark, broken) == tables(spark, whole)


def test_a_chain_without_messages(spark, tmp_path):
    store = C.store(str(tmp_path / "none"))
    assert store.manifest(spark) == (-1, [], []) and store.table(spark, "links").count() == 0


def test_live_link_states_equal_the_fold(spark, tmp_path):
    from shelfmark.operators import retry
    from shelfmark.streaming import retries

    spark.conf.set(*retries.STATE_STORE)
    try:
        draw, rows, start = random.Random(4), [], dt.datetime(2024, 1, 1)
        for link in range(40):
            for k in range(draw.randint(1, 9)):
                rows.append((link, start + dt.timedelta(hours=draw.randint(0, 3) + 5 * k), k, draw.choice(["transient"] * 6 + ["gate"] * 3 + ["valid", "invalid"])))
        # a link that falls silent, and one attempt long after that moves the watermark past its next one
        rows += [(100, start, 0, "transient"), (101, start + dt.timedelta(days=30), 0, "valid")]
        schema = "link long, attempt_at timestamp, place long, outcome string"
        rows.sort(key=lambda r: r[1])
        path = str(tmp_path / "a")
        for part in (rows[:50], rows[50:110], rows[110:-1], rows[-1:], [(101, start + dt.timedelta(days=31), 1, "valid")]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = S.read_stream(spark, path, C.StructType.fromDDL(schema))
        seen = S.run_once(retries.live_link_states(stream, "link", most=4), ["link", "event"]).collect()
        want = {r["link"]: tuple(r)[1:] for r in retry.link_states(spark.createDataFrame(rows, schema), "link", ["place"], most=4).collect()}
        assert {r["link"]: (r["status"], r["attempts"], r["next_retry_at"]) for r in seen if r["event"] == "state"} == want
        waiting = {k for k, v in want.items() if v[0] == "pending_validation"}
        assert {r["link"] for r in seen if r["event"] == "due"} >= waiting and 100 in waiting
        assert all(r["next_retry_at"] == want[r["link"]][2] for r in seen if r["event"] == "due" and r["link"] in waiting)
    finally:
        spark.conf.unset(retries.STATE_STORE[0])
