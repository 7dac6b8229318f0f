"""Streams replayed from files agree with the batch operators."""
import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS
from reqlens.operators import rates, requests
from reqlens.plans import scoring
from reqlens.schemas import REQUEST
from reqlens.sources import logs
from reqlens.streaming import scoring as streams
from reqlens.streaming.rate_state import stream_rate_state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
S = DEFAULTS.but(burst_limit=6, window_limit=20)


def records(n=240):
    out, at = [], 0
    for i in range(n):
        at += [0, 900_000, 200_000, 30_000_000, 125_000_000][0 if i % 7 else (i // 7) % 5]
        at += 150_000
        out.append({
            "event_id": i, "client": f"c{i % 3}",
            "ts": (T0 + timedelta(microseconds=at)).isoformat().replace("+00:00", "Z"),
            "method": "GET", "path": f"/api/{'abcde'[i % 5]}/{i}",
            "query": "q=' union select a from b --" if i % 50 == 7 else "", "body": "{\"k\": 1}",
            "status": 200})
    return out


@pytest.fixture()
def folder(tmp_path):
    rows = records()
    for part in range(4):
        with open(tmp_path / f"p{part}.json", "w") as fh:
            for r in rows[part * 60:(part + 1) * 60]:
                fh.write(json.dumps(r) + "\n")
        os.utime(tmp_path / f"p{part}.json", (1_700_000_000 + part,) * 2)
    return str(tmp_path)


def drain(df, name, tmp, mode="append"):
    query = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_rates_and_decisions_equal_batch(spark, folder, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("s")
    cols = ["event_id", "window_count", "burst_count", "window_distinct", "rate_limited",
            "action", "layer", "reason", "status"]
    batch = scoring.score_requests(spark.read.schema(REQUEST).json(folder), None, S)
    stream = streams.score_stream(
        logs.request_stream(spark, folder, max_files=1), None, S)
    got = drain(stream, "scored", tmp).select(cols).orderBy("event_id").collect()
    want = batch.select(cols).orderBy("event_id").collect()
    assert got == want
    assert {r.layer for r in got} == {"L1-rules", "L1-rate", "L1-only"}


def test_reset_clears_one_client(spark, folder, tmp_path):
    df = requests.to_request(logs.request_stream(spark, folder)).withColumn(
        "kind", F.when(F.col("event_id") == 120, "reset"))
    out = drain(stream_rate_state(df, S), "reset", tmp_path)
    assert out.filter("event_id = 120").count() == 0
    first = out.filter("client = 'c0' and event_id > 120").orderBy("event_id").first()
    assert (first.window_count, first.window_distinct) == (1, 1)


def test_late_rows_are_scored_and_degraded(spark, tmp_path_factory):
    src, tmp = tmp_path_factory.mktemp("late"), tmp_path_factory.mktemp("s")
    rows = [(0, 100), (1, 200), (2, 10)]
    for i, sec in rows:
        with open(src / f"{i}.json", "w") as fh:
            fh.write(json.dumps({"event_id": i, "client": "a", "path": "/x",
                                 "ts": (T0 + timedelta(seconds=sec)).isoformat()}) + "\n")
        os.utime(src / f"{i}.json", (1_700_000_000 + i,) * 2)
    df = requests.to_request(logs.request_stream(spark, str(src), max_files=1))
    got = drain(stream_rate_state(df, S, lateness_seconds=60), "late", tmp).orderBy("event_id")
    assert [r.rate_degraded for r in got.collect()] == [False, False, True]


def test_series_counters_and_sessions(spark, folder, tmp_path):
    raw = requests.to_request(logs.request_stream(spark, folder)).withColumns(
        {"action": F.when(F.col("event_id") % 4 == 0, "block").otherwise("allow"),
         "layer": F.lit("L1-rules"), "enforced": F.col("event_id") % 8 == 0,
         "time": F.col("ts")})
    series = drain(streams.stream_series(raw, watermark="1 second"), "series", tmp_path)
    assert series.groupBy("bin").count().filter("count > 1").count() == 0
    assert 0 < series.agg(F.sum("allowed") + F.sum("blocked")).first()[0] <= 240
    counters = drain(streams.stream_counters(raw), "counters", tmp_path, "complete")
    assert counters.agg(F.sum("n")).first()[0] == 240
    spread = drain(streams.stream_session_spread(raw, watermark="1 second"), "spread", tmp_path)
    assert spread.count() > 3 and spread.filter("templates > requests").count() == 0


def test_log_sink_partitions_and_hides_text(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    query = logs.write_event_log(
        streams.log_stream(logs.request_stream(spark, folder), None, S), out, "sink",
        available_now=True)
    query.awaitTermination()
    log = logs.read_event_table(spark, out)
    assert log.count() == 240 and log.filter("dt = DATE'2024-01-01'").count() == 240
    assert not {"path", "query", "body", "user_agent"} & set(log.columns)
    assert log.filter("length(client) <> 16").count() == 0


def test_duplicates_drop_within_watermark(spark, folder, tmp_path):
    raw = logs.request_stream(spark, folder)
    twice = raw.unionByName(raw)
    assert drain(streams.without_duplicates(twice, watermark="1 day"), "dedup",
                 tmp_path).count() == 240


def replay(spark, batches, tmp_path_factory, **state):
    """Batches of (event_id, client, second, template) through the rate state, in turn."""
    src, tmp = tmp_path_factory.mktemp("replay"), tmp_path_factory.mktemp("ck")
    for k, rows in enumerate(batches):
        with open(src / f"{k:03d}.json", "w") as fh:
            for i, client, sec, template in rows:
                fh.write(json.dumps({"event_id": i, "client": client, "path": template, "template": template,
                                     "ts": (T0 + timedelta(seconds=sec)).isoformat()}) + "\n")
        os.utime(src / f"{k:03d}.json", (1_700_000_000 + k,) * 2)
    df = requests.to_request(logs.request_stream(spark, str(src), max_files=1))
    query = (stream_rate_state(df, S, **state).writeStream.format("memory").queryName(f"r{tmp.name.replace('-', '_')}")
             .option("checkpointLocation", str(tmp)).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = {r.event_id: r for r in spark.table(query.name).collect()}
    return rows, [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_state_does_not_grow_with_the_flood_and_expires(spark, tmp_path_factory):
    def flood(first, sec, n):
        return [(first + i, "hot", sec + i % 2, "/x") for i in range(n)]
    small, few = replay(spark, [flood(0, 0, 20), flood(20, 2, 20)], tmp_path_factory)
    large, many = replay(spark, [flood(0, 0, 2000), flood(2000, 2, 2000), [(9000, "other", 10_000, "/y")]], tmp_path_factory)
    assert few[1]["numRowsTotal"] == many[1]["numRowsTotal"] > 0
    assert large[3999].window_count == 4000 and small[39].window_count == 40
    # The last batch moves the stream on: only the other client is left, and the replay ended.
    assert many[-1]["numRowsTotal"] < many[1]["numRowsTotal"]


def test_a_batch_touches_its_own_templates_only(spark, tmp_path_factory):
    def updated(breadth):
        first = [(i, "a", i % 30, f"/t{i}") for i in range(breadth)]
        rows, progress = replay(spark, [first, [(9000, "a", 31, "/t1"), (9001, "a", 32, "/new")]], tmp_path_factory)
        assert (rows[9000].window_distinct, rows[9001].window_distinct) == (breadth, breadth + 1)
        return progress[1]["numRowsUpdated"]
    assert updated(10) == updated(300)


def test_batches_equal_one_batch_and_forgotten_clients_are_marked(spark, tmp_path_factory):
    rows = [(i, f"c{i % 2}", sec, f"/t{i % 5}") for i, sec in enumerate(
        [0, 0, 1, 30, 59, 60, 61, 100, 180, 181, 299, 300, 301, 301, 420, 700])]
    once, _ = replay(spark, [rows], tmp_path_factory)
    split, _ = replay(spark, [rows[:3], rows[3:9], rows[9:10], rows[10:]], tmp_path_factory)
    cols = ["window_count", "burst_count", "window_distinct", "rate_degraded"]
    assert {i: [r[c] for c in cols] for i, r in once.items()} == {i: [r[c] for c in cols] for i, r in split.items()}
    late, _ = replay(spark, [[(0, "a", 0, "/x")], [(1, "b", 5000, "/x")], [(2, "b", 5001, "/x")], [(3, "a", 1, "/y")]],
                     tmp_path_factory)
    assert len(late) == 4 and late[3].rate_degraded and late[3].window_count == 1
    assert not late[2].rate_degraded
