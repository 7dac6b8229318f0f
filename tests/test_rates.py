"""Rate operators against a brute-force replay."""
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS
from reqlens.operators import rates

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def replay(rows, s=DEFAULTS):
    """Arrival-order replay: what a per-client counter store would answer."""
    out, stamps, seen, last = {}, {}, {}, {}
    for client, at, template, arrival in sorted(rows, key=lambda r: (r[1], r[3])):
        if client in last and at - last[client] >= s.session_gap_seconds * 10**6:
            seen[client] = set()
        last[client] = at
        stamps.setdefault(client, []).append(at)
        seen.setdefault(client, set()).add(template)
        w = sum(1 for x in stamps[client] if x > at - s.window_seconds * 10**6)
        b = sum(1 for x in stamps[client] if x > at - s.burst_seconds * 10**6)
        out[arrival] = (w, b, len(seen[client]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(c, T0 + timedelta(microseconds=a), t, i) for c, a, t, i in rows],
        "client string, ts timestamp, template string, event_id bigint")


def random_rows(seed, n=600):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 400_000, 1_000_000, 5_000_000, 59_999_999, 60_000_000,
                          119_999_999, 120_000_000]) if rng.random() < 0.3 else rng.randrange(200_000)
        client = "hot" if rng.random() < 0.4 else f"c{rng.randrange(5)}"
        rows.append((client, at, f"/t{rng.randrange(9)}", i))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [3, 65_536])
def test_rate_state_equals_replay(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(rates, "CHUNK", chunk)
    rows = random_rows(seed)
    want = replay(rows)
    df = frame(spark, rows)
    got = {r.event_id: (r.window_count, r.burst_count, r.window_distinct)
           for r in rates.rate_state(df).collect()}
    assert got == want
    counts = {r.event_id: (r.window_count, r.burst_count)
              for r in rates.sliding_counts(df).collect()}
    assert counts == {k: v[:2] for k, v in want.items()}
    distinct = {r.event_id: r.window_distinct for r in rates.session_distinct(df).collect()}
    assert distinct == {k: v[2] for k, v in want.items()}


def test_window_is_half_open(spark):
    rows = [("a", 0, "/", 1), ("a", 60_000_000, "/", 2),
            ("b", 0, "/", 3), ("b", 59_999_999, "/", 4)]
    got = {r.event_id: r.window_count for r in rates.sliding_counts(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}


def test_session_gap_boundary(spark):
    rows = [("a", 0, "/x", 1), ("a", 119_999_999, "/y", 2), ("b", 0, "/x", 3),
            ("b", 120_000_000, "/y", 4)]
    got = {r.event_id: r.window_distinct
           for r in rates.session_distinct(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1}


def test_limits_are_strict_and_burst_wins(spark):
    df = spark.createDataFrame([(40, 240), (41, 240), (40, 241), (41, 241)],
                               "burst_count int, window_count int")
    got = [(r.rate_limited, r.rate_reason) for r in rates.with_verdict(df).collect()]
    assert [g[0] for g in got] == [False, True, True, True]
    assert got[1][1] == "burst limit exceeded: 41 requests in 5s (limit 40)"
    assert got[2][1] == "rate limit exceeded: 241 requests in 60s (limit 240)"
    assert got[3][1].startswith("burst")


def test_burst_of_80_trips(spark):
    rows = [("a", i * 10_000, "/", i) for i in range(80)]
    out = rates.rate_state(frame(spark, rows))
    assert out.filter("rate_limited").count() == 40


def test_hot_client_and_instant(spark):
    """One client holding most rows at one instant keeps exact arrival order."""
    df = spark.range(5_000).select(
        F.col("id").alias("event_id"), F.lit("hot").alias("client"),
        F.timestamp_micros(F.lit(0)).alias("ts"),
        F.concat(F.lit("/"), (F.col("id") % 7).cast("string")).alias("template"))
    out = rates.rate_state(df)
    assert out.filter("window_count <> event_id + 1").count() == 0
    assert out.filter("window_distinct <> least(event_id + 1, 7)").count() == 0


def test_missing_counters_degrade(spark):
    r = rates.without_counters(spark.range(1)).first()
    assert (r.window_count, r.rate_limited, r.rate_degraded) == (0, False, True)


def test_requests_without_client_or_time_are_kept(spark):
    df = frame(spark, [("a", 0, "/x", 1), ("a", 5, "/y", 2)]).unionByName(spark.sql(
        "SELECT string(null) AS client, timestamp(null) AS ts, string(null) AS template, id AS event_id "
        "FROM range(3, 6)"))
    got = {r.event_id: (r.window_count, r.window_distinct) for r in rates.rate_state(df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (2, 1), 5: (3, 1)}


def test_a_flood_spreads_over_spans(spark):
    """One client with every row inside one window: no span holds more than its part, and
    spans carry the totals."""
    df = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("hot").alias("client"),
                                    F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.lit("/").alias("template"))
    cells = rates._keyed(df, "client", "ts", "event_id").groupBy(*rates.KEYS).agg(F.count(F.lit(1)).alias("_n"))
    line = rates._timeline(cells, {}, rates._width(DEFAULTS), 120_000_000).orderBy("_span").collect()
    assert [r["_before"] for r in line] == list(range(0, 60_000, 1000)) and {r["_start"] for r in line} == {0}
    out = rates.rate_state(df)
    assert out.filter("window_count <> least(event_id + 1, 60000) or window_distinct <> 1").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("busy", [0, 150, 100_000])
def test_long_and_short_clients_agree_with_replay(spark, monkeypatch, seed, busy):
    """Clients cut into spans, clients in one pass, and both in one input."""
    monkeypatch.setattr(rates, "BUSY", busy)
    rows = random_rows(seed)
    want = replay(rows)
    df = frame(spark, rows)
    got = {r.event_id: (r.window_count, r.burst_count, r.window_distinct) for r in rates.rate_state(df).collect()}
    assert got == want
    counts = {r.event_id: (r.window_count, r.burst_count) for r in rates.sliding_counts(df).collect()}
    assert counts == {k: v[:2] for k, v in want.items()}
    distinct = {r.event_id: (r.window_distinct, r.session_start) for r in rates.session_distinct(df).collect()}
    assert {k: v[0] for k, v in distinct.items()} == {k: v[2] for k, v in want.items()}
    monkeypatch.setattr(rates, "BUSY", 0)
    assert distinct == {r.event_id: (r.window_distinct, r.session_start) for r in rates.session_distinct(df).collect()}


def test_short_clients_are_shuffled_once(spark):
    """No client over the bound: after the count of clients, rows go through one exchange."""
    df = frame(spark, random_rows(5))
    out = rates.rate_state(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 1 <= plan.count("Exchange hashpartitioning(") <= 2


def test_scoring_splits_before_it_reads_texts(spark, monkeypatch):
    """Long clients take their own way, and no text is decoded for both."""
    from reqlens.plans import scoring
    df = frame(spark, random_rows(6)).withColumns({"path": F.col("template"), "body": F.lit("a%2Bb"), "status": F.lit(200)})

    def scored(busy):
        monkeypatch.setattr(rates, "BUSY", busy)
        out = scoring.score_requests(df)
        return out, sorted(map(str, out.select("event_id", "window_count", "window_distinct", "layer", "path_len",
                                               "body_entropy", "session_start").collect()))
    _, want = scored(100_000)
    out, got = scored(150)
    assert got == want
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    payload, split = (next(i for i, x in enumerate(lines) if mark in x) for mark in ("ArrowEvalPython [payload", "LeftAnti"))
    assert payload < split


def test_scoring_short_clients_reads_and_shuffles_once(spark):
    """No client over the bound: texts are decoded once, and scored rows go through one exchange."""
    from reqlens.plans import scoring
    df = frame(spark, random_rows(7)).withColumns({"path": F.col("template"), "body": F.lit("a%2Bb"), "status": F.lit(200)})
    out = scoring.score_requests(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert 1 <= plan.count("Exchange hashpartitioning(") <= 2
    assert plan.count("ArrowEvalPython [payload") == 1
