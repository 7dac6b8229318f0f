"""Streams replayed from the event table to completion."""
from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from registry import query
from registry.inputs import (DAY, LOG_COLUMNS, LOG_DERIVED, LOG_SQL, LOG_VERDICT, REQUEST_COLUMNS,
                             REQUESTS_SQL, columns_of, with_)
from registry.rating import _COUNTS_SQL, _SESSION_SQL
from reqlens.schemas import EVENT_LOG, SCALER
from reqlens.session import checkpoint_root
from reqlens.sources import artefacts, logs
from reqlens.streaming import scoring as streams
from reqlens.streaming.rate_state import stream_rate_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = f"{sf}/events.parquet"
    # As a pattern, since the source takes a plain path for a directory.
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(spark, sf):
    return _events(spark, sf).select(
        *[F.expr(sql).alias(n) for n, sql in REQUEST_COLUMNS.items()], "ts")


def _log(spark, sf):
    df = _events(spark, sf).select(
        *[F.expr(sql).alias(n) for n, sql in LOG_COLUMNS.items()], F.col("ts").alias("time"))
    for step in (LOG_DERIVED, LOG_VERDICT):
        df = df.withColumns(columns_of(step))
    return df


def _drain(df, mode="append"):
    """Runs the stream over all available input into a table in a fresh folder."""
    spark = df.sparkSession
    root = f"{checkpoint_root(spark)}/replay-{uuid.uuid4().hex}"
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{root}/out")
    else:
        def keep(batch, _):
            batch.write.mode("overwrite").parquet(f"{root}/out")
        writer = df.writeStream.foreachBatch(keep)
    query_ = writer.outputMode(mode).option("checkpointLocation", f"{root}/ck").trigger(
        availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query("stream_rate_state", with_(REQUESTS_SQL, _COUNTS_SQL, _SESSION_SQL) + """
SELECT event_id, window_count, burst_count, window_distinct,
  (burst_count > 4 OR window_count > 8) AS rate_limited FROM cnt JOIN ses USING (event_id)""")
def stream_rate(spark, sf):
    out = stream_rate_state(_requests(spark, sf), DAY, resolution_us=1)  # times have microseconds
    return _drain(out.select("event_id", "window_count", "burst_count", "window_distinct",
                             "rate_limited"))


# Every 37th request becomes an operator's order to clear its client's counters.
_RESET_SQL = """reset AS (SELECT event_id, template, us, client || '#' || sum(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY client ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS client FROM req),
  rest AS (SELECT * FROM reset WHERE event_id % 37 <> 0)"""


@query("stream_reset", with_(REQUESTS_SQL, _RESET_SQL, _COUNTS_SQL.replace("FROM req", "FROM rest"),
                             _SESSION_SQL.replace("FROM req", "FROM rest")) + """
SELECT event_id, window_count, burst_count, window_distinct FROM cnt JOIN ses USING (event_id)""")
def stream_reset(spark, sf):
    kind = F.when(F.col("event_id") % 37 == 0, "reset").otherwise("request")
    out = stream_rate_state(_requests(spark, sf).withColumn("kind", kind), DAY, resolution_us=1)
    return _drain(out.select("event_id", "window_count", "burst_count", "window_distinct"))


@query("stream_decisions", with_(REQUESTS_SQL, _COUNTS_SQL) + """
SELECT event_id, CASE WHEN burst_count > 4 OR window_count > 8 THEN 'L1-rate' ELSE 'L1-only' END
  AS layer, (burst_count > 4 OR window_count > 8) AS enforced FROM cnt""")
def stream_decisions(spark, sf):
    out = streams.score_stream(_requests(spark, sf), None, DAY, resolution_us=1)
    return _drain(out.select("event_id", "layer", "enforced"))


@query("stream_counters", with_(LOG_SQL) + """
SELECT enforced, layer, count(*) AS n FROM log GROUP BY enforced, layer""")
def stream_counters(spark, sf):
    return _drain(streams.stream_counters(_log(spark, sf)), "complete")


def _closed(df, time):
    """The stream with its first event once more, far ahead: it moves the watermark
    past all windows of the others, and its own stays open."""
    ahead = df.filter("event_id = 0").withColumn(time, F.col(time) + F.expr("INTERVAL 20 YEARS"))
    return df.unionByName(ahead)


@query("stream_series", with_(LOG_SQL) + """
SELECT us // 3600000000 * 3600 AS bin, count(*) FILTER (action = 'allow') AS allowed,
  count(*) FILTER (action = 'block') AS blocked FROM log GROUP BY 1""")
def stream_series(spark, sf):
    """Hourly windows, all of them."""
    out = streams.stream_series(_closed(_log(spark, sf), "time"), seconds=3600, watermark="1 second")
    return _drain(out.withColumn("bin", F.unix_seconds("bin")))


@query("stream_sessions", with_(REQUESTS_SQL, _SESSION_SQL) + """
SELECT client, start_us AS session_start, count(*) AS requests, count(DISTINCT template) AS templates
FROM s2 GROUP BY client, start_us""")
def stream_sessions(spark, sf):
    """All sessions; their few templates are far below where the sketch errs."""
    out = streams.stream_session_spread(_closed(_requests(spark, sf), "ts"), DAY, "1 hour")
    return _drain(out.withColumn("session_start", F.unix_micros("session_start")))


@query("stream_deduplicated", "SELECT event_id FROM events")
def stream_deduplicated(spark, sf):
    """Every request delivered twice."""
    raw = _requests(spark, sf)
    return _drain(streams.without_duplicates(raw.unionByName(raw), watermark="60 days").select(
        "event_id"))


SWAP_ROWS = 100_000  # of two files of the replay, about


@query("stream_model_swap", with_(REQUESTS_SQL, _COUNTS_SQL) + """
SELECT CASE WHEN early THEN 'lenient' ELSE 'strict' END AS model_version, CASE WHEN early THEN 0 ELSE 1 END AS batch,
  CASE WHEN burst_count > 4 OR window_count > 8 THEN 'L1-rate' WHEN early THEN '' ELSE 'L4-meta' END AS layer, count(*) AS n
FROM (SELECT *, us < (SELECT (min(us) + max(us)) // 2 FROM req) AS early FROM cnt) GROUP BY ALL""")
def stream_model_swap(spark, sf):
    """Two batches of requests; a stricter model is published between them, and the first
    batch is delivered to the sink twice."""
    from registry.models import _hand_written
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = f"{checkpoint_root(spark)}/swap-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(
        *[F.expr(sql).alias(n) for n, sql in REQUEST_COLUMNS.items()], "ts")
    at = F.unix_micros("ts")
    middle, n = rows.agg(F.expr("(min(unix_micros(ts)) + max(unix_micros(ts))) div 2"), F.count(F.lit(1))).first()
    rows.filter(at < middle).repartition(n // SWAP_ROWS + 1).write.parquet(f"{root}/in")
    files = len(spark.read.schema(rows.schema).parquet(f"{root}/in").inputFiles())  # of the first batch
    rows.filter(at >= middle).repartition(files).write.mode("append").parquet(f"{root}/in")  # no more than those

    store, models = artefacts.Store(f"{root}/models"), _hand_written(spark)
    table = spark.createDataFrame([(n, m, s) for n, (m, s) in models.scaler.items()], SCALER)
    for version, threshold in (("lenient", 1.1), ("strict", 0.0)):
        artefacts.save_models(spark, store, version, {
            "scaler": table, "nodes": models.nodes, "trees": 2, "sample": models.sample, "network": models.network,
            "meta": models.meta})
        artefacts.save_decision(spark, store, version, {
            "feature_names": models.feature_names, "threshold": threshold, "if_lo": models.ranges["if"][0],
            "if_hi": models.ranges["if"][1], "ae_lo": models.ranges["ae"][0], "ae_hi": models.ranges["ae"][1]})
    artefacts.publish(spark, store, "lenient")
    keep = streams.batch_sink(f"{root}/log", "gateway")

    def sink(log, batch_id):
        keep(log, batch_id)
        if batch_id == 0:
            keep(log, batch_id)
            artefacts.publish(log.sparkSession, store, "strict")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    streams.score_with_reload(source, store, sink, f"swap{uuid.uuid4().hex}", DAY, available_now=True,
                              resolution_us=1).awaitTermination()
    log = spark.read.schema(EVENT_LOG + ", model_version STRING, query STRING, batch INT").parquet(f"{root}/log")
    return log.groupBy("model_version", "batch", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("log_lines", """
SELECT count(*) AS lines, count(*) FILTER (event_id % 10 = 0) AS blank, count(*) FILTER (event_id % 10 = 1) AS malformed,
  count(*) FILTER (event_id % 10 = 2) AS repaired, count(*) FILTER (event_id % 10 > 1) AS rows,
  count(*) FILTER (event_id % 10 > 1 AND event_type = 'error') AS errors FROM events""")
def log_lines(spark, sf):
    """A JSON-lines log of the events with blank, cut and badly encoded lines, and what
    reading it counts on the way."""
    event = spark.read.parquet(f"{sf}/events.parquet")
    line = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"),
                              F.col("event_type").alias("action"), F.lit("GET").alias("method")))
    part = F.col("event_id") % 10
    raw = (F.when(part == 0, F.lit("  ").cast("binary")).when(part == 1, F.lit('{"ts": 1, "act').cast("binary"))
           .when(part == 2, F.concat(F.encode(F.regexp_replace(line, '"GET".*$', '"G'), "utf-8"), F.unhex(F.lit("FF")),
                                     F.encode(F.lit('ET"}'), "utf-8"))).otherwise(F.encode(line, "utf-8")))
    path = f"{checkpoint_root(spark)}/lines-{uuid.uuid4().hex}"
    event.select(raw.cast("string").alias("value")).write.text(path)  # bytes as they are
    seen = Observation()
    read = logs.read_event_log(spark, path, seen).filter("method = 'GET'")
    found = read.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("action") == "error").alias("errors")).first()
    counts = seen.get
    return spark.createDataFrame([(*[counts[c] for c in ("lines", "blank", "malformed", "repaired")], found["rows"],
                                   found["errors"])], "lines long, blank long, malformed long, repaired long, rows long, errors long")
