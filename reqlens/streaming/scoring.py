"""Streaming counterparts of scoring and of the traffic summaries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.models.bundle import ModelSet
from reqlens.operators import decide
from reqlens.plans import scoring
from reqlens.sources.artefacts import Reloader, Store
from reqlens.streaming.rate_state import stream_rate_state


def without_duplicates(requests: DataFrame, key: str = "event_id",
                       watermark: str = "10 minutes") -> DataFrame:
    """Drops redelivered requests within the watermark."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def score_stream(requests: DataFrame, models: ModelSet | None = None,
                 settings: Settings = DEFAULTS, measured: bool = False, **state) -> DataFrame:
    """Request stream -> decisions, with the same column functions as batch. Features
    are derived for models, or if `measured`."""
    accepted, _ = scoring.accept(requests, settings)
    shaped = scoring.shape(accepted, settings, measured=models is not None or measured)
    return scoring.judge(stream_rate_state(shaped, settings, **state), models, settings)


def refused_stream(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return scoring.accept(requests, settings)[1]


def log_stream(requests: DataFrame, models: ModelSet | None = None,
               settings: Settings = DEFAULTS, **state) -> DataFrame:
    scored = score_stream(requests, models, settings, measured=True, **state)
    return decide.to_event_log(scored, settings)


def batch_sink(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """A sink keyed by query and batch: a batch that is run again after a failure replaces
    its own rows. Read the log with spark.read.parquet(path)."""
    def sink(log: DataFrame, batch_id: int) -> None:
        log.write.mode("overwrite").parquet(f"{path}/query={name}/batch={batch_id}")
    return sink


def score_with_reload(requests: DataFrame, store: Store, sink: Callable[[DataFrame, int], None],
                      name: str, settings: Settings = DEFAULTS, available_now: bool = False,
                      checkpoint: str | None = None, **state):
    """Scores every micro-batch with the newest published model, and names its version in
    every row (model_version). A model changes between batches, never inside one.
    `sink(log, batch_id)` should be idempotent per batch id, as batch_sink is. The stream's
    own state is kept at `checkpoint`, by default beside the models, so that a restart goes
    on where it ended. Returns the started query."""
    accepted, _ = scoring.accept(requests, settings)
    rated = stream_rate_state(scoring.shape(accepted, settings), settings, **state)
    reloader = Reloader(store, settings)

    def handle(batch: DataFrame, batch_id: int) -> None:
        models = reloader.get(batch.sparkSession)
        log = decide.to_event_log(scoring.judge(batch, models, settings), settings)
        # Kept while the sink works: it may use the log more than once, and the state is behind it.
        log = log.withColumn("model_version", F.lit(reloader.version).cast("string")).persist()
        try:
            sink(log, batch_id)
        finally:
            log.unpersist()

    writer = (rated.writeStream.foreachBatch(handle).queryName(name)
              .option("checkpointLocation", checkpoint or f"{store.root}/_streams/{name}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 second")
    return writer.start()


def stream_series(events: DataFrame, time: str = "time", seconds: int = 5,
                  watermark: str = "10 minutes") -> DataFrame:
    """Allowed and blocked per tumbling window; non-empty windows, final once."""
    def ones(action):
        return F.sum(F.when(F.col("action") == action, 1).otherwise(0)).alias(
            "allowed" if action == "allow" else "blocked")
    return (events.withWatermark(time, watermark)
            .groupBy(F.window(time, f"{seconds} seconds").alias("w"))
            .agg(ones("allow"), ones("block"))
            .select(F.col("w.start").alias("bin"), "allowed", "blocked"))


def stream_counters(events: DataFrame) -> DataFrame:
    """Running totals per (enforced, layer); for complete or update mode."""
    return events.groupBy("enforced", "layer").agg(F.count(F.lit(1)).alias("n"))


def stream_session_spread(requests: DataFrame, settings: Settings = DEFAULTS,
                          watermark: str = "10 minutes") -> DataFrame:
    """Per closed session: requests and approximately distinct templates, in
    constant memory."""
    gap = f"{settings.session_gap_seconds} seconds"
    return (requests.withWatermark("ts", watermark)
            .groupBy("client", F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.approx_count_distinct("template").alias("templates"))
            .select("client", F.col("w.start").alias("session_start"), "requests", "templates"))
