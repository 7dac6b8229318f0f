"""Reading and writing event logs and request streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reqlens.schemas import EVENT_LOG, REQUEST


def read_event_log(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """JSON-lines log. Blank lines vanish, malformed ones are dropped and bytes
    that are not UTF-8 are ignored. The schema is given, never inferred.

    `seen` is filled by the action that reads the rows, in the same pass: lines, and of
    these blank, malformed and repaired ones."""
    line = F.col("value")
    # The JSON source would reject a whole record for one bad byte.
    repaired = F.when(F.is_valid_utf8(line), line).otherwise(
        F.replace(F.make_valid_utf8(line), F.lit("\ufffd"), F.lit("")))
    record = F.from_json(repaired, EVENT_LOG + ", _corrupt STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    blank = F.trim(line) == ""
    rows = spark.read.text(path).select(
        blank.alias("blank"), (~F.is_valid_utf8(line)).alias("repaired"), F.when(~blank, record).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull()
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("blank").alias("blank"),
                            F.count_if(~F.col("blank") & ~good).alias("malformed"),
                            F.count_if(good & F.col("repaired")).alias("repaired"))
    return rows.filter(good).select("r.*").drop("_corrupt")


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet log, partitioned by day; filters on `dt` prune directories."""
    return spark.read.schema(EVENT_LOG + ", dt DATE").parquet(path)


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.to_date(F.timestamp_seconds("ts")))


def write_event_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Days are spread by a hash as well, so one busy day is not one task."""
    (with_day(df).withColumn("_spread", F.pmod(F.xxhash64("client", "ts"), F.lit(64)))
     .repartition("dt", "_spread").drop("_spread")
     .write.mode(mode).partitionBy("dt").parquet(path))


def request_stream(spark: SparkSession, path: str, fmt: str = "json",
                   max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def request_stream_kafka(spark: SparkSession, servers: str, topic: str,
                         max_offsets: int | None = None) -> DataFrame:
    """Requests as JSON values of a topic; needs the Kafka connector on the cluster."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    value = F.from_json(F.col("value").cast("string"), REQUEST)
    return reader.load().select(value.alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def write_event_log(df: DataFrame, path: str, name: str, fmt: str = "parquet",
                    available_now: bool = False, interval: str = "1 minute",
                    checkpoint: str | None = None):
    """Starts an append-only sink, partitioned by day; returns the query. Each
    interval writes a file per task and day, so short ones make many small files.
    Progress is kept at `checkpoint`, by default in the log's own folder, where readers
    don't look: a restart goes on where it ended."""
    writer = (with_day(df).writeStream.format(fmt).outputMode("append").partitionBy("dt")
              .option("path", path).option("checkpointLocation", checkpoint or f"{path}/_streams/{name}")
              .queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=interval)
    return writer.start()
