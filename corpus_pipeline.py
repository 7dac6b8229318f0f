"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, binary output."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqlens.llm.common import stored
from reqlens.llm.decontaminate import remove_contaminated
from reqlens.llm.mixing import mixed
from reqlens.llm.neardup import NearDup, deduplicate
from reqlens.llm.quality import keep_quality
from reqlens.llm.tokenbinary import token_shards


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs, NearDup(percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination),
          ("source mix", source_mix), ("token output", token_output)]

#: Near-dedup, the mix and the shards have no SQL form; a brute-force test stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and
    read again, so a lost executor costs the running stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
