"""Session helpers: sensible local defaults, and reliable lineage cuts."""
from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "reqlens", **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster, use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Small files are cut by row groups, so that they keep all cores busy.
        .config("spark.sql.files.maxPartitionBytes", "4m")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A local
    master without one, as in tests, gets a temporary folder; a cluster must name
    one, as its nodes could not read each other's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="reqlens-ckpt-"))
    return _FALLBACK[0]


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably. Lost executors then cost a re-read, not a re-run."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)
