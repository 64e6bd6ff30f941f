"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on: AQE picks join strategies from
# measured sizes and splits skewed partitions, UTC keeps time stamps stable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "repoloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="repoloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Store `df` as a table in the checkpoint folder and read it back.

    Used where two branches of a plan must see identical rows (partition numbers of a
    sampled range partitioning) or where the input is costly. Unlike `checkpoint()`,
    which runs the plan once to count and once more to write, this computes it once,
    and later reads take only the columns they need. The table stays until the folder
    is cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    home = f"{ensure_checkpoint_dir(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(home)
    return spark.read.schema(df.schema).parquet(home)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when a stored input has fewer splits than there are cores.

    A table stored as one small row group would keep all later per-file work in one
    task. A large input has many splits and passes through unchanged. For plain scans
    only: counting the partitions plans the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
