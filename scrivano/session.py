"""Session helpers: a tuned session for stand-alone runs and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scrivano", master: str | None = None, **conf: str) -> SparkSession:
    """Session for stand-alone runs. On a cluster, pass no master and let spark-submit decide."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, local runs)
    a folder below the warehouse, which is shared as well, takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scrivano-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Arrow batches hold ``most`` bytes, where the session names no limit of its own.

    Spark's default of 64 MB is held several times over by every running task: by the vectors that the
    JVM fills, which double as they grow, by the Python worker, and by what comes back.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, most)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root, for a written intermediate table."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
