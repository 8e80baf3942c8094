"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "fotolake", master: str | None = None, shuffle_partitions: int | None = None):
    """A session in UTC with adaptive execution on.  ``master`` is for local runs;
    on a cluster it comes from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # No call-site capture for each column expression: plans are built much faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a scratch folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return
    if sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the shared checkpoints."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir().rstrip("/")
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read that: computed once, columnar,
    and safe against lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after counting that ``df`` holds at most ``max_rows`` rows.
    Larger sides keep the shuffled join, split by AQE where skewed."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
