"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Counted rows and bytes of keys up to which a settled table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 4 << 20


def build_session(app: str = "quadrat", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut into: the cluster's shared one, else a fresh local one for tests."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet to the folder all executors share, and read back.

    Unlike a `checkpoint()` it is compressed, and who reads it reads only the columns used. Names may hold anything, as
    columns are written by place; columns without a type are not written."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    places = [(f"c{i}", field) for i, field in enumerate(df.schema)]
    kept = [c for c, field in places if not isinstance(field.dataType, NullType)]
    rows = df.toDF(*[c for c, _ in places]).select(*kept)
    rows.write.parquet(path)
    read = df.sparkSession.read.schema(rows.schema).parquet(path)
    return read.select(*[(F.col(c) if c in kept else F.lit(None)).alias(field.name) for c, field in places])


def settled(side: DataFrame, key: str) -> DataFrame:
    """A table of distinct values with what was worked out for each, written once to the checkpoint folder.

    It is broadcast if counting finds it small, so that the rows that look values up stay where they are; else the
    join shuffles both sides. Streams pass as they are."""
    if side.isStreaming:
        return side
    done = written(side)
    rows, size = done.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    return F.broadcast(done) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else done
