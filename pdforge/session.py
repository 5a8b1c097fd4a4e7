"""Spark session and shared-storage helpers.

Cluster settings (shuffle partitions, AQE, checkpoint dir) are read from the
session when present; defaults are only applied where nothing is configured,
e.g. in tests on ``local[*]``.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app_name: str = "pdforge",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PDFORGE_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is honoured when set; where it is unset, local mode
    (tests) uses a folder under /tmp and a cluster is refused.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = os.environ.get("PDFORGE_CHECKPOINT_DIR", "/tmp/pdforge-checkpoints")
        os.makedirs(d, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a reused intermediate reliably (survives executor loss).

    Uses ``checkpoint()`` into the shared checkpoint folder, never
    ``localCheckpoint``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of bytecode up to which HotSpot compiles a method.
COMPILED_BYTES = 8000


@contextmanager
def compiled_methods(spark: SparkSession):
    """Jobs run inside fuse no more operators than the JVM still compiles.

    A projection of dozens of parsed columns makes one fused method past HotSpot's limit, which then runs in the bytecode
    interpreter for every row; below ``spark.sql.codegen.hugeMethodLimit`` Spark generates code for each operator instead.
    The session's own setting is put back; a lower one stays.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    own = spark.conf.get(key)
    if int(own) <= COMPILED_BYTES:
        yield
        return
    spark.conf.set(key, str(COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used where several actions reuse one expensive intermediate (the joined,
    de-leaked loan table; the grouped score table): later jobs read columnar
    files with pruning instead of re-running the joins, and the lineage is cut,
    so a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
