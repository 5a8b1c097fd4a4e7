"""Helpers shared by the text operators: table access, worker-side caches, small numeric pieces."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.session import materialize

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows in an Arrow batch where the job sets nothing.
BATCH_BYTES, BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker (functions are shipped by value, so their module globals
    do not). Workers are reused by later stages, so asking for one name frees what other operators held."""
    home = sys.modules.setdefault("_pdforge_worker", types.ModuleType("_pdforge_worker")).__dict__.setdefault("caches", {})
    others = [k for k in home if k != name]
    for other in others:
        del home[other]
    if others:
        give_back()
    return home.setdefault(name, {})


def give_back() -> None:
    """Returns memory that Python and Arrow have freed to the system, which the allocators keep otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most about ``BATCH_BYTES`` of rows at a time to Python and back. Spark's own 64 MB
    are held several times for each task, in the executor and in its worker, and what an allocator once took it keeps. A
    value that the job has set stays."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def row_blocks(batch, max_bytes: int = 1 << 20, column: str = "text"):
    """(slice, texts as bytes) of an Arrow batch, each slice holding about ``max_bytes`` of text
    and at least one row; null text counts as empty. Only one slice's texts are Python objects at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not len(batch):
        return
    col = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < len(ends):
        end = min(int(np.searchsorted(ends, before + max_bytes)) + 1, len(ends))
        part = batch.slice(begin, end - begin)
        yield part, [x or b"" for x in part.column(column).cast(pa.large_binary()).to_pylist()]
        begin, before = end, int(ends[end - 1])


def dense_names(keys: DataFrame, cols: list[str], name: str = "name") -> DataFrame:
    """Distinct ``keys`` numbered 1.. without gaps, in the order (hash bucket, ``cols``).

    The buckets are sorted apart (about sqrt(n) of them), and their sizes are summed over one row per
    bucket, so no task sorts all keys. ``keys`` should be a written table: it is read twice.
    """
    n = keys.count()
    buckets = max(1, int(n ** 0.5))
    t = keys.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    base = (t.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
            .select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base")))
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*cols)))
    return t.join(base, "_b").select(*cols, (F.col("_base") + F.col("_r")).cast("long").alias(name))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once in the shared checkpoint folder, then read back."""
    return materialize(df, f"llm-{name}")
