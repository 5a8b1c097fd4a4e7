"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on the document id.

``write_tokens`` range-partitions the documents by id, so each file holds an ascending run of ids and its
stripe statistics prune by range, encodes each partition in order and writes one file per task. A row has
its place in the file (``part``, ``row``) and the number of ids before it in the part, so a document's
global position needs only the sum of the earlier parts: one row per part.

Defined results: null text counts as empty (only the end id); a null doc_id sorts first; repeated rows are
written as often as they occur, ordered by (doc_id, text); an empty table gives an empty table; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import row_blocks, stored
from pdforge.llm.tokens import BLOCK_BYTES, END_ID, text_encoder
from pdforge.session import scratch_path

SCHEMA = "part int, row long, doc_id long, part_start long, ids array<int>"
#: ORC writer settings: integers are run-length encoded by the format itself.
ORC = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000",
       "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` (doc_id, text) and write the ids as ORC in ascending doc_id order."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, row, start = TaskContext.get().partitionId(), 0, 0
        encode = text_encoder(tokenizer, end_id)
        for batch in batches:
            for rows, texts in row_blocks(batch, BLOCK_BYTES):
                ids = encode(texts)
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(sizes)
                flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    pa.array(np.arange(row, row + len(ids), dtype=np.int64)),
                    rows.column("doc_id"),
                    pa.array(start + ends - sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                ], names=["part", "row", "doc_id", "part_start", "ids"])
                row, start = row + len(ids), start + int(ends[-1])

    src = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
           .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    src.mapInArrow(run, SCHEMA).write.options(**ORC).mode("overwrite").orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of some documents; the predicate reaches the ORC reader, which skips stripes and row groups
    by statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a written folder, read stripe by stripe."""
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            off = ids.offsets.to_numpy().astype(np.int64)
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("part_start"),
                 pa.array(off[1:] - off[:-1]), pa.array(crc, type=pa.int64())],
                names=["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    rows = stored(read_tokens(spark, path).mapInArrow(
        run, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"), "orc-digests")
    parts = stored(rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
                   .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), "orc-parts")
    return rows.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = write_tokens(docs, scratch_path(spark, "llm-orc-tokens"), tokenizer)
    return token_digests(spark, path)
