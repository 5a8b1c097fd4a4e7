"""Packing by non-negative least squares over the histogram of piece lengths.

Each document is cut into whole windows, one body whose length is a multiple of ``unit`` and one tail shorter
than ``unit``, so the histogram has at most window/unit + unit - 1 lengths however large the corpus is.
``combinations`` enumerates the multisets of at most ``depth`` body lengths that fill a window exactly;
``nnls`` (Lawson and Hanson's active set method) finds how often to repeat each; the counts are rounded down
to what the histogram has, and what is left, tails included, is packed greedily, largest first, by repeating
a pattern as often as its pieces last. The plan is a small table of (length, rank range) -> (sequence, offset);
the pieces themselves are ranked inside their length by hash block, so no task sees a whole length.

Defined results: null or empty text is one piece with only the end id; repeated rows are packed as often as
they occur; an empty table gives no pieces; other columns are not read. Only the last sequences can hold
padding: the greedy part fills every other window as full as the remaining lengths allow.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import row_blocks, stored
from pdforge.llm.tokens import BLOCK_BYTES, END_ID, text_encoder

WINDOW, UNIT, DEPTH = 4096, 64, 6
PIECES = "doc_id long, doc_tokens long, start long, length int, ids binary"
DIGESTS = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, tokenizer: str | None = None,
           end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """Pieces of each document: (doc_id, doc_tokens, start, length, ids as little-endian uint32), or with ``digests``
    the CRC-32 of the ids in their place, so that no ids leave the task."""
    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        encode = text_encoder(tokenizer, end_id)
        last, of = ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())
        for batch in batches:
            for rows, texts in row_blocks(batch, BLOCK_BYTES):
                out = []
                for doc, ids in zip(rows.column("doc_id").to_pylist(), encode(texts)):
                    n = len(ids) // 4
                    rest = n % window
                    cuts = [*range(0, n - rest + 1, window), n - rest + rest // unit * unit, n]
                    parts = [(doc, n, a, b - a, ids[4 * a:4 * b]) for a, b in zip(cuts, cuts[1:]) if b > a]
                    out += [(*p[:4], crc32(p[4])) for p in parts] if digests else parts
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), of))],
                    names=["doc_id", "doc_tokens", "start", "length", last])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS if digests else PIECES)


@lru_cache
def combinations(parts: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` positive integers that sum to ``parts``, largest first."""
    def grow(left, most, room):
        if left == 0:
            yield ()
        elif room:
            for k in range(min(left, most), (left + room - 1) // room - 1, -1):
                for rest in grow(left - k, k, room - 1):
                    yield (k, *rest)

    return list(grow(parts, parts, depth))


def nnls(items, h, tolerance: float = 1e-9):
    """x >= 0 minimising |A x - h|, where column j of A counts the classes in row j of ``items``
    (class numbers, padded with len(h)). Lawson and Hanson's active set method; at most len(h) columns
    are ever active."""
    import numpy as np

    m, n = len(h), len(items)
    h = np.asarray(h, dtype=float)
    x, active = np.zeros(n), []

    def matrix(cols):
        a = np.zeros((m + 1, len(cols)))
        for k, j in enumerate(cols):
            np.add.at(a[:, k], items[j], 1.0)
        return a[:m]

    for _ in range(6 * m):
        residual = np.append(h - (matrix(active) @ x[active] if active else 0.0), 0.0)
        gain = residual[items].sum(axis=1)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if not gain[j] > tolerance * max(1.0, h.max(initial=0)) or len(active) >= m:
            break
        active.append(j)
        while active:
            z = np.linalg.lstsq(matrix(active), h, rcond=None)[0]
            low = z <= 0
            if not low.any():
                x[active] = z
                break
            now = x[active]
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + step * (z - now)
            x[active] = now
            stay = [(k, v) for k, v, bad in zip(active, now, low) if not (bad and v <= 1e-9)]
            if len(stay) == len(active):  # no progress possible
                stay = [(k, v) for k, v, bad in zip(active, now, low) if not bad]
            for k in active:
                x[k] = 0.0
            active = [k for k, _ in stay]
            for k, v in stay:
                x[k] = max(v, 0.0)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH):
    """Patterns [(repeats, {length: times})] that use up the histogram, in sequence order."""
    import numpy as np

    left = {k: int(v) for k, v in histogram.items() if v > 0}
    out: list[tuple[int, dict[int, int]]] = []

    def take(pattern: dict[int, int], times: int):
        if times > 0:
            out.append((times, pattern))
            for k, m in pattern.items():
                left[k] -= m * times

    if left.get(window):
        take({window: 1}, left[window])
    classes = window // unit
    h = np.array([left.get(k * unit, 0) for k in range(1, classes)], dtype=float)
    if h.any():
        combos = [c for c in combinations(classes, depth) if len(c) > 1]
        items = np.full((len(combos), depth), len(h), dtype=np.int64)
        for j, c in enumerate(combos):
            items[j, :len(c)] = [k - 1 for k in c]
        # only combinations of lengths that occur
        items = items[(np.append(h, 1.0)[items] > 0).all(axis=1)]
        if len(items):
            x = nnls(items, h)
            for j in np.argsort(-x, kind="stable")[:len(h)]:
                if x[j] < 0.5:
                    break
                pattern: dict[int, int] = {}
                for k in items[j]:
                    if k < len(h):
                        pattern[int(k + 1) * unit] = pattern.get(int(k + 1) * unit, 0) + 1
                take(pattern, min(int(x[j] + 1e-6), *(left[k] // m for k, m in pattern.items())))
    while True:  # greedy: fill a window largest first, repeat the pattern while its pieces last
        have = sorted((k for k, v in left.items() if v > 0), reverse=True)
        if not have:
            return out
        room, pattern = window, {}
        for k in have:
            if m := min(room // k, left[k]):
                pattern[k] = m
                room -= m * k
        take(pattern, min(left[k] // m for k, m in pattern.items()))


def segments(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times in a sequence, first sequence, offset) of each part of the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for length, times in pattern.items():
            lo = used.get(length, 0)
            used[length] = lo + repeats * times
            out.append((length, lo, used[length], times, sequence, offset))
            offset += length * times
        sequence += repeats
    return out


def pack(rows: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """``rows`` (doc_id, start, length, any more columns) with sequence_id and offset.

    ``rows`` must be a written table: it is read for its histogram and again to be placed.
    """
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most window/unit + unit lengths reach the driver
    parts = segments(plan(histogram, window, unit, depth))
    plan_rows = spark.createDataFrame(parts, "length int, _lo long, _hi long, _times int, _seq long, _off int")
    blocks = max(1, int(sum(histogram.values()) ** 0.5))
    order = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in rows.columns]
    t = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int"))
    base = (t.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
            .select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block"))
                                         - F.col("_n")).alias("_base")))
    base = stored(base, "pack-blocks")
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1)
    # both sides lie by (length, block) already
    t = t.join(base.hint("merge"), ["length", "_block"]).withColumn("_rank", F.col("_base") + F.col("_r")).drop("_base", "_r", "_block")
    # the plan has a few thousand rows at most, whatever the corpus
    t = t.join(F.broadcast(plan_rows), "length").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    return (t.withColumn("sequence_id", F.col("_seq") + F.floor(k / F.col("_times")).cast("long"))
            .withColumn("offset", F.col("_off") + (k % F.col("_times")) * F.col("length"))
            .drop("_rank", "_lo", "_hi", "_times", "_seq", "_off"))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids array): the sequences themselves from packed pieces that carry ``ids``,
    padded to the window unless the filled length is a power of two."""
    def join(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), dtype="<u4").astype(np.int32)
        n = len(ids)
        full = ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(window - n, pad_id, dtype=np.int32)])
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "n_tokens": [n], "ids": [full.tolist()]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, n_tokens long, ids array<int>")


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    rows = stored(pieces(docs, tokenizer=tokenizer, digests=True), "pieces")
    return pack(rows).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                             "sequence_id", F.col("offset").cast("long").alias("offset"))
