"""Hard negatives by spanning-tree bounds between anchors.

Scores are integer inner products of the components floor(256 * x). Anchors come in blocks of at most ``ANCHORS``, alike
ones together (sign bits of fixed random directions), and a block is broadcast at a time; its anchors form a minimum
spanning tree of Euclidean distances. A task walks the tree over each batch of candidates: at a child, a candidate's
score lies within its parent's interval plus or minus edge length times the candidate's norm. Only candidates whose
interval overlaps a window that still counts are rescored (all of a batch where most do), which closes their interval for
the subtree. Subtrees are walked smallest first and intervals freed after the last child, so about log2(``ANCHORS``) are
held. A first walk, one tree per label, finds the positives (window: from the last of the best so far up); a second
one, over all anchors of the block, the negatives of each positive's window. Tasks keep only the best of each window and
Spark merges them. No candidate is left out: each row meets each anchor through its interval or its score.

Sums are exact: float64 while they stay below 2^53, Python integers for rows or anchors with a component beyond 2^20
(those are scored without bounds). Scores beyond 64 bits are returned as the nearest 64-bit value.

Defined results: rows whose id, label or vector is null, or that hold a null or non-finite component, take no part;
vectors meet only those of their own length; repeated rows count once, rows that share an id but differ count each as a
candidate and never as each other's; of such anchors the smallest (label, vector) counts; ties go to the smaller vec_id;
an empty table, or one without anchors, gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import stored
from pdforge.session import scratch_path

ANCHOR_STRIDE, RELABEL_STRIDE, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score in percent of the positive's.
LOW, HIGH = 30, 90
#: Anchors a broadcast, candidates a task at least, directions whose signs bring like anchors together.
ANCHORS, TASK_ROWS, DIRECTIONS = 2048, 65_536, 12
PLAIN = float(1 << 20)
LONG = (1 << 63) - 1


# ---- rows --------------------------------------------------------------------------------------------------------

def numbered(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) with the labels that count."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    v = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return v.withColumn("label", F.when(F.col("vec_id") % RELABEL_STRIDE == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def blocks_of(batch):
    """(ids, labels, components as a float matrix) of an Arrow batch's valid rows, one block per vector length;
    repeated rows once."""
    import pyarrow.compute as pc

    v = batch.column("embedding")
    size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    start = np.cumsum(size) - size
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        m = np.floor(SCALE * x[start[at, None] + np.arange(d)[None, :]])
        good = np.isfinite(m).all(axis=1)
        i, y, m = ids[at][good], labels[at][good], m[good]
        if len(np.unique(i)) < len(i):
            seen = {(a, b, r.tobytes()): k for k, (a, b, r) in enumerate(zip(i.tolist(), y.tolist(), m))}
            keep = np.sort(np.fromiter(seen.values(), dtype=np.int64))
            i, y, m = i[keep], y[keep], m[keep]
        if len(i):
            yield d, i, y, m


def anchor_blocks(rows: DataFrame) -> DataFrame:
    """(block, vec_id, label, v): valid anchors in blocks of at most ``ANCHORS``, alike ones together."""
    def valid(batches):
        import pyarrow as pa

        for batch in batches:
            for d, i, y, m in blocks_of(batch):
                side = np.random.default_rng(d).normal(size=(d, DIRECTIONS))
                code = ((m @ side > 0) @ (1 << np.arange(DIRECTIONS))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(i), pa.array(y), pa.array([r.tolist() for r in m], type=pa.list_(pa.float64())),
                     pa.array(np.full(len(i), d, dtype=np.int64)), pa.array(code)], names=["vec_id", "label", "v", "d", "code"])

    a = rows.where(F.col("vec_id") % ANCHOR_STRIDE == 0).mapInArrow(valid, "vec_id long, label long, v array<double>, d long, code long")
    one = a.groupBy("vec_id").agg(F.min(F.struct("label", "v", "d", "code")).alias("r")).select("vec_id", "r.*")

    def dealt(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            at = n + np.arange(len(batch))
            n += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part)), pa.array(at), *[batch.column(c) for c in ("vec_id", "label", "v")]],
                                             names=["part", "at", "vec_id", "label", "v"])

    # ranges of one order, then places in the whole order by the sizes of the ranges before
    ordered = stored(one.repartitionByRange(max(1, -(-one.count() // ANCHORS)), "d", "code", "label", "vec_id")
                     .sortWithinPartitions("d", "code", "label", "vec_id")
                     .mapInArrow(dealt, "part long, at long, vec_id long, label long, v array<double>"), "anchors")
    before = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")) \
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each range
    return ordered.join(before, "part").select(F.floor((F.col("base") + F.col("at")) / ANCHORS).alias("block"), "vec_id", "label", "v")


# ---- spanning tree -----------------------------------------------------------------------------------------------

def spanning_tree(x: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """(node, parent, edge length, whether the parent's intervals may go) from parents to children; -1 is no parent."""
    n = len(x)
    sq = (x * x).sum(axis=1)
    far, near, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, dtype=bool)
    children = [[] for _ in range(n)]
    order, node = [], 0
    for _ in range(n):
        left[node] = False
        order.append(node)
        if near[node] >= 0:
            children[near[node]].append(node)
        d = np.maximum(sq + sq[node] - 2.0 * (x @ x[node]), 0.0)
        closer = left & (d < far)
        far[closer], near[closer] = d[closer], node
        if left.any():
            node = int(np.argmin(np.where(left, far, np.inf)))
    size = np.ones(n, dtype=np.int64)
    for v in reversed(order[1:]):
        size[near[v]] += size[v]
    walk, stack = [], [(0, -1, 0.0, True)]
    while stack:
        v, parent, length, last = stack.pop()
        walk.append((v, parent, length, last))
        below = sorted(children[v], key=lambda c: -size[c])  # the largest is pushed first and walked last
        stack += [(c, v, float(np.sqrt(far[c])), k == 0) for k, c in enumerate(below)]
    return walk


def overlapping(walk, anchors: np.ndarray, x: np.ndarray, wanted):
    """Walks the tree over candidates ``x``: (node, rows, scores) of the candidates whose interval overlaps what
    ``wanted(node, lo, hi)`` marks."""
    norm = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)
    held = {}
    for node, parent, length, last in walk:
        if parent < 0:
            lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        else:
            up = held.pop(parent) if last else held[parent]
            room = length * (1 + 1e-9) * norm + 1.0  # one unit above any rounding of sums below 2^53
            lo, hi = up[0] - room, up[1] + room
        mark = wanted(node, lo, hi)
        rows = np.flatnonzero(mark)
        if parent < 0 or 2 * len(rows) > len(x):
            lo = hi = x @ anchors[node]
            s = lo[rows]
        else:
            s = x[rows] @ anchors[node]
            lo[rows] = hi[rows] = s
        held[node] = (lo, hi)
        if len(rows):
            yield node, rows, s.astype(np.int64)


def exact_scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, by Python integers where floats would round."""
    b = [int(t) for t in a.tolist()]
    return np.array([max(-LONG, min(LONG, sum(int(s) * t for s, t in zip(r, b)))) for r in x.tolist()], dtype=np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first distinct (score, id) by score descending, then id."""
    s, i = scores, ids
    if len(s) > 4 * k:
        top = s >= np.partition(s, len(s) - 2 * k)[len(s) - 2 * k]
        s, i = s[top], i[top]
    order = np.lexsort((i, -s))
    s, i = s[order], i[order]
    if len(s) > 1:
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
        s, i = s[new], i[new]
    if len(s) < k and len(scores) > 4 * k:
        pairs = np.unique(np.stack([-scores, ids]), axis=1)[:, :k]
        return -pairs[0], pairs[1]
    return s[:k], i[:k]


class Best:
    """The first ``k`` (score, id) of each window met so far."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.s = [np.zeros(0, dtype=np.int64)] * windows
        self.i = [np.zeros(0, dtype=np.int64)] * windows
        self.floor = np.full(windows, -LONG, dtype=np.int64)

    def add(self, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            self.s[w], self.i[w] = first(np.concatenate([self.s[w], scores]), np.concatenate([self.i[w], ids]), self.k)
            if len(self.s[w]) == self.k:
                self.floor[w] = self.s[w][-1]


# ---- the two walks -----------------------------------------------------------------------------------------------

def _walks(ids, labels, vectors, by_label: bool):
    """[(vector length, label or None, anchor numbers, matrix, walk or None)]: one tree a group; without one, anchors
    with large components."""
    groups = {}
    for k, (y, v) in enumerate(zip(labels, vectors)):
        wide = len(v) and max(abs(t) for t in v) > PLAIN
        groups.setdefault((len(v), y if by_label else None, bool(wide)), []).append(k)
    out = []
    for (d, y, wide), numbers in groups.items():
        m = np.array([vectors[k] for k in numbers], dtype=np.float64).reshape(len(numbers), d)
        out.append((d, y, np.array(numbers), m, None if wide else spanning_tree(m)))
    return out


def _meet(group, ids, labels, x, wanted):
    """(anchor number, candidate rows, scores) for a block of candidates, by bounds or, for large components, directly."""
    _, _, numbers, m, walk = group
    wide = np.abs(x).max(axis=1) > PLAIN if x.shape[1] else np.zeros(len(x), dtype=bool)
    plain = np.flatnonzero(~wide)
    if walk is not None and len(plain):
        for node, rows, s in overlapping(walk, m, x[plain], lambda n, lo, hi: wanted(numbers[n], plain, lo, hi)):
            yield numbers[node], plain[rows], s
    rest = np.flatnonzero(wide) if walk is not None else np.arange(len(x))
    if len(rest):
        for node, a in enumerate(m):
            yield numbers[node], rest, exact_scores(x[rest], a)


def _positives(rows: DataFrame, block) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's first rows of its label, merged over tasks."""
    def run(batches):
        import pyarrow as pa

        a_ids, a_labels, vectors = block.value
        groups = _walks(a_ids, a_labels, vectors, True)
        best = Best(len(a_ids), POSITIVES)
        for batch in batches:
            for d, ids, labels, x in blocks_of(batch):
                for group in groups:
                    own = np.flatnonzero(labels == group[1])
                    if group[0] != d or not len(own):
                        continue
                    own_ids = ids[own]

                    def wanted(n, at, lo, hi):
                        return (hi >= best.floor[n]) & (own_ids[at] != a_ids[n])

                    for n, r, s in _meet(group, own_ids, labels[own], x[own], wanted):
                        keep = (s >= best.floor[n]) & (own_ids[r] != a_ids[n])
                        best.add(n, s[keep], own_ids[r[keep]])
        n = [len(s) for s in best.s]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(a_ids, dtype=np.int64), n)), pa.array(_joined(best.i)),
                                          pa.array(_joined(best.s))], names=["anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long").distinct()
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= POSITIVES).drop("r")


def _joined(parts) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, dtype=np.int64)])


def _negatives(rows: DataFrame, block, windows) -> DataFrame:
    """The result rows of one block; ``windows`` holds (anchor number, positive_id, positive_score, low, high)."""
    def run(batches):
        import pyarrow as pa

        a_ids, a_labels, vectors = block.value
        asked = windows.value
        of = {}
        for w, (n, *_) in enumerate(asked):
            of.setdefault(n, []).append(w)
        low = np.array([w[3] for w in asked], dtype=np.int64)
        high = np.array([w[4] for w in asked], dtype=np.int64)
        groups = _walks(a_ids, a_labels, vectors, False)
        best = Best(len(asked), NEGATIVES)
        for batch in batches:
            for d, ids, labels, x in blocks_of(batch):
                for group in groups:
                    if group[0] != d:
                        continue

                    def wanted(n, at, lo, hi):
                        mark = np.zeros(len(at), dtype=bool)
                        for w in of.get(n, ()):
                            mark |= (hi >= max(low[w], best.floor[w])) & (lo <= high[w])
                        return mark & (labels[at] != a_labels[n])

                    for n, r, s in _meet(group, ids, labels, x, wanted):
                        other = labels[r] != a_labels[n]
                        for w in of.get(n, ()):
                            keep = other & (s >= max(low[w], best.floor[w])) & (s <= high[w])
                            best.add(w, s[keep], ids[r[keep]])
        n = [len(s) for s in best.s]
        cols = [np.repeat(np.array([c for c in col], dtype=np.int64), n) for col in
                ([a_ids[w[0]] for w in asked], [w[1] for w in asked], [w[2] for w in asked])]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(_joined(best.i)), pa.array(_joined(best.s))],
                                         names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long").distinct()
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = numbered(vectors)
    out = scratch_path(spark, "llm-negatives")
    anchors = stored(anchor_blocks(rows), "anchor-blocks")
    n = rows.count()
    tasks = max(sc.defaultParallelism, -(-n // TASK_ROWS))
    rows = rows.coalesce(tasks)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.mode("append").parquet(out)
    for block in sorted(r.block for r in anchors.select("block").distinct().collect()):  # one number a block
        held = anchors.where(F.col("block") == block).orderBy("vec_id").collect()  # ANCHORS rows at most
        ids, labels = [r.vec_id for r in held], [r.label for r in held]
        shared = sc.broadcast((ids, labels, [r.v for r in held]))
        number = {i: k for k, i in enumerate(ids)}
        asked = [(number[r.anchor_id], r.positive_id, r.positive_score, -(-LOW * r.positive_score // 100), HIGH * r.positive_score // 100)
                 for r in _positives(rows, shared).orderBy("anchor_id", F.desc("positive_score"), "positive_id").collect()]
        windows = sc.broadcast([w for w in asked if w[3] <= w[4]])  # ANCHORS * POSITIVES at most
        _negatives(rows, shared, windows).write.mode("append").parquet(out)
        shared.unpersist()
        windows.unpersist()
    return spark.read.schema(schema).parquet(out)


query = mine

SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
