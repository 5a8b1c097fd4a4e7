"""Approximate nearest neighbours by balanced posting lists.

The index is fitted on a bounded sample (``SAMPLE`` vectors, by hash of the id): centroids are the means of a tree
of median splits, so lists are balanced, refined by a few rounds of k-means. Centroids are linked to their nearest
ones in a graph that a beam search walks, in memory of every task (``MAX_LISTS`` centroids at most). Each vector
goes to its nearest list and, near a border, to others up to a distance ratio (``REPLICAS`` at most, all vectors in
one at least). A query takes all lists within a distance ratio of its nearest: where the beam's farthest centroid is
still within it, the distances to all centroids decide. The ratio is the smallest with which this search, asked by sample
vectors, reaches lists that hold ``TARGET`` of their true neighbours. A list is searched in blocks of at most ``BLOCK`` vectors and
queries, so a vector that a third of the rows share never fills one task, and every block's scores are exact double
inner products; the best are merged per query. The nearest ``LEAST_LISTS`` lists are searched first: the k-th score found
there is a floor, below which the query's other lists return nothing, so rows per query do not grow with the lists.

Inner products are ordered as distances after adding one component sqrt(M^2 - |v|^2) (M the largest norm).

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part; ties go to the smaller vec_id; a repeated vec_id counts once (its largest score) and is never its own
neighbour; queries that found fewer than k although more exist search all lists; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import stored

K, STRIDE = 20, 20
SAMPLE, PER_LIST, MAX_LISTS, REPLICAS, BORDER, BEAM, DEGREE = 20_000, 256, 16_384, 4, 1.05, 64, 24
TARGET, LEAST_LISTS, BLOCK = 0.985, 4, 4096
#: Rows of one Arrow batch of (list, vector) pairs, and pairs whose products are held at once.
PAIRS = 1 << 14


# ---- index -------------------------------------------------------------------------------------------------------

def _distances(x, c):
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :], 0.0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """Centroids of about equally large lists: median splits along the two-means axis, then k-means rounds in which
    a list twice as large as the mean is split again and the smallest one dropped."""
    rng = np.random.default_rng(seed)

    def split(part):
        a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
        for _ in range(3):
            near = ((part - a) ** 2).sum(1) <= ((part - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = part[near].mean(0), part[~near].mean(0)
        order = np.argsort(part @ (b - a), kind="stable")
        return part[order[:len(part) // 2]], part[order[len(part) // 2:]]

    parts = [x]
    while len(parts) < lists:
        parts.sort(key=len)
        big = parts.pop()
        if len(big) < 2:
            parts.append(big)
            break
        parts += split(big)
    c = np.stack([p.mean(0) for p in parts])
    for _ in range(rounds):
        near = np.concatenate([np.argmin(_distances(x[i:i + 4096], c), axis=1) for i in range(0, len(x), 4096)])
        sizes = np.bincount(near, minlength=len(c))
        big, small = int(sizes.argmax()), int(sizes.argmin())
        c = np.stack([x[near == i].mean(0) if sizes[i] else c[i] for i in range(len(c))])
        if big != small and sizes[big] > 2 * len(x) / len(c):
            a, b = split(x[near == big])
            if len(a) and len(b):
                c[big], c[small] = a.mean(0), b.mean(0)
    return c


def centroid_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest ones, and a ring over all that keeps the graph connected."""
    n = len(c)
    degree = min(degree, n - 1)
    links = np.empty((n, degree + 1), dtype=np.int64)
    for i in range(0, n, 1024):
        d = _distances(c[i:i + 1024], c)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        links[i:i + 1024, :degree] = np.argsort(d, axis=1, kind="stable")[:, :degree]
    ring = (np.arange(n) + 1) % n
    links[:, degree] = np.where((links[:, :degree] == ring[:, None]).any(axis=1), np.arange(n), ring)  # no link twice
    return links


def graph_search(x: np.ndarray, c: np.ndarray, links: np.ndarray, beam: int = BEAM):
    """Nearest centroids of each row of x by beam search: (ids, squared distances), nearest first."""
    n, m = len(x), len(c)
    beam = min(beam, m)
    rows = np.arange(n)[:, None]
    start = np.unique(np.linspace(0, m - 1, min(m, 8)).astype(np.int64))
    seen = np.zeros((n, m), dtype=bool)
    seen[:, start] = True
    ids = np.full((n, beam + len(start)), -1, dtype=np.int64)[:, :max(beam, len(start))]
    dist = np.full(ids.shape, np.inf)
    ids[:, :len(start)] = start
    dist[:, :len(start)] = _distances(x, c[start])
    done = np.zeros(ids.shape, dtype=bool)
    norms = (c * c).sum(1)
    xx = (x * x).sum(1)
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        best = open_.argmin(axis=1)
        go = np.flatnonzero(np.isfinite(open_[rows[:, 0], best]))
        if not len(go):
            break
        done[go, best[go]] = True
        near = links[ids[go, best[go]]]
        fresh = ~seen[go[:, None], near]
        seen[go[:, None], near] = True
        d = np.maximum(xx[go][:, None] - 2.0 * np.einsum("ij,ikj->ik", x[go], c[near]) + norms[near], 0.0)
        d = np.where(fresh, d, np.inf)
        alld = np.concatenate([dist[go], d], axis=1)
        alli = np.concatenate([ids[go], near], axis=1)
        alldone = np.concatenate([done[go], np.zeros(near.shape, dtype=bool)], axis=1)
        keep = np.argpartition(alld, ids.shape[1] - 1, axis=1)[:, :ids.shape[1]]
        take = lambda a: np.take_along_axis(a, keep, axis=1)
        dist[go], ids[go], done[go] = take(alld), take(alli), take(alldone)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def lists_of(x, c, links, ratio: float, most: int | None, least: int = 1, beam: int = BEAM):
    """(row, list) pairs, nearest list first: the lists within ``ratio`` of each row's nearest distance, at most ``most``."""
    rows, lists = [], []

    def take(at, ids, d):
        d = np.sqrt(d)
        ok = (d <= ratio * d[:, :1]) & (ids >= 0)
        # the farthest centroid of the beam is still within the ratio: more may be
        wider = ok[:, -1] if ids.shape[1] < len(c) and (most is None or most > ids.shape[1]) else np.zeros(len(at), dtype=bool)
        ok[:, :least] |= ids[:, :least] >= 0
        if most is not None:
            ok[:, most:] = False
        r, k = np.nonzero(ok & ~wider[:, None])
        rows.append(at[r])
        lists.append(ids[r, k])
        return at[wider]

    todo = take(np.arange(len(x)), *graph_search(x, c, links, beam))
    for i in range(0, len(todo), 128):
        d = _distances(x[todo[i:i + 128]], c)
        ids = np.argsort(d, axis=1, kind="stable")
        take(todo[i:i + 128], ids, np.take_along_axis(d, ids, axis=1))
    rows, lists = np.concatenate(rows), np.concatenate(lists)
    order = np.argsort(rows, kind="stable")
    return rows[order], lists[order]


def search_ratio(x, c, links, target: float = TARGET, k: int = K, queries: int = 300, border: float = BORDER,
                 replicas: int = REPLICAS) -> float:
    """The smallest distance ratio with which ``lists_of`` finds lists that hold ``target`` of the true neighbours of some
    sample vectors, asked as queries are."""
    at = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
    q = x[at].copy()
    q[:, -1] = 0.0
    d = _distances(q, x)
    d[np.arange(len(q)), at] = np.inf
    true = np.argsort(d, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    if not true.size:
        return 1.0
    near = np.unique(true)
    rows, lists = lists_of(x[near], c, links, border, replicas)
    home = np.full((len(near), replicas), -1, dtype=np.int64)
    home[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = lists
    home = home[np.searchsorted(near, true)]
    d = np.sqrt(_distances(q, c))
    need = np.where(home >= 0, np.take_along_axis(d[:, None, :], np.maximum(home, 0), axis=2), np.inf).min(axis=2)
    ratios = np.unique(np.maximum(1.0, need / np.maximum(d.min(axis=1, keepdims=True), 1e-12)))

    def reached(ratio):
        asked = np.zeros((len(q), len(c) + 1), dtype=bool)
        asked[lists_of(q, c, links, ratio, None, LEAST_LISTS)] = True
        return asked[np.arange(len(q))[:, None, None], home].any(axis=2).mean()

    lo, hi = 0, len(ratios) - 1  # the last one takes every list that is needed
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if reached(ratios[mid]) >= target else (mid + 1, hi)
    return float(ratios[lo])


# ---- on Spark ----------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> tuple[DataFrame, int, float]:
    """(vec_id, v as packed float64), the dimension and the largest norm."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = ~F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(F.col("v"), lambda x: x != 0)
    t = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good)
    sizes = t.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()
    if not sizes:
        return t.limit(0), 0, 0.0
    top = max(sizes, key=lambda r: (r["n"], r["d"]))
    return t.where(F.size("v") == top["d"]), top["d"], float(top["m"]) ** 0.5


def _matrix(column, dim: int) -> np.ndarray:
    """(rows, dim) of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


def pair_batches(part, x: np.ndarray, r: np.ndarray, to: np.ndarray, floor: bool):
    """The rows ``r`` of ``part`` (vectors ``x``) with their lists ``to``: Arrow batches of ``PAIRS`` rows at most, however
    many lists a row takes."""
    import pyarrow as pa

    packed = [row.tobytes() for row in x]
    for a in range(0, len(r), PAIRS):
        own = r[a:a + PAIRS]
        at = pa.array(own, type=pa.int64())
        rest = [part.column("floor").take(at)] if floor else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(to[a:a + PAIRS].astype(np.int32)), part.column("vec_id").take(at), pa.array([packed[j] for j in own], type=pa.binary()), *rest],
            names=["list", "id", "v", "floor"][:3 + len(rest)])


def exact_products(qx: np.ndarray, vx: np.ndarray, r: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``r`` of qx with rows ``j`` of vx, in the same order of additions for equal vectors."""
    out = np.empty(len(r))
    for a in range(0, len(r), PAIRS):
        b = a + PAIRS
        out[a:b] = (qx[r[a:b]] * vx[j[a:b]]).sum(axis=1)
    return out


def _augmented(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest ** 2 - (x * x).sum(1), 0.0))
    return np.concatenate([x, extra[:, None]], axis=1)


def build(t: DataFrame, n: int, dim: int, largest: float):
    """(centroids, links, ratio) fitted on about ``SAMPLE`` vectors."""
    u = F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = t.where(u < min(1.0, SAMPLE / n)).orderBy("vec_id").toArrow()
    x = _augmented(_matrix(sample.column("v").combine_chunks(), dim), largest, False) if len(sample) else np.zeros((1, dim + 1))
    lists = int(min(MAX_LISTS, max(1, n // PER_LIST), max(1, len(x) // 8)))
    c = balanced_centroids(x, lists)
    links = centroid_graph(c)
    return c, links, search_ratio(x, c, links)


def neighbours(vectors: DataFrame, k: int = K, stride: int = STRIDE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row whose id is divisible by ``stride``."""
    spark: SparkSession = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    t, dim, largest = usable(vectors)
    if dim == 0:
        return spark.createDataFrame([], schema)
    t = stored(t, "ann-vectors")
    n = t.count()
    c, links, ratio = build(t, n, dim, largest)
    lists = len(c)

    def route(query: bool, rest: bool = False):
        """Lists of vectors, or of queries: the nearest ``LEAST_LISTS`` of each, or the rest with the query's floor."""
        def run(batches):
            for batch in batches:
                for i in range(0, len(batch), 1024):
                    part = batch.slice(i, 1024)
                    x = _matrix(part.column("v"), dim)
                    if query:
                        r, to = lists_of(_augmented(x, largest, True), c, links, ratio, None, LEAST_LISTS)
                        near = np.arange(len(r)) - np.searchsorted(r, r) < LEAST_LISTS
                        r, to = (r[~near], to[~near]) if rest else (r[near], to[near])
                    else:
                        r, to = lists_of(_augmented(x, largest, False), c, links, BORDER, REPLICAS)
                    yield from pair_batches(part, x, r, to, rest)
        return run

    def best(queries: DataFrame, posts: DataFrame) -> DataFrame:
        # one row per list: at most MAX_LISTS
        blocks = lambda d, name: d.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        size = F.broadcast(blocks(queries, "nq").join(blocks(posts, "nb"), "list"))
        q = (queries.join(size, "list").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
             .withColumn("vb", F.explode(F.expr("sequence(0, nb - 1)"))).select("list", "qb", "vb", "id", "v", *[x for x in queries.columns if x == "floor"]))
        p = (posts.join(size, "list").withColumn("vb", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
             .withColumn("qb", F.explode(F.expr("sequence(0, nq - 1)"))).select("list", "qb", "vb", "id", "v"))

        def score(a, b):
            import pandas as pd

            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            qx = np.frombuffer(b"".join(a["v"]), dtype=np.float64).reshape(-1, dim)
            vx = np.frombuffer(b"".join(b["v"]), dtype=np.float64).reshape(-1, dim)
            qi, vi = a["id"].to_numpy(), b["id"].to_numpy()
            floor = a["floor"].to_numpy() if "floor" in a else np.full(len(qx), -np.inf)
            out = []
            for i in range(0, len(qx), 256):
                s = qx[i:i + 256] @ vx.T
                s[qi[i:i + 256, None] == vi[None, :]] = -np.inf
                m = min(k, len(vx))
                edge = np.partition(s, len(vx) - m, axis=1)[:, len(vx) - m]
                r, j = np.nonzero((s >= edge[:, None] - 1e-9 * max(1.0, largest * largest)) & np.isfinite(s))
                exact = exact_products(qx, vx, i + r, j)
                order = np.lexsort((vi[j], -exact, r))
                r, j, exact = r[order], j[order], exact[order]
                first = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (exact >= floor[i + r])
                out.append(pd.DataFrame({"query_id": qi[i + r[first]], "vec_id": vi[j[first]], "score": exact[first]}))
            return pd.concat(out)

        keys = ["list", "qb", "vb"]
        found = (q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
                 .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
        return top(found)

    def top(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = t.where(F.col("vec_id") % stride == 0)
    posts = stored(t.mapInArrow(route(False), "list int, id long, v binary"), "ann-lists")
    probe = "list int, id long, v binary"
    nearest = stored(best(stored(asked.mapInArrow(route(True), probe), "ann-probes"), posts), "ann-nearest")
    floors = (nearest.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")))
    floored = asked.join(floors, "vec_id", "left").fillna(float("-inf"), ["floor"])
    rest = stored(floored.mapInArrow(route(True, rest=True), probe + ", floor double"), "ann-rest")
    found = stored(top(nearest.drop("rank").unionByName(best(rest, posts).drop("rank"))
                       .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))), "ann-found")
    want = min(k, t.select("vec_id").distinct().count() - 1)
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= want).select(F.col("query_id").alias("vec_id"))
    short = stored(asked.join(enough, "vec_id", "left_anti"), "ann-short")
    if want > 0 and not short.isEmpty():  # fewer than k in the lists searched: all lists

        def everywhere(batches):
            import pyarrow as pa

            for batch in batches:
                for row, vec in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("v"), dim)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists, dtype=np.int32)), pa.array([row] * lists, type=pa.int64()),
                                                      pa.array([vec.tobytes()] * lists, type=pa.binary())], names=["list", "id", "v"])

        again = best(stored(short.mapInArrow(everywhere, "list int, id long, v binary"), "ann-again"), posts)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors)
