"""Boosted trees (T4) over binned columns: MLlib's algorithm with far less work a row.

``BoostedTrees`` is MLlib's ``GBTClassifier`` with a training of its own for many rows. Split candidates, the rows and features drawn for a tree
or node, gains, limits and leaf values are MLlib's, and so are the trees, unless rounding decides: between two splits of one
gain, or in a pure node, which is always a leaf here and for which MLlib draws features where rounding hides that it is pure.
What differs is how the sums of a level are found:

* Rows are binned once into files by column, a folder a fit in the shared scratch folder. A pass maps them; features share
  joint cells (two of 64 bins make 4,096), so that one count serves several.
* Only the smaller child of a split is summed; its sibling is what the parent has left.
* What the trees so far say of a row, and whether the next tree draws it, is written once a tree. File names carry the tree,
  contents depend on nothing else, and a file appears whole: a repeated task writes the same again.

A pass is a job that brings one row of sums a part to the driver; its size is that of the level, whatever the rows. A level of
more cells than ``CELLS`` takes several passes. Up to ``MLLIB_ROWS`` rows jobs cost more than rows: MLlib trains there.
"""

from __future__ import annotations

import json
import os
import random
import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.session import scratch_path

#: Rows summed at once; cells of joint features times nodes, at most; cells of a pass; bits of a packed count.
ROWS, JOINT, CELLS, HALF = 1 << 18, 1 << 16, 1 << 20, 26
#: Gains nearer than this share of the node's impurity are a tie: the first counts. Below the second a node is pure.
TIE, PURE = 1e-12, 1e-13
EPSILON = 2.0 ** -52
#: Rows up to which MLlib's own training takes no longer.
MLLIB_ROWS = 1 << 20


# ---------------------------------------------------------------------------
# the random numbers of MLlib's samplers
# ---------------------------------------------------------------------------
def hashed_seed(seed: int) -> int:
    """The state of Spark's XORShiftRandom for a seed (MurmurHash3 of its bytes, twice)."""
    def mur(h):
        for i in (0, 4):
            k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    data = (seed & (1 << 64) - 1).to_bytes(8, "big")
    low = mur(0x3C074A61)
    return mur(low) << 32 | low


def _shift(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << np.uint64(21))
    s ^= s >> np.uint64(35)
    s ^= s << np.uint64(4)
    return s


def _jump(columns: np.ndarray, s: np.ndarray) -> np.ndarray:
    """States ``s`` moved on by the linear step whose images of the 64 single bits are ``columns``."""
    out = np.zeros_like(s)
    for i in range(64):
        out ^= columns[i] * ((s >> np.uint64(i)) & np.uint64(1))
    return out


def _ahead(steps: int, lanes: int) -> list[np.ndarray]:
    """The linear steps over 1, 2, 4 ... runs of ``steps``, as images of the 64 single bits."""
    single = np.uint64(1) << np.arange(64, dtype=np.uint64)
    far, power = single, _shift(single)
    while steps:
        if steps & 1:
            far = _jump(power, far)
        power, steps = _jump(power, power), steps >> 1
    out = []
    while 1 << len(out) < lanes:
        out.append(far)
        far = _jump(far, far)
    return out


def drawn(seed: int, n: int, rate: float) -> np.ndarray:
    """Which of ``n`` rows the sampler takes: row by row two steps of one generator, here in lanes that start ahead."""
    if rate >= 1.0:
        return np.ones(n, dtype=bool)
    lanes = 1
    while lanes < 4096 and lanes * 256 < n:
        lanes *= 2
    steps = -(-n // lanes)
    s = np.array([hashed_seed(seed)], dtype=np.uint64)
    for far in _ahead(2 * steps, lanes):
        s = np.concatenate([s, _jump(far, s)])
    out, low, high = np.empty((steps, lanes), dtype=bool), np.uint64((1 << 26) - 1), np.uint64((1 << 27) - 1)
    for i in range(steps):
        s = _shift(s)
        a = (s & low) << np.uint64(27)
        s = _shift(s)
        out[i] = (a + (s & high)).astype(np.float64) * 2.0 ** -53 < rate
    return out.T.ravel()[:n]


class _JavaRandom:
    """java.util.Random, of which a tree takes a long a node."""

    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.s >> 16
        return v - (1 << 32) if v >= 1 << 31 else v

    def long(self) -> int:
        return ((self._next() << 32) + self._next()) & (1 << 64) - 1


def node_features(seed: int, features: int, k: int) -> list[int]:
    """The features drawn for a node, in order: a reservoir of ``k``."""
    own, s = list(range(k)), hashed_seed(seed)
    for item in range(k, features):
        bits = []
        for b in (26, 27):
            s ^= s << 21 & (1 << 64) - 1
            s ^= s >> 35
            s ^= s << 4 & (1 << 64) - 1
            bits.append(s & (1 << b) - 1)
        at = int(((bits[0] << 27) + bits[1]) * 2.0 ** -53 * (item + 1))
        if at < k:
            own[at] = item
    return own


# ---------------------------------------------------------------------------
# files of a part
# ---------------------------------------------------------------------------
def _folder(path: str):
    """The file system of ``path`` and the path on it."""
    from pyarrow import fs
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def _write(folder: str, name: str, parts: list) -> None:
    files, at = _folder(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/{(own := uuid.uuid4().hex)}.new") as f:
        for p in parts:
            f.write(memoryview(np.ascontiguousarray(p)).cast("B"))
    files.move(f"{at}/{own}.new", f"{at}/{name}")


def _read(folder: str, name: str) -> np.ndarray:
    from pyarrow import fs
    files, at = _folder(folder)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(f"{at}/{name}", dtype=np.uint8, mode="r").view(np.ndarray) if os.path.getsize(f"{at}/{name}") else np.empty(0, dtype=np.uint8)
    with files.open_input_file(f"{at}/{name}") as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def _drop(folder: str, name: str) -> None:
    files, at = _folder(folder)
    try:
        files.delete_file(f"{at}/{name}")
    except OSError:  # another try of the task was first
        pass


class Rows:
    """The files of one part: bins by feature, joint cells, label and weight."""

    def __init__(self, shape: dict, folder: str, part: int, n: int):
        self.shape, self.folder, self.part, self.n = shape, folder, part, n
        blob, at = _read(folder, f"rows-{part}"), 0

        def take(kind, count):
            nonlocal at
            size = np.dtype(kind).itemsize * count * n
            out = blob[at:at + size].view(kind).reshape(count, n) if n else np.empty((count, 0), dtype=kind)
            at += size
            return out

        self.weight = take(np.float64, 1)[0]
        self.cells = take(np.uint32 if shape["wide_cells"] else np.uint16, len(shape["groups"]))
        self.bins = take(np.uint16 if shape["wide_bins"] else np.uint8, len(shape["bins"]))
        self.label = take(np.uint8, 1)[0]

    def state(self, tree: int):
        """(log-odds halves so far, whether drawn) as the pass that began ``tree`` wrote them."""
        blob = _read(self.folder, f"state-{self.part}-{tree}")
        return (blob[:8 * self.n].view(np.float64), blob[8 * self.n:].view(bool)) if self.n else (np.empty(0), np.empty(0, dtype=bool))


def walked(bins: np.ndarray, splits: list, kind) -> np.ndarray:
    """The node of each row (numbers by order of creation) after ``splits``: (node, feature, last bin or set of bins that goes
    left, number of the left child; the right one's is the next)."""
    node = np.zeros(bins.shape[1], dtype=kind)
    for at, feature, left, child in splits:
        x = bins[feature]
        right = x > left if isinstance(left, int) else ~left[x]
        node += (node == at) * (right + kind(child - at))
    return node


def _residual(tree: int, label: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """What the next tree is to explain: the label as -1 or 1, then the negative gradient of the log loss."""
    y = label * 2.0 - 1.0
    return y if tree == 0 else 4.0 * y / (1.0 + np.exp(2.0 * y * so_far))


def begun(rows: Rows, tree: int, last: dict | None, seed: int, rate: float) -> np.ndarray | None:
    """Begins ``tree``: adds the last tree to the rows' log-odds, draws the rows of this one, writes both. Returns the sums
    of weighted squares of the last tree's leaves."""
    so_far, squares = np.zeros(rows.n), None
    if last is not None:
        before, was = rows.state(tree - 1)
        squares = np.zeros(len(last["values"]))
        for a in range(0, rows.n, ROWS):
            b = min(rows.n, a + ROWS)
            node = walked(rows.bins[:, a:b], last["splits"], last["kind"])
            so_far[a:b] = before[a:b] + last["values"][node] * last["weight"]
            y = _residual(tree - 1, rows.label[a:b], before[a:b])
            squares += np.bincount(node, weights=np.where(was[a:b], rows.weight[a:b], 0.0) * y * y, minlength=len(squares))
    _write(rows.folder, f"state-{rows.part}-{tree}", [so_far, drawn(seed + tree + rows.part + 1, rows.n, rate)])
    if tree > 1:
        _drop(rows.folder, f"state-{rows.part}-{tree - 2}")
    return squares


def summed(rows: Rows, tree: int, splits: list, kind, asked: list[int], nodes: int) -> np.ndarray:
    """Sums over the drawn rows of the ``asked`` nodes: (count, weight, weighted residual) by node and bin of each feature in
    turn, and the weighted squares by node, in one array."""
    shape, k = rows.shape, len(asked)
    so_far, own = rows.state(tree)
    place = np.full(nodes, -1, dtype=np.int16 if k < 32000 else np.int32)
    place[asked] = np.arange(k)
    levels = shape["weights"]
    sums = [[np.zeros(k * g["cells"]) for _ in range(2 if levels else 3)] for g in shape["groups"]]
    squares = np.zeros(k)
    for a in range(0, rows.n, ROWS):
        b = min(rows.n, a + ROWS)
        if splits:
            slot = place[walked(rows.bins[:, a:b], splits, kind)]
            at = np.flatnonzero((slot >= 0) & own[a:b])
            slot = slot[at].astype(np.int64)
        else:
            at = np.flatnonzero(own[a:b])
            slot = np.zeros(len(at), dtype=np.int64)
        if not len(at):
            continue
        w = rows.weight[a:b][at]
        y = _residual(tree, rows.label[a:b][at], so_far[a:b][at])
        wy = w * y
        squares += np.bincount(slot, weights=wy * y, minlength=k)
        packed = np.where(w == levels[0], 1.0, float(1 << HALF)) if levels else None
        for g, cells, out in zip(shape["groups"], rows.cells, sums):
            i = cells[a:b][at] + slot * g["cells"] if k > 1 else cells[a:b][at].astype(np.int64)
            for o, weights in zip(out, (packed, wy) if levels else (None, w, wy)):
                o += np.bincount(i, weights=weights, minlength=len(o))
    found = np.empty((3, k, shape["total"]))
    for g, out in zip(shape["groups"], sums):
        if levels:  # counts of the two weights share a sum
            second = np.floor(out[0] / (1 << HALF))
            first = out[0] - second * (1 << HALF)
            out = [first + second, first * levels[0] + second * levels[-1], out[1]]
        sizes = [shape["bins"][f] for f in g["features"]]
        for j, o in enumerate(out):
            joint = o.reshape(k, *sizes)
            for d, f in enumerate(g["features"]):
                start = shape["starts"][f]
                found[j, :, start:start + sizes[d]] = joint.sum(axis=tuple(i + 1 for i in range(len(sizes)) if i != d))
    return np.concatenate([found.ravel(), squares])


# ---------------------------------------------------------------------------
# the trees, on the driver
# ---------------------------------------------------------------------------
class _Node:
    def __init__(self, number: int, level: int, stats):
        self.number, self.level, self.stats = number, level, tuple(map(float, stats))  # stats: count, weight, weighted residual
        self.refused = False  # no split was allowed
        self.squares, self.sums, self.split, self.children, self.gain = 0.0, None, None, None, -1.0

    @property
    def value(self) -> float:
        return self.stats[2] / self.stats[1] if self.stats[1] else 0.0

    @property
    def impurity(self) -> float:
        return (self.squares - self.stats[2] ** 2 / self.stats[1]) / self.stats[1] if self.stats[1] else 0.0

    @property
    def pure(self) -> bool:
        return self.impurity < max(EPSILON, PURE * self.value ** 2)


def best_split(node: _Node, features: list[int], shape: dict, limits: dict):
    """(feature, goes left: last bin or set of bins, gain, left stats) of the first best split, None where none is allowed."""
    hist = node.sums[:, shape["grid"]] * shape["inside"]  # (3, feature, bin)
    order = None
    if shape["arity"]:
        cats = np.array(sorted(shape["arity"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(hist[0, cats] > 0, hist[2, cats] / hist[1, cats], np.inf)
        mean[~shape["inside"][cats]] = np.inf
        order = np.argsort(mean, axis=1, kind="stable")
        hist[:, cats] = np.take_along_axis(hist[:, cats], np.broadcast_to(order, (3, *order.shape)), axis=2)
    left = np.cumsum(hist, axis=2)
    right = left[:, :, -1:] - left
    total = np.array(node.stats)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - total[2] ** 2 / total[1]) / total[1]
    allowed = shape["cuts"] & (left[0] >= limits["rows"]) & (right[0] >= limits["rows"]) & (left[1] >= limits["weight"]) \
        & (right[1] >= limits["weight"]) & (left[1] > 0) & (right[1] > 0) & (gain >= limits["gain"])
    gain = np.where(allowed, gain, -np.inf)[features]
    most = gain.max(initial=-np.inf)
    if not most > 0:
        return None
    near = gain >= most - TIE * max(abs(node.impurity), most)
    i = int(np.flatnonzero(near.any(axis=1))[0])
    cut, f = int(np.flatnonzero(near[i])[0]), features[i]
    goes = cut
    if f in shape["arity"]:
        first = order[int(np.flatnonzero(cats == f)[0])][:cut + 1]
        goes = np.zeros(1 << (16 if shape["wide_bins"] else 8), dtype=bool)
        goes[first] = True
    return f, goes, float(gain[i, cut]), left[:, f, cut].copy(), (first.tolist() if f in shape["arity"] else None)


def grown(ask, shape: dict, plan: dict, draw) -> list[_Node]:
    """The nodes of one tree; ``ask(splits, asked, nodes)`` gives the sums of the nodes asked for, ``draw()`` the features
    for the next node."""
    root = _Node(0, 0, (0.0, 0.0, 0.0))
    sums, squares = ask([], [0], 1)
    nodes, splits, level = [root], [], [root]
    root.sums, root.squares = sums[0], float(squares[0])
    root.stats = tuple(root.sums[:, :shape["bins"][0]].sum(axis=1).tolist())
    while level:
        following = []
        for node in level:
            if node.pure and node.level:
                continue
            found = best_split(node, draw(), shape, plan)
            if found is None:
                node.refused = True
                continue
            f, goes, node.gain, left, cats = found
            rest = np.array(node.stats) - left
            node.children = [_Node(len(nodes), node.level + 1, left), _Node(len(nodes) + 1, node.level + 1, rest)]
            node.split = (f, goes, cats)
            splits.append((node.number, f, goes, len(nodes)))
            nodes += node.children
            following.append(node)
        level = []
        if following and following[0].level + 1 < plan["depth"]:
            pairs = [(n, *sorted(n.children, key=lambda c: c.stats[0])) for n in following]
            per = max(1, CELLS // shape["total"])
            for a in range(0, len(pairs), per):
                sums, squares = ask(splits, [small.number for _, small, _ in pairs[a:a + per]], len(nodes))
                for (parent, small, large), s, q in zip(pairs[a:a + per], sums, squares):
                    small.sums, small.squares = s, float(q)
                    large.sums = np.where(parent.sums[0] - s[0] > 0, parent.sums - s, 0.0)
                    large.squares = max(0.0, parent.squares - float(q))
                    parent.sums = None
            for n in following:  # the order of MLlib's stack
                level = [n.children[1], n.children[0], *level]
    for n in nodes:
        n.sums = None
    return nodes


def boosted(passed, shape: dict, plan: dict) -> list[list[tuple]]:
    """The nodes of every tree as plain rows; ``passed(work)`` adds up what ``work`` finds in the rows of each part."""
    features, trees, last = len(shape["bins"]), [], None
    for tree in range(plan["trees"] + 1):
        ending, rng, began = tree == plan["trees"], _JavaRandom(plan["seed"] + tree), []

        def ask(splits, asked, nodes, tree=tree, ending=ending, before=last, began=began):
            first, k, ends = not began, len(asked), len(before["values"]) if before else 0
            began.append(1)

            def work(rows):
                squares = begun(rows, tree, before, plan["seed"], plan["rate"]) if first else None
                found = [] if ending else [summed(rows, tree, splits, _kind(nodes), asked, nodes)]
                return np.concatenate(found if squares is None else [*found, squares])

            got = passed(work)
            if first and before:
                for n, q in zip(trees[-1], got[len(got) - ends:]):
                    n.squares = float(q) if n.children is None else n.squares
                got = got[:len(got) - ends]
            return None if ending else (got[:-k].reshape(3, k, shape["total"]).transpose(1, 0, 2), got[-k:])

        def draw(rng=rng):
            return list(range(features)) if plan["per_node"] == features else node_features(rng.long(), features, plan["per_node"])

        if ending:
            ask([], [], 1)
            break
        nodes = grown(ask, shape, plan, draw)
        trees.append(nodes)
        last = {"splits": [(n.number, *n.split[:2], n.children[0].number) for n in nodes if n.children],
                "values": np.array([n.value for n in nodes]), "weight": 1.0 if tree == 0 else plan["step"], "kind": _kind(len(nodes))}
    return [_plain(nodes) for nodes in trees]


def _kind(nodes: int):
    return np.uint8 if nodes <= 255 else np.uint16 if nodes <= 65535 else np.uint32


def _plain(nodes: list) -> list[tuple]:
    """(prediction, impurity, stats, rows, gain, left, right, (feature, last bin, levels)) of the nodes in MLlib's order; a
    split into leaves of one value is a leaf."""
    out = []

    def put(n) -> int:
        at = len(out)
        out.append(None)
        value, gain, left, right, split = n.value, -1.0, -1, -1, (-1, -1, None)
        if n.children:
            left, right = put(n.children[0]), put(n.children[1])
            a, b = out[left], out[right]
            if a[5] < 0 and b[5] < 0 and a[0] == b[0]:
                value, left, right = a[0], -1, -1
                del out[at + 1:]
            else:
                f, goes, cats = n.split
                gain, split = n.gain, (f, -1 if cats is not None else goes, cats)
        out[at] = (value, -1.0 if n.refused else n.impurity, [n.stats[1], n.stats[2], n.squares], int(n.stats[0]), gain, left, right, split)
        return at

    put(nodes[0])
    return out


def _grouped(bins: list[int], most: int) -> list[list[int]]:
    """Features whose joint cells are at most ``most``: the widest with the widest that still fits."""
    left, out = sorted(range(len(bins)), key=lambda f: (-bins[f], f)), []
    while left:
        own, cells = [left.pop(0)], 0
        cells = bins[own[0]]
        while (fit := next((f for f in left if cells * bins[f] <= most), None)) is not None:
            own.append(fit)
            left.remove(fit)
            cells *= bins[fit]
        out.append(own)
    return out


class BoostedTrees(GBTClassifier):
    """MLlib's gradient-boosted trees, grown by this module from many rows; early stopping on a validation column is MLlib's."""

    def _fit(self, dataset: DataFrame):
        if self.isDefined(self.validationIndicatorCol) and self.getValidationIndicatorCol() or dataset.count() <= MLLIB_ROWS:
            return super()._fit(dataset)
        return self._copyValues(self._trained(dataset))

    def _candidates(self, dataset: DataFrame) -> tuple[list, dict, dict]:
        """Per feature its thresholds (None where it has levels), the number of levels by feature, and MLlib's figures."""
        self._transfer_params_to_java()
        jvm, ml, old = dataset.sparkSession.sparkContext._jvm, "org.apache.spark.ml.", "org.apache.spark.mllib.tree."

        def single(name):
            return getattr(getattr(jvm, name + "$"), "MODULE$")

        rows = single(ml + "util.DatasetUtils").extractInstances(self._java_obj, dataset._jdf, single("scala.Option").apply(2))
        levels = single(ml + "util.MetadataUtils").getCategoricalFeatures(dataset._jdf.schema().apply(self.getFeaturesCol()))
        plan = self._java_obj.getOldBoostingStrategy(levels, single(old + "configuration.Algo").Classification()).treeStrategy().copy()
        plan.setAlgo("Regression")
        plan.setImpurity(single(old + "impurity.Variance"))
        meta = single(ml + "tree.impl.DecisionTreeMetadata").buildMetadata(rows, plan, 1, self.getFeatureSubsetStrategy())
        splits = single(ml + "tree.impl.RandomForest").findSplits(rows, meta, self.getSeed())
        cuts, arity = [], {}
        for f in range(meta.numFeatures()):
            if meta.isCategorical(f):
                arity[f] = meta.numBins()[f]
                cuts.append(None)
            else:
                cuts.append([s.threshold() for s in splits[f]])
        return cuts, arity, {"per_node": meta.numFeaturesPerNode(), "weight": meta.minWeightPerNode(), "rows": meta.minInstancesPerNode(),
                             "gain": meta.minInfoGain(), "examples": meta.numExamples()}

    def _shape(self, cuts: list, arity: dict, depth: int, rows: int) -> dict:
        """Numbers of bins, their places in a row of sums, and the groups of features that share joint cells; few where a part
        has few ``rows``."""
        bins = [arity[f] if c is None else len(c) + 1 for f, c in enumerate(cuts)]
        groups = [{"features": g, "cells": int(np.prod([bins[f] for f in g]))} for g in _grouped(bins, max(64, min(4096, JOINT >> max(0, depth - 1), rows // 16)))]
        starts = np.concatenate([[0], np.cumsum(bins)])
        wide = max(bins)
        at = np.arange(wide)[None, :]
        inside = at < np.array(bins)[:, None]
        return {"bins": bins, "starts": starts[:-1].tolist(), "total": int(starts[-1]), "groups": groups, "arity": arity, "weights": [],
                "wide_bins": wide > 256, "wide_cells": max(g["cells"] for g in groups) > 1 << 16, "inside": inside,
                "grid": np.where(inside, starts[:-1, None] + at, 0), "cuts": at < np.array(bins)[:, None] - 1}

    def _binned(self, dataset: DataFrame, cuts: list, shape: dict, folder: str) -> list[tuple[int, int]]:
        """Writes the files of all parts; (part, rows) of each. Notes in ``shape`` the weights where they are one or two."""
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) and self.getWeightCol() else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w"))
        kind, joint = (np.uint16 if shape["wide_bins"] else np.uint8), (np.uint32 if shape["wide_cells"] else np.uint16)

        def run(batches):
            import pyarrow as pa

            bins, ys, ws = [], [], []
            for batch in batches:
                n = len(batch)
                if not n:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(cuts))
                bins.append(np.stack([(x[:, f] if c is None else np.searchsorted(c, x[:, f])).astype(kind) for f, c in enumerate(cuts)]))
                ys.append(batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint8))
                ws.append(np.array(batch.column("w").to_numpy(zero_copy_only=False), dtype=np.float64))
            part = TaskContext.get().partitionId()
            if not bins:
                return
            own = np.concatenate(bins, axis=1)
            del bins
            w, n = np.concatenate(ws), own.shape[1]
            cells = []
            for g in shape["groups"]:
                c = np.zeros(n, dtype=joint)
                for f in g["features"]:
                    c = c * joint(shape["bins"][f]) + own[f].astype(joint)
                cells.append(c)
            _write(folder, f"rows-{part}", [w, *cells, own, np.concatenate(ys)])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([np.unique(w)[:3].tolist()], pa.list_(pa.float64()))],
                                             names=["part", "n", "weights"])

        found = rows.mapInArrow(run, "part int, n long, weights array<double>").collect()  # a row a part
        weights = sorted({w for r in found for w in r["weights"]})
        if 0 < len(weights) <= 2 and max(r["n"] for r in found) < 1 << HALF:
            shape["weights"] = weights
        return [(r["part"], r["n"]) for r in sorted(found, key=lambda r: r["part"])]

    def _trained(self, dataset: DataFrame) -> GBTClassificationModel:
        spark = dataset.sparkSession
        cuts, arity, limits = self._candidates(dataset)
        shape, folder = self._shape(cuts, arity, self.getMaxDepth(), limits["examples"] // spark.sparkContext.defaultParallelism), scratch_path(spark, "boosting")
        parts = self._binned(dataset, cuts, shape, folder)
        plan = {"trees": self.getMaxIter(), "depth": self.getMaxDepth(), "seed": self.getSeed(), "rate": self.getSubsamplingRate(),
                "step": self.getStepSize(), **limits}
        sc = spark.sparkContext
        spread, shared = sc.parallelize(parts, len(parts)), sc.broadcast(shape)
        trees = boosted(lambda work: sum(spread.map(lambda p: work(Rows(shared.value, folder, *p))).collect()), shape, plan)
        shared.unpersist()
        files, at = _folder(folder)
        files.delete_dir(at)
        return self._model(spark, trees, cuts, arity)

    def _model(self, spark, trees: list, cuts: list, arity: dict) -> GBTClassificationModel:
        """MLlib's model of the trees, by way of the files that a saved one consists of."""
        from pyspark import __version__ as version

        path = scratch_path(spark, "boosted_model")
        table, kept = [], []
        params = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        of_tree = {k: params[k] for k in ("cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
                                          "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")}
        meta = {"timestamp": 0, "sparkVersion": version, "defaultParamMap": {}}
        for t, nodes in enumerate(trees):
            for i, (value, impurity, stats, rows, gain, left, right, (f, goes, cats)) in enumerate(nodes):
                split = (-1, [], -1) if left < 0 else (f, [cuts[f][goes]], -1) if cats is None else (f, [float(c) for c in cats], arity[f])
                table.append((t, (i, value, impurity, stats, rows, gain, left, right, split)))
            kept.append((t, json.dumps({**meta, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"dtr_{random.getrandbits(48):012x}",
                                        "paramMap": {**of_tree, "impurity": "variance"}, "numFeatures": len(cuts)}), 1.0 if t == 0 else self.getStepSize()))
        own = {**meta, "class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": self.uid, "paramMap": params, "numFeatures": len(cuts), "numTrees": len(trees)}
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(kept, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(table, "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
                                     "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>") \
            .coalesce(1).write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)
