"""Many logistic models of all folds fitted and scored together.

The rows are written once, whatever the number of folds: numeric inputs, places of levels, fold. What a fold's own scaler and
indexer would make of them is a linear map of one common design (a level that a fold does not train on counts as unknown), so
a pass computes sums in the common design and the driver turns them into the fold's. A pass a step serves all models of all
folds; tasks return sums whose size is that of the models.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Rows of a product at once; rows up to which every model has its own curvature; curvatures a fold beyond; scores of a bucket;
#: rows a task and fold shows for the cuts between buckets.
CHUNK, OWN_ROWS, CURVATURES, BUCKET, SHOWN = 4096, 200_000, 3, 200_000, 64


def _parts(batches, rows: int):
    """(fold, numeric inputs, places of levels, label, weight) of some rows at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.slice(i, rows)
            x, c = (part.column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) for n in ("x", "c"))
            yield part.column("fold").to_numpy(zero_copy_only=False), x, c, *(part.column(n).to_numpy(zero_copy_only=False) for n in ("y", "w"))


def _merged(a, b):
    """Counts, means and sums of squared deviations of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n), *(p + q for p, q in zip(a[3:], b[3:]))


class Design:
    """The common design of the rows and each fold's map into its own."""

    def __init__(self, rows: DataFrame, folds: int, levels: list[int]):
        self.levels, self.folds = levels, folds
        found = _statistics(rows, levels)
        self.own = {k: s for k, (s, _) in found.items()}
        self.shown = {k: s for k, (_, s) in found.items()}
        every = None
        for s in self.own.values():
            every = _merged(every, s)
        if every is None:
            raise ValueError("there are no rows to fit")
        self.n, self.mean = int(every[0]), every[1]
        std = np.sqrt(every[2] / max(1, every[0] - 1))
        self.std = np.where(std > 0, std, 1.0)
        self.maps, self.weight = {}, {}
        for k in range(folds):
            train = None
            for h, s in self.own.items():
                train = _merged(train, s) if h != k else train
            if train is None:
                continue
            self.weight[k] = float(train[4])
            std, p = np.sqrt(train[2] / max(1, train[0] - 1)), len(self.mean)
            scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
            m = np.eye(1 + p + sum(levels))
            m[np.arange(1, p + 1), np.arange(1, p + 1)] = self.std * scale
            m[1:p + 1, 0] = (self.mean - train[1]) * scale
            at = 1 + p
            for size in levels:  # the last place is that of unknown levels
                gone = at + np.flatnonzero(train[3][at - 1 - p:at - 1 - p + size - 1] == 0)
                m[gone, gone], m[at + size - 1, gone] = 0.0, 1.0
                at += size
            self.maps[k] = m

    def rows(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.std, *[np.eye(size)[c[:, j]] for j, size in enumerate(self.levels)]], axis=1)


def _statistics(rows: DataFrame, levels: list[int]) -> dict:
    """Per fold: (count, means, squared deviations, rows of each level, weight), and a few of its rows."""
    def run(batches):
        import pickle

        import pyarrow as pa

        sums, shown = {}, {}
        for k, x, c, _, w in _parts(batches, 65536):
            for f in np.unique(k).tolist():
                own = k == f
                xs, cs = x[own], c[own]
                mean = xs.mean(axis=0)
                found = (float(len(xs)), mean, ((xs - mean) ** 2).sum(axis=0),
                         np.concatenate([np.zeros(0), *[np.bincount(cs[:, j], minlength=size) for j, size in enumerate(levels)]]), w[own].sum())
                sums[f] = _merged(sums.get(f), found)
                shown.setdefault(f, (xs[:SHOWN].copy(), cs[:SHOWN].copy()))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sums, shown))], pa.binary())], names=["sums"])

    import pickle

    total, some = {}, {}
    for r in rows.mapInArrow(run, "sums binary").collect():  # a row a task: its size is that of the inputs
        sums, shown = pickle.loads(r["sums"])
        for f, s in sums.items():
            total[f] = _merged(total.get(f), s)
            some.setdefault(f, []).append(shown[f])
    return {f: (s, some[f]) for f, s in total.items()}


def fitted(rows: DataFrame, design: Design, regs: list, max_iters: list, tol: float = 1e-10) -> np.ndarray:
    """Coefficients (fold, model, intercept and inputs of the fold's own design) of one L2 logistic model for the training rows
    of each fold and each strength of ``regs``: the objective of ``lr_pipeline`` (mean weighted loss, intercept not penalised).

    Newton's method with exact losses and gradients. Beyond ``OWN_ROWS`` rows a fold's models share the curvatures of a few of
    them (the strength hardly moves those), which costs steps but little work a row. A step that does not lower a model's loss
    is halved; a model leaves when its next step would gain less than ``tol`` of it.
    """
    folds, models, d = design.folds, len(regs), len(next(iter(design.maps.values())))
    held, trial, step = (np.zeros((folds, models, d)) for _ in range(3))
    best, shrink = np.full((folds, models), np.inf), np.ones((folds, models))
    left = {(k, m) for k in design.maps for m in range(models)}
    ranked = np.argsort(regs, kind="stable")
    count = models if design.n <= OWN_ROWS else min(models, CURVATURES)
    picked = [int(ranked[(2 * i + 1) * models // (2 * count)]) for i in range(count)]
    model_of = {int(m): picked[r * count // models] for r, m in enumerate(ranked)}
    bends, fixed = {}, np.full(d, 1.0)
    fixed[0] = 0.0
    for turn in range(max(max_iters)):
        asked = sorted(left)
        if not asked:
            break
        curved = sorted({(k, model_of[m]) for k, m in asked} & left)
        common = np.stack([design.maps[k].T @ trial[k, m] for k, m in asked])
        at = {a: i for i, a in enumerate(asked)}

        def run(batches, asked=asked, curved=curved, common=common, at=at):
            import pyarrow as pa

            loss, grad, bend = np.zeros(len(asked)), np.zeros((len(asked), d)), np.zeros((len(curved), d, d))
            for k, x, c, y, w in _parts(batches, CHUNK):
                z = design.rows(x, c)
                for f in np.unique(k).tolist():
                    own, mine = k == f, [i for i, (g, _) in enumerate(asked) if g != f]
                    if not mine:
                        continue
                    zf, yf, wf = z[own], y[own][:, None], w[own][:, None]
                    margin = zf @ common[mine].T
                    e = np.exp(-np.abs(margin))
                    p = np.where(margin >= 0, 1.0, e) / (1.0 + e)
                    loss[mine] += (wf * (np.maximum(margin, 0.0) + np.log1p(e) - yf * margin)).sum(axis=0)
                    grad[mine] += (wf * (p - yf)).T @ zf
                    place = {i: j for j, i in enumerate(mine)}
                    for j, a in enumerate(curved):
                        if a[0] != f:
                            q = p[:, place[at[a]]]
                            bend[j] += (zf * (wf[:, 0] * q * (1 - q))[:, None]).T @ zf
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([loss, grad.ravel(), bend.ravel()]).tobytes()], pa.binary())], names=["sums"])

        total = sum(np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect())  # a row a task, as large as the models
        n = len(asked)
        loss, grad, bend = total[:n], total[n:n + n * d].reshape(n, d), total[n + n * d:].reshape(-1, d, d)
        now = [loss[i] / design.weight[k] + 0.5 * float((regs[m] * fixed * trial[k, m] ** 2).sum()) for i, (k, m) in enumerate(asked)]
        for (k, m), b in zip(curved, bend):
            if now[at[k, m]] <= best[k, m] or (k, m) not in bends:
                bends[k, m] = design.maps[k] @ b @ design.maps[k].T / design.weight[k]
        for i, (k, m) in enumerate(asked):
            pull = regs[m] * fixed
            if now[i] <= best[k, m]:
                held[k, m], best[k, m], shrink[k, m] = trial[k, m], now[i], 1.0
                slope = design.maps[k] @ grad[i] / design.weight[k] + pull * trial[k, m]
                step[k, m] = np.linalg.lstsq(bends[k, model_of[m]] + np.diag(pull), slope, rcond=None)[0]
                gain = 0.5 * float(slope @ step[k, m])
            else:
                shrink[k, m] /= 2
                gain = best[k, m] if shrink[k, m] > 1e-6 else 0.0
            if gain <= tol * best[k, m] or turn + 1 >= max_iters[m]:
                left.discard((k, m))
            trial[k, m] = held[k, m] - shrink[k, m] * step[k, m]
    return held


def held_out_aucs(rows: DataFrame, design: Design, coefs: np.ndarray) -> dict:
    """{(model, fold): exact ROC-AUC of the fold's own rows}.

    Scores travel as blocks of numbers, by model, fold and range of scores; the cuts between ranges come from a few rows and
    decide only how even the ranges are. A range is sorted in one task; counts of the ranges add up to the exact area.
    """
    models, folds = coefs.shape[1], sorted(design.maps)
    common = {k: (design.maps[k].T @ coefs[k].T) for k in folds}
    cuts = {}
    for k in folds:
        ranges = -(-int(design.own[k][0]) // BUCKET) if k in design.own else 1
        some = np.concatenate([design.rows(x, c) for x, c in design.shown.get(k, [])]) @ common[k] if k in design.own else None
        cuts[k] = np.quantile(some, np.arange(1, ranges) / ranges, axis=0) if ranges > 1 else np.zeros((0, models))

    def blocks(batches):
        import pyarrow as pa

        for k, x, c, y, _ in _parts(batches, 32768):
            found = []
            for f in np.unique(k).tolist():
                own = k == f
                score, yes = design.rows(x[own], c[own]) @ common[f] if f in common else np.zeros((0, models)), y[own] == 1
                for m in range(models if f in common else 0):
                    place = np.searchsorted(cuts[f][:, m], score[:, m], side="right")
                    for b in np.unique(place).tolist():
                        here = place == b
                        found.append((m, f, b, score[here & yes, m].tobytes(), score[here & ~yes, m].tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["m", "k", "b", "yes", "no"])

    def counted(pdf):
        import pandas as pd

        yes, no = (np.sort(np.concatenate([np.frombuffer(v) for v in pdf[c]])) for c in ("yes", "no"))
        twice = int(np.searchsorted(no, yes, side="left").sum()) + int(np.searchsorted(no, yes, side="right").sum())
        return pd.DataFrame({"m": pdf["m"].iloc[:1], "k": pdf["k"].iloc[:1], "b": pdf["b"].iloc[:1], "yes": [len(yes)], "no": [len(no)], "twice": [twice]})

    ranges = rows.mapInArrow(blocks, "m int, k int, b int, yes binary, no binary").groupBy("m", "k", "b") \
        .applyInPandas(counted, "m int, k int, b int, yes long, no long, twice long").collect()  # a row a range
    out, sums = {}, {}
    for r in sorted(ranges, key=lambda r: (r.m, r.k, r.b)):
        yes, no, twice = sums.get((r.m, r.k), (0, 0, 0))
        sums[r.m, r.k] = (yes + r.yes, no + r.no, twice + r.twice + 2 * r.yes * no)
    for at, (yes, no, twice) in sums.items():
        if not (yes and no):
            raise ValueError("a fold lacks a class")
        out[at] = twice / (2.0 * yes * no)
    return out
