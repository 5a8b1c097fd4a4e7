"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of bytes: each run of non-white-space with a space at either end, longer runs cut every
``WINDOW`` bytes. Two gated recurrent passes, forward and backward, give every position a distribution over the
languages; a document pools the log probabilities of all positions of all its windows that hold a letter. Training
is backpropagation through time with Adam, on the driver, over the distinct words of a bounded sample of labelled
documents (``max_docs`` a language, chosen by a hash of doc_id). Prediction labels whole texts: a window's result
depends on its bytes alone, so each distinct window is run once per worker and memoised.

Defined results: null text or text without a letter is ``und`` with score 0; so is every text when there is no
labelled row to learn from; ties go to the smaller language name; a null doc_id is never held out; repeated rows
repeat their result; an empty table gives an empty table; of other columns only ``lang`` is read, for training.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.llm.common import row_blocks, worker_cache

WINDOW, HIDDEN, MAX_DOCS, STEPS, BATCH, RATE, SEED = 24, 16, 400, 500, 256, 0.01, 7
MEMO_WINDOWS = 400_000
EDGE = 32


# ---- the network -------------------------------------------------------------------------------------------------

def _init(classes: int, hidden: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.1, (257, 3 * hidden))   # input weights of each byte; 256 is padding
        p[f"{d}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p[f"{d}b"] = np.zeros(hidden)                         # recurrent bias of the candidate
    p["o"] = rng.normal(0, 0.1, (2 * hidden, classes))
    p["ob"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _pass(x, mask, wx, wh, bn, keep=False):
    """One direction over x (batch, time) of bytes; states (time, batch, hidden), and what the way back needs."""
    batch, steps = x.shape
    hidden = wh.shape[0]
    h = np.zeros((batch, hidden), dtype=np.float32)
    states, tape = np.empty((steps, batch, hidden), dtype=np.float32), []
    for t in range(steps):
        gx = wx[x[:, t]]
        gh = h @ wh
        zr = 1 / (1 + np.exp(-(gx[:, :2 * hidden] + gh[:, :2 * hidden])))
        z, r = zr[:, :hidden], zr[:, hidden:]
        u = gh[:, 2 * hidden:] + bn
        n = np.tanh(gx[:, 2 * hidden:] + r * u)
        m = mask[:, t:t + 1]
        new = m * (n + z * (h - n)) + (1 - m) * h
        if keep:
            tape.append((h, z, r, u, n, m))
        states[t] = h = new
    return states, tape


def _back(x, tape, dstates, wh):
    """Gradients of one direction: backpropagation through time."""
    hidden = wh.shape[0]
    dwx, dwh, db = np.zeros((257, 3 * hidden), np.float32), np.zeros_like(wh), np.zeros(hidden, np.float32)
    dh = np.zeros_like(dstates[0])
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, u, n, m = tape[t]
        dh = dh + dstates[t]
        dnew, dprev = dh * m, dh * (1 - m)
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        du = dn * r
        dgh = np.concatenate([dz, dr, du], axis=1)
        np.add.at(dwx, x[:, t], np.concatenate([dz, dr, dn], axis=1))
        dwh += h.T @ dgh
        db += du.sum(axis=0)
        dh = dprev + dnew * z + dgh @ wh.T
    return dwx, dwh, db


def _reversed(x, lengths):
    """Each row's first ``lengths`` entries in reverse order, padding left in place; and the index that does it."""
    at = np.arange(x.shape[1])[None, :]
    index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, index, axis=1), index


def _positions(p, x, lengths, keep=False):
    mask = (np.arange(x.shape[1])[None, :] < lengths[:, None]).astype(np.float32)
    xr, index = _reversed(x, lengths)
    sf, tf = _pass(x, mask, p["fx"], p["fh"], p["fb"], keep)
    sb, tb = _pass(xr, mask, p["bx"], p["bh"], p["bb"], keep)
    sb = np.take_along_axis(sb, index.T[:, :, None], axis=0)  # back to the places of the bytes
    s = np.concatenate([sf, sb], axis=2)
    logits = s @ p["o"] + p["ob"]
    logits = logits - logits.max(axis=2, keepdims=True)
    logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    return logp, mask, s, (xr, index, tf, tb)


def window_scores(p, x, lengths):
    """Sum over the positions of each window of the log probabilities of the languages."""
    logp, mask, _, _ = _positions(p, x, lengths)
    return (logp * mask.T[:, :, None]).sum(axis=0)


def loss_and_gradients(p, x, lengths, y):
    hidden = p["fh"].shape[0]
    logp, mask, s, (xr, index, tf, tb) = _positions(p, x, lengths, keep=True)
    total = mask.sum()
    w = mask.T[:, :, None] / total
    onehot = np.eye(p["o"].shape[1], dtype=np.float32)[y][None]
    loss = -float((logp * onehot * w).sum())
    dl = (np.exp(logp) - onehot) * w
    g = {"o": np.einsum("tbh,tbc->hc", s, dl), "ob": dl.sum(axis=(0, 1))}
    ds = dl @ p["o"].T
    g["fx"], g["fh"], g["fb"] = _back(x, tf, ds[:, :, :hidden], p["fh"])
    dsb = np.take_along_axis(ds[:, :, hidden:], index.T[:, :, None], axis=0)
    g["bx"], g["bh"], g["bb"] = _back(xr, tb, dsb, p["bh"])
    return loss, g


def padded(windows: list[bytes]):
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    x = np.full((len(windows), int(lengths.max(initial=1))), 256, dtype=np.int64)
    flat = np.frombuffer(b"".join(windows), dtype=np.uint8)
    x[np.arange(x.shape[1])[None, :] < lengths[:, None]] = flat
    return x, lengths


def fit(words: list[bytes], labels: np.ndarray, weights: np.ndarray, classes: int, hidden: int = HIDDEN,
        steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> dict[str, np.ndarray]:
    """Train on windows drawn by weight, languages in equal shares."""
    rng = np.random.default_rng(seed)
    p = _init(classes, hidden, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    share = weights / np.bincount(labels, weights, classes)[labels]
    draw = np.cumsum(share) / share.sum()
    for step in range(1, steps + 1):
        pick = np.minimum(np.searchsorted(draw, rng.random(batch)), len(words) - 1)
        x, lengths = padded([words[i] for i in pick])
        _, g = loss_and_gradients(p, x, lengths, labels[pick])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            p[k] -= (pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


# ---- on Spark ----------------------------------------------------------------------------------------------------

def runs_of(text: bytes, window: int = WINDOW) -> list[bytes]:
    """Runs of non-white-space that may hold a letter, cut every ``window`` bytes."""
    out = []
    for w in text.split():
        if len(w) <= window:
            out.append(w)
        else:
            out += [w[i:i + window] for i in range(0, len(w), window)]
    return out


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, **settings):
    """(languages, parameters) learned from labelled documents that are not held out, about ``max_docs`` of each
    language; None without any."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, max_docs / n))]), F.col("lang"))
    u = F.pmod(F.xxhash64(F.lit("gru"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    words = (known.where(u < share).select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w"))
             .where(F.col("w") != "").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "w").toPandas())
    names = sorted(counts)
    windows, labels, weights = [], [], []
    for lang, w, n in words.itertuples(index=False):
        for piece in runs_of(w.encode()):
            windows.append(bytes([EDGE]) + piece + bytes([EDGE]))
            labels.append(names.index(lang))
            weights.append(n)
    if not windows:
        return None
    return names, fit(windows, np.array(labels), np.array(weights, dtype=float), len(names), **settings)


def _labeller(model):
    """A function from texts to (languages, scores), with a memo of windows kept in the worker."""
    import regex

    letter = regex.compile(r"\p{L}")
    lettered = bytes(1 if chr(c).isalpha() else 0 for c in range(128)) + b"\1" * 128
    names, p = model if model else ([], {"o": np.zeros((0, 0))})
    token = (tuple(names), p["o"].tobytes())
    home = worker_cache("gru")
    if home.get("model") != token:
        home.clear()
        home.update(model=token, memo={}, rows=np.zeros((0, len(names)), np.float32))

    def learn(new):
        new.sort(key=len)
        out = []
        for i in range(0, len(new), 2048):
            x, lengths = padded([bytes([EDGE]) + w + bytes([EDGE]) for w in new[i:i + 2048]])
            out.append(window_scores(p, x, lengths))
        base = len(home["rows"])
        home["memo"].update((w, base + i) for i, w in enumerate(new))
        home["rows"] = np.concatenate([home["rows"], *out])

    def label(texts):
        preds, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not names:
            return preds, scores
        if len(home["memo"]) > MEMO_WINDOWS:
            home.update(memo={}, rows=np.zeros((0, len(names)), np.float32))
        split = [[w for w in runs_of(t) if 1 in w.translate(lettered)] if letter.search(t.decode()) else [] for t in texts]
        memo = home["memo"]
        new = [w for w in set().union(*split) if w not in memo]
        if new:
            learn(new)
        for i, runs in enumerate(split):
            if runs:
                at = np.fromiter(map(memo.__getitem__, runs), dtype=np.int64, count=len(runs))
                total = home["rows"][at].sum(axis=0, dtype=np.float64)
                mean = total / sum(map(len, runs))
                prob = np.exp(mean - mean.max())
                best = int(np.argmax(total))
                preds[i], scores[i] = names[best], float(prob[best] / prob.sum())
        return preds, scores

    return label


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score of each row, over whole texts."""
    def run(batches):
        import pyarrow as pa

        label = _labeller(model)
        for batch in batches:
            for rows, texts in row_blocks(batch):
                preds, scores = label(texts)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(preds, type=pa.string()), pa.array(scores, type=pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns: only ``und`` is rejected, and where no model could
    be learned only texts without a letter."""
    def run(batches):
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}")
        label = _labeller(model)
        for batch in batches:
            for rows, texts in row_blocks(batch):
                keep = [p != "und" for p in label(texts)[0]] if model and model[0] else [bool(letter.search(t.decode())) for t in texts]
                yield rows.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
