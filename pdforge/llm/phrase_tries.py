"""Collocations counted by double-array tries.

Candidates come level by level (Apriori): words are counted; pairs are summed in buckets of two 32-bit word hashes, so a
bucket's sum is never below a pair's frequency; triples are only summed where both their pairs' buckets reach the least
count (a bitmap of fixed size tells). Words of the hashes name the buckets (all words, where hashes collide), and sums and
word counts bound each score from above. The phrases of the highest bounds, their parts, and the longer phrases that
could drop them are dealt by hash into shards of at most about ``SHARD`` phrases; a task builds each shard's
double-array trie (base, check) over word numbers in three digits of 256, nodes with most children first and all nodes
of a kind at once. One shard is broadcast at a time (its size is bounded, whatever the corpus): numpy advances the states
of all text positions together, word by word and digit by digit, bincounts the accepting states, and Spark sums the
tasks' counts. So every frequency returned comes from matching the words themselves. While the last score of a lang's first
``TOP`` lies below the bound of a phrase not counted yet, those phrases are counted too: nothing is missed, and what is
broadcast does not grow with the number of frequent phrases. Scores are exact decimals of 38 digits.

Defined results: null text is empty; null lang is ``und`` and meets a lang of that name; rows that repeat count each
time; ties in score and frequency go by the phrase's bytes; an empty table gives an empty table; columns other than
text and lang are not read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import row_blocks, stored, worker_cache

LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
#: Phrases a trie, bits of the bitmap, positions and words held before they are summed, first choice per wanted phrase.
SHARD, FILTER_BITS, HELD, WORDS, CHOICE, SALTS = 1_000_000, 1 << 25, 1_000_000, 50_000, 4, 16
#: Rows a batch to Spark, bytes of text a block.
ROWS, BLOCK = 1 << 15, 1 << 18
HASH_MASK = 0xFFFFFFFF
DIGITS, DENSE = 3, 32
BREAK = b"\xff"  # no byte of UTF-8
_SPLIT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)


# ---- words -------------------------------------------------------------------------------------------------------

def by_language(batch, block: int = BLOCK):
    """(lang, words) of each language in a block of an Arrow batch; ``BREAK`` stands between pieces and texts."""
    for rows, texts in row_blocks(batch, block):
        groups = {}
        for lang, t in zip(rows.column("lang").to_pylist(), texts):
            groups.setdefault("und" if lang is None else lang, []).append(t)
        for lang, part in groups.items():
            joined = BREAK.join([*part, b""]).lower().translate(_SPLIT).replace(BREAK, b" " + BREAK + b" ")
            yield lang, joined.split()


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(lang: str, words: list[bytes], mask: int):
    """(distinct words, their hashes, number of each position's word, pair buckets, and where pairs and triples lie
    within a piece)."""
    import xxhash

    names = list(set(words))
    number = dict(zip(names, range(len(names))))
    code = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    seed = xxhash.xxh32_intdigest(lang.encode())
    hashes = np.array([xxhash.xxh64_intdigest(w, seed) & mask for w in names], dtype=np.uint64)
    h = hashes[code]
    word = code != number.get(BREAK, -1)
    in2 = word[:-1] & word[1:]
    return names, hashes, code, h, (h[:-1] << np.uint64(32)) | h[1:], in2, in2[:-1] & in2[1:]


def _long(x):
    return np.ascontiguousarray(x).view(np.int64)


# ---- candidates --------------------------------------------------------------------------------------------------

def marked(bitmap: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Whether the pair buckets' bits are set."""
    b = _mix(pair) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def words_and_pairs(docs: DataFrame, least: int) -> DataFrame:
    """(key, lang, word, c), one pass: words (key: hash) and pair buckets (no word, no lang) of ``least`` occurrences or
    more, and all words of each lang (no key, no word)."""
    mask = HASH_MASK

    def run(batches):
        import pyarrow as pa

        names = ["key", "lang", "word", "c"]
        held, size, own, n = [], 0, {}, {}

        def pairs():
            key, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for k in range(0, len(key), ROWS):
                none = pa.nulls(len(key[k:k + ROWS]), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(_long(key[k:k + ROWS])), none, none, pa.array(c[k:k + ROWS])], names=names)

        def counted():
            rows = [(h, lang, w, c) for lang, part in own.items() for w, (h, c) in part.items()]
            h, lang, w, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(h, type=pa.int64()), pa.array(lang), pa.array(w, type=pa.binary()).cast(pa.string()),
                                               pa.array(c, type=pa.int64())], names=names)

        for batch in batches:
            for lang, words in by_language(batch):
                words_, hashes, code, _, pair, in2, _ = coded(lang, words, mask)
                part = own.setdefault(lang, {})
                for w, h, c in zip(words_, hashes.tolist(), np.bincount(code, minlength=len(words_)).tolist()):
                    if w != BREAK:
                        part[w] = (h, part[w][1] + c if w in part else c)
                        n[lang] = n.get(lang, 0) + c
                held.append(pair[in2])
                size += len(held[-1])
                if size >= HELD:
                    yield from pairs()
                    size = 0
                if sum(map(len, own.values())) >= WORDS:
                    yield counted()
                    own.clear()
        if size:
            yield from pairs()
        if any(own.values()):
            yield counted()
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(list(n)), pa.nulls(len(n), pa.string()),
                                              pa.array(list(n.values()), type=pa.int64())], names=names)

    return docs.mapInArrow(run, "key long, lang string, word string, c long").groupBy("key", "lang", "word") \
        .agg(F.sum("c").alias("c")).where((F.col("c") >= least) | F.col("key").isNull())


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bitmap of the marked pair buckets: ``FILTER_BITS`` bits, so ``FILTER_BITS`` / 64 rows at most."""
    bits = FILTER_BITS

    def run(batches):
        import pyarrow as pa

        out = np.zeros(bits // 64, dtype=np.uint64)
        for batch in batches:
            b = _mix(batch.column("key").to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(out, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].view(np.int64))], names=["w", "b"])

    found = pairs.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["w"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def triples(docs: DataFrame, shared, least: int) -> DataFrame:
    """(key, h3, s): buckets of triples, both pairs marked, with ``least`` occurrences or more."""
    mask = HASH_MASK

    def run(batches):
        import pyarrow as pa

        keys, thirds, size = [], [], 0

        def counted():
            # 96 bits: number the pairs first
            pair, back = np.unique(np.concatenate(keys), return_inverse=True)
            both, c = np.unique((back.astype(np.uint64) << np.uint64(32)) | np.concatenate(thirds), return_counts=True)
            keys.clear()
            thirds.clear()
            for k in range(0, len(both), ROWS):
                b = both[k:k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(_long(pair[(b >> np.uint64(32)).astype(np.int64)])), pa.array(_long(b & np.uint64(0xFFFFFFFF))),
                                                  pa.array(c[k:k + ROWS])], names=["key", "h3", "c"])

        for batch in batches:
            for lang, words in by_language(batch):
                if len(words) < 3:
                    continue
                _, _, _, h, pair, in2, in3 = coded(lang, words, mask)
                ok = in2 & marked(shared.value, pair)
                at = np.flatnonzero(in3 & ok[:-1] & ok[1:])
                keys.append(pair[at])
                thirds.append(h[at + 2])
                size += len(at)
                if size >= HELD:
                    yield from counted()
                    size = 0
        if size:
            yield from counted()

    return docs.mapInArrow(run, "key long, h3 long, c long").groupBy("key", "h3").agg(F.sum("c").alias("s")).where(F.col("s") >= least)


def candidates(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, s, bound) of every phrase that may occur ``least`` times, (lang, n))."""
    one = stored(words_and_pairs(docs, least), "pt-pairs")
    pairs = one.where("key IS NOT NULL AND word IS NULL").select("key", F.col("c").alias("s"))
    shared = docs.sparkSession.sparkContext.broadcast(pair_bitmap(pairs))
    three = stored(triples(docs, shared, least), "pt-triples")
    shared.unpersist()
    word = lambda k: one.where("word IS NOT NULL").select(F.col("key").alias(f"h{k}"), "lang", F.col("word").alias(f"w{k}"), F.col("c").alias(f"f{k}"))
    halves = [F.expr("shiftrightunsigned(key, 32)").alias("h1"), F.expr("key & 4294967295").alias("h2")]
    # a phrase is no more frequent than its bucket, nor a part less frequent than the phrase
    up = lambda c: F.least(F.lit(1e6), c * (1e6 * (1 + 1e-9)))
    two = pairs.select(*halves, "s").join(word(1), "h1").join(word(2), ["lang", "h2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "s", up(F.col("s") / F.col("f1") * (F.col("s") / F.col("f2"))).alias("bound"))
    more = three.select(*halves, "h3", "s").join(word(1), "h1").join(word(2), ["lang", "h2"]).join(word(3), ["lang", "h3"])
    more = more.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "s", up(F.col("s") / F.greatest("f1", "f3")).alias("bound"))
    return stored(two.unionByName(more), "pt-candidates"), one.where("key IS NULL").select("lang", F.col("c").alias("n"))


# ---- double-array tries ------------------------------------------------------------------------------------------

def double_array(words: np.ndarray, sizes: np.ndarray, seed: int = 1):
    """(base, check, state of each phrase) of phrases given as word numbers, ``words`` padded to ``LONGEST`` columns."""
    rng = np.random.default_rng(seed)
    node, levels, total = np.zeros(len(words), dtype=np.int64), [], 1
    final = node.copy()
    for w in range(words.shape[1]):
        rows = np.flatnonzero(sizes > w)
        for shift in range(8 * (DIGITS - 1), -1, -8):
            digit = (words[rows, w] >> shift) & 255
            key, back = np.unique(node[rows] * 256 + digit, return_inverse=True)
            levels.append((key >> 8, key & 255))
            node[rows] = total + back
            total += len(key)
        done = rows[sizes[rows] == w + 1]
        final[done] = node[done]
    parent = np.concatenate([[0], *[p for p, _ in levels]])
    digit = np.concatenate([[0], *[d for _, d in levels]])
    order = 1 + np.argsort(parent[1:], kind="stable")
    heads, begin, kids = np.unique(parent[order], return_index=True, return_counts=True)
    base = np.zeros(total, dtype=np.int64)
    wide = heads[kids > DENSE]
    # slots 0 to 255 hold the root alone; wide nodes have 256 slots each, whose gaps others fill
    base[wide] = 256 * (1 + np.arange(len(wide)))
    slots = 256 * (2 + len(wide)) + int(1.3 * kids[kids <= DENSE].sum()) + 512
    used = np.zeros(slots, dtype=bool)
    used[:256] = used[-256:] = True
    inner = np.isin(parent, wide)
    inner[0] = False
    used[base[parent[inner]] + digit[inner]] = True
    for k in range(DENSE, 1, -1):
        of = np.flatnonzero(kids == k)
        own = digit[order[begin[of, None] + np.arange(k)[None, :]]]
        who = heads[of]
        while len(who):
            free = np.flatnonzero(~used)
            if len(free) < 4 * k:
                free = np.zeros(0, dtype=np.int64)
            placed = np.zeros(len(who), dtype=bool)
            if len(free):
                b = rng.choice(free, len(who)) - own[:, 0]
                at = b[:, None] + own
                good = np.flatnonzero((b > 0) & ~used[np.clip(at, 0, len(used) - 1)].any(axis=1) & (at[:, -1] < len(used)))
                claim = np.full(len(used), -1)
                claim[at[good]] = good[:, None]
                good = good[(claim[at[good]] == good[:, None]).all(axis=1)]
                base[who[good]] = b[good]
                used[at[good]] = True
                placed[good] = True
            who, own = who[~placed], own[~placed]
            if placed.mean() < 0.02 and len(who):  # too full: more room at the end
                used = np.concatenate([used[:-256], np.zeros(max(4 * k * len(who), 1024), dtype=bool), np.ones(256, dtype=bool)])
    of = np.flatnonzero(kids == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(of):
        used = np.concatenate([used[:-256], np.zeros(len(of), dtype=bool), np.ones(256, dtype=bool)])
        free = np.flatnonzero(~used)
    base[heads[of]] = free[:len(of)] - digit[order[begin[of]]]
    state = base[parent] + digit
    state[0] = 0
    full = np.zeros(len(used), dtype=np.int32)
    full[state] = base
    check = np.full(len(used), -1, dtype=np.int32)
    check[state[1:]] = state[parent[1:]]
    return full, check, state[final]


def advance(base: np.ndarray, check: np.ndarray, state: np.ndarray, word: np.ndarray):
    """(rows that go on, their states) after one word each."""
    at = np.arange(len(state))
    for shift in range(8 * (DIGITS - 1), -1, -8):
        t = base[state].astype(np.int64) + ((word >> shift) & 255)
        ok = check[t] == state
        state, word, at = t[ok], word[ok], at[ok]
    return at, state


def shard_tries(entries: DataFrame) -> DataFrame:
    """(shard, state, lang, phrase, name, blob): the accepting states of each shard, and its arrays."""
    def build(key, pdf):
        import pandas as pd

        vocabulary, rows = {}, []
        for lang, phrase in zip(pdf["lang"], pdf["phrase"]):
            own = vocabulary.setdefault(lang, {})
            rows.append([own.setdefault(w, len(own)) for w in phrase.split(" ")])
        first, n = {}, 0
        for lang, own in vocabulary.items():
            first[lang] = n
            n += len(own)
        if n >= 256 ** DIGITS:
            raise ValueError("a shard holds more words than its digits number")
        sizes = np.array([len(r) for r in rows])
        words = np.zeros((len(rows), LONGEST), dtype=np.int64)
        for k in range(LONGEST):
            has = np.flatnonzero(sizes > k)
            words[has, k] = [rows[i][k] for i in has]
        words += pdf["lang"].map(first).to_numpy()[:, None]
        base, check, state = double_array(words, sizes)
        accept = np.zeros(len(base), dtype=bool)
        accept[state] = True
        blobs = {"base": base.tobytes(), "check": check.tobytes(), "accept": np.packbits(accept).tobytes(),
                 "words": json.dumps({lang: list(own) for lang, own in vocabulary.items()}).encode()}
        shard = int(key[0])
        return pd.concat([
            pd.DataFrame({"shard": shard, "state": state, "lang": pdf["lang"].to_numpy(), "phrase": pdf["phrase"].to_numpy(), "name": None, "blob": None}),
            pd.DataFrame([{"shard": shard, "state": -1, "lang": None, "phrase": None, "name": k, "blob": v} for k, v in blobs.items()])])

    return entries.groupBy("shard").applyInPandas(build, "shard long, state long, lang string, phrase string, name string, blob binary")


class _Numbers(dict):
    def __missing__(self, key):
        return -1


def _trie(shared, key: str) -> dict:
    home = worker_cache("phrases")
    if key not in home:
        home.clear()  # one shard at a time
        raw = shared.value
        base = np.frombuffer(raw["base"], dtype=np.int32)
        words, n = {}, 0
        for lang, own in json.loads(raw["words"]).items():
            words[lang] = _Numbers(zip((w.encode() for w in own), range(n, n + len(own))))
            n += len(own)
        home[key] = {"base": base, "check": np.frombuffer(raw["check"], dtype=np.int32), "words": words,
                     "accept": np.unpackbits(np.frombuffer(raw["accept"], dtype=np.uint8))[:len(base)].astype(bool)}
    return home[key]


def shard_counts(docs: DataFrame, shared, key: str) -> DataFrame:
    """(state, f): occurrences of one shard's phrases by accepting state."""
    def run(batches):
        import pyarrow as pa

        t = _trie(shared, key)
        base, check = t["base"], t["check"]
        counts = np.zeros(len(base), dtype=np.int64)
        held, size = [], 0
        for batch in batches:
            for lang, words in by_language(batch):
                if lang not in t["words"]:
                    continue
                number = np.fromiter(map(t["words"][lang].__getitem__, words), dtype=np.int64, count=len(words))
                pos = np.flatnonzero(number >= 0)
                state = np.zeros(len(pos), dtype=np.int64)
                for _ in range(LONGEST):
                    on, state = advance(base, check, state, number[pos])
                    held.append(state)
                    size += len(state)
                    pos = pos[on] + 1
                    ok = pos < len(number)
                    ok[ok] = number[pos[ok]] >= 0
                    pos, state = pos[ok], state[ok]
                if size >= HELD:
                    counts += np.bincount(np.concatenate(held), minlength=len(base))
                    held, size = [], 0
        if size:
            counts += np.bincount(np.concatenate(held), minlength=len(base))
        hit = np.flatnonzero((counts > 0) & t["accept"])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["state", "c"])

    return docs.mapInArrow(run, "state long, c long").groupBy("state").agg(F.sum("c").alias("f"))


def frequencies(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, f) of ``phrases`` (distinct lang, phrase; a stored table) that occur."""
    shards = max(1, -(-phrases.count() // SHARD))
    tries = stored(shard_tries(phrases.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)))), "pt-tries")
    sc = docs.sparkSession.sparkContext
    out = phrases.select("lang", "phrase", F.lit(0).cast("long").alias("f")).limit(0)
    for k in range(shards):
        raw = {r.name: bytes(r.blob) for r in tries.where((F.col("shard") == k) & F.col("name").isNotNull()).select("name", "blob").collect()}
        if not raw:  # an empty shard
            continue
        shared = sc.broadcast(raw)  # about 25 bytes a phrase of SHARD
        counted = stored(shard_counts(docs, shared, tries.inputFiles()[0] + f"#{k}"), "pt-counts")
        shared.unpersist()
        own = tries.where((F.col("shard") == k) & F.col("phrase").isNotNull()).select("state", "lang", "phrase")
        out = out.unionByName(own.join(counted.hint("merge"), "state").select("lang", "phrase", "f"))
    return out


# ---- scores ------------------------------------------------------------------------------------------------------

def _parts(t: DataFrame) -> DataFrame:
    """(lang, phrase): the phrases and all their shorter parts."""
    w = F.split("phrase", " ")
    runs = F.expr("flatten(transform(sequence(1, size(w)), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    return t.withColumn("w", w).select("lang", F.explode(runs).alias("phrase")).distinct()


def _held_pairs(t: DataFrame) -> DataFrame:
    """``t`` with one row for each pair (``phrase``) that a phrase of three words (``long``) holds."""
    w = F.split("long", " ")
    pairs = F.array_distinct(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " ")))
    return t.withColumnRenamed("phrase", "long").where(F.size(w) == 3).withColumn("phrase", F.explode(pairs))


def _scores(chosen: DataFrame, f: DataFrame, least: int, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the chosen phrases that stay."""
    often = chosen.select("lang", "phrase").join(f.withColumnRenamed("f", "a").hint("merge"), ["lang", "phrase"]) \
        .where(F.col("a") >= least).withColumn("w", F.split("phrase", " "))
    cut = often.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.withColumn("head", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn("rest", F.expr("array_join(slice(w, k + 1, size(w)), ' ')"))
    both = cut.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")).hint("merge"), ["lang", "head"]) \
        .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).hint("merge"), ["lang", "rest"])
    both = both.withColumn("score", F.expr("(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0)))"
                                           " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")) \
        .select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    over = _held_pairs(f.where(F.col("f") >= least)).groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    return best.join(over.hint("merge"), ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < inside * F.col("a"))) \
        .drop("over")


def _ranked(t: DataFrame, order: list, top: int) -> DataFrame:
    """``t`` with the rank within its lang, the first ``top`` rows; a lang's rows are cut in ``SALTS`` parts first."""
    salt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    part = t.withColumn("r_", F.row_number().over(salt)).where(F.col("r_") <= top).drop("r_")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def query(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select("text", "lang")
    known, n = candidates(docs, least)
    holds = _held_pairs(known.select("lang", "phrase", F.col("s").alias("s3")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bounds = {}  # one number a lang: phrases whose bound reaches it are counted
    for r in _ranked(known, [F.desc("bound"), "phrase"], CHOICE * top).groupBy("lang").agg(F.min("bound").alias("b")).collect():
        bounds[r.lang] = r.b
    f = asked = scored = None
    while bounds:
        level = docs.sparkSession.createDataFrame(list(bounds.items()), "lang string, b double")
        chosen = stored(known.join(F.broadcast(level), "lang").where("bound >= b").select("lang", "phrase", "s"), "pt-chosen")
        size = chosen.select("lang", "phrase", F.col("s").alias("a"))
        if f is not None:  # a bucket may hold more than the phrase
            size = size.join(f.hint("merge"), ["lang", "phrase"], "left").select("lang", "phrase", F.coalesce("f", "a").alias("a"))
        longer = holds.join(size.hint("merge"), ["lang", "phrase"]).where(100 * F.col("s3") >= inside * F.col("a"))
        need = _parts(chosen).unionByName(longer.select("lang", F.col("long").alias("phrase"))).distinct()
        if asked is not None:
            need = need.join(asked.hint("merge"), ["lang", "phrase"], "left_anti")
        need = stored(need, "pt-need")
        if not need.isEmpty():
            new = frequencies(docs, need)
            f = stored(new if f is None else f.unionByName(new), "pt-frequencies")
            asked = need if asked is None else asked.unionByName(need)
        elif scored == bounds:
            break
        done = stored(_scores(chosen, f, least, inside), "pt-scores")
        low = {r.lang: float(r.score) for r in _ranked(done, order, top).where(F.col("rank") == top).collect()}
        scored, bounds = bounds, {lang: min(b, low.get(lang, -1.0)) for lang, b in bounds.items()}
    if f is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return _ranked(done, order, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps
  FROM documents),
words AS (
  SELECT d, lang, p, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i
  FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
        FROM (SELECT d, lang, unnest(ps) AS piece, unnest(generate_series(1, len(ps))) AS p FROM pieces))),
next AS (SELECT lang, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY d, p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w AS phrase, count(*) AS f FROM next GROUP BY ALL),
f2 AS (SELECT lang, w || ' ' || w2 AS phrase, w, w2, count(*) AS f FROM next WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w || ' ' || w2 || ' ' || w3 AS phrase, w, w2, w3, count(*) AS f FROM next WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS k, w AS h, w2 AS t FROM f2 WHERE f >= 10
  UNION ALL SELECT lang, phrase, f, 1, w, w2 || ' ' || w3 FROM f3
  UNION ALL SELECT lang, phrase, f, 2, w || ' ' || w2, w3 FROM f3),
f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, f FROM f2),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.h JOIN f y ON y.lang = c.lang AND y.phrase = c.t),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
       b.phrase, b.a, b.l, b.r, n.n, b.score
FROM best b JOIN n USING (lang) LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.f IS NULL OR 100 * o.f < 50 * b.a
QUALIFY rank <= 2000
"""
