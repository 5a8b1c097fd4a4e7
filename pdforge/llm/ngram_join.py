"""Set similarity join on word shingles, with set-relation skipping.

Sets are the distinct ``N``-word shingles of a text as 64-bit hashes; texts with equal sets are one class. Index lists
hold, for each shingle in the first quarter of a set (prefix filter, in one global order with frequent shingles
last), the class, its size and the position. Skipping by position: a pair is only looked at where sizes and
positions leave room for enough common shingles. Skipping by relation: in a first round each list compares its members
with one leader only; members that link to it share its component, and what is known of a leader bounds the rest
(|x & z| <= |c & z| + |x - c|). A bitmap of bucket parities bounds it too: sets differ in at least as many
shingles as their bitmaps in bits. Before any text moves, a pair's sketches are compared: parity bitmaps that grow with
the set, a bit or two a shingle, so that long sets are told apart too; a pair they refute is known by bounds alone. Star rounds with other leaders repeat until few lists mix components; then every pair
of a list that lies in different components and passes all bounds is verified on the whole texts. So no link between
components is missed, and a group of thousands of near copies costs a few comparisons a member, not all pairs.

Frequent shingles are found by counts of all shingles inside tasks; their number is bounded (``FREQUENT_MOST``) and only
sets the order of shingles and how lists are dealt out, never which pairs are found. Lists of frequent shingles are
dealt out in blocks by class, and no entry of such a list is left out.

Defined results: null text, empty text and text without words have an empty set and link with nothing; fewer than N
words are one shingle of all of them; rows with equal sets share a component, as do rows that repeat a doc_id; a null
doc_id links like any other and comes after all ids, so a component is named null only where it has no id (ids of 2^62
and more are reserved for this); an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pdforge.llm.common import row_blocks, stored, worker_cache
from pdforge.llm.graph import components

N = 5
#: Link when 100 * common >= PERCENT * union, that is 7 * common >= 3 * (sum of sizes) at 75.
PERCENT = 75
FREQUENT, FREQUENT_MOST, BLOCK, FILTER_BITS = 32, 200_000, 512, 1 << 22
STAR_ROUNDS, HUBS, HUB_LISTS, BEFORE = 2, 8, 2, 3
#: Added to the block numbers of a list that is dealt out.
SPLIT = 1 << 30
NO_ID = 1 << 62
#: Longs of a set's bitmap: bit k is the parity of its shingles in bucket k.
LONGS = 8
BITS = [f"b{k}" for k in range(LONGS)]

_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- shingle sets ------------------------------------------------------------------------------------------------

def _mix(x):
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, .. n - 1; a worker keeps one megabyte's, longer ones are made anew."""
    held = worker_cache("shingles")
    if base not in held:
        held[base] = _new_powers(base, 1 << 20)
    return held[base][:n] if n <= 1 << 20 else _new_powers(base, n)


def _new_powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def flat_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets): the sorted distinct shingle hashes of each text, one after the other.

    Words are hashed by differences of one running polynomial over all bytes (modulo 2^64, odd base), mixed, and
    combined per shingle.
    """
    base = 0xD1342543DE82EF95
    joined = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(base, len(joined)), dtype=np.uint64)])
    words = _mix((run[ends] - run[starts]) * _powers(pow(base, -1, 1 << 64), len(joined))[starts])
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, bounds)
    many = max(0, len(words) - n + 1)
    grams = np.zeros(many, dtype=np.uint64)
    for j in range(n):
        grams = grams * _ODD + words[j:many + j]
    grams = _mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a:b - n + 1])
            if len(s) > 1:
                new = s[1:] != s[:-1]
                s = s if new.all() else np.concatenate([s[:1], s[1:][new]])
            out.append(s)
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for w in words[a:b]:
                h = h * _ODD + w
            out.append(_mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int64)
    return np.concatenate([*out, np.zeros(0, dtype=np.uint64)]), offsets


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, at = flat_sets(texts, n)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def all_fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set, as rows."""
    out = np.zeros((len(at) - 1, 2), dtype=np.uint64)
    size = (at[1:] - at[:-1]).astype(np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        for k, x in enumerate((_mix(flat + _ODD), _mix(flat * _ODD + np.uint64(3)))):
            out[full, k] = np.add.reduceat(x, at[:-1][full])
    return _mix(out ^ size[:, None])


def _fingerprints(s: np.ndarray) -> np.ndarray:
    return all_fingerprints(s, np.array([0, len(s)]))[0]


def all_parities(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set, ``LONGS`` longs a row."""
    size, rows = 64 * LONGS, len(at) - 1
    of = np.repeat(np.arange(rows), at[1:] - at[:-1])
    odd = np.bincount(of * size + ((flat >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=rows * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(rows, LONGS)


def all_sketches(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A parity bitmap of each set with at least a bit a shingle: their number is a power of two, 64 or more."""
    size = at[1:] - at[:-1]
    bits = np.left_shift(np.int64(1), np.maximum(6, np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    bucket = (flat >> np.uint64(20)).astype(np.int64) & (np.repeat(bits, size) - 1)
    odd = np.bincount(np.repeat(begin, size) + bucket, minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:a + b] for a, b in zip((begin // 8).tolist(), (bits // 8).tolist())]


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded, which keeps the parities."""
    u, v = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    while len(v) > len(u):
        v = v[:len(v) // 2] ^ v[len(v) // 2:]
    return int(np.bitwise_count(u ^ v).sum())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _long(x):
    return np.asarray(x, dtype=np.uint64).view(np.int64)


# ---- index lists -------------------------------------------------------------------------------------------------

def class_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, b0.., sketch): size, 128-bit fingerprint and parity bitmaps of each document's set."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, texts in row_blocks(batch, 1 << 19):
                flat, at = flat_sets(texts)
                f, b = all_fingerprints(flat, at), all_parities(flat, at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(at[1:] - at[:-1]),
                     pa.array(_long(f[:, 0].copy())), pa.array(_long(f[:, 1].copy())), *[pa.array(b[:, k].copy()) for k in range(LONGS)],
                     pa.array(all_sketches(flat, at), type=pa.binary())],
                    names=["doc_id", "n", "f1", "f2", *BITS, "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{b} long" for b in BITS) + ", sketch binary")


def frequent_shingles(docs: DataFrame):
    """(sorted hashes, counts) of shingles that are frequent inside tasks, ``FREQUENT_MOST`` at most."""
    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def counted():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 2
            return pa.RecordBatch.from_arrays([pa.array(_long(values[often])), pa.array(counts[often])], names=["g", "c"])

        for batch in batches:
            for _, texts in row_blocks(batch, 1 << 19):
                held.append(flat_sets(texts)[0])
                size += len(held[-1])
                if size > 1_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = stored(docs.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT), "nj-frequent")
    top = counts.orderBy(F.desc("c"), "g").limit(FREQUENT_MOST).toPandas()  # a bounded number of rows
    g = top["g"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], top["c"].to_numpy(dtype=np.int64)[order]


def index_lists(docs: DataFrame, frequent) -> DataFrame:
    """(g, block, f, n, pos, c, cn, cpos): list entries of shingles that two classes or more share; c is the list's
    leader, its smallest class."""
    spark = docs.sparkSession
    hashes, counts = spark.sparkContext.broadcast(frequent[0]), spark.sparkContext.broadcast(frequent[1])

    def entries(batches):
        import pyarrow as pa

        often, many = hashes.value, counts.value
        seen = set()
        for batch in batches:
            for _, texts in row_blocks(batch, 1 << 19):
                cols = [[], [], [], []]
                flat, at_ = flat_sets(texts)
                prints = all_fingerprints(flat, at_)[:, 0].tolist()
                late_all, many_all = np.zeros(len(flat), dtype=bool), None
                if len(often):
                    at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                    late_all = often[at] == flat
                    many_all = many[at]
                for a, b, f in zip(at_[:-1].tolist(), at_[1:].tolist(), prints):
                    if a == b or f in seen:  # no set, or another copy in this task
                        continue
                    seen.add(f)
                    s, late = flat[a:b], late_all[a:b]
                    p = len(s) // 4 + 1
                    block = np.zeros(p, dtype=np.int32)
                    prefix = s[:p]
                    if late.any():
                        order = np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[:p]
                        prefix, late = s[order], late[order]
                        blocks = np.left_shift(1, np.ceil(np.log2(np.maximum(1, many_all[a:b][order] / BLOCK))).astype(np.int64))
                        # a list in several blocks is marked: no entry of it may go because it is alone in its block
                        split = np.where(blocks > 1, SPLIT, 0) + (np.uint64(f) % blocks.astype(np.uint64)).astype(np.int64)
                        block = np.where(late, split, 0).astype(np.int32)
                    cols[0].append(prefix)
                    cols[1].append(block)
                    cols[2].append(np.full(p, f, dtype=np.uint64))
                    cols[3].append((np.int64(len(s)) << 32) + np.arange(p, dtype=np.int64))
                if cols[0]:
                    g, b, f, np_ = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays([pa.array(_long(g)), pa.array(b), pa.array(_long(f)), pa.array(np_)], names=["g", "block", "f", "np"])

    def lists(batches):
        import pyarrow as pa

        names = ["g", "block", "f", "np"]
        kept = None

        def out(a):
            g, b, f, x = a
            if not len(g):
                return None
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])])
            fresh = new | np.concatenate([[True], f[1:] != f[:-1]])
            g, b, f, x, new = g[fresh], b[fresh], f[fresh], x[fresh], new[fresh]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            alone = new & np.concatenate([new[1:], [True]]) & (b < SPLIT)
            i = np.flatnonzero(~alone)
            c = lead[i]
            low = (1 << 32) - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (g[i], b[i], f[i], x[i] >> 32, x[i] & low, f[c], x[c] >> 32, x[c] & low)],
                names=["g", "block", "f", "n", "pos", "c", "cn", "cpos"])

        for batch in batches:
            a = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            if kept is not None:
                a = [np.concatenate(z) for z in zip(kept, a)]
            if not len(a[0]):
                continue
            # the last list may go on in the next batch
            cut = int(np.flatnonzero((a[0] != a[0][-1]) | (a[1] != a[1][-1]))[-1:].sum() + 1) if (a[0][0] != a[0][-1]) or (a[1][0] != a[1][-1]) else 0
            if cut and (r := out([v[:cut] for v in a])) is not None:
                yield r
            kept = [v[cut:] for v in a]
        if kept is not None and (r := out(kept)) is not None:
            yield r

    dealt = docs.mapInArrow(entries, "g long, block int, f long, np long").repartition("g", "block").sortWithinPartitions("g", "block", "f", "np")
    return dealt.mapInArrow(lists, "g long, block int, f long, n long, pos long, c long, cn long, cpos long")


def _room(n1, p1, n2, p2):
    """Sizes and positions of a common shingle leave room for a link, if it is the first common one."""
    ok_size = 4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)
    return ok_size & (7 * F.least(n1 - p1, n2 - p2) >= 3 * (n1 + n2))


# ---- verification ------------------------------------------------------------------------------------------------

def screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, z, dx, dz, most, near) of class pairs (x, z): a document of each class, the most shingles that they can have in
    common by their sketches, and whether that leaves room for a link."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            differ = np.array([sketches_differ(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column("sx"), batch.column("sz"))], dtype=np.int64)
            both = batch.column("nx").to_numpy() + batch.column("nz").to_numpy()
            most = (both - differ) // 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "z", "dx", "dz")), pa.array(most), pa.array(100 * most >= PERCENT * (both - most))],
                                             names=["x", "z", "dx", "dz", "most", "near"])

    side = lambda a: reps.select(F.col("f1").alias(a), F.col("rep").alias(f"d{a}"), F.col("n").alias(f"n{a}"), F.col("sketch").alias(f"s{a}"))
    # pairs, texts and lists all grow with the corpus: shuffle joins at every size
    p = pairs.join(side("x").hint("merge"), "x").join(side("z").hint("merge"), "z")
    return p.mapInArrow(run, "x long, z long, dx long, dz long, most long, near boolean")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, z, common, most, linked) of class pairs (x, z), from the whole texts of one document of each class. Of pairs
    that their sketches refute only bounds are known: 0 and ``most`` shingles in common."""
    spark = docs.sparkSession
    every = stored(screened(pairs, reps), "nj-pairs")
    p = every.where("near").select("x", "z", "dx", "dz")
    ids = p.select(F.col("dx").alias("d")).unionByName(p.select(F.col("dz").alias("d"))).distinct()
    # a bitmap of fixed size keeps most other texts out of the shuffle
    bit = F.pmod(F.xxhash64("d"), F.lit(FILTER_BITS))
    words = (ids.select(F.shiftright(bit, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(d), {FILTER_BITS}) & 31 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())  # FILTER_BITS / 32 rows at most
    bits = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).astype(np.uint32)
    flags = spark.sparkContext.broadcast(bits)

    def wanted(batches):
        import pyarrow as pa

        for batch in batches:
            h = batch.column("h").to_numpy()
            hit = (flags.value[h >> 5] >> (h & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["doc_id", "text"])

    hashed = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    # of rows that repeat a doc_id any one will do only if they are equal: the set's fingerprint decides
    texts = stored(hashed.mapInArrow(wanted, "doc_id long, text string"), "nj-texts")

    def counted(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ta", "tb"))
            # about 2 MB of text at a time
            cuts = np.unique(np.concatenate([[0], 1 + np.flatnonzero(np.diff(np.cumsum(size) >> 21)), [len(batch)]])).tolist()
            for k, end in zip(cuts, cuts[1:]):
                part = batch.slice(k, end - k)
                x, z = part.column("x").to_pylist(), part.column("z").to_pylist()
                texts = dict(zip(x, part.column("ta").cast(pa.large_binary()).to_pylist()))
                texts.update(zip(z, part.column("tb").cast(pa.large_binary()).to_pylist()))
                flat, at = flat_sets([t or b"" for t in texts.values()])
                sets = {f: flat[i:j] for f, i, j in zip(texts, at[:-1], at[1:])}
                right = {f for f, g in zip(texts, _long(all_fingerprints(flat, at)[:, 0]).tolist()) if f == g}
                a, b = [sets[f] for f in x], [sets[f] for f in z]
                same = [f in right and h in right for f, h in zip(x, z)]
                common = [_common(u, v) for u, v in zip(a, b)]
                linked = [100 * c >= PERCENT * (len(s) + len(t) - c) for s, t, c in zip(a, b, common)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), part.column("z"), pa.array(common, type=pa.int64()), pa.array(linked), pa.array(same)],
                    names=["x", "z", "common", "linked", "same"]).filter(pa.array(same)).select(["x", "z", "common", "linked"])

    left = p.join(texts.select(F.col("doc_id").alias("dx"), F.col("text").alias("ta")).hint("merge"), "dx")
    both = left.join(texts.select(F.col("doc_id").alias("dz"), F.col("text").alias("tb")).hint("merge"), "dz")
    exact = both.select("x", "z", "ta", "tb").mapInArrow(counted, "x long, z long, common long, linked boolean") \
        .select("x", "z", "common", F.col("common").alias("most"), "linked")
    far = every.where("not near").select("x", "z", F.lit(0).cast("long").alias("common"), "most", F.lit(False).alias("linked"))
    return stored(exact.unionByName(far).distinct(), "nj-verified")


# ---- the join ----------------------------------------------------------------------------------------------------

def _key():
    """The doc_id, or for a null one a number of its text beyond all ids (``NO_ID`` and more)."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61)))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: doc_id, n, f1, f2, rep; component of each linked class representative)."""
    docs = docs.select(_key().alias("doc_id"), "text")
    rows = stored(class_rows(docs), "nj-rows")
    classes = stored(rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), *[F.min(b).alias(b) for b in [*BITS, "sketch"]]), "nj-classes")
    lists = stored(index_lists(docs, frequent_shingles(docs)), "nj-lists")
    pair = lambda a, b: (F.least(a, b).alias("x"), F.greatest(a, b).alias("z"))
    known, comp = None, None
    for turn in range(STAR_ROUNDS):
        if turn == 0:
            star = lists.where((F.col("f") != F.col("c")) & _room(F.col("n"), F.col("pos"), F.col("cn"), F.col("cpos"))).select(*pair(F.col("f"), F.col("c")))
            # leaders of the blocks of one list
            heads = lists.where((F.col("f") == F.col("c"))).select("g", "f", "n", "pos")
            first = heads.groupBy("g").agg(F.min("f").alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1").select("g", "h")
            star = star.unionByName(heads.join(first, "g").where("f != h").select(*pair(F.col("f"), F.col("h"))))
        else:
            star = _more_stars(_mixed(lists.select("g", "block", "f", "n"), comp), turn).select(*pair(F.col("f"), F.col("h")))
        star = star.distinct()
        if known is not None:
            star = star.join(known.select("x", "z"), ["x", "z"], "left_anti")
        star = stored(star, "nj-star")
        if star.isEmpty():
            if turn == 0:  # no leader fits; members of the lists may still link with each other
                continue
            break
        found = verified(docs, star, classes)
        known = found if known is None else stored(known.unionByName(found), "nj-known")
        comp = stored(components(known.where("linked").select(F.col("x").alias("a"), F.col("z").alias("b"))), "nj-comp")
        if turn + 1 < STAR_ROUNDS and found.where("linked").isEmpty():
            break
    if known is None:
        if lists.isEmpty():
            return rows, None
        known = docs.sparkSession.createDataFrame([], "x long, z long, common long, most long, linked boolean")
    # what is left: pairs of a list in different components, bounded by positions and by what the leader tells
    mixed = _mixed(lists.select("g", "f", "n", "pos", "c"), comp)
    told = known.select("x", "z", "common", "most")
    told = told.unionByName(told.select(F.col("z").alias("x"), F.col("x").alias("z"), "common", "most"))
    mixed = mixed.join(told.select(F.col("x").alias("f"), F.col("z").alias("c"), F.col("common").alias("o"), F.col("most").alias("u")).hint("merge"), ["f", "c"], "left")
    mixed = mixed.join(classes.select(F.col("f1").alias("f"), F.col("n").alias("n_"), *BITS).hint("merge"), "f").where("n = n_")
    # the lists of a class just before this one: a pair that shares one of them is looked at there, where there is more room
    own = Window.partitionBy("f").orderBy("pos", "g")
    last = [f"q{k}" for k in range(1, BEFORE + 1)]
    mixed = mixed.withColumns({q: F.lag("g", k).over(own) for k, q in enumerate(last, 1)})
    mixed = stored(mixed.select("g", "f", "n", "pos", "c", "comp", *last, *BITS, *[F.when(F.col("f") == F.col("c"), F.col("n")).otherwise(F.col(o)).alias(o) for o in ("o", "u")]), "nj-mixed")
    s, t = mixed.alias("s"), mixed.alias("t")
    need = 3 * (F.col("s.n") + F.col("t.n"))
    bound = F.least(F.col("s.u") + F.col("t.n") - F.col("t.o"), F.col("t.u") + F.col("s.n") - F.col("s.o"))
    differ = sum((F.bit_count(F.col(f"s.{b}").bitwiseXOR(F.col(f"t.{b}"))) for b in BITS), F.lit(0))
    earlier = F.coalesce(reduce(or_, (F.col(f"s.{a}") == F.col(f"t.{b}") for a in last for b in last)), F.lit(False))
    rest = s.join(t, (F.col("s.g") == F.col("t.g")) & (F.col("s.f") < F.col("t.f")) & (F.col("s.comp") != F.col("t.comp"))
                  & _room(F.col("s.n"), F.col("s.pos"), F.col("t.n"), F.col("t.pos"))
                  & ~earlier
                  & (7 * differ <= F.col("s.n") + F.col("t.n"))
                  & ((F.col("s.c") != F.col("t.c")) | bound.isNull() | (7 * bound >= need))) \
        .select(F.col("s.f").alias("x"), F.col("t.f").alias("z")).distinct().join(known.select("x", "z"), ["x", "z"], "left_anti")
    rest = stored(rest, "nj-rest")
    if not rest.isEmpty():
        known = stored(known.unionByName(verified(docs, rest, classes)), "nj-known")
    # components of documents: classes by their smallest doc_id
    rep = classes.groupBy("f1").agg(F.min("rep").alias("r"))
    edges = known.where("linked").join(rep.select(F.col("f1").alias("x"), F.col("r").alias("a")), "x") \
        .join(rep.select(F.col("f1").alias("z"), F.col("r").alias("b")), "z").select("a", "b")
    return rows, stored(components(edges), "nj-components")


def _mixed(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Entries of lists whose classes lie in more than one component so far."""
    if comp is None:  # every class its own component
        t = lists.withColumn("comp", F.col("f"))
    else:
        c = comp.select(F.col("id").alias("f"), F.col("component").alias("comp"))
        t = stored(lists.join(c.hint("merge"), "f", "left").withColumn("comp", F.coalesce("comp", "f")), "nj-entries")
    g = t.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("g")
    return t.join(g, "g")


def _more_stars(mixed: DataFrame, turn: int) -> DataFrame:
    """(f, h) to compare next: in each block of a list, classes outside its largest component with ``HUBS`` members of
    that component, chosen by hash; a class does so in its ``HUB_LISTS`` longest lists."""
    key = ["g", "block"]
    big = (mixed.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("k"))
           .groupBy(*key).agg(F.max(F.struct("k", "comp")).alias("b"), F.sum("k").alias("total"), F.count(F.lit(1)).alias("kinds"))
           .where("kinds > 1").select(*key, F.col("b.comp").alias("big"), "total"))
    t = stored(mixed.join(big, key), "nj-stars")
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(turn), "f"), "f")
    hubs = (t.where("comp = big").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HUBS)
            .select(*key, F.col("f").alias("h"), F.col("n").alias("hn")))
    own = Window.partitionBy("f").orderBy(F.desc("total"), F.xxhash64(F.lit(turn), "g"), "g")
    out = t.where("comp != big").withColumn("r", F.row_number().over(own)).where(F.col("r") <= HUB_LISTS)
    return out.join(hubs, key).where(4 * F.least("n", "hn") >= 3 * F.greatest("n", "hn")).select("f", "h")


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, component, class_id) of every document; ids of ``NO_ID`` and more stand for null."""
    rows, comp = links(docs)
    own = stored(rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id")), "nj-own")
    t = rows.join(own, ["f1", "f2", "n"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    t = t.withColumn("component", F.col("class_id")) if comp is None else t.join(comp, F.col("class_id") == F.col("id"), "left") \
        .withColumn("component", F.coalesce("component", "class_id"))
    return t.select(F.col("doc_id").alias("key"), F.col("n").alias("n_shingles"), "component", "class_id")


def join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set)."""
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return keyed(docs).select(known("key").alias("doc_id"), "n_shingles", known("component").alias("component_id"), known("class_id").alias("class_id"))


query = join


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id, all columns."""
    keep = stored(keyed(docs).where("key = component").select("key").distinct(), "nj-keep")
    return docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key")).join(keep.hint("merge"), "key").select("row.*")
