"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The file of the model gives pieces, scores and types only; merging happens here. A block's distinct words (a run of
spaces and what follows it) become one flat array of symbols, cut wherever no piece holds the two neighbouring
characters, so no merge can cross a cut. In each round every segment finds the smallest rank among its pairs by one
segmented minimum and merges all places of it at once, leftmost first and without overlap; where a fresh pair would rank
no later than the merged one, only the leftmost place of that segment is merged, as one-at-a-time merging might turn
aside there. Arrays are compacted after each round and segments without a pair leave, until none is left. Segments that
need more than ``ROUNDS`` (long runs of blanks, whose pieces tie in rank) end by the same rule with a heap.
Characters without a piece become byte pieces. Decoding gathers the pieces' bytes from one flat table.

A worker remembers words in two generations bounded in bytes; texts are whole, blocks hold about 1 MB of text.

Defined results: null and empty texts have no ids and decode to the empty text; U+2581 and blanks are the same, as in
the library; rows that repeat give the same row again; an empty table gives an empty table; of other columns, whatever
their names, only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.llm.common import row_blocks, worker_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
ROUNDS = 512
#: A generation of the memo ends at so many bytes (words and ids); the one before is kept for look-ups.
MEMO_BYTES = 48 << 20
_FAR = np.int64(1) << 40


def model_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    return path


class Pieces:
    """Tables of a BPE model with byte pieces and the identity normaliser (dummy prefix, blanks kept)."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        if m.normalize("ﬁ  a ") != f"{SPACE}ﬁ{SPACE}{SPACE}a{SPACE}" or any(m.is_unused(i) for i in range(n)):
            raise ValueError("only models with the identity normaliser, a dummy prefix and no unused piece")
        text = [m.id_to_piece(i) for i in range(n)]
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if not all(m.is_byte(int(i)) for i in self.byte):
            raise ValueError("only models with byte pieces")
        plain = {p: i for i, p in enumerate(text) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        # rank 0 merges first; equal scores share a rank
        scores = np.unique([-m.get_score(i) for i in plain.values()], return_inverse=True)[1]
        rank = dict(zip(plain, scores.tolist()))
        # characters: their own piece, or a number past all pieces where only longer pieces hold them
        letters = {c for p in plain for c in p}
        self.symbols = dict(plain)
        for c in sorted(letters - plain.keys()):
            self.symbols[c] = len(text) + len(self.symbols) - len(plain)
        self.borrowed = {i: c for c, i in self.symbols.items() if c not in plain}
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for c in letters:
            self.char[ord(c)] = self.symbols[c]
        pairs = {(self.symbols[p[:k]], self.symbols[p[k:]]): p for p in plain for k in range(1, len(p))
                 if p[:k] in self.symbols and p[k:] in self.symbols}
        keys = np.array([a << 24 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([rank[p] for p in pairs.values()], dtype=np.int64)[order]
        self.merged = np.array([plain[p] for p in pairs.values()], dtype=np.int64)[order]
        self.inside = np.unique(np.array([ord(a) << 24 | ord(b) for p in plain for a, b in zip(p, p[1:])], dtype=np.int64))
        # decoding
        shown = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i)
                 else p.replace(SPACE, " ").encode() for i, p in enumerate(text)]
        self.length = np.array([len(b) for b in shown], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(shown) + b"\0", dtype=np.uint8)
        self.leads = np.array([p.startswith(SPACE) for p in text])
        self.spaced_only = b"\n"[0] not in {b for p in plain if len(p) > 1 for b in p.encode()}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; a far rank where they don't merge."""
        key = np.where((left >= 0) & (right >= 0), left << 24 | right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _FAR), self.merged[at]

    # ---- encoding ----------------------------------------------------------------------------------------------

    def merge(self, text: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, first character of each) once no pair of a segment merges; -1 - c stands for a character c
        without a piece. Nothing merges across the characters ``cuts``."""
        c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        if not len(c):
            return c, c
        sym = self.char[c].astype(np.int64)
        sym = np.where(sym < 0, -1 - c, sym)
        key = c[:-1] << 24 | c[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        first = np.concatenate([[True], self.inside[at] != key])
        first[cuts[cuts < len(c)]] = True
        pos = np.arange(len(c))
        rank = np.full(len(c), _FAR)
        if len(c) > 1:
            rank[:-1] = np.where(first[1:], _FAR, self.pair(sym[:-1], sym[1:])[0])
        done = []
        for turn in range(ROUNDS + 1):
            begins = np.flatnonzero(first)
            sizes = np.diff(np.append(begins, len(sym)))
            low = np.minimum.reduceat(rank, begins)
            over = low == _FAR
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((sym[gone], pos[gone]))
                sym, pos, rank, first = sym[~gone], pos[~gone], rank[~gone], first[~gone]
                begins = np.flatnonzero(first)
                sizes, low = sizes[~over], low[~over]
            if not len(sym) or turn == ROUNDS:
                break
            best = np.repeat(low, sizes)
            hit = rank == best
            # places at even distance from the start of a run of neighbouring ones
            index = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
            take = np.flatnonzero(hit & ((index - run) % 2 == 0))
            new = self.pair(sym[take], sym[take + 1])[1]
            segment = np.cumsum(first) - 1
            # neighbours as one-at-a-time merging from the left would meet them
            has_left = ~first[take]
            left = sym[np.maximum(take - 1, 0)]
            after_merge = np.concatenate([[False], take[1:] - take[:-1] == 2])
            left = np.where(after_merge, np.concatenate([[0], new[:-1]]), left)
            after = np.minimum(take + 2, len(sym) - 1)
            has_right = (take + 2 < len(sym)) & ~first[after]
            early = (has_left & (self.pair(left, new)[0] <= low[segment[take]])) \
                | (has_right & (self.pair(new, sym[after])[0] <= low[segment[take]]))
            if early.any():
                turned = np.zeros(len(begins), dtype=bool)
                turned[segment[take[early]]] = True
                leftmost = np.concatenate([[True], segment[take[1:]] != segment[take[:-1]]])
                stay = leftmost | ~turned[segment[take]]
                take, new = take[stay], new[stay]
            sym = sym.copy() if turn == 0 else sym
            sym[take] = new
            keep = np.ones(len(sym), dtype=bool)
            keep[take + 1] = False
            moved = np.cumsum(keep) - 1
            fresh = moved[take]
            sym, pos, rank, first = sym[keep], pos[keep], rank[keep], first[keep]
            again = np.unique(np.concatenate([fresh, fresh[~first[fresh]] - 1]))
            right = np.minimum(again + 1, len(sym) - 1)
            ends = (again + 1 >= len(sym)) | first[right]
            rank[again] = np.where(ends, _FAR, self.pair(sym[again], sym[right])[0])
        bounds = np.append(np.flatnonzero(first), len(sym))
        for a, b in zip(bounds[:-1], bounds[1:]):
            kept = self._by_heap(sym[a:b])
            done.append((kept[0], pos[a:b][kept[1]]))
        sym, pos = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(pos, kind="stable")
        return sym[order], pos[order]

    def _by_heap(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long segment: the pair of smallest rank, then leftmost, until none is left."""
        import heapq

        known = {}

        def lookup(a, b):
            if (a, b) not in known:
                r, m = self.pair(np.array([a]), np.array([b]))
                known[a, b] = (int(r[0]), int(m[0]))
            return known[a, b]

        s, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := lookup(s[i], s[i + 1])[0]) < _FAR]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], alive[j], after[i] = lookup(a, b)[1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := lookup(s[k], s[after[k]])[0]) < _FAR:
                    heapq.heappush(heap, (r, k, s[k], s[after[k]]))
        keep = np.flatnonzero(alive)
        return np.array(s, dtype=np.int64)[keep], keep

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32 bits) of each word; blanks stand for U+2581."""
        texts = [w.decode().replace(" ", SPACE) for w in words]
        bounds = np.cumsum([len(t) for t in texts])
        sym, pos = self.merge("".join(texts), bounds)
        strange = (sym < 0) | (sym >= len(self.length))
        if strange.any():
            parts = [list(chr(-1 - s if s < 0 else ord(self.borrowed[s])).encode()) for s in sym[strange].tolist()]
            sizes = np.ones(len(sym), dtype=np.int64)
            sizes[strange] = [len(p) for p in parts]
            out = np.repeat(sym, sizes)
            out[np.repeat(strange, sizes)] = self.byte[[b for p in parts for b in p]]
            sym, pos = out, np.repeat(pos, sizes)
        ends = np.searchsorted(pos, bounds).tolist()
        raw = sym.astype("<i4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    # ---- decoding ----------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of id lists, list k being ids[bounds[k]:bounds[k + 1]]."""
        size = self.length[ids].copy()
        lead = bounds[:-1][bounds[:-1] < bounds[1:]]
        skip = np.zeros(len(ids), dtype=np.int64)
        skip[lead] = self.leads[ids[lead]]
        size -= skip
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] + skip - (ends - size), size)
        raw = self.bytes[at].tobytes()
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [raw[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:])]


def _tables(path: str) -> dict:
    import codecs

    codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))
    home = worker_cache("pieces")
    if path not in home:
        home[path] = {"pieces": Pieces(path), "memo": {}, "old": {}, "bytes": 0}
    return home[path]


def text_encoder(path: str | None = None):
    """A function from texts (UTF-8 bytes) to their ids as little-endian 32-bit integers."""
    import re
    from itertools import chain

    state = _tables(model_path(path))
    pieces = state["pieces"]
    words = re.compile(rb" *[^ \n]+| +|\n+" if pieces.spaced_only else rb" *[^ ]+| +").findall

    def encode(texts: list[bytes]) -> list[bytes]:
        if state["bytes"] > MEMO_BYTES:
            state["old"], state["memo"], state["bytes"] = state["memo"], {}, 0
        memo, old = state["memo"], state["old"]
        runs = [words(b" " + t.replace(b"\xe2\x96\x81", b" ")) if t else [] for t in texts]
        flat = list(chain.from_iterable(runs))
        need = set(flat).difference(memo)
        if need:
            memo.update((w, old[w]) for w in need if w in old)
            new = [w for w in need if w not in memo]
            memo.update(zip(new, pieces.encode_words(new)))
            state["bytes"] += sum(len(w) + len(memo[w]) + 160 for w in need)
        out, begin = [], 0
        ids = list(map(memo.__getitem__, flat))
        for r in runs:
            out.append(b"".join(ids[begin:begin + len(r)]))
            begin += len(r)
        return out

    return encode


def _lists(raw: list[bytes]):
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
    ids = np.frombuffer(b"".join(raw), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), ids, bounds


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every text."""
    def run(batches):
        import pyarrow as pa

        encoder = text_encoder(path)
        for batch in batches:
            for rows, texts in row_blocks(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _lists(encoder(texts))[0]], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null lists decode to the empty text."""
    def run(batches):
        import pyarrow as pa

        pieces = _tables(model_path(path))["pieces"]
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                lists = [np.asarray(x if x is not None else [], dtype="<i4") for x in part.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                texts = pieces.decode(np.concatenate(lists), bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): encoding and decoding in one pass over the texts."""
    def run(batches):
        import pyarrow as pa

        encoder = text_encoder(path)
        pieces = _tables(model_path(path))["pieces"]
        for batch in batches:
            for rows, texts in row_blocks(batch):
                lists, ids, bounds = _lists(encoder(texts))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(pieces.decode(ids, bounds), type=pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                   F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
                                   F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
