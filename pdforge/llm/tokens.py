"""Token ids by a public tokenizer file, encoded word by word with a worker-wide memo.

The tokenizer drops white space and never joins characters across it (its normaliser and its word
pattern are both local to a run without white space), so encoding each run of non-white-space on its own
gives the ids of the whole text. Runs repeat: each distinct run is encoded about once per worker. Runs of lower-case
Latin letters, which the normaliser and the word pattern leave as they are, go to the library's BPE model with a
white-space splitter instead of both.
"""

from __future__ import annotations

from pdforge.llm.common import worker_cache

#: File name among the public tokenizers, and the id that ends each document.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Marks whose run after a letter is a piece of its own for the tokenizer: none of them is part of a contraction ('s) or
#: of a special token (<|endoftext|>).
MARKS = b".,;:!?*$&%#\"()[]{}-+=/"
#: Bytes of text that are encoded together: a block's distinct runs are looked up once.
BLOCK_BYTES = 2 << 20
#: A generation of the memo ends at so many runs or bytes of text in it; the one before is kept for look-ups.
MEMO_WORDS, MEMO_BYTES = 400_000, 16 << 20


def tokenizer_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    return path


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def text_encoder(path: str | None = None, end_id: int = END_ID):
    """A function from texts (UTF-8 bytes) to their ids as little-endian unsigned 32-bit integers,
    the end id included."""
    import os
    import unicodedata

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    home = worker_cache("tokens")
    path = tokenizer_path(path)
    if path not in home:
        tok = Tokenizer.from_file(path)
        letters = Tokenizer(tok.model)
        letters.pre_tokenizer = WhitespaceSplit()
        vocabulary = tok.get_vocab()
        closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            closing[i] = piece.endswith("</w>")
        home[path] = {"tok": tok, "letters": letters, "closing": closing, "memo": {}, "old": {}, "bytes": 0}
    state = home[path]
    tok, letters, closing = state["tok"], state["letters"], state["closing"]
    end, table = np.array([end_id], dtype="<u4").tobytes(), byte_letters()

    def core(w: bytes) -> tuple[bytes, bytes, bool]:
        """A run without the marks that follow its last letter, and in lower case if its letters are Latin and
        composed: the tokenizer cuts there and lowers anyway, so fewer distinct runs need encoding. Last, whether the
        rest is nothing but such letters."""
        head = w.rstrip(MARKS)
        letter = head[-1:].isalpha()  # ASCII
        if head.isascii():
            if not letter:
                return (w if b"<|" in w else w.lower()), b"", False
            return (head if b"<|" in head else head.lower()), w[len(head):], head.isalpha()
        s = head.decode()
        if s.isalpha() and max(s) < "\u0250" and unicodedata.is_normalized("NFC", s):
            low = s.lower()
            return low.encode(), w[len(head):], low.isalpha() and max(low) < "\u0250" and unicodedata.is_normalized("NFC", low)
        return (head, w[len(head):], False) if letter else (w, b"", False)

    def fill(memo: dict, simple: list[bytes], words: list[bytes]) -> None:
        """Encodes runs of lower-case composed Latin letters (``simple``) and others (``words``) into the memo."""
        if simple:
            # the last token of each word carries the word end
            joined = b" ".join(simple).decode("latin-1").translate({b: c for b, c in table.items() if b != 32})
            ids = np.array(letters.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(closing[ids]) + 1).tolist()
            if len(ends) == len(simple):
                raw = ids.tobytes()
                for w, a, b in zip(simple, [0, *ends], ends):
                    memo[w] = raw[4 * a:4 * b]
            else:
                words = [*words, *simple]
        for w, e in zip(words, tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            memo[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(texts: list[bytes]) -> list[bytes]:
        if len(state["memo"]) > MEMO_WORDS or state["bytes"] > MEMO_BYTES:
            state["old"], state["memo"], state["bytes"] = state["memo"], {}, 0
        memo, old = state["memo"], state["old"]
        # Arrow splits and numbers the runs; only a block's distinct ones become Python objects (and an empty one, where
        # white space begins or ends a text, or nothing else is in it)
        runs = pc.ascii_split_whitespace(pa.array(texts, type=pa.large_binary()).view(pa.large_string()))
        last = runs.offsets.to_numpy().astype(np.int64)
        numbered = runs.flatten().dictionary_encode()
        own = numbered.dictionary.view(pa.large_binary()).to_pylist()
        del runs
        memo[b""] = b""
        found = list(map(memo.get, own))
        new = []
        for k, ids in enumerate(found):
            if ids is None:
                w = own[k]
                ids = old.get(w)
                if ids is None:
                    new.append(k)
                    continue
                memo[w] = found[k] = ids
                state["bytes"] += len(w)
        if new:
            simple, others, cores = set(), set(), []
            for k in new:
                w = own[k]
                state["bytes"] += len(w)
                if w.isalpha() and w.islower():  # ASCII letters alone
                    simple.add(w)
                else:
                    c, tail, plain = core(w)
                    cores.append((w, c, tail))
                    if c not in memo:
                        (simple if plain else others).add(c)
                    if tail and tail not in memo:
                        others.add(tail)
            for held in (simple, others):
                known = [w for w in held if w in old]
                memo.update((w, old[w]) for w in known)
                held.difference_update(known)
            fill(memo, list(simple), list(others))
            for w, c, tail in cores:
                memo[w] = memo[c] + memo[tail] if tail else memo[c]
            for k in new:
                found[k] = memo[own[k]]
        # every run's ids one after the other, the end id after each text's last run
        at = np.insert(numbered.indices.to_numpy().astype(np.int64), last[1:], len(found))
        ids = pa.array([*found, end], type=pa.large_binary()).take(pa.array(at))
        cuts = np.frombuffer(ids.buffers()[1], dtype=np.int64)[last + np.arange(len(last))].tolist() if len(at) else [0]
        raw = memoryview(ids.buffers()[2]) if cuts[-1] else b""
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    return encode
