"""SentencePiece merge rounds against the library."""

import hashlib
import random

import numpy as np
import pytest
from odd_rows import ROWS

from pdforge.llm import sentence_pieces as S


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def _texts(library):
    rng = random.Random(1)
    pool = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    out = ["", " ", "  a  b ", "▁x", "a\nb\x00c", "日本語\U0001F600", "<s> <0x41> </s>", "\n\n \n  \n", "x" * 9000 + "y",
           " " * 40 + "q" + " " * 17, " " * 2000, "=" * 700, "\t\tq", "ACGT" * 3000, "aaaa" * 100]
    out += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    out += ["".join(chr(rng.choice([32, 32, 9, 10, rng.randint(33, 126), rng.randint(160, 0x3000), rng.randint(0x4e00, 0x9fff),
                                    rng.randint(0x1f300, 0x1f900)])) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    return out + ["".join(rng.choice("abcdest ") for _ in range(rng.randint(0, 300))) for _ in range(600)]


def test_ids_equal_the_library(library):
    texts, encode = _texts(library), S.text_encoder()
    for k in range(0, len(texts), 300):
        part = texts[k:k + 300]
        got = [np.frombuffer(b, dtype="<i4").tolist() for b in encode([t.encode() for t in part])]
        assert got == [library.encode(t) for t in part]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_heap_takes_over(library, monkeypatch, rounds):
    monkeypatch.setattr(S, "ROUNDS", rounds)
    pieces = S.Pieces(S.model_path())
    for t in _texts(library)[::7]:
        if t:
            got = np.frombuffer(pieces.encode_words([(" " + t.replace("▁", " ")).encode()])[0], dtype="<i4").tolist()
            assert got == library.encode(t)


def test_decoding_of_any_ids(library):
    rng = random.Random(2)
    pieces = S._tables(S.model_path())["pieces"]
    lists = [[rng.randint(0, 31999) for _ in range(rng.randint(0, 12))] for _ in range(500)]
    lists += [[rng.randint(3, 258) for _ in range(6)] for _ in range(500)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert pieces.decode(np.array([i for x in lists for i in x]), bounds) == [library.decode(x) for x in lists]


def test_query_on_odd_rows(spark, odd, nothing, library):
    got = sorted(tuple(r) for r in S.query(odd.withColumn("ids", odd.name)).collect())
    want = []
    for doc, text, *_ in ROWS:
        ids = library.encode(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert S.query(nothing).collect() == []
    back = {r.doc_id: r.text for r in S.decode(S.encode(odd)).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}


def test_text_of_megabytes(spark, library):
    text = "lorem ipsum dolor sit amet " * 60_000 + "x" * 200_000 + " " * 3000
    r = S.query(spark.createDataFrame([(1, text), (None, "a b")], "doc_id long, text string")).where("doc_id = 1").first()
    ids = library.encode(text)
    assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
