"""Short words that tell licences apart stand whole."""

import time

from pdforge.llm import license_scan as L


def _labels(text):
    return [(s["label"], s["first_word"], s["edits"]) for s in L.phrase_scanner(L.BASE, L.NOTICES, L.CHARS_PER_EDIT)(text)]


def test_telling_words():
    phrases = list((L.BASE | L.NOTICES).items())
    told = dict(zip([p for p, _ in phrases], L.telling_words(phrases)))
    assert told["mit license"] == {"mit"} and told["bsd license"] == {"bsd"}
    assert told["apache license"] == told["gnu general public license"] == set()


def test_a_telling_word_stands_whole():
    for text in ("see it license terms", "bad license", "usd license", "bud license", "emit license", "a mt license"):
        assert _labels(text) == []
    assert _labels("mit licence and bsd licens") == [("mit", 0, 1), ("bsd", 3, 1)]
    assert _labels("it license mit licens bad license bsd license") == [("mit", 2, 1), ("bsd", 6, 0)]
    assert _labels("apachee license") == [("apache", 0, 1)]


def test_words_are_counted_once_over_a_long_dense_text():
    text = " ".join(["mit license x mit licence"] * 20_000)
    start = time.time()
    got = _labels(text)
    assert got == [("mit", w, int(w % 5 == 3)) for i in range(20_000) for w in (5 * i, 5 * i + 3)]
    assert time.time() - start < 60
