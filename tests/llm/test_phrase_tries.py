"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import SF001

from pdforge.llm import phrase_tries as P


def _brute(rows, least, top, inside):
    n, f = Counter(), {}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                own.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if a >= least and " " in p}
        kept = []
        for p, a in cand.items():
            w = p.split(" ")
            if len(w) == 2 and any(100 * b >= inside * a for q, b in cand.items() if q.count(" ") == 2 and (q.startswith(p + " ") or q.endswith(" " + p))):
                continue
            s = []
            for k in range(1, len(w)):
                l, r = own[" ".join(w[:k])], own[" ".join(w[k:])]
                s.append((1000000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(s)
            kept.append((score, a, p, l, r))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, l, r, n[lang], score) for k, (score, a, p, l, r) in enumerate(kept[:top])]
    return sorted(out)


def _rows(seed=1, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "New", "york", "Ünder", "naïve", "日本", "x\x00y", "it's", "a-b"]
    weight = rng.dirichlet(np.ones(len(vocabulary)) * 0.5)
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ? ", "\x0b", "\x0c "]
    out = []
    for i in range(docs):
        text = "".join(str(rng.choice(vocabulary, p=weight)) + str(rng.choice(ends, p=[.6, .05, .05, .06, .06, .06, .06, .03, .03])) for _ in range(int(rng.integers(0, 80))))
        out.append((i, text, [None, "en", "und", "", "日"][int(rng.integers(0, 5))], 7))
    return out + [(1, None, "en", 1), (1, "", None, 1), (2, " .. ", "zz", 1), (3, out[0][1], out[0][2], 1), (3, out[0][1], out[0][2], 1),
                  (4, "same words again " * 2000, "long", 1)]


@pytest.mark.parametrize("shard,bits,held,mask,choice,top", [(1_000_000, 1 << 16, 4_000_000, 0xFFFFFFFF, 4, 30), (40, 64, 300, 7, 1, 8)])
def test_against_plain_counting(spark, monkeypatch, shard, bits, held, mask, choice, top):
    """The second case has several shards and rounds, a full bitmap and colliding hashes."""
    for name, value in (("SHARD", shard), ("FILTER_BITS", bits), ("HELD", held), ("WORDS", held), ("HASH_MASK", mask), ("CHOICE", choice)):
        monkeypatch.setattr(P, name, value)
    rows = _rows()
    got = P.query(spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase long").repartition(4), top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == _brute(rows, 10, top, 50) and len(found) > 20


def test_empty_and_rare(spark, nothing):
    assert P.query(nothing).collect() == []
    assert P.query(spark.createDataFrame([(1, "only once here", "en")], "doc_id long, text string, lang string")).collect() == []


def test_double_array_accepts_its_phrases_alone():
    rng = np.random.default_rng(5)
    for n, top in ((1, 5), (300, 10), (20_000, 3000), (30_000, 70_000)):
        sizes = rng.integers(1, 4, n)
        words = rng.integers(0, top, (n, 3)) ** 2 // top
        words[np.arange(3)[None, :] >= sizes[:, None]] = 0
        key = np.unique(np.concatenate([words, sizes[:, None]], axis=1), axis=0)
        words, sizes = key[:, :3], key[:, 3]
        base, check, state = P.double_array(words, sizes)
        assert len(np.unique(state)) == len(words)

        def walk(words, sizes):
            out = np.full(len(words), -1)
            rows, s = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
            for k in range(3):
                on, s = P.advance(base, check, s, words[rows, k])
                rows = rows[on]
                out[rows[sizes[rows] == k + 1]] = s[sizes[rows] == k + 1]
                s, rows = s[sizes[rows] > k + 1], rows[sizes[rows] > k + 1]
            return out

        assert (walk(words, sizes) == state).all()
        other = rng.integers(0, top + 5, (2000, 3))
        size = rng.integers(1, 4, 2000)
        other[np.arange(3)[None, :] >= size[:, None]] = 0
        held = {tuple(r): s for r, s in zip(np.concatenate([words, sizes[:, None]], axis=1).tolist(), state.tolist())}
        accept = set(state.tolist())
        got = walk(other, size)
        for row, z, s in zip(other.tolist(), size.tolist(), got.tolist()):
            assert held.get((*row, z), -1) == (s if s in accept else -1)


def test_against_sql(spark):
    from oracle_harness import compare, duck_connection

    from pdforge.llm.queries import QUERIES, SQL
    problems, _, _ = compare(spark, duck_connection(SF001), "op12", QUERIES["op12_phrase_tries"], SQL["op12_phrase_tries"], SF001)
    assert not problems
