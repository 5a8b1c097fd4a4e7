"""Fuzzy short-notice search for licence phrases.

A phrase that may differ by k edits is cut into k + 1 pieces: by the pigeonhole principle any occurrence with at
most k edits holds one piece unchanged. One Aho-Corasick automaton over all pieces locates candidates in the text
reduced to its words; around each, exact places are read off, and the regex library's bounded-error matching
(``{e<=k}``, the next match, improved) verifies the rest at word borders and reports span and edits. A short word that alone tells a phrase from another
label's ("mit license", "bsd license") must begin a matched word: "mitt license" may pass for a slip, "bad license"
and "emit license" name no licence.

Defined results: null text counts as empty (0 words, no spans); places are counted as often as they occur; rows are
independent, so repeated rows repeat their result and an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdforge.llm.common import row_blocks, worker_cache

#: Phrases and their labels; the first four are the base list.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "eclipse public license": "epl",
}
#: One edit for so many characters of a phrase.
CHARS_PER_EDIT = 8
SPANS = ("doc_id long, n_words long, spans array<struct<label string, phrase string, base boolean, "
         "first_word long, end_word long, edits int, similarity double, matched string>>")


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into edits + 1 pieces: (offset, piece)."""
    at = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(at, at[1:])]


def telling_words(phrases: list[tuple[str, str]], longest: int = 3) -> list[set[str]]:
    """Per (phrase, label): its words of at most ``longest`` letters that alone tell it from another label's phrase."""
    out = []
    for p, label in phrases:
        words, telling = p.split(" "), set()
        for q, other in phrases:
            theirs = q.split(" ")
            if other != label and len(theirs) == len(words):
                differ = [w for w, t in zip(words, theirs) if w != t]
                if len(differ) == 1 and len(differ[0]) <= longest:
                    telling.add(differ[0])
        out.append(telling)
    return out


def phrase_scanner(base: dict[str, str], notices: dict[str, str], chars_per_edit: int):
    """A function from a text reduced to words (single spaces between them) to its spans."""
    import ahocorasick
    import regex

    phrases = [(p, label, True) for p, label in base.items()] + [(p, label, False) for p, label in notices.items()]
    budget = [len(p) // chars_per_edit for p, _, _ in phrases]
    fuzzy = [regex.compile(rf"(?e)(?<!\S)(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}(?!\S)") if k else None
             for (p, _, _), k in zip(phrases, budget)]
    telling = telling_words([(p, label) for p, label, _ in phrases])
    found: dict[str, list[tuple[int, int]]] = {}
    for i, ((p, _, _), k) in enumerate(zip(phrases, budget)):
        for at, piece in seeds(p, k):
            found.setdefault(piece, []).append((i, at + len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, where)
    automaton.make_automaton()

    def word_border(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")

    def altered(i: int, part: str):
        """Matches of phrase i with edits, its telling words standing whole; a refused one hides none behind it."""
        m = fuzzy[i].search(part)
        while m:
            words = m.group().split(" ")
            if all(any(w.startswith(t) for w in words) for t in telling[i]):
                yield m
                at = m.end()
            else:
                at = part.find(" ", m.start()) + 1 or len(part)
            m = fuzzy[i].search(part, at)

    def scan(text: str):
        windows: dict[int, list[list[int]]] = {}
        for end, where in automaton.iter(text):
            for i, upto in where:
                k = budget[i]
                a, b = max(0, end + 1 - upto - k), min(len(text), end + 1 - upto + len(phrases[i][0]) + k)
                spans = windows.setdefault(i, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                    spans[-1][0] = min(a, spans[-1][0])
                else:
                    spans.append([a, b])
                while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                    a, b = spans.pop()
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
        out = []
        for i, spans in windows.items():
            p, label, is_base = phrases[i]
            done, counted, words = -1, 0, 0
            for a, b in spans:
                a = max(text.rfind(" ", 0, a + 1) + 1 if a else 0, done + 1)
                b = text.find(" ", b)
                b = len(text) if b < 0 else b
                done = max(done, b)
                exact, gaps, at = [], [], a
                x = text.find(p, a, b)
                while x >= 0:
                    if word_border(text, x, x + len(p)):
                        exact.append((x, x + len(p), 0))
                        gaps.append((at, x))
                        at = x + len(p)
                    x = text.find(p, x + 1, b)
                gaps.append((at, b))
                if fuzzy[i] is not None:
                    for lo, hi in gaps:
                        lo += text[lo:lo + 1] == " "  # a gap begins and ends with a whole word
                        hi -= text[hi - 1:hi] == " "
                        if hi - lo >= len(p) - budget[i]:
                            for m in altered(i, text[lo:hi]):
                                if word_border(text, lo + m.start(), lo + m.end()):
                                    exact.append((lo + m.start(), lo + m.end(), sum(m.fuzzy_counts)))
                for x, y, e in sorted(exact):
                    words, counted = words + text.count(" ", counted, x), x
                    out.append({"label": label, "phrase": p, "base": is_base and e == 0, "first_word": words,
                                "end_word": words + 1 + text.count(" ", x, y), "edits": e,
                                "similarity": 1.0 - e / len(p), "matched": text[x:y]})
        out.sort(key=lambda s: (s["first_word"], s["end_word"], s["phrase"]))
        return out

    return scan


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per document: doc_id, n_words and the spans found (word positions from 0)."""
    base = BASE if base is None else base
    notices = NOTICES if notices is None else notices

    def run(batches):
        import pyarrow as pa

        home = worker_cache("licences")
        key = (tuple(base.items()), tuple(notices.items()), chars_per_edit)
        if key not in home:
            home[key] = phrase_scanner(base, notices, chars_per_edit)
        find = home[key]
        words = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F
                      else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
        span = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()),
                                   ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()),
                                   ("similarity", pa.float64()), ("matched", pa.string())]))
        for batch in batches:
            for rows, texts in row_blocks(batch):
                split = [t.translate(words).split(b" ") for t in texts]
                split = [[w for w in s if w] for s in split]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array([len(s) for s in split], type=pa.int64()),
                    pa.array([find(b" ".join(s).decode()) for s in split], type=span)],
                    names=["doc_id", "n_words", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def query(docs: DataFrame) -> DataFrame:
    t = scan(docs).withColumn("_base", F.filter("spans", lambda s: s["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform("_base", lambda s: s["first_word"])
    return t.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"))
