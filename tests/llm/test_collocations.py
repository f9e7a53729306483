"""Phrase collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tenderlake.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, phrase string, f long, score string"


def plain(rows, least=30, longest=4, best=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower().decode()):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    p = (lang, *w[i:i + k])
                    f[p] = f.get(p, 0) + 1
    c = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[i:i + k]) for p, a in c.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1)
               if 100 * a >= 80 * f[(p[0], *p[i:i + k])]}
    by = {}
    for p, a in c.items():
        if p not in covered:
            s, k = min((2000000 * a // (f[p[:1 + k]] + f[(p[0], *p[1 + k:])]), k) for k in range(1, len(p) - 1))
            by.setdefault(p[0], []).append((-s, -a, " ".join(p[1:]).encode(), f[p[:1 + k]], f[(p[0], *p[1 + k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
                  for lang, got in by.items() for i, (s, a, p, x, y) in enumerate(sorted(got)[:best]))


def rows_of(got):
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["a", "B", "the", "of", "Ünder", "x-y", "É", "new", "york", "city", "0", " ", " "]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "; ", "!", "\r\n", "\x0b"]

    def one(n):
        return "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    out = [(rng.choice(["en", "de", None, "und"]), one(rng.randint(0, 60))) for _ in range(300)]
    copy = one(200)
    out += [("en", copy)] * 40 + [("de", "x " + copy)] * 3            # copies, in another language too
    out += [("en", None), (None, None), ("en", ""), ("en", " .,; \n"), ("fr", "one"), ("fr", "word " * 35)]
    out += [("es", "same " * 50_000), ("en", one(30_000))]            # very long, one of a single word
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i % 7, lang, t, "x", 1, "y") for i, (lang, t) in enumerate(texts)], SCHEMA)


def test_phrases(spark, texts):
    got = C.collocations(frame(spark, texts).repartition(5))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(texts)
    assert len(want) > 150 and rows_of(got) == want


def test_other_sizes(spark, texts, monkeypatch):
    monkeypatch.setattr(C, "RANKED_AT_ONCE", 50)
    for least, longest, best in ((2, 2, 10), (5, 6, 30), (40, 3, 2000)):
        assert rows_of(C.collocations(frame(spark, texts), least=least, longest=longest, best=best)) == plain(
            texts, least, longest, best)


def test_many_lots_and_buckets(spark, texts, monkeypatch):
    for name, value in (("LOT_CHARS", 20_000), ("BUCKET_CHARS", 10_000), ("HELD_CHARS", 5_000)):
        monkeypatch.setattr(C, name, value)
    assert rows_of(C.collocations(frame(spark, texts))) == plain(texts)


def test_hashes_that_fall_together(spark, texts, monkeypatch):
    # eight bits of each key: every bucket is full of other phrases, the counts are the same
    real = C._key
    monkeypatch.setattr(C, "_key", lambda h, b: real(h, b) & np.uint64(0xFFFFFFFF000000FF))
    few = texts[:120]
    assert rows_of(C.collocations(frame(spark, few), least=3)) == plain(few, 3)


def test_parse_is_prefix_free(texts):
    for longest in (2, 4):
        over = longest - 1
        for _, t in texts[:200]:
            chunks = [c.split(" ") for c in C.parse([t or ""], C._Codes(), longest, 8)]
            whole = [w for c in chunks for w in c[:-over]]
            tokens = [C.BREAK if x[0] in C.BREAKS else x for x in C.TOKENS.findall((t or "").encode().lower().decode())]
            assert whole == tokens
            assert all(a[-over:] == b[:over] for a, b in zip(chunks, chunks[1:]))
    a, b = (C.parse([t], C._Codes(), 4, 8) for t in ("p q " + texts[-1][1], "r . " + texts[-1][1]))
    assert len(set(a) & set(b)) >= len(set(a)) - 2                    # a shared passage has the same chunks


def test_no_rows(spark, texts):
    assert C.collocations(frame(spark, []).limit(0)).collect() == []
    assert C.collocations(frame(spark, [("en", None), (None, "")])).collect() == []
    with pytest.raises(ValueError):
        C.collocations(frame(spark, texts), least=1)
