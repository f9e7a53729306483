"""Where the training-data operators once did less than the whole job."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as C
from tenderlake.llm import jaccard_join as J
from tenderlake.llm import sentencepiece_bpe as P
from tenderlake.llm import substring_dedup as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------- Jaccard join

def _kept(rows, width, percent):
    """Smallest id of each group that links of all pairs connect."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t)
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))})
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [x if r == y else r for r in root]
    return sorted(min(d for (d, _), r in zip(rows, root) if r == k) for k in set(root))


def _edited(seed, sizes, each):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for size in sizes:
        base = [word() for _ in range(size)]
        for _ in range(each):
            w = list(base)
            if rng.random() < 0.5:
                w += [word() for _ in range(rng.randint(0, size * 3 // 10))]
            else:
                at, n = rng.randrange(size), rng.randint(0, max(1, size // 7))
                w[at:at + n] = [word() for _ in range(n)]
            rows.append((len(rows), " ".join(w)))
    return rows


def test_pipeline_stage_drops_copies_of_five_words_at_0_8(spark):
    rows = _edited(1, (5, 8, 9, 12, 15, 20, 40, 100, 300, 1000), 8)
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n int")
    got = sorted(r.doc_id for r in C.drop_near_copies(spark, docs, "").collect())
    assert got == _kept(rows, 5, 80)
    assert got != _kept(rows, 3, 90)


@pytest.mark.parametrize("width,percent,long_,grams", [(5, 80, 3, 600), (2, 67, 3, 600), (1, 75, J.LONG, 600), (4, 99, 3, 600)])
def test_widths_and_thresholds(spark, monkeypatch, width, percent, long_, grams):
    monkeypatch.setattr(J, "LONG", long_)
    rows = _edited(2, (2, 3, 4, 5, 6, 9, 13, 30, 90, 200), 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.classes(df, block_grams=grams, width=width, percent=percent)
    assert sorted({r.component_id for r in got.collect()}) == _kept(rows, width, percent)


def test_linked_sets_share_enough_segments():
    rng = np.random.default_rng(3)
    for percent in (67, 75, 80, 90, 99):
        for _ in range(300):
            n = int(rng.integers(2, 400))
            x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            lost, more = rng.integers(0, n // 3 + 1, 2)
            y = np.unique(np.append(x[lost:], rng.integers(0, 1 << 62, more).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            b = J.segments(y, percent)
            shared = [(s, len(np.intersect1d(k, m))) for s, k in J.segments(x, percent) for t, m in b if s == t and len(k) == len(m)]
            assert any(k > s for s, k in shared)


def test_other_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        J.classes(spark.createDataFrame([], "doc_id long, text string"), percent=60)


def test_a_large_family_without_links_stays_in_bounded_blocks(spark, monkeypatch):
    rng = random.Random(4)
    template = [f"t{i}" for i in range(300)]
    rows = [(n, " ".join(template + [f"o{n}x{i}" for i in range(28)])) for n in range(120)]     # 84% alike
    rows += [(n + 120, t + f" e{rng.randrange(9)}") for n, t in rows[:12]]                       # near copies of some
    most, blocks = 6 * 326, []
    search = J._search

    def seen(b, *args):
        blocks.append([r["count"] for r in b.groupBy("block").count().collect()])
        return search(b, *args)

    monkeypatch.setattr(J, "_search", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.classes(df, block_grams=most)
    assert sorted({r.component_id for r in got.collect()}) == _kept(rows, 3, 90) == list(range(120))
    # on average six sets a part; parts are dealt by hash
    assert len(blocks) == 2 and len(blocks[0]) > 10 and max(blocks[1]) <= 5 * 6


# ------------------------------------------------------------ SentencePiece

def test_each_occurrence_is_skipped_in_by_itself():
    p, plain, n = P.Pieces(), P.Pieces(P.MODEL_FILE, 0.0), 20_000
    for word in ("the", "of", "interesting", "government"):
        path = []
        whole = plain._merged_short(["▁" + word], None, path)[0]
        got = [bytes(g) for g in p.encode([word] * n, list(range(n)))]                 # over documents
        first = p._skipped(p._occurrences(n, 7) + path[0][1][0])
        assert abs(first.mean() - P.DROPOUT) < 0.015                                     # the first merge
        # and over places of one text: the share without any skip
        at = np.full(n, p.known[" " + word])
        p._follow(at, p._occurrences(n, 7))
        long_ = np.flatnonzero(at != p.known[" " + word])
        want = 1 - (1 - P.DROPOUT) ** sum(len(r) for r, _ in path)
        assert abs(len(long_) / n - want) < 0.02
        differ = sum(g != whole for g in got) / n
        assert 0 < differ <= want + 0.02 and differ >= 0.05
    assert len(set(got)) > 4


def test_remembered_or_not_it_is_the_agenda_of_the_occurrence():
    p = P.Pieces()
    text = " ".join(["interesting words", "xyzzyx", "▁", "a" * 50, "n\0l", "漢字 é"] * 30)
    units = P.UNITS.findall(" " + text)
    want = b"".join(p.blank if u == P.BLANK else p._ids(p._merged_long(u.replace(" ", P.BLANK), int(o)))
                    for u, o in zip(units, p._occurrences(len(units), 5)))
    assert p.encode([text, ""], [5, 6]) == [want, b""] == p.encode([text, ""], [5, 6])
    assert p.decode(np.frombuffer(want, "<i4").tolist()) == text


def test_outcomes_that_one_occurrence_needs_are_its_agenda():
    p = P.Pieces(P.MODEL_FILE, 0.5)          # many skips, few occurrences: most outcomes are of one occurrence
    words = ["interesting", "government", "the", "internationalisation", "zq"]
    texts = [" ".join(words[(i + j) % 5] for j in range(7)) for i in range(40)]
    for t, k, got in zip(texts, range(40), p.encode(texts, list(range(40)))):
        units = P.UNITS.findall(" " + t)
        assert got == b"".join(p._ids(p._merged_long(u.replace(" ", P.BLANK), int(o)))
                               for u, o in zip(units, p._occurrences(len(units), k)))


# --------------------------------------------------- substring deduplication

def _with_line(n):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = [f"licence{i}" for i in range(12)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(60)]
        at = rng.randrange(60)
        w[at:at] = line if i % 3 else line + passage[rng.randrange(9):]
        rows.append((i, " ".join(w)))
    return rows + [(n, " ".join(line * 4)), (n + 1, " ".join(line * 5))]


def test_a_common_line_spreads_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(D, "FREQUENT", 40)
    rows = _with_line(300)
    docs = spark.createDataFrame([(d, d, t) for d, t in rows], "doc_id long, key long, text string")
    common = D.frequent(docs, sum(len(t) for _, t in rows), 13)
    assert len(common) >= 10
    strings = lambda *hot: sorted(len(D._unpack(blob)[1]["seg_doc"])
                                  for _, blob in D._batch([(d, d, t) for d, t in rows], 100_003, 13, *hot))
    # a bucket a minimiser: with the line's grams as minimisers one holds every document
    assert strings()[-1] >= 250 and strings(common)[-1] <= D.FREQUENT
    # exact, whatever is common
    monkeypatch.setattr(D, "BATCH_CHARS", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.kept) for r in D.cut_repeats(df).collect())
    first, want = {}, []
    for d, t in rows:
        w = t.split(" ")
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k:k + 13]), d) < d:
                keep[k:k + 13] = [False] * 13
        want.append((d, " ".join(x for x, y in zip(w, keep) if y)))
    assert got == want
