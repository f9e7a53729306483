"""Secret scans, SentencePiece, URL filters, toxicity, substring dedup and the
Jaccard join against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.llm import jaccard_join as J
from tenderlake.llm import secrets as S
from tenderlake.llm import sentencepiece_bpe as P
from tenderlake.llm import substring_dedup as D
from tenderlake.llm import toxicity as X
from tenderlake.llm import url_filter as U
from tenderlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------- secret scans

HEX = "0123456789abcdef" * 2
EDGES = [None, "", " ", "token = abc", "secret=token : abcdefgh", "PassWord:'abcdef'", "é api_key=\"" + HEX + "\"",
         "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 11, "x" + HEX[:24], HEX[:23], "a" * 50, "apiKEY:abcdefgh=="]


def _base(text):
    text = text or ""
    out = []
    for k, (p, ok) in enumerate((
            (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             lambda m: len(m[2]) >= 6),
            (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return sorted(out)


@pytest.fixture(scope="module")
def secret_docs():
    rng = random.Random(5)
    words = ["alpha", "beta", "of", "the", "run", "x", "12", "a1", ":", "=", "(v)", "K"]
    def one(i):  # noqa: E306
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if i % 4 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            w.insert(rng.randint(0, len(w)), rng.choice(["token = \"%s\"", "key %s", "secret: %s", "%s"]) % key)
        return " ".join(w)
    return EDGES + [one(i) for i in range(600)]


def test_base_spans(secret_docs):
    for t in secret_docs:
        assert [(s, k, e) for s, k, e, _ in S.base_spans(t or "")] == _base(t), t


def test_viterbi_is_exact_and_learns(secret_docs):
    model = S.fit_rows(secret_docs)
    field = S.Field(model)
    found = lost = 0
    for t in secret_docs:
        t = t or ""
        tokens = S.TOKEN.findall(t)
        tags = field.tags(tokens, S.file_feature(t))
        if tokens:      # the whole chain by plain Viterbi
            ids = [field.known[x] for x in tokens]
            pad = [0, *ids, 0]
            e = np.array([field.me[i] + field.prev[a] + field.next[b] + field.file[S.file_feature(t)]
                          for a, i, b in zip(pad, ids, pad[2:])])
            score, back = e[0], []
            for row in e[1:]:
                x = score[:, None] + field.step
                back.append(x.argmax(0))
                score = x.max(0) + row
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert {i: v for i, v in enumerate(path[::-1]) if v} == tags
        places = [(m.start(), m.end()) for m in S.TOKEN.finditer(t)]
        for s, k, e in _base(t):
            if k == 2:
                hit = any(places[i][0] < e and s < places[i][1] for i in tags)
                found, lost = found + hit, lost + (not hit)
    assert found > 20 * max(1, lost)


def test_scan(spark, secret_docs):
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(secret_docs)], "doc_id long, text string, spans string")
    got = S.scan(df, S.fit(df)).collect()
    assert len(got) == len(secret_docs) and got[0].doc_id is None
    for r in got:
        t = secret_docs[r.doc_id or 0]
        assert [(x.start, S.KINDS.index(x.kind), x.end) for x in r.spans if x.kind != "crf"] == _base(t)
        for x in r.spans:
            assert 0 <= x.start < x.end <= len(t)
    assert S.scan(df.limit(0), None).count() == 0 and S.fit(df.limit(0)) is None


# ------------------------------------------------------------ SentencePiece

PIECE_TEXTS = ["", " ", "Hello  world\n x", "a▁b ▁", "\t\tq\x00é́ ﬁ", "日本語 𝄞", "z" * 500 + " " * 50, "<s> </s> <0x0A>", "the " * 300]


def _ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_without_dropout_it_is_the_models_encoding():
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=P.MODEL_FILE)
    p = P.Pieces(P.MODEL_FILE, 0.0)
    rng = random.Random(6)
    texts = [t for t in PIECE_TEXTS if "▁" not in t] + [
        "".join(rng.choice("abtheing \n é漢\x00[") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t, g in zip(texts, p.encode(texts, [0] * len(texts))):
        assert _ids(g) == model.encode(t), repr(t)


def test_dropout_is_seeded_lossless_and_the_same_by_row_or_heap():
    p, q, other = P.Pieces(), P.Pieces(), P.Pieces(P.MODEL_FILE, P.DROPOUT, 99)
    keys = list(range(len(PIECE_TEXTS)))
    got = p.encode(PIECE_TEXTS, keys)
    assert got == [q.encode([t], [k])[0] for t, k in zip(PIECE_TEXTS, keys)]
    assert [p.decode(_ids(g)) for g in got] == PIECE_TEXTS
    assert other.encode(PIECE_TEXTS, keys) != got
    one = _ids(got[-1])
    assert len(one) > 300 and len({tuple(one[i:i + 1]) for i in range(len(one))}) > 1     # "the" in more than one way
    units = ["▁interesting", "tiontionwhere", "▁" * 9 + "x", "éèê", "漢a", "q"]
    for v in range(P.VARIANTS):
        assert p._merged_short(units, np.full(len(units), v)) == [p._ids(p._merged_long(u, v)) for u in units]


def test_encode_decode(spark):
    texts = [*PIECE_TEXTS, None]
    df = spark.createDataFrame([(None if i == 2 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, pieces int")
    got = P.decode(P.encode(df))
    assert got.columns == ["doc_id", "text", "pieces", "decoded"]
    assert all(r.decoded == (r.text or "") for r in got.collect())
    assert P.encode(df, release=True).collect() == P.encode(df).collect()
    assert P.decode(P.encode(df.limit(0))).count() == 0


# -------------------------------------------------------------- URL filters

def test_url_filter(spark):
    rng = random.Random(7)
    day0 = date(2024, 1, 1)
    urls = ["http://a.b.example.com/x/y?q=1#z", "https://U:p@A.b.Example.com:80/x", "http://example.com", "ftp://b.example.com/x/y/w",
            None, "", "not a url", "http:///x", "http://other.org/x"]
    patterns = ["example.com", "b.example.com", "a.b.example.com/x", "a.b.example.com/x/y", "com", "other.org", None]
    log = [(rng.choice(patterns), rng.choice(["block", "allow"]), rng.choice(["add", "remove"]),
            day0 + timedelta(rng.randint(0, 40))) for _ in range(150)]
    captures = [(i, rng.choice(urls), rng.choice([None, *[day0 + timedelta(d) for d in range(45)]]), True) for i in range(400)]
    got = {r.page_id: r for r in U.judge(
        spark.createDataFrame(captures, "page_id long, url string, fetched_at date, blocked boolean"),
        spark.createDataFrame(log, "pattern string, kind string, action string, dated date")).collect()}
    assert len(got) == 400

    def active(key, kind, t):
        days = sorted({d for p, k, _, d in log if (p, k) == (key, kind) and d <= t})
        return bool(days) and all(a == "add" for p, k, a, d in log if (p, k, d) == (key, kind, days[-1]))

    for i, url, t, _ in captures:
        m = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", (url or "").lower())
        hits = []
        if m and t:
            labels, parts = m[1].split("."), [x for x in m[2].split("/") if x]
            keys = [(n, ".".join(labels[-n:])) for n in range(1, len(labels) + 1)]
            keys += [(1000 + n, m[1] + "/" + "/".join(parts[:n])) for n in range(1, len(parts) + 1)]
            hits = [(lv, kind == "allow", k) for lv, k in keys for kind in ("allow", "block") if active(k, kind, t)]
        best = max(hits, default=None)
        assert got[i]["_blocked"] == bool(best and not best[1]), (url, t, hits)
        assert got[i].rule == (best[2] if best else None) and got[i].n_active == len(hits)


# ----------------------------------------------------------------- toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    from tenderlake.llm.queries import op8_toxicity
    got = op8_toxicity(spark, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = got.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.5)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert sum(p for p, y in out if not y) / sum(1 for p, y in out if not y) < 0.02


def test_toxicity_edges(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["nice", "plain", "words", "over", "there"]) for _ in range(20))
             + (" awfulword" if i % 3 == 0 else "")) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "AwfulWord!"), (None, "awfulword"), (903, "x awfulword " + "plain " * 60_000)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(df, labels)
    got = {r.doc_id: r.s for r in X.score(df, model, keep=("doc_id", "score"), into="s").collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(200))
    assert got[900] == got[901] and got[902] > 0.5 and got[None] > 0.5 and got[903] > 0.5
    assert X.score(df, X.fit(df, labels.limit(0))).agg(F.max("score")).first()[0] < 1e-9
    assert X.score(df.limit(0), model).count() == 0
    # slices of a long text find what the whole text has
    want = np.ones(1 << X.BITS, bool)
    text = docs[-1][1][:150_000]
    whole = X._distinct(X._clean(text), np.zeros(1, np.int64), want)
    assert set(whole.tolist()) == set(np.concatenate([b for _, b in X._features([text], want)]).tolist())


# ---------------------------------------------------------- substring dedup

def _cut(rows, width):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k:k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def _repeat_rows():
    rng = random.Random(9)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(30)] for _ in range(6)]
    rows = [(None, " ".join(passages[0])), (3, None), (4, " \n"), (5, "é" * 9), (6, "a " * 500), (7, "a " * 40)]
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages)[rng.randint(0, 9):] if rng.random() < 0.5 else [rng.choice("abcé") for _ in range(rng.randint(0, 20))]
        rows.append((100 + rng.randint(0, 120), rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + rows[-3:]


@pytest.mark.parametrize("width,batch", [(13, 4_000_000), (5, 300)])
def test_substring_dedup(spark, monkeypatch, width, batch):
    monkeypatch.setattr(D, "BATCH_CHARS", batch)
    rows = _repeat_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(4)
    cut = D.cut_repeats(df, width=width)
    assert cut.columns == ["doc_id", "n_words", "n_removed", "kept"]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in cut.collect()), key=lambda r: (r[0] or -1, *r[1:])) == sorted(
        _cut(rows, width), key=lambda r: (r[0] or -1, *r[1:]))
    assert D.cut_repeats(df.limit(0)).count() == 0


def test_equal_hashes_are_checked_word_for_word(monkeypatch):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 400).astype(np.int32)
    starts = np.arange(390)
    doc = starts // 40
    monkeypatch.setattr(D, "_rolled", lambda x, width: np.zeros(len(x) - width + 1, np.uint64))
    got = D.repeated(ids, starts, doc, 4)
    first = {}
    for s in starts.tolist():
        first.setdefault(tuple(ids[s:s + 4]), doc[s])
    assert got.tolist() == [bool(first[tuple(ids[s:s + 4])] < doc[s]) for s in starts.tolist()]


# ------------------------------------------------------------- Jaccard join

def _links(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None] if sets[i] else [x for x in [d] if x is not None]
        out.append((d, len(sets[i]), min(known, default=None)))
    return out


def _near_rows():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(None, "x y z w"), (2, "X  y\nz w"), (3, None), (4, ""), (5, "one"), (6, "ONE"), (7, "one two"), (8, "É a b c"), (9, "é a b c")]
    passage = [word() for _ in range(60)]
    n = 20
    for size in (9, 10, 11, 12, 14, 30, 60, 100, 250):
        for _ in range(3):
            base = [word() for _ in range(size + 2)]
            for _ in range(8):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    at = rng.randrange(len(w))
                    rng.choice([lambda: w.__setitem__(at, word()), lambda: w.pop(at), lambda: w.insert(at, word())])()
                if rng.random() < 0.3:
                    w = w[:rng.randint(max(1, int(len(w) * 0.85)), len(w))]
                rows.append((n, " ".join(w)))
                n += 1
    for _ in range(40):       # documents that share a passage only
        rows.append((n, " ".join(passage + [word() for _ in range(rng.randint(5, 60))])))
        n += 1
    rng.shuffle(rows)
    return rows + rows[:2]


@pytest.mark.parametrize("long_,grams", [(J.LONG, J.BLOCK_GRAMS), (3, 600)])
def test_jaccard_join(spark, monkeypatch, long_, grams):
    monkeypatch.setattr(J, "LONG", long_)
    rows = _near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = J.classes(df, block_grams=grams)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(_links(rows), key=key)


def test_links_of_a_block_connect_what_all_links_do():
    rng = random.Random(11)
    base = list(range(200))
    sets = []
    for _ in range(120):
        s = set(base)
        for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 30])):
            s.discard(rng.randrange(200))
            s.add(rng.randrange(1000, 9000))
        sets.append(np.array(sorted(s), np.uint64))
    got = J.link_block(np.array([len(s) for s in sets]), np.concatenate(sets), np.ones(120, bool))

    def parts(links):
        root = list(range(120))
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {frozenset(i for i in range(120) if root[i] == r) for r in root}
    py = [set(s.tolist()) for s in sets]
    full = [(i, j) for i in range(120) for j in range(i) if 100 * len(py[i] & py[j]) >= 90 * len(py[i] | py[j])]
    assert parts(got) == parts(full) and len(got) < 120 and set(map(frozenset, got)) <= set(map(frozenset, full))


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, 1), (4, text + " end", 2), (4, text + " end", 2), (9, "other words here", 3), (1, "", 4), (1, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = J.one_of_each(df)
    assert got.columns == df.columns and sorted(r.key for r in got.collect()) == [2, 3, 4, 5]
    assert J.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_of_the_contract(spark):
    from tenderlake.llm.queries import op4_secret_scan
    r = op4_secret_scan(spark, "/root/testdata/sf0.001")
    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for x in r.collect():
        spans = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in _base(docs[x.doc_id]))
        assert x.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
