"""Secret scans with a linear-chain conditional random field.

A text is a chain of tokens (word-like runs and single marks), each tagged as
secret begin, inside or outside.  A token's evidence is the features of itself
and of its neighbours: the key word or mark, or the shape (length, character
classes, changes between them, hex, known prefix), and a feature of the file
(how many assignment marks the text has); tag transitions are learned with
them.  Three fixed patterns give base spans, and the field learns from them
what secrets and their surroundings look like.  So that it does not learn the
patterns themselves, half of the secrets it is shown stand without key word
and marks, and with the value cut to a random length.  It adds spans that no
pattern covers.

The field is fitted on at most ``MAX_DOCS`` documents, half of them (if there
are as many) with a base span, found by a scan of all, and on at most
``MAX_WINDOWS`` stretches of them, picked at random.

Decoding is exact Viterbi over the whole text: a token whose evidence for
"outside" beats everything that any two transitions could give is outside on
the best path, so the chain falls apart there and only the short stretches
between such tokens are decoded step by step.

Base spans stay as they are; of a run that the field tags, the parts outside
them are reported that have a letter or digit.

Offsets are code points, end exclusive.  Defined cases: a null or empty text
has no spans; a very long text is decoded whole; repeated rows are scanned each; without any base span in the
sample only base spans are found; a null id is allowed; further columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import add_columns, fresh, releasing, saved
from tenderlake.llm.fitting import minimise

MAX_DOCS = 10_000        # documents the field is fitted on, chosen by hash of the id
MAX_WINDOWS = 30_000     # stretches of them
WINDOW, WINDOWS_PLAIN = 24, 1
HIDDEN, CUT = 0.5, 12    # share of the secrets shown by their value alone, its least length then
RIDGE = 0.1
REMEMBERED = 400_000

# Fixed patterns and key words of the base spans, with their least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")      # maximal runs: the same as runs of 24 and more
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20}
# Texts with a base span, for the choice of documents to learn from.
ANY_BASE = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
            r"|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
NEAR_WORDS = frozenset((*KEY_WORDS, "key", "auth", "bearer", "credential", "credentials", "private", "access",
                        "authorization", "login", "user", "username", "email", "mail", "id"))

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind index, end, start of the secret itself), sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEY_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    found.sort()
    return found


# ------------------------------------------------------------------ evidence

SIZES, TURNS = (2, 4, 6, 9, 13, 20, 28, 40), (2, 3, 5, 9, 14)


def token_features(t: str) -> tuple[str, ...]:
    """A mark or key word itself, otherwise the shape of the longest piece
    between the token's dots, dashes, slashes and the like."""
    if len(t) == 1 and not t.isalnum():
        return "mark", "m:" + t
    low = t.lower().strip("._-")
    if low in NEAR_WORDS:
        return "word", "w:" + low
    t = max(re.split(r"[\W_]+", t), key=len)
    n = len(t)
    out = [f"n{k}" for k in SIZES if n >= k]
    if t.isalpha() and (t[1:].islower() or t.isupper() or not t.isascii()):
        return "plain", *out, *(["upper"] if n > 1 and t.isupper() else [])
    classes, last, turns = set(), "", 0
    for c in t:
        k = "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"
        turns += k != last
        last = k
        classes.add(k)
    out += [f"t{k}" for k in TURNS if turns >= k]
    out += ["c:" + "".join(sorted(classes)), *("has:" + k for k in sorted(classes))]
    if len(classes) > 1 and 2 * n <= 5 * turns:
        out.append("mixed")
    if "d" in classes and not t.strip("0123456789abcdef"):
        out.append("hex")
    if t.startswith("AKIA"):
        out.append("AKIA")
    return tuple(out)


def file_feature(text: str) -> int:
    n = text.count("=") + text.count(":")
    return 0 if not n else 1 if n == 1 else 2 if n <= 4 else 3


# ------------------------------------------------------------------- fitting

def _windows(text: str, rng: np.random.Generator):
    """Training stretches of a text: one anywhere, and around its base spans."""
    found = list(TOKEN.finditer(text))
    if not found:
        return
    starts = np.array([m.start() for m in found])
    ends = np.array([m.end() for m in found])
    tags = np.zeros(len(found), np.int8)
    at = [(int(a), 0, 0) for a in rng.integers(0, len(found), WINDOWS_PLAIN)]
    for start, _, end, begin in base_spans(text):
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end)
        if b > a and not tags[a:b].any():
            tags[a], tags[a + 1:b] = BEGIN, INSIDE
            at.append((int(a), int(b), int(np.searchsorted(ends, start, side="right"))))
    file = file_feature(text)
    for a, b, key in at:
        lo = max(0, a - WINDOW // 2)
        hi = min(len(found), lo + WINDOW)
        tokens = [m[0] for m in found[max(0, lo - 1):hi + 1]]
        tag = tags[lo:hi].tolist()
        before, after = lo > 0, hi < len(found)
        if b and rng.random() < HIDDEN:
            # the value alone: without key word, marks before it and a quote after it
            shift = lo - before
            if b == a + 1:
                tokens[a - shift] = tokens[a - shift][:int(rng.integers(CUT, max(CUT, len(found[a][0])) + 1))]
            gone = {i for i in range(max(key, lo), a)}
            if b < hi and found[b][0] in "\"'":
                gone.add(b)
            tokens = [x for i, x in enumerate(tokens, shift) if i not in gone]
            tag = [x for i, x in enumerate(tag, lo) if i not in gone]
            yield list(map(token_features, tokens)), before, after, tag, max(0, file - (a > key))
        else:
            yield list(map(token_features, tokens)), before, after, tag, file


def fit_rows(texts, ridge: float = RIDGE) -> dict | None:
    rng = np.random.default_rng(5)
    rows, seen = [], 0
    for t in texts:
        for w in _windows(t or "", rng):
            seen += 1
            if len(rows) < MAX_WINDOWS:
                rows.append(w)
            elif (k := int(rng.integers(seen))) < MAX_WINDOWS:
                rows[k] = w
    if not any(any(w[3]) for w in rows):
        return None
    kinds = sorted({t for w in rows for t in w[0]})
    index = {t: i + 1 for i, t in enumerate(kinds)}     # 0: no neighbour
    names = ["none", *sorted({f for t in kinds for f in t})]
    place = {f: i for i, f in enumerate(names)}
    n_types, n_feats, s, wide = len(kinds) + 1, len(names), len(rows), WINDOW
    has = np.zeros((n_types, n_feats))                  # features of the kinds of token
    has[0, 0] = 1
    for i, t in enumerate(kinds):
        has[i + 1, [place[f] for f in t]] = 1
    ids = np.zeros((s, wide + 2), np.int64)
    tags, mask, file = np.zeros((s, wide), np.int64), np.zeros((s, wide), bool), np.zeros(s, np.int64)
    for r, (types, before, _, tag, f) in enumerate(rows):
        ids[r, 0 if before else 1:][:len(types)] = [index[t] for t in types]
        tags[r, :len(tag)], mask[r, :len(tag)], file[r] = tag, True, f
    size = [n_feats * 3] * 3 + [4 * 3, 9]
    cut = np.cumsum(size)[:-1]
    here = mask.astype(float)[..., None]
    hot = np.eye(3)[tags] * here
    pair_mask = (mask[:, :-1] & mask[:, 1:])
    pair_count = np.zeros((3, 3))
    np.add.at(pair_count, (tags[:, :-1][pair_mask], tags[:, 1:][pair_mask]), 1)

    def loss(w):
        me, prev, nxt, fil, tr = (x.reshape(-1, 3) for x in np.split(w, cut))
        e = (has @ me)[ids[:, 1:-1]] + (has @ prev)[ids[:, :-2]] + (has @ nxt)[ids[:, 2:]] + fil[file][:, None]
        fwd = np.zeros((s, wide, 3))
        fwd[:, 0] = e[:, 0]
        for t in range(1, wide):
            x = np.logaddexp.reduce(fwd[:, t - 1, :, None] + tr, axis=1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], x, fwd[:, t - 1])
        total = np.logaddexp.reduce(fwd[:, -1], axis=1)
        bwd = np.zeros((s, wide, 3))
        pairs = np.zeros((3, 3))
        for t in range(wide - 2, -1, -1):
            x = np.logaddexp.reduce(tr + (e[:, t + 1] + bwd[:, t + 1])[:, None], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None], x, 0)
            p = np.exp(fwd[:, t, :, None] + tr + (e[:, t + 1] + bwd[:, t + 1])[:, None] - total[:, None, None])
            pairs += p[mask[:, t + 1]].sum(axis=0)
        p = np.exp(fwd + bwd - total[:, None, None]) * here
        d = (p - hot).reshape(-1, 3)
        grads = []
        for x, n in ((ids[:, 1:-1], n_types), (ids[:, :-2], n_types), (ids[:, 2:], n_types),
                     (np.broadcast_to(file[:, None], (s, wide)), -4)):
            x = x.ravel()
            g = np.stack([np.bincount(x, weights=d[:, k], minlength=abs(n)) for k in range(3)], axis=1)
            grads.append((has.T @ g if n > 0 else g).ravel())
        grads.append((pairs - pair_count).ravel())
        value = total.sum() - (e * hot).sum() - (tr * pair_count).sum()
        return value + ridge / 2 * w.dot(w), np.concatenate(grads) + ridge * w

    w = minimise(loss, np.zeros(sum(size)), steps=80)
    me, prev, nxt, fil, tr = (x.reshape(-1, 3) for x in np.split(w, cut))
    return {"features": names, "me": me.tolist(), "prev": prev.tolist(), "next": nxt.tolist(),
            "file": fil.tolist(), "step": tr.tolist()}


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = 3) -> dict | None:
    """Fit the field on at most ``max_docs`` documents in one task.  ``docs``:
    doc_id, text."""
    import json
    known = saved(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("text").rlike(ANY_BASE), F.lit(False))).alias("hit")), "secrets-labels")
    first = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    pick = (known.where("hit").orderBy(*first).limit(max_docs // 2)
            .unionAll(known.where("not hit").orderBy(*first).limit(max_docs - max_docs // 2)).select("doc_id"))
    rows = (docs.select("doc_id", "text").join(F.broadcast(saved(pick, "secrets-sample")), "doc_id")
            .groupBy("doc_id").agg(F.max("text").alias("text")))

    def run(batches):
        got = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "text": []})], ignore_index=True)
        model = fit_rows(got.sort_values("doc_id")["text"])
        if model:
            yield pd.DataFrame({"model": [json.dumps(model)]})

    found = rows.repartition(1).mapInPandas(releasing(run), "model string").collect()
    return json.loads(found[0]["model"]) if found else None


# ------------------------------------------------------------------ decoding

class Field:
    """A fitted field, ready to decode."""

    def __init__(self, model: dict):
        place = {f: i for i, f in enumerate(model["features"])}
        me, prev, nxt, self.file, self.step = (np.array(model[k]) for k in ("me", "prev", "next", "file", "step"))
        # rows of the kinds of token met so far, by their known features; 0: no neighbour
        kinds, rows = {}, [np.concatenate([x[0] for x in (me, prev, nxt)])]
        self.me = self.prev = self.next = None      # the rows' parts
        # how far "outside" must lead to be certain
        gain = self.step[:, 1:] - self.step[:, :1]
        gain_out = self.step[1:] - self.step[:1]
        self.lead = np.maximum(gain.max(axis=0), 0) + np.maximum(gain_out.max(axis=1), 0)
        field = self

        class Known(dict):
            def __missing__(self, t):
                if len(self) > REMEMBERED:
                    self.clear()
                kind = tuple(place[f] for f in token_features(t) if f in place)
                if kind not in kinds:
                    kinds[kind] = len(rows)
                    rows.append(np.concatenate([x[list(kind)].sum(axis=0) for x in (me, prev, nxt)]))
                    field.me = None
                self[t] = i = kinds[kind]
                return i
        self.known, self.rows = Known(), rows

    def tags(self, tokens: list[str], file: int) -> dict[int, int]:
        """Place and tag of the tokens that aren't outside."""
        n = len(tokens)
        if not n:
            return {}
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, n)
        if self.me is None:
            self.me, self.prev, self.next = np.split(np.array(self.rows), 3, axis=1)
        e = self.me[ids] + self.file[file]
        e[1:] += self.prev[ids[:-1]]
        e[:-1] += self.next[ids[1:]]
        # no neighbour has the row 0, as in training
        e[0] += self.prev[0]
        e[-1] += self.next[0]
        open_ = np.flatnonzero((e[:, :1] - e[:, 1:] <= self.lead).any(axis=1))
        out: dict[int, int] = {}
        if len(open_):
            for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                for place, tag in zip(part.tolist(), self._best(e, int(part[0]), int(part[-1]), n)):
                    if tag:
                        out[place] = tag
        return out

    def _best(self, e, a: int, b: int, n: int) -> list[int]:
        """Viterbi over tokens a..b, with certain outsides around them."""
        step = self.step
        score = e[a] + (step[OUT] if a else 0)
        back = []
        for t in range(a + 1, b + 1):
            x = score[:, None] + step
            back.append(x.argmax(axis=0))
            score = x.max(axis=0) + e[t]
        if b < n - 1:
            score = score + step[:, OUT]
        path = [int(score.argmax())]
        for x in reversed(back):
            path.append(int(x[path[-1]]))
        return path[::-1]


def spans(text: str, field: Field | None) -> tuple[list[int], list[int], list[int]]:
    """Kinds, starts and ends of all spans, by start, then kind: the base ones
    and, of those of the field, what lies outside the base ones."""
    found = [(s, k, e) for s, k, e, _ in base_spans(text)]
    tags = field.tags(TOKEN.findall(text), file_feature(text)) if field else {}
    if tags:
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        runs, last = [], -2
        for i in sorted(tags):
            if tags[i] == INSIDE and i == last + 1:
                runs[-1][1] = places[i][1]
            else:
                runs.append(list(places[i]))
            last = i
        base: list[list[int]] = []                  # base spans, joined where they overlap
        for s, _, e in found:
            if base and s < base[-1][1]:
                base[-1][1] = max(base[-1][1], e)
            else:
                base.append([s, e])
        ends, added = [e for _, e in base], []
        for s, e in runs:
            for x, y in base[bisect_right(ends, s):]:
                if x >= e:
                    break
                added.append((s, x))
                s = y
            added.append((s, e))
        found += [(s, KINDS.index("crf"), e) for s, e in added if any(map(str.isalnum, text[s:e]))]
    found.sort()
    return [k for _, k, _ in found], [s for s, _, _ in found], [e for _, _, e in found]


def scan(docs: DataFrame, model: dict | None, text_col: str = "text",
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``, an array of (kind, start, end), of every whole
    text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)    # weights of the token types

    def make():
        field = Field(sent.value) if sent.value else None
        return lambda texts: list(zip(*[spans(t or "", field) for t in texts]))

    ints = T.ArrayType(T.IntegerType()), pa.list_(pa.int32())
    n = fresh(docs, "_k", "_s", "_e")
    rows = add_columns(docs, list(keep), [F.col(f"`{text_col}`")], {x: ints for x in n.values()}, make)
    names = F.array(*[F.lit(k) for k in KINDS])
    return rows.select(*keep, F.transform(
        F.arrays_zip(*n.values()), lambda x: F.struct(
            F.get(names, x[n["_k"]]).alias("kind"), x[n["_s"]].alias("start"), x[n["_e"]].alias("end"))).alias("spans"))
