"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and merge ranks come from a public SentencePiece BPE model file
(``model_file``; every executor needs it at that path).  A unit, a run of
blanks with the word after it, is merged by an agenda of candidate merges,
best score first, then leftmost (an array row a unit for short units, worked on many at
a time, a heap for long ones).  Each candidate taken is skipped when its keyed hash falls under
``dropout``; the key is (seed, document id, place of the unit in the text,
piece, place in the unit), so each occurrence of a unit is skipped in by itself,
and is the same in every run and on every executor.  What a unit becomes without
skips is remembered with its merges; most occurrences have a skip at none of
these and take it.  The others go on to what the unit becomes when the first
merge skipped is left out, which is remembered in the same way, and so on until
no merge is skipped; the agenda runs only for what is not remembered yet, and
for units that stand only once in a batch of texts, which are not remembered.

What no piece covers, and a literal U+2581, is written as byte pieces: decoding
gives back every text, byte for byte.  With ``dropout`` 0 the segmentation is
the model's own (but for U+2581, which the model can't tell from a blank).

Defined cases: a null text is the empty text; empty texts have no pieces; very
long texts and units are encoded whole; repeated rows are encoded each, alike;
a null id is a key like any other; further columns are kept, an older column of
the result's name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import fresh, releasing

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 31
VARIANTS = 4             # occurrence numbers 0 to 3 that the tests try; encoding takes 64-bit ones
BLANK = "▁"
UNITS = re.compile("\n|▁|\x20*[^\x20\n▁]+|\x20+")
SHORT = 32               # longest unit whose agenda is an array row, not a heap
REMEMBERED = 400_000     # outcomes a worker remembers before it starts afresh
NONE = float("-inf")
MASK, GOLDEN = (1 << 64) - 1, 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PART = 1 << 18           # units whose skips are looked up at a time


def _mix(x: np.ndarray) -> np.ndarray:
    for k in MIX:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _mix_one(x: int) -> int:
    for k in MIX:
        x = (x ^ x >> 30) * k & MASK
    return x ^ x >> 31


def _in_row(unit: str) -> bool:
    return len(unit) <= SHORT and unit != BLANK and "\0" not in unit   # 0 ends a row


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.kept, self.size = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.kept):
            self.kept = np.concatenate([self.kept[:self.size], np.empty(self.size + len(more), self.kept.dtype)])
        self.kept[self.size:self.size + len(more)] = more
        self.size += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.kept[:self.size]


class Pieces:
    """The vocabulary of a model file and the agenda over it."""

    def __init__(self, model_file: str = MODEL_FILE, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor
        m = SentencePieceProcessor(model_file=model_file)
        self.ids, self.score, self.byte = {}, {}, [0] * 256
        self.raw = [b""] * m.get_piece_size()
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[p], self.score[p] = i, m.get_score(i)
                self.raw[i] = p.replace(BLANK, " ").encode()
        self.limit, self.seed = int(dropout * (1 << 32)), seed
        self.keys = _mix(np.arange(len(self.raw), dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(_mix_one(seed & MASK)))
        self._forget()
        # the vocabulary as arrays: single characters, pairs that make a piece
        self.strings = {i: p for p, i in self.ids.items()}
        self.blank = np.array([self.byte[b] for b in BLANK.encode()], dtype="<i4").tobytes()
        self.scores = np.full(len(self.raw), NONE)
        for p, i in self.ids.items():
            self.scores[i] = self.score[p]
        chars = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array(x) for x in zip(*chars))
        pairs = sorted((self.ids[p[:k]] * len(self.raw) + self.ids[p[k:]], i) for p, i in self.ids.items()
                       for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pairs, self.pair_ids = (np.array(x) for x in zip(*pairs))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}      # unit: the number of its outcome without skips
        self.units: list[str] = []           # of each outcome: the unit,
        self.left_out: list[tuple] = []      # the keys of the merges left out,
        self.spelt: list[bytes] = []         # the pieces' ids,
        self.begin, self.steps = _Grown(np.int64), _Grown(np.int64)      # and its merges in the following
        self.path = _Grown(np.uint64)        # keys of the merges, outcome after outcome
        self.child = _Grown(np.int64)        # the outcome when this one is left out, too; -1 if not known

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, -1 if none."""
        key = a * len(self.raw) + b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.pair_ids[at], -1)

    def _merged_short(self, units: list[str], occurrences: np.ndarray | None,
                      path: list | None = None, left_out: np.ndarray | None = None) -> list[bytes]:
        """Ids of many short units at once, one row each: the agenda of a row
        is the score of the pair that begins at each place.  No occurrences:
        no skips but of the keys ``left_out`` (as many for each row).  ``path``
        takes (rows, keys) of the merges that are not left out."""
        occurrences = None if occurrences is None else occurrences.astype(np.uint64)
        n, wide = len(units), max(map(len, units))
        code = np.array(units, dtype=f"<U{wide}").view("<u4").reshape(n, wide)
        size = np.count_nonzero(code, axis=1)
        known = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        piece = np.where(self.chars[known] == code, self.char_ids[known], -1)
        places = np.arange(wide)
        after = np.where(places + 1 < size[:, None], places + 1, wide)
        ahead = np.broadcast_to(places - 1, (n, wide)).copy()
        made = np.full((n, wide), -1)
        if wide > 1:
            made[:, :-1] = self._joined(piece[:, :-1].ravel(), piece[:, 1:].ravel()).reshape(n, -1)
        agenda = np.where(made >= 0, self.scores[made], NONE)
        alive = places < size[:, None]
        live = np.arange(n)
        while len(live):
            i = agenda[live].argmax(axis=1)
            some = agenda[live, i] > NONE
            live, i = live[some], i[some]
            new = made[live, i]
            r = live
            if path is not None or occurrences is not None:
                key = self.keys[new] + i.astype(np.uint64) * np.uint64(GOLDEN)
            drop = None
            if occurrences is not None:
                drop = self._skipped(occurrences[r] + key)
            elif left_out is not None:
                drop = (left_out[r] == key[:, None]).any(axis=1)
            if path is not None:
                path.append((r, key) if drop is None else (r[~drop], key[~drop]))
            if drop is not None:
                agenda[r[drop], i[drop]] = NONE
                r, i, new = r[~drop], i[~drop], new[~drop]
            j = after[r, i]
            k, h = after[r, j], ahead[r, i]
            piece[r, i], alive[r, j], agenda[r, j], agenda[r, i] = new, False, NONE, NONE
            after[r, i] = k
            for rows, first, second in ((k < wide, i, k), (h >= 0, h, i)):
                q, x, y = r[rows], first[rows], second[rows]
                both = self._joined(piece[q, x], piece[q, y])
                made[q, x] = both
                agenda[q, x] = np.where(both >= 0, self.scores[both], NONE)
                if second is k:
                    ahead[q, y] = x
        out, ends = piece[alive].astype("<i4"), np.cumsum(alive.sum(axis=1))
        spelt = out.tobytes()
        got = [spelt[4 * x:4 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
        unknown = np.flatnonzero((alive & (piece < 0)).any(axis=1))
        for r in unknown.tolist():
            got[r] = self._ids([self.strings[x] if x >= 0 else units[r][c]
                                for c, x in enumerate(piece[r].tolist()) if alive[r, c]])
        return got

    def _skipped(self, keys: np.ndarray) -> np.ndarray:
        return (_mix(keys) >> np.uint64(32)) < self.limit

    def _ids(self, parts: list[str]) -> bytes:
        """Ids as little-endian 32-bit integers; byte pieces where there is none."""
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte[b] for b in p.replace(BLANK, " ").encode())
            else:
                out.append(i)
        return np.array(out, dtype="<i4").tobytes()

    def _merged_long(self, unit: str, occurrence: int) -> list[str]:
        """The same with a heap and linked neighbours."""
        part: list[str | None] = list(unit)
        n, ids, score, limit = len(part), self.ids, self.score, self.limit
        keys = self.keys
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            both = part[i] + part[i + 1]
            if both in score:
                agenda.append((-score[both], i, both, i + 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, both, j = heapq.heappop(agenda)
            # merges away since: one side is gone or has grown
            if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != both:
                continue
            if limit and _mix_one(occurrence + int(keys[ids[both]]) + i * GOLDEN & MASK) >> 32 < limit:
                continue
            part[i], part[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                more = both + part[k]
                if more in score:
                    heapq.heappush(agenda, (-score[more], i, more, k))
            h = left[i]
            if h >= 0:
                more = part[h] + both
                if more in score:
                    heapq.heappush(agenda, (-score[more], h, more, i))
        return [p for p in part if p is not None]

    def _occurrences(self, n: int, key: int) -> np.ndarray:
        """A number for each of a text's units."""
        text = _mix_one((key & MASK) ^ _mix_one(self.seed + 1 & MASK))
        return _mix(np.arange(n, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(text))

    def encode(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        units = [UNITS.findall(" " + t) if t else [] for t in texts]
        ends = np.cumsum([0] + [len(u) for u in units]).tolist()
        flat = [u for us in units for u in us]
        if not flat:
            return [b""] * len(texts)
        occurrences = np.concatenate([self._occurrences(len(u), k) for u, k in zip(units, keys)])
        if len(self.spelt) > REMEMBERED:
            self._forget()
        missing = sorted((u for u, k in Counter(flat).items() if k > 1 and u not in self.known and _in_row(u)), key=len)
        first = len(self.spelt)
        self._learn(missing, [()] * len(missing))
        self.known.update(zip(missing, range(first, first + len(missing))))
        get = self.known.get
        at = np.fromiter((get(u, -1) for u in flat), np.int64, len(flat))
        if self.limit:
            for x in range(0, len(at), PART):
                self._follow(at[x:x + PART], occurrences[x:x + PART])
        spelt = [*self.spelt, b""]            # the last one for units that aren't remembered
        got = [spelt[i] for i in at.tolist()]
        others = np.flatnonzero(at < 0).tolist()
        once = sorted((i for i in others if _in_row(flat[i])), key=lambda i: len(flat[i]))
        for x in range(0, len(once), 4096):
            part = once[x:x + 4096]
            for i, g in zip(part, self._merged_short([flat[i].replace(" ", BLANK) for i in part],
                                                     occurrences[part] if self.limit else None)):
                got[i] = g
        for i in others:
            if _in_row(flat[i]):
                continue
            got[i] = (self.blank if flat[i] == BLANK else
                      self._ids(self._merged_long(flat[i].replace(" ", BLANK), int(occurrences[i]))))
        return [b"".join(got[x:y]) for x, y in zip(ends[:-1], ends[1:])]

    def _follow(self, at: np.ndarray, occurrences: np.ndarray) -> None:
        """Go on, in ``at``, from outcome to outcome until no merge is skipped;
        -1 where that leads to an outcome that only one occurrence needs."""
        rows = np.flatnonzero(at >= 0)
        while len(rows):
            steps = self.steps.all[at[rows]]
            rows, steps = rows[steps > 0], steps[steps > 0]
            if not len(rows):
                return
            first = np.cumsum(steps) - steps
            step = np.arange(int(steps.sum())) + np.repeat(self.begin.all[at[rows]] - first, steps)
            skipped = self._skipped(np.repeat(occurrences[rows], steps) + self.path.all[step])
            # the first one in the order of the agenda
            step = np.minimum.reduceat(np.where(skipped, step, self.path.size), first)
            rows, step = rows[step < self.path.size], step[step < self.path.size]
            unknown = self.child.all[step] < 0
            new, count = np.unique(step[unknown], return_counts=True)
            new = new[count > 1]
            if len(new):
                parent = (np.searchsorted(self.begin.all, new, side="right") - 1).tolist()
                # the shortest units first: rows of one length are worked on together
                order = sorted(range(len(new)), key=lambda i: len(self.units[parent[i]]))
                new, parent = new[order], [parent[i] for i in order]
                number = len(self.spelt)
                self._learn([self.units[p] for p in parent],
                            [(*self.left_out[p], k) for p, k in zip(parent, self.path.all[new].tolist())])
                self.child.kept[new] = np.arange(number, number + len(new))
            at[rows] = self.child.all[step]
            rows = rows[at[rows] >= 0]

    def _learn(self, units: list[str], left_out: list[tuple]) -> None:
        """Remember what units (rows of the agenda, in order of length) become
        when some merges are left out."""
        for x in range(0, len(units), 4096):
            part, out, path = units[x:x + 4096], left_out[x:x + 4096], []
            most = max(map(len, out))
            keys = np.array([o + o[:1] * (most - len(o)) for o in out], np.uint64) if most else None
            self.spelt += self._merged_short([u.replace(" ", BLANK) for u in part], None, path, keys)
            rows, key = (np.concatenate(p) for p in zip(*path)) if path else (np.empty(0, np.int64), np.empty(0, np.uint64))
            steps = np.bincount(rows, minlength=len(part))
            self.begin.add(self.path.size + np.cumsum(steps) - steps)
            self.steps.add(steps)
            self.path.add(key[np.argsort(rows, kind="stable")])
            self.child.add(np.full(len(key), -1))
        self.units += units
        self.left_out += left_out

    def decode(self, ids) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8")


_HELD: dict[tuple, Pieces] = {}


def _pieces(*args) -> Pieces:
    if args not in _HELD:
        _HELD.clear()
        _HELD[args] = Pieces(*args)
    return _HELD[args]


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", into: str = "pieces",
           model_file: str = MODEL_FILE, dropout: float = DROPOUT,
           seed: int = SEED, drop_text: bool = False, release: bool = False) -> DataFrame:
    """``docs`` with the ids of the text's pieces as array<int>; the text goes
    with ``drop_text``.  With ``release`` a task forgets the outcomes when it
    ends, so that workers which later do other work hold less; each task then
    learns them anew."""
    n = fresh(docs, "text_in", "key_in")
    kept = [c for c in docs.columns if c.lower() != into.lower() and not (drop_text and c == text_col)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(n["text_in"]),
                       F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string")).alias(n["key_in"]))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(into, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        p = _pieces(model_file, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                got = p.encode(_texts(b.column(n["text_in"])), b.column(n["key_in"]).to_pylist())
                ends = np.cumsum([0] + [len(g) // 4 for g in got]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [ids], names=kept + [into])
        if release:
            p._forget()

    return rows.mapInArrow(releasing(run) if release else run, schema)


def decode(rows: DataFrame, pieces_col: str = "pieces", into: str = "decoded",
           model_file: str = MODEL_FILE, drop_pieces: bool = False) -> DataFrame:
    """``rows`` with the text that the pieces spell; null pieces spell null."""
    kept = [c for c in rows.columns if c.lower() != into.lower() and not (drop_pieces and c == pieces_col)]
    n = fresh(rows, "pieces_in")
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(into, T.StringType())])

    def run(batches):
        p = _pieces(model_file, 0.0, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                lists = b.column(n["pieces_in"])
                ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
                out = [p.decode(ids[x:y].tolist()) if ok else None for x, y, ok in
                       zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))]
                                                 + [pa.array(out, pa.string())], names=kept + [into])

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{pieces_col}`").alias(n["pieces_in"])
                       ).mapInArrow(run, schema)
