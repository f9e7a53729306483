"""Phrase collocation mining over a prefix-free parse.

A text (ASCII letters in lower case) is split into pieces and these into words;
a phrase is a run of 1 to ``longest`` words of one piece.

1. Parse.  A text is the sequence of its words with a break between pieces and
   ``longest`` - 1 breaks at its end.  A window of ``longest`` - 1 tokens whose
   hash is divisible by ``PERIOD`` is a trigger: a chunk ends with it and the
   next one begins with it.  As content alone decides, a passage that stands
   in many texts gives the same chunks; the dictionary holds each chunk of a
   language once, with its frequency in the parse.  Chunks are dealt by hash
   into lots of the dictionary.
2. Select.  A chunk owns the phrases that start before its last ``longest`` - 1
   tokens, so a phrase in the overlap of two chunks counts once.  Every lot
   sends the hash of each owned phrase, weighted by the chunk's frequency, to
   the hash's bucket (packed, 5 bytes a phrase; weights of ``least`` and more
   are alike).  Buckets tell each lot which of its hashes reach ``least``.
3. Count.  Lots give those phrases as text with their whole weight, and a sum by
   language and phrase is the exact count; hashes that fell together only
   cost a row here.
4. Score.  Cuts, containment and ranks are joins and aggregates of the phrases
   found ``least`` times.  A part of such a phrase is found at least as often,
   so every count that a score needs is among them.

Numbers of lots and buckets follow the size of the input.  A chunk, phrase or
language in a third of all texts is a row a lot or a batch at most, never a group.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count each; a text of any length is parsed whole (one without triggers is
one chunk); further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import saved

LEAST, LONGEST = 30, 4
PERIOD = 32                   # tokens of a chunk, on average
LOT_CHARS = 9_000_000         # texts that a lot of the dictionary stands for
BUCKET_CHARS = 5_000_000      # texts that a bucket of hashes stands for
HELD_CHARS = 16_000_000       # chunks that a task combines before it sends them
MOST_PARTITIONS = 16_384
RANKED_AT_ONCE = 100_000      # phrases ranked in one task before the languages' best meet
TOKENS = re.compile(r"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]+")
BREAKS = frozenset(".,;:!?\n\x0b\x0c\r")
BREAK, BETWEEN = "\n", "\x0b"     # a break between pieces; between chunks of a lot


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values."""
    n = max(len(x) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for k in range(width if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k:n + k]
    return _mix(out)


class _Codes(dict):
    """64-bit codes of tokens, remembered; 0 is a break."""

    def __missing__(self, token):
        import xxhash
        if len(self) > 500_000:
            self.clear()
        self[token] = x = 0 if token[0] in BREAKS else xxhash.xxh64_intdigest(token) or 1
        return x


# --------------------------------------------------------------------- parse

def parse(texts: list[str], codes: _Codes, longest: int = LONGEST, period: int = PERIOD) -> list[str]:
    """The chunks of the texts, one after the other, tokens joined by a blank."""
    over = longest - 1
    tokens, ends = [], []
    for t in texts:
        got = TOKENS.findall(t.encode().lower().decode())
        if got:
            tokens += got
            tokens += [BREAK] * max(over, 1)
            ends.append(len(tokens))
    if not tokens:
        return []
    x = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    for i in np.flatnonzero(x == 0).tolist():
        tokens[i] = BREAK
    ends = np.array(ends)
    firsts = np.concatenate([[0], ends[:-1]])
    if over:
        starts = np.union1d(np.flatnonzero(_rolled(x, over) % np.uint64(period) == 0), firsts)
        text = np.searchsorted(ends, starts, side="right")
        starts = starts[(starts < ends[text] - over)]
    else:
        starts = firsts
    text = np.searchsorted(ends, starts, side="right")
    after = np.append(starts[1:], len(tokens))
    after = np.minimum(after, ends[text] - max(over, 1))
    return [" ".join(tokens[a:b + over]) for a, b in zip(starts.tolist(), after.tolist())]


def _dictionary(docs: DataFrame, lots: int, longest: int) -> DataFrame:
    """lang, lot, chunks (compressed, each once), weights, n (words)."""
    over = longest - 1
    schema = "lang string, lot long, chunks binary, weights binary, n long"
    names = ["lang", "lot", "chunks", "weights", "n"]

    def packed(held: dict):
        import xxhash
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3).compress
        by: dict = {}
        for (lang, chunk), k in held.items():
            by.setdefault((lang, xxhash.xxh64_intdigest(chunk, 7) % lots), []).append((chunk, k))
        rows = []
        for (lang, lot), got in by.items():
            weights = np.array([k for _, k in got], "<i8")
            text = BETWEEN.join(c for c, _ in got)
            n = sum(k * sum(t != BREAK for t in c.split(" ")[:-over or None]) for c, k in got)
            rows.append((lang, lot, squeeze(text.encode()), squeeze(weights.tobytes()), n))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))],
            names=names)

    def send(batches):
        codes, held, chars = _Codes(), {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                by: dict = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    for chunk in parse(texts, codes, longest):
                        key = lang, chunk
                        if key in held:
                            held[key] += 1
                        else:
                            held[key] = 1
                            chars += len(chunk)
                if chars > HELD_CHARS:
                    yield packed(held)
                    held, chars = {}, 0
        if held:
            yield packed(held)

    def meet(batches):
        now, held = None, {}
        for batch in batches:
            for lang, lot, chunks, weights in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if lot != now and held:
                    yield packed(held)
                    held = {}
                now = lot
                for chunk, k in zip(_open(chunks).decode().split(BETWEEN), np.frombuffer(_open(weights), "<i8").tolist()):
                    held[lang, chunk] = held.get((lang, chunk), 0) + k
        if held:
            yield packed(held)

    rows = docs.mapInArrow(send, schema)
    return (rows.select(names[:4]).repartition(min(lots, MOST_PARTITIONS), "lot").sortWithinPartitions("lot")
            .mapInArrow(meet, schema))


def _open(blob: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob)


# --------------------------------------------------------------------- count

class Lot:
    """The phrases that the chunks of a lot own."""

    def __init__(self, lang: str, chunks: bytes, weights: bytes, longest: int):
        import xxhash
        text = _open(chunks).decode()
        each = text.split(BETWEEN)
        sizes = np.fromiter((c.count(" ") + 1 for c in each), np.int64, len(each))
        number: dict = {}
        tokens = text.replace(BETWEEN, " ").split(" ")
        self.ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int32, len(tokens))
        self.words = list(number)
        seed = xxhash.xxh64_intdigest(lang)
        code = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.x = code[self.ids]
        brk = self.ids == number.get(BREAK, -1)
        # words that follow without a break, from each place on
        n = len(tokens)
        at = np.where(brk, np.arange(n), n)
        self.run = np.minimum.accumulate(at[::-1])[::-1] - np.arange(n)
        ends = np.repeat(np.cumsum(sizes), sizes)
        owned = np.arange(n) < ends - (longest - 1 or 1)
        self.run[~owned] = 0
        self.weight = np.repeat(np.frombuffer(_open(weights), "<i8"), sizes)

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.run >= n)

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of n words."""
        at = self.starts(n)
        return at, _rolled(self.x, n)[at] if len(at) else np.empty(0, np.uint64)


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 bits, of a hash."""
    low = h & np.uint64(0xFFFFFFFF)
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | _mix(h) & np.uint64(0xFFFFFFFF) ^ low


def _sums(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2 ** 56) in order and their weights, both clipped at ``least``."""
    both = np.sort(keys << np.uint64(8) | np.minimum(weights, least).astype(np.uint64))
    keys = both >> np.uint64(8)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat((both & np.uint64(255)).astype(np.int64), first) if len(first) else first
    return keys[first], np.minimum(sums, least)


def _selected(lots: DataFrame, buckets: int, least: int, longest: int) -> DataFrame:
    """lang, lot, bucket, keys: what of a lot is found ``least`` times, with
    hashes that fell together counted as one."""
    clip = min(least, 255)

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, lot, chunks, weights = (batch.column(k)[i].as_py() for k in range(4))
                have = Lot(lang, chunks, weights, longest)
                keys, got = [], []
                for n in range(1, longest + 1):
                    at, h = have.hashes(n)
                    keys.append(_key(h, buckets))
                    got.append(have.weight[at])
                keys, got = _sums(np.concatenate(keys), np.concatenate(got), clip)
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                mine, first = np.unique(bucket, return_index=True)
                last = np.append(first[1:], len(keys))
                keys, got = keys.astype(np.uint32), got.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(mine), pa.string()), pa.array([lot] * len(mine), pa.int64()), pa.array(mine, pa.int64()),
                     pa.array([keys[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                     pa.array([got[a:b].tobytes() for a, b in zip(first, last)], pa.binary())],
                    names=["lang", "lot", "bucket", "keys", "weights"])

    def settle(rows, bucket):
        keys = [np.frombuffer(r[2], "<u4") for r in rows]
        all_keys = np.concatenate(keys)
        found, sums = _sums(all_keys.astype(np.uint64), np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]), clip)
        enough = found[sums >= clip].astype(np.uint32)
        if not len(enough):
            return
        at = np.minimum(np.searchsorted(enough, all_keys), len(enough) - 1)
        hit, place, out = enough[at] == all_keys, 0, []
        for (lang, lot, *_), k in zip(rows, keys):
            mine = k[hit[place:place + len(k)]]
            place += len(k)
            if len(mine):
                out.append((lang, lot, bucket, mine.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
            names=["lang", "lot", "bucket", "keys"])

    def meet(batches):
        now, rows = None, []
        for batch in batches:
            for lang, lot, bucket, keys, weights in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if bucket != now and rows:
                    yield from settle(rows, now)
                    rows = []
                now = bucket
                rows.append((lang, lot, keys, weights))
        if rows:
            yield from settle(rows, now)

    sent = lots.select("lang", "lot", "chunks", "weights").mapInArrow(
        send, "lang string, lot long, bucket long, keys binary, weights binary")
    return (sent.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(meet, "lang string, lot long, bucket long, keys binary"))


def _recounted(lots: DataFrame, selected: DataFrame, buckets: int, longest: int) -> DataFrame:
    """lang, phrase, f: selected phrases of each lot with their whole weight."""

    def count(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})
        wanted = np.sort(np.concatenate([
            np.uint64(b) << np.uint64(32) | np.frombuffer(k, "<u4").astype(np.uint64)
            for b, k in zip(right["bucket"].to_pylist(), right["keys"].to_pylist())]))
        quick = np.zeros(1 << 22, bool)
        quick[wanted & np.uint64((1 << 22) - 1)] = True
        lang = left["lang"][0].as_py()
        phrases, f = [], []
        for r in range(left.num_rows):
            have = Lot(lang, left["chunks"][r].as_py(), left["weights"][r].as_py(), longest)
            for n in range(1, longest + 1):
                at, h = have.hashes(n)
                k = _key(h, buckets)
                some = np.flatnonzero(quick[k & np.uint64((1 << 22) - 1)])
                at, h, k = at[some], h[some], k[some]
                some = wanted[np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)] == k
                at, h = at[some], h[some]
                if not len(at):
                    continue
                order = np.argsort(h, kind="stable")
                at, h = at[order], h[order]
                new = np.append(True, h[1:] != h[:-1])
                same = np.ones(len(at), bool)
                for j in range(n):
                    same[1:] &= have.ids[at[1:] + j] == have.ids[at[:-1] + j]
                if (same[1:] == new[1:]).any():        # other words under one hash: order by the words themselves
                    order = np.lexsort([have.ids[at + j] for j in range(n)])
                    at = at[order]
                    new = np.zeros(len(at), bool)
                    new[0] = True
                    for j in range(n):
                        new[1:] |= have.ids[at[1:] + j] != have.ids[at[:-1] + j]
                first = np.flatnonzero(new)
                f.append(np.add.reduceat(have.weight[at], first))
                words = have.words
                phrases += [" ".join([words[i] for i in p]) for p in
                            have.ids[at[first][:, None] + np.arange(n)].tolist()]
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()),
                         "f": pa.array(np.concatenate(f) if f else np.empty(0, np.int64), pa.int64())})

    return lots.select("lang", "lot", "chunks", "weights").groupBy("lang", "lot").cogroup(
        selected.groupBy("lang", "lot")).applyInArrow(count, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                     longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of every phrase of 1 to ``longest`` words found
    ``least`` times (2 to 255) in its language, and (lang, n) with the number of words."""
    if not 2 <= least <= 255 or longest < 1:
        raise ValueError(f"least from 2 to 255 and longest from 1, got {least} and {longest}")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).alias("text")).where("text != ''")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    lots = saved(_dictionary(rows, max(16, -(-chars // LOT_CHARS)), longest), "phrase-lots")
    buckets = max(16, -(-chars // BUCKET_CHARS))
    if buckets >= 1 << 24:
        raise ValueError("more texts than 2 ** 24 buckets are meant for; raise BUCKET_CHARS")
    chosen = _selected(lots, buckets, least, longest)
    found = (_recounted(lots, chosen, buckets, longest).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
             .where(F.col("f") >= least))
    return saved(found, "phrases"), lots.groupBy("lang").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------- score

def _wide(c) -> F.Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def scored(found: DataFrame, covered_percent: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that
    no longer one covers: the lowest of floor(2000000 a / (l + r)) over the cuts
    into a first part found l times and a rest found r times."""
    w = F.split("phrase", " ")
    long_ = found.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.size(w).alias("k")).where("k > 1")

    def part(cut, side):
        first = F.array_join(F.slice("w", F.lit(1), cut), " ")
        return F.when(side == 0, first).otherwise(F.array_join(F.slice("w", cut + 1, F.col("k") - cut), " "))

    sides = (long_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
             .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
             .select("lang", "phrase", "a", "cut", "side", part(F.col("cut"), F.col("side")).alias("part")))
    known = found.select("lang", F.col("phrase").alias("part"), "f")
    cuts = (sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
            .agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"),
                 F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")))
    score = F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = (cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.score", "b.l", "b.r"))
    inside = (long_.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
              .select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"),
                      F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    covered = _wide("longer") * F.lit(100) >= _wide("a") * F.lit(covered_percent)
    return (best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
            .select("lang", "phrase", "a", "l", "r", "score"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 longest: int = LONGEST, best: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each
    language by score, a (both descending) and phrase."""
    found, words = frequent_phrases(docs, lang_col, text_col, least, longest)
    got = saved(scored(found), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first: no task ranks a whole language
    shares = max(1, -(-got.count() // RANKED_AT_ONCE))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    got = got.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= best)
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return got.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
