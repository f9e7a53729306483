"""Substring deduplication by super-k-mer partitioning.

Every run of ``WIDTH`` consecutive words of one document is a window.  A word
goes if a window over it has a word sequence that also starts in a document
with a smaller id.  Windows are judged on the input.

1. Documents are worked on in batches.  A batch first settles its own
   repeats: of equal windows only those of its smallest document id travel on
   (this is the combine before the shuffle: a passage in a third of all
   documents leaves a batch once).
2. Consecutive windows that share a minimiser (the smallest hash among their
   runs of three words that aren't frequent; frequent ones are counted first, on
   a sample and on all very long texts; where all are frequent, the hash of the
   whole window) form a super-k-mer; it travels as one packed string, to
   the bucket of its minimiser.  Equal windows have equal minimisers, so they
   meet.  The strings of one batch and bucket share one compressed row.
3. A bucket sorts all its windows and finds equal ones exactly (by a hash,
   then word for word); windows of larger documents give cut intervals.
4. The intervals of each document, gathered by document, are cut from its
   text.

The number of buckets follows the size of the input.  A minimiser's strings
meet in one bucket; they are about ``FREQUENT`` at most, as runs of words with
more places are no minimisers, so a line in many documents spreads over its
neighbours' buckets.  The sample decides on the dealing only: equal windows have
equal keys whatever it holds.

Defined cases: a null text has no words; texts under ``WIDTH`` words lose
nothing; rows that repeat an id are separate texts with that id (none is
smaller); a row without an id keeps its text and takes nothing from others;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.llm.common import add_columns

WIDTH, MINIMISER = 13, 3
BATCH_CHARS = 4_000_000      # texts worked on at a time
BUCKET_CHARS = 8_000_000     # text that a bucket stands for, on average
FREQUENT = 50_000            # most strings (of up to 2 x WIDTH words) that a minimiser should get
SAMPLE_CHARS, LEAST_SHARE, LONG_TEXT = 16_000_000, 1 / 64, 1_000_000
LEVEL = 6                    # of compression
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values."""
    n = len(x) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k:n + k]
    return _mix(out)


class _Numbers(dict):
    """Words to consecutive numbers."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def repeated(ids: np.ndarray, starts: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window (place of its first word in ``ids``, document id): does
    the same word sequence start in a document with a smaller id?"""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    h = _rolled(_mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), width)[starts]
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    if not same.any():
        return out
    member = np.append(same, False) | np.append(False, same)
    order, h = order[member], h[member]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    d, at = doc[order], starts[order]
    least = np.minimum.reduceat(d, first)
    # only groups over several documents matter; check them word for word
    some = (np.maximum.reduceat(d, first) > least)[group]
    odd = np.zeros(len(h), bool)
    lead = at[first][group]
    for k in range(width):
        odd |= some & (ids[at + k] != ids[lead + k])
    out[order] = d > least[group]
    for g in np.unique(group[odd]).tolist():       # equal hashes of different windows
        best: dict[tuple, int] = {}
        rows = np.flatnonzero(group == g).tolist()
        seq = {r: tuple(ids[at[r]:at[r] + width].tolist()) for r in rows}
        for r in rows:
            best[seq[r]] = min(best.get(seq[r], d[r]), d[r])
        for r in rows:
            out[order[r]] = d[r] > best[seq[r]]
    return out


def _runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive starts with equal values."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.diff(starts) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.append(0, np.flatnonzero(cut) + 1)
    return first, np.append(first[1:] - 1, len(starts) - 1)


_ARRAYS = (("docs", "<i8"), ("keys", "<i8"), ("seg_doc", "<i4"), ("seg_pos", "<i4"), ("seg_words", "<i4"),
           ("cut_doc", "<i4"), ("cut_start", "<i4"), ("cut_end", "<i4"))


def _pack(text: str, **arrays) -> bytes:
    import zstandard
    parts = [np.asarray(arrays[n], dtype=t).tobytes() for n, t in _ARRAYS]
    head = np.array([len(p) for p in parts], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(parts) + text.encode())


def _unpack(blob: bytes) -> tuple[str, dict[str, np.ndarray]]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(_ARRAYS), {}
    for (n, t), size in zip(_ARRAYS, np.frombuffer(raw, "<i8", len(_ARRAYS)).tolist()):
        out[n] = np.frombuffer(raw[at:at + size], t)
        at += size
    return raw[at:].decode(), out


def _places(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and their places in the texts; places of which one window can hold
    two count once."""
    import xxhash
    numbers = _Numbers()
    found = [numbers.of(WORDS.findall(t)) for t in texts]
    code = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    sizes = np.array([len(x) for x in found])
    if not sizes.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    # one long row; texts lie a window apart
    grams = _rolled(code[np.concatenate(found)], MINIMISER)
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = text[:len(grams)] == text[MINIMISER - 1:]
    at = (np.arange(len(grams)) + text[:len(grams)] * width)[whole]
    grams = grams[whole]
    order = np.argsort(grams, kind="stable")
    grams, at = grams[order], at[order]
    first = np.append(True, grams[1:] != grams[:-1])[:len(grams)]
    counts = first | np.append(True, np.diff(at) > width - MINIMISER)[:len(grams)]
    begin = np.flatnonzero(first)
    return grams[begin], np.add.reduceat(counts.astype(np.int64), begin) if len(begin) else np.empty(0, np.int64)


def frequent(rows: DataFrame, chars: int, width: int) -> np.ndarray:
    """Sorted hashes of the runs of ``MINIMISER`` words with over ``FREQUENT``
    places, estimated.  ``rows``: doc_id, key, text."""
    share = min(1.0, max(LEAST_SHARE, SAMPLE_CHARS / max(chars, 1)))
    long_ = F.length("text") >= LONG_TEXT
    picked = F.pmod(F.xxhash64(F.lit(9), "doc_id", "key"), F.lit(1 << 20)) < int(share * (1 << 20))
    part = rows.where(long_ | picked).select(F.when(long_, 1.0).otherwise(1 / share).alias("weight"), "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                weights, texts = (batch.slice(at, 256).column(i).to_pylist() for i in range(2))
                for w in set(weights):
                    grams, n = _places([t for t, x in zip(texts, weights) if x == w], width)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n * w)],
                                                     names=["gram", "places"])

    many = part.mapInArrow(run, "gram long, places double").groupBy("gram").agg(F.sum("places").alias("places"))
    got = many.where(F.col("places") > FREQUENT).select("gram").collect()     # words of the input / FREQUENT at most
    return np.sort(np.array([r.gram for r in got], np.int64).view(np.uint64))


def _batch(rows: list[tuple[int, int, str]], buckets: int, width: int, common: np.ndarray = np.empty(0, np.uint64)):
    """(bucket, packed row) of a batch of (document id, key, text).  ``common``:
    grams that are no minimisers."""
    import xxhash
    numbers = _Numbers()
    words: list[str] = []
    sizes = []
    for _, _, text in rows:
        w = WORDS.findall(text)
        sizes.append(len(w))
        words += w
    sizes = np.array(sizes)
    base = np.cumsum(sizes) - sizes
    if not len(words):
        return
    ids = numbers.of(words)
    row_of = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(words))
    starts = np.flatnonzero(place - base[row_of] <= sizes[row_of] - width)
    if not len(starts):
        return
    doc_ids, keys = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    gone = repeated(ids, starts, doc_ids[row_of[starts]], width)

    cut = starts[gone]
    a, b = _runs(cut, row_of[cut])
    cuts = (row_of[cut[a]], cut[a] - base[row_of[cut[a]]], cut[b] - base[row_of[cut[b]]] + width)

    starts = starts[~gone]
    code = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    grams = _rolled(code[ids], MINIMISER)
    span = width - MINIMISER + 1
    top = np.uint64(1 << 63)
    if len(common):
        place = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        grams = grams >> np.uint64(1) | np.where(common[place] == grams, top, np.uint64(0))
    least = grams[:len(grams) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, grams[k:len(grams) - span + 1 + k], out=least)
    least = least[starts]
    if len(common):
        only = least >= top
        least[only] = _rolled(code[ids], width)[starts[only]]
    a, b = _runs(starts, row_of[starts], least)
    bucket = (least[a] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, b, bucket = a[order], b[order], bucket[order]
    from_word, to_word = starts[a], starts[b] + width
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))[ids] + 1
    offset = np.append(0, np.cumsum(lengths))
    text = " ".join(words)
    left, right = offset[from_word].tolist(), (offset[to_word] - 1).tolist()
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    empty = np.empty(0, np.int64)
    for x, y in zip(edges, [*edges[1:], len(bucket)]):
        row = row_of[from_word[x:y]]
        mine, at = np.unique(row, return_inverse=True)
        yield int(bucket[x]), _pack(
            "\n".join([text[i:j] for i, j in zip(left[x:y], right[x:y])]),
            docs=doc_ids[mine], keys=keys[mine], seg_doc=at, seg_pos=from_word[x:y] - base[row],
            seg_words=to_word[x:y] - from_word[x:y], cut_doc=empty, cut_start=empty, cut_end=empty)
    if len(cuts[0]):
        mine, at = np.unique(cuts[0], return_inverse=True)
        yield int(code[ids[0]] % np.uint64(buckets)), _pack(
            "", docs=doc_ids[mine], keys=keys[mine], seg_doc=empty, seg_pos=empty, seg_words=empty,
            cut_doc=at, cut_start=cuts[1], cut_end=cuts[2])


def _bucket(blobs: list[bytes], width: int):
    """(document ids, keys, starts, ends) of the intervals that a bucket cuts."""
    texts, docs, keys, pos, sizes, out = [], [], [], [], [], []
    for blob in blobs:
        text, x = _unpack(blob)
        if len(x["cut_doc"]):
            out.append((x["docs"][x["cut_doc"]], x["keys"][x["cut_doc"]], x["cut_start"], x["cut_end"]))
        if len(x["seg_doc"]):
            texts.append(text)
            docs.append(x["docs"][x["seg_doc"]])
            keys.append(x["keys"][x["seg_doc"]])
            pos.append(x["seg_pos"])
            sizes.append(x["seg_words"])
    if texts:
        docs, keys, pos, sizes = (np.concatenate(x) for x in (docs, keys, pos, sizes))
        numbers = _Numbers()
        ids = np.concatenate([numbers.of(t.replace("\n", " ").split(" ")) for t in texts])
        base = np.cumsum(sizes, dtype=np.int64) - sizes
        seg = np.repeat(np.arange(len(sizes)), sizes - width + 1)
        n_before = np.cumsum(sizes - width + 1, dtype=np.int64) - (sizes - width + 1)
        starts = base[seg] + np.arange(len(seg)) - n_before[seg]
        gone = repeated(ids, starts, docs[seg], width)
        s, at = seg[gone], starts[gone]
        a, b = _runs(at, s)
        s = s[a]
        first = pos[s] + at[a] - base[s]
        out.append((docs[s], keys[s], first, first + (at[b] - at[a]) + width))
    return out


def intervals(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """doc_id, key (hash of the text) and cut intervals ``start``, ``end`` in
    words; intervals may overlap."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    common = frequent(rows, chars, width)

    def deal(batches):
        held, size = [], 0

        def flush():
            got = list(_batch(held, buckets, width, common))
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())],
                names=["bucket", "packed"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for r in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    held.append(r)
                    size += len(r[2])
                    if size >= BATCH_CHARS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def settle(batches):
        def out(blobs):
            for got in _bucket(blobs, width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(x, dtype=t)) for x, t in zip(got, ("<i8", "<i8", "<i4", "<i4"))],
                    names=["doc_id", "key", "start", "end"])

        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and blobs:
                    yield from out(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from out(blobs)

    dealt = rows.mapInArrow(deal, "bucket long, packed binary")
    return (dealt.repartition(int(buckets), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(settle, "doc_id long, key long, start int, `end` int"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and ``kept``,
    the words that stay, joined by one blank."""
    cuts = intervals(docs, id_col, text_col, width).groupBy("doc_id", "key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"))

    def pack():
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return lambda texts: [[squeeze((t or "").encode()) for t in texts]]

    # texts travel to their intervals compressed
    rows = add_columns(rows, ["_id", "doc_id", "key"], [F.col("_text")], {"_packed": (T.BinaryType(), pa.binary())}, pack)
    both = rows.join(cuts.hint("shuffle_hash"), ["doc_id", "key"], "left").select("_id", "_packed", "starts", "ends")

    def cut(packed, starts, ends):
        import zstandard
        open_ = zstandard.ZstdDecompressor().decompress
        total, gone, kept = [], [], []
        for p, first, last in zip(packed, starts, ends):
            words = WORDS.findall(open_(p).decode())
            n = len(words)
            if first:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.array(first), 1)
                np.add.at(edge, np.array(last), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            total.append(n)
            gone.append(n - len(words))
            kept.append(" ".join(words))
        return total, gone, kept

    long_ = T.LongType(), pa.int64()
    return add_columns(both, ["_id"], [F.col("_packed"), F.col("starts"), F.col("ends")],
                       {"n_words": long_, "n_removed": long_, "kept": (T.StringType(), pa.string())},
                       lambda: cut).withColumnRenamed("_id", id_col)
