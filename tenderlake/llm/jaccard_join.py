"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word ``width``-grams (3 unless the caller says); two link
when their Jaccard similarity is ``percent`` hundredths or more (90 unless the
caller says; 67 to 99).  The join is exact (grams are compared by 64-bit hash):

1. Equal sets are one class (digest of the sorted set); only one document of
   a class goes on.
2. Linked sets of sizes x, y differ in at most (x + y) (1 - t) / (1 + t) grams
   at the threshold t, (x + y) / 19 at 0.9.  A set is dealt by gram hash into more segments than that, so linked sets agree on
   whole segments; each segment's hash is an inverted list of sets.  Sets are
   compared within size classes a factor 1.5 wide; a set near a border is
   dealt for both classes.
3. There are ``spare`` more segments than needed, so linked sets share T =
   ``spare`` + 1 lists.  The lists' entries travel once, packed, to the bucket
   of their list, where lists of one set end (equal sets of a batch send one
   entry, and of a list with more than ``LONG`` sets in one batch only as many
   go to its bucket as show that).  Lists over ``LONG`` sets are put aside; the short ones
   are merged, which counts for pairs of sets how many they share, and pairs
   found T - L times are candidates, where L long lists are the fewer of the
   two sets' (DivideSkip's bound, on segments).  Sets with more than ``spare``
   long lists may share long lists only; they meet there, each with the list's
   first.
4. Sets connected so are a family: everything that can link.  Families are
   bounded blocks of sets (a larger family is several, see below).  In a
   block every set is a query: its grams' inverted lists are ordered by
   length, the L longest are put aside (DivideSkip's choice of L), the short
   ones are heap-merged and sets found T - L times are candidates; these are
   probed in the long lists by binary search, until the overlap is known.
   Candidates already connected to the query need no probe.
5. A family of several blocks shares a few pivots with each block, which
   connects what is common.  The sets outside the family's largest component
   are then dealt to parts of their own, and so is that component; each part
   of the rest asks each part of the component and each part of the rest, a
   pair of parts a block.  No block holds more than two parts, however large
   the rest is; the number of blocks grows with rest parts x parts.

Nothing of all documents is gathered in one task or at the driver, and no
pairs are made within lists.

Defined cases: documents without words (null, empty, white space) have an
empty set and link with nothing; with fewer words than ``width`` the whole
sequence is the set; repeated rows are equal sets, one class; a null id never is a
component id unless its component has no other; further columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import releasing, saved
from tenderlake.llm.components import components

N, NUMERATOR, DENOMINATOR = 3, 90, 100
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WIDER = 1.5                      # a linked set is at most one size class away from 0.67 on
LONG = 16                        # most sets on a short list
BLOCK_GRAMS = 4_000_000          # grams of a block
BATCH_GRAMS = 2_000_000          # grams of the sets dealt at a time
BUCKET_CHARS = 8_000_000         # texts that a bucket of lists stands for
MOST_PARTITIONS = 16_384
PIVOTS = 16
MU = 0.0085                      # DivideSkip's cost ratio of a probe to a merge
HEAP_MOST = 2000                 # list entries merged with a heap; more are merged by counting


# -------------------------------------------------------------------- sets

def _mix(x: np.ndarray) -> np.ndarray:
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


class _Codes(dict):
    """64-bit codes of words, remembered."""

    def __missing__(self, word):
        import xxhash
        if len(self) > 300_000:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x


def gram_set(text: str | None, codes: _Codes, width: int = N) -> np.ndarray:
    """Sorted distinct gram hashes of a text, ASCII letters in lower case."""
    if not text:
        return np.empty(0, np.uint64)
    words = WORDS.findall(text.encode().lower().decode())
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(x))
    h = np.full(len(x) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k:len(h) + k]
    return np.unique(_mix(h))


def first_size(percent: int) -> int:
    """Sets of fewer grams only link when equal."""
    return -(-percent // (DENOMINATOR - percent))


def size_bounds(most: int, percent: int = NUMERATOR) -> list[int]:
    """Lower bounds of the size classes up to a size."""
    out = [first_size(percent)]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * WIDER)))
    return out


def size_classes(n: int, percent: int = NUMERATOR) -> list[tuple[int, int, int]]:
    """(class, spare, number of segments) of each size class that sets of n
    grams are dealt in."""
    if n < first_size(percent):
        return []
    bounds = size_bounds(n, percent)
    own = max(j for j, b in enumerate(bounds) if b <= n)
    out = []
    for j in (own, own - 1):
        if j < 0 or (j < own and DENOMINATOR * (bounds[own] - 1) < percent * n):
            continue
        top = (bounds[j + 1] if j + 1 < len(bounds) else max(bounds[j] + 1, int(bounds[j] * WIDER))) - 1
        differ = (top + top * DENOMINATOR // percent) * (DENOMINATOR - percent) // (DENOMINATOR + percent)
        spare = 1 + (differ + 1) // 6
        out.append((j, spare, differ + 1 + spare))
    return out


def segments(grams: np.ndarray, percent: int = NUMERATOR) -> list[tuple[int, np.ndarray]]:
    """(spare, list keys) for each size class the set is dealt in."""
    out = []
    for j, spare, count in size_classes(len(grams), percent):
        sums = np.zeros(count, np.uint64)
        seg = (_mix(grams + np.uint64(j + 1)) >> np.uint64(20)) % np.uint64(count)
        np.add.at(sums, seg.astype(np.int64), _mix(grams))
        place = np.arange(j << 20, (j << 20) + count, dtype=np.uint64)
        keys = _mix(sums + place * np.uint64(0x9E3779B97F4A7C15))
        out.append((spare, keys))
    return out


def _sets(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key -> n, digest (two longs), spares: of each size class the set
    is dealt in."""
    schema = "doc_id long, key long, n long, d1 long, d2 long, spares array<int>"

    def run(batches):
        codes = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                n, d, spares = [], [], []
                for t in b.column(2).to_pylist():
                    g = gram_set(t, codes, width)
                    n.append(len(g))
                    d.append(_digest(g))
                    spares.append([c[1] for c in size_classes(len(g), percent)])
                d = np.array(d).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()),
                     pa.array(d[:, 1].copy()), pa.array(spares, pa.list_(pa.int32()))],
                    names=["doc_id", "key", "n", "d1", "d2", "spares"])

    return rows.mapInArrow(releasing(run), schema)


def _digest(grams: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), "<i8")


# ------------------------------------------------------------------ families

def _lists(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """list, cg, size: the entries of every list of two sets and more.  ``rows``:
    doc_id, h (63 bits of a document's own), text; cg is 2 h + which of its (at
    most two) dealings."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    names = ["bucket", "sure", "lists", "owners"]

    def packed(held: dict):
        """Rows for the buckets from the sets of a batch: (digest -> (doc_id, h, grams))."""
        lists, owners = [], []
        for _, h, grams in held.values():
            for g, (_, keys) in enumerate(segments(grams, percent)):
                lists.append(keys)
                owners.append(np.full(len(keys), h * 2 + g, np.int64))
        if not lists:
            return None
        lists, owners = np.concatenate(lists), np.concatenate(owners)
        order = np.lexsort((owners, lists))
        lists, owners = lists[order], owners[order]
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        place = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        out = []
        # of a list that is long already, what shows it goes to its bucket; the rest is dealt evenly
        for sure, mine in ((False, np.flatnonzero(place <= LONG)), (True, np.flatnonzero(place > LONG))):
            x, o = lists[mine], owners[mine]
            bucket = (((_mix(o.view(np.uint64)) if sure else x) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            by = np.argsort(bucket, kind="stable")
            x, o, bucket = x[by], o[by], bucket[by]
            which, start = np.unique(bucket, return_index=True)
            for b, i, j in zip(which.tolist(), start.tolist(), np.append(start[1:], len(x)).tolist()):
                out.append((b, sure, x[i:j].tobytes(), o[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (
            pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=names)

    def deal(batches):
        codes, held, size = _Codes(), {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                for doc_id, h, t in zip(*[b.column(i).to_pylist() for i in range(3)]):
                    g = gram_set(t, codes, width)
                    if len(g) < first_size(percent):
                        continue
                    d, row = _digest(g).tobytes(), (doc_id is None, doc_id or 0, h)
                    if d not in held:
                        size += len(g)
                    if d not in held or row < held[d][0]:      # of equal sets the first document's
                        held[d] = row, h, g
                if size > BATCH_GRAMS:
                    got = packed(held)
                    if got is not None:
                        yield got
                    held, size = {}, 0
        got = packed(held) if held else None
        if got is not None:
            yield got

    def settle(rows):
        for sure, x, o in ((True, *_joined(rows, True)), (False, *_joined(rows, False))):
            if not len(x):
                continue
            size = np.full(len(x), LONG + 1)
            if not sure:
                order = np.argsort(x, kind="stable")
                x, o = x[order], o[order]
                _, at, count = np.unique(x, return_inverse=True, return_counts=True)
                size = count[at]
                many = size > 1
                x, o, size = x[many], o[many], size[many]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(o), pa.array(size.astype(np.int64))],
                                             names=["list", "cg", "size"])

    def meet(batches):
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if bucket != now and rows:
                    yield from settle(rows)
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            yield from settle(rows)

    dealt = rows.select("doc_id", "h", "text").mapInArrow(releasing(deal), "bucket long, sure boolean, lists binary, owners binary")
    return (dealt.repartition(min(int(buckets), MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(releasing(meet), "list long, cg long, size long"))


def _joined(rows: list, sure: bool) -> tuple[np.ndarray, np.ndarray]:
    mine = [r for r in rows if r[0] == sure]
    return (np.frombuffer(b"".join(r[1] for r in mine), "<u8"), np.frombuffer(b"".join(r[2] for r in mine), "<i8"))


def _families(rows: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root): documents (by h) that candidate pairs connect.  ``sets``:
    h, n, spares."""
    on = saved(_lists(rows, width, percent), "join-lists")
    short, long_ = on.where(F.col("size") <= LONG), on.where(F.col("size") > LONG)
    # rows that repeat a document are one
    about = (sets.select("h", "n", F.posexplode("spares").alias("g", "spare"))
             .select((F.col("h") * 2 + F.col("g")).alias("cg"), "n", "spare").join(on.select("cg").distinct(), "cg", "left_semi")
             .groupBy("cg").agg(F.max("n").alias("n"), F.max("spare").alias("spare")))
    longs = long_.groupBy("cg").agg(F.count(F.lit(1)).alias("longs"))
    about = about.join(longs, "cg", "left").withColumn("longs", F.coalesce("longs", F.lit(0)))

    # pairs on short lists (at most LONG sets each) and the lists they share
    x, y = (short.select("list", F.col("cg").alias(k)) for k in ("x", "y"))
    pairs = x.join(y, "list").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    ax, ay = (about.select(*[F.col(c).alias(f"{k}_{c}") for c in about.columns]) for k in ("x", "y"))
    near = (pairs.join(ax, F.col("x") == F.col("x_cg")).join(ay, F.col("y") == F.col("y_cg"))
            .where((F.col("shared") > F.col("x_spare") - F.least("x_longs", "y_longs", "x_spare"))
                   & (DENOMINATOR * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")))
            .select(F.col("x").alias("cg"), F.col("y").alias("first")))

    many = about.where("longs > spare").select("cg")
    meet = long_.join(many, "cg", "left_semi").select("list", "cg")
    firsts = meet.groupBy("list").agg(F.min("cg").alias("first"))
    edges = near.unionByName(meet.join(firsts, "list").select("cg", "first")).select(
        F.shiftright("cg", 1).alias("a"), F.shiftright("first", 1).alias("b"))
    return components(edges, name="join-families")


# -------------------------------------------------------------------- search

def link_block(sizes: np.ndarray, grams: np.ndarray, asks: np.ndarray, percent: int = NUMERATOR) -> list[tuple[int, int]]:
    """Links that connect the sets of a block as all its links do.

    ``grams``: the sets one after the other, ``sizes`` long each; ``asks``:
    which sets are queries (a link between two others may be left out)."""
    count = len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    _, gram = np.unique(grams, return_inverse=True)
    owner = np.repeat(np.arange(count), sizes)
    order = np.argsort(gram, kind="stable")       # sets of a list stay in order
    held = owner[order]
    length = np.bincount(gram)
    list_end = np.cumsum(length)
    list_begin = list_end - length
    root = np.arange(count)
    links = []
    for q in np.flatnonzero(asks).tolist():
        n = int(sizes[q])
        need = -(-percent * n // DENOMINATOR)           # T
        mine = gram[begins[q]:ends[q]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        longest = int(length[mine[-1]])
        aside = min(need - 1, int(need / (MU * math.log2(max(2, longest)) + 1)))   # L
        short, long_ = mine[:n - aside], mine[n - aside:]
        if length[short].sum() == len(short):
            continue                                       # nobody else is on the short lists
        if length[short].sum() <= HEAP_MOST:
            found: dict[int, int] = {}
            for x in heapq.merge(*[held[list_begin[g]:list_end[g]].tolist() for g in short.tolist()]):
                found[x] = found.get(x, 0) + 1
            near = np.array([x for x, k in found.items() if k >= need - aside], np.int64)
            seen = np.array([found[x] for x in near.tolist()], np.int64)
        else:
            hits = np.bincount(np.concatenate([held[list_begin[g]:list_end[g]] for g in short.tolist()]),
                               minlength=count)
            near = np.flatnonzero(hits >= need - aside)
            seen = hits[near]
        fits = ((root[near] != root[q]) & (DENOMINATOR * np.minimum(sizes[near], n)
                                           >= percent * np.maximum(sizes[near], n)))
        near, seen = near[fits], seen[fits]
        if len(near) > 32:
            # many candidates: all long lists are counted at once
            seen = np.bincount(np.concatenate([held[list_begin[g]:list_end[g]] for g in mine.tolist()]),
                               minlength=count)[near]
            probe = False
        else:
            probe = True
        for x, k in sorted(zip(near.tolist(), seen.tolist()), key=lambda p: -p[1]):
            if root[x] == root[q]:
                continue
            if probe:
                for g in long_.tolist():
                    b, e = list_begin[g], list_end[g]
                    at = b + np.searchsorted(held[b:e], x)
                    k += bool(at < e and held[at] == x)
            if DENOMINATOR * k >= percent * (n + int(sizes[x]) - k):
                links.append((q, x))
                root[root == root[x]] = root[q]
    return links


def _search(blocks: DataFrame, name: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) within blocks.  ``blocks``: block, c, asks, text."""
    def to_sets(batches):
        codes = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                got = [gram_set(t, codes, width).tobytes() for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.binary())],
                                                 names=["block", "c", "asks", "grams"])

    def settle(rows):
        c, asks, grams = [], [], []
        at: dict[int, int] = {}
        for x, y, g in rows:                # repeated rows of a document are one set
            if x in at:
                asks[at[x]] |= y
            else:
                at[x] = len(c)
                c.append(x)
                asks.append(y)
                grams.append(np.frombuffer(g, np.uint64))
        if len(c) < 2:
            return None
        found = link_block(np.array([len(g) for g in grams]), np.concatenate(grams), np.array(asks), percent)
        return [c[i] for i, _ in found], [c[j] for _, j in found]

    def run(batches):
        now, rows = None, []

        def out():
            got = settle(rows)
            if got and got[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

        for batch in batches:
            for block, *row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if block != now and rows:
                    yield from out()
                    rows = []
                now = block
                rows.append(row)
        if rows:
            yield from out()

    sets = blocks.select("block", "c", "asks", "text").mapInArrow(
        releasing(to_sets), "block long, c long, asks boolean, grams binary")
    return saved(sets.repartition("block").sortWithinPartitions("block", "c")
                 .mapInArrow(releasing(run), "a long, b long"), name)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            block_grams: int = BLOCK_GRAMS, width: int = N, percent: int = NUMERATOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (hash of the text), n_shingles,
    component_id and ``kept`` (one row of each component)."""
    if width < 1 or not 67 <= percent <= 99:
        raise ValueError(f"width from 1 and percent from 67 to 99, got {width} and {percent}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"),
                         F.col(text_col).alias("text"))
    sets = saved(_sets(source.select("doc_id", "key", "text"), width, percent).withColumn(
        "row", F.monotonically_increasing_id()), "join-sets")
    # 1. classes of equal sets; the row of the first document stands for its class
    own = F.shiftright(F.xxhash64("doc_id", "key"), 1).alias("h")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), own, F.col("row").alias("r"))
    equal = saved(sets.where("n > 0").groupBy("d1", "d2").agg(F.min(order).alias("o"))
                  .select("d1", "d2", F.col("o.r").alias("c"), F.col("o.d").alias("first_id")), "join-classes")
    nodes = sets.join(equal.select(F.col("c").alias("row")), "row", "left_semi").withColumnRenamed("row", "c")
    family = saved(_families(source.select("doc_id", own, "text"), sets.select(own, "n", "spares"), width, percent), "join-family")

    # 4. blocks of families
    sized = family.select(F.col("node").alias("h"), F.col("root").alias("family")).join(
        nodes.select("c", "doc_id", "key", "n", own), "h").drop("h")
    total = sized.groupBy("family").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("sets"))
    total = total.withColumn("parts", F.ceil(F.col("grams") / block_grams))
    member = sized.join(total, "family").withColumn("part", F.pmod(F.xxhash64("c"), "parts"))
    pivot = F.pmod(F.xxhash64(F.lit(1), "c"), F.col("sets")) < PIVOTS
    member = saved(member.select("c", "doc_id", "key", "family", "part", "parts", pivot.alias("pivot")), "join-member")

    def block(family, part):
        return F.xxhash64(family, part)

    def with_text(m: DataFrame) -> DataFrame:
        m = m.select("block", "c", "asks", F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
        return source.join(m.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d"))
                          & (F.col("key") == F.col("_k")))

    parts = F.when(F.col("pivot") & (F.col("parts") > 1), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
                   ).otherwise(F.array("part"))
    first = member.withColumn("p", F.explode(parts)).select(
        block(F.col("family"), F.col("p")).alias("block"), "c", F.lit(True).alias("asks"), "doc_id", "key")
    links = _search(with_text(first), "join-links", width, percent)

    # 5. families of several blocks: the rest asks the other blocks
    several = member.where("parts > 1")
    if not several.isEmpty():
        so_far = components(links, name="join-so-far")
        placed = several.join(so_far, several["c"] == so_far["node"], "left").withColumn(
            "root", F.coalesce("root", "c")).drop("node")
        most = (placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k"))
                .groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main")))
        # a part of the rest (i) meets the parts of the largest component and of the rest (j), two parts a block
        sided = placed.join(most, "family").join(nodes.select("c", "n"), "c").withColumn("rest", F.col("root") != F.col("main"))
        dealt = sided.groupBy("family").agg(*[F.greatest(F.ceil(F.sum(F.when(F.col("rest") == side, F.col("n")).otherwise(0))
                                                                / block_grams), F.lit(0)).alias(k)
                                              for k, side in (("rests", True), ("mains", False))])
        sided = sided.join(dealt, "family").where("rests > 0").withColumn("i", F.pmod(
            F.xxhash64(F.lit(2), "c"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))))

        def to(least: int | str, most: str):
            least, most = (F.expr(str(x)).cast("long") for x in (least, most))
            return F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<long>"))

        rest, main = sided.where("rest"), sided.where(~F.col("rest"))
        cols = ["family", "i", "j", "asks", "c", "doc_id", "key"]
        # j under ``rests`` is a part of the rest, from there on one of the component
        second = (rest.withColumn("j", F.explode(to("i", "rests + mains - 1"))).withColumn("asks", F.lit(True)).select(*cols)
                  .unionByName(rest.withColumn("j", F.col("i")).withColumn("i", F.explode(to(0, "i - 1")))
                               .withColumn("asks", F.lit(False)).select(*cols))
                  .unionByName(main.withColumn("j", F.col("i") + F.col("rests")).withColumn("i", F.explode(to(0, "rests - 1")))
                               .withColumn("asks", F.lit(False)).select(*cols)))
        second = second.select(F.xxhash64("family", "i", "j").alias("block"), "c", "asks", "doc_id", "key")
        links = links.unionByName(_search(with_text(second), "join-links", width, percent))

    linked = components(links, name="join-components")
    known = equal.join(linked, equal["c"] == linked["node"], "left").select(
        "d1", "d2", F.coalesce("root", "c").alias("root"), F.struct(
            F.col("first_id").isNull().alias("x"), F.col("first_id").alias("id"), F.col("c").alias("row")).alias("o"))
    least = known.groupBy("root").agg(F.min("o").alias("first"))
    known = known.join(least, "root").select("d1", "d2", "first")
    return (sets.where("n > 0").join(known, ["d1", "d2"])
            .select("doc_id", "key", "n", F.col("first.id").alias("component_id"),
                    (F.col("row") == F.col("first.row")).alias("kept"))
            .unionByName(sets.where("n = 0").select(
                "doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
            .withColumnRenamed("n", "n_shingles"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = N,
                percent: int = NUMERATOR) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each
    component the document with the smallest id, and every document without
    words."""
    stay = classes(docs, id_col, text_col, width=width, percent=percent).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.col("key").alias("_k")).distinct()
    cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*cols, F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("")).alias("_d"),
                       F.xxhash64(f"`{text_col}`").alias("_k"), F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]").alias("_w"))
    got = rows.join(stay.hint("shuffle_hash"), ["_d", "_k"], "left_semi")
    # fully repeated rows of the document that stays are one
    once = got.where("_w").dropDuplicates(["_d", "_k"]).unionByName(got.where(~F.coalesce("_w", F.lit(False))))
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
