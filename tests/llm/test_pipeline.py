"""Each stage of the pipeline against a plain version of its decision."""

import re
from collections import Counter

import pytest

import corpus_pipeline as C
from tenderlake.llm import sentencepiece_bpe, toxicity
from tenderlake.llm.common import saved

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        docs = saved(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages(spark, stages):
    source, clean, single, apart, mixed, encoded = stages
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "source_mixing", "sentencepiece"]
    for d in (clean, single, apart, mixed):
        assert d.columns == source.columns and d.dtypes == source.dtypes
    rows = [d.collect() for d in stages[:5]]
    # toxicity: what goes is what the classifier rejects, clean labelled documents stay
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in rows[1]}
    gone = [r.doc_id for r in rows[0] if r.doc_id not in left]
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(rows[0])
    # exact dedup: one row per text, the longest, then the smallest id
    best = {}
    for r in rows[1]:
        k = "".join(WORD.findall(r.text))
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert Counter(r.doc_id for r in rows[2]) == Counter(i for _, i in best.values())
    # near copies: the smallest id of each group of linked documents
    sets = {}
    for r in rows[2]:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in r.text))
        sets[r.doc_id] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by, root = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    find = lambda x: x if root[x] == x else find(root[x])
    for ids in by.values():
        for a, b in zip(ids, ids[1:]):
            x, y = sets[a], sets[b]
            if find(a) != find(b) and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert {r.doc_id for r in rows[3]} == {i for i in sets if find(i) == i}
    # mixing: no new rows, none over three times
    n = Counter(r.doc_id for r in rows[4])
    assert set(n) <= {r.doc_id for r in rows[3]} and max(n.values()) <= 3
    # encoding: every row, decoded to its text
    texts = {r.doc_id: r.text for r in rows[4]}
    back = sentencepiece_bpe.decode(encoded).collect()
    assert Counter(r.doc_id for r in back) == n and all(r.decoded == texts[r.doc_id] for r in back)


def test_run_is_the_stages(spark, stages):
    assert Counter(r.doc_id for r in C.run(spark, SF).select("doc_id").collect()) == Counter(
        r.doc_id for r in stages[-1].select("doc_id").collect())


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0),
                                 (2, "a b c", None, "src0", 5)], docs.schema)
    for name, stage in C.STAGES:
        odd = saved(stage(spark, odd, SF), f"odd-{name}")
    assert odd.count() >= 1
    none = docs.limit(0)
    for name, stage in C.STAGES:
        none = saved(stage(spark, none, SF), f"none-{name}")
    assert none.count() == 0
    assert toxicity.HELD_OUT == 0
