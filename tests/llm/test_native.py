"""Quality rules, exact dedup, chat formatting and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tenderlake.llm import chat, exact_dedup, mixing, quality_rules
from tenderlake.llm.common import shared_root

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "same\nsame\n\n \nsame\n",
         "# * | <b> $1 & 5% ok", "é漢𝄞 é漢𝄞\x0b\x0c\r z y", "p q r s t u v w " + " ".join(map(str, range(60))) + " p q r s t u v w"]


def _stats(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.with_statistics(df)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _stats(texts[r.doc_id]), r
    failed = {r.doc_id: r.base_failed for r in quality_rules.judge(got, [], quality_rules.base_rule()).collect()}
    for i, t in enumerate(texts):
        n, _, _, _, rep = _stats(t)
        assert failed[i] == (n < 20 or 100 * rep > 30 * n)


def test_quality_rules_learn(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        words = ["".join(rng.choice("abcdef") for _ in range(5)) + "#" * (bad and rng.random() < 0.5) for _ in range(40)]
        rows.append((i, " ".join(words), int(not bad)))
    rows += [(5000, None, 1), (5001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    stats = quality_rules.with_statistics(df, keep=("doc_id", "quality"))
    rules = quality_rules.learn(stats)
    assert rules and rules[0].good == 0 and rules[0].bad > 100
    got = quality_rules.judge(stats, rules, quality_rules.base_rule()).where("doc_id < 1500").collect()
    assert sum(r.kept == bool(r.quality) for r in got) > 1480
    # nothing to learn from: nothing is rejected by rules
    assert quality_rules.learn(stats.where("quality = 1")) == []
    assert quality_rules.learn(stats.limit(0)) == []


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    from tenderlake.llm.queries import op1_quality_rules
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = op1_quality_rules(spark, sf).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.9


def test_exact_dedup(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (None, "a\tb "), (7, None), (6, " \n"), (8, "cd"), (9, "cd"), (9, "cd"),
            (10, "ce"), (11, "é e"), (12, "ée")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, kept string, _len int")
    got = exact_dedup.classes(df, prefix_chars=1).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    # four ways to write "ab": the longest text, then the smallest id (a null id is last)
    assert [by[i][0].keep_id for i in (3, 1, 2, None)] == [2] * 4 and by[2][0].group_size == 4
    assert [by[i][0].kept for i in (3, 1, 2, None)] == [False, False, True, False]
    assert [by[i][0].keep_id for i in (7, 6)] == [6, 6]
    assert sum(r.kept for r in by[9]) + by[8][0].kept == 1 and by[8][0].kept
    assert by[10][0].kept and by[10][0].group_size == 1
    assert by[11][0].kept and not by[12][0].kept
    whole = exact_dedup.deduplicate(df)
    assert whole.columns == df.columns and whole.count() == 5
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    only = spark.createDataFrame([(4, "z")] * 3, "doc_id long, text string")
    assert exact_dedup.deduplicate(only).count() == 1


def _read(conv):
    """Plain reading: windows in order, own turns and loss spans."""
    turns, loss = [], []
    un = lambda s: s.replace("&lsqb;", "[").replace("&lt;", "<").replace("&nl;", "\n").replace("&amp;", "&")
    for w in sorted(conv, key=lambda r: r.window):
        parts = w.text.split("<|im_start|>")[1:]
        assert all(p.endswith("<|im_end|>\n") for p in parts) and len(parts) == w.n_context + w.n_turns
        turns += [tuple(un(x) for x in p[:-len("<|im_end|>\n")].split("\n", 1)) for p in parts[w.n_context:]]
        loss += [un(w.text[s.start:s.end]) for s in w.loss]
    return turns, loss


def test_chat(spark):
    rng = random.Random(3)
    marks = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "&lt;|x", "<<SYS>>a<</SYS>>", "&amp;&", None, "", "[INST]", "<s>"]
    rows = [(1, 0, "system", "be brief"), *((1, i, "user" if i % 2 else "assistant", "word " * rng.randint(0, 60))
                                            for i in range(1, 700))]
    rows += [(2, i, rng.choice(["user", "assistant", "system", None, "a<|b\nc"]), rng.choice(marks)) for i in range(60)]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (4, 5, "user", "tie"), (4, 5, "user", "tie"),
             (4, 5, "assistant", "tie"), (5, -3, "assistant", "only")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=200).collect()
    by, want = defaultdict(list), defaultdict(list)
    for w in windows:
        by[w.conv_id].append(w)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert set(by) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        got, loss = _read(by[c])
        assert got == [x[1:] for x in turns]
        assert loss == [x[2] for x in turns if x[1] == "assistant"]
    long_ = by[1]
    assert len(long_) > 50 and all("be brief" in w.text for w in long_) and any(w.n_context > 1 for w in long_)
    # what a window repeats is what came right before it
    long_.sort(key=lambda r: r.window)
    for a, b in zip(long_, long_[1:]):
        again = b.text.split("<|im_start|>")[2:b.n_context + 1]
        assert not again or a.text.endswith("".join("<|im_start|>" + x for x in again))
    back = {r.conv_id: r for r in chat.read_back(chat.format_windows(df, budget=200)).collect()}
    assert [tuple(t) for t in back[2].turns] == [x[1:] for x in want[2]]
    assert chat.format_windows(df.limit(0)).count() == 0


def test_flow_prefers_fresh_tokens():
    # one shared pattern and two of their own: nothing repeats while fresh tokens serve the quotas
    flow = mixing.min_cost_flow([100, 50, 100], [[0], [0, 1], [1]], [120, 120], 3)
    assert sum(f.get(0, 0) for f in flow) == 120 and sum(f.get(1, 0) for f in flow) == 120
    assert [sum(f.values()) for f in flow][0] <= 100 and sum(flow[2].values()) <= 100 and sum(flow[1].values()) <= 50
    # a quota over everything stops at three passes
    assert mixing.min_cost_flow([10], [[0]], [1000], 3) == [{0: 30}]
    # cost against brute force: cheapest way to send 7 over two patterns of 3 and 2 tokens
    f = mixing.min_cost_flow([3, 2], [[0], [0]], [7], 3)
    cost = lambda t, c: sum(max(0, min(c, t - k * c)) * k for k in range(3))
    got = cost(sum(f[0].values()), 3) + cost(sum(f[1].values()), 2)
    assert got == min(cost(x, 3) + cost(7 - x, 2) for x in range(8) if x <= 9 and 7 - x <= 6)


def test_shares():
    assert mixing.capped_shares([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    t = mixing.capped_shares([1, 50, 49], [5, 2, 1])
    assert t[0] == 3 and sum(t) == pytest.approx(100) and t[1] == pytest.approx(2 * t[2])
    assert mixing.capped_shares([0, 0], [5, 2]) == [0, 0]


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["b", "b", "b", "a", "c", None]), " ".join("w" * rng.randint(0, 40))) for i in range(3000)]
    rows += [(9000, "tiny", "w w"), (9001, "a", None), (9002, "a", ""), (5, "b", "w"), (5, "b", "w")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, Size int")
    out = mixing.mix(df, F.array("source"), mixing.word_count(F.col("text")), F.col("doc_id"))
    assert out.columns == [*df.columns, "_size", "sources", "copies", "taken", "routed"]
    got = out.collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.capped_shares([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = Counter()
    for r in got:
        assert r.taken == r.copies * r["_size"] <= 3 * r["_size"]
        taken[r.source] += r.taken
        assert r.routed.by_source[0].target == pytest.approx(want[r.source])
    for s in names:
        assert abs(taken[s] - want[s]) <= 41, (s, taken[s], want[s])
    again = mixing.mix(df.repartition(5), F.array("source"), mixing.word_count(F.col("text")), F.col("doc_id"))
    assert Counter((r.doc_id, r.taken) for r in again.collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(df.limit(0), F.array("source"), F.lit(1), F.col("doc_id")).count() == 0
    none = mixing.mix(df, F.lit(None).cast("array<string>"), F.lit(1), F.col("doc_id"))
    assert none.count() == len(rows) and none.where("taken > 0").count() == 0


def test_shared_folder_must_be_named(spark):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://x"})
    with pytest.raises(ValueError):
        shared_root(Far)


def test_hashes_of_the_contract(spark):
    from tenderlake.llm.queries import op3_chat_formatting
    r = op3_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(said)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
