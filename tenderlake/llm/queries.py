"""Registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import (
    bit_sliced, chat, collocations, exact_dedup, hard_negatives, jaccard_join, mixing, quality_rules, secrets,
    sentencepiece_bpe, substring_dedup, toxicity, url_filter)
from tenderlake.llm.common import text_or_empty, without_spaces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.with_statistics(_table(spark, sf_dir, "documents"))
    stats = quality_rules.saved(stats, "rules-stats")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = quality_rules.learn(stats.join(labels, "doc_id"))
    got = quality_rules.judge(stats, rules, quality_rules.base_rule())
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "rule")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sha = F.sha2(without_spaces(text_or_empty("text")), 256)
    return exact_dedup.classes(docs, carry={"text_sha256": sha}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    windows = chat.format_windows(turns)
    got = chat.read_back(windows)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"),
                      F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secrets.scan(docs, secrets.fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"), n("crf"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.sha2(text_or_empty("text"), 256).alias("text_sha256"))
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(rows, drop_text=True))
    ids = F.array_join(F.transform("pieces", lambda i: i.cast("string")), ",")
    return got.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"),
                      F.sha2(ids, 256).alias("pieces_sha256"), F.length("decoded").cast("long").alias("n_chars"),
                      F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"))
    got = mixing.mix(rows, F.array("source"), F.col("n"), F.col("doc_id"))
    own = F.get(F.col("routed.by_source"), F.lit(0))
    return got.select("doc_id", "size", own["source_size"].alias("source_size"),
                      own["target"].alias("target"), "taken", "copies")


def _draw(text: str) -> str:
    """A number from 0 to 16,777,215 that a string decides, as Spark SQL."""
    return f"CAST(conv(substring(md5({text}), 1, 6), 16, 10) AS INT)"


def _captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch time, the URL decides a
    day of 2023."""
    return pages.select("page_id", "url", F.expr(
        f"date_add(DATE'2023-01-01', {_draw('coalesce(url, chr(0))')} % 365)").alias("fetched_at"))


def _list_log(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: a third of the hosts and
    every second parent domain are blocked for a while, some for good or
    twice, and some language folders are allowed."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h != ''").distinct()
    parents = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("h")).where("h != ''").distinct()
    logs = []
    for table, pattern, kind, one_in, days, again in (
            (hosts, "h", "block", 3, 90, 2), (parents, "h", "block", 2, 30, 3), (hosts, "h || '/en'", "allow", 4, 120, 2)):
        base = table.select(F.expr(pattern).alias("pattern")).withColumn("a", F.expr(_draw("pattern"))).where(
            f"a % {one_in} = 0").withColumn("d", F.expr(f"date_add(DATE'2023-01-01', {_draw("pattern || '#'")} % 300)"))
        for action, when, after in (("add", "true", 0), ("remove", "a % 5 != 0", days),
                                    ("add", f"(a div {one_in}) % {again} = 0", 2 * days)):
            logs.append(base.where(when).select(
                "pattern", F.lit(kind).alias("kind"), F.lit(action).alias("action"),
                F.date_add("d", after).alias("dated")))
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    got = url_filter.judge(_captures(pages), _list_log(pages))
    return got.select("page_id", "fetched_at", "blocked", "rule", "listed_from", "n_active")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.cut_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_shingles", "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_exact_dedup, op3_chat_formatting, op4_secret_scan, op5_sentencepiece,
    op6_source_mixing, op7_url_filter, op8_toxicity, op9_substring_dedup, op10_jaccard_join, op11_collocations,
    op12_hard_negatives, op13_top_k)}

ORACLES: dict[str, str] = {}

_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"
ORACLES["op2_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256({_NORM}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size,
             arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

# Turns in order, their tokens and windows; texts are escaped only for their length.
_ESC = ("regexp_replace(regexp_replace(replace({0}, '&', '&amp;'), "
        "'<(\\||/?s>|</?SYS>>)', '&lt;\\1', 'g'), '\\[(/?INST\\])', '&lsqb;\\1', 'g')")
ORACLES["op3_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')) + {chat.TURN_TOKENS} AS tok,
  length({_ESC.format('text')}) + length({_ESC.format("replace(role, chr(10), '&nl;')")})
    + {len(chat.BEGIN) + 1 + len(chat.END)} AS chars FROM c),
p AS (SELECT *, row_number() OVER o AS pos,
  coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
w AS (SELECT *, CAST(floor(before / {chat.BUDGET // 2}) AS BIGINT) AS win,
  pos = 1 AND role = '{chat.SYSTEM}' AS lead FROM p),
s AS (SELECT conv_id, win, min(before) AS start FROM w GROUP BY ALL),
f AS (
  SELECT conv_id, chars FROM w
  UNION ALL SELECT w.conv_id, chars FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    AND s.win = w.win + 1 WHERE NOT lead AND start - before <= {chat.BUDGET // 8}
  UNION ALL SELECT w.conv_id, chars FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    WHERE lead AND s.win > 0),
t AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{chat.TARGET}'), '') AS loss FROM w GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM g JOIN t ON g.conv_id IS NOT DISTINCT FROM t.conv_id
"""

# Every window with the smallest id it starts in, then the words under windows of larger ids.
ORACLES["op9_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.WIDTH - 2})) AS i FROM d
      WHERE len(w) >= {substring_dedup.WIDTH}),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {substring_dedup.WIDTH - 1}], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring_dedup.WIDTH})) AS p FROM x JOIN f USING (h)
      WHERE first < doc_id),
c AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
r AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN g
      ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id)
SELECT k.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN r ON r.doc_id = k.doc_id
"""

# Links from counts of shared shingles, then the smallest id reachable.
ORACLES["op10_jaccard_join"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

# Every phrase at every place, then cuts, containment and ranks of the frequent ones.
_BREAKS = ".,;:!?\\x0A-\\x0D"
ORACLES["op11_collocations"] = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09{_BREAKS}]+|[{_BREAKS}]') AS w FROM documents),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) v(k)
      WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM p WHERE NOT regexp_matches(phrase, '[{_BREAKS}]') GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM c),
y AS (SELECT x.lang, x.phrase, a, cut, u.f AS l, v.f AS r, (2000000::HUGEINT * a) // (u.f + v.f) AS score FROM x
      JOIN f u ON u.lang = x.lang AND u.phrase = array_to_string(w[:cut], ' ')
      JOIN f v ON v.lang = x.lang AND v.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), (score, cut)) AS best FROM y GROUP BY ALL),
g AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.k > s.k
      AND 100::HUGEINT * t.a >= 80::HUGEINT * s.a AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
o AS (SELECT lang, phrase, a, best.l AS l, best.r AS r, CAST(best.score AS BIGINT) AS score,
        row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank
      FROM b ANTI JOIN g ON g.lang = b.lang AND g.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

def _duck_vectors(times: int, more: str, where: str) -> str:
    return (f"SELECT vec_id, {more} list_transform(embedding, lambda x: floor({times} * CAST(x AS DOUBLE))) AS v "
            f"FROM embeddings WHERE {where} embedding IS NOT NULL "
            "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")


# All scores of each anchor, its positives, then the rows in each window.
ORACLES["op12_hard_negatives"] = f"""
WITH e AS ({_duck_vectors(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,", "label IS NOT NULL AND")}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES}),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (
        PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""

ORACLES["op13_top_k"] = f"""
WITH e AS ({_duck_vectors(64, "", "")}),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= {bit_sliced.K}
"""


def _duck_draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 6) AS INT)"


def _duck_log(table: str, pattern: str, kind: str, one_in: int, days: int, again: int) -> str:
    base = (f"SELECT pattern, {_duck_draw('pattern')} AS a, DATE '2023-01-01' + {_duck_draw("pattern || '#'")} % 300 AS d "
            f"FROM (SELECT {pattern} AS pattern FROM {table}) WHERE {_duck_draw('pattern')} % {one_in} = 0")
    return " UNION ALL ".join(
        f"SELECT pattern, '{kind}' AS kind, '{action}' AS action, d + {after} AS dated FROM ({base}) WHERE {when}"
        for action, when, after in (("add", "true", 0), ("remove", "a % 5 <> 0", days),
                                    ("add", f"(a // {one_in}) % {again} = 0", 2 * days)))


# State of each pattern on each of its days, then for every capture the last day at or before its own.
ORACLES["op7_url_filter"] = f"""
WITH p AS (SELECT page_id, url, row_number() OVER () AS r,
    DATE '2023-01-01' + {_duck_draw("coalesce(url, chr(0))")} % 365 AS t,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM p WHERE host <> ''),
parents AS (SELECT DISTINCT regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS h FROM hosts
            WHERE regexp_extract(h, '([^.]+[.][^.]+)$', 1) <> ''),
log AS ({_duck_log("hosts", "h", "block", 3, 90, 2)} UNION ALL {_duck_log("parents", "h", "block", 2, 30, 3)}
        UNION ALL {_duck_log("hosts", "h || '/en'", "allow", 4, 120, 2)}),
day AS (SELECT pattern, kind, dated, bool_and(action = 'add') AS live FROM log GROUP BY ALL),
state AS (SELECT *, sum(CASE WHEN live THEN 0 ELSE 1 END) OVER (PARTITION BY pattern, kind ORDER BY dated) AS era
          FROM day),
spell AS (SELECT *, min(dated) FILTER (live) OVER (PARTITION BY pattern, kind, era) AS since FROM state),
s AS (SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM p),
k AS (SELECT r, t, array_to_string(ls[len(ls) - i + 1:], '.') AS key, i AS level
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s WHERE host <> '')
      UNION ALL SELECT r, t, host || '/' || array_to_string(ps[1:i], '/'), i + 1000
      FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM s WHERE host <> '')),
hit AS (SELECT r, key, level, kinds.kind, (SELECT arg_max(struct_pack(live := live, since := since), dated)
          FROM spell WHERE pattern = key AND spell.kind = kinds.kind AND dated <= t) AS now
        FROM k, (VALUES ('allow'), ('block')) kinds(kind) WHERE key IN (SELECT pattern FROM log)),
v AS (SELECT r, count(*) AS n_active, arg_max(struct_pack(kind := kind, key := key, since := now.since),
        struct_pack(level := level, key := key, allow := kind = 'allow')) AS best
      FROM hit WHERE now.live GROUP BY r)
SELECT page_id, t AS fetched_at, coalesce(best.kind = 'block', false) AS blocked, best.key AS rule,
       best.since AS listed_from, coalesce(n_active, 0) AS n_active
FROM p LEFT JOIN v USING (r)
"""
