"""DuckDB oracle SQL, one statement per registered query.

Each statement reads the driver's tables (pre-registered views) through the
staging CTEs and recomputes the query's result in plain SQL.  Doubles are
rounded to 6 places and arrays are emitted as '|'-joined text on both sides.
"""

from __future__ import annotations

from tenderlake.functions import fixed
from tenderlake.plans import sqltext as q
from tenderlake.plans.inputs import (GAP_NOTE_SQL, GAP_STATUS_SQL, REVISED_NOTICE,EVENT_IS_OLD_SQL, MISSING_KIND, ORDER_IS_OLD_SQL, REVIEWED_STATUS,
                                     VERSION_OFFSET, NOTICE_VERSION_OFFSET)
from tenderlake.plans.staging import with_staging

ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


# ------------------------------------------------------------ shared CTEs
def records_cte(src: str = "stg_listing") -> str:
    kind = q.source_kind("source_type", "source_name", "platform")
    return f"""SELECT *, seq AS record_id, seq AS raw_id,
  CASE WHEN {MISSING_KIND} THEN NULL ELSE {kind} END AS source_kind,
  nullif(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#@]+)', 1)), '') AS host,
  {q.cluster_key('title', 'customer', 'deadline', 'source_url')} AS cluster_key,
  CASE WHEN {q.nu('source_url')} <> '' THEN {q.dbl(0.95)} ELSE {q.dbl(0.7)} END AS rec_conf
FROM {src}"""


def clusters_cte(recs: str = "recs") -> str:
    return f"""SELECT cluster_key, min(record_id) AS cluster_id,
  arg_min(title, record_id) FILTER (WHERE title <> '') AS title,
  arg_min(customer, record_id) FILTER (WHERE customer <> '') AS customer,
  max(rec_conf) AS confidence,
  arg_max(CASE WHEN rec_conf >= {q.dbl(0.9)} THEN 'auto_accepted' ELSE 'needs_review' END, record_id)
    AS review_status,
  count(*) AS source_count
FROM {recs} GROUP BY cluster_key"""


def roles_ctes(clusters: str, recs: str, taxonomy: dict | None = None,
               links: str | None = None) -> list[tuple[str, str]]:
    """hay(cluster_id, h) and roles(cluster_id, role_category, role_tags)."""
    tax = taxonomy or fixed.DEFAULT_ROLE_TAXONOMY
    lk = links or f"(SELECT c.cluster_id, r.record_id FROM {recs} r JOIN {clusters} c USING (cluster_key))"
    hay = f"""SELECT c.cluster_id, {q.nt("concat_ws(' ', c.title, c.customer, agg.t)")} AS h
FROM {clusters} c LEFT JOIN (
  SELECT l.cluster_id, string_agg(concat_ws(' ', r.title, r.summary, r.description, r.broker, r.source_url),
                                 ' ' ORDER BY r.record_id) AS t
  FROM {lk} l JOIN {recs} r USING (record_id) GROUP BY l.cluster_id) agg ON agg.cluster_id = c.cluster_id"""
    parts = []
    for role, kws in tax.items():
        s = " + ".join(f"CAST({q.has_word('h', ' '.join(k.lower().split()))} AS INTEGER)" for k in kws) or "0"
        parts.append(f"SELECT cluster_id, {q.sq(role)} AS role, {s} AS score FROM hay")
    scores = " UNION ALL ".join(parts)
    ranked = f"""SELECT cluster_id, role, score,
  row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, role DESC) AS rn
FROM ({scores}) WHERE score > 0"""
    roles = f"""SELECT h.cluster_id,
  coalesce(max(r.role) FILTER (WHERE r.rn = 1), 'generalist') AS role_category,
  coalesce(string_agg(r.role, '|' ORDER BY r.rn) FILTER (WHERE r.rn <= 3), '') AS role_tags
FROM hay h LEFT JOIN ranked r ON r.cluster_id = h.cluster_id GROUP BY h.cluster_id"""
    return [("hay", hay), ("ranked", ranked), ("roles", roles)]


def relevance_sql(conf: str, role: str, capacity: dict | None = None, mode: str = "balanced") -> tuple[str, str]:
    cpart = f"least(greatest({conf}, {q.dbl(0.0)}), {q.dbl(1.0)}) * {q.dbl(0.5)}"
    if capacity:
        m = "CASE " + " ".join(f"WHEN {role} = {q.sq(k)} THEN {v}" for k, v in capacity.items()) + " END"
        inp = f"({role} IN ({', '.join(q.sq(k) for k in capacity)}))"
        role_part = f"CASE WHEN {inp} THEN {q.dbl(0.2)} ELSE {q.dbl(0.0)} END"
        cap_part = (f"CASE WHEN {inp} AND {m} > 0 THEN least({q.dbl(0.4)}, {q.dbl(0.1)} + CAST({m} AS DOUBLE) * {q.dbl(0.06)}) "
                    f"ELSE {q.dbl(-0.2)} END")
        note = (f"CASE WHEN {inp} AND {m} > 0 THEN 'capacity=' || CAST({m} AS VARCHAR) "
                f"WHEN {inp} THEN 'capacity=0' ELSE 'role_not_in_capacity_profile' END")
    else:
        role_part, cap_part, note = q.dbl(0.2), q.dbl(0.0), "'availability_profile=empty'"
    adj = {"high_precision": " - " + q.dbl(0.15), "high_recall": " + " + q.dbl(0.1)}.get(mode, "")
    score = f"greatest({q.dbl(0.0)}, least({q.dbl(1.0)}, {cpart} + {role_part} + {cap_part}{adj}))"
    why = f"'confidence=' || printf('%.2f', {conf}) || ', ' || {note} || ', mode={mode}'"
    return score, why


def listing_cluster_ctes() -> list[tuple[str, str]]:
    return [("recs", records_cte()), ("clusters", clusters_cte())]


# ------------------------------------------------------------ flagship
@oracle("relevant_opportunities")
def _relevant() -> str:
    score, why = relevance_sql("c.confidence", "r.role_category")
    body = f"""SELECT c.cluster_id, c.cluster_key, c.title, c.customer, c.review_status,
  {q.r6('c.confidence')} AS confidence, c.source_count, r.role_category, r.role_tags,
  {q.r6(score)} AS relevance_score, {why} AS relevance_rationale
FROM clusters c JOIN roles r ON r.cluster_id = c.cluster_id
WHERE c.review_status NOT IN ('ignored', 'watch_only')
  AND NOT (c.review_status = 'needs_review' AND c.confidence < {q.dbl(0.75)})
  AND {score} >= {q.dbl(0.35)}
ORDER BY {score} DESC, c.confidence DESC, c.cluster_id DESC
LIMIT 100"""
    return with_staging(body, "stg_listing",
                        extra_ctes=listing_cluster_ctes() + roles_ctes("clusters", "recs"))


# ------------------------------------------------------------ expressions
@oracle("normalize_text")
def _normalize_text() -> str:
    return f"""SELECT doc_id, sha256({q.nt('text')}) AS norm_hash,
  CAST(length({q.nt('text')}) AS BIGINT) AS norm_len FROM documents"""


@oracle("normalize_url")
def _normalize_url() -> str:
    return f"SELECT page_id, {q.nu('url')} AS norm_url FROM pages"


@oracle("content_hash")
def _content_hash() -> str:
    return "SELECT doc_id, sha256(text) AS content_hash FROM documents"


@oracle("url_host")
def _url_host() -> str:
    return ("SELECT page_id, nullif(lower(regexp_extract(url, "
            "'^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#@]+)', 1)), '') AS host FROM pages")


@oracle("cluster_key")
def _cluster_key() -> str:
    return with_staging(
        f"SELECT seq, {q.cluster_key('title', 'customer', 'deadline', 'source_url')} AS cluster_key "
        "FROM stg_listing", "stg_listing")


@oracle("source_kind")
def _source_kind() -> str:
    return with_staging(
        f"SELECT seq, {q.source_kind('source_type', 'source_name', 'platform')} AS source_kind "
        "FROM stg_listing", "stg_listing")


@oracle("source_priority")
def _source_priority() -> str:
    key = q.priority_key("source_kind", "source_type", "platform", "host", "broker", "source_url")
    return with_staging(
        f"SELECT record_id, pk AS priority_key, CAST({q.rank('pk')} AS BIGINT) AS priority_rank "
        f"FROM (SELECT record_id, {key} AS pk FROM recs)",
        "stg_listing", extra_ctes=[("recs", records_cte())])


KEYWORD_SET = ["the", "and", "of the", "de", "la", "et", "der", "und", "die", "el", "los",
               "y", "que", "is", "für", "été"]


@oracle("keyword_match")
def _keyword_match() -> str:
    hits = [q.has_word('h', k) for k in KEYWORD_SET]
    n = " + ".join(f"CAST({x} AS BIGINT)" for x in hits)
    names = ", ".join(f"CASE WHEN {x} THEN {q.sq(k)} END" for x, k in zip(hits, KEYWORD_SET))
    return f"""SELECT doc_id, {n} AS n_hits, concat_ws('|', {names}) AS matched
FROM (SELECT doc_id, {q.nt('text')} AS h FROM documents)"""


@oracle("agreement_phrase")
def _agreement_phrase() -> str:
    return with_staging(
        f"SELECT seq, {q.agreement_phrase('agreement_type')} AS type_hit, "
        f"{q.agreement_phrase('notice_type')} AS notice_hit, {q.agreement_phrase('title')} AS title_hit "
        "FROM stg_notice", "stg_notice")


@oracle("truthy_coalesce")
def _truthy() -> str:
    return with_staging(
        f"SELECT seq, {q.first_truthy('id', 'notice_id', 'external_id', 'url')} AS external_key, "
        f"{q.first_truthy('buyer', 'customer')} AS buyer_or_customer FROM stg_notice", "stg_notice")


# ------------------------------------------------------------ sources
BAD_FEED_SQL = "(line_key // 8) % 50 = 0 AND line_key % 8 = 1"


def listing_body_sql() -> str:
    ov = ("json_object('title', title, 'company', customer, 'description', summary, "
          "'delivery_date', deadline, 'job_uri', source_url)")
    return (f"CAST(json_object('job_overview', {ov}, 'description', description, "
            "'description_summarised', summary, 'platform', platform) AS VARCHAR)")


def listing_meta_sql() -> str:
    return ("CAST(json_object('title', title, 'company', customer, 'delivery_date', deadline, "
            "'job_uri', source_url, 'platform', platform) AS VARCHAR)")


def fallback_sql(body: str) -> str:
    def part(x, d):
        return f"coalesce(nullif({q.nt(x)}, ''), {q.sq(d)})"
    return ("'fallback:' || " + " || ':' || ".join([
        part("platform", "unknown"), part("title", "untitled"), part("customer", "unknown-company"),
        part("deadline", "unknown-deadline")]) + f" || ':' || substr(sha256({body}), 1, 16)")


def raw_listing_cte() -> str:
    return f"""SELECT seq, 'scraper' AS source_type, coalesce(nullif(platform, ''), 'unknown') AS source_name,
  coalesce(nullif(source_url, ''), {fallback_sql('body')}) AS external_id, body AS raw_body,
  {listing_meta_sql()} AS metadata, title, customer, summary, deadline, source_url, description, platform
FROM (SELECT *, {listing_body_sql()} AS body FROM stg_listing)"""


@oracle("ingest_listings")
def _ingest_listings() -> str:
    return with_staging("SELECT seq, source_type, source_name, external_id, sha256(raw_body) AS body_hash, "
                        "sha256(metadata) AS metadata_hash FROM raw_l", "stg_listing",
                        extra_ctes=[("raw_l", raw_listing_cte())])


@oracle("fallback_external_id")
def _fallback() -> str:
    return with_staging(f"SELECT seq, {fallback_sql(listing_body_sql())} AS fallback_id FROM stg_listing",
                        "stg_listing")


def raw_mail_cte() -> str:
    meta = ("CAST(json_object('uid', CAST(uid AS VARCHAR), 'subject', subject, 'from', sender, "
            "'to', NULL, 'cc', NULL, 'date', NULL, 'mailbox', 'INBOX', "
            "'message_id', coalesce(message_id, CAST(uid AS VARCHAR))) AS VARCHAR)")
    return f"""SELECT uid AS seq, 'email' AS source_type, 'oppdrag@example.no' AS source_name,
  coalesce(message_id, CAST(uid AS VARCHAR)) AS external_id, coalesce(body, '') AS raw_body,
  {meta} AS metadata, subject, sender FROM stg_mail"""


@oracle("ingest_mail")
def _ingest_mail() -> str:
    return with_staging("SELECT seq, source_type, source_name, external_id, sha256(raw_body) AS body_hash, "
                        "sha256(metadata) AS metadata_hash FROM raw_m", "stg_mail",
                        extra_ctes=[("raw_m", raw_mail_cte())])


@oracle("mail_since_uid")
def _mail_since() -> str:
    return with_staging("SELECT uid AS seq, coalesce(message_id, CAST(uid AS VARCHAR)) AS external_id "
                        "FROM stg_mail WHERE uid >= 7500", "stg_mail")


NOTICE_KEYS = ("agreement_type", "buyer", "category", "customer", "deadline", "description",
               "external_id", "id", "notice_id", "notice_type", "published_at", "status",
               "summary", "title", "url")


def canonical_notice_sql() -> str:
    parts = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '\"{k}\":' || CAST(to_json({k}) AS VARCHAR) END"
                      for k in NOTICE_KEYS)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def notices_cte() -> str:
    ext = q.first_truthy("id", "notice_id", "external_id", "url")
    return f"""SELECT *, {canonical_notice_sql()} AS body, {ext} AS ext_id
FROM stg_notice WHERE NOT ({BAD_FEED_SQL}) AND seq % 4 <> 2"""


def all_notices_cte() -> str:
    ext = q.first_truthy("id", "notice_id", "external_id", "url")
    return f"SELECT *, {canonical_notice_sql()} AS body, {ext} AS ext_id FROM stg_notice"


@oracle("ingest_multi_notice")
def _ingest_multi_notice() -> str:
    return with_staging(
        "SELECT line_key // 8 AS seq, row_number() OVER (PARTITION BY line_key // 8, source_name ORDER BY n.seq, body) - 1 "
        "AS pos, source_name, ext_id AS external_id, sha256(body) AS body_hash FROM nt_all n",
        "stg_notice", extra_ctes=[("nt_all", all_notices_cte())])


@oracle("ingest_notices")
def _ingest_notices() -> str:
    return with_staging("SELECT seq, source_name, ext_id AS external_id, sha256(body) AS body_hash FROM nt_ok",
                        "stg_notice", extra_ctes=[("nt_ok", notices_cte())])


@oracle("notice_normalize")
def _notice_normalize() -> str:
    return with_staging(
        f"SELECT seq, ext_id AS external_id, title, nullif(url, '') AS url, "
        f"{q.first_truthy('buyer', 'customer')} AS buyer, {q.nt('agreement_type')} AS agreement_type, "
        f"{q.nt('notice_type')} AS notice_type, source_name AS origin FROM nt_ok",
        "stg_notice", extra_ctes=[("nt_ok", notices_cte())])


@oracle("feed_precedence")
def _feed_precedence() -> str:
    return with_staging(
        "SELECT seq, source_name, 'embedded' AS origin FROM stg_notice WHERE source_name = 'doffin' AND seq % 2 = 1 "
        "UNION ALL SELECT seq, source_name, 'shared' AS origin FROM stg_notice WHERE source_name = 'kgv-portal' "
        "AND seq % 2 = 0 UNION ALL SELECT seq, source_name, 'fetched' AS origin FROM stg_notice "
        "WHERE source_name = 'mercell-tender'",
        "stg_notice")


@oracle("ingest_quarantine")
def _quarantine() -> str:
    return with_staging(
        f"SELECT source_name, CASE WHEN {BAD_FEED_SQL} THEN 'bad_json' ELSE 'no_items' END AS reason, "
        f"count(*) AS n_documents FROM stg_notice WHERE ({BAD_FEED_SQL}) OR seq % 4 = 2 GROUP BY ALL",
        "stg_notice")


# ------------------------------------------------------------ extraction
REC_OUT = ("raw_id, title, customer, broker, source_url, deadline, sha256(coalesce(description, '')) "
           "AS description_hash, summary, source_type, source_kind, platform, host, agreement_type, "
           "notice_type, category, round(extraction_confidence, 6) AS extraction_confidence, extraction_error")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{q.WS}|{q.WS}$', '', 'g')"


def rx_group(text: str, pat: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '{pat}') THEN {strip_sql(f'regexp_extract({text}, {q.sq(pat)}, 2)')} END"


TITLE_RE2 = r"(?i)(oppdrag|assignment|rolle)[:\-]\s*(.+)"
DEADLINE_RE2 = r"(?i)(frist|deadline)[:\-]\s*([^\n]+)"
URL_RE2 = r"https?://[^\s)]+"


def host_sql(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#@]+)', 1)), '')"


def email_records_cte() -> str:
    b = "raw_body"
    title = f"coalesce({rx_group('coalesce(subject, chr(0))', TITLE_RE2)}, {rx_group(b, TITLE_RE2)}, subject)"
    return f"""SELECT seq AS raw_id, {title} AS title, sender AS customer, sender AS broker,
  CASE WHEN regexp_matches({b}, '{URL_RE2}') THEN regexp_extract({b}, '{URL_RE2}', 0) END AS source_url,
  {rx_group(b, DEADLINE_RE2)} AS deadline, {b} AS description, CAST(NULL AS VARCHAR) AS summary,
  'email' AS source_type, {q.source_kind("'email'", "source_name")} AS source_kind,
  CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS agreement_type,
  CAST(NULL AS VARCHAR) AS notice_type, CAST(NULL AS VARCHAR) AS category,
  {q.dbl(0.65)} AS extraction_confidence, CAST(NULL AS VARCHAR) AS extraction_error
FROM raw_m"""


def listing_records_cte() -> str:
    ok = "description IS NOT NULL"

    def f(x):
        return f"CASE WHEN {ok} THEN {x} END"
    return f"""SELECT seq AS raw_id, {f('title')} AS title, {f('customer')} AS customer, {f('platform')} AS broker,
  {f('source_url')} AS source_url, {f('deadline')} AS deadline, {f("coalesce(description, '')")} AS description,
  {f('summary')} AS summary, 'scraper' AS source_type,
  {f(q.source_kind("'scraper'", 'source_name', 'platform'))} AS source_kind, {f('platform')} AS platform,
  {f(host_sql('source_url'))} AS host, CAST(NULL AS VARCHAR) AS agreement_type,
  CAST(NULL AS VARCHAR) AS notice_type, CAST(NULL AS VARCHAR) AS category,
  CASE WHEN {ok} THEN {q.dbl(0.9)} END AS extraction_confidence,
  CASE WHEN {ok} THEN NULL ELSE 'invalid listing document: description missing' END AS extraction_error
FROM raw_l"""


def notice_records_cte() -> str:
    url = "nullif(url, '')"
    return f"""SELECT seq AS raw_id, title, {q.first_truthy('buyer', 'customer')} AS customer, source_name AS broker,
  {url} AS source_url, deadline, coalesce(nullif(description, ''), body) AS description, summary,
  'procurement' AS source_type,
  {q.source_kind("'procurement'", 'source_name', 'NULL', 'NULL', 'source_name')} AS source_kind,
  CAST(NULL AS VARCHAR) AS platform, {host_sql(url)} AS host, agreement_type, notice_type, category,
  {q.dbl(0.85)} AS extraction_confidence, CAST(NULL AS VARCHAR) AS extraction_error
FROM nt_ok"""


@oracle("extract_email")
def _extract_email() -> str:
    return with_staging(f"SELECT {REC_OUT} FROM rec_m", "stg_mail",
                        extra_ctes=[("raw_m", raw_mail_cte()), ("rec_m", email_records_cte())])


@oracle("extract_listing")
def _extract_listing() -> str:
    return with_staging(f"SELECT {REC_OUT} FROM rec_l", "stg_listing",
                        extra_ctes=[("raw_l", raw_listing_cte()), ("rec_l", listing_records_cte())])


@oracle("extract_notice")
def _extract_notice() -> str:
    return with_staging(f"SELECT {REC_OUT} FROM rec_n", "stg_notice",
                        extra_ctes=[("nt_ok", all_notices_cte()), ("rec_n", notice_records_cte())])


def all_records_ctes() -> list[tuple[str, str]]:
    return [("raw_l", raw_listing_cte()), ("rec_l", listing_records_cte()),
            ("raw_m", raw_mail_cte()), ("rec_m", email_records_cte()),
            ("nt_ok", all_notices_cte()), ("rec_n", notice_records_cte()),
            ("rec_all", "SELECT * REPLACE (raw_id * 4 + 1 AS raw_id) FROM rec_l UNION ALL "
                        "SELECT * REPLACE (raw_id * 4 + 2 AS raw_id) FROM rec_m UNION ALL "
                        "SELECT * REPLACE (raw_id * 4 + 3 AS raw_id) FROM rec_n")]


@oracle("extract_all")
def _extract_all() -> str:
    return with_staging(f"SELECT {REC_OUT} FROM rec_all", "stg_mail", "stg_notice",
                        extra_ctes=all_records_ctes())


@oracle("extract_errors")
def _extract_errors() -> str:
    return with_staging(
        "SELECT seq * 4 + 1 AS raw_id, 'scraper' AS source_type, external_id, "
        "'invalid listing document: description missing' AS extraction_error FROM raw_l WHERE description IS NULL",
        "stg_listing", extra_ctes=[("raw_l", raw_listing_cte())])


# ------------------------------------------------------------ raw state
def events_fold_ctes() -> list[tuple[str, str]]:
    ev = f"""SELECT event_type AS source_name, CAST(user_id AS VARCHAR) AS external_id, event_id AS seq,
  ts, sha256(props) AS h, CASE WHEN {EVENT_IS_OLD_SQL} THEN 0 ELSE 1 END AS is_new FROM events"""
    w = """SELECT *, lag(h) OVER (PARTITION BY source_name, external_id ORDER BY is_new, seq) AS prev_h,
  row_number() OVER (PARTITION BY source_name, external_id ORDER BY is_new, seq) AS pos
FROM ev"""
    kept = """SELECT source_name, external_id, arg_max(seq, pos) AS k_seq, arg_max(ts, pos) AS k_ts,
  arg_max(h, pos) AS k_h, arg_max(is_new, pos) AS k_new
FROM w WHERE prev_h IS NULL OR prev_h <> h GROUP BY ALL"""
    ids = "SELECT source_name, external_id, arg_min(seq, pos) AS raw_id FROM w GROUP BY ALL"
    return [("ev", ev), ("w", w), ("kept", kept), ("ids", ids)]


@oracle("raw_upsert")
def _raw_upsert() -> str:
    return with_staging(
        "SELECT i.raw_id, k.source_name, k.external_id, k.k_h AS content_hash, k.k_seq AS seq, "
        "k.k_new = 1 AS changed, epoch_us(k.k_ts) AS received_us "
        "FROM kept k JOIN ids i USING (source_name, external_id)", extra_ctes=events_fold_ctes())


@oracle("latest_record")
def _latest_record() -> str:
    return ("SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS raw_id, max(event_id) AS record_id, "
            "arg_max(sha256(props), event_id) AS raw_content_hash FROM events GROUP BY ALL")


@oracle("incremental_reextract")
def _incremental() -> str:
    extra = events_fold_ctes() + [
        ("stored", "SELECT source_name, external_id, arg_max(h, pos) AS s_h FROM w "
                   "WHERE (prev_h IS NULL OR prev_h <> h) AND is_new = 0 GROUP BY ALL"),
        ("batch_keys", "SELECT DISTINCT source_name, external_id FROM ev WHERE is_new = 1")]
    return with_staging(
        "SELECT i.raw_id, k.source_name, k.external_id, "
        "CASE WHEN s.s_h IS NOT NULL AND s.s_h = k.k_h THEN 'reuse' ELSE 'extract' END AS action "
        "FROM kept k JOIN ids i USING (source_name, external_id) "
        "JOIN batch_keys b USING (source_name, external_id) "
        "LEFT JOIN stored s USING (source_name, external_id)", extra_ctes=extra)


# ------------------------------------------------------------ clustering
STATUS_SQL = f"CASE WHEN rec_conf >= {q.dbl(0.9)} THEN 'auto_accepted' ELSE 'needs_review' END"


def keyed_sql(rel: str) -> str:
    return (f"SELECT * REPLACE ({q.cluster_key('title', 'customer', 'deadline', 'source_url')} AS cluster_key, "
            f"CASE WHEN {q.nu('source_url')} <> '' THEN {q.dbl(0.95)} ELSE {q.dbl(0.7)} END AS rec_conf) FROM {rel}")


def score_cols(title_asof: str, cust_asof: str, dl_prior: str) -> str:
    url = f"({q.nu('x.source_url')} <> '')"
    t = f"({q.nt('x.title')} = {q.nt(title_asof)})"
    c = f"({q.nt('x.customer')} = {q.nt(cust_asof)})"
    d = f"({q.nt('x.deadline')} <> '' AND ({dl_prior} OR x.dl_first < x.record_id))"
    score = (f"least(CASE WHEN {url} THEN {q.dbl(0.6)} ELSE {q.dbl(0.0)} END + CASE WHEN {t} THEN {q.dbl(0.2)} ELSE {q.dbl(0.0)} END"
             f" + CASE WHEN {c} THEN {q.dbl(0.1)} ELSE {q.dbl(0.0)} END + CASE WHEN {d} THEN {q.dbl(0.1)} ELSE {q.dbl(0.0)} END, {q.dbl(1.0)})")
    why = (f"coalesce(nullif(concat_ws(',', CASE WHEN {url} THEN 'url' END, CASE WHEN {t} THEN 'title' END, "
           f"CASE WHEN {c} THEN 'customer' END, CASE WHEN {d} THEN 'deadline' END), ''), 'weak-match')")
    return f"{score} AS match_confidence, {why} AS match_rationale"


def windowed_sql(rel: str) -> str:
    w = "PARTITION BY cluster_key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return (f"SELECT *, first_value(nullif(title, '') IGNORE NULLS) OVER ({w}) AS t_win, "
            f"first_value(nullif(customer, '') IGNORE NULLS) OVER ({w}) AS c_win, "
            f"min(record_id) OVER (PARTITION BY cluster_key, {q.nt('deadline')}) AS dl_first FROM {rel}")


def cluster_scenario_ctes() -> list[tuple[str, str]]:
    old_c = clusters_cte("old").replace("count(*) AS source_count", "0 AS _unused")
    return [
        ("recs_all", records_cte()),
        ("old", f"SELECT * FROM recs_all WHERE {ORDER_IS_OLD_SQL}"),
        ("newr", f"SELECT * FROM recs_all WHERE NOT ({ORDER_IS_OLD_SQL})"),
        ("rsrc", "SELECT * FROM old WHERE deadline LIKE '1997%'"),
        ("rev0", f"SELECT * REPLACE (seq + {VERSION_OFFSET} AS record_id, coalesce(title, '') || ' (revised)' AS title, "
                 "'revised ' || deadline AS deadline) FROM rsrc WHERE description IS NOT NULL"),
        ("rev", keyed_sql("rev0")),
        ("batch", "SELECT * FROM newr UNION ALL SELECT * FROM rev"),
        ("failed", "SELECT raw_id FROM rsrc WHERE description IS NULL"),
        ("oc0", old_c),
        ("oc", f"SELECT * REPLACE ({REVIEWED_STATUS} AS review_status) FROM oc0"),
        ("ow", windowed_sql("old")),
        ("ol", f"SELECT c.cluster_id, x.record_id, {score_cols('x.t_win', 'x.c_win', 'FALSE')} "
               "FROM ow x JOIN oc0 c USING (cluster_key)"),
        ("bs", f"""SELECT cluster_key, min(record_id) AS b_first,
  arg_min(title, record_id) FILTER (WHERE title <> '') AS b_title,
  arg_min(customer, record_id) FILTER (WHERE customer <> '') AS b_customer,
  max(rec_conf) AS b_conf, arg_max({STATUS_SQL}, record_id) AS b_status FROM batch GROUP BY cluster_key"""),
        ("fc", """SELECT coalesce(o.cluster_id, b.b_first) AS cluster_id, coalesce(o.cluster_key, b.cluster_key) AS cluster_key,
  coalesce(nullif(o.title, ''), b.b_title, o.title) AS title,
  coalesce(nullif(o.customer, ''), b.b_customer, o.customer) AS customer,
  greatest(o.confidence, b.b_conf) AS confidence,
  CASE WHEN b.cluster_key IS NULL THEN o.review_status
       WHEN o.review_status IS NOT NULL AND o.review_status NOT IN ('auto_accepted', 'needs_review') THEN o.review_status
       ELSE b.b_status END AS review_status
FROM oc o FULL OUTER JOIN bs b ON o.cluster_key = b.cluster_key"""),
        ("ol_f", "SELECT l.* FROM ol l JOIN old r USING (record_id) WHERE r.raw_id NOT IN (SELECT raw_id FROM failed)"),
        ("kl", "SELECT l.* FROM ol_f l JOIN old r USING (record_id) WHERE r.raw_id NOT IN (SELECT raw_id FROM batch)"),
        ("prior_dl", f"SELECT DISTINCT f.cluster_key, {q.nt('r.deadline')} AS dl FROM kl JOIN old r USING (record_id) "
                     f"JOIN fc f USING (cluster_id) WHERE {q.nt('r.deadline')} <> ''"),
        ("bw", windowed_sql("batch")),
        ("nl", f"""SELECT f.cluster_id, x.record_id,
  {score_cols("coalesce(nullif(o.title, ''), x.t_win)", "coalesce(nullif(o.customer, ''), x.c_win)",
              f"EXISTS (SELECT 1 FROM prior_dl p WHERE p.cluster_key = x.cluster_key AND p.dl = {q.nt('x.deadline')})")}
FROM bw x JOIN fc f USING (cluster_key) LEFT JOIN oc o USING (cluster_key)"""),
        ("fl", "SELECT * FROM kl UNION ALL SELECT * FROM nl WHERE (cluster_id, record_id) NOT IN (SELECT cluster_id, record_id FROM kl)"),
        ("all_recs", "SELECT * FROM old UNION ALL SELECT * FROM batch"),
    ]


def cscen(body: str) -> str:
    return with_staging(body, "stg_listing", extra_ctes=cluster_scenario_ctes())


@oracle("cluster_upsert")
def _cluster_upsert() -> str:
    return cscen(f"SELECT cluster_id, cluster_key, title, customer, {q.r6('confidence')} AS confidence, review_status FROM fc")


@oracle("cluster_links")
def _cluster_links() -> str:
    return cscen(f"SELECT cluster_id, record_id, {q.r6('match_confidence')} AS match_confidence, match_rationale FROM fl")


@oracle("cluster_similarity")
def _cluster_similarity() -> str:
    return with_staging(
        f"SELECT c.cluster_id, x.record_id, {q.r6('match_confidence')} AS match_confidence, match_rationale FROM "
        f"(SELECT c.cluster_id, x.record_id, {score_cols('x.t_win', 'x.c_win', 'FALSE')} "
        f"FROM ({windowed_sql('recs')}) x JOIN clusters c USING (cluster_key)) x JOIN clusters c USING (cluster_id)",
        "stg_listing", extra_ctes=listing_cluster_ctes())


@oracle("detach_superseded")
def _detach_superseded() -> str:
    return cscen("SELECT l.cluster_id, l.record_id FROM ol_f l JOIN old r USING (record_id) "
                 "WHERE r.raw_id IN (SELECT raw_id FROM batch)")


@oracle("detach_failed")
def _detach_failed() -> str:
    return cscen("SELECT l.cluster_id, count(*) AS removed_links FROM ol l JOIN old r USING (record_id) "
                 "WHERE r.raw_id IN (SELECT raw_id FROM failed) GROUP BY l.cluster_id")


def comparisons_sql(links: str, recs: str) -> str:
    fields = ("title", "customer", "broker", "deadline", "source_url")
    unp = " UNION ".join(f"SELECT l.cluster_id, '{f}' AS field_name, r.{f} AS value FROM {links} l "
                         f"JOIN {recs} r USING (record_id) WHERE r.{f} <> ''" for f in fields)
    return f"""SELECT v.cluster_id, v.field_name, v.value, n.n_values FROM ({unp}) v
JOIN (SELECT cluster_id, field_name, count(*) AS n_values FROM ({unp}) GROUP BY ALL HAVING count(*) > 1) n
USING (cluster_id, field_name)"""


@oracle("comparisons")
def _comparisons() -> str:
    return cscen(comparisons_sql("fl", "all_recs"))


@oracle("comparison_counts")
def _comparison_counts() -> str:
    fields = ("title", "customer", "broker", "deadline", "source_url")
    return cscen(" UNION ALL ".join(
        f"SELECT l.cluster_id, '{f}' AS field_name, r.{f} AS value, count(*) AS n FROM fl l JOIN all_recs r USING (record_id) "
        f"WHERE r.{f} <> '' GROUP BY l.cluster_id, r.{f}" for f in fields))


def primary_sql(clusters: str, links: str, recs: str) -> str:
    pk = q.priority_key("source_kind", "source_type", "platform", "host", "broker", "source_url")
    return f"""SELECT c.cluster_id, p.primary_record_id, coalesce(p.n, 0) AS source_count FROM {clusters} c
LEFT JOIN (SELECT l.cluster_id, arg_max(l.record_id, {{'r': {q.rank('k.pk')}, 'c': coalesce(k.extraction_confidence, {q.dbl(0.0)}), 'i': l.record_id}}) AS primary_record_id,
  count(*) AS n FROM {links} l JOIN (SELECT record_id, extraction_confidence, {pk} AS pk FROM {recs}) k USING (record_id)
  GROUP BY l.cluster_id) p USING (cluster_id)"""


@oracle("primary_source")
def _primary_source() -> str:
    return cscen(primary_sql("fc", "fl", "all_recs"))


@oracle("touched_clusters")
def _touched() -> str:
    return cscen("SELECT cluster_id FROM nl UNION "
                 "SELECT l.cluster_id FROM ol_f l JOIN old r USING (record_id) WHERE r.raw_id IN (SELECT raw_id FROM batch) UNION "
                 "SELECT l.cluster_id FROM ol l JOIN old r USING (record_id) WHERE r.raw_id IN (SELECT raw_id FROM failed)")


# ------------------------------------------------------------ policy / digest
def include_sql(status: str, conf: str, score: str, thr: float = 0.35) -> str:
    return (f"({status} NOT IN ('ignored', 'watch_only') AND NOT ({status} = 'needs_review' AND {conf} < {q.dbl(0.75)}) "
            f"AND {score} >= {q.dbl(thr)})")


@oracle("role_classify")
def _role_classify() -> str:
    return with_staging("SELECT cluster_id, role_category, role_tags FROM roles", "stg_listing",
                        extra_ctes=listing_cluster_ctes() + roles_ctes("clusters", "recs"))


CAPACITY_PROFILE = {"data_engineering": 2, "backend": 0, "frontend": 7, "security": 1}


@oracle("role_classify_phrases")
def _role_phrases() -> str:
    from tenderlake.plans.catalog import PHRASE_TAXONOMY
    parts = []
    for role, kws in PHRASE_TAXONOMY.items():
        s = " + ".join(f"CAST({q.has_word('h', k)} AS INTEGER)" for k in kws)
        parts.append(f"SELECT cluster_id, {q.sq(role)} AS role, {s} AS score FROM hay")
    return f"""WITH hay AS MATERIALIZED (SELECT doc_id AS cluster_id, {q.nt("coalesce(text, '')")} AS h FROM documents),
s AS ({" UNION ALL ".join(parts)}),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, role DESC) AS rn FROM s WHERE score > 0)
SELECT h.cluster_id, coalesce(max(r.role) FILTER (WHERE r.rn = 1), 'generalist') AS role_category,
  coalesce(string_agg(r.role, '|' ORDER BY r.rn) FILTER (WHERE r.rn <= 3), '') AS role_tags
FROM hay h LEFT JOIN r ON r.cluster_id = h.cluster_id GROUP BY h.cluster_id"""


@oracle("relevance_score")
def _relevance() -> str:
    score, why = relevance_sql("c.confidence", "r.role_category", CAPACITY_PROFILE, "high_recall")
    return with_staging(f"SELECT c.cluster_id, r.role_category, {q.r6(score)} AS relevance_score, {why} AS relevance_rationale "
                        "FROM clusters c JOIN roles r USING (cluster_id)", "stg_listing",
                        extra_ctes=listing_cluster_ctes() + roles_ctes("clusters", "recs"))


def digest_ctes() -> list[tuple[str, str]]:
    score, why = relevance_sql("f.confidence", "r.role_category")
    return cluster_scenario_ctes() + roles_ctes("fc", "all_recs", links="fl") + [
        ("sc", f"""SELECT f.*, r.role_category, r.role_tags, {score} AS relevance_score, {why} AS relevance_rationale,
  coalesce(n.n, 0) AS source_count
FROM fc f JOIN roles r USING (cluster_id) LEFT JOIN (SELECT cluster_id, count(*) AS n FROM fl GROUP BY 1) n USING (cluster_id)"""),
        ("dg", f"""SELECT cluster_id * 2 AS digest_id, cluster_id, review_status, CAST(NULL AS VARCHAR) AS message_ts,
  CAST(NULL AS TIMESTAMP) AS sent_at FROM fc WHERE cluster_id % 4 = 1
UNION ALL SELECT cluster_id * 2, cluster_id, review_status, 'old-' || CAST(cluster_id AS VARCHAR),
  TIMESTAMP '{SENT_AT}' FROM fc WHERE cluster_id % 4 IN (2, 3)
UNION ALL SELECT cluster_id * 2 + 1, cluster_id, review_status, NULL, NULL FROM fc WHERE cluster_id % 4 = 3"""),
        ("flags", "SELECT cluster_id, bool_or(sent_at IS NULL) AS has_unsent, bool_or(sent_at IS NOT NULL) AS has_sent, "
                  "max(digest_id) FILTER (WHERE sent_at IS NULL) AS unsent_digest_id FROM dg GROUP BY 1"),
        ("plan", f"""SELECT sc.*, fl.unsent_digest_id,
  CASE WHEN sc.source_count = 0 THEN 'delete_unsent'
       WHEN NOT {include_sql('sc.review_status', 'sc.confidence', 'sc.relevance_score')} THEN 'delete_unsent'
       WHEN coalesce(fl.has_unsent, FALSE) THEN 'update_unsent'
       WHEN coalesce(fl.has_sent, FALSE) THEN 'suppress' ELSE 'insert' END AS action
FROM sc LEFT JOIN flags fl USING (cluster_id)"""),
    ]


SENT_AT = "2024-01-30 10:00:00"
RUN_AS_OF = "2024-02-01 00:00:00"


def dscen(body: str) -> str:
    return with_staging(body, "stg_listing", extra_ctes=digest_ctes())


@oracle("digest_candidates")
def _digest_candidates() -> str:
    return dscen(f"SELECT cluster_id, review_status, {q.r6('relevance_score')} AS relevance_score FROM sc "
                 f"WHERE {include_sql('review_status', 'confidence', 'relevance_score')}")


@oracle("cluster_search")
def _cluster_search() -> str:
    score, why = relevance_sql("c.confidence", "r.role_category")
    return with_staging(
        f"""SELECT c.cluster_id, c.cluster_key, c.title, c.customer, c.review_status, {q.r6('c.confidence')} AS confidence,
  c.source_count, r.role_category, r.role_tags, {q.r6(score)} AS relevance_score, {why} AS relevance_rationale
FROM clusters c JOIN roles r USING (cluster_id)
WHERE (c.title ILIKE '%nation_1%' OR c.customer ILIKE '%nation_1%' OR c.cluster_key ILIKE '%nation_1%')
  AND {score} >= {q.dbl(0.5)}""", "stg_listing", extra_ctes=listing_cluster_ctes() + roles_ctes("clusters", "recs"))


TOUCHED_SQL = """SELECT cluster_id FROM nl UNION
SELECT l.cluster_id FROM ol_f l JOIN old r USING (record_id) WHERE r.raw_id IN (SELECT raw_id FROM batch) UNION
SELECT l.cluster_id FROM ol l JOIN old r USING (record_id) WHERE r.raw_id IN (SELECT raw_id FROM failed)"""


def payload_ctes() -> list[tuple[str, str]]:
    return [
        ("touched", TOUCHED_SQL),
        ("ocp0", primary_sql("oc", "ol", "old")),
        ("fcp", primary_sql("fc", "fl", "all_recs")),
        ("ocp", """SELECT f.cluster_id, CASE WHEN t.cluster_id IS NOT NULL THEN n.primary_record_id
  ELSE o.primary_record_id END AS primary_record_id
FROM fc f LEFT JOIN (SELECT DISTINCT cluster_id FROM touched) t USING (cluster_id)
  LEFT JOIN fcp n USING (cluster_id) LEFT JOIN ocp0 o USING (cluster_id)"""),
        ("firstl", "SELECT cluster_id, min(record_id) AS first_rid, count(*) AS n FROM fl GROUP BY 1"),
        ("pay0", """SELECT f.*, p.primary_record_id, coalesce(fi.n, 0) AS source_count,
  CASE WHEN EXISTS (SELECT 1 FROM fl x WHERE x.cluster_id = f.cluster_id AND x.record_id = p.primary_record_id)
       THEN p.primary_record_id ELSE fi.first_rid END AS disp
FROM fc f LEFT JOIN ocp p USING (cluster_id) LEFT JOIN firstl fi USING (cluster_id)"""),
        ("pay", """SELECT p.cluster_id, coalesce(nullif(r.title, ''), nullif(p.title, ''), 'Untitled opportunity') AS title,
  coalesce(nullif(r.customer, ''), p.customer) AS customer, r.deadline, p.source_count, p.primary_record_id,
  p.confidence, p.review_status
FROM pay0 p LEFT JOIN all_recs r ON r.record_id = p.disp"""),
    ]


@oracle("digest_payload")
def _digest_payload() -> str:
    return with_staging(f"SELECT cluster_id, title, customer, deadline, source_count, primary_record_id, "
                        f"{q.r6('confidence')} AS confidence, review_status FROM pay", "stg_listing",
                        extra_ctes=cluster_scenario_ctes() + payload_ctes())


@oracle("digest_message")
def _digest_message() -> str:
    return with_staging(
        f"""SELECT p.cluster_id, '{fixed.MESSAGE_PREFIX}' || coalesce(nullif(p.title, ''), 'Untitled opportunity') AS header,
  coalesce(nullif(p.customer, ''), 'Unknown customer') AS customer_text,
  coalesce(nullif(p.deadline, ''), 'Unknown deadline') AS deadline_text,
  CAST(p.source_count AS VARCHAR) AS sources_text, p.review_status AS status_text,
  printf('%.2f', p.confidence) AS confidence_text, coalesce(nullif(s.role_category, ''), 'generalist') AS role_text,
  printf('%.2f', s.relevance_score) AS relevance_text
FROM pay p JOIN sc s USING (cluster_id)""", "stg_listing", extra_ctes=digest_ctes() + payload_ctes())


@oracle("digest_plan")
def _digest_plan() -> str:
    return dscen("SELECT cluster_id, action, action IN ('update_unsent', 'insert') AS emit FROM plan")


@oracle("digest_plan_gated")
def _digest_plan_gated() -> str:
    return dscen("SELECT cluster_id, action, false AS emit, true AS blocked FROM plan")


@oracle("digest_mark_sent")
def _digest_mark_sent() -> str:
    return dscen(f"""SELECT d.digest_id, d.cluster_id, d.review_status,
  CASE WHEN a.digest_id IS NOT NULL AND d.sent_at IS NULL THEN a.message_ts ELSE d.message_ts END AS message_ts,
  epoch_us(CASE WHEN a.digest_id IS NOT NULL AND d.sent_at IS NULL THEN TIMESTAMP '{RUN_AS_OF}' ELSE d.sent_at END) AS sent_us
FROM (
  SELECT g.digest_id, g.cluster_id, coalesce(u.review_status, g.review_status) AS review_status, g.message_ts, g.sent_at
  FROM dg g LEFT JOIN plan u ON u.action = 'update_unsent' AND u.unsent_digest_id = g.digest_id
  WHERE g.sent_at IS NOT NULL OR g.cluster_id NOT IN (SELECT cluster_id FROM plan WHERE action = 'delete_unsent')
  UNION ALL SELECT cluster_id * 2, cluster_id, review_status, NULL, NULL FROM plan WHERE action = 'insert'
) d LEFT JOIN (
  SELECT CASE WHEN action = 'update_unsent' THEN unsent_digest_id ELSE cluster_id * 2 END AS digest_id,
         'm-' || CAST(cluster_id AS VARCHAR) AS message_ts
  FROM plan WHERE action IN ('update_unsent', 'insert') AND customer IS NOT NULL
) a USING (digest_id)""")


@oracle("pending_digests")
def _pending() -> str:
    return dscen("SELECT DISTINCT cluster_id FROM dg WHERE sent_at IS NULL")


@oracle("cadence_gate")
def _cadence() -> str:
    return ("SELECT m.minutes, epoch_us(max(ts)) AS latest_us, m.minutes > 0 AND "
            "max(ts) > TIMESTAMP '2024-01-30 23:00:00' - to_minutes(m.minutes) AS blocked "
            "FROM events, (VALUES (0), (30), (100000)) AS m(minutes) GROUP BY m.minutes")


@oracle("review_queue")
def _review_queue() -> str:
    return cscen(f"""SELECT f.cluster_id, f.title, f.customer, {q.r6('f.confidence')} AS confidence, c.field_name, c.value
FROM fc f LEFT JOIN ({comparisons_sql('fl', 'all_recs')}) c USING (cluster_id) WHERE f.review_status = 'needs_review'""")


# ------------------------------------------------------------ signals
def signal_rows_sql(src: str) -> str:
    detected = " OR ".join(q.agreement_phrase(x) for x in ("agreement_type", "notice_type", "title"))
    return f"""SELECT seq, source_name, {q.first_truthy('id', 'notice_id', 'external_id', 'url')} AS external_id, title,
  {q.first_truthy('buyer', 'customer')} AS buyer_name,
  {q.nt("coalesce(nullif(agreement_type, ''), 'unspecified')")} AS agreement_type,
  category, {q.nt('status')} AS status, nullif(url, '') AS source_url, published_at, deadline,
  {q.dbl(0.85)} AS signal_confidence, ({detected}) AS detected
FROM {src}"""


def newest_sql(rel: str) -> str:
    """Last writer per (source_name, external_id), as a struct so null
    attributes are kept (DuckDB's arg_max skips null arguments)."""
    return (f"SELECT source_name, external_id, w.title AS title, w.agreement_type AS agreement_type, "
            f"w.buyer_name AS buyer_name, w.detected AS detected, w.seq AS seq FROM ("
            f"SELECT source_name, external_id, arg_max({{'title': title, 'agreement_type': agreement_type, "
            f"'buyer_name': buyer_name, 'detected': detected, 'seq': seq}}, seq) AS w FROM {rel} GROUP BY ALL)")


@oracle("signal_detect")
def _signal_detect() -> str:
    return with_staging("SELECT source_name, external_id, title, buyer_name, agreement_type, category, status, "
                        f"source_url, published_at, deadline, {q.r6('signal_confidence')} AS signal_confidence "
                        "FROM sig WHERE detected", "stg_notice", extra_ctes=[("sig", signal_rows_sql("stg_notice"))])


@oracle("signal_sync")
def _signal_sync() -> str:
    ctes = [
        ("old_n", f"SELECT * FROM stg_notice WHERE {ORDER_IS_OLD_SQL}"),
        ("rev_n", f"SELECT * REPLACE (seq + {NOTICE_VERSION_OFFSET} AS seq, 'Open competition' AS title, "
                  f"CAST(NULL AS VARCHAR) AS agreement_type, CAST(NULL AS VARCHAR) AS notice_type) "
                  f"FROM old_n WHERE {REVISED_NOTICE}"),
        ("batch_n", f"SELECT * FROM stg_notice WHERE NOT ({ORDER_IS_OLD_SQL}) UNION ALL SELECT * FROM rev_n"),
        ("s_old", signal_rows_sql("old_n")),
        ("s_new", signal_rows_sql("batch_n")),
        ("st", newest_sql("s_old") + " WHERE detected"),
        ("newest", newest_sql("s_new")),
    ]
    return with_staging(
        "SELECT source_name, external_id, title, agreement_type FROM st "
        "WHERE (source_name, external_id) NOT IN (SELECT source_name, external_id FROM newest) "
        "UNION ALL SELECT source_name, external_id, title, agreement_type FROM newest WHERE detected",
        "stg_notice", extra_ctes=ctes)


@oracle("signal_list")
def _signal_list() -> str:
    return with_staging(
        "SELECT source_name, external_id, buyer_name, seq FROM sigf WHERE detected AND buyer_name ILIKE '%nation_1%' "
        "ORDER BY seq DESC, source_name DESC, external_id DESC LIMIT 50",
        "stg_notice", extra_ctes=[("sig", signal_rows_sql("stg_notice")), ("sigf", newest_sql("sig"))])


# ------------------------------------------------------------ gaps
def gap_ctes() -> list[tuple[str, str]]:
    note = q.sq("Auto-closed after matching agreement signal detected for this buyer.")
    conf = f"least({q.dbl(0.99)}, {q.dbl(0.55)} + {q.dbl(0.1)} * CAST(n AS DOUBLE))"

    def per_buyer(clusters: str, links: str) -> str:
        return f"""SELECT {q.nt('customer')} AS bk, count(*) AS n, arg_min(customer, cluster_id) AS first_customer,
  min(cluster_id) AS first_cluster_id FROM {clusters}
WHERE customer IS NOT NULL AND cluster_id IN (SELECT cluster_id FROM {links}) AND {q.nt('customer')} <> ''
GROUP BY 1"""
    return cluster_scenario_ctes() + [
        ("sig", signal_rows_sql("stg_notice")),
        ("sigf", newest_sql("sig")),
        ("covered", f"SELECT DISTINCT {q.nt('buyer_name')} AS bk FROM sigf WHERE detected AND buyer_name IS NOT NULL "
                    f"AND {q.nt('buyer_name')} <> ''"),
        ("ob", per_buyer("oc0", "ol")),
        ("og0", f"SELECT 'buyer:' || bk AS gap_key, coalesce(first_customer, bk) AS buyer_name, {conf} AS confidence, "
                "n AS cluster_count, first_cluster_id FROM ob WHERE n >= 2"),
        ("og", f"SELECT *, {GAP_STATUS_SQL} AS status, {GAP_NOTE_SQL} AS note FROM og0"),
        ("fb", per_buyer("fc", "fl")),
        ("closed", f"SELECT gap_key, 'ignored' AS status, {note} AS note FROM og "
                   f"WHERE {q.nt('buyer_name')} IN (SELECT bk FROM covered INTERSECT SELECT bk FROM fb) "
                   "AND status IN ('open', 'acknowledged')"),
        ("ac", "SELECT og.* REPLACE (coalesce(c.status, og.status) AS status, CASE WHEN c.gap_key IS NULL THEN og.note ELSE c.note END AS note) "
               "FROM og LEFT JOIN closed c USING (gap_key)"),
        ("pay", f"SELECT 'buyer:' || bk AS gap_key, coalesce(first_customer, bk) AS buyer_name, {conf} AS confidence, "
                "n AS cluster_count, first_cluster_id FROM fb WHERE n >= 2 AND bk NOT IN (SELECT bk FROM covered)"),
        ("fg", f"""SELECT coalesce(a.gap_key, p.gap_key) AS gap_key,
  CASE WHEN p.gap_key IS NOT NULL THEN p.buyer_name ELSE a.buyer_name END AS buyer_name,
  CASE WHEN p.gap_key IS NULL THEN a.status WHEN a.gap_key IS NULL THEN 'open'
       WHEN a.status = 'open' OR (a.status = 'ignored' AND a.note = {note}) THEN 'open' ELSE a.status END AS status,
  CASE WHEN p.gap_key IS NULL THEN a.note WHEN a.gap_key IS NULL THEN NULL
       WHEN a.status = 'ignored' AND a.note = {note} THEN NULL ELSE a.note END AS note,
  CASE WHEN p.gap_key IS NOT NULL THEN p.confidence ELSE a.confidence END AS confidence,
  CASE WHEN p.gap_key IS NOT NULL THEN p.cluster_count ELSE a.cluster_count END AS cluster_count,
  CASE WHEN p.gap_key IS NOT NULL THEN p.first_cluster_id ELSE a.first_cluster_id END AS first_cluster_id,
  p.gap_key IS NOT NULL AS hit
FROM ac a FULL OUTER JOIN pay p ON a.gap_key = p.gap_key"""),
    ]


def gscen(body: str) -> str:
    return with_staging(body, "stg_listing", "stg_notice", extra_ctes=gap_ctes())


GAP_OUT = f"gap_key, buyer_name, status, note, {q.r6('confidence')} AS confidence, cluster_count"


@oracle("gap_discovery")
def _gap_discovery() -> str:
    return gscen(f"SELECT {GAP_OUT} FROM fg WHERE hit")


@oracle("gap_autoclose")
def _gap_autoclose() -> str:
    return gscen("SELECT gap_key, status, note FROM closed")


@oracle("gap_upsert")
def _gap_upsert() -> str:
    return gscen(f"SELECT {GAP_OUT} FROM fg")


@oracle("gap_status")
def _gap_status() -> str:
    return gscen("SELECT gap_key, CASE WHEN first_cluster_id % 6 = 0 THEN 'ignored' WHEN first_cluster_id % 3 = 0 THEN 'acknowledged' "
                 "WHEN first_cluster_id % 3 = 1 THEN 'watch_only' ELSE status END AS status, "
                 "CASE WHEN first_cluster_id % 3 = 1 THEN 'check later' ELSE note END AS note FROM fg")


@oracle("gap_list")
def _gap_list() -> str:
    return gscen(f"SELECT gap_key, {q.r6('confidence')} AS confidence FROM fg WHERE status = 'open' "
                 "ORDER BY confidence DESC, gap_key DESC")


@oracle("coverage_summary")
def _coverage() -> str:
    return gscen("SELECT (SELECT count(*) FROM sigf WHERE detected) AS agreement_signal_count, "
                 "(SELECT count(*) FROM fg) AS gap_count, (SELECT count(*) FROM fg WHERE status = 'open') AS open_gap_count")


# ------------------------------------------------------------ analytics
@oracle("buyer_trends")
def _buyer_trends() -> str:
    return with_staging(f"SELECT customer AS buyer, count(*) AS opportunity_count, {q.r6('avg(confidence)')} AS avg_confidence "
                        "FROM clusters WHERE customer IS NOT NULL GROUP BY customer "
                        "ORDER BY opportunity_count DESC, buyer LIMIT 10", "stg_listing", extra_ctes=listing_cluster_ctes())


@oracle("broker_patterns")
def _broker_patterns() -> str:
    return with_staging("SELECT broker, count(*) AS record_count, count(DISTINCT customer) AS unique_buyers "
                        "FROM stg_listing WHERE broker IS NOT NULL GROUP BY broker "
                        "ORDER BY record_count DESC, broker LIMIT 10", "stg_listing")


@oracle("source_quality")
def _source_quality() -> str:
    return cscen(f"""SELECT (SELECT count(*) FROM fc) AS cluster_count,
  (SELECT count(DISTINCT cluster_id) FROM ({comparisons_sql('fl', 'all_recs')})) AS clusters_with_conflicts,
  {q.r6("CASE WHEN (SELECT count(*) FROM fc) > 0 THEN CAST((SELECT count(DISTINCT cluster_id) FROM (" + comparisons_sql('fl', 'all_recs') + ")) AS DOUBLE) / (SELECT count(*) FROM fc) ELSE 0.0 END")} AS conflict_ratio,
  {q.r6("(SELECT avg(k) FROM (SELECT cluster_id, count(*) AS k FROM fl GROUP BY 1))")} AS average_sources_per_cluster""")


@oracle("market_summary")
def _market_summary() -> str:
    conflicts = f"(SELECT count(DISTINCT cluster_id) FROM ({comparisons_sql('fl', 'all_recs')}))"
    one = [("source_quality", "cluster_count", "(SELECT count(*) FROM fc)"),
           ("source_quality", "clusters_with_conflicts", conflicts),
           ("source_quality", "conflict_ratio", f"{conflicts} / (SELECT count(*) FROM fc)"),
           ("source_quality", "average_sources_per_cluster",
            "(SELECT avg(k) FROM (SELECT cluster_id, count(*) AS k FROM fl GROUP BY 1))"),
           ("coverage", "agreement_signal_count", "(SELECT count(*) FROM sigf WHERE detected)"),
           ("coverage", "gap_count", "(SELECT count(*) FROM fg)"),
           ("coverage", "open_gap_count", "(SELECT count(*) FROM fg WHERE status = 'open')")]
    top = [("buyer_trends", "buyer", m, "tb") for m in ("opportunity_count", "avg_confidence")]
    top += [("broker_patterns", "broker", m, "tk") for m in ("record_count", "unique_buyers")]
    rows = [f"SELECT '{s}' AS section, {n} AS name, '{m}' AS metric, {q.r6(f'CAST({m} AS DOUBLE)')} AS value FROM {t}"
            for s, n, m, t in top]
    rows += [f"SELECT '{s}', 'all', '{m}', {q.r6(f'CAST({x} AS DOUBLE)')}" for s, m, x in one]
    extra = gap_ctes() + listing_cluster_ctes() + [
        ("tb", "SELECT customer AS buyer, count(*) AS opportunity_count, avg(confidence) AS avg_confidence FROM clusters "
               "WHERE customer IS NOT NULL GROUP BY customer ORDER BY opportunity_count DESC, buyer LIMIT 10"),
        ("tk", "SELECT broker, count(*) AS record_count, count(DISTINCT customer) AS unique_buyers FROM stg_listing "
               "WHERE broker IS NOT NULL GROUP BY broker ORDER BY record_count DESC, broker LIMIT 10")]
    return with_staging(" UNION ALL ".join(rows), "stg_listing", "stg_notice", extra_ctes=extra)


@oracle("review_transition")
def _review_transition() -> str:
    st = "CASE order_status WHEN 'F' THEN 'watch_only' WHEN 'O' THEN 'ignored' ELSE 'manually_merged' END"
    return with_staging(f"SELECT c.cluster_id, arg_max({st}, r.seq) AS review_status, count(*) AS n_transitions "
                        f"FROM recs r JOIN clusters c USING (cluster_key) WHERE NOT ({ORDER_IS_OLD_SQL}) GROUP BY c.cluster_id",
                        "stg_listing", extra_ctes=listing_cluster_ctes())


# ------------------------------------------------------------ pages and listing stores
LINK_RE2 = r'<li><a href="([^"]*)">([^<]*)</a></li>'


@oracle("page_listings")
def _page_listings() -> str:
    pat = q.sq(LINK_RE2)
    return f"""SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, href,
  CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
       ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href END AS job_uri, title
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {pat}, 1)) AS href,
             unnest(regexp_extract_all(html, {pat}, 2)) AS title,
             unnest(range(1, len(regexp_extract_all(html, {pat}, 1)) + 1)) AS pos FROM pages)"""


@oracle("page_listings_portals")
def _page_portals() -> str:
    """What the pages were written from; no pattern is shared."""
    t, c, d = (f"coalesce({x}, '')" for x in ("title", "customer", "deadline"))
    b = "'https://portal.example'"
    kind = "(seq // 20) % 5"
    return with_staging(f"""SELECT CASE {kind} WHEN 0 THEN 'mercell' WHEN 1 THEN 'witted' WHEN 2 THEN 'emagine'
    WHEN 3 THEN 'verama' ELSE 'folq' END AS source, seq // 20 AS page_id,
  CASE {kind} WHEN 0 THEN trim({t}) ELSE {t} END AS title,
  CASE {kind} WHEN 0 THEN {b} || '/t/' || seq WHEN 1 THEN 'https://w.example/' || seq WHEN 2 THEN 'https://e.example/' || seq
    WHEN 3 THEN {b} || '/job/' || seq ELSE {b} || '/b/' || seq END AS job_uri,
  CASE {kind} WHEN 0 THEN trim({c}) WHEN 4 THEN {c} END AS company,
  CASE {kind} WHEN 0 THEN '' WHEN 1 THEN {c} END AS description,
  CASE {kind} WHEN 0 THEN {d} WHEN 2 THEN CASE WHEN {d} = '' THEN 'Start' ELSE {d} END
    WHEN 4 THEN CASE WHEN {d} = '' THEN 'Snarest' ELSE {d} END END AS delivery_date FROM stg_listing""", "stg_listing")


@oracle("listing_detail_join")
def _listing_detail() -> str:
    dl = strip_sql("split_part(coalesce(d.deadline, '') || ' (frist)', '(', 1)")
    return with_staging(f"""SELECT o.seq, 'https://example.com/job/' || CAST(o.seq AS VARCHAR) AS job_uri,
  coalesce(nullif(CASE WHEN d.seq IS NOT NULL THEN {dl} END, ''), o.deadline, 'Snarest') AS delivery_date,
  coalesce(nullif(lower(d.customer), ''), o.customer) AS company,
  sha256(coalesce(d.description, '')) AS description_hash
FROM stg_listing o LEFT JOIN (SELECT * FROM stg_listing WHERE order_status = 'F') d ON d.seq = o.seq""", "stg_listing")


@oracle("new_listings")
def _new_listings() -> str:
    return with_staging(f"""SELECT seq, source_url AS job_id FROM stg_listing n WHERE NOT ({ORDER_IS_OLD_SQL})
  AND NOT EXISTS (SELECT 1 FROM stg_listing k WHERE k.{ORDER_IS_OLD_SQL} AND k.source_url IS NOT DISTINCT FROM n.source_url)""",
                        "stg_listing")


@oracle("known_listings_update")
def _known_update() -> str:
    return with_staging(f"""SELECT seq, source_url AS job_id FROM stg_listing WHERE {ORDER_IS_OLD_SQL}
UNION ALL SELECT min(seq), source_url FROM stg_listing n WHERE NOT ({ORDER_IS_OLD_SQL})
  AND NOT EXISTS (SELECT 1 FROM stg_listing k WHERE k.{ORDER_IS_OLD_SQL} AND k.source_url IS NOT DISTINCT FROM n.source_url)
GROUP BY source_url""", "stg_listing")


@oracle("schema_align")
def _schema_align() -> str:
    return with_staging("SELECT cluster_id, review_status, '' AS role_tags, CAST(0.0 AS DOUBLE) AS relevance_score FROM clusters",
                        "stg_listing", extra_ctes=listing_cluster_ctes())
