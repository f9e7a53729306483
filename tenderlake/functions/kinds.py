"""Source classification and agreement-phrase predicates (CASE expressions)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.fixed import AGREEMENT_PHRASES, SOURCE_PRIORITY
from tenderlake.functions.text import _col, normalize_text


def _fingerprint(*parts: Column) -> Column:
    """Space-joined non-empty normalized parts."""
    return F.concat_ws(" ", F.array_remove(F.array(*[normalize_text(p) for p in parts]), ""))


def source_kind(source_type, source_name, platform=None, host=None, origin=None) -> Column:
    """Kind of an ingested item, from its type, name and metadata hints.

    Rule order: doffin, email type, procurement type, procurement/anskaff
    words, forward words, scraper/broker type, direct, manual, unknown."""
    none = F.lit(None).cast("string")
    st = normalize_text(_col(source_type))
    fp = _fingerprint(_col(source_type), _col(source_name),
                      _col(platform) if platform is not None else none,
                      _col(host) if host is not None else none,
                      _col(origin) if origin is not None else none)
    return _kind_case(st, fp)


def with_source_kind(df, out: str = "source_kind", source_type="source_type",
                     source_name="source_name", platform=None, host=None, origin=None):
    """Add the source kind as a column, materializing the fingerprint once."""
    none = F.lit(None).cast("string")
    df = (df.withColumn("_sk_fp", _fingerprint(
        _col(source_type), _col(source_name),
        _col(platform) if platform is not None else none,
        _col(host) if host is not None else none,
        _col(origin) if origin is not None else none))
        .withColumn("_sk_st", normalize_text(_col(source_type))))
    return df.withColumn(out, _kind_case(F.col("_sk_st"), F.col("_sk_fp"))).drop("_sk_fp", "_sk_st")


def _kind_case(st, fp) -> Column:
    return (F.when(fp.contains("doffin"), "public_tender")
            .when(st == "email", "email_forwarded")
            .when(st == "procurement", "procurement_platform")
            .when(fp.contains("procurement") | fp.contains("anskaff"), "procurement_platform")
            .when(fp.contains("forward"), "forwarded")
            .when(st.isin("scraper", "broker"), "broker")
            .when(fp.contains("direct"), "direct")
            .when(fp.contains("manual"), "manual")
            .otherwise("unknown"))


def with_priority_key(df, out: str = "priority_key", stored_kind="source_kind",
                      source_type="source_type", platform="platform", host="host",
                      broker="broker", source_url="source_url"):
    """Add the priority kind as a column.  The fingerprint is materialized
    once so the CASE does not repeat it per branch (keeps codegen small)."""
    df = (df.withColumn("_pk_fp", _fingerprint(_col(source_type), _col(platform), _col(host),
                                                _col(broker), _col(source_url)))
          .withColumn("_pk_st", normalize_text(_col(source_type)))
          .withColumn("_pk_br", normalize_text(_col(broker)))
          .withColumn("_pk_canon", normalize_text(_col(stored_kind))))
    return df.withColumn(out, _priority_case(F.col("_pk_canon"), F.col("_pk_st"), F.col("_pk_br"),
                                             F.col("_pk_fp"))).drop("_pk_fp", "_pk_st", "_pk_br", "_pk_canon")


def _priority_case(canonical, st, br, fp) -> Column:
    return (F.when(canonical.isin(*SOURCE_PRIORITY.keys()), canonical)
            .when(fp.contains("doffin"), "public_tender")
            .when(fp.contains("procurement"), "procurement_platform")
            .when((st == "email") | br.contains("@"), "email_forwarded")
            .when(fp.contains("forward"), "forwarded")
            .when(fp.contains("manual"), "manual")
            .when((st == "scraper") | fp.contains("broker"), "broker")
            .when(fp.contains("direct"), "direct")
            .otherwise("unknown"))


def source_priority_key(stored_kind, source_type, platform, host, broker, source_url) -> Column:
    """Kind used to rank a record for display.  A valid stored kind wins;
    otherwise a rule list (ordered differently from :func:`source_kind`)
    over type, platform, host, broker and URL."""
    return _priority_case(normalize_text(_col(stored_kind)), normalize_text(_col(source_type)),
                          normalize_text(_col(broker)),
                          _fingerprint(_col(source_type), _col(platform), _col(host), _col(broker),
                                       _col(source_url)))


def source_rank(kind: Column) -> Column:
    """Numeric priority of a kind (literal CASE; the table has 8 rows)."""
    expr = None
    for k, v in SOURCE_PRIORITY.items():
        expr = (F.when(kind == k, F.lit(v)) if expr is None else expr.when(kind == k, F.lit(v)))
    return expr.otherwise(F.lit(SOURCE_PRIORITY["unknown"]))


# One alternation of the agreement phrases, whole-word (Unicode \b).
_PHRASE_ALT = "|".join(re.escape(p).replace(r"\ ", " ") for p in AGREEMENT_PHRASES)
AGREEMENT_REGEX = r"(?U)\b(?:" + _PHRASE_ALT + r")\b"


def contains_agreement_phrase(text) -> Column:
    """True when the normalized text is an agreement phrase or contains one
    as whole words."""
    return phrase_in(normalize_text(_col(text)))


def phrase_in(n: Column) -> Column:
    """The same for a text that is normalized already."""
    return (n != "") & (n.isin(*AGREEMENT_PHRASES) | n.rlike(AGREEMENT_REGEX))


def phrase_in_any(*texts: Column) -> Column:
    """Whether one of several normalized texts holds an agreement phrase; they are
    searched as the lines of one text (no phrase goes over a line's end)."""
    lines = F.concat_ws("\n", *texts)
    # a text without the letters of any phrase is not searched for whole words
    some = reduce(or_, [lines.contains(p) for p in AGREEMENT_PHRASES])
    return some & lines.rlike(AGREEMENT_REGEX)
