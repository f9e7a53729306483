"""Procurement notice feeds -> raw items.

A feed document is a JSON list of notices or an object with an ``items``
list; anything else (bad JSON, a scalar, an object without ``items``)
yields no notices.  Non-object entries are skipped.  Parsing uses Spark's
VARIANT type, whose JSON output has sorted keys — the canonical body.

A notice is parsed once.  Its fields, chosen by the types its JSON values have
(the text "0" counts, the number 0 does not), are kept beside the body in the
struct column ``notice``, which is stored with the raw item; extraction and
signal detection read that column and parse nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import content_hash, normalize_text, truthy, variant_truthy_of

_V = "try_variant_get"


def _vget(v: str, path: str) -> Column:
    return F.expr(f"{_V}({v}, '{path}', 'string')")


def explode_feed(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """(source_name, payload, ...) -> one row per object notice, with
    ``notice`` (VARIANT) and ``notice_pos`` (position in the feed)."""
    v = F.expr(f"try_parse_json({payload})")
    items = F.coalesce(F.expr("try_variant_get(_feed, '$.items', 'array<variant>')"),
                       F.expr("try_variant_get(_feed, '$', 'array<variant>')"))
    out = (feeds.withColumn("_feed", v)
           .select("*", F.posexplode(items).alias("notice_pos", "notice"))
           .drop("_feed"))
    return out.where(F.expr("startswith(schema_of_variant(notice), 'OBJECT<')"))


def quarantine(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """Feed documents that yield nothing, with the reason — kept as a
    table instead of failing the run."""
    parsed = feeds.withColumn("_feed", F.expr(f"try_parse_json({payload})"))
    no_list = (F.expr("try_variant_get(_feed, '$', 'array<variant>')").isNull()
               & F.expr("try_variant_get(_feed, '$.items', 'array<variant>')").isNull())
    reason = (F.when(F.col("_feed").isNull(), F.lit("bad_json"))
              .when(no_list, F.lit("no_items")))
    return (parsed.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .drop("_feed"))


def feed_precedence(embedded: DataFrame, fetched: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Per source, the source's own embedded feed wins; a ``shared``
    embedded feed serves the sources without one; fetched notices are used
    only for sources with neither.  A feed counts as present when its document
    has entries, whether or not they are objects."""
    def without(rows: DataFrame, *having: DataFrame) -> DataFrame:
        for h in having:
            rows = rows.join(h.select("source_name").distinct(), "source_name", "left_anti")
        return rows
    if shared is None:
        return without(fetched, embedded).unionByName(embedded)
    return without(fetched, embedded, shared).unionByName(without(shared, embedded)).unionByName(embedded)


# The fields of the struct column ``notice``.
NOTICE_FIELDS = ("title", "customer", "source_url", "deadline", "description", "summary", "agreement_type", "notice_type",
                 "category", "status", "published_at", "origin", "own_title", "own_agreement_type", "told_agreement_type",
                 "told_notice_type")


def _all_texts(payload: str) -> Column:
    """Whether a VARIANT is an object whose values are all texts or nulls, by its
    schema's text: every colon in it stands before such a type.  Keys that are
    not plain words stand in backticks there and are left to the long way."""
    schema = F.expr(f"schema_of_variant({payload})")
    others = F.replace(F.replace(schema, F.lit(": STRING"), F.lit("")), F.lit(": VOID"), F.lit(""))
    return F.coalesce(schema.startswith("OBJECT<") & ~others.contains(":") & ~schema.contains("`"), F.lit(False))


def _with_texts(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the values of the VARIANT column ``payload`` as texts by key
    (``_m``, null when it is no object), read in one pass, and whether all of
    them are texts or nulls (``_texts``): then no type need be asked for again.
    Otherwise ``_o`` has the texts of the values that are true by their types."""
    texts = _all_texts(payload)
    true = F.transform_values(F.expr(f"try_variant_get({payload}, '$', 'map<string,variant>')"),
                              lambda _, v: variant_truthy_of(v))
    return df.withColumns({"_m": F.expr(f"try_variant_get({payload}, '$', 'map<string,string>')"),
                           "_texts": texts, "_o": F.when(~texts, true)})


def _any_of(key: str) -> Column:
    return F.try_element_at("_m", F.lit(key))


def _true_of(key: str) -> Column:
    return F.when(F.col("_texts"), truthy(_any_of(key))).otherwise(F.try_element_at("_o", F.lit(key)))


def _fields(meta: str | None, origin: Column) -> dict[str, Column]:
    """The typed fields of a notice whose texts stand beside it
    (:func:`_with_texts`); ``meta`` is a VARIANT column of its metadata (null:
    made from the payload, so that it says nothing else)."""
    def known(key: str) -> list[Column]:              # what the metadata says
        if meta is None:
            return [_any_of("title")] if key == "title" else []
        return [_vget(meta, f"$.{key}") if key == "title" else truthy(_vget(meta, f"$.{key}"))]
    return {
        "title": F.coalesce(_true_of("title"), *known("title")),
        "customer": F.coalesce(_true_of("buyer"), _any_of("customer")),
        "source_url": F.coalesce(_true_of("url"), _any_of("source_url")),
        "deadline": _any_of("deadline"), "description": _true_of("description"),
        "summary": _any_of("summary"), "agreement_type": _any_of("agreement_type"),
        "notice_type": _any_of("notice_type"), "category": _any_of("category"),
        "status": _any_of("status"), "published_at": _any_of("published_at"),
        "origin": origin,
        # what detection looks at, and what a signal shows
        "own_title": _true_of("title"), "own_agreement_type": _true_of("agreement_type"),
        "told_agreement_type": F.coalesce(_true_of("agreement_type"), *known("agreement_type")),
        "told_notice_type": F.coalesce(_true_of("notice_type"), *known("notice_type"))}


def _with_fields(df: DataFrame, fields: dict[str, Column], **more: Column) -> tuple[DataFrame, Column]:
    """``df`` with the fields as columns of their own, and the struct of them."""
    made = df.withColumns({**{f"_f_{k}": v for k, v in fields.items()}, **more})
    return made, F.struct(*[F.col(f"_f_{k}").alias(k) for k in NOTICE_FIELDS])


def with_notice(raw: DataFrame) -> DataFrame:
    """``raw`` with the ``notice`` column: where the table lacks it, it is made
    from the metadata.  Write the result before reading it: then no filter
    reaches into the parsing."""
    if "notice" in raw.columns:
        return raw
    own = F.when(F.col("source_type") == "procurement", F.expr("try_parse_json(metadata)"))
    parsed = raw.withColumn("_meta", own).withColumn("_load", F.expr("try_variant_get(_meta, '$.notice_payload', 'variant')"))
    made, notice = _with_fields(_with_texts(parsed, "_load"), _fields("_meta", _vget("_meta", "$.origin")))
    return made.select(*raw.columns, F.when(F.col("_meta").isNotNull(), notice).alias("notice"))


def normalize_notices(notices: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Notice -> raw item.  external_id = first truthy of id, notice_id,
    external_id, url, else the hash of the canonical JSON; body = canonical
    JSON (sorted keys); metadata keeps normalized type hints, the origin and
    the full payload; ``notice`` holds the typed fields."""
    body = F.when(F.col("_texts"), F.to_json(F.col("_m"))).otherwise(F.to_json(F.col("notice")))
    fields = _fields(None, F.col("source_name"))
    # arrival order: the feed document, then the notice's place in it
    pos = F.col("notice_pos").cast("bigint") if "notice_pos" in notices.columns else F.lit(0).cast("bigint")
    seq = F.col("seq") if "seq" in notices.columns else pos
    received = received_at if received_at is not None else F.lit(None).cast("timestamp")
    made, notice = _with_fields(
        _with_texts(notices, "notice"), fields, _body=body, _seq=seq, _pos=pos, _received=received,
        _own_key=F.coalesce(*[_true_of(k) for k in ("id", "notice_id", "external_id", "url")]),
        _told_type=_true_of("notice_type"), _told_title=_any_of("title"))
    ext = F.coalesce("_own_key", content_hash(F.col("_body")))
    head = F.to_json(F.struct(
        F.col("_told_title").alias("title"), F.col("_f_source_url").alias("url"), F.col("_f_customer").alias("buyer"),
        normalize_text("_f_own_agreement_type").alias("agreement_type"),
        normalize_text("_told_type").alias("notice_type"),
        F.col("_f_category").alias("category"),
        F.col("source_name").alias("origin")), {"ignoreNullFields": "false"})
    # splice the payload object in as a nested object (not a quoted string)
    meta = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"),
                    F.lit(',"notice_payload":'), F.col("_body"), F.lit("}"))
    return made.withColumn("_head", head).select(
        F.col("_seq").alias("seq"), F.lit("procurement").alias("source_type"), "source_name",
        ext.alias("external_id"), F.col("_body").alias("raw_body"), meta.alias("metadata"),
        F.col("_received").alias("received_at"), F.col("_pos").alias("pos"), notice.alias("notice"))
