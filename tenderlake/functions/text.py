"""Scalar column expressions (normalization, truthiness, regex capture).

All functions return ``Column`` objects built from built-in Spark SQL
functions, so they stay inside whole-stage codegen.  Regex flags are fixed
here: ``(?U)`` makes ``\\w``/``\\s`` Unicode-aware like Python's ``re``; ``(?d)``
makes ``.`` stop only at ``\\n`` (Python's ``.`` matches ``\\r``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: ColumnOrName) -> Column:
    """Lower-case, collapse whitespace runs to one space, trim; null -> ''."""
    x = F.lower(F.coalesce(_col(c), F.lit("")))
    # single spaces stay as they are: most texts have nothing to replace
    return F.trim(F.regexp_replace(x, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def normalize_url(c: ColumnOrName) -> Column:
    """normalize_text, then strip trailing slashes."""
    return F.rtrim(normalize_text(c), F.lit("/"))


def content_hash(c: ColumnOrName) -> Column:
    """SHA-256 hex digest of the UTF-8 text."""
    return F.sha2(_col(c), 256)


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def truthy(c: ColumnOrName) -> Column:
    """A string that Python would treat as true: null and '' become null."""
    c = _col(c)
    return F.when(c != F.lit(""), c)


def json_truthy(c: ColumnOrName) -> Column:
    """Truthiness of a JSON value read as text, where its type is not known
    any more (0, false, [], {}, "" and null are false)."""
    c = _col(c)
    return F.when(~c.isin("", "0", "0.0", "false", "[]", "{}", "null"), c)


def variant_truthy_of(value: Column) -> Column:
    """A JSON value as text where Python would call it true, by its own type:
    the string "0" is true, the number 0 is not."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "STRING", truthy(text)).otherwise(json_truthy(text))


def first_truthy(*cols: ColumnOrName, last_raw: bool = True) -> Column:
    """Python ``a or b or c``: first truthy value; the last operand is
    returned as-is when nothing before it is truthy."""
    cs = [_col(c) for c in cols]
    if last_raw:
        return F.coalesce(*[truthy(c) for c in cs[:-1]], cs[-1])
    return F.coalesce(*[truthy(c) for c in cs])


def url_host(c: ColumnOrName) -> Column:
    """Lower-cased host of an absolute URL, null when there is none."""
    host = F.lower(F.try_parse_url(_col(c), F.lit("HOST")))
    return F.when(host != F.lit(""), host)


def keyword_pattern(keyword: str) -> str | None:
    """Java regex for a whole-word match of an (already normalized) keyword.
    Spaces in the keyword match any whitespace run.  Empty keyword -> None."""
    if not keyword:
        return None
    escaped = re.escape(keyword).replace(r"\ ", r"\s+")
    return r"(?U)(?<!\w)" + escaped + r"(?!\w)"


def contains_keyword(haystack: ColumnOrName, keyword: str) -> Column:
    """Whole-word keyword test over an already normalized haystack.

    A cheap ``contains`` on the first token guards the regex, so long texts
    that cannot match skip the regex engine."""
    pat = keyword_pattern(keyword)
    if pat is None:
        return F.lit(False)
    h = _col(haystack)
    first_token = keyword.split(" ")[0]
    return F.when(h.contains(first_token), h.rlike(pat)).otherwise(F.lit(False))


def format_2dp(c: ColumnOrName) -> Column:
    """Two-decimal text of a double below 10**12, rounded by its exact binary
    value, half to even (0.835 is stored just below, so it prints 0.83).

    The distance to the midpoint of the two candidates is computed without
    rounding: the value is split in two halves of 26 bits, whose products with
    200 are exact."""
    x = F.abs(_col(c).cast("double"))
    low = F.floor(x * 100).cast("double")
    cents = F.when(low / 100 > x, low - 1).otherwise(low)
    top = x * 134217729.0
    high = top - (top - x)
    over = (high * 200.0 - (cents * 2 + 1)) + (x - high) * 200.0
    up = (over > 0) | ((over == 0) & (cents % 2 == 1))
    n = (cents + F.when(up, 1).otherwise(0)).cast("bigint")
    sign = F.when((_col(c) < 0) & (n > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."),
                    F.lpad((n % 100).cast("string"), 2, "0"))
