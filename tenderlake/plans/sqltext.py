"""DuckDB SQL text helpers for the oracle queries.

These build plain SQL expressions for DuckDB (RE2 regexes, no look-around);
they are written independently of the Spark column code they check.
"""

from __future__ import annotations

import re

# Whitespace as Java's (?U)\s sees it: \s plus Unicode separators, VT, NEL.
WS = r"[\s\pZ\x{0B}\x{85}]+"
# A non-word character for whole-word tests on padded text.
NW = r"[^\pL\pM\pN_]"


def nt(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS}', ' ', 'g'))"


def nu(x: str) -> str:
    return f"regexp_replace({nt(x)}, '/+$', '')"


def truthy(x: str) -> str:
    return f"nullif({x}, '')"


def first_truthy(*xs: str) -> str:
    return "coalesce(" + ", ".join([truthy(x) for x in xs[:-1]] + [xs[-1]]) + ")"


def dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def re2_escape(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def has_word(h: str, kw: str) -> str:
    """Whole-word test of a normalized keyword in a normalized text."""
    if not kw:
        return "FALSE"
    pat = NW + re2_escape(kw).replace(" ", r"\s+") + NW
    return f"regexp_matches(' ' || {h} || ' ', '{pat.replace(chr(39), chr(39) * 2)}')"


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cluster_key(title: str, customer: str, deadline: str, url: str) -> str:
    return (f"CASE WHEN {nu(url)} <> '' THEN {nu(url)} "
            f"ELSE {nt(title)} || '|' || {nt(customer)} || '|' || {nt(deadline)} END")


def fingerprint(*parts: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({nt(p)}, '')" for p in parts) + ")"


def source_kind(st: str, name: str, platform: str = "NULL", host: str = "NULL",
                origin: str = "NULL") -> str:
    fp = fingerprint(st, name, platform, host, origin)
    s = nt(st)
    return f"""CASE WHEN contains({fp}, 'doffin') THEN 'public_tender'
  WHEN {s} = 'email' THEN 'email_forwarded'
  WHEN {s} = 'procurement' THEN 'procurement_platform'
  WHEN contains({fp}, 'procurement') OR contains({fp}, 'anskaff') THEN 'procurement_platform'
  WHEN contains({fp}, 'forward') THEN 'forwarded'
  WHEN {s} IN ('scraper', 'broker') THEN 'broker'
  WHEN contains({fp}, 'direct') THEN 'direct'
  WHEN contains({fp}, 'manual') THEN 'manual'
  ELSE 'unknown' END"""


PRIORITY = {"public_tender": 100, "procurement_platform": 90, "direct": 80, "broker": 70,
            "email_forwarded": 60, "forwarded": 50, "manual": 40, "unknown": 10}


def priority_key(stored: str, st: str, platform: str, host: str, broker: str, url: str) -> str:
    fp = fingerprint(st, platform, host, broker, url)
    canon = nt(stored)
    keys = ", ".join(sq(k) for k in PRIORITY)
    return f"""CASE WHEN {canon} IN ({keys}) THEN {canon}
  WHEN contains({fp}, 'doffin') THEN 'public_tender'
  WHEN contains({fp}, 'procurement') THEN 'procurement_platform'
  WHEN {nt(st)} = 'email' OR contains({nt(broker)}, '@') THEN 'email_forwarded'
  WHEN contains({fp}, 'forward') THEN 'forwarded'
  WHEN contains({fp}, 'manual') THEN 'manual'
  WHEN {nt(st)} = 'scraper' OR contains({fp}, 'broker') THEN 'broker'
  WHEN contains({fp}, 'direct') THEN 'direct'
  ELSE 'unknown' END"""


def rank(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {kind} = {sq(k)} THEN {v}" for k, v in PRIORITY.items()) + " ELSE 10 END"


PHRASES = ["dps", "dynamic purchasing system", "frame", "frame agreement", "framework",
           "framework agreement", "ramme", "rammeavtale", "ramme avtale"]


def agreement_phrase(x: str) -> str:
    n = nt(x)
    alts = "|".join(re2_escape(p) for p in PHRASES)
    inlist = ", ".join(sq(p) for p in PHRASES)
    return (f"({n} <> '' AND ({n} IN ({inlist}) OR "
            f"regexp_matches(' ' || {n} || ' ', '{NW}({alts}){NW}')))")
