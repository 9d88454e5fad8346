"""Spelling-independent forms of the columns that findings are compared by.

Absent values (NULL, empty, blanks only) become NULL, which equals nothing.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, functions as F

#: Directories below which CI systems and containers check repositories out.
MACHINE_ROOTS = (
    r"/builds/[^/]+/[^/]+",
    r"/home/runner/work/[^/]+",
    r"/home/circleci/project",
    r"/home/travis/build/[^/]+/[^/]+",
    r"/var/lib/jenkins/workspace/[^/]+",
    r"/srv/checkouts/[^/]+/[^/]+",
    r"/workspace",
    r"[a-z]:/agent/_work/[^/]+/s",
)


def squeezed(c: Column | str) -> Column:
    """Outer white space removed, lower case; NULL if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def fingerprint_hex(c: Column | str) -> Column:
    """The 64 hex digits of a fingerprint without scheme prefix; NULL if it has none."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_extract(F.lower(c), r"^\s*(?:[a-z0-9_.-]+:)*([0-9a-f]{64})\s*$", 1)
    return F.when(t != "", t)


def utc_day(c: Column | str) -> Column:
    """UTC date of a timestamp as ``YYYY-MM-DD``, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    days = F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def utc_micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def instant(text: str) -> Column:
    """A time written as text, read as UTC."""
    return F.timestamp_micros(utc_micros(F.lit(text)))


def micros(df, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column of either kind."""
    return utc_micros(F.col(column)) if dict(df.dtypes)[column] == "timestamp_ntz" else F.unix_micros(column)


def commit_id(c: Column | str) -> Column:
    """A commit in lower case without blanks; NULL below seven characters."""
    t = squeezed(c)
    return F.when(F.length(t) >= 7, t)


_PLAIN = re.compile(r"[A-Za-z0-9_\-. ]+(?:/[A-Za-z0-9_\- ][A-Za-z0-9_\-. ]*)*\Z")


def _path(p: str | None, root: re.Pattern) -> str | None:
    if p is None:
        return None
    p = p.strip()
    if not p:
        return None
    if _PLAIN.match(p) and p[0] != ".":
        return p.lower()
    if "%" in p:
        p = unquote(p)
    p = unicodedata.normalize("NFC", p).replace("\\", "/").lower().strip()
    if p.startswith("file:"):
        p = "/" + p[5:].lstrip("/")
    drive = re.match(r"[a-z]:/", p)
    rooted = p.startswith("/") or bool(drive)
    parts: list[str] = []
    for part in p.split("/"):
        part = part if part.strip() else ""
        if part in ("", "."):
            continue
        if part == "..":
            if parts and parts[-1] != "..":
                parts.pop()
            elif not rooted:
                parts.append(part)
            continue
        parts.append(part)
    if not parts:
        return None
    if not rooted:
        return "/".join(parts)
    whole = "/".join(parts) if drive else "/" + "/".join(parts)
    cut = root.match(whole)
    return whole[cut.end() :] if cut and cut.end() < len(whole) else "//" + whole.lstrip("/")


def checkout_path(c: Column | str, roots: tuple[str, ...] = MACHINE_ROOTS) -> Column:
    """The path inside the checkout, in one spelling: separators, dots, percent signs, letter case, Unicode form.

    A path from a machine's root loses a known ``root``; below an unknown one it is kept
    with a leading ``//``, for the caller to match by its ending.
    """
    rx = re.compile("(?:" + "|".join(roots) + ")/")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p in s:
            if p not in known:
                if len(known) > 50_000:
                    known.clear()
                known[p] = _path(p, rx)
            out.append(known[p])
        return pd.Series(out, dtype=object)

    return run(F.col(c) if isinstance(c, str) else c)
