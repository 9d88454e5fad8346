"""Byte-exact text operations as Spark expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from keelsieve.functions.patterns import MARKS


def byte_projection(c: Column) -> Column:
    """``c`` with every non-ASCII character replaced by as many ``?`` as it has UTF-8 bytes.

    Offsets in the result are byte offsets of the text, and ``\\b`` and ``\\s`` mean what they do on bytes.
    """
    t = F.regexp_replace(c, r"[\x{80}-\x{7FF}]", "??")
    t = F.regexp_replace(t, r"[\x{800}-\x{FFFF}]", "???")
    return F.regexp_replace(t, r"[\x{10000}-\x{10FFFF}]", "????")


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(projected: str, regex: str, replacement: str, rule_id: str | None = None) -> str:
    """SQL for the array of (start, stop) byte offsets of a rule's wanted group in all of its matches, on a byte projection.

    ``regex`` and ``replacement`` set ``patterns.MARKS`` around the group: one pass of the pattern, after which the
    pieces between marks give every place. The pieces are bound to a name, as the fold would make them anew at
    every element. One SQL text per rule keeps building the plan cheap.
    """
    before, opened, closed = MARKS
    named = f"'rule_id', {quoted(rule_id)}, " if rule_id else ""
    kind = f"array<struct<{'rule_id:string,' if rule_id else ''}start:int,stop:int>>"
    start = f"acc.at + instr(x, '{opened}') - 1"
    one = f"named_struct({named}'start', cast({start} AS int), 'stop', cast({start} + instr(x, '{closed}') - instr(x, '{opened}') - 1 AS int))"
    step = f"named_struct('at', acc.at + length(x) - 2, 'out', array_append(acc.out, {one}))"
    fold = f"aggregate(slice(m, 2, greatest(size(m) - 1, 0)), named_struct('at', length(get(m, 0)), 'out', cast(array() AS {kind})), (acc, x) -> {step}, acc -> acc.out)"
    return f"get(transform(array(split(regexp_replace({projected}, {quoted(regex)}, {quoted(replacement)}), '{before}', -1)), m -> {fold}), 0)"


def spans_of(text: Column, rules: Sequence[tuple[str, str, int, Sequence[str]]]) -> Column:
    """The same spans for (rule id, pattern, group, demanded literals) whose group has no fixed place in a match, by Python's engine; a match without the group is none."""

    @F.pandas_udf("array<struct<rule_id:string,start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        ready = [(r, re.compile(p), g, d) for r, p, g, d in rules]
        out = []
        for t in texts:
            low = (t or "").lower()
            out.append([(r, m.start(g), m.end(g)) for r, rx, g, d in ready if t and (not d or any(w in low for w in d)) for m in rx.finditer(t) if m.start(g) >= 0])
        return pd.Series([[dict(zip(("rule_id", "start", "stop"), x)) for x in found] for found in out], dtype=object)

    return run(text)


def lossy_text(c: Column) -> Column:
    """Bytes as text, each malformed sequence as U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per byte of a BINARY column, summed in ascending byte order; empty is 0."""
    n = F.octet_length(value)

    def of(codes: Column) -> Column:
        counts = F.transform(F.array_sort(F.array_distinct(codes)), lambda x: F.size(F.filter(codes, lambda y: y == x)))
        return F.aggregate(counts, F.lit(0.0), lambda a, k: a - (k / F.size(codes)) * F.log2(k / F.size(codes)))

    codes = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))
    return F.when(n > 0, F.get(F.transform(F.array(codes), of), F.lit(0))).otherwise(F.lit(0.0))


def entropy_of_texts(text: Column) -> Column:
    """Shannon entropy in bits per byte of a STRING column, by one count of bytes a text however long; NULL and empty are 0."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                n = np.bincount(np.frombuffer(t.encode("utf-8"), dtype=np.uint8), minlength=256)
                share = n[n > 0] / n.sum()
                out[i] = abs(float((share * np.log2(share)).sum()))
        return pd.Series(out)

    return run(text)


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Hex HMAC-SHA256 of a BINARY or STRING column. The key's pads become literals: keep plans out of logs."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ k for b in padded)) for k in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def masked(value: Column, visible: int = 4) -> Column:
    """First ``visible`` bytes, then a star per byte; invalid UTF-8 from a cut character becomes U+FFFD."""
    n = F.octet_length(value)
    head = lossy_text(F.substring(value, 1, visible))
    return F.concat(head, F.repeat(F.lit("*"), F.greatest(n - visible, F.lit(0))))
