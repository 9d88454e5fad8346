"""Distinct counts over sets too large to hold, from mergeable bit matrices.

A sketch is a matrix of ``buckets`` x 54 bits. An identifier's hash picks a row
(stochastic averaging); the number of trailing zeros of the rest of the hash is
its rank and sets that bit. Rows are kept sparsely, one per touched bucket, so a
small set costs little. The union of two sets is the bitwise union of their
matrices, whoever made them and in whatever order.

For n identifiers a bit of rank r is unset with probability exp(-n q_r), q_r =
2^-(r+1) / buckets. The estimate maximises the likelihood of all bits seen; the
Fisher information there gives its variance (about 0.65 / sqrt(buckets),
relatively).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.shared import materialise

BUCKETS = 1024
RANKS = 54


def sketch(df: DataFrame, dims: Sequence[str], identifier: Column, buckets: int = BUCKETS) -> DataFrame:
    """Sketch rows (``dims``, ``bucket``, ``bits``) of the identifiers of each group; NULL identifiers are left out.

    Repeated rows change nothing. Partial aggregation on the map side leaves at most
    ``buckets`` rows per group and task, so a hot group never meets in one place.
    """
    if buckets & (buckets - 1) or buckets < 16:
        raise ValueError("buckets must be a power of two, 16 or more")
    shift = buckets.bit_length() - 1
    h = F.xxhash64(identifier, F.lit(7001))
    rest = F.shiftrightunsigned(F.col("__h"), shift).bitwiseOR(F.shiftleft(F.lit(1).cast("long"), RANKS - 1))
    rank = F.bit_count(rest.bitwiseAND(-rest) - 1).cast("int")
    rows = df.where(identifier.isNotNull()).select(*dims, h.alias("__h"))
    rows = rows.select(*dims, F.col("__h").bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int").alias("bucket"), rank.alias("__rank"))
    rows = rows.select(*dims, "bucket", F.expr("shiftleft(1L, __rank)").alias("bits"))
    return rows.groupBy(*dims, "bucket").agg(F.bit_or("bits").alias("bits"))


def merge(sketches: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Union of all sketch rows that agree in ``dims``."""
    return sketches.groupBy(*dims, "bucket").agg(F.bit_or("bits").alias("bits"))


def combinations(sketches: DataFrame, dims: Sequence[str], groups: Sequence[Sequence[str]]) -> DataFrame:
    """Sketches of several groupings at once, merged from the finest one without reading the data again.

    Adds ``grouping`` (the names joined by ``+``, ``all`` for none). A row takes part in a grouping
    only if all its columns are present.
    """
    kinds = [f.dataType for f in sketches.schema.fields if f.name in dims]
    types = dict(zip([f.name for f in sketches.schema.fields if f.name in dims], kinds))
    structs = []
    for g in groups:
        ok = F.lit(True)
        for d in g:
            ok = ok & F.col(d).isNotNull()
        body = F.struct(F.lit("+".join(g) or "all").alias("grouping"), *[(F.col(d) if d in g else F.lit(None).cast(types[d])).alias(d) for d in dims])
        structs.append(F.when(ok, body))
    rows = sketches.select(F.inline(F.filter(F.array(*structs), lambda x: x.isNotNull())), "bucket", "bits")
    return merge(rows, ["grouping", *dims])


def _maximum_likelihood(set_bits: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and standard errors from the number of set bits by rank (one row per group)."""
    q = 2.0 ** -(np.arange(RANKS) + 1) / buckets
    q[-1] *= 2  # the last rank also takes all beyond
    unset = ((buckets - set_bits) * q).sum(axis=1)
    lo, hi = np.full(len(set_bits), -2.0), np.full(len(set_bits), 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            slope = (set_bits * q / np.expm1(np.exp2(mid)[:, None] * q)).sum(axis=1) - unset
        up = slope > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    n = np.exp2(lo)
    with np.errstate(over="ignore"):
        information = (buckets * q * q / np.expm1(n[:, None] * q)).sum(axis=1)
    empty = set_bits.sum(axis=1) == 0
    return np.where(empty, 0.0, n), np.where(empty, 0.0, 1 / np.sqrt(information))


def estimate(sketches: DataFrame, dims: Sequence[str], buckets: int = BUCKETS, z: float = 3.0) -> DataFrame:
    """``estimate``, ``std_error``, ``lower`` and ``upper`` (``z`` standard errors) for each group of sketch rows."""

    @F.pandas_udf("estimate double, std_error double, lower double, upper double")
    def solve(rows: pd.Series) -> pd.DataFrame:
        counts = np.zeros((len(rows), RANKS))
        for i, words in enumerate(rows):
            words = np.asarray(words, dtype=np.int64)
            counts[i] = ((words[:, None] >> np.arange(RANKS)) & 1).sum(axis=0)
        n, se = _maximum_likelihood(counts, buckets) if len(rows) else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({"estimate": n, "std_error": se, "lower": np.maximum(0, n - z * se), "upper": n + z * se})

    # a group has at most `buckets` rows: the list is bounded by the size of a sketch
    lists = sketches.groupBy(*dims).agg(F.collect_list("bits").alias("__bits"))
    return lists.select(*dims, solve("__bits").alias("e")).select(*dims, "e.*")


def exact_counts(rows: DataFrame, dims: Sequence[str], groups: Sequence[Sequence[str]], identifier: str = "id") -> DataFrame:
    """``grouping``, ``dims`` and exact ``n`` of the same groups as :func:`combinations`, to measure bounds against; it shuffles every identifier."""
    kinds = dict(rows.dtypes)
    structs = []
    for g in groups:
        ok = F.lit(True)
        for d in g:
            ok = ok & F.col(d).isNotNull()
        structs.append(F.when(ok, F.struct(F.lit("+".join(g) or "all").alias("grouping"), *[(F.col(d) if d in g else F.lit(None).cast(kinds[d])).alias(d) for d in dims])))
    fine = rows.where(F.col(identifier).isNotNull()).select(*dims, identifier).distinct()
    each = fine.select(F.inline(F.filter(F.array(*structs), lambda x: x.isNotNull())), identifier).distinct()
    return each.groupBy("grouping", *dims).agg(F.count(F.lit(1)).alias("n"))


def dominant_days(rows: DataFrame, share: float = 0.1, least_per_mille: int = 15, total: int | None = None, buckets: int = BUCKETS, z: float = 6.0) -> DataFrame:
    """Days that hold at least ``share`` of all distinct identifiers of a frequent (rule_id, severity) pair.

    ``rows`` has created_day, rule_id, severity and id. Absent days count in the pair's total only. The bounds of the sketches
    decide most days; exact counts are made for the pairs of those days alone that the bounds leave open. Bounds are taken
    two wider on each side, as in small sets whole identifiers fall together.
    """
    total = rows.count() if total is None else total
    whole = rows.where("rule_id IS NOT NULL AND severity IS NOT NULL")
    frequent = whole.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 1000 >= F.lit(least_per_mille * total)).drop("n")
    fine = sketch(whole.where("id IS NOT NULL"), ["created_day", "rule_id", "severity"], F.col("id"), buckets)
    both = combinations(fine, ["created_day", "rule_id", "severity"], [("created_day", "rule_id", "severity"), ("rule_id", "severity")])
    bounds = estimate(both, ["grouping", "created_day", "rule_id", "severity"], buckets, z)
    pairs = bounds.where("grouping = 'rule_id+severity'").select("rule_id", "severity", (F.col("lower") - 2).alias("pair_lower"), (F.col("upper") + 2).alias("pair_upper"))
    days = bounds.where("grouping = 'created_day+rule_id+severity'").select("created_day", "rule_id", "severity", (F.col("lower") - 2).alias("day_lower"), (F.col("upper") + 2).alias("day_upper"))
    short = days.join(pairs, ["rule_id", "severity"]).where(F.col("day_upper") >= share * F.col("pair_lower")).join(frequent, ["rule_id", "severity"])
    sure = (F.col("day_lower") > 0) & (F.col("day_lower") >= share * F.col("pair_upper"))
    short = materialise(short.select("created_day", "rule_id", "severity", sure.alias("sure")), "shortlist")
    unsure = short.where("NOT sure").drop("sure")
    exact = whole.where("id IS NOT NULL").join(unsure.select("rule_id", "severity").distinct(), ["rule_id", "severity"]).select("rule_id", "severity", "created_day", "id").distinct()
    in_pair = exact.groupBy("rule_id", "severity").agg(F.count_distinct("id").alias("pair_n"))
    in_day = exact.where("created_day IS NOT NULL").groupBy("rule_id", "severity", "created_day").agg(F.count(F.lit(1)).alias("day_n"))
    hit = in_day.join(unsure, ["created_day", "rule_id", "severity"]).join(in_pair, ["rule_id", "severity"])
    return short.where("sure").drop("sure").unionByName(hit.where(F.col("day_n") >= F.lit(share) * F.col("pair_n")).select("created_day", "rule_id", "severity"))
