"""Mixing sources to target shares by a time-varying curriculum.

Each source has a weight over training time t in [0, 1], piecewise linear and scaled so
that its integral is the source's token budget. Integrating the weight gives the tokens
demanded up to t; a document whose turn in its source comes after c tokens is due where
that integral reaches c. Sorting by that time interleaves all sources as their
schedules ask. Budgets follow the targets but never exceed max_repeats passes.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from keelsieve.functions.normalise import squeezed
from keelsieve.shared import materialise

VOCABULARY = os.environ.get("KEELSIEVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that one slice of a source's order is meant to hold.
SLICE_ROWS = 20_000
#: Texts above this many characters are encoded piece by piece, as the splitting pattern cuts them, so that no call of the encoder grows with a text.
CHUNK_CHARS = 100_000
#: Targets up to which the plan goes to every task; the plan of more is joined.
SMALL_PLAN = 10_000

Schedule = dict[str, Sequence[tuple[float, float]]]


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` in place of the text; NULL and empty texts have 0 tokens.

    The vocabulary goes to the executors as a broadcast of the file's bytes (below 2 MB)."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    chunk, pattern = CHUNK_CHARS, PATTERN
    made: dict = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import regex
        import tiktoken

        if "e" not in made:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            made["e"] = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode, whole = made["e"].encode_ordinary, made["e"]._encode_single_piece
        if "p" not in made:
            made["p"] = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

        def size(t: str | None) -> int:
            if not t:
                return 0
            if len(t) <= chunk:
                return len(encode(t))
            return sum(len(whole(m[0])) for m in made["p"].finditer(t))

        return texts.map(size)

    return docs.withColumn("n_tokens", count(F.col(text))).drop(text)


def _integral(knots: Sequence[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, w = np.array([k[0] for k in knots], float), np.array([k[1] for k in knots], float)
    if len(t) < 2 or t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any() or (w < 0).any() or w.max() <= 0:
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of 0 or more, one of them above 0")
    c = np.concatenate([[0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])
    return t, w / c[-1], c / c[-1]


def due_time(fraction: np.ndarray, knots: Sequence[tuple[float, float]]) -> np.ndarray:
    """Where the integral of a weight schedule reaches ``fraction`` of its whole."""
    t, w, c = _integral(knots)
    f = np.clip(fraction, 0, 1)
    i = np.clip(np.searchsorted(c, f, side="right") - 1, 0, len(t) - 2)
    rest, width = f - c[i], t[i + 1] - t[i]
    slope = (w[i + 1] - w[i]) / width
    root = np.sqrt(np.maximum(0, w[i] ** 2 + 2 * slope * rest))
    step = np.where(w[i] + root > 0, 2 * rest / np.maximum(w[i] + root, 1e-300), 0)
    return t[i] + np.minimum(step, width)


def shares(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens held, wanted and granted, passes over its documents, actual share and shortfall.

    The mixture is as large as all documents together; those without a source, or of one that is no
    target, add to that size only. ``falls_short``: even max_repeats passes give less than the target.
    Shares of an empty corpus are 0. Targets are given once per source (NULL sources are ignored).
    """
    wanted = targets.select(squeezed("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    held = counted.groupBy(squeezed("source").alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    held = materialise(held, "mix-held")
    total = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).head()["t"]
    out = wanted.join(held, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.col("target_share") * F.lit(total)).alias("wanted_tokens"),
    )
    supply = F.col("tokens") * F.col("max_repeats")
    out = out.withColumn("falls_short", supply < F.col("wanted_tokens")).withColumn("budget", F.least(supply.cast("double"), F.col("wanted_tokens")))
    return out.withColumn("passes", F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))


def mixture(counted: DataFrame, targets: DataFrame, schedules: Schedule | None = None, seed: int = 11, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The chosen records in training order: ``position`` in [0, 1], ``source``, ``doc_id``, ``copy_no``, ``n_tokens``.

    A source's documents are taken in a random but fixed order, pass after pass, until its budget is
    spent; the last record may overrun it. Sources without a schedule keep a constant weight. Equal
    positions are ordered by source, doc_id and copy.
    """
    schedules = {k.strip().lower(): v for k, v in (schedules or {}).items()}
    for knots in schedules.values():
        _integral(knots)
    small = F.broadcast if targets.count() <= SMALL_PLAN else lambda df: df
    plan = shares(counted, targets).where("budget > 0").select("source", "tokens", "budget", "passes")
    docs = counted.select(squeezed("source").alias("source"), "doc_id", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("__h"))
    docs = materialise(docs.join(small(plan.select("source")), "source", "left_semi"), "mix-docs")
    bits = max(0, math.ceil(math.log2(max(1, docs.count() / slice_rows))))
    docs = docs.withColumn("__slice", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    # running sums in two levels: over the slices of a source, then inside each slice
    sums = docs.groupBy("source", "__slice").agg(F.sum("n_tokens").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("source", "__slice").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = docs.join(sums, ["source", "__slice"]).join(small(plan), "source")
    placed = placed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    start = (F.col("copy_no") - 1) * F.col("tokens") + F.col("__before") + F.col("__in")
    placed = placed.withColumn("__start", start).where(F.col("__start") < F.col("budget"))
    # a position is where the schedule's integral reaches the middle of a record
    fraction = F.least(F.lit(1.0), (F.col("__start") + F.col("n_tokens") / 2) / F.col("budget"))

    @F.pandas_udf("double")
    def due(source: pd.Series, f: pd.Series) -> pd.Series:
        at = f.to_numpy(dtype=float).copy()
        for name, knots in schedules.items():
            mine = (source == name).to_numpy()
            if mine.any():
                at[mine] = due_time(at[mine], knots)
        return pd.Series(at)

    out = placed.select(due("source", fraction).alias("position"), "source", "doc_id", F.col("copy_no").cast("int"), "n_tokens")
    return out.orderBy("position", "source", "doc_id", "copy_no")


def actual_shares(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """``report`` of :func:`shares` with the tokens and share that the mixture really holds."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("records"), F.max("copy_no").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("__all"))
    out = report.join(got, "source", "left").fillna(0, ["mixed_tokens", "records", "most_copies"])
    whole = total.head()["__all"] or 0
    return out.withColumn("actual_share", F.lit(0.0) if not whole else F.col("mixed_tokens") / F.lit(whole))
