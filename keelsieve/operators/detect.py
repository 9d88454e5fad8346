"""Detection: matches of every rule, explainable scores, bands, and findings without raw values."""

from __future__ import annotations

import secrets
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.functions import patterns, textops
from keelsieve.functions.normalise import instant
from keelsieve.sources.rules import SEVERITIES, Rule, checksum, validate

# Score signals, bands and windows.
BANDS = (("finding", 0.90), ("llm_review", 0.70), ("low_confidence", 0.50))
RANKS = {"ignore": 0, "low_confidence": 1, "llm_review": 2, "finding": 3}
ENTROPY_HIGH, ENTROPY_LOW, KEYWORD, NEGATIVE = 0.10, -0.15, 0.10, -0.40
WINDOW_BYTES = 200
DETECTOR_VERSION = "1"
#: Columns that matching and scoring make; input columns of these names give way.
MADE = ("rule_id", "start", "stop", "value", "context", "entropy", "signals", "score", "band")


@dataclass(frozen=True)
class Options:
    """``key``: of the fingerprint, see :func:`load_key`; ``min_band``: what to emit; ``scheme``: prefix of the fingerprint."""

    key: bytes
    min_band: str = "low_confidence"
    scheme: str = "hmac-sha256:"
    max_bytes: int = 20 * 1024 * 1024

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("fingerprints need a key")


def load_key(path: str | None = None, environment: str | None = None) -> bytes:
    """The fingerprint key: a file's contents, else an environment value (hex, or 16 bytes and more as they are), else one for this process only."""
    if path:
        with open(path, "rb") as f:
            key = f.read().strip()
        if not key:
            raise ValueError("the key file is empty")
        return key
    if environment:
        try:
            return bytes.fromhex(environment)
        except ValueError:
            raw = environment.encode()
            if len(raw) < 16:
                raise ValueError("a key needs 16 bytes or more") from None
            return raw
    return secrets.token_bytes(32)


def scannable(artifacts: DataFrame, content: str = "content", max_bytes: int = Options.max_bytes, head: int = 8000) -> DataFrame:
    """Leaves out contents above a size and binary ones (a NUL in the first ``head`` bytes); NULL contents go too."""
    c = F.col(content).cast("binary")
    return artifacts.where(c.isNotNull() & (F.octet_length(c) <= max_bytes) & (F.locate("\u0000", F.decode(F.substring(c, 1, head), "ISO-8859-1")) == 0))


def _signals_sql(r: Rule) -> str:
    """The signals of a rule in their order, over ``entropy`` and the lower-case context ``__low``."""
    q = textops.quoted

    def signal(name: str, value: str, reason: str) -> str:
        return f"named_struct('name', {q(name)}, 'score', {value}, 'reason', {reason})"

    parts = [signal("base", f"{float(r.confidence)!r}D", "'rule confidence'")]
    if r.entropy_enabled:
        high = f"entropy >= {float(r.entropy_threshold)!r}D"
        parts.append(signal("entropy", f"if({high}, {ENTROPY_HIGH!r}D, {ENTROPY_LOW!r}D)", f"if({high}, 'entropy at or above threshold', 'entropy below threshold')"))
    for name, words, gain in (("keyword", r.keywords, KEYWORD), ("negative_keyword", r.negative_keywords, NEGATIVE)):
        if words:  # the first configured word that the context contains
            hit = "CASE " + " ".join(f"WHEN contains(__low, {q(w.lower())}) THEN {q(w)}" for w in words) + " END"
            parts.append(signal(name, f"if(({hit}) IS NOT NULL, {gain!r}D, 0.0D)", f"coalesce({hit}, '')"))
    return f"array({', '.join(parts)})"


def matches(artifacts: DataFrame, rules: Iterable[Rule], content: str = "content") -> DataFrame:
    """One row per match of each rule: the artifact's columns but the content, ``rule_id``, ``start``, ``stop``, ``value``, ``context``.

    Rules are independent, so one text may match several. Offsets, values and contexts are bytes. One scan;
    each rule is an expression of its own, whose pattern is compiled once per task. Rules whose wanted group may be
    missing from a match, repeat in it or lie in one of several branches go through Python's engine together; a match
    without its group is none. Input columns named like one of ``MADE`` are dropped; NULL and empty contents match nothing.
    """
    rules = validate(rules)
    rest = [c for c in artifacts.columns if c != content and c not in MADE]
    base = artifacts.where(F.col(content).isNotNull()).withColumn("__p", textops.byte_projection(F.col(content).cast("string"))).withColumn("__l", F.lower("__p"))

    per_rule, rest_of_rules = [], []
    for r in rules:
        p = patterns.read(r.regex)
        marked = None if patterns.matches_nothing(p) else p.marked(r.secret_group)
        if marked is None:
            rest_of_rules.append((r.id, p.plain(), r.secret_group, r.demands))
            continue
        # a cheap test first: literals the pattern demands, else whether it matches at all
        cheap = " OR ".join(f"contains(__l, {textops.quoted(w)})" for w in r.demands)
        possible = cheap or f"__p RLIKE {textops.quoted(marked[0])}"
        per_rule.append(f"if({possible}, {textops.spans_sql('__p', *marked, r.id)}, cast(array() AS array<struct<rule_id:string,start:int,stop:int>>))")
    if rest_of_rules:
        base = base.withColumn("__u", textops.spans_of(F.col("__p"), rest_of_rules))
        per_rule.append("__u")
    # the outer form keeps the optimizer from testing the array for emptiness below, where every part of it would be worked out again
    out = base.select(*rest, F.encode(F.col(content).cast("string"), "UTF-8").alias("__b"), F.expr(f"concat({', '.join(per_rule)})").alias("__m"))
    out = out.select(*rest, "__b", F.inline_outer("__m")).where("rule_id IS NOT NULL")
    lo = F.greatest(F.col("start") - WINDOW_BYTES, F.lit(0))
    hi = F.least(F.col("stop") + WINDOW_BYTES, F.octet_length("__b"))
    return out.select(
        *rest, "rule_id", "start", "stop",
        F.substr("__b", F.col("start") + 1, F.col("stop") - F.col("start")).alias("value"),
        textops.lossy_text(F.substr("__b", lo + 1, hi - lo)).alias("context"),
    )


def score(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Adds ``entropy``, ``signals``, ``score`` and ``band`` to matches; signals are summed in their order and clamped to 0..1."""
    rules = validate(rules)
    rows = found.withColumn("entropy", textops.entropy(F.col("value"))).withColumn("__low", F.lower("context"))

    signals = F.expr("CASE rule_id " + " ".join(f"WHEN {textops.quoted(r.id)} THEN {_signals_sql(r)}" for r in rules) + " END")
    rows = rows.withColumn("signals", signals)
    total = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["score"])
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return rows.withColumn("band", band(F.col("score"))).drop("__low")


def band(c: Column) -> Column:
    out = F.when(c >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(c >= least, name)
    return out.otherwise("ignore")


def band_rank(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), RANKS.items(), F.when(F.lit(False), 0))


def at_least(scored: DataFrame, min_band: str) -> DataFrame:
    return scored.where(band_rank(F.col("band")) >= RANKS[min_band])


def findings(scored: DataFrame, rules: Iterable[Rule], options: Options, as_of: str = "2025-01-01 00:00:00") -> DataFrame:
    """Findings of scored matches. The value column ends here: fingerprint, mask and length take its place.

    Ids derive from artifact, rule and span, and times from ``as_of``, so the same input gives the same rows.
    After ``review.review`` its score, decision and metadata hold instead of the band. Needs ``artifact_id``; ``source_type``, ``uri``, ``path``, ``commit_sha`` default to the empty string.
    """
    rules = validate(rules)
    if "review_score" in scored.columns:  # second opinions were applied
        kept, confidence = scored.where("emit"), F.col("review_score")
        metadata = F.map_concat(F.create_map(F.lit("band"), F.col("band")), F.col("review_metadata"))
    else:
        kept, confidence, metadata = at_least(scored, options.min_band), F.col("score"), F.create_map(F.lit("band"), F.col("band"))
    severity = reduce(lambda acc, r: acc.when(F.col("rule_id") == r.id, r.severity), rules, F.when(F.lit(False), ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in scored.columns else F.lit("")
    when = instant(as_of)
    ident = F.concat(F.lit("fnd_"), F.substring(F.sha2(F.concat_ws("|", F.col("artifact_id").cast("string"), "rule_id", F.col("start").cast("string"), F.col("stop").cast("string")), 256), 1, 24))
    return kept.select(
        "artifact_id", ident.alias("id"), "rule_id", F.col("rule_id").alias("type"), severity.alias("severity"), confidence.alias("confidence"),
        F.concat(F.lit(options.scheme), textops.hmac_sha256(options.key, F.col("value"))).alias("fingerprint"),
        textops.masked(F.col("value")).alias("masked_prefix"), F.octet_length("value").alias("length"),
        text("source_type").alias("source_type"), text("uri").alias("source_uri"), text("path").alias("path"), text("commit_sha").alias("commit_sha"),
        F.lit("OPEN").alias("state"), when.alias("created_at"), when.alias("updated_at"), metadata.alias("metadata"),
        F.struct("signals", F.lit(checksum(rules)).alias("ruleset_version"), F.lit(DETECTOR_VERSION).alias("detector_version"), when.alias("created_at")).alias("provenance"),
        "start",
    )


def detect(artifacts: DataFrame, rules: Iterable[Rule], options: Options, as_of: str = "2025-01-01 00:00:00") -> DataFrame:
    """Artifacts to findings in one narrow pass, without a shuffle. The key in ``options`` makes the fingerprints; who holds it can test guesses."""
    rules = validate(rules)
    return findings(score(matches(scannable(artifacts, max_bytes=options.max_bytes), rules), rules), rules, options, as_of)


def try_rule(artifacts: DataFrame, rule: Rule) -> DataFrame:
    """Matches of a single rule with their scores, whatever the band and without fingerprints: for writing rules."""
    return score(matches(scannable(artifacts), [rule]), [rule]).drop("value", "context")


def explain(found: DataFrame) -> DataFrame:
    """One row per signal of each finding, in order."""
    return found.select("id", "rule_id", "confidence", F.posexplode("provenance.signals").alias("signal_no", "s")).select("id", "rule_id", "confidence", "signal_no", F.col("s.name").alias("signal"), F.col("s.score").alias("signal_score"))


def severity_rank(c: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[1], kv[0] + 1), enumerate(SEVERITIES), F.when(F.lit(False), 0)).otherwise(0)
