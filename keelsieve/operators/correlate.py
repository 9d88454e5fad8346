"""Findings of one secret put together: credentials, exposures, incidents.

All keys are folded with map-side partial aggregates of fixed size, so a fingerprint
holding a large share of the rows is no burden to any task. Membership of incidents is a
table of rows, not a list in a row, for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.functions.normalise import fingerprint_hex, squeezed


def _short_hash(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def credential_id(fingerprint: Column) -> Column:
    return _short_hash("cred_", F.concat(F.lit("credential:"), fingerprint))


def exposure_id(credential: Column, source_type: Column, uri: Column, path: Column, commit: Column) -> Column:
    return _short_hash("exp_", F.concat(F.lit("exposure:"), F.concat_ws("|", credential, source_type, uri, path, commit)))


def incident_id(credential: Column) -> Column:
    return _short_hash("inc_", F.concat(F.lit("incident:"), credential))


def provider_of(rule_id: Column) -> Column:
    """The part of a rule id before its first hyphen; the whole of it if there is none or nothing before it."""
    return F.when(F.instr(rule_id, "-") > 1, F.substring_index(rule_id, "-", 1)).otherwise(rule_id)


def same_fingerprint(c: Column | str) -> Column:
    """One spelling per fingerprint: its 64 hex digits, or for any other text itself without blanks in lower case; NULL if absent."""
    return F.coalesce(fingerprint_hex(c), squeezed(c))


def set_time(c: str) -> Column:
    """A time, NULL where the clock was not set: before 1971."""
    return F.when(F.unix_micros(c) >= 365 * 86_400_000_000, F.col(c))


def _located(findings: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = findings.withColumn("fingerprint", same_fingerprint("fingerprint")).where("fingerprint IS NOT NULL")
    return rows.select(
        credential_id(F.col("fingerprint")).alias("credential_id"), "fingerprint", text("source_type"), text("source_uri"), text("path"), text("commit_sha"),
        set_time("created_at").alias("created_at"), "seq", text("rule_id"),
    )


def exposures(findings: DataFrame) -> DataFrame:
    """Distinct places of each credential with the first and last time seen.

    ``findings`` needs fingerprint, rule_id, source_type, source_uri, path, commit_sha, created_at and ``seq``, the order of
    arrival. Rows without a fingerprint belong to no credential; spellings of one fingerprint are one; absent places are the
    empty string. NULL times and those of an unset clock do not count; a place whose first finding has none has no first time.
    """
    keys = ["credential_id", "source_type", "source_uri", "path", "commit_sha"]
    first = F.when(F.min_by(F.col("created_at").isNotNull(), "seq"), F.min("created_at"))
    out = _located(findings).groupBy(*keys).agg(first.alias("first_seen"), F.max("created_at").alias("last_seen"))
    return out.select(exposure_id(*[F.col(k) for k in keys]).alias("id"), *keys, "first_seen", "last_seen")


def credentials(findings: DataFrame) -> DataFrame:
    """One row per fingerprint: provider and kind of its first finding, first and last set time, number of exposures."""
    rows = _located(findings)
    whole = rows.groupBy("credential_id").agg(
        F.first("fingerprint").alias("fingerprint"), F.min_by("rule_id", "seq").alias("kind"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    places = exposures(findings).groupBy("credential_id").agg(F.count(F.lit(1)).alias("exposure_count"))
    out = whole.join(places, "credential_id")
    return out.select(F.col("credential_id").alias("id"), "fingerprint", provider_of(F.col("kind")).alias("provider"), "kind", F.lit("active").alias("status"), "first_seen", "last_seen", "exposure_count")


def incidents(findings: DataFrame) -> DataFrame:
    """One open incident per credential."""
    c = credentials(findings)
    return c.select(incident_id(F.col("id")).alias("id"), F.col("id").alias("credential_id"), F.lit("open").alias("status"), "exposure_count", F.col("first_seen").alias("created_at"), F.col("last_seen").alias("updated_at"))


def incident_members(findings: DataFrame) -> DataFrame:
    """Exposures of each incident, a row each."""
    return exposures(findings).select(incident_id(F.col("credential_id")).alias("incident_id"), F.col("id").alias("exposure_id"))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """``base`` with rows replaced or added by the latest ``version`` of ``changes``; on equal versions the change wins."""
    columns = base.columns
    rest = [c for c in columns if c not in keys]
    both = base.select(*columns, F.lit(0).alias("__new")).unionByName(changes.select(*columns, F.lit(1).alias("__new")))
    rank = F.struct(F.col("__new"), F.col(version))
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r"))
    return out.select(*keys, "__r.*").select(*columns)
