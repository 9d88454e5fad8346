"""Read tools over findings and the gates that a tool call passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keelsieve.functions.normalise import instant

# The names of the tools, the scope each needs and the arguments it takes.
CATALOGUE = (
    ("list_findings", "findings:read", ("state", "source_type", "rule_id", "limit"), True),
    ("get_finding", "findings:read", ("finding_id",), True),
    ("explain_finding", "findings:read", ("finding_id",), True),
    ("list_credentials", "credentials:read", ("provider", "status", "limit"), True),
    ("get_credential", "credentials:read", ("credential_id",), True),
    ("list_incidents", "incidents:read", ("status", "limit"), True),
    ("get_incident", "incidents:read", ("incident_id",), True),
    ("get_scan", "scans:read", ("scan_id",), False),
    ("start_scan", "scans:start", ("source_type", "target"), False),
    ("cancel_scan", "scans:cancel", ("scan_id",), False),
    ("request_remediation", "remediation:request", ("credential_id",), False),
    ("execute_remediation", "remediation:execute", ("remediation_id",), False),
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, list(a), i) for n, s, a, i in CATALOGUE], "tool string, scope string, arguments array<string>, implemented boolean")


def listed(df: DataFrame, key: str, limit: int = 0, **equal: str | None) -> DataFrame:
    """Rows equal in all given columns (None: any), ordered by ``key``; at most ``limit`` if that is above 0."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    out = df.orderBy(key)
    return out.limit(limit) if limit > 0 else out


def one(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with a key; LookupError if there is none."""
    got = df.where(F.col(key) == value)
    if got.isEmpty():
        raise LookupError(f"no row with {key} {value!r}")
    return got


def dispatch(calls: DataFrame, tools: DataFrame, allowed_scopes: Sequence[str], approvals: dict[str, int] | None = None, limiter: Column | None = None) -> DataFrame:
    """``result`` and ``reason`` of each call (call_id, principal, scopes, tool, arguments): the first gate that stops it, or allowed.

    Gates in order: the tool is known, the principal holds its scope, policy allows that scope, no approval is
    pending, no argument is foreign, the rate limit (a boolean column, NULL passes) has room.
    """
    rows = calls.join(tools.select("tool", F.col("scope").alias("needs"), F.col("arguments").alias("takes")), "tool", "left")
    foreign = F.array_sort(F.array_except(F.coalesce("arguments", F.array().cast("array<string>")), "takes"))
    pending = F.lit(0)
    for scope, n in (approvals or {}).items():
        pending = F.when(F.col("needs") == scope, n).otherwise(pending)
    gates = [
        (F.col("needs").isNull(), "denied_unknown_tool", F.col("tool")),
        (~F.array_contains(F.coalesce("scopes", F.array().cast("array<string>")), F.col("needs")), "denied_authz", F.col("needs")),
        (~F.col("needs").isin(*allowed_scopes) if allowed_scopes else F.lit(True), "denied_policy", F.col("needs")),
        (pending > 0, "denied_approval_pending", pending.cast("string")),
        (F.size(foreign) > 0, "denied_arguments", F.get(foreign, F.lit(0))),
        (~F.coalesce(limiter, F.lit(True)) if limiter is not None else F.lit(False), "denied_rate_limited", F.col("principal")),
    ]
    result = reduce(lambda acc, g: acc.when(g[0], g[1]), gates, F.when(F.lit(False), "")).otherwise("allowed")
    reason = reduce(lambda acc, g: acc.when(g[0], g[2]), gates, F.when(F.lit(False), "")).otherwise("")
    return rows.select("call_id", "principal", "tool", result.alias("result"), reason.alias("reason"))


def audit(decisions: DataFrame, at: str) -> DataFrame:
    """An audit row for every decision."""
    reason = F.when(F.col("reason") != "", F.create_map(F.lit("tool"), F.col("tool"), F.lit("reason"), F.col("reason"))).otherwise(F.create_map(F.lit("tool"), F.col("tool")))
    return decisions.select(
        F.col("principal").alias("actor"), F.concat(F.lit("tool_call:"), "tool").alias("action"), F.col("tool").alias("resource"), "result",
        F.col("call_id").cast("string").alias("request_id"), instant(at).alias("at"), reason.alias("metadata"),
    )
