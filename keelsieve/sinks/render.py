"""Findings and correlation results as lines, documents and exit states."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.operators.detect import severity_rank
from keelsieve.schemas import FINDING_JSON

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
MESSAGE_BYTES = 256 * 1024


def text_lines(findings: DataFrame) -> DataFrame:
    """One line per finding."""
    return findings.select("id", F.format_string("[%s] %s %s (confidence %.2f) %s", F.upper("severity"), "rule_id", "path", "confidence", "masked_prefix").alias("line"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def fails(findings: DataFrame, severity: str) -> bool:
    """Whether any finding is at least as severe: the exit state of a gate."""
    least = {"low": 1, "medium": 2, "high": 3, "critical": 4}[severity]
    return not findings.where(severity_rank(F.col("severity")) >= least).isEmpty()


def json_documents(findings: DataFrame) -> DataFrame:
    """Each finding as a JSON document with the exchanged field names."""
    body = F.struct(*[F.col(c).alias(n) for n, c in FINDING_JSON.items() if c in findings.columns])
    return findings.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_json(findings: DataFrame, path: str) -> None:
    """JSON lines, written by all tasks."""
    findings.select(*[F.col(c).alias(n) for n, c in FINDING_JSON.items() if c in findings.columns]).write.mode("overwrite").json(path)


def explain_lines(explained: DataFrame) -> DataFrame:
    return explained.select("id", "signal_no", F.format_string("%s %s %+.2f", "rule_id", "signal", "signal_score").alias("line"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """The results of a SARIF run, one JSON document per row: write them as lines, or join few into a log."""
    base = F.create_map(F.lit("fingerprint"), F.col("fingerprint"), F.lit("maskedValue"), F.col("masked_prefix"))
    properties = F.when(F.coalesce("commit_sha", F.lit("")) != "", F.map_concat(base, F.create_map(F.lit("commit"), F.col("commit_sha")))).otherwise(base)
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    body = F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"),
        F.struct(F.concat(F.lit("Potential "), "type", F.lit(" detected (masked: "), "masked_prefix", F.lit(")")).alias("text")).alias("message"),
        place.alias("locations"), properties.alias("properties"),
    )
    return findings.select("id", "rule_id", sarif_level(F.col("severity")).alias("level"), F.to_json(body).alias("result"))


def sarif_log(findings: DataFrame, tool: str, version: str, information_uri: str = "", most: int = 100_000) -> str:
    """A whole SARIF log as text. It is one document on the driver; ValueError above ``most`` results, for which there are result lines."""
    rows = sarif_results(findings).orderBy("id").select("result").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results; write sarif_results as lines instead")
    rules = [{"id": r["rule_id"]} for r in findings.select("rule_id").distinct().orderBy("rule_id").collect()]
    driver = {"name": tool, "informationUri": information_uri, "version": version, "rules": rules}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": driver}, "results": [json.loads(r["result"]) for r in rows]}]}, indent=2)


def correlation_documents(credentials: DataFrame, exposures: DataFrame) -> DataFrame:
    """Exposure rows beside their credential: the flat form of the correlation report, any number of exposures each."""
    e = exposures.select(F.col("credential_id").alias("id"), F.col("id").alias("exposure_id"), "source_type", "source_uri", "path", "commit_sha")
    return credentials.select("id", "provider", "kind", "status", "exposure_count").join(e, "id")


def correlation_lines(credentials: DataFrame, exposures: DataFrame, incidents: DataFrame, risk: DataFrame | None = None, enrichments: DataFrame | None = None) -> DataFrame:
    """A correlation document as lines (``kind``, ``id``, ``document``): one per credential, exposure and incident, and per assessment and enrichment where given.

    A line each, as a credential may have any number of exposures. What was not worked out has no line.
    """
    out = None
    for kind, df in (("credential", credentials), ("exposure", exposures), ("incident", incidents), ("risk", risk), ("enrichment", enrichments)):
        if df is not None:
            rows = df.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*df.columns)).alias("document"))
            out = rows if out is None else out.unionByName(rows)
    return out


def quality_lines(confusion: DataFrame, name: str) -> DataFrame:
    """A benchmark's results, one line per row of counts."""
    return confusion.select(F.format_string("%s: precision %.2f, recall %.2f (tp %d, fn %d, fp %d, tn %d)", name, "precision", "recall", "tp", "fn", "fp", "tn").alias("line"))


def publishable(messages: DataFrame, body: str = "body", most: int = MESSAGE_BYTES) -> DataFrame:
    """Messages within a queue's size limit."""
    return messages.where(F.octet_length(body) <= most)


def append_audit(events: DataFrame, path: str) -> None:
    """Audit rows appended as JSON lines."""
    events.write.mode("append").json(path)
