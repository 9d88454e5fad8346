"""Column layouts of the entities that pass between stages."""

from __future__ import annotations

ARTIFACT = (
    "artifact_id string, source_type string, uri string, path string, commit_sha string, mime_type string,"
    " content string, metadata map<string,string>, fetched_at timestamp"
)
SIGNAL = "struct<name:string,score:double,reason:string>"
SCORE = f"struct<signals:array<{SIGNAL}>,deterministic_score:double,llm_adjustment:double,final_score:double>"
PROVENANCE = f"struct<signals:array<{SIGNAL}>,ruleset_version:string,detector_version:string,created_at:timestamp>"
FINDING = (
    "id string, rule_id string, type string, severity string, confidence double, fingerprint string, masked_prefix string,"
    " length int, source_type string, source_uri string, path string, commit_sha string, state string,"
    f" created_at timestamp, updated_at timestamp, metadata map<string,string>, provenance {PROVENANCE}"
)
CREDENTIAL = "id string, fingerprint string, provider string, kind string, status string, first_seen timestamp, last_seen timestamp, exposure_count long"
EXPOSURE = "id string, credential_id string, source_type string, source_uri string, path string, commit_sha string, visibility string, first_seen timestamp, last_seen timestamp"
INCIDENT = "id string, credential_id string, status string, exposure_ids array<string>, created_at timestamp, updated_at timestamp"
AUDIT = "actor string, action string, resource string, result string, request_id string, at timestamp, metadata map<string,string>"
FRONTIER = "scan_id string, url string, depth int"

#: Field names of findings documents as they are exchanged, in the order of FINDING.
FINDING_JSON = {
    "ID": "id", "RuleID": "rule_id", "Type": "type", "Severity": "severity", "Confidence": "confidence", "Fingerprint": "fingerprint",
    "MaskedPrefix": "masked_prefix", "Length": "length", "SourceType": "source_type", "SourceURI": "source_uri", "Path": "path",
    "Commit": "commit_sha", "State": "state", "CreatedAt": "created_at", "UpdatedAt": "updated_at", "Metadata": "metadata",
}
FINDING_JSON_SCHEMA = (
    "ID string, RuleID string, Type string, Severity string, Confidence double, Fingerprint string, MaskedPrefix string, Length int,"
    " SourceType string, SourceURI string, Path string, Commit string, State string, CreatedAt timestamp, UpdatedAt timestamp, Metadata map<string,string>"
)
