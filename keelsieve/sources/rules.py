"""The rule catalogue: what to match and how to score it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from keelsieve.functions import patterns

SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    regex: str
    severity: str
    confidence: float
    secret_group: int = 0
    keywords: tuple[str, ...] = ()
    negative_keywords: tuple[str, ...] = ()
    entropy_enabled: bool = False
    entropy_threshold: float = 0.0
    #: Lower-case literals of which the regex itself demands one, if it does: texts without any are skipped.
    demands: tuple[str, ...] = ()


# The built-in detection rules.
BUILTIN = (
    Rule("aws-access-key-id", "Key id of an AWS user or role", r"\b((?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[A-Z0-9]{16})\b", "high", 0.98, 1,
         ("aws", "access_key", "aws_access_key_id"), ("example", "placeholder", "dummy"),
         demands=("akia", "asia", "agpa", "aida", "aroa", "aipa", "anpa", "anva", "asca")),
    Rule("aws-secret-access-key", "Secret half of an AWS key pair", r"""(?i)aws_secret_access_key\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})["']?""", "critical", 0.9, 1,
         ("aws", "secret_access_key", "aws_secret_access_key"), ("example", "placeholder", "dummy"), True, 4.2, ("aws_secret_access_key",)),
    Rule("generic-api-key-assignment", "Something named key, secret or token set to a literal", r"""(?i)(api[_-]?key|secret|token)\s*[:=]\s*["']([A-Za-z0-9_\-/+=]{20,})["']""", "medium", 0.5, 2,
         ("api_key", "secret", "token"), ("example", "placeholder", "your_api_key", "changeme"), True, 3.5, ("apikey", "api_key", "api-key", "secret", "token")),
    Rule("generic-jwt", "Signed web token", r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b", "medium", 0.6, 1,
         (), ("example", "sample"), True, 4.0, ("eyj",)),
    Rule("generic-password-assignment", "Something named password set to a literal", r"""(?i)(password|passwd|pwd)\s*[:=]\s*["']([^"'\s]{8,})["']""", "medium", 0.4, 2,
         ("password", "passwd", "pwd"), ("example", "placeholder", "changeme", "password123"), demands=("passw", "pwd")),
    Rule("github-pat-classic", "Old-style GitHub token", r"\b(ghp_[A-Za-z0-9]{36})\b", "high", 0.97, 1,
         ("github", "token", "ghp_"), ("example", "placeholder"), demands=("ghp_",)),
    Rule("github-pat-fine-grained", "New-style GitHub token", r"\b(github_pat_[A-Za-z0-9_]{22,255})\b", "high", 0.97, 1,
         ("github", "token"), ("example", "placeholder"), demands=("github_pat_",)),
    Rule("pem-private-key", "Head of a private key", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|PGP) )?PRIVATE KEY-----", "critical", 0.99, 0, demands=("private key-----",)),
    Rule("stripe-secret-key-live", "Stripe key of live mode", r"\b(sk_live_[A-Za-z0-9]{24,247})\b", "critical", 0.98, 1, ("stripe",), ("example", "placeholder"), demands=("sk_live_",)),
    Rule("stripe-secret-key-test", "Stripe key of test mode", r"\b(sk_test_[A-Za-z0-9]{24,247})\b", "low", 0.9, 1, ("stripe",), (), demands=("sk_test_",)),
)


def validate(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    """Rules in order of their id; ValueError for a rule that cannot work or an id given twice."""
    seen: dict[str, Rule] = {}
    for r in rules:
        if not r.id or not r.regex:
            raise ValueError(f"rule {r.id!r}: id and regex are required")
        if r.id in seen:
            raise ValueError(f"rule {r.id!r} is given twice")
        if not 0 <= r.confidence <= 1:
            raise ValueError(f"rule {r.id!r}: confidence outside 0..1")
        if r.severity not in SEVERITIES:
            raise ValueError(f"rule {r.id!r}: unknown severity {r.severity!r}")
        try:
            p = patterns.read(r.regex)
            re.compile(p.plain())
        except (ValueError, re.error) as e:
            raise ValueError(f"rule {r.id!r}: {e}") from None
        groups = p.groups
        if not 0 <= r.secret_group <= groups:
            raise ValueError(f"rule {r.id!r}: secret_group {r.secret_group} of {groups}")
        seen[r.id] = r
    return tuple(seen[k] for k in sorted(seen))


def checksum(rules: Iterable[Rule]) -> str:
    """Version of a rule set: changes with anything that changes a score, not with names."""
    lines = []
    for r in rules:
        flag = "true" if r.entropy_enabled else "false"
        lines.append(f"{r.id}|{r.regex}|{r.secret_group}|{','.join(r.keywords)}|{','.join(r.negative_keywords)}|{flag}|{r.entropy_threshold:.4f}|{r.severity}|{r.confidence:.4f}\n")
    return "sha256:" + hashlib.sha256("".join(sorted(lines)).encode()).hexdigest()[:16]


def load(folder: str | Path) -> tuple[Rule, ...]:
    """Rules of all YAML files below a folder. Needs PyYAML, which is not otherwise used."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading rule files needs PyYAML") from e
    found = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml")):
        for raw in yaml.safe_load(path.read_text()) or []:
            entropy = raw.get("entropy") or {}
            found.append(Rule(
                raw.get("id", ""), raw.get("name", ""), raw.get("regex", ""), raw.get("severity", ""), float(raw.get("confidence", 0)), int(raw.get("secret_group", 0)),
                tuple(raw.get("keywords") or ()), tuple(raw.get("negative_keywords") or ()), bool(entropy.get("enabled", False)), float(entropy.get("threshold", 0)),
            ))
    return validate(found)


def as_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """The catalogue as a DataFrame, for listing and joins."""
    rows = [(r.id, r.name, r.regex, r.severity, r.confidence, r.secret_group, list(r.keywords), list(r.negative_keywords), (r.entropy_enabled, r.entropy_threshold)) for r in rules]
    schema = "rule_id string, rule_name string, regex string, severity string, confidence double, secret_group int, keywords array<string>, negative_keywords array<string>, entropy struct<enabled:boolean,threshold:double>"
    return spark.createDataFrame(rows, schema)
