"""Readers: files, labelled folders, findings and correlation documents, settings and prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelsieve.schemas import CREDENTIAL, EXPOSURE, FINDING_JSON, FINDING_JSON_SCHEMA, INCIDENT


def files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files as artifacts, each whole; the size limit is applied before anything is read. A missing path is an error.

    Files without a single byte are left out, as Spark's file scans do: nothing can be found in them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(paths if isinstance(paths, str) else list(paths))
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    plain = F.regexp_replace("path", r"^file:(?://)?", "")
    return df.select(
        F.sha2(F.col("path"), 256).alias("artifact_id"), F.lit("file").alias("source_type"), F.col("path").alias("uri"), plain.alias("path"), F.lit("").alias("commit_sha"),
        F.lit("").alias("mime_type"), F.col("content"), F.col("modificationTime").alias("fetched_at"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Samples below ``true_positive`` and ``false_positive`` folders, dot files left out."""
    df = files(spark, folder, recursive=True).where(~F.col("path").rlike(r"/\.[^/]*$"))
    df = df.withColumn("expected", F.when(F.col("path").contains("/true_positive/"), True).when(F.col("path").contains("/false_positive/"), False))
    return df.where("expected IS NOT NULL")


def findings_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Findings documents (an array, or lines), with ``seq`` in reading order and absent texts as the empty string."""
    raw = spark.read.schema(FINDING_JSON_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    texts = {"RuleID", "Type", "Severity", "Fingerprint", "MaskedPrefix", "SourceType", "SourceURI", "Path", "Commit", "State"}
    columns = [(F.coalesce(F.col(n), F.lit("")) if n in texts else F.col(n)).alias(c) for n, c in FINDING_JSON.items()]
    return raw.select(*columns, F.monotonically_increasing_id().alias("seq"))


def correlation_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of a correlation document."""
    kinds = {"credentials": CREDENTIAL, "exposures": EXPOSURE, "incidents": INCIDENT}
    schema = ", ".join(f"{k} array<struct<{', '.join(f'{x.strip().split(None, 1)[0]}:{x.strip().split(None, 1)[1]}' for x in v.split(', '))}>>" for k, v in kinds.items())
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    return {k: raw.select(F.inline(k)) for k in kinds}


@dataclass(frozen=True)
class Settings:
    """Job settings; ``of`` takes defaults, then a file's values, then explicit ones, and refuses unknown keys and values of another type."""

    rules_dir: str = "builtin"
    log_level: str = "info"
    offline: bool = True
    min_band: str = "low_confidence"
    fail_on: str = ""
    output: str = "text"
    max_depth: int = 2
    max_pages: int = 100
    obey_robots_txt: bool = True

    @classmethod
    def of(cls, file_values: dict | None = None, **explicit) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        merged = {**(file_values or {}), **{k: v for k, v in explicit.items() if v is not None}}
        for name, value in merged.items():
            if name not in kinds:
                raise ValueError(f"unknown setting {name}")
            if type(value) is not kinds[name]:
                raise ValueError(f"setting {name} needs {kinds[name].__name__}, not {type(value).__name__}")
        out = cls(**merged)
        if out.log_level not in ("debug", "info", "warn", "error"):
            raise ValueError(f"invalid log_level {out.log_level!r}")
        return out

    @classmethod
    def load(cls, path: str | Path, **explicit) -> Settings:
        """From a YAML file. Needs PyYAML; a file of plain ``key: value`` lines is read without."""
        text = Path(path).read_text()
        try:
            import yaml
        except ImportError:
            values = {}
            for line in text.splitlines():
                line = re.sub(r"(?:^|\s)#.*$", "", line).strip()
                m = re.fullmatch(r"(\w+):\s*(.*)", line)
                if line and not m:
                    raise ValueError(f"not a plain setting: {line!r}") from None
                if m:
                    v = m[2].strip()
                    values[m[1]] = {"true": True, "false": False}.get(v, int(v) if re.fullmatch(r"-?\d+", v) else v.strip("\"'"))
        else:
            values = yaml.safe_load(text) or {}
        if not isinstance(values, dict):
            raise ValueError("settings have to be keys with values")
        return cls.of(values, **explicit)


_FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*\n(.*)\Z", re.S)


def prompts(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Prompt templates (prompt_id, version, body) of a folder's Markdown files with id and version in front."""
    rows, seen = [], set()
    for path in sorted(Path(folder).glob("*.md")):
        m = _FRONT.match(path.read_text())
        head = dict(re.findall(r"(?m)^(\w+)\s*:\s*(.+?)\s*$", m[1])) if m else {}
        if not head.get("id") or not head.get("version", "").isdigit() or int(head["version"]) < 1:
            raise ValueError(f"{path.name}: needs an id and a version of 1 or more")
        key = (head["id"], int(head["version"]))
        if key in seen:
            raise ValueError(f"{path.name}: {key[0]} version {key[1]} is given twice")
        seen.add(key)
        rows.append((*key, m[2]))
    return spark.createDataFrame(rows, "prompt_id string, version int, body string")
