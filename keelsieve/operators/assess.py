"""Scores as products of named factors, lookups and first-match tables, all driven by data passed in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.functions.normalise import utc_micros

# Default multipliers.
PROVIDER = {"aws": 1.5, "gcp": 1.5, "azure": 1.5, "github": 1.2, "gitlab": 1.2, "stripe": 1.2}
PUBLIC, PRIVATE = 1.6, 1.0
AGE_HOURS = ((24, 1.0), (7 * 24, 1.1), (30 * 24, 1.25), (180 * 24, 1.4))
LEVELS = ((6.0, "CRITICAL"), (4.0, "HIGH"), (2.5, "MEDIUM"), (1.5, "LOW"))
OTHER_SOURCE, OLDEST, MOST = 1.2, 1.6, 10.0
NAMES = ("exposure", "visibility", "provider", "age", "reuse", "confidence")


def lookup(c: Column, table: dict, default) -> Column:
    """A small fixed mapping as an expression."""
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), default)).otherwise(default)


def bucketed(c: Column, steps: Sequence[tuple[float, float]], beyond: float) -> Column:
    """The value of the first step whose bound lies above ``c``; NULL takes the first value."""
    return reduce(lambda acc, s: acc.when(c < s[0], s[1]), steps, F.when(c.isNull(), steps[0][1])).otherwise(beyond)


def _place() -> Column:
    return F.concat_ws(":", "source_type", F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("source_uri")))


def exposure_factors(exposures: DataFrame) -> DataFrame:
    """Per credential: number of exposures and source types, and the most visible place (largest factor, first by id on ties) with a reason.

    A place marked public counts as public; then one of the web; then one marked private; then a local file; any other is unknown.
    """
    marked = F.lower(F.trim("visibility")) if "visibility" in exposures.columns else F.lit(None).cast("string")
    web, local = F.col("source_type").isin("web_page", "web_script"), F.col("source_type").isin("git_working_tree", "file")
    steps = ((marked == "public", PUBLIC, "is marked public"), (web, PUBLIC, "is on the web"), (marked == "private", PRIVATE, "is marked private"), (local, PRIVATE, "is a local file"))
    weight = reduce(lambda acc, s: acc.when(s[0], s[1]), steps, F.when(F.lit(False), 0.0)).otherwise(OTHER_SOURCE)
    why = reduce(lambda acc, s: acc.when(s[0], s[2]), steps, F.when(F.lit(False), "")).otherwise("has no known visibility")
    rows = exposures.select("credential_id", "source_type", "id", weight.alias("w"), F.concat(_place(), F.lit(" "), why).alias("why"))
    return rows.groupBy("credential_id").agg(
        F.count(F.lit(1)).alias("exposure_count"), F.count_distinct("source_type").alias("source_types"),
        F.max("w").alias("visibility"), F.min_by("why", F.struct(-F.col("w"), F.col("id"))).alias("visibility_reason"),
    )


def assess(credentials: DataFrame, exposures: DataFrame, as_of: str) -> DataFrame:
    """Factors with their reasons, ``score`` (their product in listed order, at most 10) and ``level`` of every credential.

    A credential without exposures counts as one place of unknown kind; a NULL first_seen counts as new.
    """
    e = exposure_factors(exposures)
    rows = credentials.select("id", "provider", "first_seen").join(e.withColumnRenamed("credential_id", "id"), "id", "left")
    n = F.greatest(F.coalesce("exposure_count", F.lit(1)), F.lit(1))
    kinds = F.greatest(F.coalesce("source_types", F.lit(1)), F.lit(1))
    hours = (utc_micros(F.lit(as_of)) - F.unix_micros("first_seen")) / F.lit(3_600_000_000)
    rows = rows.select(
        "id", "provider", (F.lit(1.0) + F.lit(0.15) * F.least(n - 1, F.lit(10))).alias("exposure_factor"), F.coalesce("visibility", F.lit(OTHER_SOURCE)).alias("visibility_factor"),
        lookup(F.lower("provider"), PROVIDER, 1.0).alias("provider_factor"), bucketed(hours, AGE_HOURS, OLDEST).alias("age_factor"),
        (F.lit(1.0) + F.lit(0.2) * F.least(kinds - 1, F.lit(4))).alias("reuse_factor"), F.lit(1.0).alias("confidence_factor"),
        F.format_string("seen in %d places", n).alias("exposure_reason"), F.coalesce("visibility_reason", F.lit("no place is known")).alias("visibility_reason"),
        F.format_string("provider %s", "provider").alias("provider_reason"),
        F.when(hours.isNull(), "first time unknown").otherwise(F.format_string("first seen %d hours ago", F.floor(hours).cast("long"))).alias("age_reason"),
        F.format_string("found in %d kinds of source", kinds).alias("reuse_reason"), F.lit("not weighed").alias("confidence_reason"),
    )
    rows = rows.withColumn("score", F.least(F.lit(MOST), reduce(lambda a, b: a * b, [F.col(f"{x}_factor") for x in NAMES])))
    level = reduce(lambda acc, s: acc.when(F.col("score") >= s[0], s[1]), LEVELS, F.when(F.lit(False), ""))
    return rows.withColumn("level", level.otherwise("INFO"))


def factors(assessed: DataFrame) -> DataFrame:
    """One row per factor of each credential: multiplier and reason."""
    parts = [F.struct(F.lit(n).alias("factor"), F.col(f"{n}_factor").alias("multiplier"), F.col(f"{n}_reason").alias("reason")) for n in NAMES]
    return assessed.select("id", F.posexplode(F.array(*parts)).alias("factor_no", "f")).select("id", "factor_no", "f.*")


def enrich(credentials: DataFrame, kinds: DataFrame, known: float = 0.30, unknown: float = 0.15) -> DataFrame:
    """Credential type and confidence of the providers that ``kinds`` (provider, kind, credential_type) covers."""
    covered = credentials.join(kinds.select("provider").distinct(), "provider", "left_semi")
    out = covered.join(kinds, ["provider", "kind"], "left")
    return out.select("id", "provider", F.coalesce("credential_type", F.lit("unknown")).alias("credential_type"), F.when(F.col("credential_type").isNotNull(), known).otherwise(unknown).alias("confidence"))


def enrich_all(credentials: DataFrame, enrichers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """Results of every enricher (id, provider, credential_type, confidence) with its name as ``source``, and the errors by name.

    An enricher decides which credentials it covers. One that raises, or that lacks a column, is left out with its error;
    the others' results stay. No enricher gives no rows.
    """
    spark = credentials.sparkSession
    out = spark.createDataFrame([], "source string, id string, provider string, credential_type string, confidence double")
    errors: dict[str, str] = {}
    for name, run in enrichers.items():
        try:
            got = run(credentials).select(F.lit(name).alias("source"), "id", "provider", "credential_type", F.col("confidence").cast("double"))
        except Exception as e:  # whatever an enricher raises is its own matter
            errors[name] = f"{type(e).__name__}: {e}"
            continue
        out = out.unionByName(got)
    return out, errors


def first_match(rows: DataFrame, table: Sequence[dict], on: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Columns of the first entry of an ordered table that agrees with a row in ``on``; a key left out of an entry agrees with anything.

    ``values`` maps result columns to SQL types. Rows that no entry fits have NULL there. The table is a short list known to the driver.
    """
    out = rows
    for name, kind in values.items():
        expr = None
        for entry in table:
            fits = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(entry[k])) for k in on if k in entry], F.lit(True))
            value = F.lit(entry.get(name)).cast(kind)
            expr = F.when(fits, value) if expr is None else expr.when(fits, value)
        out = out.withColumn(name, expr if expr is not None else F.lit(None).cast(kind))
    return out


def illegal_steps(log: DataFrame, edges: DataFrame, key: str, order: Sequence[str], state: str = "state") -> DataFrame:
    """Consecutive states of a key that no row of ``edges`` (from_state, to_state) allows; staying is allowed."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(*order)
    steps = log.select(key, *[c for c in order if c != key], F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"))
    steps = steps.where("from_state IS NOT NULL AND to_state IS NOT NULL AND from_state != to_state")
    return steps.join(edges, ["from_state", "to_state"], "left_anti")
