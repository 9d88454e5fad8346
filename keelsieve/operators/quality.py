"""Detection quality against labelled samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def outcomes(samples: DataFrame, found: DataFrame, key: str = "artifact_id", label: str = "expected") -> DataFrame:
    """``tp``, ``fn``, ``fp`` or ``tn`` of each sample; one finding is enough to flag it. A NULL label counts as negative."""
    flagged = found.select(key).distinct().withColumn("flagged", F.lit(True))
    rows = samples.select(key, F.coalesce(label, F.lit(False)).alias("expected")).join(flagged, key, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    kind = F.when(F.col("expected") & F.col("flagged"), "tp").when(F.col("expected"), "fn").when(F.col("flagged"), "fp").otherwise("tn")
    return rows.withColumn("outcome", kind)


def confusion(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of outcomes with precision, recall and F1 (0 where a denominator is 0)."""
    counts = [F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fn", "fp", "tn")]
    out = rows.groupBy(*([by] if by else [])).agg(*counts)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
