"""Per-key results under heavy skew, by multi-level tree aggregation.

Every input split first combines its own rows (the map side of the first
exchange). The partial states of a key then meet in rounds: in each, at most
``fan_in`` neighbouring partials of a key go to one reducer, so that no reducer
ever receives all of them, however many rows a key has. The number of rounds is
the logarithm of the number of splits to the base ``fan_in``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keelsieve.functions.normalise import fingerprint_hex, squeezed
from keelsieve.shared import input_splits

FAN_IN = 16
#: The states of a (key, place) pair are three numbers, so more of them may meet at once.
PLACE_FAN_IN = 1024


def tree_rounds(splits: int, fan_in: int = FAN_IN) -> int:
    """Rounds after which ``splits`` partials of one key are a single state."""
    n, reach = 1, fan_in
    while reach < splits:
        n, reach = n + 1, reach * fan_in
    return n


def tree_aggregate(df: DataFrame, keys: Sequence[str], merges: dict[str, Column], splits: int, fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate by ``keys`` in fan-in rounds.

    ``merges`` names each state column with an aggregate of itself that is associative
    and maps states to a state (``{"n": F.sum("n")}``). Empty input gives no rows; NULL
    keys form a group as in ``groupBy``.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    level = df.withColumn("__part", F.spark_partition_id())
    rounds = tree_rounds(splits, fan_in)
    for r in range(rounds, 0, -1):
        # neighbours that share part // fan_in**(rounds - r + 1) meet; the last round leaves one group
        last = r == 1
        group = [F.col(k) for k in keys] + ([] if last else [F.floor(F.col("__part") / F.lit(fan_in)).cast("int").alias("__part")])
        level = level.groupBy(*group).agg(*[c.alias(n) for n, c in merges.items()])
    return level


def keyed_statistics(findings: DataFrame, fan_in: int = FAN_IN, place_fan_in: int = PLACE_FAN_IN) -> DataFrame:
    """Rows, first and last ``created_at`` and number of places of every fingerprint and rule.

    Result: ``key_name`` (``fingerprint`` or ``rule_id``), ``key_value``, ``row_count``,
    ``first_created_at``, ``last_created_at``, ``places``. A place is a distinct pair of
    source_uri and path; absent and empty count alike. Absent keys belong to no group;
    NULL created_at and those of an unset clock (before 1971) count as rows but set no
    bounds. An empty table gives no rows.

    A first tree folds the rows of each (key, place), whose hash spreads them over all
    reducers; a second tree folds the places of each key.
    """
    splits = input_splits(findings)
    seen = F.when(F.unix_micros("created_at") >= 365 * 86_400_000_000, F.unix_micros("created_at"))
    place = F.unhex(F.md5(F.concat_ws("\n", F.coalesce("source_uri", F.lit("")), F.coalesce("path", F.lit("")))))
    rows = findings.select(
        F.inline(F.array(
            F.struct(F.lit("fingerprint").alias("key_name"), fingerprint_hex("fingerprint").alias("key_value")),
            F.struct(F.lit("rule_id").alias("key_name"), squeezed("rule_id").alias("key_value")),
        )),
        place.alias("__place"),
        seen.alias("__at"),
    ).where("key_value IS NOT NULL")
    folds = {"row_count": F.sum("row_count"), "lo": F.min("lo"), "hi": F.max("hi")}
    rows = rows.select("key_name", "key_value", "__place", F.lit(1).cast("long").alias("row_count"), F.col("__at").alias("lo"), F.col("__at").alias("hi"))
    by_place = tree_aggregate(rows, ["key_name", "key_value", "__place"], folds, splits, place_fan_in)
    by_place = by_place.withColumn("places", F.lit(1).cast("long")).drop("__place")
    reducers = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = tree_aggregate(by_place, ["key_name", "key_value"], folds | {"places": F.sum("places")}, reducers, fan_in)
    return out.select(
        "key_name", "key_value", "row_count",
        F.timestamp_micros("lo").alias("first_created_at"), F.timestamp_micros("hi").alias("last_created_at"),
        "places",
    )


def heavy_keys(findings: DataFrame, per_mille: int = 15, fan_in: int = FAN_IN) -> DataFrame:
    """Keys holding at least ``per_mille`` of all rows, absent keys included in the total."""
    total = findings.count()  # one number, from file footers where the source has them
    return keyed_statistics(findings, fan_in).where(F.col("row_count") * 1000 >= F.lit(per_mille * total)).select("key_name", "key_value")
