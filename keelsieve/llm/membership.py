"""Has a key been seen before: an approximate filter first, full keys on disk second.

The filter is a table of 512-bit blocks: a key's hash picks one block and one bit in
each of its eight words. It is built by grouping, merged by bitwise union and tested by
a join on the block number, so no task ever holds more than its share of blocks.
A negative is final. A positive goes on to the full keys, which lie in folders by range
of blocks: only the folders with positives are read. Positives disproved there are the
filter's errors, and are counted, not estimated. A batch's new keys enter both. The store
is a folder with a short description of itself and can be opened again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keelsieve.shared import exists, folders, new_path, read_text, remove, write_table, write_text

BITS_PER_KEY = 12
WORDS = [f"w{i}" for i in range(8)]
#: Keys that a folder is meant to hold when a store is made; and the least and greatest number of folders.
SLOT_KEYS, LEAST_SLOTS, MOST_SLOTS = 1_000_000, 8, 4096
#: Parts of a filter, one a batch, after which they are merged.
MERGE_EVERY = 8
_ABOUT = "about.json"


def blocks_for(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, math.ceil(keys * bits_per_key / 512))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(101)), F.lit(blocks).cast("long"))


def _bits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(8)]


def build_filter(keys: DataFrame, column: str, blocks: int, parts: Sequence[str] = ()) -> DataFrame:
    """Blocks (``parts``, ``block``, ``w0`` .. ``w7``) of distinct non-NULL keys; a filter for each value of ``parts``."""
    rows = keys.select(*parts, _block(F.col(column), blocks).alias("block"), F.xxhash64(F.col(column), F.lit(202)).alias("h"))
    rows = rows.select(*parts, "block", *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("h")))])
    return rows.groupBy(*parts, "block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(w) for i, w in enumerate(WORDS)])


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two filters of the same number of blocks."""
    return a.unionByName(b).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def probe(keys: DataFrame, column: str, blocks_table: DataFrame, blocks: int, parts: Sequence[str] = ()) -> DataFrame:
    """``keys`` with ``maybe``: false where the filter (that of its ``parts``) rules the key out."""
    asked = keys.withColumn("block", _block(F.col(column), blocks)).withColumn("__h", F.xxhash64(F.col(column), F.lit(202)))
    hit = F.lit(True)
    for w, b in zip(WORDS, _bits(F.col("__h"))):
        hit = hit & (F.call_function("getbit", F.col(w), b) == 1)
    return asked.join(blocks_table, [*parts, "block"], "left").withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "__h", *WORDS)


class KeyStore:
    """Full keys in folders by range of blocks, and a filter over them in parts that are merged from time to time."""

    def __init__(self, spark: SparkSession, path: str, blocks: int, slots: int, bits_per_key: int, keys: int, parts: list[int]) -> None:
        self.spark, self.path, self.blocks, self.slots, self.bits_per_key, self.keys, self.parts = spark, path.rstrip("/"), blocks, slots, bits_per_key, keys, parts

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: DataFrame | None = None, bits_per_key: int = BITS_PER_KEY) -> KeyStore:
        """A store of the distinct non-NULL ``keys`` (``k`` binary), with room for half as many again before its filter is made anew."""
        if exists(spark, f"{path}/{_ABOUT}"):
            raise ValueError(f"{path} already holds a store")
        store = cls(spark, path, 1, 1, bits_per_key, 0, [])
        if keys is None:
            store._save()
            return store
        whole = write_table(keys.where("k IS NOT NULL").distinct(), new_path(spark, "first-keys"))
        n = whole.count()
        store.slots = max(LEAST_SLOTS, min(MOST_SLOTS, n // SLOT_KEYS))
        store.blocks = max(store.slots, blocks_for(n + n // 2, bits_per_key))
        store.add(whole, n)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyStore:
        return cls(spark, path, **json.loads(read_text(spark, f"{path}/{_ABOUT}")))

    def _save(self) -> None:
        about = {x: getattr(self, x) for x in ("blocks", "slots", "bits_per_key", "keys", "parts")}
        write_text(self.spark, f"{self.path}/{_ABOUT}", json.dumps(about))

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("k", F.lit(303)), F.lit(self.slots).cast("long")).cast("int")

    def full_keys(self, slots: Sequence[int] | None = None) -> DataFrame:
        """The keys (``k``) of the folders of ``slots``, or of all."""
        paths = [f"{self.path}/keys/part={p}" for p in self.parts]
        if slots is not None:
            wanted = {f"slot={s}" for s in slots}
            paths = [f"{p}/{name}" for p in paths for name in folders(self.spark, p) if name in wanted]
        return self.spark.read.schema("k binary").option("basePath", f"{self.path}/keys").parquet(*paths).select("k") if paths else self.spark.createDataFrame([], "k binary")

    def _filter(self) -> DataFrame:
        got = self.spark.read.schema("block long, " + ", ".join(f"{w} long" for w in WORDS)).parquet(*[f"{self.path}/filter-{p}" for p in self.parts])
        return got if len(self.parts) == 1 else got.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])

    def add(self, keys: DataFrame, n: int) -> None:
        """``n`` keys that are not in the store yet. Beyond its room the filter is made anew from the full keys, twice as large."""
        part = 1 + max(self.parts, default=0)
        self._lay(keys, part)
        build_filter(self.spark.read.schema("k binary").parquet(f"{self.path}/keys/part={part}"), "k", self.blocks).write.mode("overwrite").parquet(f"{self.path}/filter-{part}")
        self.parts, self.keys = [*self.parts, part], self.keys + n
        room = self.blocks * 512 // self.bits_per_key
        if len(self.parts) >= MERGE_EVERY or self.keys > room:
            self._merge(2 * blocks_for(self.keys, self.bits_per_key) if self.keys > room else self.blocks)
        self._save()

    def _lay(self, keys: DataFrame, part: int) -> None:
        keys.select("k", self._slot().alias("slot")).repartition("slot").sortWithinPartitions("slot", "k").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/keys/part={part}")

    def _merge(self, blocks: int) -> None:
        old, part = self.parts, 1 + max(self.parts)
        keys = self.full_keys()
        self._lay(keys, part)
        made = self._filter() if blocks == self.blocks else build_filter(keys, "k", blocks)
        made.write.mode("overwrite").parquet(f"{self.path}/filter-{part}")
        self.parts, self.blocks = [part], blocks
        self._save()
        for p in old:
            remove(self.spark, f"{self.path}/keys/part={p}")
            remove(self.spark, f"{self.path}/filter-{p}")

    def check(self, first: DataFrame) -> DataFrame:
        """``k``, ``n`` and ``route`` of the different keys of a batch (``k``, ``n``): negative, verified or disproved. New ones enter the store."""
        if not self.parts:
            routed = write_table(first.select("k", "n", F.lit("negative").alias("route")), new_path(self.spark, "routed"))
        else:
            tested = write_table(probe(first, "k", self._filter(), self.blocks).withColumn("slot", self._slot()), new_path(self.spark, "tested"))
            positives = tested.where("maybe")
            slots = [r[0] for r in positives.select("slot").distinct().collect()]  # at most MOST_SLOTS
            # the positives are the small side: the full keys of the touched folders stay where they are
            found = self.full_keys(slots).join(positives.select("k"), "k", "left_semi").select("k", F.lit("verified").alias("found"))
            routed = tested.join(found, "k", "left").select("k", "n", F.when(~F.col("maybe"), "negative").otherwise(F.coalesce("found", F.lit("disproved"))).alias("route"))
            routed = write_table(routed, new_path(self.spark, "routed"))
        fresh = routed.where("route != 'verified'")
        n = fresh.count()
        if n:
            if not self.parts:
                self.slots, self.blocks = LEAST_SLOTS, max(LEAST_SLOTS, blocks_for(2 * n, self.bits_per_key))
            self.add(fresh.select("k"), n)
        return routed


def seen_before(history: DataFrame | None, stream: DataFrame, key: str, order: str, bits_per_key: int = BITS_PER_KEY, path: str | None = None) -> DataFrame:
    """One row per stream row with a key: ``order``, ``batch_no``, ``seen`` and ``route``.

    ``route``: ``repeat`` (its key came earlier in the stream), ``negative`` (ruled out by the filter), ``verified`` or
    ``disproved`` (a positive of the filter, looked up among the full keys). Rows without a key equal nothing and are left
    out. An empty history makes every first key negative. What is given together is looked up together; call it for each
    arrival with ``path``: the store there is used and kept, ``history`` is laid into it only if it is new and may be None
    afterwards. Order has to go on rising from call to call.
    """
    spark = stream.sparkSession
    if path is not None and exists(spark, f"{path}/{_ABOUT}"):
        store = KeyStore.open(spark, path)
    else:
        store = KeyStore.create(spark, path or new_path(spark, "keys"), None if history is None else history.select(F.unhex(key).alias("k")), bits_per_key)
    asked = stream.where(F.col(key).isNotNull()).select(F.unhex(key).alias("k"), F.col(order).alias("n"), "batch_no")
    marks = store.check(asked.groupBy("k").agg(F.min("n").alias("n"))).select("n", "route")
    out = asked.select("n", "batch_no").join(marks, "n", "left").withColumn("route", F.coalesce("route", F.lit("repeat")))
    return out.select(F.col("n").alias(order), "batch_no", F.col("route").isin("repeat", "verified").alias("seen"), "route")


def error_report(decisions: DataFrame) -> DataFrame:
    """By batch: first keys tested, positives, disproved ones and the filter's measured rate of wrong answers.

    Every positive is verified, so the rate of wrong final answers is zero; the filter's own rate is
    disproved / (disproved + negative).
    """
    count = lambda r: F.count_if(F.col("route") == r)
    out = decisions.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("row_count"), count("repeat").alias("repeats"), count("negative").alias("negatives"),
        count("verified").alias("verified"), count("disproved").alias("disproved"),
    )
    return out.withColumn("filter_error_rate", F.coalesce(F.try_divide(F.col("disproved"), F.col("disproved") + F.col("negatives")), F.lit(0.0)))
