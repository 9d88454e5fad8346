"""New batches against all history: multi-key sorted-neighbourhood over persisted runs.

A *run* is a table of distinct (fingerprint, path, commit) with their first row, in folders of
fixed key ranges, sorted inside each by fingerprint, path and commit, so that equal records are
neighbours. Ranges hash fingerprint and path, so that no fingerprint makes one grow hot. A record
whose path hangs below an unknown machine root has a further key for each ending of that path,
and so sorts beside the relative path it may name. Beside each range lies a filter of its keys.

A batch becomes a run of its own. Its keys are tested against the filters of the older runs; only
the folders of ranges that may hold one are read, and of those only the windows around the
batch's keys. A scan over the sorted union compares each new entry with the neighbours whose
commits begin with its own or the other way round. Runs are merged in tiers. A store is a folder
with a list of its runs: it can be opened again, and the history is never laid a second time.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keelsieve.functions.normalise import checkout_path, commit_id, fingerprint_hex
from keelsieve.llm import membership
from keelsieve.shared import exists, folders, materialise, new_path, read_text, remove, write_table, write_text

#: Rows that a key range is meant to hold when a store is made; and its least and greatest number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 250_000, 8, 4096
COMPACT_EVERY = 4
_ENTRY = "fp string, p string, commit string, seq long, origin binary"
_LIST = "runs.json"


def normalised(df: DataFrame, *keep: str) -> DataFrame:
    """``fp``, ``p`` and ``commit`` of the rows that have all three, beside the columns to ``keep``."""
    rows = df.select(*keep, fingerprint_hex("fingerprint").alias("fp"), checkout_path("path").alias("p"), commit_id("commit_sha").alias("commit"))
    return rows.where("fp IS NOT NULL AND p IS NOT NULL AND commit IS NOT NULL")


def entries(rows: DataFrame, seq: Column) -> DataFrame:
    """Sorted-neighbourhood entries: ``fp``, ``p``, ``commit``, least ``seq``, and the ``origin`` of keys made from a path's ending."""
    parts = F.split(F.expr("substring(p, 3)"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    unknown = F.col("p").startswith("//")
    keys = F.when(unknown, F.concat(F.array("p"), ends)).otherwise(F.array("p"))
    rows = rows.select("fp", "commit", seq.cast("long").alias("seq"), F.col("p").alias("whole"), F.explode(keys).alias("p"))
    origin = F.when(F.col("p") != F.col("whole"), F.unhex(F.md5("whole")))
    return rows.groupBy("fp", "p", "commit", origin.alias("origin")).agg(F.min("seq").alias("seq")).select("fp", "p", "commit", "seq", "origin")


_NONE = (1 << 63) - 1


class _Open:
    """A commit on the scan's stack with the least rows of itself, of its prefixes and of its extensions.

    Each is a pair: least row of any entry, least row of entries that name the path itself."""

    __slots__ = ("commit", "here", "above", "below", "new")

    def __init__(self, commit: str, above: tuple[int, int]) -> None:
        self.commit, self.above, self.new = commit, above, []
        self.here = self.below = (_NONE, _NONE)


def _least(*pairs: tuple[int, int]) -> tuple[int, int]:
    return min(p[0] for p in pairs), min(p[1] for p in pairs)


def _scan(batches):
    """Of each new entry among entries sorted by fingerprint, path and commit: whether an earlier row is equal to it."""
    stack: list[_Open] = []
    at = None

    def close(out: list, upto: str | None) -> None:
        while stack and (upto is None or not upto.startswith(stack[-1].commit)):
            top = stack.pop()
            least = _least(top.here, top.above, top.below)
            # a key made from a path's ending may only meet the path itself
            out.extend((seq, whole, (least[0] if whole else least[1]) < seq) for seq, whole in top.new)
            if stack:
                stack[-1].below = _least(stack[-1].below, top.here, top.below)

    for pdf in batches:
        out: list[tuple] = []
        for fp, p, commit, seq, origin, new in zip(pdf["fp"], pdf["p"], pdf["commit"], pdf["seq"], pdf["origin"], pdf["new"]):
            close(out, commit if (fp, p) == at else None)
            at = (fp, p)
            if not (stack and stack[-1].commit == commit):
                stack.append(_Open(commit, _least(stack[-1].here, stack[-1].above) if stack else (_NONE, _NONE)))
            top, whole = stack[-1], origin is None
            top.here = _least(top.here, (seq, seq if whole else _NONE))
            if new:
                top.new.append((seq, whole))
        yield pd.DataFrame(out, columns=["seq", "whole", "refused"])
    out = []
    close(out, None)
    yield pd.DataFrame(out, columns=["seq", "whole", "refused"])


def _near() -> Column:
    """What records have to share to be compared: a hash of fingerprint, path and the commit's first seven digits. Others that share it are told apart by the scan."""
    return F.xxhash64("fp", "p", F.substring("commit", 1, 7))


class RunStore:
    """Persisted runs of everything seen so far, in key ranges, merged in tiers of ``compact_every``."""

    def __init__(self, spark: SparkSession, path: str, ranges: int, bits_per_key: int, compact_every: int, runs: list[dict]) -> None:
        self.spark, self.path, self.ranges, self.bits_per_key, self.compact_every = spark, path.rstrip("/"), ranges, bits_per_key, compact_every
        #: name, tier (-1: loaded history) and filter blocks of each run
        self.runs = runs

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int = 0, bits_per_key: int = membership.BITS_PER_KEY, compact_every: int = COMPACT_EVERY) -> RunStore:
        """An empty store meant for about ``rows`` rows; it takes any number, in larger ranges."""
        if exists(spark, f"{path}/{_LIST}"):
            raise ValueError(f"{path} already holds a store")
        store = cls(spark, path, max(LEAST_RANGES, min(MOST_RANGES, rows // RANGE_ROWS)), bits_per_key, compact_every, [])
        store._save()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStore:
        """The store at a path, as the last call left it."""
        return cls(spark, path, **json.loads(read_text(spark, f"{path}/{_LIST}")))

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/{_LIST}", json.dumps({"ranges": self.ranges, "bits_per_key": self.bits_per_key, "compact_every": self.compact_every, "runs": self.runs}))

    def _range(self) -> Column:
        return F.pmod(F.xxhash64("fp", "p"), F.lit(self.ranges)).cast("int")

    def _lay(self, rows: DataFrame, tier: int, n: int) -> dict:
        """Write a run of about ``n`` rows, with the filters of its ranges if it is more than a single batch; it counts once it is listed."""
        number = 1 + max([r["number"] for r in self.runs], default=0)
        run = {"number": number, "tier": tier, "rows": n, "blocks": 0}
        ranged = rows.withColumn("key_range", self._range()).repartition("key_range").sortWithinPartitions("key_range", "fp", "p", "commit")
        ranged.select(*[x.split()[0] for x in _ENTRY.split(", ")], "key_range").write.mode("overwrite").partitionBy("key_range").parquet(f"{self.path}/run={number}")
        if tier:
            run["blocks"] = membership.blocks_for(-(-n // self.ranges), self.bits_per_key)
            made = membership.build_filter(self._read([run]).select("key_range", _near().alias("h")), "h", run["blocks"], ["key_range"])
            made.repartition("key_range").write.mode("overwrite").partitionBy("key_range").parquet(f"{self.path}/filter={number}")
        return run

    def _ranges_of(self, run: dict) -> list[int]:
        """The key ranges that a run has rows in: its folders."""
        return sorted(int(name.split("=")[1]) for name in folders(self.spark, f"{self.path}/run={run['number']}") if name.startswith("key_range="))

    def _read(self, runs: list[dict], touched: list[tuple[int, int]] | None = None) -> DataFrame:
        """The rows of runs; of ``touched`` (run number, key range) pairs only, if given."""
        paths = [f"{self.path}/run={r['number']}" for r in runs] if touched is None else [f"{self.path}/run={n}/key_range={k}" for n, k in touched]
        return self.spark.read.schema(_ENTRY + ", run int, key_range int").option("basePath", self.path).parquet(*paths)

    def load(self, rows: DataFrame, n: int) -> None:
        """A large first run of about ``n`` rows that needs no check: the accepted history."""
        self.runs.append(self._lay(rows, -1, n))
        self._save()

    def _possible(self, near: DataFrame, ranges: list[int], runs: list[dict]) -> DataFrame:
        """Keys of a batch (``key_range``, ``h``) beside each run whose filter does not rule them out (``run``, ``key_range``, ``h``)."""
        out = None
        for r in runs:
            filters = self.spark.read.schema("block long, " + ", ".join(f"{w} long" for w in membership.WORDS) + ", key_range int").parquet(f"{self.path}/filter={r['number']}")
            asked = membership.probe(near, "h", filters.where(F.col("key_range").isin(ranges)), r["blocks"], ["key_range"])
            asked = asked.where("maybe").select(F.lit(r["number"]).alias("run"), "key_range", "h")
            out = asked if out is None else out.unionByName(asked)
        return out

    def _windows(self, batch: DataFrame, ranges: list[int], older: list[dict]) -> DataFrame | None:
        """Rows of older runs around the keys of a batch: from the folders that its ranges, and the filters where runs have one, leave.

        The keys are numbers in a table of their own, which Spark brings to the runs while it is small; else both are shuffled."""
        near = materialise(batch.select("key_range", _near().alias("h")).distinct(), "near")
        out = []
        wide = [r for r in older if r["blocks"]]
        if wide:
            possible = materialise(self._possible(near, ranges, wide), "possible")
            touched = [tuple(x) for x in possible.select("run", "key_range").distinct().collect()]  # runs x ranges at most
            if touched:
                out.append((touched, possible.select("h")))
        touched = [(r["number"], k) for r in older if not r["blocks"] for k in self._ranges_of(r) if k in set(ranges)]
        if touched:
            out.append((touched, near.select("h")))
        rows = [self._read(older, t).withColumn("h", _near()).join(keys, "h", "left_semi").drop("h") for t, keys in out]
        return reduce(DataFrame.unionByName, rows) if rows else None

    def check(self, rows: DataFrame, n: int) -> DataFrame:
        """``seq``, ``whole`` and ``refused`` of the first rows of a batch of about ``n`` entries, by entry; the batch then is a run."""
        older = list(self.runs)
        run = self._lay(rows, 0, n)
        batch = self._read([run])
        windows = self._windows(batch, self._ranges_of(run), older) if older else None
        picked = batch.withColumn("new", F.lit(True))
        if windows is not None:
            picked = picked.unionByName(windows.withColumn("new", F.lit(False)))
        ordered = picked.repartition("fp", "p", F.substring("commit", 1, 7)).sortWithinPartitions("fp", "p", "commit", "seq")
        result = write_table(ordered.select("fp", "p", "commit", "seq", "origin", "new").mapInPandas(_scan, "seq long, whole boolean, refused boolean"), new_path(self.spark, "checked"))
        self.runs.append(run)
        self._save()
        self._compact()
        return result

    def _compact(self) -> None:
        tier = 0
        while True:
            due = [r for r in self.runs if r["tier"] == tier]
            if len(due) < self.compact_every:
                return
            merged = self._read(due).groupBy("fp", "p", "commit", "origin").agg(F.min("seq").alias("seq"))
            run = self._lay(merged, tier + 1, sum(r["rows"] for r in due))
            self.runs = [r for r in self.runs if r not in due] + [run]
            self._save()
            for r in due:
                remove(self.spark, f"{self.path}/run={r['number']}")
                remove(self.spark, f"{self.path}/filter={r['number']}")
            tier += 1


def decide(history: DataFrame | None, incoming: DataFrame, compact_every: int = COMPACT_EVERY, bits_per_key: int = membership.BITS_PER_KEY, path: str | None = None) -> DataFrame:
    """``record_no``, ``batch_no`` and ``refused`` of the incoming rows that have fingerprint, path and commit.

    Refused are rows equal in all three to a row of ``history`` or an incoming row of smaller record_no,
    accepted or not. Rows that lack one of the three equal nothing: they are accepted and not listed here.
    Batches are checked in order of their number; NULL batch_no counts as batch 0. Empty tables give no rows.
    With ``path`` the store there is used and kept; ``history`` is laid into it only if it is new, and may be None
    afterwards. Record numbers have to go on rising from call to call.
    """
    spark = incoming.sparkSession
    if path is not None and exists(spark, f"{path}/{_LIST}"):
        store = RunStore.open(spark, path)
    else:
        old = None if history is None else materialise(entries(normalised(history), F.lit(-1)), "history")
        n = 0 if old is None else old.count()
        store = RunStore.create(spark, path or new_path(spark, "store"), n, bits_per_key, compact_every)
        if n:
            store.load(old, n)
    staged_at = new_path(spark, "incoming")
    rows = normalised(incoming.withColumn("batch_no", F.coalesce("batch_no", F.lit(0))), "record_no", "batch_no")
    kinds = dict(rows.dtypes)
    rows.repartition("batch_no", F.pmod(F.xxhash64("record_no"), F.lit(8))).write.partitionBy("batch_no").parquet(staged_at)
    staged = spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in ("record_no", "fp", "p", "commit", "batch_no"))).parquet(staged_at)
    # Rows repeated inside their batch are later than the first of their entry: only first rows can be accepted.
    firsts = None
    for number, n in sorted(map(tuple, staged.groupBy("batch_no").count().collect())):  # a row per batch
        got = store.check(entries(staged.where(F.col("batch_no") == number), F.col("record_no")), n)
        firsts = got if firsts is None else firsts.unionByName(got)
    if firsts is None:
        return staged.select("record_no", "batch_no", F.lit(False).alias("refused"))
    accepted = firsts.groupBy("seq").agg(F.bool_or("whole").alias("whole"), F.bool_or("refused").alias("refused")).where("whole AND NOT refused")
    out = staged.select("record_no", "batch_no").join(accepted.select(F.col("seq").alias("record_no"), F.lit(False).alias("refused")), "record_no", "left")
    return out.withColumn("refused", F.coalesce("refused", F.lit(True)))
