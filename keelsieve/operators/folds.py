"""Ordered folds per key: token bucket, circuit breaker, expiring cache.

Rows are range-partitioned by key and time, so that the timeline of a hot key is cut into pieces that
go to different tasks. The state in which a piece begins is not known there, but each fold has moments
after which its state is the same whatever it was before (a bucket that must be full, a success that
must have been let through, a call after which any stored answer has run out). Everything behind the
first such moment is settled in a first pass; the rows before it, usually few, are settled in a second,
from the state in which the piece before ended. Pieces without such a moment are joined to the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keelsieve.functions.normalise import micros
from keelsieve.shared import materialise

Step = Callable[[dict, dict], dict]
#: Given what is known so far and a row: the state after the row if it is certain, else None.
Settle = Callable[[dict, dict], dict | None]


def _key(v: object) -> object:
    """A key whichever way its batch holds it: whole numbers come as fractions beside NULLs."""
    return None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v


def scan_by_key(df: DataFrame, key: str, order: Sequence[str], schema: str, start: Callable[[], dict], step: Step, settle: Settle, pieces: int | None = None) -> DataFrame:
    """Run ``step(state, row) -> output row`` over the rows of each key in order; ``start()`` makes a key's state. NULL keys form one key.

    ``settle`` tells from when on the state of a piece of a timeline is certain. The driver holds a line for each of the ``pieces``.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    columns = df.columns
    kinds = dict(df.dtypes)
    both = ", ".join([*[f"o{i} {part.strip().split(' ', 1)[1]}" for i, part in enumerate(schema.split(","))], *[f"i{i} {kinds[c]}" for i, c in enumerate(columns)], "piece int, note string"])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = TaskContext.get().partitionId()
        head, current, state, seen = None, None, None, {}
        begun = False
        width = len(names) + len(columns)
        for b in batches:
            out = []
            for values in b.itertuples(index=False, name=None):
                row = dict(zip(columns, values))
                k = _key(row[key])
                if not begun:
                    head = current = k
                    begun = True
                elif k != current:
                    current, state = k, start()
                if state is None:  # what came before this piece is not known
                    out.append((*[None] * len(names), *values, piece, "open"))
                    state = settle(seen, row)
                else:
                    got = step(state, row)
                    out.append((*[got[n] for n in names], *[None] * len(columns), piece, "done"))
            yield pd.DataFrame(out, columns=range(width + 2))
        if begun:
            note = json.dumps({"piece": piece, "head": repr(head), "last": repr(current), "state": state})
            yield pd.DataFrame([(*[None] * width, piece, note)], columns=range(width + 2))

    cut = df.repartitionByRange(pieces, key, *order).sortWithinPartitions(key, *order)
    done = materialise(cut.mapInPandas(_named(first, both), both), "fold")
    notes = sorted((json.loads(r["note"]) for r in done.where("note LIKE '{%'").select("note").collect()), key=lambda n: n["piece"])  # a line per piece
    # the state before each piece; pieces after one that never settled go with it, in order
    chains, states, before = {}, {}, None
    for n in notes:
        if before is not None and before["last"] == n["head"]:
            if before["state"] is None:
                chains[n["piece"]] = chains[before["piece"]]
            else:
                chains[n["piece"]], states[n["piece"]] = n["piece"], before["state"]
        else:
            chains[n["piece"]], states[n["piece"]] = n["piece"], start()
        before = n
    chain_of = spark.createDataFrame([(int(p), int(c)) for p, c in chains.items()], "piece int, chain int")

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for b in batches:
            out = []
            for chain, *values in b.itertuples(index=False, name=None):
                if chain != current:
                    current, state = chain, dict(states[chain])
                out.append(step(state, dict(zip(columns, values))))
            yield pd.DataFrame(out, columns=names)

    raw = [F.col(f"i{i}").alias(c) for i, c in enumerate(columns)]
    open_rows = done.where("note = 'open'").join(F.broadcast(chain_of), "piece").select("chain", "piece", *raw)  # a row per piece
    settled = done.where("note = 'done'").select(*[F.col(f"o{i}").alias(n) for i, n in enumerate(names)])
    rest = open_rows.repartition("chain").sortWithinPartitions("chain", "piece", key, *order).drop("piece").mapInPandas(second, schema)
    return settled.unionByName(rest)


def _named(run, schema: str):
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def renamed(batches):
        for out in run(batches):
            out.columns = names
            yield out

    return renamed


def token_bucket(calls: DataFrame, key: str, at: str, order: str, rate: float, burst: float, idle_seconds: float = 900.0, pieces: int | None = None) -> DataFrame:
    """``order``, ``key``, ``allowed``, ``tokens`` for each call: a bucket per key, refilled at ``rate`` a second up to ``burst``.

    A bucket idle for ``idle_seconds`` starts full again. NULL times count as the time of the call before.
    """

    def step(s: dict, row: dict) -> dict:
        us = row["__us"]
        now = s.get("last") if us is None or us != us else int(us)
        last = s.get("last")
        if last is None or (now is not None and (now - last) / 1e6 >= idle_seconds):
            s["tokens"] = burst
        elif now is not None:
            s["tokens"] = min(burst, s["tokens"] + max(0, now - last) / 1e6 * rate)
        s["last"] = now
        ok = s["tokens"] >= 1
        if ok:
            s["tokens"] -= 1
        return {order: row[order], key: row[key], "allowed": ok, "tokens": s["tokens"]}

    def settle(seen: dict, row: dict) -> dict | None:
        """``least``: what the bucket holds at least. Where that is a full bucket, the state is certain."""
        us = row["__us"]
        now = seen.get("last") if us is None or us != us else int(us)
        last = seen.get("last")
        gap = 0 if last is None or now is None else max(0, now - last) / 1e6
        least = 0.0 if last is None else burst if gap >= idle_seconds else min(burst, seen["least"] + gap * rate)
        seen["last"], seen["least"] = now, least - 1 if least >= 1 else 0.0
        if least >= burst and now is not None:
            return {"tokens": burst - 1 if burst >= 1 else burst, "last": now}
        return None

    rows = calls.select(key, order, micros(calls, at).alias("__us"))
    kinds = dict(rows.dtypes)
    return scan_by_key(rows, key, ["__us", order], f"{order} {kinds[order]}, {key} {kinds[key]}, allowed boolean, tokens double", dict, step, settle, pieces)


def breaker(calls: DataFrame, key: str, at: str, order: str, failed: str, threshold: int = 5, open_seconds: float = 30.0, pieces: int | None = None) -> DataFrame:
    """``order``, ``key``, ``state`` (before the call), ``admitted`` for each call of a circuit breaker per key.

    ``threshold`` failures in a row open it; after ``open_seconds`` a probe is let through, which closes it or opens it anew.
    Calls are over before the next one starts, so one probe at a time is in flight. NULL ``failed`` is a success.
    """

    def start() -> dict:
        return {"state": "closed", "fails": 0, "opened": 0}

    def step(s: dict, row: dict) -> dict:
        now = int(row["__us"])
        before = s["state"]
        admitted = True
        if s["state"] == "open":
            if (now - s["opened"]) / 1e6 >= open_seconds:
                s["state"] = before = "half_open"
            else:
                admitted = False
        if admitted:
            if row[failed] is not None and row[failed] == row[failed] and bool(row[failed]):
                s["fails"] += 1
                if s["state"] == "half_open" or s["fails"] >= threshold:
                    s["state"], s["opened"] = "open", now
            else:
                s["state"], s["fails"] = "closed", 0
        return {order: row[order], key: row[key], "state": before, "admitted": admitted}

    def settle(seen: dict, row: dict) -> dict | None:
        """``opened``: when it may have opened last. A success so long after that was let through, and closes it."""
        now = int(row["__us"])
        bad = row[failed] is not None and row[failed] == row[failed] and bool(row[failed])
        opened = seen.setdefault("opened", now)
        if bad:
            seen["opened"] = now
        elif (now - opened) / 1e6 >= open_seconds:
            return start()
        return None

    rows = calls.where(F.col(at).isNotNull()).select(key, order, failed, micros(calls, at).alias("__us"))
    kinds = dict(rows.dtypes)
    return scan_by_key(rows, key, ["__us", order], f"{order} {kinds[order]}, {key} {kinds[key]}, state string, admitted boolean", start, step, settle, pieces)


def cached(calls: DataFrame, key: str, at: str, order: str, ttl_seconds: float = 300.0, pieces: int | None = None) -> DataFrame:
    """``order``, ``key``, ``hit``: whether an answer stored for the key within ``ttl_seconds`` exists; a miss stores one."""

    def step(s: dict, row: dict) -> dict:
        now = row["__us"] / 1e6
        hit = "at" in s and now - s["at"] < ttl_seconds
        if not hit:
            s["at"] = now
        return {order: row[order], key: row[key], "hit": hit}

    def settle(seen: dict, row: dict) -> dict | None:
        """After a pause as long as answers are kept, a call is a miss."""
        now = row["__us"] / 1e6
        last, seen["last"] = seen.get("last"), now
        return {"at": now} if last is not None and now - last >= ttl_seconds else None

    rows = calls.where(F.col(at).isNotNull()).select(key, order, micros(calls, at).alias("__us"))
    kinds = dict(rows.dtypes)
    return scan_by_key(rows, key, ["__us", order], f"{order} {kinds[order]}, {key} {kinds[key]}, hit boolean", dict, step, settle, pieces)
