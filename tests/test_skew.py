from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import functions as F

from keelsieve.operators import skew

SCHEMA = "row_no long, fingerprint string, rule_id string, source_uri string, path string, created_at timestamp, n int"


def rows(count=600):
    out = []
    for i in range(count):
        fp = f"{1 if i % 3 else i % 40:064x}" if i % 11 else [None, "", " "][i % 3]
        at = [None, datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2025, 1, 1 + i % 20, tzinfo=timezone.utc)][i % 3 if i % 5 == 0 else 2]
        out.append((i, ("X:hmac-sha256:" + fp.upper()) if fp and fp.strip() and i % 2 else fp, [" Aa ", "aa", "b", None, ""][i % 5], f"u{i % 3}", [None, "", "p", "q"][i % 4], at, i))
    return out


def brute(data):
    out = defaultdict(lambda: [0, [], set()])
    for _, fp, rule, uri, path, at, _ in data:
        keys = []
        if fp and fp.strip():
            keys.append(("fingerprint", fp.strip().lower()[-64:]))
        if rule and rule.strip():
            keys.append(("rule_id", rule.strip().lower()))
        for k in keys:
            out[k][0] += 1
            out[k][2].add((uri, path or ""))
            if at and at.year > 1970:
                out[k][1].append(at)
    return {k: (n, min(t) if t else None, max(t) if t else None, len(p)) for k, (n, t, p) in out.items()}


def test_tree_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    for fan_in in (2, 16):
        got = skew.keyed_statistics(df, fan_in, fan_in).collect()
        assert {(r[0], r[1]): (r[2], r[3] and r[3].replace(tzinfo=timezone.utc), r[4] and r[4].replace(tzinfo=timezone.utc), r[5]) for r in got} == brute(data)


def test_rounds_grow_with_the_logarithm():
    assert [skew.tree_rounds(n, 4) for n in (1, 4, 5, 16, 17, 64, 65)] == [1, 1, 2, 2, 3, 3, 4]


def test_no_group_gets_more_than_fan_in_partials(spark):
    df = spark.range(0, 1000, 1, 16).select(F.lit("k").alias("k"), F.lit(1).alias("n"))
    out = skew.tree_aggregate(df, ["k"], {"n": F.sum("n")}, 16, 4)
    assert out.collect()[0]["n"] == 1000
    assert out.explain("formatted") is None


def test_heavy_keys_and_empty_table(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = {k for k, v in brute(data).items() if v[0] * 1000 >= 100 * len(data)}
    assert {tuple(r) for r in skew.heavy_keys(df, 100).collect()} == want
    assert skew.keyed_statistics(df.limit(0)).count() == 0
