"""Distinct counts, batches against history, seen before, mixing: against brute force, with odd rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelsieve.functions.normalise import fingerprint_hex
from keelsieve.llm import distinct, history, membership, mixing

RNG = random.Random(7)


# --- distinct counts


def test_estimates_hold_their_bounds(spark):
    sizes = {"a": 0, "b": 3, "c": 400, "d": 20_000, "e": 200_000}
    parts = [spark.range(n).select(F.lit(k).alias("g"), F.concat(F.lit(k), F.col("id").cast("string")).alias("id")) for k, n in sizes.items() if n]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.unionByName(df.limit(50)).unionByName(spark.createDataFrame([("a", None)], "g string, id string"))
    got = {r["g"]: r for r in distinct.estimate(distinct.sketch(df, ["g"], F.col("id")), ["g"], z=4).collect()}
    assert "a" not in got
    for k, n in sizes.items():
        if n:
            assert got[k]["lower"] <= n <= got[k]["upper"], (k, got[k])
    assert got["e"]["std_error"] / got["e"]["estimate"] < 0.03


def test_merged_sketches_equal_one_sketch(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") % 700).cast("string").alias("id"))
    whole = distinct.sketch(df, ["g"], F.col("id"))
    halves = distinct.merge(distinct.sketch(df.where("x < 3000"), ["g"], F.col("id")).unionByName(distinct.sketch(df.where("x >= 2000"), ["g"], F.col("id"))), ["g"])
    assert sorted(map(tuple, whole.select("g", "bucket", "bits").collect())) == sorted(map(tuple, halves.select("g", "bucket", "bits").collect()))
    rolled = distinct.combinations(whole, ["g"], [(), ("g",)])
    assert {r["grouping"] for r in rolled.collect()} == {"all", "g"}
    total = distinct.estimate(rolled.where("grouping = 'all'"), ["grouping"]).head()
    assert abs(total["estimate"] - 700) < 6 * total["std_error"]


def test_dominant_days_equal_brute_force(spark):
    rows = []
    for i in range(3000):
        day = None if i % 29 == 0 else f"2025-01-{1 + int(RNG.random() ** 2 * 28):02d}"
        rows.append((day, RNG.choice(["r1", "r2", "rare", None]) if i % 97 else "tiny", RNG.choice(["high", "low", None]), None if i % 31 == 0 else str(RNG.randint(0, 400))))
    df = spark.createDataFrame(rows, "created_day string, rule_id string, severity string, id string")
    pair, day, n = defaultdict(set), defaultdict(set), defaultdict(int)
    for d, r, s, x in rows:
        if r and s:
            n[r, s] += 1
            if x:
                pair[r, s].add(x)
                if d:
                    day[d, r, s].add(x)
    want = {k for k, v in day.items() if n[k[1:]] * 1000 >= 15 * len(rows) and len(v) >= 0.1 * len(pair[k[1:]])}
    assert want and {tuple(r) for r in distinct.dominant_days(df).collect()} == want
    assert distinct.dominant_days(df.limit(0)).count() == 0


def test_sketch_refuses_odd_sizes(spark):
    with pytest.raises(ValueError):
        distinct.sketch(spark.range(1), [], F.col("id"), buckets=1000)


# --- batches against history

HEX = "0123456789abcdef"
F_SCHEMA = "row_no long, fingerprint string, path string, commit_sha string, batch_no int, seq string"
I_SCHEMA = "record_no long, batch_no int, fingerprint string, path string, commit_sha string, k string, commit string"


def _rows(n, seed):
    rng = random.Random(seed)
    commits = ["".join(rng.choice(HEX) for _ in range(40)) for _ in range(6)]
    commits += [commits[0][:10] + "".join(rng.choice(HEX) for _ in range(30)), commits[1][:7] + "f" * 33]
    out = []
    for _ in range(n):
        fp = "%064x" % rng.randint(1, 3) if rng.random() > 0.05 else rng.choice([None, "", " "])
        fp = rng.choice([fp, fp.upper(), "x:hmac-sha256:" + fp, f" {fp} "]) if fp and fp.strip() else fp
        p = rng.choice(["src/a.py", "lib/a.py", "a.py"])
        p = rng.choice([p, "./" + p, p.upper(), "/workspace/" + p, "/opt/odd/" + p, p.replace("/", "\\"), None, ""])
        c = rng.choice(commits)
        c = rng.choice([c, c[: rng.randint(7, 12)], c.upper() + " ", c[:5], None])
        out.append((fp, p, c))
    return out


def _equal_rows(a, b):
    (fa, pa, ca), (fb, pb, cb) = a, b
    if fa != fb or not (ca.startswith(cb) or cb.startswith(ca)):
        return False
    if pa == pb:
        return True
    ra, rb = pa.startswith("//"), pb.startswith("//")
    return (ra and not rb and ("/" + pa.lstrip("/")).endswith("/" + pb)) or (rb and not ra and ("/" + pb.lstrip("/")).endswith("/" + pa))


@pytest.mark.parametrize("seed", [1, 2])
def test_refused_rows_equal_brute_force(spark, seed):
    old = [(i, *r, 1, "x") for i, r in enumerate(_rows(25, seed))]
    new = [(i + 1, 1 + i // 12, *r, "x", "y") for i, r in enumerate(_rows(60, seed + 10))]
    h, inc = spark.createDataFrame(old, F_SCHEMA), spark.createDataFrame(new, I_SCHEMA)
    norm = lambda df, k: {r[0]: (r[1], r[2], r[3]) for r in history.normalised(df, k).select(k, "fp", "p", "commit").collect()}
    before, coming = list(norm(h, "row_no").values()), norm(inc, "record_no")
    want = {n for n, r in coming.items() if any(_equal_rows(r, o) for o in before) or any(m < n and _equal_rows(r, o) for m, o in coming.items())}
    got = history.decide(h, inc, compact_every=2, bits_per_key=1).where("refused")
    assert {r["record_no"] for r in got.collect()} == want


def test_a_store_is_opened_again_and_reads_windows_only(spark, tmp_path):
    rng = random.Random(3)
    row = lambda i: ("%064x" % i, f"src/f{i % 50}.py", "%040x" % (i * 7919))
    h = spark.createDataFrame([(i, *row(i), 1, "x") for i in range(4000)], F_SCHEMA)
    path = str(tmp_path / "store")
    one = [(i + 1, 1, *row(rng.choice([i, 9000 + i])), "x", "y") for i in range(6)]
    two = [(i + 101, 2, *row(rng.choice([i, 9000 + i, 20_000 + i])), "x", "y") for i in range(6)]
    batch = lambda rows: spark.createDataFrame(rows, I_SCHEMA)
    got = {r["record_no"]: r["refused"] for r in history.decide(h, batch(one), path=path).collect()}
    got |= {r["record_no"]: r["refused"] for r in history.decide(None, batch(two), path=path).collect()}
    whole = {r["record_no"]: r["refused"] for r in history.decide(h, batch(one + two)).collect()}
    assert got == whole and True in got.values() and False in got.values()
    store = history.RunStore.open(spark, path)
    assert [r["tier"] for r in store.runs] == [-1, 0, 0]
    # one known record: a single folder of the history is possible, and the plan reads that alone
    entry = history.entries(history.normalised(batch([(999, 9, *row(17), "x", "y")]), "record_no"), F.col("record_no"))
    laid = store._lay(entry, 0, 1)
    (only,) = store._ranges_of(laid)
    possible = store._possible(store._read([laid]).select("key_range", history._near().alias("h")), [only], store.runs[:1])
    assert [tuple(x) for x in possible.select("run", "key_range").distinct().collect()] == [(1, only)]
    windows = store._windows(store._read([laid]), [only], store.runs)
    assert windows.where("run = 1").count() == 1
    files = [f for f in windows.inputFiles() if "/run=" in f]
    assert all(f"key_range={only}/" in f for f in files) and any("run=1/" in f for f in files)
    with pytest.raises(ValueError):
        history.RunStore.create(spark, path)


def test_runs_are_merged(spark, tmp_path):
    h = spark.createDataFrame([], F_SCHEMA)
    rows = [(i + 1, 1 + i % 5, *r, "x", "y") for i, r in enumerate(_rows(60, 5))]
    rows = sorted(rows, key=lambda r: r[1])
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    inc = spark.createDataFrame(rows, I_SCHEMA)
    some = {(r["record_no"], r["refused"]) for r in history.decide(h, inc, compact_every=2, path=str(tmp_path / "a")).collect()}
    assert some == {(r["record_no"], r["refused"]) for r in history.decide(h, inc, compact_every=100).collect()}
    assert max(r["tier"] for r in history.RunStore.open(spark, str(tmp_path / "a")).runs) >= 2


def test_history_with_empty_tables(spark):
    h, i = spark.createDataFrame([], F_SCHEMA), spark.createDataFrame([], I_SCHEMA)
    assert history.decide(h, i).count() == 0
    one = spark.createDataFrame([(1, None, "a" * 64, "p", "c" * 40, "", ""), (2, None, "a" * 64, "p", "c" * 40, "", "")], I_SCHEMA)
    assert {(r["record_no"], r["refused"]) for r in history.decide(h, one).collect()} == {(1, False), (2, True)}


# --- seen before


def test_seen_before_equals_brute_force_even_with_a_poor_filter(spark):
    old = [("%064x" % RNG.randint(0, 500),) for _ in range(400)] + [(None,), ("",)]
    new = [(i, 1 + i // 300, "%064x" % RNG.randint(0, 2000) if i % 17 else None) for i in range(900)]
    h = spark.createDataFrame(old, "f string").select(fingerprint_hex("f").alias("fp"))
    s = spark.createDataFrame(new, "n long, batch_no int, f string").select("n", "batch_no", fingerprint_hex("f").alias("fp"))
    keys, want = {k for (k,) in old if k}, set()
    for n, _, k in new:
        if k:
            if k in keys:
                want.add(n)
            keys.add(k)
    for bits in (2, 12):
        got = membership.seen_before(h, s, "fp", "n", bits_per_key=bits)
        assert {r["n"] for r in got.where("seen").collect()} == want
        report = membership.error_report(got).collect()
        assert sum(r["row_count"] for r in report) == sum(1 for x in new if x[2])
        if bits == 2:
            assert sum(r["disproved"] for r in report) > 0
    assert membership.seen_before(h.limit(0), s, "fp", "n").where("route = 'negative'").count() == len({k for *_, k in new if k})
    assert membership.seen_before(h, s.limit(0), "fp", "n").count() == 0


def test_a_key_store_is_opened_again_grows_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(membership, "MERGE_EVERY", 3)
    rng = random.Random(2)
    old = spark.createDataFrame([("%064x" % rng.randint(0, 300),) for _ in range(100)], "fp string")
    rows = [(i, 1 + i // 60, "%064x" % rng.randint(0, 5000)) for i in range(420)]
    s = spark.createDataFrame(rows, "n long, batch_no int, fp string")
    whole = {(r["n"], r["seen"]) for r in membership.seen_before(old, s, "fp", "n").collect()}
    keys, want = {r["fp"] for r in old.collect()}, set()
    for n, _, k in rows:
        want.add((n, k in keys))
        keys.add(k)
    assert whole == want
    path, got = str(tmp_path / "keys"), set()
    for part in (s.where("batch_no <= 3"), s.where("batch_no > 3")):
        got |= {(r["n"], r["seen"]) for r in membership.seen_before(old if not got else None, part, "fp", "n", path=path).collect()}
    assert got == want
    store = membership.KeyStore.open(spark, path)
    assert store.keys == len(keys) == store.full_keys().distinct().count() == store.full_keys().count() and len(store.parts) < 3
    assert store.blocks * 512 >= store.keys * store.bits_per_key


def test_filters_merge(spark):
    keys = spark.range(300).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("k"))
    whole = membership.build_filter(keys, "k", 8)
    both = membership.merge_filters(membership.build_filter(keys.limit(150), "k", 8), membership.build_filter(keys, "k", 8))
    rows = lambda df: sorted(tuple(r) for r in df.select("block", *membership.WORDS).collect())
    assert rows(whole) == rows(both)
    assert membership.probe(keys, "k", whole, 8).where("NOT maybe").count() == 0


# --- mixing


def test_due_times_invert_the_integral():
    knots = [(0, 0.0), (0.4, 0.5), (1, 2.0)]
    t = np.linspace(0, 1, 101)
    at = mixing.due_time(t, knots)
    assert (np.diff(at) >= 0).all() and at[0] == 0 and at[-1] == pytest.approx(1)
    fine = np.linspace(0, 1, 200_001)
    w = np.interp(fine, [0, 0.4, 1], [0, 0.5, 2])
    c = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    assert np.interp(at, fine, c / c[-1]) == pytest.approx(t, abs=1e-4)
    for bad in ([(0, 1)], [(0, 1), (0.5, 1)], [(0, -1), (1, 1)], [(0, 0), (1, 0)]):
        with pytest.raises(ValueError):
            mixing.due_time(t, bad)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, ["A", " a ", "b", "c", None, "other"][i % 6], 10 + i % 7, "x") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, position string")


def test_mixture_meets_targets(spark, corpus):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    report = mixing.shares(corpus, targets)
    total = corpus.agg(F.sum("n_tokens")).head()[0]
    held = {r["source"]: r["tokens"] for r in report.collect()}
    assert {r["source"] for r in report.where("falls_short").collect()} == {s for s, sh, m in (("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.2, 2)) if held[s] * m < sh * total}
    mixed = mixing.mixture(corpus, targets, {"b": [(0, 0.0), (1, 1.0)]}, slice_rows=20)
    rows = mixed.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and max(r["copy_no"] for r in rows) <= 2
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    for r in mixing.actual_shares(mixed, report).collect():
        assert r["mixed_tokens"] == pytest.approx(r["budget"], abs=17)
    b = [r["position"] for r in rows if r["source"] == "b"]
    assert sum(b) / len(b) > 0.6
    assert rows == mixing.mixture(corpus.repartition(5), targets, {"b": [(0, 0.0), (1, 1.0)]}, slice_rows=20).collect()


def test_found_sources_come_from_the_dealt_mixture(spark, monkeypatch, tmp_path):
    """A source that falls short by its supply, one that does not; and one of which the mixture deals too little."""
    from keelsieve.llm import queries

    docs = [(i, "wiki" if i % 4 else "chat", "some plain words about things " * 5) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("wiki", 0.5, 2), ("chat", 0.9, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    run = lambda: {r["source"] for r in queries.p8_found(spark, str(tmp_path)).collect()}
    assert run() == {"chat"}
    whole = queries.mixing.mixture
    monkeypatch.setattr(queries.mixing, "mixture", lambda *a, **k: whole(*a, **k).where("source != 'wiki'"))
    assert run() == {"wiki", "chat"}


def test_mixture_of_nothing(spark, corpus):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(corpus.limit(0), targets).count() == 0
    assert mixing.shares(corpus.limit(0), targets).head()["falls_short"] is False
    assert mixing.mixture(corpus, targets.limit(0)).count() == 0


def test_token_counts(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, long), (5, "x" * 250_000)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] == 60_001 and got[5] > 1000


def test_token_counts_do_not_hang_on_where_long_texts_are_cut(spark, monkeypatch):
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "\n\n \t", "don't", "'s", "12345", "é語", "!?", " ...", "\x1c", "\u2028", "x" * 70, " " * 90, "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counts = lambda: {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    whole = counts()
    for chunk in (5, 40, 200):
        monkeypatch.setattr(mixing, "CHUNK_CHARS", chunk)
        assert counts() == whole


def test_mixture_of_many_targets_is_joined(spark, corpus, monkeypatch):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    few = mixing.mixture(corpus, targets).collect()
    monkeypatch.setattr(mixing, "SMALL_PLAN", 1)
    assert mixing.mixture(corpus, targets).collect() == few
