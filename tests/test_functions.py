import hashlib
import hmac
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keelsieve.functions import normalise, patterns, textops
from keelsieve.functions.normalise import MACHINE_ROOTS, _path

ROOT = re.compile("(?:" + "|".join(MACHINE_ROOTS) + ")/")


def test_spellings_of_one_path():
    want = "src/modèles/a b.rb"
    for p in (
        "src/modèles/a b.rb", "./src/modèles/a b.rb", "src//modèles/./a b.rb", "src\\modèles\\a b.rb", "src/tmp/../modèles/a b.rb", "SRC/Modèles/A B.rb", " src/modèles/a b.rb ",
        "src/mod%C3%A8les/a%20b.rb", "src/mode\u0300les/a b.rb", "/builds/group7/checkout/src/modèles/a b.rb", "C:/agent/_work/12/s/src/modèles/a b.rb", "/./workspace/src/modèles/a b.rb",
    ):
        assert _path(p, ROOT) == want, p
    assert _path("/opt/x/src/a.rb", ROOT) == "//opt/x/src/a.rb"
    assert _path("src/a.rb", ROOT) != _path("lib/a.rb", ROOT)
    assert [_path(p, ROOT) for p in (None, "", "  ", ".", "/")] == [None] * 5


def test_normalised_columns(spark):
    hexed = "ab" * 32
    rows = [(f" X:hmac-sha256:{hexed.upper()}\n", " High ", " ABCDEF12 "), (hexed, "", "abc"), ("", None, None), (None, " ", "")]
    df = spark.createDataFrame(rows, "f string, s string, c string").select(normalise.fingerprint_hex("f"), normalise.squeezed("s"), normalise.commit_id("c"))
    assert [tuple(r) for r in df.collect()] == [(hexed, "high", "abcdef12"), (hexed, None, None), (None, None, None), (None, None, None)]


def test_utc_day_ignores_session_zone(spark):
    df = spark.sql("SELECT timestamp_micros(1735689599999999) AS t UNION ALL SELECT CAST(NULL AS TIMESTAMP)")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r[0] for r in df.select(normalise.utc_day("t")).collect()] == ["2024-12-31", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_projection_keeps_byte_offsets(spark):
    texts = ["aé𝄞語b", "", "plain", "\u07ff\u0800\uffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(textops.byte_projection(F.col("t")))
    got = [r[0] for r in df.collect()]
    assert [len(g) for g in got] == [len(t.encode()) for t in texts] and all(g.isascii() for g in got)


FORMS = [
    (r"key=([a-z]+);", 1), (r"(x)?key=([a-z]+)", 1), (r"(x)?key=([a-z]+)", 2), (r"(?i)(?P<n>key|pw)\s*=\s*(?:v([0-9]+)|[a-z]{2,});?", 1), (r"(?i)(?P<n>key|pw)\s*=\s*(?:v([0-9]+)|[a-z]{2,});?", 2),
    (r"a(b(c)b)a", 2), (r"(ab)+", 1), (r"[[:alpha:]]+=", 0), (r"\w+$", 0), (r"(?m)^(\w)", 1), (r"x*", 0), (r"=(.+);", 1), (r"\Qkey=\E(\S+)", 1),
]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["key=abc;", "xkey=abc", "PW = v12;", "pw=zz", "abcba", "abab", " ", "\n", "é", "\r", "语", "k", "="]), min_size=1, max_size=10))
def test_spans_equal_matches_on_bytes(spark, parts):
    """Marked patterns in the JVM and plain ones in Python against Python's own engine on bytes."""
    text = "".join(parts)
    proj = spark.createDataFrame([(text,)], "t string").select(textops.byte_projection(F.col("t")).alias("p"))
    known = proj.head()[0]
    want, columns = [], []
    for rx, group in FORMS:
        p = patterns.read(rx)
        want.append([m.span(group) for m in re.finditer(p.plain(), known) if m.start(group) >= 0])
        marked = None if patterns.matches_nothing(p) else p.marked(group)
        columns.append(F.expr(textops.spans_sql("p", *marked)) if marked else textops.spans_of(F.col("p"), [("r", p.plain(), group, ())]))
    got = proj.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head()
    assert [[(s["start"], s["stop"]) for s in x] for x in got] == want


def test_patterns_read_what_re2_reads():
    for rx in ("(?=a)", "(?<!a)b", r"(a)\1", "a**", "a++", "(", "a)", "[a", "x{3,1}", "x{1001}", "*a", "(?P<a>x)(?P<a>y)", "(?x)a", r"\pL", "é", "\\"):
        with pytest.raises(ValueError):
            patterns.read(rx)
    same = {r"^a.b$": ("a-b", "a\nb"), r"(?s)a.b": ("a\nb", "ab"), r"(?m)^a$": ("x\na\ny", "xa"), r"a{,2}": ("a{,2}", "aa"), r"[]a]+": ("]a", "b"), r"[^\s]x": ("ax", "\nx"), r"\s": ("\t", "\x0b"), r"[[:digit:]_]": ("7", "a"), r"\x41\z": ("xA", "A\n"), r"a{2}": ("aa", "a"), r"[a&&b]": ("&", "c")}
    for rx, (yes, no) in same.items():
        p = re.compile(patterns.read(rx).plain())
        assert p.search(yes) and not p.search(no), rx


def test_entropy_hmac_and_mask(spark):
    values = [b"", b"aaaa", b"abcd", bytes(range(256)), "é".encode() * 3]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "v binary").select(textops.entropy(F.col("v")), textops.hmac_sha256(b"k" * 70, F.col("v")), textops.masked(F.col("v"))).collect()
    for v, (e, h, m) in zip(values, rows):
        n = Counter(v)
        assert abs(e - -sum(c / len(v) * math.log2(c / len(v)) for c in n.values() if v)) < 1e-9
        assert h == hmac.new(b"k" * 70, v, hashlib.sha256).hexdigest()
        assert m.endswith("*" * max(0, len(v) - 4))
    assert rows[2][2] == "abcd"


def test_entropy_of_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["", None, "aaaa", "abcd", "é" * 3 + "x", "".join(chr(32 + i % 90) for i in range(1_000_000))]
    spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, title string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["entropy"] for r in entry.queries()["entropy_texts"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        v = (t or "").encode()
        assert abs(got[i] - -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())) < 1e-6
    assert len(got) == len(texts)
