"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelsieve.functions.normalise import fingerprint_hex, squeezed, utc_day
from keelsieve.llm import credentials, distinct, history, leakage, membership, mixing, provenance, reading
from keelsieve.plans.registry import Registry, table
from keelsieve.shared import spread

registry = Registry()

_FP = r"nullif(regexp_extract(lower(fingerprint), '^\s*(?:[a-z0-9_.-]+:)*([0-9a-f]{64})\s*$', 1), '')"
_ID = r"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


# --- 1. files not written by hand


@registry.add("p1_found")
def p1_found(spark, sf_dir):
    return provenance.label_files(spread(table(spark, sf_dir, "artifacts"), "artifact_id")).where("p_handwritten < 0.5").select("artifact_id")


@registry.add("p1_links")
def p1_links(spark, sf_dir):
    """Every file with its class of copies and near copies, and the size of that class."""
    found = provenance.copy_classes(spread(table(spark, sf_dir, "artifacts"), "artifact_id"))
    return found.join(found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class_id")


@registry.add("p1_labels")
def p1_labels(spark, sf_dir):
    return provenance.label_files(spread(table(spark, sf_dir, "artifacts"), "artifact_id"))


# --- 2. credentials in source


def _sources(spark, sf_dir):
    a = spread(table(spark, sf_dir, "artifacts"), "artifact_id")
    return a.select("artifact_id", F.coalesce(F.when(F.trim("path") != "", F.col("path")), F.col("uri")).alias("path"), "content")


@registry.add("p2_found")
def p2_found(spark, sf_dir):
    return credentials.locate(_sources(spark, sf_dir)).select("artifact_id", "line_no").distinct()


@registry.add("p2_redacted")
def p2_redacted(spark, sf_dir):
    """Contents without credentials; those that had none come out as they were."""
    return credentials.redact(_sources(spark, sf_dir)).select("artifact_id", "content")


# --- 3. distinct counts


def _identified(spark, sf_dir):
    return table(spark, sf_dir, "findings").select(
        utc_day("created_at").alias("created_day"), squeezed("rule_id").alias("rule_id"), squeezed("severity").alias("severity"),
        F.unhex(fingerprint_hex("fingerprint")).alias("id"),
    )


@registry.add("p3_found", f"""
WITH r AS (SELECT strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d') AS created_day, {_ID.format(c='rule_id')} AS rule_id,
                  {_ID.format(c='severity')} AS severity, {_FP} AS fp FROM findings),
big AS (SELECT rule_id, severity, count(DISTINCT fp) AS n FROM r WHERE rule_id IS NOT NULL AND severity IS NOT NULL
        GROUP BY ALL HAVING count(*) * 1000 >= 15 * (SELECT count(*) FROM findings))
SELECT d.created_day, d.rule_id, d.severity FROM
  (SELECT created_day, rule_id, severity, count(DISTINCT fp) AS n FROM r WHERE created_day IS NOT NULL GROUP BY ALL) d
  JOIN big USING (rule_id, severity) WHERE d.n > 0 AND d.n >= 0.1 * big.n""")
def p3_found(spark, sf_dir):
    total = table(spark, sf_dir, "findings").count()
    return distinct.dominant_days(_identified(spark, sf_dir), total=total)


@registry.add("p3_counts")
def p3_counts(spark, sf_dir):
    """Estimates with bounds for every combination of day, rule and severity."""
    dims = ["created_day", "rule_id", "severity"]
    rows = _identified(spark, sf_dir)
    fine = distinct.sketch(rows, dims, F.col("id"))
    groups = [(), ("created_day",), ("rule_id",), ("severity",), ("created_day", "rule_id"), ("created_day", "severity"), ("rule_id", "severity"), tuple(dims)]
    return distinct.estimate(distinct.combinations(fine, dims, groups), ["grouping", *dims])


_GROUPED = f"""WITH r AS (SELECT strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%d') AS created_day, {_ID.format(c='rule_id')} AS rule_id, {_ID.format(c='severity')} AS severity, {_FP} AS fp FROM findings),
g AS (SELECT 'all' AS g, NULL AS k, fp FROM r UNION ALL SELECT 'created_day', created_day, fp FROM r WHERE created_day IS NOT NULL UNION ALL SELECT 'rule_id', rule_id, fp FROM r WHERE rule_id IS NOT NULL
 UNION ALL SELECT 'severity', severity, fp FROM r WHERE severity IS NOT NULL UNION ALL SELECT 'created_day+rule_id', created_day || '|' || rule_id, fp FROM r WHERE created_day IS NOT NULL AND rule_id IS NOT NULL
 UNION ALL SELECT 'created_day+severity', created_day || '|' || severity, fp FROM r WHERE created_day IS NOT NULL AND severity IS NOT NULL UNION ALL SELECT 'rule_id+severity', rule_id || '|' || severity, fp FROM r WHERE rule_id IS NOT NULL AND severity IS NOT NULL
 UNION ALL SELECT 'created_day+rule_id+severity', created_day || '|' || rule_id || '|' || severity, fp FROM r WHERE created_day IS NOT NULL AND rule_id IS NOT NULL AND severity IS NOT NULL)"""


@registry.add("p3_bounds", _GROUPED + " SELECT g AS grouping, count(*) AS groups, 0::BIGINT AS outside FROM (SELECT g, k FROM g WHERE fp IS NOT NULL GROUP BY g, k) GROUP BY g")
def p3_bounds(spark, sf_dir):
    """By grouping: how many groups there are, and how many exact counts lie outside the bounds (six standard errors and one)."""
    dims = ["created_day", "rule_id", "severity"]
    rows = _identified(spark, sf_dir).where("id IS NOT NULL")
    groups = [(), ("created_day",), ("rule_id",), ("severity",), ("created_day", "rule_id"), ("created_day", "severity"), ("rule_id", "severity"), tuple(dims)]
    guessed = distinct.estimate(distinct.combinations(distinct.sketch(rows, dims, F.col("id")), dims, groups), ["grouping", *dims], z=6.0)
    exact = distinct.exact_counts(rows, dims, groups)
    both = exact.join(guessed, F.concat_ws("|", exact["grouping"], *[F.coalesce(exact[d], F.lit("\x01")) for d in dims]) == F.concat_ws("|", guessed["grouping"], *[F.coalesce(guessed[d], F.lit("\x01")) for d in dims]), "left")
    bad = ~F.coalesce((F.col("n") >= F.col("lower") - 1) & (F.col("n") <= F.col("upper") + 1), F.lit(False))
    return both.groupBy(exact["grouping"]).agg(F.count(F.lit(1)).alias("groups"), F.count_if(bad).alias("outside"))


# --- 4. new batches against all history


_ROOTS = r"^(?:/builds/[^/]+/[^/]+|/home/runner/work/[^/]+|/home/circleci/project|/home/travis/build/[^/]+/[^/]+|/var/lib/jenkins/workspace/[^/]+|/srv/checkouts/[^/]+/[^/]+|/workspace|[a-z]:/agent/_work/[^/]+/s)/"


def _sql_path(c: str) -> str:
    """The checkout path in SQL: decoded, composed, lower case, one kind of slash, dots resolved (twice, as nested ones are rare), known roots cut."""
    p = rf"lower(replace(nfc_normalize(url_decode(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '+', '%2B'))), '\', '/'))"
    for rx, to in ((r"/+", "/"), (r"(^|/)(\./)+", r"\1"), (r"(^|/)[^/]+/\.\./", r"\1"), (r"(^|/)[^/]+/\.\./", r"\1"), (r"/+", "/"), (_ROOTS, "")):
        p = f"regexp_replace({p}, '{rx}', '{to}', 'g')"
    return f"nullif({p}, '')"


_P4 = f"""
WITH h AS (SELECT DISTINCT {_FP} AS fp, {_sql_path('path')} AS p, {_ID.format(c='commit_sha')} AS c FROM findings),
i AS (SELECT record_no, batch_no, {_FP} AS fp, {_sql_path('path')} AS p, {_ID.format(c='commit_sha')} AS c FROM incoming_findings),
j AS (SELECT * FROM i WHERE fp IS NOT NULL AND p IS NOT NULL AND length(c) >= 7),
k AS (SELECT fp, p, c, min(record_no) AS first_no FROM j GROUP BY ALL),
d AS (SELECT DISTINCT record_no, batch_no FROM (
  SELECT j.record_no, j.batch_no FROM j JOIN h ON h.fp = j.fp AND h.p = j.p AND length(h.c) >= 7 AND substr(h.c, 1, 7) = substr(j.c, 1, 7) WHERE starts_with(h.c, j.c) OR starts_with(j.c, h.c)
  UNION ALL SELECT j.record_no, j.batch_no FROM j JOIN k ON k.fp = j.fp AND k.p = j.p AND substr(k.c, 1, 7) = substr(j.c, 1, 7) WHERE k.first_no < j.record_no AND (starts_with(k.c, j.c) OR starts_with(j.c, k.c))))"""


@registry.add("p4_found", _P4 + " SELECT record_no FROM d")
def p4_found(spark, sf_dir):
    return _decided(spark, sf_dir).where("refused").select("record_no")


@registry.add("p4_batches", _P4 + """ SELECT batch_no, n AS row_count, coalesce(r, 0) AS refused, n - coalesce(r, 0) AS accepted
FROM (SELECT batch_no, count(*) AS n FROM i GROUP BY batch_no) LEFT JOIN (SELECT batch_no, count(*) AS r FROM d GROUP BY batch_no) USING (batch_no)""")
def p4_batches(spark, sf_dir):
    """Accepted and refused rows of each batch; rows lacking a part of the key are accepted."""
    incoming = table(spark, sf_dir, "incoming_findings").groupBy("batch_no").agg(F.count(F.lit(1)).alias("row_count"))
    no = _decided(spark, sf_dir).groupBy("batch_no").agg(F.count_if("refused").alias("refused"))
    out = incoming.join(no, "batch_no", "left").withColumn("refused", F.coalesce("refused", F.lit(0)))
    return out.withColumn("accepted", F.col("row_count") - F.col("refused"))


def _decided(spark, sf_dir):
    return history.decide(table(spark, sf_dir, "findings"), table(spark, sf_dir, "incoming_findings"))


# --- 6. seen before


def _seen(spark, sf_dir):
    key = fingerprint_hex("fingerprint").alias("fp")
    old = table(spark, sf_dir, "findings").select(key)
    new = table(spark, sf_dir, "incoming_findings").select(key, "record_no", "batch_no")
    return membership.seen_before(old, new, "fp", "record_no")


@registry.add("p6_found", f"""
WITH i AS (SELECT record_no, {_FP} AS fp FROM incoming_findings),
h AS (SELECT DISTINCT {_FP} AS fp FROM findings),
f AS (SELECT fp, min(record_no) AS first_no FROM i WHERE fp IS NOT NULL GROUP BY fp)
SELECT i.record_no FROM i JOIN f USING (fp) LEFT JOIN h ON h.fp = i.fp WHERE h.fp IS NOT NULL OR i.record_no > f.first_no""")
def p6_found(spark, sf_dir):
    return _seen(spark, sf_dir).where("seen").select("record_no")


@registry.add("p6_errors")
def p6_errors(spark, sf_dir):
    return membership.error_report(_seen(spark, sf_dir))


@registry.add("p6_routes", f"""
WITH i AS (SELECT record_no, batch_no, {_FP} AS fp FROM incoming_findings), h AS (SELECT DISTINCT {_FP} AS fp FROM findings),
f AS (SELECT fp, min(record_no) AS first_no FROM i WHERE fp IS NOT NULL GROUP BY fp)
SELECT batch_no, count(*) AS row_count, count(*) FILTER (WHERE i.record_no > first_no) AS repeats, count(*) FILTER (WHERE i.record_no = first_no AND h.fp IS NOT NULL) AS verified,
 count(*) FILTER (WHERE i.record_no = first_no AND h.fp IS NULL) AS first_keys FROM i JOIN f USING (fp) LEFT JOIN h ON h.fp = i.fp GROUP BY batch_no""")
def p6_routes(spark, sf_dir):
    """The same report without what hangs on the filter: negatives and disproved positives together are the keys not seen before."""
    return p6_errors(spark, sf_dir).select("batch_no", "row_count", "repeats", "verified", (F.col("negatives") + F.col("disproved")).alias("first_keys"))


# --- 8. mixing sources

#: Plain material first, dense material later.
CURRICULUM = {
    "courses": [(0, 2.0), (1, 0.0)],
    "chat": [(0, 1.5), (1, 0.5)],
    "wiki": [(0, 1.5), (1, 0.5)],
    "decisions": [(0, 0.5), (1, 1.5)],
    "policies": [(0, 0.5), (1, 1.5)],
    "papers": [(0, 0.0), (0.4, 0.5), (1, 2.0)],
}


def _counted(spark, sf_dir):
    return mixing.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"))


@registry.add("p8_found")
def p8_found(spark, sf_dir):
    """Sources of which the mixture, as the curriculum deals it, holds fewer tokens than wanted."""
    return p8_shares(spark, sf_dir).where("mixed_tokens < wanted_tokens").select("source")


@registry.add("p8_records", """
WITH d AS (SELECT nullif(lower(trim(source)), '') AS source, 1 + n_chars // 4 AS n FROM documents), t AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
h AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source)
SELECT source, tokens, (tokens * max_repeats < target_share * (SELECT sum(n) FROM d)) AS falls_short, CASE WHEN tokens * max_repeats < target_share * (SELECT sum(n) FROM d) THEN tokens * max_repeats END AS mixed_tokens FROM t JOIN h USING (source)""")
def p8_records(spark, sf_dir):
    """The dealt mixture with a quarter of the characters as sizes: of a source that falls short, all records as often as allowed."""
    counted = mixing.materialise(table(spark, sf_dir, "documents").select("doc_id", "source", (F.lit(1) + F.floor(F.col("n_chars") / 4)).cast("long").alias("n_tokens")), "mix-tokens")
    targets = table(spark, sf_dir, "mix_targets")
    got = mixing.actual_shares(mixing.mixture(counted, targets, CURRICULUM), mixing.shares(counted, targets))
    return got.where("tokens > 0").select("source", "tokens", "falls_short", F.when(F.col("falls_short"), F.col("mixed_tokens")).alias("mixed_tokens"))


@registry.add("p8_mixture")
def p8_mixture(spark, sf_dir):
    counted = mixing.materialise(_counted(spark, sf_dir), "mix-tokens")
    return mixing.mixture(counted, table(spark, sf_dir, "mix_targets"), CURRICULUM)


@registry.add("p8_shares")
def p8_shares(spark, sf_dir):
    counted = mixing.materialise(_counted(spark, sf_dir), "mix-tokens")
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.actual_shares(mixing.mixture(counted, targets, CURRICULUM), mixing.shares(counted, targets))


# --- 9. reading level


def _assessed(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return reading.assess(documents, reading.fit(documents, table(spark, sf_dir, "reading_labels")))


@registry.add("p9_found")
def p9_found(spark, sf_dir):
    return _assessed(spark, sf_dir).where("reading_level IN (1, 4)").select("doc_id", "reading_level")


@registry.add("p9_profile")
def p9_profile(spark, sf_dir):
    """Documents by source and reading level."""
    source = table(spark, sf_dir, "documents").select("doc_id", squeezed("source").alias("source"))
    return _assessed(spark, sf_dir).join(source, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"))


# --- 7. evaluation items in training text


def _leaks(spark, sf_dir):
    return leakage.find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf_dir, "eval_items"))


@registry.add("p7_found")
def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir).where("kind = 'quote'").select("item_id", "doc_id").distinct()


@registry.add("p7_items")
def p7_items(spark, sf_dir):
    """Leaked items with the number of documents and the longest leaked stretch."""
    got = _leaks(spark, sf_dir).where("kind = 'quote'").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(got, "item_id")


@registry.add("p7_paraphrases")
def p7_paraphrases(spark, sf_dir):
    """Documents that hold most of an item's words in order without a leaked stretch."""
    return _leaks(spark, sf_dir).where("kind = 'paraphrase'").groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.round(F.max("cosine"), 3).alias("cosine"))
