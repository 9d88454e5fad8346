"""Queries of correlation, assessment, tools, folds and addresses, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelsieve.functions.normalise import utc_micros
from keelsieve.operators import assess, correlate, folds, tools, weburl
from keelsieve.plans import detect_queries
from keelsieve.plans.registry import Registry, table
from keelsieve.shared import new_path
from keelsieve.sinks import render
from keelsieve.sources import files
from keelsieve.sources.rules import BUILTIN
from keelsieve.streaming import streams

registry = Registry()
AS_OF = "2025-07-15 00:00:00"


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "findings").withColumn("seq", F.col("row_no"))


# --- correlation

_SAME = r"coalesce(nullif(regexp_extract(lower(fingerprint), '^\s*(?:[a-z0-9_.-]+:)*([0-9a-f]{64})\s*$', 1), ''), nullif(lower(regexp_replace(fingerprint, '^\s+|\s+$', '', 'g')), ''))"
_BASE = f"""b AS (SELECT 'cred_' || substr(sha256('credential:' || fp), 1, 16) AS credential_id, fp AS fingerprint, coalesce(source_type, '') AS source_type, coalesce(source_uri, '') AS source_uri,
 coalesce(path, '') AS path, coalesce(commit_sha, '') AS commit_sha, CASE WHEN epoch_us(created_at) >= 31536000000000 THEN created_at END AS created_at, row_no, coalesce(rule_id, '') AS rule_id FROM (SELECT *, {_SAME} AS fp FROM findings) WHERE fp IS NOT NULL)"""
_EXPOSURES = """e AS (SELECT 'exp_' || substr(sha256('exposure:' || credential_id || '|' || source_type || '|' || source_uri || '|' || path || '|' || commit_sha), 1, 16) AS id,
 credential_id, source_type, source_uri, path, commit_sha, CASE WHEN arg_min(created_at IS NOT NULL, row_no) THEN min(created_at) END AS first_seen, max(created_at) AS last_seen FROM b GROUP BY credential_id, source_type, source_uri, path, commit_sha)"""
_CREDENTIALS = """c AS (SELECT g.credential_id AS id, fingerprint, CASE WHEN instr(kind, '-') > 1 THEN split_part(kind, '-', 1) ELSE kind END AS provider, kind, 'active' AS status, first_seen, last_seen, exposure_count
 FROM (SELECT credential_id, min(fingerprint) AS fingerprint, arg_min(rule_id, row_no) AS kind, min(created_at) AS first_seen, max(created_at) AS last_seen FROM b GROUP BY credential_id) g
 JOIN (SELECT credential_id, count(*) AS exposure_count FROM e GROUP BY credential_id) n USING (credential_id))"""
_ALL = f"WITH {_BASE}, {_EXPOSURES}, {_CREDENTIALS} "


def _us(c):
    return F.unix_micros(c).alias(c)


@registry.add("credentials", _ALL + "SELECT id, fingerprint, provider, kind, status, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, exposure_count FROM c")
def credentials(spark, sf_dir):
    c = correlate.credentials(_findings(spark, sf_dir))
    return c.select("id", "fingerprint", "provider", "kind", "status", _us("first_seen"), _us("last_seen"), "exposure_count")


@registry.add("exposures", _ALL + "SELECT id, credential_id, source_type, source_uri, path, commit_sha, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen FROM e")
def exposures(spark, sf_dir):
    e = correlate.exposures(_findings(spark, sf_dir))
    return e.select("id", "credential_id", "source_type", "source_uri", "path", "commit_sha", _us("first_seen"), _us("last_seen"))


@registry.add("incidents", _ALL + "SELECT 'inc_' || substr(sha256('incident:' || id), 1, 16) AS id, id AS credential_id, 'open' AS status, exposure_count, epoch_us(first_seen) AS created_at, epoch_us(last_seen) AS updated_at FROM c")
def incidents(spark, sf_dir):
    return correlate.incidents(_findings(spark, sf_dir)).select("id", "credential_id", "status", "exposure_count", _us("created_at"), _us("updated_at"))


@registry.add("incident_members", _ALL + "SELECT 'inc_' || substr(sha256('incident:' || credential_id), 1, 16) AS incident_id, id AS exposure_id FROM e")
def incident_members(spark, sf_dir):
    return correlate.incident_members(_findings(spark, sf_dir))


@registry.add("correlation_documents", _ALL + "SELECT c.id, provider, kind, status, exposure_count, e.id AS exposure_id, source_type, source_uri, path, commit_sha FROM c JOIN e ON e.credential_id = c.id")
def correlation_documents(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return render.correlation_documents(correlate.credentials(f), correlate.exposures(f))


@registry.add("correlation_lines", _ALL + """, i AS (SELECT 'inc_' || substr(sha256('incident:' || id), 1, 16) AS id, id AS credential_id, exposure_count FROM c)
SELECT 'credential' AS kind, id, '{"id":"' || id || '","fingerprint":' || to_json(fingerprint) || ',"provider":' || to_json(provider) || ',"kind":' || to_json(kind) || ',"status":"active","exposure_count":' || exposure_count || '}' AS document FROM c
UNION ALL SELECT 'exposure', id, '{"id":"' || id || '","credential_id":"' || credential_id || '","source_type":' || to_json(source_type) || ',"source_uri":' || to_json(source_uri) || ',"path":' || to_json(path) || ',"commit_sha":' || to_json(commit_sha) || '}' FROM e
UNION ALL SELECT 'incident', id, '{"id":"' || id || '","credential_id":"' || credential_id || '","status":"open","exposure_count":' || exposure_count || '}' FROM i""")
def correlation_lines(spark, sf_dir):
    f = _findings(spark, sf_dir)
    c, e, i = correlate.credentials(f), correlate.exposures(f), correlate.incidents(f)
    times = ("first_seen", "last_seen", "created_at", "updated_at")
    return render.correlation_lines(*[x.drop(*times) for x in (c, e, i)])


@registry.add("findings_round_trip", "SELECT rule_id, count(*) AS findings, round(sum(confidence), 6) AS confidence, count(DISTINCT finding_id) AS ids, sum(secret_length)::BIGINT AS length FROM (SELECT coalesce(rule_id, '') AS rule_id, confidence, finding_id, secret_length FROM findings) GROUP BY rule_id")
def findings_round_trip(spark, sf_dir):
    """All findings written as JSON documents by all tasks and read back."""
    f = table(spark, sf_dir, "findings").withColumnsRenamed({"finding_id": "id", "secret_length": "length"})
    path = new_path(spark, "findings-json")
    render.write_json(f, path)
    got = files.findings_json(spark, path, multi_line=False)
    return got.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.round(F.sum("confidence"), 6).alias("confidence"), F.count_distinct("id").alias("ids"), F.sum("length").alias("length"))


@registry.add("upsert_latest", """
SELECT finding_id, arg_max(state, ingested_at) AS state, max(epoch_us(ingested_at)) AS ingested_at FROM
 (SELECT finding_id, state, ingested_at FROM findings) GROUP BY finding_id""")
def upsert_latest(spark, sf_dir):
    """Re-delivered findings merged by id, the latest delivery winning."""
    f = table(spark, sf_dir, "findings").select("finding_id", "state", "ingested_at")
    # what is there already claims to be newer: a change replaces it all the same
    base = f.groupBy("finding_id").agg(F.lit("STALE").alias("state"), (F.max("ingested_at") + F.expr("INTERVAL 1 YEAR")).alias("ingested_at")).select(*f.columns)
    out = correlate.upsert(base, f, ["finding_id"], "ingested_at")
    return out.select("finding_id", "state", _us("ingested_at"))


# --- assessment

_ASSESSED = f"""{_ALL}, x AS (SELECT credential_id AS id, count(*) AS n, count(DISTINCT source_type) AS kinds, first(source_type || ':' || coalesce(nullif(path, ''), source_uri) || CASE WHEN source_type IN ('web_page', 'web_script') THEN ' is on the web' WHEN source_type IN ('git_working_tree', 'file') THEN ' is a local file' ELSE ' has no known visibility' END
    ORDER BY CASE WHEN source_type IN ('web_page', 'web_script') THEN 1 WHEN source_type IN ('git_working_tree', 'file') THEN 3 ELSE 2 END, id) AS why,
   max(CASE WHEN source_type IN ('web_page', 'web_script') THEN 1.6::DOUBLE WHEN source_type IN ('git_working_tree', 'file') THEN 1::DOUBLE ELSE 1.2::DOUBLE END) AS visibility FROM e GROUP BY credential_id),
f AS (SELECT c.id, provider, why, 1::DOUBLE + 0.15::DOUBLE * least(n - 1, 10) AS exposure_factor, visibility AS visibility_factor,
  CASE WHEN lower(provider) IN ('aws', 'gcp', 'azure') THEN 1.5::DOUBLE WHEN lower(provider) IN ('github', 'gitlab', 'stripe') THEN 1.2::DOUBLE ELSE 1::DOUBLE END AS provider_factor,
  CASE WHEN first_seen IS NULL OR h < 24 THEN 1::DOUBLE WHEN h < 168 THEN 1.1::DOUBLE WHEN h < 720 THEN 1.25::DOUBLE WHEN h < 4320 THEN 1.4::DOUBLE ELSE 1.6::DOUBLE END AS age_factor,
  1::DOUBLE + 0.2::DOUBLE * least(kinds - 1, 4) AS reuse_factor FROM (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen)) / 3600000000 AS h FROM c) c JOIN x USING (id)),
s AS (SELECT *, least(10::DOUBLE, exposure_factor * visibility_factor * provider_factor * age_factor * reuse_factor * 1::DOUBLE) AS score FROM f),
a AS (SELECT *, CASE WHEN score >= 6 THEN 'CRITICAL' WHEN score >= 4 THEN 'HIGH' WHEN score >= 2.5 THEN 'MEDIUM' WHEN score >= 1.5 THEN 'LOW' ELSE 'INFO' END AS level FROM s) """


def _assessed(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return assess.assess(correlate.credentials(f), correlate.exposures(f), AS_OF)


@registry.add("assessments", _ASSESSED + "SELECT id, provider, round(exposure_factor, 9) AS exposure_factor, visibility_factor, provider_factor, age_factor, round(reuse_factor, 9) AS reuse_factor, round(score, 9) AS score, level, why AS visibility_reason FROM a")
def assessments(spark, sf_dir):
    a = _assessed(spark, sf_dir)
    return a.select("id", "provider", F.round("exposure_factor", 9).alias("exposure_factor"), "visibility_factor", "provider_factor", "age_factor", F.round("reuse_factor", 9).alias("reuse_factor"), F.round("score", 9).alias("score"), "level", "visibility_reason")


@registry.add("assessment_factors", _ASSESSED + """SELECT factor, round(avg(m), 9) AS mean_multiplier, count(*) AS credentials FROM (
 SELECT unnest(['exposure', 'visibility', 'provider', 'age', 'reuse', 'confidence']) AS factor, unnest([exposure_factor, visibility_factor, provider_factor, age_factor, reuse_factor, 1::DOUBLE]) AS m FROM a) GROUP BY factor""")
def assessment_factors(spark, sf_dir):
    return assess.factors(_assessed(spark, sf_dir)).groupBy("factor").agg(F.round(F.avg("multiplier"), 9).alias("mean_multiplier"), F.count(F.lit(1)).alias("credentials"))


@registry.add("assessment_levels", _ASSESSED + "SELECT level, count(*) AS credentials FROM a GROUP BY level")
def assessment_levels(spark, sf_dir):
    return _assessed(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("credentials"))


_KINDS = [("aws", "aws-session-pair", "session pair"), ("github", "github-app-token", "app token"), ("gcp", "gcp-service-account", "service account")]


@registry.add("enrichments", _ALL + """, k(provider, kind, credential_type) AS (VALUES ('aws', 'aws-session-pair', 'session pair'), ('github', 'github-app-token', 'app token'), ('gcp', 'gcp-service-account', 'service account'))
SELECT c.id, c.provider, coalesce(credential_type, 'unknown') AS credential_type, CASE WHEN credential_type IS NOT NULL THEN 0.3::DOUBLE ELSE 0.15::DOUBLE END AS confidence
FROM c LEFT JOIN k ON k.provider = c.provider AND k.kind = c.kind WHERE c.provider IN (SELECT provider FROM k)""")
def enrichments(spark, sf_dir):
    kinds = spark.createDataFrame(_KINDS, "provider string, kind string, credential_type string")
    found, _ = assess.enrich_all(correlate.credentials(_findings(spark, sf_dir)), {"structural": lambda c: assess.enrich(c, kinds), "offline": lambda c: c.select("no_such_column")})
    return found.drop("source")


@registry.add("first_match_table", """
SELECT source_type, severity, count(*) AS findings, any_value(CASE WHEN severity = 'critical' AND source_type = 'ci' THEN 1 WHEN severity = 'critical' THEN 2 WHEN source_type = 'web_page' THEN 3 END) AS step
FROM findings GROUP BY source_type, severity""")
def first_match_table(spark, sf_dir):
    rules = [{"severity": "critical", "source_type": "ci", "step": 1}, {"severity": "critical", "step": 2}, {"source_type": "web_page", "step": 3}]
    rows = table(spark, sf_dir, "findings").groupBy("source_type", "severity").agg(F.count(F.lit(1)).alias("findings"))
    return assess.first_match(rows, rules, ["severity", "source_type"], {"step": "int"})


@registry.add("illegal_steps", """
WITH s AS (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events)
SELECT from_state, to_state, count(*) AS steps FROM s WHERE from_state > to_state GROUP BY ALL""")
def illegal_steps(spark, sf_dir):
    """Changes of a user's event type that an edge table (rising names only) does not allow."""
    e = table(spark, sf_dir, "events")
    kinds = F.array_sort(F.collect_set("event_type"))  # a handful of names
    pairs = F.flatten(F.transform(F.col("k"), lambda a: F.transform(F.filter("k", lambda b: b > a), lambda b: F.struct(a.alias("from_state"), b.alias("to_state")))))
    edges = e.agg(kinds.alias("k")).select(F.inline(pairs))
    return assess.illegal_steps(e, edges, "user_id", ["ts", "event_id"], "event_type").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("steps"))


# --- tools

_TOOLS = ", ".join(f"('{n}', '{s}', [{', '.join(repr(a) for a in args)}])" for n, s, args, _ in tools.CATALOGUE)


@registry.add("list_findings", "SELECT row_no, finding_id, rule_id, severity, state FROM findings WHERE state = 'OPEN' AND source_type = 'ci' ORDER BY row_no LIMIT 100")
def list_findings(spark, sf_dir):
    """The listing tool with its limit: a top-k by key."""
    return tools.listed(table(spark, sf_dir, "findings"), "row_no", 100, state="OPEN", source_type="ci", rule_id=None).select("row_no", "finding_id", "rule_id", "severity", "state")


@registry.add("get_finding", "SELECT row_no, finding_id, rule_id, severity, state FROM findings WHERE finding_id = (SELECT min(finding_id) FROM findings)")
def get_finding(spark, sf_dir):
    """All deliveries of one finding, by its id."""
    f = table(spark, sf_dir, "findings")
    return tools.one(f, "finding_id", f.agg(F.min("finding_id")).head()[0]).select("row_no", "finding_id", "rule_id", "severity", "state")


@registry.add("list_incidents", _ALL + "SELECT 'inc_' || substr(sha256('incident:' || id), 1, 16) AS id, id AS credential_id, exposure_count FROM c ORDER BY 1 LIMIT 50")
def list_incidents(spark, sf_dir):
    return tools.listed(correlate.incidents(_findings(spark, sf_dir)), "id", 50, status="open").select("id", "credential_id", "exposure_count")


@registry.add("list_credentials", _ALL + "SELECT id, provider, kind, exposure_count FROM c WHERE provider = 'github' AND status = 'active'")
def list_credentials(spark, sf_dir):
    return tools.listed(correlate.credentials(_findings(spark, sf_dir)), "id", provider="github", status="active").select("id", "provider", "kind", "exposure_count")


@registry.add("tool_catalogue", f"SELECT tool, scope, len(arguments)::BIGINT AS arguments FROM (VALUES {_TOOLS}) t(tool, scope, arguments)")
def tool_catalogue(spark, sf_dir):
    return tools.catalogue(spark).select("tool", "scope", F.size("arguments").cast("long").alias("arguments"))


def _calls(spark, sf_dir):
    """Tool calls derived from the events: who, when, which tool, with which scopes and arguments."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(n) for n, *_ in tools.CATALOGUE], F.lit("no_such_tool"))
    scopes = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("findings:read"))).when(F.col("user_id") % 3 == 1, F.array(F.lit("findings:read"), F.lit("credentials:read"))).otherwise(F.array(F.lit("scans:read"), F.lit("scans:start")))
    arguments = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("limit"), F.lit("colour"))).when(F.col("event_id") % 5 == 1, F.array(F.lit("finding_id"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("call_id"), F.col("user_id").cast("string").alias("principal"), "ts", F.get(names, (F.col("event_id") % 13).cast("int")).alias("tool"), scopes.alias("scopes"), arguments.alias("arguments"))


_CALLS = f"""tools(tool, scope, takes) AS (VALUES {_TOOLS}),
calls AS (SELECT event_id AS call_id, user_id::VARCHAR AS principal, [{', '.join(repr(n) for n, *_ in tools.CATALOGUE)}, 'no_such_tool'][(event_id % 13 + 1)::INT] AS tool,
 CASE user_id % 3 WHEN 0 THEN ['findings:read'] WHEN 1 THEN ['findings:read', 'credentials:read'] ELSE ['scans:read', 'scans:start'] END AS scopes,
 CASE event_id % 5 WHEN 0 THEN ['limit', 'colour'] WHEN 1 THEN ['finding_id'] ELSE []::VARCHAR[] END AS arguments FROM events)"""
_DECISIONS = _CALLS + """, d AS (SELECT call_id, principal, c.tool, CASE WHEN scope IS NULL THEN 'denied_unknown_tool' WHEN NOT list_contains(scopes, scope) THEN 'denied_authz'
 WHEN scope NOT IN ('findings:read', 'credentials:read', 'scans:start') THEN 'denied_policy' WHEN scope = 'scans:start' THEN 'denied_approval_pending'
 WHEN len(list_filter(arguments, lambda a: NOT list_contains(takes, a))) > 0 THEN 'denied_arguments' ELSE 'allowed' END AS result FROM calls c LEFT JOIN tools t ON t.tool = c.tool)"""


def _decisions(spark, sf_dir):
    return tools.dispatch(_calls(spark, sf_dir), tools.catalogue(spark), ["findings:read", "credentials:read", "scans:start"], {"scans:start": 1})


@registry.add("dispatch_decisions", f"WITH {_DECISIONS} SELECT call_id, principal, tool, result FROM d")
def dispatch_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("call_id", "principal", "tool", "result")


@registry.add("audit_rows", f"WITH {_DECISIONS} SELECT principal AS actor, 'tool_call:' || tool AS action, result, count(*) AS calls FROM d GROUP BY ALL")
def audit_rows(spark, sf_dir):
    return tools.audit(_decisions(spark, sf_dir), AS_OF).groupBy("actor", "action", "result").agg(F.count(F.lit(1)).alias("calls"))


# --- folds over events


_EVENTS = "e AS (SELECT event_id, {key} AS k, value < 20 AS failed, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL)"


@registry.add("token_bucket", f"""
WITH RECURSIVE {_EVENTS.format(key='user_id')},
w AS (SELECT event_id, k, n, us, 2.0::DOUBLE AS left_over, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE n = 1
 UNION ALL SELECT event_id, k, n, us, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END FROM (
  SELECT e.event_id, e.k, e.n, e.us, CASE WHEN (e.us - w.us) / 1e6 >= 900000 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, w.left_over + (e.us - w.us)::DOUBLE / 1e6::DOUBLE * 0.00001::DOUBLE) END AS t FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1))
SELECT event_id, k AS user_id, allowed, round(tokens, 6) AS tokens FROM w""")
def token_bucket(spark, sf_dir):
    out = folds.token_bucket(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", rate=0.00001, burst=3.0, idle_seconds=900_000)
    return out.withColumn("tokens", F.round("tokens", 6))


@registry.add("breaker_states", f"""
WITH RECURSIVE {_EVENTS.format(key='event_type')},
w AS (SELECT event_id, k, n, 'closed' AS before, true AS admitted, CASE WHEN failed THEN 1 ELSE 0 END AS fails, 'closed' AS state, 0::BIGINT AS opened FROM e WHERE n = 1
 UNION ALL SELECT event_id, k, n, b, ok, CASE WHEN NOT ok THEN fails WHEN bad THEN fails + 1 ELSE 0 END,
   CASE WHEN NOT ok THEN 'open' WHEN NOT bad THEN 'closed' WHEN b = 'half_open' OR fails + 1 >= 2 THEN 'open' ELSE b END,
   CASE WHEN ok AND bad AND (b = 'half_open' OR fails + 1 >= 2) THEN us ELSE opened END FROM (
  SELECT e.event_id, e.k, e.n, e.us, coalesce(e.failed, false) AS bad, w.fails, w.opened,
   CASE WHEN w.state = 'open' AND (e.us - w.opened) / 1e6 >= 600 THEN 'half_open' ELSE w.state END AS b, NOT (w.state = 'open' AND (e.us - w.opened) / 1e6 < 600) AS ok
  FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1))
SELECT event_id, k AS event_type, before AS state, admitted FROM w""")
def breaker_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("failed", F.col("value") < 20)
    return folds.breaker(e, "event_type", "ts", "event_id", "failed", threshold=2, open_seconds=600)


@registry.add("cache_hits", """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
w AS (SELECT event_id, user_id, n, ts AS stored, false AS hit FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN epoch_us(e.ts) - epoch_us(w.stored) < 86400000000 THEN w.stored ELSE e.ts END, epoch_us(e.ts) - epoch_us(w.stored) < 86400000000 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, user_id, hit FROM w""")
def cache_hits(spark, sf_dir):
    return folds.cached(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ttl_seconds=86_400)


# --- addresses and pages


@registry.add("url_canonical", """
SELECT artifact_id, CASE WHEN uri LIKE 'http%' THEN regexp_replace(lower(regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*')) || CASE WHEN regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END, '(.)/$', '\\1')
 || CASE WHEN contains(uri, '?') THEN '?' || regexp_extract(uri, '\\?([^#]*)', 1) ELSE '' END END AS url FROM artifacts""")
def url_canonical(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts")
    return a.select("artifact_id", weburl.canonical_url(F.col("uri")).alias("url"))


_URL = """regexp_replace(lower(regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*')) || CASE WHEN regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(uri, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END, '(.)/$', '\\1')
 || CASE WHEN contains(uri, '?') THEN '?' || regexp_extract(uri, '\\?([^#]*)', 1) ELSE '' END"""


@registry.add("url_dedup", f"SELECT DISTINCT url, sha256(url) AS fingerprint FROM (SELECT {_URL} AS url FROM artifacts WHERE uri LIKE 'http%')")
def url_dedup(spark, sf_dir):
    return weburl.new_addresses(table(spark, sf_dir, "artifacts").where("uri LIKE 'http%'"), "uri")


@registry.add("domain_scope", r"""
SELECT artifact_id, h = 'www.fallowby.test' OR h = 'hazelrigg.test' OR h LIKE '%.www.fallowby.test' OR h LIKE '%.hazelrigg.test' AS in_scope
FROM (SELECT artifact_id, lower(regexp_extract(uri, '^https?://([^/:?#]+)', 1)) AS h FROM artifacts WHERE uri LIKE 'http%')""")
def domain_scope(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts").where("uri LIKE 'http%'")
    return a.select("artifact_id", weburl.in_domains(F.parse_url("uri", F.lit("HOST")), ["www.fallowby.test", "Hazelrigg.test"]).alias("in_scope"))


@registry.add("path_scope", "SELECT artifact_id, path = 'src' OR path LIKE 'src/%' OR path LIKE 'vendor/%' OR path = 'vendor/' AS excluded FROM artifacts WHERE path IS NOT NULL")
def path_scope(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts").where("path IS NOT NULL")
    return a.select("artifact_id", weburl.path_excluded(F.col("path"), ["src", "vendor/"]).alias("excluded"))


@registry.add("script_files", "SELECT source_type, count(*) FILTER (WHERE lower(path) LIKE '%.js' OR lower(path) LIKE '%.mjs' OR lower(path) LIKE '%.cjs') AS scripts, count(*) AS files FROM artifacts WHERE path IS NOT NULL GROUP BY source_type")
def script_files(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts").where("path IS NOT NULL")
    return a.groupBy("source_type").agg(F.count_if(weburl.is_script(F.col("path"))).alias("scripts"), F.count(F.lit(1)).alias("files"))


@registry.add("content_type_gate", "SELECT count(*) FILTER (WHERE coalesce(trim(mime_type), '') = '' OR contains(lower(mime_type), 'text/html')) AS pages, count(*) AS artifacts FROM artifacts")
def content_type_gate(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts")
    return a.agg(F.count_if(weburl.is_page(F.col("mime_type"))).alias("pages"), F.count(F.lit(1)).alias("artifacts"))


@registry.add("source_maps", r"SELECT artifact_id, regexp_extract(content, '//[@#]\s*sourceMappingURL=(\S+)', 1) AS source_map FROM artifacts WHERE regexp_matches(content, '//[@#]\s*sourceMappingURL=(\S+)') AND NOT lower(regexp_extract(content, '//[@#]\s*sourceMappingURL=(\S+)', 1)) LIKE 'data:%'")
def source_maps(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts")
    return a.select("artifact_id", weburl.source_map(F.col("content")).alias("source_map")).where("source_map IS NOT NULL")


def _pages(spark, sf_dir):
    """A page around every artifact's content."""
    a = table(spark, sf_dir, "artifacts").where(F.col("content").isNotNull())
    html = F.concat(F.lit('<html><head><script src="/js/app.js#x"></script><script>'), F.regexp_replace("content", "(?i)</script", "<\\\\/script"), F.lit("</script></head><body><a href='next.html#top'>n</a><a href=\"lib.mjs\">m</a></body></html>"))
    return a.select("artifact_id", F.concat(F.lit("https://pages.test/"), F.col("artifact_id").cast("string"), F.lit("/index.html")).alias("url"), html.alias("html"))


# what Python's strip takes from both ends of a script, and how the pages above escape an end tag
_STRIPPED = r"regexp_replace(regexp_replace(content, '(?i)</script', '<\\/script', 'g'), '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+$', '', 'g')"


@registry.add("page_scripts", f"SELECT artifact_id, sha256({_STRIPPED}) AS body_hash FROM artifacts WHERE content IS NOT NULL AND {_STRIPPED} != ''")
def page_scripts(spark, sf_dir):
    return weburl.parsed(_pages(spark, sf_dir)).select("artifact_id", F.explode("inline").alias("body")).select("artifact_id", F.sha2("body", 256).alias("body_hash"))


@registry.add("page_links", """
SELECT artifact_id, unnest(['https://pages.test/js/app.js', 'https://pages.test/' || artifact_id || '/lib.mjs', 'https://pages.test/' || artifact_id || '/next.html']) AS link FROM artifacts WHERE content IS NOT NULL""")
def page_links(spark, sf_dir):
    """Scripts and pages that the pages link to; references inside scripts are those of source_maps."""
    p = weburl.parsed(_pages(spark, sf_dir))
    return p.select("artifact_id", F.explode(F.concat(F.filter("scripts", lambda x: ~x.endswith(".map")), "links")).alias("link"))


@registry.add("inline_script_dedup", f"SELECT min(artifact_id) AS artifact_id, 0 AS no, h AS body_hash FROM (SELECT artifact_id, sha256({_STRIPPED}) AS h FROM artifacts WHERE content IS NOT NULL AND {_STRIPPED} != '') GROUP BY h")
def inline_script_dedup(spark, sf_dir):
    return weburl.inline_scripts(weburl.parsed(_pages(spark, sf_dir)), "artifact_id", ["artifact_id"]).select("artifact_id", "no", "body_hash")


@registry.add("crawl_round", """
SELECT 'https://pages.test/' || artifact_id || '/next.html' AS url, 1 AS depth, sha256('https://pages.test/' || artifact_id || '/next.html') AS fingerprint FROM artifacts
WHERE content IS NOT NULL ORDER BY url LIMIT 100""")
def crawl_round(spark, sf_dir):
    """What one round of a crawl would claim: new addresses in scope, within its page budget."""
    links = weburl.parsed(_pages(spark, sf_dir)).select(F.explode("links").alias("url"), F.lit(1).alias("depth"))
    seen = table(spark, sf_dir, "artifacts").select(weburl.url_fingerprint(weburl.canonical_url(F.col("uri"))).alias("fingerprint"))
    return weburl.claim(links, seen, 100, ["pages.test"])


@registry.add("robots_filter", "SELECT artifact_id, NOT (path LIKE 'vendors/%') AS allowed FROM artifacts WHERE path != '' AND path IS NOT NULL")
def robots_filter(spark, sf_dir):
    a = table(spark, sf_dir, "artifacts").where("path != ''").select("artifact_id", F.concat(F.lit("https://robots.test/"), "path").alias("url"), F.lit("robots.test").alias("host"))
    robots = spark.createDataFrame([("robots.test", "User-agent: *\nDisallow: /vendors/\n")], "host string, robots string")
    return weburl.robots_allowed(a, robots, "keelsieve").select("artifact_id", "allowed")


# addresses of all kinds: plain, mapped, local and public ones of six, and what is none
_BLOCKED = """CASE WHEN c_custkey % 6 IN (1, 3, 5) THEN true WHEN c_custkey % 6 = 2 THEN false ELSE (c_custkey % 256) IN (10, 127) OR (c_custkey % 256 = 192 AND 168 = (c_custkey * 7) % 256)
 OR (c_custkey % 256 = 172 AND (c_custkey * 7) % 256 BETWEEN 16 AND 31) OR (c_custkey % 256 = 169 AND (c_custkey * 7) % 256 = 254) END"""


def _addresses(spark, sf_dir):
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k % 256).cast("string"), ((k * 7) % 256).cast("string"), F.lit("1"), F.lit("2"))
    of = F.when(k % 6 == 0, F.concat(F.lit("::ffff:"), ip)).when(k % 6 == 1, F.concat(F.lit("fe80::"), (k % 256).cast("string"))).when(k % 6 == 2, F.concat(F.lit("2001:4860::"), (k % 256).cast("string"))).when(k % 6 == 3, F.lit("fc00::1")).when(k % 6 == 4, ip).otherwise(F.concat(ip, F.lit("x")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("h"), F.floor(k / 5).cast("string")).alias("host"), of.alias("address"))


@registry.add("guarded_addresses", f"SELECT c_custkey, {_BLOCKED} AS blocked FROM customer")
def guarded_addresses(spark, sf_dir):
    return _addresses(spark, sf_dir).select("c_custkey", weburl.blocked_address(F.col("address")).alias("blocked"))


@registry.add("rejected_hosts", f"SELECT host FROM (SELECT 'h' || c_custkey // 5 AS host, {_BLOCKED} AS blocked FROM customer) GROUP BY host HAVING bool_or(blocked)")
def rejected_hosts(spark, sf_dir):
    """Hosts that resolve to five addresses each, refused for a single bad one."""
    return weburl.rejected_hosts(_addresses(spark, sf_dir))


@registry.add("publishable_messages", "SELECT count(*) AS messages FROM documents WHERE strlen(text) <= 262144")
def publishable_messages(spark, sf_dir):
    return render.publishable(table(spark, sf_dir, "documents"), "text").agg(F.count(F.lit(1)).alias("messages"))


# --- streams, run to the end of what is there


@registry.add("stream_detect", detect_queries.registry.sql["detect_by_rule"])
def stream_detect(spark, sf_dir):
    """Findings of the stream of artifacts, written by its sink and counted by rule."""
    s = streams.artifacts(spark, f"{sf_dir}/artifacts.parque[t]", table(spark, sf_dir, "artifacts").schema)
    found = streams.detected(s, BUILTIN, detect_queries.OPTIONS).select("artifact_id", "rule_id", "fingerprint")
    out = new_path(spark, "stream-out")
    streams.run_available(found, out, new_path(spark, "stream-mark"))
    f = spark.read.schema(found.schema).parquet(out)
    return f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("fingerprint").alias("secrets"), F.count_distinct("artifact_id").alias("artifacts"))


@registry.add("stream_findings", detect_queries.registry.sql["detect_findings"])
def stream_findings(spark, sf_dir):
    """All rules with scores, bands and masks over the stream of artifacts, written by its sink: the rows of detect_findings."""
    s = streams.artifacts(spark, f"{sf_dir}/artifacts.parque[t]", table(spark, sf_dir, "artifacts").schema)
    found = streams.detected(s, BUILTIN, detect_queries.OPTIONS).select("artifact_id", "rule_id", "severity", "confidence", F.col("start").cast("long"), F.col("length").cast("long"), "masked_prefix")
    out = new_path(spark, "stream-out")
    streams.run_available(found, out, new_path(spark, "stream-mark"))
    return spark.read.schema(found.schema).parquet(out)


@registry.add("stream_dedup", registry.sql["url_dedup"])
def stream_dedup(spark, sf_dir):
    """Addresses of artifacts, each let through once by the stream: the rows of url_dedup."""
    s = streams.artifacts(spark, f"{sf_dir}/artifacts.parque[t]", table(spark, sf_dir, "artifacts").schema)
    first = streams.first_seen(s.where("uri LIKE 'http%'").select("uri"), "uri").select("url", "fingerprint")
    out = new_path(spark, "stream-out")
    streams.run_available(first, out, new_path(spark, "stream-mark"))
    return spark.read.schema(first.schema).parquet(out)


@registry.add("stream_publish", "SELECT count(*) AS messages, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE strlen(text) <= 262144")
def stream_publish(spark, sf_dir):
    """Documents published as a stream of messages within the size limit, counted where they arrive."""
    s = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    out = new_path(spark, "stream-out")
    streams.publish(s.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body")), out, new_path(spark, "stream-mark"))
    return spark.read.schema("key string, body string").json(out).agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("body")).cast("long").alias("bytes"))


@registry.add("stream_windows", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 day, ts)) AS window_start, count(*) AS row_count FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Daily windows of events, counted as a stream in complete mode."""
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    w = streams.counts(s.withColumn("ts", F.timestamp_micros(utc_micros(F.col("ts")))), "ts", ["event_type"], "1 day")
    out = new_path(spark, "stream-out")
    # the whole counts of every trigger, written by the tasks; the last trigger's hold
    q = w.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", new_path(spark, "stream-mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(w.schema).parquet(out).select("event_type", F.unix_micros("window.start").alias("window_start"), "row_count")
