"""Queries on per-key results under skew."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelsieve.operators import skew
from keelsieve.plans.registry import Registry, table

registry = Registry()

_KEYS = r"""
SELECT 'fingerprint' AS key_name,
       nullif(regexp_extract(lower(fingerprint), '^\s*(?:[a-z0-9_.-]+:)*([0-9a-f]{64})\s*$', 1), '') AS key_value,
       created_at, coalesce(source_uri, '') AS u, coalesce(path, '') AS p FROM findings
UNION ALL
SELECT 'rule_id', nullif(lower(regexp_replace(rule_id, '^\s+|\s+$', '', 'g')), ''),
       created_at, coalesce(source_uri, ''), coalesce(path, '') FROM findings
"""


@registry.add("p5_keys", f"""
WITH k AS ({_KEYS}), t AS (SELECT *, CASE WHEN epoch_us(created_at) >= 31536000000000 THEN epoch_us(created_at) END AS seen FROM k WHERE key_value IS NOT NULL)
SELECT key_name, key_value, count(*) AS row_count, min(seen) AS first_created_us, max(seen) AS last_created_us,
       count(DISTINCT u || chr(10) || p) AS places
FROM t GROUP BY key_name, key_value""")
def p5_keys(spark, sf_dir):
    out = skew.keyed_statistics(table(spark, sf_dir, "findings"))
    return out.select(
        "key_name", "key_value", "row_count",
        F.unix_micros("first_created_at").alias("first_created_us"), F.unix_micros("last_created_at").alias("last_created_us"), "places",
    )


@registry.add("p5_found", f"""
WITH k AS ({_KEYS})
SELECT key_name, key_value FROM k WHERE key_value IS NOT NULL
GROUP BY key_name, key_value HAVING count(*) * 1000 >= 15 * (SELECT count(*) FROM findings)""")
def p5_found(spark, sf_dir):
    return skew.heavy_keys(table(spark, sf_dir, "findings"))
