"""Queries of versioned rules, dense codes, audits and large paired tests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import audits, codes
from ..operators import rule_versions as RV
from ..operators import studies as D
from ..operators.ingest import REDACTIONS
from .catalog import register

_RULES = [{"id": i, "target": "text", "action": "REDACT", "pattern": p, "replacement": r} for i, p, r in REDACTIONS]

#: Rule documents with the moment from which they hold; documents' ids are the moments. The second breaks the contract.
VERSIONS = [
    (0, {"version": "a", "rules": _RULES[:2], "package_blocklist": ["de"], "max_text_length": 100_000}),
    (60, {"version": "broken", "rules": _RULES[:1], "package_blocklist": [], "max_text_length": 0}),
    (120, {"version": "b", "rules": [*_RULES, {"id": "n", "target": "node", "action": "DROP", "pattern": "e"}], "package_blocklist": ["en", "fr"], "max_text_length": 3_000}),
]


def _sha(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _replaced(text: str, rules: list[tuple[str, str, str]]) -> str:
    for _, pattern, replacement in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


@register(
    "versioned_rules", "H4 H7 V19 L7",
    f"""SELECT doc_id, CASE WHEN doc_id < 120 THEN 'a' ELSE 'b' END AS rule_version, CASE WHEN doc_id < 120 THEN '{_sha(VERSIONS[0][1])}' ELSE '{_sha(VERSIONS[2][1])}' END AS rule_hash,
 CASE WHEN doc_id < 120 THEN coalesce(lang = 'de', false) ELSE coalesce(lang IN ('en', 'fr'), false) END AS blocked,
 sha256(CASE WHEN doc_id < 120 THEN left({_replaced('text', REDACTIONS[:2])}, 100000) ELSE left({_replaced('text', REDACTIONS)}, 3000) END) AS redacted_sha256 FROM documents WHERE doc_id >= 0""",
)
def versioned_rules(spark, sf_dir):
    documents = spark.createDataFrame([(at, json.dumps(d, indent=1)) for at, d in VERSIONS], "valid_from bigint, document string")
    versions = RV.rule_versions(documents)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    held = RV.with_version(docs, versions, "doc_id", 100)
    text = RV.redacted(F.col("text"), F.col("_rules"), F.col("_max_length"), RV.most_rules(versions))
    return held.select("doc_id", "rule_version", "rule_hash", F.coalesce(F.array_contains("_blocklist", F.col("lang")), F.lit(False)).alias("blocked"), F.sha2(text, 256).alias("redacted_sha256"))


@register("dense_codes", "N10", """WITH v AS (SELECT o_custkey::VARCHAR AS u FROM orders UNION SELECT 'n' || c_nationkey FROM customer UNION SELECT c_name FROM customer)
SELECT u AS value, dense_rank() OVER (ORDER BY u) - 1 AS code FROM v""")
def dense_codes(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    values = orders.select(F.col("o_custkey").cast("string").alias("u")).union(customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))).union(customer.select("c_name"))
    return codes.dense_codes(values, "u")


@register("privacy_audit", "V22", """WITH n AS (SELECT conv_id, turn % 11 = 10 AS password, CASE WHEN role = 'system' THEN text END AS t, CASE WHEN turn % 5 = 4 THEN left(text, 12) WHEN turn % 5 = 3 THEN '<EDITABLE_TEXT_DROPPED>' ELSE '' END AS r FROM conversations),
l AS (SELECT conv_id, coalesce(password, false) AS p, coalesce(t, '') <> '' AND t <> '<EDITABLE_TEXT_DROPPED>' AS a, coalesce(r, '') <> '' AND r <> '<EDITABLE_TEXT_DROPPED>' AS b FROM n)
SELECT conv_id, count(*) AS n_nodes, count(*) FILTER (p OR a OR b) AS n_bad, concat_ws(',', CASE WHEN bool_or(p) THEN 'password' END, CASE WHEN bool_or(a) THEN 'text' END, CASE WHEN bool_or(b) THEN 'text_redacted' END) AS leaks, bool_or(p OR a OR b) AS violated FROM l GROUP BY conv_id""")
def privacy_audit(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    redacted = F.when(F.col("turn") % 5 == 4, F.left("text", F.lit(12))).when(F.col("turn") % 5 == 3, audits.PLACEHOLDER).otherwise("")
    node = F.struct((F.col("turn") % 11 == 10).alias("password"), F.when(F.col("role") == "system", F.col("text")).alias("text"), redacted.alias("text_redacted"))
    out = audits.privacy_audit(c.select("conv_id", F.array(node).alias("nodes")), "conv_id", "nodes")
    return out.withColumn("leaks", F.concat_ws(",", "leaks"))


@register("device_provenance", "O5", """SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_devices, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS n_unknown, 'mixed' AS provenance""")
def device_provenance(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return audits.provenance(orders.select(F.col("o_custkey").alias("d")), customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("d")), "d")


@register("paired_tests_large", "R8", """WITH d AS (SELECT l_linenumber % 3 AS g, l_quantity - 25 AS d FROM lineitem), t AS (SELECT g, count(*) AS n_pairs, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM d GROUP BY g)
SELECT g, n_pairs, wins, losses, round(log10(greatest(1e-300, least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))))), 4) AS log_p_sign FROM t""")
def paired_tests_large(spark, sf_dir):
    """The sign test of groups of thousands of pairs: its terms are far below what a double holds."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") % 3).alias("g"), (F.col("l_quantity") - 25).alias("d"))
    out = D.paired_tests(li, "d", ["g"])
    return out.select("g", "n_pairs", "wins", "losses", (F.round(F.log10(F.greatest(F.lit(1e-300), "p_sign")), 4)).alias("log_p_sign"))
