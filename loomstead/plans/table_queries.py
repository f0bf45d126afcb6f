"""Queries over ingest rules, redaction, duplicates, and the relational extensions (survey rows V, L, X and 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from .catalog import register


@register("ingest_reason_codes", "V1 V2 V3 V18", """WITH e AS (SELECT conv_id, turn, role, to_base64(encode(text)) || CASE WHEN turn % 5 = 1 THEN '*' ELSE '' END AS payload, sha256(text) AS good, CASE WHEN turn % 3 = 2 THEN repeat('0', 64) ELSE sha256(text) END AS sha,
 sha256(role) AS device, CASE WHEN role = 'user' THEN sha256('user') ELSE sha256('x') END AS inner_device, text FROM conversations)
SELECT conv_id, turn, CASE WHEN length(payload) = 0 THEN 'invalid_envelope' WHEN turn % 5 = 1 THEN 'invalid_base64' WHEN sha <> good THEN 'payload_hash_mismatch' WHEN device <> inner_device THEN 'envelope_batch_device_id_mismatch' END AS reason FROM e""")
def ingest_reason_codes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.col("text").cast("binary")
    packed64 = F.regexp_replace(F.base64(body), "[\\r\\n]", "")
    e = c.select("conv_id", "turn", "role", F.concat(packed64, F.when(F.col("turn") % 5 == 1, "*").otherwise("")).alias("payload_base64"), F.when(F.col("turn") % 3 == 2, F.repeat(F.lit("0"), 64)).otherwise(F.sha2(body, 256)).alias("payload_sha256_hex"), F.sha2("role", 256).alias("device_id"))
    e = e.withColumns({"algorithm": F.lit(I.ALGORITHM), "rule_hash": F.sha2(F.lit("r"), 256), "batch_id": F.lit("00000000-0000-4000-8000-000000000000"), "created_at_wall_millis": F.lit(0), "rule_version": F.lit("1")})
    packed = F.when(F.col("payload_base64").rlike(I.BASE64), F.try_to_binary("payload_base64", F.lit("base64")))
    e = e.withColumn("packed", packed).withColumn("inner", F.when(F.col("role") == "user", F.sha2(F.lit("user"), 256)).otherwise(F.sha2(F.lit("x"), 256)))
    reason = F.when(~I.envelope_ok(), "invalid_envelope").when(F.col("packed").isNull(), "invalid_base64").when(F.sha2("packed", 256) != F.col("payload_sha256_hex"), "payload_hash_mismatch").when(F.col("device_id") != F.col("inner"), "envelope_batch_device_id_mismatch")
    return e.select("conv_id", "turn", reason.alias("reason"))


def _redact_sql() -> str:
    out = "text"
    for _, pattern, replacement in I.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


@register("redaction_rules", "L7", f"SELECT doc_id, sha256({_redact_sql()}) AS redacted, length({_redact_sql()}) AS n FROM documents")
def redaction_rules(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", I.redact(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("redacted"), F.length("t").cast("bigint").alias("n"))


@register("dedupe_conflict", "X5 X6 X7 S13", """SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN sha256(text) = first_value(sha256(text)) OVER w THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM documents WINDOW w AS (PARTITION BY lang, n_chars ORDER BY doc_id)""")
def dedupe_conflict(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("content"))
    return I.duplicates(d, ["lang", "n_chars"], ["doc_id"], "content").select("doc_id", "outcome")


@register("quarantine_record", "S17", "SELECT event_id, sha256(json(props)::VARCHAR) AS payload_sha256, array_to_string(list_sort(json_keys(props))[1:50], ',') AS top_keys FROM events")
def quarantine_record(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    return I.quarantine_record(e, "props").select("event_id", "payload_sha256", F.array_join("top_keys", ",").alias("top_keys"))


@register("rollup_report", "2.14", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_report(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("cube_report", "2.14", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 8) AS mean_discount FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_report(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 8).alias("mean_discount"))


@register("approx_distinct", "2.14", "SELECT event_type, count(DISTINCT user_id) AS n, true AS close, true AS nonzero FROM events GROUP BY event_type")
def approx_distinct(spark, sf_dir):
    """The sketch's count must lie near the exact one, which DuckDB has too."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    both = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"))
    return both.select("event_type", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("close"), (F.col("a") > 0).alias("nonzero"))


@register("set_ops", "2.14 K1", """SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def set_ops(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    built = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return keys("F").intersect(keys("O")).exceptAll(built).distinct()


@register("star_revenue", "2.14", """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name, r_name""")
def star_revenue(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    li = t("lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("rev").alias("rev"))
    j = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))
