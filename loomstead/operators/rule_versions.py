"""Versioned rule documents: checked, hashed, valid from a moment on, and applied as data.

A rule document is JSON: `version`, `rules` (id, target, action, pattern, replacement), `package_blocklist`, `max_text_length`
and, as a client sends it back, `rule_hash`. `rule_versions` makes a dimension table of documents, `problems` says what breaks
the contract, and `with_version` gives every row the version that held at its time. Texts are then redacted by the rules
of their own row: each place of a rule set is one expression over the row's pattern, and an expression keeps the last
pattern that it compiled, so a run of rows of one version compiles its rules once.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import HEX64, _compiles
from .timeline import range_attach

#: Fixed values of the contract.
TARGETS, ACTIONS, DEFAULT_LENGTH = ["text", "content_description", "node"], ["REDACT", "DROP", "ALLOW"], 4096
RULE = "struct<id:string,target:string,action:string,pattern:string,replacement:string>"
DOCUMENT = f"version string, rule_hash string, max_text_length bigint, package_blocklist array<string>, rules array<{RULE}>"


def _bare(column: pa.Array) -> pa.Array:
    def canonical(text: str | None) -> str | None:
        try:
            document = json.loads(text or "")
        except ValueError:
            return text
        if isinstance(document, dict):
            document.pop("rule_hash", None)
        return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return pa.array([canonical(x) for x in column.to_pylist()], pa.string())


def _hash(document: Column) -> Column:
    """The hash of a document without its own hash: of its canonical text, so neither spelling nor order matters."""
    return F.sha2(F.arrow_udf(_bare, "string")(document), 256)


def rule_versions(documents: DataFrame, document: str = "document", valid_from: str = "valid_from") -> DataFrame:
    """One row per document: version, valid_from, valid_to (the next fine version's start; null for the last), rule_hash,
    max_text_length, package_blocklist, rules, problems. Documents with problems never hold."""
    raw = F.col(document)
    d = documents.select(F.col(valid_from).cast("bigint").alias("valid_from"), raw.alias("_raw"), F.from_json(raw, DOCUMENT).alias("d"), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")).alias("_keys"))
    d = d.select("valid_from", "_raw", "_keys", "d.*").withColumnRenamed("rule_hash", "_sent").withColumn("rules", F.coalesce("rules", F.array().cast(f"array<{RULE}>")))
    each = d.select("valid_from", "_raw", F.explode("rules").alias("r")).select("valid_from", "_raw", "r.*")
    needs = F.col("action").isin("REDACT", "DROP") & (F.coalesce(F.length("pattern"), F.lit(0)) == 0)
    known = F.coalesce(F.col("target").isin(TARGETS) & F.col("action").isin(ACTIONS), F.lit(False))
    wrong = F.when(~known, "unknown_target_or_action").when(needs, "pattern_required").when(~F.coalesce(F.arrow_udf(_compiles, "boolean")("pattern"), F.lit(True)), "pattern_does_not_compile")
    bad = each.withColumn("p", F.concat_ws(":", wrong, F.coalesce("id", F.lit("?")))).where(wrong.isNotNull()).groupBy("valid_from", "_raw").agg(F.sort_array(F.collect_list("p")).alias("_rules"))
    whole = F.filter(
        F.array(
            F.when(F.size("_keys") == 0, "not_an_object"),
            F.when(F.coalesce(F.length(F.trim("version")), F.lit(0)) == 0, "version_missing"),
            F.when(F.array_contains("_keys", "max_text_length") & ~F.coalesce(F.col("max_text_length") >= 1, F.lit(False)), "max_text_length_below_one"),
            F.when(F.col("_sent").isNotNull() & ~F.coalesce(F.col("_sent").rlike(HEX64), F.lit(False)), "rule_hash_malformed"),
        ),
        lambda p: p.isNotNull(),
    )
    out = d.join(bad, ["valid_from", "_raw"], "left").withColumn("problems", F.concat(whole, F.coalesce("_rules", F.array().cast("array<string>"))))
    out = out.withColumn("max_text_length", F.coalesce("max_text_length", F.lit(DEFAULT_LENGTH))).withColumn("rule_hash", _hash(F.col("_raw")))
    # a few rows: documents, not data
    fine = F.when(F.size("problems") == 0, F.col("valid_from"))
    later = F.min(fine).over(Window.orderBy("valid_from").rangeBetween(1, Window.unboundedFollowing))
    return out.withColumn("valid_to", F.when(F.size("problems") == 0, later)).select("version", "valid_from", "valid_to", "rule_hash", "max_text_length", "package_blocklist", "rules", "problems")


def with_version(rows: DataFrame, versions: DataFrame, at: str, bucket: int) -> DataFrame:
    """The rows with rule_version, rule_hash and _rules, _blocklist, _max_length of the version that held at their time;
    rows from before the first version are left out. An equi-join on time buckets: versions are spread over the
    buckets in which they held, rows meet the one or two of their own."""
    last = rows.agg(F.max(at).alias("_last"))
    held = versions.where(F.size("problems") == 0).crossJoin(last).withColumn("_to", F.coalesce("valid_to", F.greatest("valid_from", F.coalesce("_last", "valid_from")) + 1))
    held = held.select(F.col("valid_from").alias("_from"), "_to", F.col("version").alias("rule_version"), "rule_hash", F.col("rules").alias("_rules"), F.col("package_blocklist").alias("_blocklist"), F.col("max_text_length").alias("_max_length"))
    return range_attach(held, rows, [], "_from", "_to", at, bucket).drop("_from", "_to")


def redacted(text: Column, rules: Column, max_length: Column, slots: int, target: str = "text") -> Column:
    """A text after the rules of its row: REDACT replaces, DROP empties what matches, ALLOW stops further rules from
    applying to it; then it is cut to the version's length. `slots` is the most rules that any version has."""
    out, allowed = text, F.lit(False)
    for i in range(slots):
        rule = F.get(rules, F.lit(i))
        own = F.coalesce(rule["target"] == target, F.lit(False)) & ~allowed
        hit = F.coalesce(F.rlike(out, rule["pattern"]), F.lit(False))
        fresh = F.when(own & (rule["action"] == "REDACT"), F.regexp_replace(out, rule["pattern"], F.coalesce(rule["replacement"], F.lit("")))).when(own & (rule["action"] == "DROP") & hit, F.lit("")).otherwise(out)
        allowed = allowed | (own & F.coalesce(rule["action"] == "ALLOW", F.lit(False)) & hit)
        out = fresh
    return F.left(out, max_length.cast("int"))


def most_rules(versions: DataFrame) -> int:
    """The most rules that any version has: one number of a small table."""
    return versions.agg(F.coalesce(F.max(F.size("rules")), F.lit(0)).alias("n")).first().n
