"""Audits of what is stored: forbidden content of screen nodes, where devices come from, what was trained too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the fields that may hold no text, and what may stand in for it.
TEXT_FIELDS, PLACEHOLDER = ["text", "text_redacted", "content_desc_redacted", "window_title_redacted"], "<EDITABLE_TEXT_DROPPED>"


def node_leaks(node: Column, fields: list[str]) -> Column:
    """Names of what a stored node holds and must not: a password mark, or any text but the placeholder. `fields` are the
    node's own; one that it does not have cannot leak."""
    texts = [F.when((F.coalesce(node[f], F.lit("")) != "") & (node[f] != PLACEHOLDER), f) for f in TEXT_FIELDS if f in fields]
    marks = [F.when(F.coalesce(node["password"], F.lit(False)), "password")] if "password" in fields else []
    return F.filter(F.array(*marks, *texts, F.lit(None).cast("string")), lambda x: x.isNotNull())


def privacy_audit(rows: DataFrame, key: str, nodes: str) -> DataFrame:
    """(key, n_nodes, n_bad, leaks, violated) of rows with arrays of nodes: what the stored data still holds against the
    red line, whatever ingest has let through. One projection and one aggregation; nothing is exploded."""
    node = rows.schema[nodes].dataType.elementType
    found = F.transform(F.coalesce(nodes, F.array().cast(rows.schema[nodes].dataType)), lambda n: node_leaks(n, node.names))
    per = rows.select(key, F.size(found).alias("_n"), F.size(F.filter(found, lambda x: F.size(x) > 0)).alias("_bad"), F.array_distinct(F.flatten(found)).alias("_leaks"))
    out = per.groupBy(key).agg(F.sum("_n").alias("n_nodes"), F.sum("_bad").alias("n_bad"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("_leaks")))).alias("leaks"))
    return out.withColumn("violated", F.col("n_bad") > 0)


def provenance(devices: DataFrame, generated: DataFrame, device: str) -> DataFrame:
    """One row: devices, how many of them a generator's set does not hold, and what follows: all of them held means the
    data are synthetic, none held that they are captured, anything else a mixture."""
    d, g = devices.select(device).where(F.col(device).isNotNull()).distinct(), generated.select(device).distinct()
    strange = d.join(g, device, "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    counted = d.agg(F.count(F.lit(1)).alias("n_devices")).crossJoin(strange)
    kind = F.when(F.col("n_devices") == 0, "unknown").when(F.col("n_unknown") == 0, "synthetic").when(F.col("n_unknown") == F.col("n_devices"), "captured").otherwise("mixed")
    return counted.withColumn("provenance", kind)


def under_trained(runs: DataFrame, epochs: str, most: int, stopped_early: str, share: float = 0.1) -> DataFrame:
    """The runs that ended after less than `share` of the epochs they had without an early stop: what a report warns of."""
    return runs.where(~F.coalesce(F.col(stopped_early), F.lit(False)) & (F.coalesce(F.col(epochs), F.lit(0)) < most * share))
