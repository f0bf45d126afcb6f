"""Quality classifier (operator 6): hierarchical empirical Bayes over documents, paths and hosts.

A naive Bayes classifier over binned text statistics gives every document a log likelihood ratio; its counts
come from all labelled documents by one grouped aggregation. Hosts and paths gather their documents' labels,
and where a label is missing the classifier's probability. A host's rate is shrunk toward the global rate, a
path's toward its host's, each with a strength that the method of moments finds in the spread of the rates,
so sparse sites stay near their parent. A document's quality is its path's posterior odds times its own
likelihood ratio.

Of two broadcast-sized things only numbers reach the driver: bin counts (bins, not documents) and two
shrinkage strengths. Documents and sites meet in ordinary joins; sites are aggregated before they move.

Defined results: a null or blank text has the statistics of an empty one; null hosts and paths are sites of
their own, named (none); several labels of one document count as their mean; without any labels the global
rate is a half and all evidence 0; a null key has no label; repeated rows repeat; an empty table gives an
empty one; columns other than those named are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text_stats import STATS_SQL, with_text_stats

#: name and bin number of each statistic, in SQL that Spark and DuckDB share.
BINS = [
    ("words", "CASE WHEN n_words < 5 THEN 0 WHEN n_words < 20 THEN 1 WHEN n_words < 100 THEN 2 WHEN n_words < 1000 THEN 3 ELSE 4 END"),
    ("word_size", "CASE WHEN word_chars < 3 * n_words THEN 0 WHEN word_chars < 5 * n_words THEN 1 WHEN word_chars < 8 * n_words THEN 2 WHEN word_chars < 11 * n_words THEN 3 ELSE 4 END"),
    ("symbols", "CASE WHEN n_symbols = 0 THEN 0 WHEN n_symbols * 50 < n_words THEN 1 WHEN n_symbols * 8 < n_words THEN 2 WHEN n_symbols < n_words THEN 3 ELSE 4 END"),
    ("exclaims", "CASE WHEN n_exclaim = 0 THEN 0 WHEN n_exclaim * 20 < n_words THEN 1 WHEN n_exclaim * 2 < n_words THEN 2 ELSE 3 END"),
    ("capitals", "CASE WHEN n_upper * 20 < word_chars THEN 0 WHEN n_upper * 5 < word_chars THEN 1 WHEN n_upper * 2 < word_chars THEN 2 ELSE 3 END"),
    ("repeats", "CASE WHEN n_repeat_words = 0 THEN 0 WHEN n_repeat_words * 10 < n_words THEN 1 WHEN n_repeat_words * 3 < n_words THEN 2 ELSE 3 END"),
    ("stutter", "CASE WHEN n_adjacent * 50 < n_words THEN 0 WHEN n_adjacent * 10 < n_words THEN 1 WHEN n_adjacent * 3 < n_words THEN 2 ELSE 3 END"),
    ("dup_lines", "CASE WHEN n_dup_lines = 0 THEN 0 WHEN n_dup_lines * 5 < n_lines THEN 1 ELSE 2 END"),
]
WIDTH = 5  # bins of a statistic, at most

#: Smoothing of bin counts; bounds of the shrinkage strengths; probability from which a document is kept.
SMOOTH, LEAST, MOST, THRESHOLD = 0.5, 1.0, 10_000.0, 0.5


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _evidence(rated: DataFrame) -> tuple[float, list[float]]:
    """(global rate, log likelihood ratio of every bin of every statistic) from the labelled rows."""
    named = rated.where("label IS NOT NULL")
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f"b{j}").alias("b")) for j in range(len(BINS))])).alias("x")
    counts = named.select("label", pairs).groupBy("x.f", "x.b").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    good, bad = (sum(r[k] for r in counts if r["f"] == 0) for k in ("good", "bad"))
    table = [0.0] * (len(BINS) * WIDTH)
    for r in counts:
        table[r["f"] * WIDTH + r["b"]] = math.log((r["good"] + SMOOTH) / (good + SMOOTH * WIDTH)) - math.log((r["bad"] + SMOOTH) / (bad + SMOOTH * WIDTH))
    return ((good + SMOOTH) / (good + bad + 2 * SMOOTH) if counts else 0.5), table


#: Strength of a level's prior from its members: n, rate and the parent's rate m, in SQL that Spark and DuckDB share.
STRENGTH = (
    "CASE WHEN sum(n * (rate - m) * (rate - m)) > sum(m * (1 - m)) "
    f"THEN greatest({LEAST}, least({MOST}, sum(n * m * (1 - m)) / nullif(sum(n * (rate - m) * (rate - m)) - sum(m * (1 - m)), 0) - 1)) ELSE {MOST} END"
)


def site_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str | Column = "source", path: str | Column = "lang", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, evidence, host_quality, path_quality, quality and kept of every document."""
    column = lambda c: F.coalesce((F.col(f"`{c}`") if isinstance(c, str) else c).cast("string"), F.lit("(none)"))
    named = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_x"), column(host).alias("_h"), column(path).alias("_p"))
    stats = with_text_stats(named, "_x", ["_k", "_h", "_p"]).select("_k", "_h", "_p", *[F.expr(e).alias(f"b{j}") for j, (_, e) in enumerate(BINS)])
    given = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_k")).agg(F.avg(F.col(f"`{label}`").cast("double")).alias("label"))
    rated = cut(stats.join(given, "_k", "left"))
    rate, table = _evidence(rated)
    bins = F.array(*[F.lit(x) for x in table])
    llr = F.lit(0.0)
    for j in range(len(BINS)):
        llr = llr + F.element_at(bins, F.col(f"b{j}") + (j * WIDTH + 1))
    rated = rated.select("_k", "_h", "_p", llr.alias("evidence"), "label")
    soft = F.coalesce("label", _sigmoid(F.lit(math.log(rate / (1 - rate))) + F.col("evidence")))
    paths = cut(rated.groupBy("_h", "_p").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(soft).alias("good")))
    hosts = paths.groupBy("_h").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("m", F.lit(rate))
    strength = hosts.withColumn("rate", F.col("good") / F.col("n")).agg(F.expr(STRENGTH)).first()[0]
    strength = MOST if strength is None else float(strength)
    hosts = cut(hosts.select("_h", ((F.col("good") + strength * F.col("m")) / (F.col("n") + strength)).alias("host_quality")))
    below = paths.join(hosts, "_h").withColumn("m", F.col("host_quality"))
    strength = below.withColumn("rate", F.col("good") / F.col("n")).agg(F.expr(STRENGTH)).first()[0]
    strength = MOST if strength is None else float(strength)
    sites = below.select("_h", "_p", "host_quality", ((F.col("good") + strength * F.col("m")) / (F.col("n") + strength)).alias("path_quality"))
    safe = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("path_quality")))
    quality = _sigmoid(_logit(safe) + F.col("evidence"))
    out = rated.join(sites, ["_h", "_p"])
    return out.select(F.col("_k").alias(key), F.col("_h").alias("host"), F.col("_p").alias("path"), "evidence", "host_quality", "path_quality", quality.alias("quality"), (quality >= threshold).alias("kept"))


def _oracle() -> str:
    w = WIDTH
    bins = ", ".join(f"({e}) AS b{j}" for j, (_, e) in enumerate(BINS))
    tall = " UNION ALL ".join(f"SELECT {j} AS f, b{j} AS b, label FROM rated WHERE label IS NOT NULL" for j in range(len(BINS)))
    llr = " + ".join(f"(SELECT coalesce(any_value(x), 0) FROM llr WHERE f = {j} AND b = b{j})" for j in range(len(BINS)))
    llr = " + ".join(f"coalesce(l{j}.x, 0)" for j in range(len(BINS)))
    joins = " ".join(f"LEFT JOIN llr l{j} ON l{j}.f = {j} AND l{j}.b = rated.b{j}" for j in range(len(BINS)))
    return f"""WITH src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents), {STATS_SQL},
given AS (SELECT doc_id, avg(quality::DOUBLE) AS label FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
rated AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS h, coalesce(lang, '(none)') AS p, label, {bins} FROM stats LEFT JOIN given USING (doc_id)),
tall AS ({tall}),
tot AS (SELECT sum(label) AS good, sum(1 - label) AS bad FROM tall WHERE f = 0),
g AS (SELECT coalesce((good + {SMOOTH}) / (good + bad + {2 * SMOOTH}), 0.5) AS rate FROM tot),
llr AS MATERIALIZED (SELECT f, b, ln((sum(label) + {SMOOTH}) / (any_value(good) + {SMOOTH * w})) - ln((sum(1 - label) + {SMOOTH}) / (any_value(bad) + {SMOOTH * w})) AS x FROM tall, tot GROUP BY f, b),
ev AS MATERIALIZED (SELECT doc_id, h, p, label, {llr} AS evidence FROM rated {joins}),
paths AS MATERIALIZED (SELECT h, p, count(*)::DOUBLE AS n, sum(coalesce(label, 1 / (1 + exp(-(ln(rate / (1 - rate)) + evidence))))) AS good FROM ev, g GROUP BY h, p),
hosts AS MATERIALIZED (SELECT h, sum(n) AS n, sum(good) AS good, any_value(rate) AS m, sum(good) / sum(n) AS rate FROM paths, g GROUP BY h),
k1 AS (SELECT {STRENGTH} AS k FROM hosts),
hq AS MATERIALIZED (SELECT h, (good + k * m) / (n + k) AS host_quality FROM hosts, k1),
below AS MATERIALIZED (SELECT paths.*, host_quality, host_quality AS m, good / n AS rate FROM paths JOIN hq USING (h)),
k2 AS (SELECT {STRENGTH} AS k FROM below),
sites AS (SELECT h, p, host_quality, (good + k * m) / (n + k) AS path_quality FROM below, k2),
out AS (SELECT doc_id, h AS host, p AS path, evidence, host_quality, path_quality,
 1 / (1 + exp(-(ln(greatest(1e-9, least(1 - 1e-9, path_quality)) / (1 - greatest(1e-9, least(1 - 1e-9, path_quality)))) + evidence))) AS quality FROM ev JOIN sites USING (h, p))
SELECT doc_id, host, path, round(evidence, 6) AS evidence, round(host_quality, 6) AS host_quality, round(path_quality, 6) AS path_quality, round(quality, 6) AS quality, quality >= {THRESHOLD} AS kept FROM out"""


ORACLE = _oracle()
