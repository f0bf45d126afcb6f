"""Queries over splits, pairing and audits (survey rows G, I and K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from .catalog import register
from .stream_queries import SESS, sessions

BUCKET = "('0x' || substr(sha256('{seed}:' || {key}), 1, 12))::BIGINT % 1000"


def fraction_sql(groups: str, key: str, val: float, test: float, within: str = "", name: str = "sp") -> str:
    """CTEs that assign `groups` (a query of distinct keys) to splits."""
    by = f"PARTITION BY {within}" if within else ""
    return f"""{name}0 AS (SELECT *, {BUCKET.format(seed=42, key=key)} AS b FROM ({groups})),
{name}1 AS (SELECT *, row_number() OVER ({by} ORDER BY b, {key}) AS i, count(*) OVER ({by}) AS n FROM {name}0),
{name}2 AS (SELECT *, greatest(1, round_even(n * {test}, 0)) AS nt, greatest(1, round_even(n * {val}, 0)) AS nv FROM {name}1),
{name}3 AS (SELECT * REPLACE (CASE WHEN nt + nv > n - 1 THEN greatest(0, n - 1 - nt) ELSE nv END AS nv, least(nt, n - 1) AS nt) FROM {name}2),
{name} AS (SELECT * EXCLUDE (b, i, n, nt, nv), CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN i = 1 THEN 'train' ELSE 'test' END WHEN i <= nt THEN 'test' WHEN i <= nt + nv THEN 'val' ELSE 'train' END AS split FROM {name}3)"""


SESSION_OUT = f"{SESS}, {fraction_sql('SELECT DISTINCT device, session_id FROM ss', 'session_id', 0.2, 0.2, 'device')}, so AS (SELECT ss.*, split FROM ss JOIN sp USING (device, session_id))"


def session_split(spark, sf_dir):
    return S.make_split(sessions(spark, sf_dir), "leave_session_out", user="device", session="session_id")


@register("split_session_out", "G2 G3 G4 G8 G9", f"WITH {SESSION_OUT} SELECT event_id, session_id, split FROM so")
def split_session_out(spark, sf_dir):
    return session_split(spark, sf_dir).select("event_id", "session_id", "split")


@register("split_day_out", "G5", f"""WITH {SESS}, d AS (SELECT DISTINCT device, day FROM ss), n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY day) AS i, count(*) OVER (PARTITION BY device) AS n FROM d)
SELECT event_id, CASE WHEN n = 1 THEN 'train' WHEN i = n THEN 'test' WHEN i = n - 1 AND n >= 3 THEN 'val' ELSE 'train' END AS split FROM ss JOIN n USING (device, day)""")
def split_day_out(spark, sf_dir):
    return S.make_split(sessions(spark, sf_dir), "leave_day_out", user="device", day="day").select("event_id", "split")


@register("split_app_out", "G6", f"WITH {SESS}, {fraction_sql('SELECT DISTINCT kind FROM ss', 'kind', 0.25, 0.25)} SELECT event_id, split FROM ss JOIN sp USING (kind)")
def split_app_out(spark, sf_dir):
    return S.make_split(sessions(spark, sf_dir), "leave_app_out", package="kind").select("event_id", "split")


@register("split_combined", "G7", f"""WITH {SESS}, {fraction_sql('SELECT DISTINCT kind FROM ss', 'kind', 0.2, 0.25)}, l AS (SELECT max(day) AS last FROM ss)
SELECT event_id, s AS split FROM (SELECT event_id, CASE WHEN day = last AND split = 'test' THEN 'test' WHEN day = last AND split = 'val' THEN 'val' WHEN day <> last AND split = 'train' THEN 'train' END AS s FROM ss JOIN sp USING (kind), l) WHERE s IS NOT NULL""")
def split_combined(spark, sf_dir):
    return S.make_split(sessions(spark, sf_dir), "combined", day="day", package="kind").select("event_id", "split")


def pairs_of(spark, sf_dir):
    rows = session_split(spark, sf_dir).withColumn("scene", F.col("kind")).withColumn("topk", F.array("kind", F.lit("view")))
    test = rows.where("split = 'test'")
    return rows, S.matched_impostors(test, test, "device", "event_id", "scene", "topk")


HASH = "('0x' || substr(sha256('42:' || {c}), 1, 13))::BIGINT"
#: The ring by plain search: for each genuine row the next row of another user, going round.
PAIRS = f"""{SESSION_OUT}, t AS (SELECT event_id, device, kind AS scene, {HASH.format(c='event_id')} AS h FROM so WHERE split = 'test'),
c AS (SELECT g.event_id AS genuine_row, p.event_id AS impostor_row, g.device AS genuine_user, p.device AS impostor_user, g.scene, CASE WHEN p.h > g.h OR p.h = g.h AND p.event_id <> g.event_id THEN p.h ELSE p.h + 4503599627370496 END AS d
 FROM t g JOIN t p ON g.scene = p.scene AND g.device <> p.device),
pr AS (SELECT genuine_row, impostor_row, genuine_user, impostor_user, scene, true AS matched_exact FROM c QUALIFY row_number() OVER (PARTITION BY genuine_row ORDER BY d, impostor_row) = 1)"""


@register("matched_impostors", "I1 I4", f"WITH {PAIRS} SELECT * FROM pr")
def matched_impostors(spark, sf_dir):
    return pairs_of(spark, sf_dir)[1]


@register("stretched_impostors", "I1 I4", f"WITH {PAIRS} SELECT * FROM pr")
def stretched_impostors(spark, sf_dir):
    test = session_split(spark, sf_dir).withColumn("scene", F.col("kind")).withColumn("topk", F.array("kind", F.lit("view"))).where("split = 'test'")
    return S.matched_impostors(test, test, "device", "event_id", "scene", "topk", parts=64)


@register("leakage_audit", "I5 K1", f"""WITH {PAIRS} SELECT (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT split) AS n FROM so GROUP BY session_id)) AS session_disjoint,
 (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT split) AS n FROM so GROUP BY event_id)) AS row_disjoint, (SELECT bool_and(genuine_user <> impostor_user) FROM pr) AS users_differ,
 (SELECT count(*) = 0 FROM pr WHERE impostor_row NOT IN (SELECT event_id FROM t)) AS impostors_from_test""")
def leakage_audit(spark, sf_dir):
    rows, pairs = pairs_of(spark, sf_dir)
    return S.leakage_audit(rows, pairs, "device", "session_id", "event_id")


@register("user_coverage", "K4", f"WITH {SESS}, {fraction_sql('SELECT DISTINCT kind FROM ss', 'kind', 0.25, 0.25)}, x AS (SELECT device, bool_or(split = 'test') AS tested, bool_or(split IN ('train', 'val')) AS enrolled FROM ss JOIN sp USING (kind) WHERE value > 96 GROUP BY device) SELECT * FROM x WHERE NOT tested OR NOT enrolled")
def user_coverage(spark, sf_dir):
    rows = S.make_split(sessions(spark, sf_dir), "leave_app_out", package="kind").where("value > 96")  # few rows a user, so that some lack a side
    return S.user_coverage(rows, "device")


@register("label_distribution", "K3", "WITH l AS (SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT ld.lang, q AS quality, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) ld CROSS JOIN (SELECT unnest([0, 1]) AS q) LEFT JOIN l ON l.lang IS NOT DISTINCT FROM ld.lang AND l.quality = q")
def label_distribution(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = docs.join(labels, "doc_id", "left").groupBy("lang").agg(*[F.count_if(F.col("quality") == q).alias(str(q)) for q in (0, 1)])
    return counts.select("lang", F.explode(F.array(*[F.struct(F.lit(q).alias("quality"), F.col(f"`{q}`").alias("n")) for q in (0, 1)])).alias("x")).select("lang", "x.quality", "x.n")


@register("weak_vs_gold_agreement", "K5", """WITH d AS (SELECT doc_id, (length(text) - length(regexp_replace(text, '[!#$%&*|]', '', 'g'))) * 20 < length(text) AS guess FROM documents)
SELECT count(*) AS n, round(avg((guess = (quality = 1))::INT), 6) AS agreement, count(*) FILTER (guess) AS n_good FROM d JOIN labels USING (doc_id)""")
def weak_vs_gold_agreement(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    guess = docs.select("doc_id", ((F.length("text") - F.length(F.translate("text", "!#$%&*|", ""))) * 20 < F.length("text")).alias("guess"))
    both = guess.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == (F.col("quality") == 1)).cast("int")), 6).alias("agreement"), F.count_if("guess").alias("n_good"))
