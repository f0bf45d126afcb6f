"""Queries over verification scores, detection, resampling and routing (survey rows E, M, T, R, N and O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import stable_bucket
from ..operators import verification as V
from .catalog import QUERIES, register
from .feature_queries import r, rounded
from .stream_queries import EV, SESS, sessions, stream


def vectors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("bigint").alias("owner"), "embedding", (stable_bucket("vec_id", 42, 1000) < 600).alias("enrolled"))


def protos(spark, sf_dir):
    return V.prototypes(vectors(spark, sf_dir).where("enrolled"), "owner", "embedding")


def scored(spark, sf_dir):
    """Every test vector against its own prototype and the next user's; scores on a grid of 0.001."""
    t = vectors(spark, sf_dir).where("NOT enrolled").withColumn("attacked", F.explode(F.array("owner", (F.col("owner") + 1) % 10)))
    return V.pair_scores(t, protos(spark, sf_dir), "owner", "embedding", "attacked").withColumn("score", F.round("score", 3) + F.lit(0.0))


PROTO = """v AS (SELECT vec_id, label::BIGINT AS owner, embedding::DOUBLE[] AS x, ('0x' || substr(sha256('42:' || vec_id), 1, 12))::BIGINT % 1000 < 600 AS enrolled FROM embeddings),
nv AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v), en AS (SELECT owner, unnest(list_transform(x, lambda a: a / n)) AS a, unnest(range(1, len(x) + 1)) AS i FROM nv WHERE enrolled),
mn AS (SELECT owner, i, avg(a) AS m FROM en GROUP BY owner, i), pq AS (SELECT owner, list(m ORDER BY i) AS m FROM mn GROUP BY owner),
pt AS (SELECT owner, list_transform(m, lambda a: a / sqrt(list_dot_product(m, m))) AS p FROM pq)"""
SCORES = f"""{PROTO}, atk AS (SELECT vec_id, owner, x, unnest([owner, (owner + 1) % 10]) AS attacked FROM v WHERE NOT enrolled),
sc AS (SELECT vec_id, atk.owner, attacked, round(list_dot_product(x, p) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(p, p))), 3) + 0.0 AS score, (attacked = atk.owner)::INT AS label FROM atk JOIN pt ON pt.owner = attacked)"""


def roc_sql(source: str, keys: str = "", weight: str = "1", name: str = "roc") -> str:
    k, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""{name}0 AS (SELECT {k}score, sum(label * {weight}) AS p, sum((1 - label) * {weight}) AS n FROM {source} GROUP BY {k}score),
{name} AS (SELECT {k}score, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({part}) AS pos, sum(n) OVER ({part}) AS neg,
 sum(n) OVER ({part} ORDER BY score DESC) / nullif(sum(n) OVER ({part}), 0) AS fpr, 1 - sum(p) OVER ({part} ORDER BY score DESC) / nullif(sum(p) OVER ({part}), 0) AS fnr FROM {name}0)"""


def eer_sql(keys: str = "", roc: str = "roc", name: str = "ee") -> str:
    k, part, group = (f"{keys}, ", f"PARTITION BY {keys}", f"GROUP BY {keys}") if keys else ("", "", "")
    return f"""{name}0 AS (SELECT {k}score, fpr AS x1, fnr AS y1, coalesce(lag(fpr) OVER ({part} ORDER BY score DESC), 0) AS x0, coalesce(lag(fnr) OVER ({part} ORDER BY score DESC), 1) AS y0 FROM {roc} WHERE pos > 0 AND neg > 0),
{name} AS (SELECT {k}max_by(CASE WHEN x1 = x0 THEN x0 ELSE (y0 * (x1 - x0) - x0 * (y1 - y0)) / ((x1 - x0) - (y1 - y0)) END, score) AS eer FROM {name}0 WHERE y1 <= x1 {group})"""


@register("prototypes_cosine", "E1 E2 E3 M11", f"WITH {SCORES} SELECT * FROM sc")
def prototypes_cosine(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "owner", "attacked", "score", "label")


@register("roc_curve", "M1", f"WITH {SCORES}, {roc_sql('sc')} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, {r('fpr')} AS fpr, {r('fnr')} AS fnr FROM roc")
def roc_curve(spark, sf_dir):
    return rounded(V.roc(scored(spark, sf_dir), "score", "label").select("score", "tp", "fp", "fpr", "fnr"), "fpr", "fnr")


@register("eer", "M2", f"WITH {SCORES}, {roc_sql('sc')}, {eer_sql()} SELECT {r('eer')} AS eer FROM ee")
def eer(spark, sf_dir):
    return rounded(V.eer(V.roc(scored(spark, sf_dir), "score", "label")), "eer")


@register("auc_ap", "M5 M6", f"""WITH {SCORES}, {roc_sql('sc')}, s AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0 FROM roc)
SELECT {r('sum((fp - fp0) * (tp + tp0) / 2.0) / max(pos * neg)')} AS auc, {r('sum((tp - tp0) * tp / (tp + fp)) / max(pos)')} AS ap FROM s""")
def auc_ap(spark, sf_dir):
    return rounded(V.auc_and_precision(V.roc(scored(spark, sf_dir), "score", "label")), "auc", "ap")


@register("operating_points", "M3 M4", f"""WITH {SCORES}, {roc_sql('sc')} SELECT {', '.join(f"{r(f'min(fnr) FILTER (fpr <= {b} + 1e-12)')} AS frr_at_far_{str(b).replace('.', '_')}, {r(f'min(fpr) FILTER (fnr <= {b} + 1e-12)')} AS far_at_frr_{str(b).replace('.', '_')}" for b in (0.01, 0.05, 0.1))} FROM roc""")
def operating_points(spark, sf_dir):
    out = V.operating_points(V.roc(scored(spark, sf_dir), "score", "label"), [0.01, 0.05, 0.1])
    return rounded(out, *out.columns)


@register("per_user_eer", "M7", f"WITH {SCORES}, {roc_sql('sc', 'attacked')}, {eer_sql('attacked')} SELECT attacked, {r('eer')} AS eer FROM ee")
def per_user_eer(spark, sf_dir):
    return rounded(V.eer(V.roc(scored(spark, sf_dir), "score", "label", ["attacked"]), ["attacked"]), "eer")


@register("per_scene_eer", "M7", f"WITH {SCORES}, s AS (SELECT *, vec_id % 5 AS scene FROM sc), {roc_sql('s', 'scene')}, {eer_sql('scene')} SELECT scene, {r('eer')} AS eer FROM ee")
def per_scene_eer(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("scene", F.col("vec_id") % 5)
    return rounded(V.eer(V.roc(s, "score", "label", ["scene"]), ["scene"]), "eer")


@register("far_frr_at_threshold", "M3", f"WITH {SCORES} SELECT round(count(*) FILTER (label = 0 AND score >= 0.5) / greatest(1, count(*) FILTER (label = 0)), 6) AS far, round(count(*) FILTER (label = 1 AND score < 0.5) / greatest(1, count(*) FILTER (label = 1)), 6) AS frr FROM sc")
def far_frr_at_threshold(spark, sf_dir):
    accepted = F.col("score") >= 0.5
    share = lambda c, of: F.round(F.count_if(c & of) / F.greatest(F.lit(1), F.count_if(of)), 6)
    return scored(spark, sf_dir).agg(share(accepted, F.col("label") == 0).alias("far"), share(~accepted, F.col("label") == 1).alias("frr"))


@register("k_of_n_detection", "T_1 T_2 T_4", f"WITH {EV} SELECT event_id, sum((value < 30)::INT) OVER (PARTITION BY device ORDER BY wall, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS alarm FROM ev")
def k_of_n_detection(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("reject", F.col("value") < 30)
    return V.k_of_n(e, ["device"], ["wall", "event_id"], "reject", 3, 5).select("event_id", "alarm")


@register("ewma_detection", "T_3 T_4", f"""WITH RECURSIVE {EV}, o AS (SELECT device, (value < 30)::INT::DOUBLE AS r, row_number() OVER (PARTITION BY device ORDER BY wall, event_id) - 1 AS i FROM ev),
e AS (SELECT device, i, 0.4::DOUBLE * r AS e FROM o WHERE i = 0 UNION ALL SELECT o.device, o.i, 0.4::DOUBLE * o.r + 0.6::DOUBLE * e.e FROM e JOIN o ON o.device = e.device AND o.i = e.i + 1)
SELECT device, count(*) AS n_rows, min(i) FILTER (e > 0.5) AS first_alarm, count(*) FILTER (e > 0.5) AS n_alarms FROM e GROUP BY device""")
def ewma_detection(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("reject", F.col("value") < 30)
    return V.ewma_alarms(e, ["device"], ["wall", "event_id"], "reject", 0.4)


@register("detection_metrics", "T_6 M8 M9", f"""WITH {EV}, a AS (SELECT *, device % 3 = 0 AS attack, row_number() OVER w - 1 AS i, sum((value < 30)::INT) OVER (PARTITION BY device ORDER BY wall, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS alarm FROM ev WINDOW w AS (PARTITION BY device ORDER BY wall, event_id)),
p AS (SELECT device, attack, count(*) AS n, min(i) FILTER (alarm) AS first, count(*) FILTER (alarm) AS alarms FROM a GROUP BY ALL)
SELECT {r('avg((first IS NOT NULL)::INT) FILTER (attack)')} AS detection_rate, {r('avg(coalesce(first, n) * 60.0) FILTER (attack)')} AS time_to_detect, {r('avg(alarms / (n * 60.0 / 3600.0)) FILTER (NOT attack)')} AS false_alarms_per_hour FROM p""")
def detection_metrics(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("reject", F.col("value") < 30).withColumn("attack", F.col("device") % 3 == 0)
    alarms = V.k_of_n(e, ["device"], ["wall", "event_id"], "reject", 2, 3)
    out = V.detection_metrics(alarms, ["device"], ["wall", "event_id"], "alarm", "attack", 60.0)
    return rounded(out, *out.columns)


GRID = [("raw", 1, 1), ("2-of-3", 2, 3), ("3-of-5", 3, 5)]


@register("policy_selection", "T_7", "WITH " + EV + ", " + ", ".join(
    f"""a{i} AS (SELECT device, device % 3 = 0 AS attack, row_number() OVER (PARTITION BY device ORDER BY wall, event_id) - 1 AS i, sum((value < 30)::INT) OVER (PARTITION BY device ORDER BY wall, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {k} AS alarm FROM ev),
p{i} AS (SELECT device, attack, count(*) AS n, min(i) FILTER (alarm) AS first, count(*) FILTER (alarm) AS alarms FROM a{i} GROUP BY ALL),
m{i} AS (SELECT {i} AS idx, '{name}' AS policy, round(avg(coalesce(first, n) * 60.0) FILTER (attack), 6) AS ttd, round(avg(alarms / (n * 60.0 / 3600.0)) FILTER (NOT attack), 6) AS fa FROM p{i})""" for i, (name, k, n) in enumerate(GRID))
    + " SELECT policy, ttd, fa FROM (" + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(GRID))) + ") ORDER BY fa > 10, ttd, idx LIMIT 1")
def policy_selection(spark, sf_dir):
    e = stream(spark, sf_dir).withColumn("reject", F.col("value") < 30).withColumn("attack", F.col("device") % 3 == 0)
    rows = None
    for i, (name, k, n) in enumerate(GRID):
        m = V.detection_metrics(V.k_of_n(e, ["device"], ["wall", "event_id"], "reject", k, n), ["device"], ["wall", "event_id"], "alarm", "attack", 60.0)
        one = m.select(F.lit(i).alias("idx"), F.lit(name).alias("policy"), F.round("time_to_detect", 6).alias("ttd"), F.round("false_alarms_per_hour", 6).alias("fa"))
        rows = one if rows is None else rows.union(one)
    best = rows.agg(F.min_by(F.struct("policy", "ttd", "fa"), F.struct((F.col("fa") > 10).alias("over"), "ttd", "idx")).alias("b"))
    return best.select("b.*")


@register("bootstrap_ci", "R1", f"""WITH {SCORES}, us AS (SELECT attacked, row_number() OVER (ORDER BY attacked) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT attacked FROM sc)),
dr AS (SELECT id % 200 AS replicate, ('0x' || substr(sha256('0:' || id), 1, 12))::BIGINT % (SELECT any_value(n) FROM us) AS i FROM range(200 * (SELECT any_value(n) FROM us)) t(id)),
tm AS (SELECT replicate, attacked, count(*) AS times FROM dr JOIN us USING (i) GROUP BY ALL), jw AS (SELECT replicate, score, label, times FROM sc JOIN tm USING (attacked)),
{roc_sql('jw', 'replicate', 'times', 'rb')}, {eer_sql('replicate', 'rb', 'eb')}, {roc_sql('sc')}, {eer_sql()}
SELECT (SELECT {r('eer')} FROM ee) AS point, {r('quantile_cont(eer, 0.025)')} AS low, {r('quantile_cont(eer, 0.975)')} AS high, count(*) AS n_replicates FROM eb""")
def bootstrap_ci(spark, sf_dir):
    out = V.bootstrap_eer(scored(spark, sf_dir), "attacked", 200, 0)
    return rounded(out, "point", "low", "high")


@register("bootstrap_ci_1000", "R1 R2", QUERIES["bootstrap_ci"].sql.replace("200", "1000"))
def bootstrap_ci_1000(spark, sf_dir):
    return rounded(V.bootstrap_eer(scored(spark, sf_dir), "attacked", 1000, 0), "point", "low", "high")


@register("by_user_ci", "R4", f"""WITH {SCORES}, {roc_sql('sc', 'attacked')}, {eer_sql('attacked')}, us AS (SELECT eer, row_number() OVER (ORDER BY attacked) - 1 AS i, count(*) OVER () AS n FROM ee WHERE isfinite(eer)),
dr AS (SELECT id % 1000 AS replicate, ('0x' || substr(sha256('0:' || id), 1, 12))::BIGINT % (SELECT any_value(n) FROM us) AS i FROM range(1000 * (SELECT any_value(n) FROM us)) t(id)),
ms AS (SELECT replicate, avg(eer) AS m FROM dr JOIN us USING (i) GROUP BY replicate)
SELECT (SELECT {r('avg(eer)')} FROM us) AS mean, {r('quantile_cont(m, 0.025)')} AS low, {r('quantile_cont(m, 0.975)')} AS high, count(*) AS n_replicates FROM ms""")
def by_user_ci(spark, sf_dir):
    per = V.eer(V.roc(scored(spark, sf_dir), "score", "label", ["attacked"]), ["attacked"])
    return rounded(V.bootstrap_mean(per, "attacked", "eer", 1000, 0), "mean", "low", "high")


@register("roc_points", "M12", f"""WITH {SCORES}, {roc_sql('sc')}, b AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf FROM roc WHERE pos > 0 AND neg > 0 WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT fpr, 1 - fnr AS tpr, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM b WHERE coalesce(bt <> 0 OR bf <> 0, true)),
vx AS (SELECT k, n, fpr, tpr FROM k WHERE n > 1 UNION ALL SELECT 0, n, 0, 0 FROM k WHERE k = 1 AND n > 1)
SELECT p AS point, {r('fpr')} AS fpr, {r('tpr')} AS tpr FROM (SELECT *, CASE WHEN n < 512 THEN k ELSE round_even(k / (n / 511), 0) END::BIGINT AS p FROM vx) WHERE n < 512 OR round_even(p * (n / 511), 0) = k""")
def roc_points(spark, sf_dir):
    return rounded(V.roc_points(V.roc(scored(spark, sf_dir), "score", "label")), "fpr", "tpr")


@register("holm_adjust", "R5", "WITH p AS (SELECT p_brand, avg(p_size) / 5000.0 AS p FROM part GROUP BY p_brand), k AS (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS r, count(*) OVER () AS m FROM p) SELECT p_brand, round(p, 8) AS p, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY p, p_brand ROWS UNBOUNDED PRECEDING), 6) AS p_adjusted FROM k")
def holm_adjust(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg((F.avg("p_size") / 5000.0).alias("p"))
    return V.holm(p, "p").select("p_brand", F.round("p", 8).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"))


@register("paired_delta", "R7", """WITH y AS (SELECT o_custkey, avg(o_totalprice) FILTER (year(o_orderdate) % 2 = 0) AS a, avg(o_totalprice) FILTER (year(o_orderdate) % 2 = 1) AS b FROM orders GROUP BY o_custkey), d AS (SELECT b - a AS d FROM y WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round(avg(d), 4) AS mean_delta, round(avg(d) / stddev_samp(d), 6) AS cohens_d, round(avg((d > 0)::INT), 6) AS win_rate FROM d""")
def paired_delta(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    even = F.year("o_orderdate") % 2 == 0
    y = o.groupBy("o_custkey").agg(F.avg(F.when(even, F.col("o_totalprice"))).alias("a"), F.avg(F.when(~even, F.col("o_totalprice"))).alias("b"))
    out = V.paired_delta(y.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a")), "d")
    return out.select("n", F.round("mean_delta", 4).alias("mean_delta"), F.round("cohens_d", 6).alias("cohens_d"), F.round("win_rate", 6).alias("win_rate"))


GATE = """g0 AS (SELECT vec_id, label, embedding[1:7]::DOUBLE[] AS l FROM embeddings), g1 AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM g0),
g2 AS (SELECT *, list_reverse_sort(list_transform(range(1, 8), lambda i: {'x': e[i], 'i': i}))[1:2] AS t FROM g1),
g3 AS (SELECT vec_id, label, e, list_transform(t, lambda x: x.i) AS c, greatest(1e-12, list_sum(list_transform(t, lambda x: x.x))) AS s FROM g2),
gt AS (SELECT vec_id, label, list_transform(range(1, 8), lambda i: CASE WHEN list_contains(c, i) THEN e[i] / s ELSE 0 END) AS gate FROM g3)"""


def gates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", V.topk_gate(F.slice("embedding", 1, 7), 2).alias("gate"))


@register("gate_topk_renorm", "N3", f"WITH {GATE} SELECT vec_id, {', '.join(f'round(gate[{i + 1}], 6) AS g{i}' for i in range(7))} FROM gt")
def gate_topk_renorm(spark, sf_dir):
    return gates(spark, sf_dir).select("vec_id", *[F.round(F.col("gate")[i], 6).alias(f"g{i}") for i in range(7)])


@register("router_utilisation", "E5", f"WITH {GATE}, u AS (SELECT label, unnest(gate) AS g, unnest(range(0, 7)) AS expert FROM gt) SELECT label, expert, round(avg(g), 6) AS mean_gate, round(avg((g > 0)::INT), 6) AS active FROM u GROUP BY label, expert")
def router_utilisation(spark, sf_dir):
    u = gates(spark, sf_dir).select("label", F.posexplode("gate").alias("expert", "g"))
    return u.groupBy("label", F.col("expert").cast("bigint").alias("expert")).agg(F.round(F.avg("g"), 6).alias("mean_gate"), F.round(F.avg((F.col("g") > 0).cast("int")), 6).alias("active"))


@register("routers", "N5 N7", f"WITH {GATE} SELECT vec_id, array_to_string(list_transform(range(0, 7), lambda i: CASE WHEN i = vec_id % 7 THEN 10 ELSE 0 END), ',') AS hashed, round(list_sum(list_transform(gate, lambda p: ln(greatest(p, 1e-8)))), 5) AS fixed_sum FROM gt")
def routers(spark, sf_dir):
    g = gates(spark, sf_dir)
    hashed = F.array_join(F.transform(V.hash_router(F.col("vec_id"), 7), lambda x: x.cast("int").cast("string")), ",")
    return g.select("vec_id", hashed.alias("hashed"), F.round(F.aggregate(V.fixed_router(F.col("gate")), F.lit(0.0), lambda s, x: s + x), 5).alias("fixed_sum"))


@register("kl_balance_smooth", "N12 N13 N14", f"""WITH {GATE}, k AS (SELECT vec_id, gate, lead(gate) OVER (PARTITION BY label ORDER BY vec_id) AS nxt, label FROM gt),
kl AS (SELECT list_sum(list_transform(range(1, 8), lambda i: (1.0 / 7) * (ln(1.0 / 7) - ln(greatest(gate[i], 1e-8))))) AS kl, CASE WHEN label % 2 = 0 THEN 0.8 ELSE 0.3 END AS w,
 list_sum(list_transform(range(1, 8), lambda i: (gate[i] - nxt[i]) * (gate[i] - nxt[i]))) AS jump FROM k),
m AS (SELECT expert, avg(g) AS m FROM (SELECT unnest(gate) AS g, unnest(range(0, 7)) AS expert FROM gt) GROUP BY expert)
SELECT {r('sum(kl * w) / greatest(sum(w), 1e-8)')} AS kl, (SELECT {r('7 * sum((m - 1.0 / 7) * (m - 1.0 / 7))')} FROM m) AS balance, {r('avg(jump)')} AS smoothness FROM kl""")
def kl_balance_smooth(spark, sf_dir):
    from pyspark.sql import Window

    g = gates(spark, sf_dir).withColumn("nxt", F.lead("gate").over(Window.partitionBy("label").orderBy("vec_id")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    uniform = F.lit(1.0 / 7)
    kl = add(F.transform("gate", lambda p: uniform * (F.ln(uniform) - F.ln(F.greatest(p, F.lit(1e-8))))))
    w = F.when(F.col("label") % 2 == 0, 0.8).otherwise(0.3)
    jump = F.when(F.col("nxt").isNotNull(), add(F.zip_with("gate", "nxt", lambda a, b: (a - b) * (a - b))))
    means = [F.avg(F.col("gate")[i]) for i in range(7)]
    balance = sum(((m - 1.0 / 7) * (m - 1.0 / 7) for m in means), F.lit(0.0)) * 7
    out = g.select("gate", kl.alias("kl"), w.alias("w"), jump.alias("jump")).agg((F.sum(F.col("kl") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("kl"), balance.alias("balance"), F.avg("jump").alias("smoothness"))
    return rounded(out, "kl", "balance", "smoothness")


@register("pareto_frontier", "O2", "WITH b AS (SELECT p_brand, p_size, p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM part) SELECT p_brand, p_size, p_partkey, p_retailprice FROM b WHERE best IS NULL OR p_retailprice < best - 1e-9")
def pareto_frontier(spark, sf_dir):
    return V.pareto(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "p_size", "p_partkey", "p_retailprice")
