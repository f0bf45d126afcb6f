"""Queries over thresholds, streams, paired tests, routers, losses, audits and batch documents (survey rows M, T, R, N, K, V, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import stable_bucket
from ..operators import ingest as I
from ..operators import splits as S
from ..operators import studies as D
from ..operators import verification as V
from ..sources.batches import BATCH
from .catalog import register
from .feature_queries import r, rounded
from .split_queries import HASH, PAIRS, SESSION_OUT, pairs_of, session_split
from .verification_queries import GATE, SCORES, eer_sql, gates, roc_sql, scored

# equal error rate and the threshold on the same line
THRESHOLD = """etb AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf, row_number() OVER w AS place FROM roc WINDOW w AS (ORDER BY score DESC)),
etk AS (SELECT * FROM etb WHERE CASE WHEN place = 1 THEN lead_differs ELSE coalesce(bt <> 0 OR bf <> 0, true) END),
et0 AS (SELECT score, fpr AS x1, fnr AS y1, lag(fpr) OVER (ORDER BY score DESC) AS px, lag(fnr) OVER (ORDER BY score DESC) AS py, lag(score) OVER (ORDER BY score DESC) AS pt FROM etk),
et1 AS (SELECT score, x1, y1, coalesce(px, 0) AS x0, coalesce(py, 1) AS y0, coalesce(pt, 'Infinity'::DOUBLE) AS t0 FROM et0 WHERE y1 <= x1 QUALIFY row_number() OVER (ORDER BY score DESC) = 1),
et2 AS (SELECT *, CASE WHEN x1 = x0 THEN x0 ELSE (y0 * (x1 - x0) - x0 * (y1 - y0)) / ((x1 - x0) - (y1 - y0)) END AS eer FROM et1),
et AS (SELECT eer, CASE WHEN x1 = x0 THEN t0 ELSE t0 + (eer - x0) * ((score - t0) / (x1 - x0)) END AS threshold FROM et2)"""
# the first vertex follows the origin: it is on a stretch with the next if both steps are the same
THRESHOLD = THRESHOLD.replace("lead_differs", "coalesce(bt0 <> 0 OR bf0 <> 0, true)").replace("row_number() OVER w AS place", "lead(tp) OVER w - 2 * tp AS bt0, lead(fp) OVER w - 2 * fp AS bf0, row_number() OVER w AS place")


@register("eer_threshold", "M2", f"WITH {SCORES}, {roc_sql('sc')}, {THRESHOLD} SELECT {r('eer')} AS eer, {r('threshold')} AS threshold FROM et")
def eer_threshold(spark, sf_dir):
    return rounded(D.eer_threshold(V.roc(scored(spark, sf_dir), "score", "label")), "eer", "threshold")


@register("metrics_payload", "M10", f"""WITH {SCORES}, {roc_sql('sc')}, {THRESHOLD}, s AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0 FROM roc),
a AS (SELECT sum((fp - fp0) * (tp + tp0) / 2.0) / max(pos * neg) AS auc, sum((tp - tp0) * tp / (tp + fp)) / max(pos) AS ap FROM s),
o AS (SELECT min(fnr) FILTER (fpr <= 0.05 + 1e-12) AS frr_at_far_0_05 FROM roc),
f AS (SELECT count(*) FILTER (label = 0 AND score >= threshold) / greatest(1, count(*) FILTER (label = 0)) AS far, count(*) FILTER (label = 1 AND score < threshold) / greatest(1, count(*) FILTER (label = 1)) AS frr, count(*) AS n_scores FROM sc, et)
SELECT {', '.join(f"{r(c)} AS {c}" for c in ('eer', 'threshold', 'auc', 'ap', 'frr_at_far_0_05', 'far', 'frr'))}, n_scores FROM et, a, o, f""")
def metrics_payload(spark, sf_dir):
    names = ["eer", "threshold", "auc", "ap", "frr_at_far_0_05", "far", "frr"]
    return rounded(D.metrics_payload(scored(spark, sf_dir)).select(*names, "n_scores"), *names)


def pair_frame(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("session", F.col("vec_id") % 3).withColumn("row", F.concat(F.lit("w:"), F.col("vec_id").cast("string")))


STREAMS = f"""{SCORES}, st AS (SELECT CASE WHEN label = 0 THEN 'a|' || attacked || '|' || owner ELSE 'g|' || attacked || '|' || (vec_id % 3) END AS stream, label = 0 AS attack, score,
 row_number() OVER (PARTITION BY label, attacked, CASE WHEN label = 0 THEN owner ELSE vec_id % 3 END ORDER BY CASE WHEN label = 0 THEN vec_id % 3 ELSE 0 END, vec_id, score) - 1 AS "at" FROM sc)"""


@register("score_streams", "T_5", f'WITH {STREAMS} SELECT stream, attack, "at", score FROM st')
def score_streams(spark, sf_dir):
    return D.score_streams(pair_frame(spark, sf_dir)).select("stream", "attack", F.col("at").cast("bigint").alias("at"), "score")


def _policies_sql(threshold: float, stride: float) -> str:
    parts, unions = [], []
    for i, (name, kind, p) in enumerate(D.GRID):
        if kind == "ewma":
            parts.append(f"w{i} AS (SELECT stream, attack, k, {p['alpha']}::DOUBLE * r AS e FROM o WHERE k = 0 UNION ALL SELECT o.stream, o.attack, o.k, {p['alpha']}::DOUBLE * o.r + {1 - p['alpha']}::DOUBLE * w{i}.e FROM w{i} JOIN o ON o.stream = w{i}.stream AND o.k = w{i}.k + 1), d{i} AS (SELECT stream, attack, k, e > 0.5 AS alarm FROM w{i})")
        else:
            parts.append(f"d{i} AS (SELECT stream, attack, k, sum(r) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN {p.get('n', 1) - 1} PRECEDING AND CURRENT ROW) >= {p.get('k', 1)} AS alarm FROM o)")
        parts.append(f"p{i} AS (SELECT stream, attack, count(*) AS n, min(k) FILTER (alarm) AS first, count(*) FILTER (alarm) AS alarms FROM d{i} GROUP BY ALL)")
        unions.append(f"SELECT '{name}' AS policy, {i} AS idx, avg((first IS NOT NULL)::INT) FILTER (attack) AS detection_rate, avg(coalesce(first, n) * {stride}) FILTER (attack) AS time_to_detect, avg(alarms / (n * {stride} / 3600.0)) FILTER (NOT attack) AS false_alarms_per_hour FROM p{i}")
    return f'o AS (SELECT stream, attack, "at" AS k, (score < {threshold})::INT AS r FROM st), ' + ", ".join(parts) + ", pm AS (" + " UNION ALL ".join(unions) + ")"


POLICY_COLUMNS = ["detection_rate", "time_to_detect", "false_alarms_per_hour"]


@register("policy_metrics", "T_3 T_6", f"WITH RECURSIVE {STREAMS}, {_policies_sql(0.4, 2.0)} SELECT policy, idx, {', '.join(f'{r(c)} AS {c}' for c in POLICY_COLUMNS)} FROM pm")
def policy_metrics(spark, sf_dir):
    return rounded(D.policy_metrics(D.score_streams(pair_frame(spark, sf_dir)), 0.4, 2.0), *POLICY_COLUMNS)


@register("policy_choice", "T_7", f"WITH RECURSIVE {STREAMS}, {_policies_sql(0.4, 2.0)} SELECT policy, idx, {', '.join(f'{r(c)} AS {c}' for c in POLICY_COLUMNS)} FROM pm ORDER BY coalesce(false_alarms_per_hour > 300, false), time_to_detect, idx LIMIT 1")
def policy_choice(spark, sf_dir):
    metrics = D.policy_metrics(D.score_streams(pair_frame(spark, sf_dir)), 0.4, 2.0)
    return rounded(D.select_policy(metrics, 300.0), *POLICY_COLUMNS)


@register("pooled_delta", "R3", f"""WITH {SCORES}, sb AS (SELECT attacked, label, round(score - 0.05 * (vec_id % 3), 3) + 0.0 AS score FROM sc), us AS (SELECT attacked, row_number() OVER (ORDER BY attacked) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT attacked FROM sc)),
dr AS (SELECT id % 200 AS replicate, ('0x' || substr(sha256('0:' || id), 1, 12))::BIGINT % (SELECT any_value(n) FROM us) AS i FROM range(200 * (SELECT any_value(n) FROM us)) t(id)),
tm AS (SELECT replicate, attacked, count(*) AS times FROM dr JOIN us USING (i) GROUP BY ALL), ja AS (SELECT replicate, score, label, times FROM sc JOIN tm USING (attacked)), jb AS (SELECT replicate, score, label, times FROM sb JOIN tm USING (attacked)),
{roc_sql('ja', 'replicate', 'times', 'ra')}, {eer_sql('replicate', 'ra', 'ea')}, {roc_sql('jb', 'replicate', 'times', 'rb')}, {eer_sql('replicate', 'rb', 'eb')}, d AS (SELECT eb.eer - ea.eer AS d FROM ea JOIN eb USING (replicate))
SELECT {r('avg(d)')} AS delta_mean, {r('quantile_cont(d, 0.025)')} AS low, {r('quantile_cont(d, 0.975)')} AS high, count(d) AS n_effective, (SELECT any_value(n) FROM us) AS n_shared FROM d""")
def pooled_delta(spark, sf_dir):
    a = scored(spark, sf_dir)
    b = a.withColumn("score", F.round(F.col("score") - 0.05 * (F.col("vec_id") % 3), 3) + F.lit(0.0))
    return rounded(D.pooled_delta(a, b, "attacked", 200, 0), "delta_mean", "low", "high")


YEARS = """y AS (SELECT o_custkey, avg(o_totalprice) FILTER (year(o_orderdate) % 2 = 0) AS a, avg(o_totalprice) FILTER (year(o_orderdate) % 2 = 1) AS b FROM orders GROUP BY o_custkey),
d AS (SELECT o_custkey, 'g' || (o_custkey % 4) AS config, round(b - a, 2) AS d FROM y WHERE a IS NOT NULL AND b IS NOT NULL)"""


def yearly(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    even = F.year("o_orderdate") % 2 == 0
    y = o.groupBy("o_custkey").agg(F.avg(F.when(even, F.col("o_totalprice"))).alias("a"), F.avg(F.when(~even, F.col("o_totalprice"))).alias("b"))
    return y.where("a IS NOT NULL AND b IS NOT NULL").select("o_custkey", F.concat(F.lit("g"), (F.col("o_custkey") % 4).cast("string")).alias("config"), F.round(F.col("b") - F.col("a"), 2).alias("d"))


@register("sign_flip_p", "R6", f"""WITH {YEARS}, few AS (SELECT * FROM d WHERE o_custkey < 400), f AS (SELECT b, config, round(sum(CASE WHEN b = 0 OR ('0x' || substr(sha256('0:' || b || ':' || o_custkey), 1, 12))::BIGINT % 2 = 0 THEN d ELSE -d END), 9) AS s
 FROM few, range(0, 201) t(b) GROUP BY ALL) SELECT f.config, round((count(*) FILTER (f.b > 0 AND f.s >= z.s) + 1) / 201.0, 6) AS p_perm FROM f JOIN (SELECT config, s FROM f WHERE b = 0) z USING (config) GROUP BY f.config""")
def sign_flip_p(spark, sf_dir):
    out = D.sign_flip_p(yearly(spark, sf_dir).where("o_custkey < 400"), "o_custkey", "d", 200, 0, ["config"])
    return out.select("config", F.round("p_perm", 6).alias("p_perm"))


_SIGN = "least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2)))))"


@register("paired_tests", "R8", f"""WITH {YEARS}, k AS (SELECT config, d, rank() OVER (PARTITION BY config ORDER BY abs(d)) + (count(*) OVER (PARTITION BY config, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
t AS (SELECT config, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, sum(rk) FILTER (d > 0) AS rank_sum FROM k GROUP BY config)
SELECT config, (SELECT count(*) FROM d WHERE d.config = t.config) AS n_pairs, wins, losses, round(rank_sum, 3) AS rank_sum, round({_SIGN}, 6) AS p_sign FROM t""")
def paired_tests(spark, sf_dir):
    out = D.paired_tests(yearly(spark, sf_dir), "d", ["config"])
    return out.select("config", "n_pairs", "wins", "losses", F.round("rank_sum", 3).alias("rank_sum"), F.round("p_sign", 6).alias("p_sign"))


@register("baseline_table", "R9 R5 R7", f"""WITH {SCORES}, cf AS (SELECT 'm' || c AS config, attacked, label, round(score - 0.02 * c * (vec_id % 3), 3) + 0.0 AS score FROM sc, range(0, 4) t(c)), {roc_sql('cf', 'config, attacked')}, {eer_sql('config, attacked')},
d AS (SELECT x.config, x.eer - o.eer AS d FROM ee x JOIN ee o USING (attacked) WHERE o.config = 'm0' AND x.config <> 'm0')
SELECT config, count(*) AS n_pairs, {r('avg(d)')} AS mean_delta, CASE WHEN count(d) >= 2 AND stddev_samp(d) >= 1e-12 THEN {r('avg(d) / stddev_samp(d)')} ELSE 0 END AS cohens_d, {r('avg((d > 0)::INT)')} AS win_rate FROM d GROUP BY config""")
def baseline_table(spark, sf_dir):
    c = scored(spark, sf_dir).withColumn("c", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    c = c.select(F.concat(F.lit("m"), F.col("c").cast("string")).alias("config"), "attacked", "label", (F.round(F.col("score") - 0.02 * F.col("c") * (F.col("vec_id") % 3), 3) + F.lit(0.0)).alias("score"))
    rates = V.eer(V.roc(c, "score", "label", ["config", "attacked"]), ["config", "attacked"]).withColumnRenamed("attacked", "user")
    return rounded(D.delta_table(rates, "m0").select("config", "n_pairs", "mean_delta", "cohens_d", "win_rate"), "mean_delta", "cohens_d", "win_rate")


@register("random_router", "N6 N8", "SELECT vec_id, " + ", ".join(f"round(('0x' || substr(sha256('42:' || (vec_id % 8192) || ':' || {i}), 1, 12))::BIGINT / 281474976710656.0, 9) AS l{i}" for i in range(7)) + " FROM embeddings")
def random_router(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", D.build_router("random", row=F.col("vec_id")).alias("l"))
    return e.select("vec_id", *[F.round(F.col("l")[i], 9).alias(f"l{i}") for i in range(7)])


@register("learned_router", "N4 N8", "SELECT vec_id, " + ", ".join(f"round(list_dot_product(embedding[1:4]::DOUBLE[], [{', '.join(str((i * 3 + j) % 5 - 2.0) for j in range(4))}]) + {i}.5, 5) AS l{i}" for i in range(7)) + " FROM embeddings")
def learned_router(spark, sf_dir):
    weights = [[(i * 3 + j) % 5 - 2.0 for j in range(4)] for i in range(7)]
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", D.build_router("learned", features=F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")), weights=weights, bias=[i + 0.5 for i in range(7)]).alias("l"))
    return e.select("vec_id", *[F.round(F.col("l")[i], 5).alias(f"l{i}") for i in range(7)])


@register("auth_losses", "N11 N15", f"""WITH v AS (SELECT vec_id, vec_id // 32 AS batch, label, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT *, list_transform(x, lambda a: a / sqrt(list_dot_product(x, x))) AS u FROM v),
e AS (SELECT batch, label, unnest(u) AS a, unnest(range(1, len(u) + 1)) AS i FROM n), m AS (SELECT batch, label, i, avg(a) AS m FROM e GROUP BY ALL), q AS (SELECT batch, label, list(m ORDER BY i) AS m FROM m GROUP BY ALL),
g AS (SELECT n.batch, n.label, avg(1 - list_dot_product(u, m) / sqrt(list_dot_product(m, m))) AS g FROM n JOIN q USING (batch, label) GROUP BY ALL), pl AS (SELECT batch, avg(g) AS proto FROM g GROUP BY batch),
ce AS (SELECT batch, avg(ln(list_sum(list_transform(x[1:10], lambda a: exp(a - list_max(x[1:10]))))) + list_max(x[1:10]) - x[label + 1]) AS ce FROM v GROUP BY batch),
ds AS (SELECT a.batch, a.vec_id, max(list_distance(a.u, b.u)) FILTER (a.label = b.label AND a.vec_id <> b.vec_id) AS f, min(list_distance(a.u, b.u)) FILTER (a.label <> b.label) AS n FROM n a JOIN n b USING (batch) GROUP BY ALL),
tr AS (SELECT batch, avg(greatest(0, f - n + 0.3)) AS triplet FROM ds WHERE f IS NOT NULL AND n IS NOT NULL GROUP BY batch)
SELECT batch, {r('ce')} AS ce, {r('proto')} AS proto, {r('triplet')} AS triplet, {r('ce + 0.5 * proto')} AS total FROM ce JOIN pl USING (batch) LEFT JOIN tr USING (batch)""")
def auth_losses(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 32).alias("batch"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    ce = e.groupBy("batch").agg(F.avg(D.cross_entropy(F.slice("x", 1, 10), F.col("label"))).alias("ce"))
    out = ce.join(D.prototype_loss(e, ["batch"], "label", "x"), "batch").join(D.triplet_loss(e, ["batch"], "label", "x"), "batch", "left").withColumnsRenamed({"proto_loss": "proto", "triplet_loss": "triplet"})
    out = D.total_loss(out.withColumn("auth", F.col("ce") + 0.5 * F.col("proto")).withColumns({"kl": F.lit(0.0), "balance": F.lit(0.0), "smooth": F.lit(None).cast("double")}))
    return rounded(out.select("batch", "ce", "proto", "triplet", "total"), "ce", "proto", "triplet", "total")


@register("router_losses", "N12 N13 N14", f"""WITH {GATE}, k AS (SELECT vec_id, gate, lead(gate) OVER (PARTITION BY label ORDER BY vec_id) AS nxt, CASE WHEN label % 2 = 0 THEN 0.8 ELSE 0.3 END AS w FROM gt),
kl AS (SELECT w, list_sum(list_transform(range(1, 8), lambda i: (1.0 / 7) * (ln(1.0 / 7) - ln(greatest(gate[i], 1e-8))))) AS kl, list_sum(list_transform(range(1, 8), lambda i: (gate[i] - nxt[i]) * (gate[i] - nxt[i]))) AS jump FROM k),
m AS (SELECT expert, avg(g) AS m FROM (SELECT unnest(gate) AS g, unnest(range(0, 7)) AS expert FROM gt) GROUP BY expert)
SELECT {r('sum(kl * w) FILTER (w >= 0.5) / greatest(sum(w) FILTER (w >= 0.5), 1e-8)')} AS kl, (SELECT {r('7 * sum((m - 1.0 / 7) * (m - 1.0 / 7))')} FROM m) AS balance, {r('avg(jump)')} AS smoothness FROM kl""")
def router_losses(spark, sf_dir):
    g = gates(spark, sf_dir)
    even = F.array(*[F.lit(1.0 / 7)] * 7)
    logs = F.transform("gate", lambda p: F.ln(F.greatest(p, F.lit(1e-8))))
    sums = g.agg(D.kl_weak(logs, even, F.when(F.col("label") % 2 == 0, 0.8).otherwise(0.3), 0.5).alias("kl"), D.load_balance(F.col("gate")).alias("balance"))
    return rounded(sums.join(F.broadcast(D.temporal_smoothness(g, "gate", ["label"], ["vec_id"]))), "kl", "balance", "smoothness")


@register("decoded_topk", "I3", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang || ',' || source, coalesce(lang, source, '')) END AS topk FROM documents")
def decoded_topk(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    broken = F.when(F.col("doc_id") % 6 == 0, "no list").when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
    text = F.when(F.col("doc_id") % 3 == 0, broken).otherwise(F.to_json(F.array_compact(F.array("lang", "source"))))
    return d.select("doc_id", F.array_join(D.decoded_topk(text), ",").alias("topk"))


@register("impostors_of_three", "I1", f"""WITH {PAIRS.replace('= 1)', '<= 3)')} SELECT genuine_row, impostor_row, genuine_user, impostor_user, scene FROM pr""")
def impostors_of_three(spark, sf_dir):
    test = session_split(spark, sf_dir).withColumn("scene", F.col("kind")).withColumn("topk", F.array("kind")).where("split = 'test'")
    return S.matched_impostors(test, test, "device", "event_id", "scene", "topk", 3).select("genuine_row", "impostor_row", "genuine_user", "impostor_user", "scene")


@register("relaxed_impostors", "I1", f"""WITH {SESSION_OUT}, t AS (SELECT event_id, device, CASE WHEN device % 5 = 0 THEN 'only' || device ELSE kind END AS scene, ['any'] || CASE WHEN device % 5 = 1 THEN ['only0', 'only5', 'only10', 'only15', 'only20'] ELSE [] END AS topk, {HASH.format(c='event_id')} AS h FROM so WHERE split = 'test'),
p AS (SELECT event_id, device, unnest(topk) AS scene, h FROM t), x AS (SELECT DISTINCT g.event_id FROM t g JOIN t q ON g.scene = q.scene AND g.device <> q.device),
c AS (SELECT g.event_id AS genuine_row, p.event_id AS impostor_row, g.scene, CASE WHEN p.h > g.h OR p.h = g.h AND p.event_id <> g.event_id THEN p.h ELSE p.h + 4503599627370496 END AS d FROM t g JOIN p ON g.scene = p.scene AND g.device <> p.device WHERE g.event_id NOT IN (SELECT event_id FROM x))
SELECT genuine_row, impostor_row, scene, false AS matched_exact FROM c QUALIFY row_number() OVER (PARTITION BY genuine_row ORDER BY d, impostor_row) = 1""")
def relaxed_impostors(spark, sf_dir):
    test = session_split(spark, sf_dir).where("split = 'test'")
    own = F.when(F.col("device") % 5 == 0, F.concat(F.lit("only"), F.col("device").cast("string"))).otherwise(F.col("kind"))
    wide = F.when(F.col("device") % 5 == 1, F.array(*[F.lit(x) for x in ("any", "only0", "only5", "only10", "only15", "only20")])).otherwise(F.array(F.lit("any")))
    rows = test.withColumn("scene", own).withColumn("topk", wide)
    return S.matched_impostors(rows, rows, "device", "event_id", "scene", "topk").where("NOT matched_exact").select("genuine_row", "impostor_row", "scene", "matched_exact")


@register("leakage_checks", "K1 I5", f"""WITH {PAIRS}, m AS (SELECT session_id, bool_or(split IN ('train', 'val')) AND bool_or(split = 'test') AS mixed FROM so GROUP BY session_id),
md AS (SELECT day, bool_or(split = 'train') AND bool_or(split = 'test') AS mixed FROM so GROUP BY day), ma AS (SELECT kind, bool_or(split = 'train') AND bool_or(split = 'test') AS mixed FROM so GROUP BY kind)
SELECT (SELECT NOT bool_or(mixed) FROM m) AS no_session_leak, (SELECT NOT bool_or(mixed) FROM md) AS no_day_leak, (SELECT NOT bool_or(mixed) FROM ma) AS no_app_leak, (SELECT NOT bool_or(mixed) FROM m) AS enroll_query_sessions_disjoint,
 (SELECT bool_and(genuine_user <> impostor_user) FROM pr) AS impostor_pool_user_disjoint, (SELECT count(*) = 0 FROM pr WHERE impostor_row NOT IN (SELECT event_id FROM t)) AS impostor_windows_test_only""")
def leakage_checks(spark, sf_dir):
    rows, pairs = pairs_of(spark, sf_dir)
    return D.leakage_checks(rows, pairs, "device", "session_id", "day", "kind", "event_id", ["day", "kind"])


@register("dataset_manifest", "K2 G9", f"""WITH {PAIRS} SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(DISTINCT device) FILTER (split = 'train') AS users_train,
 count(DISTINCT device) FILTER (split = 'val') AS users_val, count(DISTINCT device) FILTER (split = 'test') AS users_test, count(DISTINCT kind) FILTER (split = 'test') AS test_scenes, (SELECT count(*) FROM pr) AS n_pairs, (SELECT count(*) FROM pr) AS n_exact FROM so""")
def dataset_manifest(spark, sf_dir):
    rows, pairs = pairs_of(spark, sf_dir)
    audit = D.leakage_checks(rows, pairs, "device", "session_id", "day", "kind", "event_id")
    names = [f"{a}_{s}" for a in ("n", "users") for s in ("train", "val", "test")]
    return D.dataset_manifest(rows, pairs, audit, "device", "scene").select(*names, "test_scenes", "n_pairs", "n_exact")


@register("validation_scores", "E4", """WITH v AS (SELECT vec_id, label::BIGINT AS owner, embedding::DOUBLE[] AS x, ('0x' || substr(sha256('42:' || vec_id), 1, 12))::BIGINT % 1000 AS b FROM embeddings), nv AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v),
en AS (SELECT owner, unnest(list_transform(x, lambda a: a / n)) AS a, unnest(range(1, len(x) + 1)) AS i FROM nv WHERE b < 600), mn AS (SELECT owner, i, avg(a) AS m FROM en GROUP BY owner, i), pq AS (SELECT owner, list(m ORDER BY i) AS m FROM mn GROUP BY owner),
q AS (SELECT vec_id, owner, owner AS attacked, x FROM v WHERE b BETWEEN 600 AND 799), a AS (SELECT * FROM q UNION ALL SELECT q.vec_id, q.owner, pq.owner, x FROM q JOIN pq ON pq.owner <> q.owner)
SELECT vec_id AS row, a.owner, attacked, round(list_dot_product(x, m) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(m, m))), 5) + 0.0 AS score, (attacked = a.owner)::INT AS label FROM a JOIN pq ON pq.owner = attacked""")
def validation_scores(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("bigint").alias("owner"), "embedding", stable_bucket("vec_id", 42, 1000).alias("b"))
    none = spark.createDataFrame([], "impostor_row bigint, genuine_user bigint")
    out = D.evaluate(e.where("b BETWEEN 600 AND 799"), V.prototypes(e.where("b < 600"), "owner", "embedding"), none, "owner", "vec_id", "embedding")
    return out.withColumn("score", F.round("score", 5) + F.lit(0.0))


#: One fine batch document; {x} are filled from a row, and each mutation replaces a piece of it.
FINE = (
    '{"batch_id":"00000000-0000-4000-8000-{id}","device_id":"{device}","session_id":"s1","record_type":"collection","collection_source":"BUILTIN_TASK","app_package_name":"app.one","sampling_rate_hz":100,'
    '"batch_duration_seconds":5,"task_sequence":1,"task_id":"I1","task_name":"type","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1","task_started_at_wall_millis":1,'
    '"task_elapsed_seconds_at_batch_end":5,"app_version":"1","rule_version":"1","rule_hash":"h","consent_version":"1","started_at_wall_millis":1710000000000,"ended_at_wall_millis":1710000005000,"base_elapsed_nanos":10,'
    '"sensor_samples":[{"sensor_type":"ACCELEROMETER","timestamp_elapsed_nanos":10,"wall_time_estimated_millis":1,"x":{x},"y":0.0,"z":9.81,"accuracy":3}],'
    '"touch_events":[{"event_id":"t1","event_type":"TOUCH_DOWN","event_time_uptime_millis":1,"event_time_wall_millis":1,"collected_at_wall_millis":1}],'
    '"context_events":[{"event_id":"e1","event_type":"TYPE_VIEW_TEXT_CHANGED","event_time_wall_millis":1,"event_detail":{"from_index":-1},"root_nodes":[{"node_id":"n1","class_name":"android.widget.EditText"}]}],'
    '"context_features":[{"feature_id":"f1","event_id":"e1","computed_at_wall_millis":1,"collection_source":"BUILTIN_TASK","task_sequence":1,"task_id":"I1","task_name":"type","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1"}],'
    '"skip_events":[],"diagnostics":{"sensor_sample_count":1,"context_event_count":1,"touch_event_count":1,"redaction_applied":true,"compression":"lz4_frame","encryption":"none","sampling_rate_hz":100}}'
)
#: Mutations: what is replaced, by what, and the reason that must come out (null: stored).
BAD = "schema_validation_failed"
MUTATIONS = [
    ("", "", None), ('"I1"', '"I6"', BAD), ('"sequence":1', '"sequence":1', None), ('"task_category":"I1","task_session_id":"t1","task_started', '"task_category":"I8","task_session_id":"t1","task_started', BAD),
    ('"class_name":"android', '"text":"typed","class_name":"android', BAD), ('"class_name":"android', '"text_redacted":"x","class_name":"android', BAD), ('"class_name":"android', '"password":true,"class_name":"android', BAD),
    ('"class_name":"android', '"hintText":null,"class_name":"android', BAD), ('"class_name":"android', '"view_id_hash":"x","class_name":"android', None), ('"from_index":-1', '"from_index":3', BAD), ('"from_index":-1', '"from_index":null', None),
    ('"from_index":-1', '"before_text_length":null', BAD), ('"from_index":-1', '"scroll_x":5', None), ('"redaction_applied":true', '"redaction_applied":false', BAD), ('"compression":"lz4_frame"', '"compression":"none"', BAD),
    ('"sensor_sample_count":1', '"sensor_sample_count":99', BAD), ('"sampling_rate_hz":100}}', '"sampling_rate_hz":50}}', BAD), (',"sampling_rate_hz":100}}', '}}', None), ('"feature_id":"f1","event_id":"e1"', '"feature_id":"f1","event_id":"e9"', BAD),
    ('"computed_at_wall_millis":1,"collection_source":"BUILTIN_TASK"', '"computed_at_wall_millis":1,"collection_source":"THIRD_PARTY_APP"', BAD), ('"task_name":"type","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1"}', '"task_name":"other","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1"}', BAD),
    ('"sensor_type":"ACCELEROMETER"', '"sensor_type":"LIGHT"', BAD), ('"event_type":"TOUCH_DOWN"', '"event_type":"DOWN"', BAD), ('"timestamp_elapsed_nanos":10', '"timestamp_elapsed_nanos":-1', BAD), ('"ended_at_wall_millis":1710000005000', '"ended_at_wall_millis":1709999999999', BAD),
    ('"collection_source":"BUILTIN_TASK","app', '"collection_source":"THIRD_PARTY_APP","app', BAD), ('"record_type":"collection"', '"record_type":"other"', BAD), ('"event_type":"TYPE_VIEW_TEXT_CHANGED"', '"event_type":"TYPE_VIEW_TEXT_CHANGED","window_title_redacted":"t"', BAD),
    ('"event_type":"TYPE_VIEW_TEXT_CHANGED"', '"event_type":"TYPE_VIEW_SCROLLED"', None), ('"event_type":"TYPE_VIEW_TEXT_CHANGED"', '"event_type":"TYPE_VIEW_TEXT_CHANGED","coarse_orientation":"sideways"', BAD), ('"session_id":"s1"', '"session_id":""', BAD),
    ('"app_version":"1",', '', BAD), ('"sampling_rate_hz":100,"batch', '"sampling_rate_hz":0,"batch', BAD), ('"device_id":"{device}"', '"device_id":"{other}"', "envelope_batch_device_id_mismatch"), ("-4000-8000-", "-4000-9000-", "envelope_batch_id_mismatch"),
    ('{"batch_id"', '["batch_id"', "invalid_json"), ('"task_sequence":1,"task_id":"I1","task_name":"type","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1","task_started_at_wall_millis":1,"task_elapsed', '"task_sequence":2,"task_id":"I1","task_name":"type","task_intuitive_description":"d","task_category":"I1","task_session_id":"t1","task_started_at_wall_millis":1,"task_elapsed', BAD),
]
_q = lambda s: "'" + s.replace("'", "''") + "'"


@register("ingest_mutations", "V1 V2 V3 V4 V5 V6 V7 V8 V9 V10 V11 V12 V13 V14 V15 V16 V17 V18 S5 X1 X2 H9", "SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(MUTATIONS)} = {i} THEN {_q(reason) if reason else 'NULL'}" for i, (_, _, reason) in enumerate(MUTATIONS)) + f" END AS reason, CASE WHEN doc_id % {len(MUTATIONS)} IN ({', '.join(str(i) for i, m in enumerate(MUTATIONS) if m[2])}) THEN 400 ELSE 200 END AS status FROM documents")
def ingest_mutations(spark, sf_dir):
    """Envelopes around batch documents, each with one mutation, through the whole chain; DuckDB has the outcomes that the contract names."""
    kinds = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(MUTATIONS)], "kind bigint, old string, new string")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % len(MUTATIONS)).alias("kind")).join(F.broadcast(kinds), "kind")  # a row a mutation
    number = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    text = F.when(F.col("old") == "", F.lit(FINE)).otherwise(F.replace(F.lit(FINE), F.col("old"), F.col("new")))
    for name, value in {"{device}": F.sha2(F.lit("d"), 256), "{other}": F.sha2(F.lit("o"), 256), "{id}": number, "{x}": F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".5"))}.items():
        text = F.replace(text, F.lit(name), value)
    e = I.enveloped(d.withColumn("document", text), "document").withColumns({
        "device_id": F.sha2(F.lit("d"), 256), "batch_id": F.concat(F.lit("00000000-0000-4000-8000-"), number), "rule_version": F.lit("1"), "rule_hash": F.sha2(F.lit("r"), 256), "created_at_wall_millis": F.col("doc_id"),
    })
    return I.rated(e, BATCH).select("doc_id", "reason", I.status_of("reason").alias("status"))


RULES = [("text", "REDACT", "[0-9]+"), ("node", "DROP", ""), ("window", "REDACT", "x"), ("content_description", "ALLOW", ""), ("text", "DROP", "(unclosed"), ("text", "HIDE", "x")]
PROBLEMS = [None, "pattern_required", "unknown_target_or_action", None, "pattern_does_not_compile", "unknown_target_or_action"]


@register("rule_problems", "V19 H7", "SELECT doc_id AS id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {_q(p)}" for i, p in enumerate(PROBLEMS) if p) + f" END AS problem FROM documents WHERE doc_id % 6 IN ({', '.join(str(i) for i, p in enumerate(PROBLEMS) if p)})")
def rule_problems(spark, sf_dir):
    rules = F.element_at(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(a).alias("action"), F.lit(p).alias("pattern")) for t, a, p in RULES]), (F.col("doc_id") % 6 + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), rules.alias("r")).select("id", "r.*")
    return I.rule_problems(d)


@register("canonical_documents", "X8 H7", "SELECT conv_id, turn, sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || ',\"z\":{\"a\":1,\"b\":[2,1]}}') AS content FROM conversations")
def canonical_documents(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    as_sent = F.when(F.col("turn") % 2 == 0, F.format_string('{"z": {"b": [2, 1], "a": 1}, "turn": %d, "role": "%s"}', "turn", "role")).otherwise(F.format_string('{"role":"%2$s",\n "z":{"a":1,"b":[2,1]}, "turn":%1$d}', "turn", "role"))
    return c.select("conv_id", "turn", I.rules_hash(as_sent).alias("content"))


@register("scalar_projections", "P3 P7 P12 P15 P16 P17", """SELECT event_id, round(floor(epoch_us(ts) / 1000) / 1000, 3) AS seconds, strftime(ts, '%Y-%m-%d') AS folder, substr(sha256('salt:' || user_id), 1, 16) AS client, substr(sha256(user_id::VARCHAR), 1, 8) AS prefix,
 CASE WHEN event_type = 'click' THEN 'scroll_x' ELSE 'from_index,scroll_x' END AS kept FROM events""")
def scalar_projections(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"tmp_a": F.lit(1), "tmp_b": F.lit(2), "gone": F.lit(3)})
    e = I.drop_columns(e, ["gone"], ["tmp_"])
    if set(e.columns) & {"tmp_a", "tmp_b", "gone"}:
        raise AssertionError("columns stay that were to go")
    detail = F.create_map(F.lit("scroll_x"), F.lit("1"), F.lit("from_index"), F.lit("3"), F.lit("added_count"), F.lit("2"))
    kept = F.array_join(F.array_sort(F.map_keys(I.sanitized_detail(detail, F.col("event_type") == "click"))), ",")
    user = F.col("user_id").cast("string")
    nanos = F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000
    return e.select("event_id", F.round(nanos / 1e9, 3).alias("seconds"), F.date_format("ts", "yyyy-MM-dd").alias("folder"), I.client_hash(user, "salt").alias("client"), F.left(F.sha2(user, 256), F.lit(8)).alias("prefix"), kept.alias("kept"))
