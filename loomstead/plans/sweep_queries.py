"""Query of the sweep over gates and numbers of experts (survey rows N3 and N17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cosine, dot
from ..operators import sweeps as W
from .catalog import register
from .feature_queries import r, rounded
from .verification_queries import PROTO, eer_sql, protos, roc_sql, vectors

#: Experts: equal parts of a vector, each with its own cosine. Gates: by the parts' energy, or none.
EXPERTS = 4


def expert_pairs(spark, sf_dir):
    """(vec_id, owner, attacked, label, energy, even, experts) of every test vector against two users."""
    tests = vectors(spark, sf_dir).where("NOT enrolled").withColumn("attacked", F.explode(F.array("owner", (F.col("owner") + 1) % 10)))
    joined = tests.join(protos(spark, sf_dir).withColumnRenamed("owner", "attacked"), "attacked")
    size = F.floor(F.size("embedding") / EXPERTS).cast("int")
    part = lambda c, i: F.slice(F.transform(c, lambda x: x.cast("double")), size * i + 1, size)
    parts = [(part("embedding", i), part("prototype", i)) for i in range(EXPERTS)]
    energy = F.array(*[F.round(dot(a, a), 9) for a, _ in parts])
    return joined.select("vec_id", "owner", "attacked", (F.col("attacked") == F.col("owner")).cast("int").alias("label"), energy.alias("energy"), F.array(*[F.lit(1.0)] * EXPERTS).alias("even"), F.array(*[cosine(a, b) for a, b in parts]).alias("experts"))


SWEEP = f"""{PROTO}, atk AS (SELECT vec_id, owner, x, unnest([owner, (owner + 1) % 10]) AS attacked FROM v WHERE NOT enrolled),
cut AS (SELECT vec_id, atk.owner, attacked, i, x[len(x) // {EXPERTS} * i + 1 : len(x) // {EXPERTS} * (i + 1)] AS a, p[len(x) // {EXPERTS} * i + 1 : len(x) // {EXPERTS} * (i + 1)] AS b FROM atk JOIN pt ON pt.owner = attacked, range({EXPERTS}) AS e(i)),
ex AS (SELECT vec_id, owner, attacked, i, round(list_dot_product(a, a), 9) AS energy, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS s FROM cut),
gt AS (SELECT *, 'energy' AS config, energy AS g FROM ex UNION ALL SELECT *, 'even', 1.0 FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY config, vec_id, attacked ORDER BY g DESC, i) AS place FROM gt),
sc AS (SELECT config, k, vec_id, attacked, (attacked = owner)::INT AS label, round(sum(g * s) / sum(g), 3) + 0.0 AS score FROM rk JOIN range(1, {EXPERTS + 1}) AS ks(k) ON place <= k GROUP BY ALL),
{roc_sql('sc', 'config, k')}, {eer_sql('config, k')}, {roc_sql('sc', 'config, k, attacked', name='uroc')}, {eer_sql('config, k, attacked', 'uroc', 'ue')},
us AS (SELECT config, k, count(*) AS n_users, avg(eer) AS user_eer FROM ue GROUP BY ALL), ns AS (SELECT config, k, count(*) AS n_scores FROM sc GROUP BY ALL),
al AS (SELECT *, min(eer) OVER (PARTITION BY config) AS best FROM ns JOIN ee USING (config, k) JOIN us USING (config, k))"""


@register("expert_sweep", "N3 N17", f"WITH {SWEEP} SELECT config, k, n_scores, {r('eer')} AS eer, n_users, {r('user_eer')} AS user_eer, {r('eer - best')} AS delta, eer <= best + 0.02 AS within FROM al")
def expert_sweep(spark, sf_dir):
    scored = W.sweep_scores(expert_pairs(spark, sf_dir), {"energy": "energy", "even": "even"}, "experts", list(range(1, EXPERTS + 1)))
    rates, per_user = W.sweep_rates(scored.withColumn("score", F.round("score", 3) + F.lit(0.0)), "attacked")
    return rounded(W.sweep_table(rates, per_user).drop("reason").withColumn("k", F.col("k").cast("bigint")), "eer", "user_eer", "delta")
