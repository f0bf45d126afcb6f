"""Sweeps over configurations: every configuration and number of experts scored, rated and compared in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import studies as D
from . import verification as V


def gated_score(gate: Column, scores: Column, k: Column) -> Column:
    """Mean of the k experts' scores that the gate weighs most, by its weights; of equal weights the first expert counts
    first. All experts where k is over their number; null without weight."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(gate) - 1), lambda i: F.struct((-F.get(gate, i)).alias("g"), i.alias("i"), F.get(scores, i).alias("s"))))
    best = F.slice(ranked, 1, k)
    weight = F.aggregate(best, F.lit(0.0), lambda a, x: a - x["g"])
    return F.aggregate(best, F.lit(0.0), lambda a, x: a - x["g"] * x["s"]) / F.when(weight > 0, weight)


def sweep_scores(pairs: DataFrame, gates: dict[str, str], scores: str, ks: list[int]) -> DataFrame:
    """The pairs once a configuration (a name and its column of gate weights) and k, with `config`, `k` and `score`."""
    grid = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), F.col(c).alias("gate"), F.lit(k).alias("k")) for name, c in gates.items() for k in ks]))
    rows = pairs.withColumn("_g", grid)
    return rows.select(*[c for c in pairs.columns if c not in {*gates.values(), scores}], F.col("_g.config").alias("config"), F.col("_g.k").alias("k"), gated_score(F.col("_g.gate"), F.col(scores), F.col("_g.k")).alias("score"))


def sweep_rates(scored: DataFrame, user: str, label: str = "label", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rates, per_user): per configuration `by` its equal error rate, or why there is none, and the rate of each user.

    A configuration that cannot be rated is a row with a reason, so that one failure does not end a sweep: `no_scores`
    if all its scores are null or NaN, `one_class` if they are of one label only. Users of one class have no rate.
    """
    by = by or ["config", "k"]
    fine = F.col("score").isNotNull() & ~F.isnan("score")
    known = scored.where(fine)
    whole = V.eer(V.roc(known, "score", label, by), by)
    sizes = scored.groupBy(*by).agg(F.count_if(fine).alias("n_scores"), F.count_if(fine & (F.col(label) == 1)).alias("_p"))
    reason = F.when(F.col("n_scores") == 0, "no_scores").when((F.col("_p") == 0) | (F.col("_p") == F.col("n_scores")), "one_class")
    per_user = V.eer(V.roc(known, "score", label, [*by, user]), [*by, user]).withColumnRenamed(user, "user")
    return sizes.join(whole, by, "left").select(*by, "n_scores", "eer", reason.alias("reason")), per_user


def sweep_table(rates: DataFrame, per_user: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """A row a configuration and k: rate, that of the users, and the distance from the configuration's best k."""
    users = per_user.groupBy("config", "k").agg(F.count(F.lit(1)).alias("n_users"), F.avg("eer").alias("user_eer"))
    best = rates.groupBy("config").agg(F.min("eer").alias("_best"))
    joined = rates.join(users, ["config", "k"], "left").join(best, "config")
    return joined.select("config", "k", "n_scores", "eer", "reason", F.coalesce("n_users", F.lit(0)).alias("n_users"), "user_eer", (F.col("eer") - F.col("_best")).alias("delta"), F.coalesce(F.col("eer") <= F.col("_best") + tolerance, F.lit(False)).alias("within"))


def selected_k(rates: DataFrame, per_user: DataFrame, config: str, tolerance: float = 0.02) -> DataFrame:
    """One row (config, k, best_k): the smallest k of a configuration that is not worse than its best."""
    own = lambda df: df.where(F.col("config") == config).drop("config")
    return D.select_k(own(rates).select("k", "eer"), own(per_user).select("k", "user", "eer"), tolerance).select(F.lit(config).alias("config"), "k", "best_k")
