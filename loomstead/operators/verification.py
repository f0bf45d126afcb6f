"""Verification: prototypes, ROC curves, error rates, detection policies, resampling, routing diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, dot, stable_bucket


def normalised(v: Column) -> Column:
    """The array over its length; itself (as doubles) if it has none to speak of."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(dot(v, v))
    return F.when(n > 1e-12, F.transform(d, lambda x: x / n)).otherwise(d)


def prototypes(df: DataFrame, user: str, vector: str) -> DataFrame:
    """(user, prototype): mean of the users' normalised vectors, normalised again. Sums meet by user and position."""
    each = df.select(user, F.posexplode(normalised(F.col(vector))).alias("_i", "_x"))
    mean = each.groupBy(user, "_i").agg(F.avg("_x").alias("_m"))
    packed = mean.groupBy(user).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return packed.select(user, normalised(F.transform("_v", lambda s: s["_m"])).alias("prototype"))


def pair_scores(tests: DataFrame, protos: DataFrame, user: str, vector: str, attacked: str) -> DataFrame:
    """Tests (with the column `attacked`) scored against the attacked users' prototypes; users without one drop out."""
    p = protos.select(F.col(user).alias("_p"), "prototype")
    joined = tests.join(p, F.col(attacked) == F.col("_p"))
    return joined.withColumn("score", cosine(F.col(vector), F.col("prototype"))).withColumn("label", (F.col(attacked) == F.col(user)).cast("int")).drop("_p", "prototype")


def roc(df: DataFrame, score: str, label: str, keys: list[str] | None = None, weight: str | None = None, buckets: float = 1024.0) -> DataFrame:
    """Per key and distinct score: tp, fp, pos, neg, fpr, fnr of accepting from that score on, and the score's own counts.

    Running sums go in two steps, by coarse score bucket first, so no window ever spans a key's whole scores:
    bucket totals are few whatever the rows.
    """
    keys = keys or []
    w = F.col(weight) if weight else F.lit(1)
    points = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("_n"))
    points = points.withColumn("_b", F.floor(F.col("score") * buckets))
    totals = points.groupBy(*keys, "_b").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
    by = keys or [F.lit(0)]
    before = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(*keys, "_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_up"), F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_un"), F.sum("_bp").over(whole).alias("pos"), F.sum("_bn").over(whole).alias("neg"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = points.join(totals, [*keys, "_b"]).withColumn("tp", F.col("_up") + F.sum("_p").over(inside)).withColumn("fp", F.col("_un") + F.sum("_n").over(inside))
    fpr, fnr = F.col("fp") / F.when(F.col("neg") > 0, F.col("neg")), 1 - F.col("tp") / F.when(F.col("pos") > 0, F.col("pos"))
    return out.select(*keys, "score", "tp", "fp", F.col("_p").alias("own_tp"), F.col("_n").alias("own_fp"), "pos", "neg", fpr.alias("fpr"), fnr.alias("fnr"))


def eer(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key the rate at which misses equal false accepts, on the line between the two vertices around it; keys of
    one class drop out. The curve falls, so its last vertex above the diagonal and its first below are extremes."""
    over, point = F.col("fnr") > F.col("fpr"), F.struct("fpr", "fnr")
    found = curve.where("pos > 0 AND neg > 0").groupBy(*(keys or [])).agg(F.min_by(point, F.when(over, F.col("score"))).alias("_a"), F.max_by(point, F.when(~over, F.col("score"))).alias("_b"))
    x0, y0 = F.coalesce(F.col("_a.fpr"), F.lit(0.0)), F.coalesce(F.col("_a.fnr"), F.lit(1.0))
    x1, y1 = F.col("_b.fpr"), F.col("_b.fnr")
    bottom = (x1 - x0) - (y1 - y0)
    value = F.when(x1 == x0, x0).otherwise((y0 * (x1 - x0) - x0 * (y1 - y0)) / F.when(bottom != 0, bottom))
    return found.where("_b IS NOT NULL").select(*(keys or []), value.alias("eer"))


def auc_and_precision(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ROC area (ties count half) and average precision (a step function)."""
    keys = keys or []
    # the curve has what each score adds, so nothing has to look back and no window spans the scores
    area = F.sum(F.col("own_fp") * (2 * F.col("tp") - F.col("own_tp")) / 2.0) / F.max(F.col("pos") * F.col("neg"))
    precision = F.sum(F.col("own_tp") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")
    return curve.where("pos > 0 AND neg > 0").groupBy(*keys).agg(area.alias("auc"), precision.alias("ap"))


def operating_points(curve: DataFrame, budgets: list[float]) -> DataFrame:
    """One row: smallest miss rate within each false accept budget, and the other way round; null if none fits."""
    aggs = []
    for b in budgets:
        name = str(b).replace(".", "_")
        aggs += [F.min(F.when(F.col("fpr") <= b + 1e-12, F.col("fnr"))).alias(f"frr_at_far_{name}"), F.min(F.when(F.col("fnr") <= b + 1e-12, F.col("fpr"))).alias(f"far_at_frr_{name}")]
    return curve.agg(*aggs)


def k_of_n(df: DataFrame, keys: list[str], order: list[str], reject: str, k: int, n: int) -> DataFrame:
    """Adds alarm: at least k rejects in the last n rows (fewer at the start)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("alarm", F.sum(F.col(reject).cast("int")).over(w) >= k)


def ewma_alarms(df: DataFrame, keys: list[str], order: list[str], reject: str, alpha: float) -> DataFrame:
    """Per key: rows, the index of the first alarm (null if none) and the number of alarms of e = alpha r + (1 - alpha) e > 0.5.

    The recurrence runs over the key's ordered rejects in one fold, so rounding is that of the recurrence itself.
    A key is one stream of scores (a session), which bounds the array.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(reject).cast("double").alias("_r")))).alias("_s"))
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        e = F.lit(alpha) * x["_r"] + F.lit(1 - alpha) * a["e"]
        hit = e > 0.5
        return F.struct(e.alias("e"), (a["i"] + 1).alias("i"), F.coalesce(a["first"], F.when(hit, a["i"])).alias("first"), (a["n"] + hit.cast("int")).alias("n"))

    out = packed.withColumn("_a", F.aggregate("_s", zero, step))
    return out.select(*keys, F.col("_a.i").cast("bigint").alias("n_rows"), F.col("_a.first").cast("bigint").alias("first_alarm"), F.col("_a.n").cast("bigint").alias("n_alarms"))


def detection_metrics(df: DataFrame, keys: list[str], order: list[str], alarm: str, attack: str, stride: float) -> DataFrame:
    """One row: detection rate and mean time to detection of attacks (undetected ones count in full), alarms an hour of the others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    per = df.withColumn("_i", F.row_number().over(w) - 1).groupBy(*keys, attack).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col(alarm), F.col("_i"))).alias("_first"), F.count_if(alarm).alias("_alarms"))
    attacks, honest = F.col(attack), ~F.col(attack)
    return per.agg(
        F.avg(F.when(attacks, F.col("_first").isNotNull().cast("double"))).alias("detection_rate"), F.avg(F.when(attacks, F.coalesce("_first", "_n") * stride)).alias("time_to_detect"),
        F.avg(F.when(honest, F.col("_alarms") / (F.col("_n") * stride / 3600.0))).alias("false_alarms_per_hour"),
    )


def resample_counts(users: DataFrame, user: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, user, times): draws of as many users as there are, with repeats, per replicate. Users are numbered
    on their sorted order; draws are hashes, so they do not depend on partitioning."""
    numbered = users.select(user).distinct().withColumn("_i", F.row_number().over(Window.orderBy(user)) - 1)
    n = users.select(user).distinct().count()
    draws = users.sparkSession.range(replicates * n).select((F.col("id") % replicates).alias("replicate"), stable_bucket("id", seed, max(n, 1)).alias("_i"))
    return draws.join(numbered, "_i").groupBy("replicate", user).agg(F.count(F.lit(1)).alias("times"))


def bootstrap_eer(scores: DataFrame, user: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: EER over all scores and its interval over replicates that resample users. Repeats become weights, so a
    replicate costs one row a user and distinct score, not a copy of the rows."""
    per = scores.groupBy(user, "score", "label").agg(F.count(F.lit(1)).alias("_c"))
    joined = per.join(resample_counts(scores, user, replicates, seed), user).withColumn("_w", F.col("_c") * F.col("times"))
    rates = eer(roc(joined, "score", "label", ["replicate"], "_w"), ["replicate"])
    interval = rates.agg(F.expr(f"percentile(eer, array({alpha / 2}D, {1 - alpha / 2}D))").alias("_q"), F.count(F.lit(1)).alias("n_replicates"))
    point = eer(roc(scores, "score", "label")).withColumnRenamed("eer", "point")
    return point.join(F.broadcast(interval)).select("point", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n_replicates")


def bootstrap_mean(values: DataFrame, user: str, value: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: mean of the users' values and its interval over replicates that resample users; values that are null or
    not finite drop out."""
    x = F.col(value)
    known = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(user, x.alias("_x"))
    means = known.join(resample_counts(known, user, replicates, seed), user).groupBy("replicate").agg((F.sum(F.col("_x") * F.col("times")) / F.sum("times")).alias("_m"))
    interval = means.agg(F.expr(f"percentile(_m, array({alpha / 2}D, {1 - alpha / 2}D))").alias("_q"), F.count(F.lit(1)).alias("n_replicates"))
    return known.agg(F.avg("_x").alias("mean")).join(F.broadcast(interval)).select("mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n_replicates")


def roc_points(curve: DataFrame, most: int = 512) -> DataFrame:
    """(point, fpr, tpr): the curve's vertices from (0, 0) on without those on a straight step, at most `most` of them at
    evenly spaced, rounded places. A curve of one class or one score has none."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    bend = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    turns = curve.where("pos > 0 AND neg > 0").withColumn("_turns", F.coalesce((bend("tp") != 0) | (bend("fp") != 0), F.lit(True))).where("_turns")
    vertices = turns.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    vertices = vertices.where("_n > 1").select("_k", "_n", "fpr", (1 - F.col("fnr")).alias("tpr"))
    vertices = vertices.union(vertices.where("_k = 1").select(F.lit(0).alias("_k"), "_n", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    step = F.col("_n") / (most - 1)  # with the origin there are _n + 1 vertices, and the last is at _n
    point = F.rint(F.col("_k") / step)
    return vertices.where((F.col("_n") < most) | (F.rint(point * step) == F.col("_k"))).select(F.when(F.col("_n") < most, F.col("_k")).otherwise(point).cast("bigint").alias("point"), "fpr", "tpr")


def holm(df: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    """Adds p_adjusted: step-down, monotone, 1 at most. A family of tests is small; its window is one key's."""
    by = keys or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count(p).over(Window.partitionBy(*by)))
    return ranked.withColumn("p_adjusted", F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m")


def paired_delta(df: DataFrame, delta: str) -> DataFrame:
    """One row: pairs, mean difference, effect size (0 without spread) and win rate."""
    sd = F.stddev_samp(delta)
    return df.agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), F.when((F.count(delta) >= 2) & (sd >= 1e-12), F.avg(delta) / sd).otherwise(0.0).alias("cohens_d"), F.avg((F.col(delta) > 0).cast("double")).alias("win_rate"))


def topk_gate(logits: Column, k: int) -> Column:
    """Softmax of which the k largest stay and sum to 1; of equal ones the later."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    ranked = F.slice(F.reverse(F.sort_array(F.transform(e, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))), 1, k)
    total = F.greatest(F.lit(1e-12), F.aggregate(ranked, F.lit(0.0), lambda s, r: s + r["x"]))
    chosen = F.transform(ranked, lambda r: r["i"])
    return F.transform(e, lambda x, i: F.when(F.array_contains(chosen, i), x / total).otherwise(0.0))


def hash_router(row: Column, experts: int, scale: float = 10.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda i: F.when(i == row % experts, F.lit(scale)).otherwise(0.0))


def fixed_router(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-8))))


def pareto(df: DataFrame, cost: str, loss: str, by: list[str]) -> DataFrame:
    """Rows whose loss is better, by more than 1e-9, than that of all cheaper ones of their group."""
    w = Window.partitionBy(*by).orderBy(cost).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.min(loss).over(w)).where(F.col("_best").isNull() | (F.col(loss) < F.col("_best") - 1e-9)).drop("_best")
