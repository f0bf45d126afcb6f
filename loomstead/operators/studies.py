"""Studies on verification scores: thresholds, streams and policies, paired tests, routers, losses, audits, datasets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_number, stable_bucket
from . import splits as S
from . import verification as V

#: Detection policies in the order of preference among equals: name, kind and its numbers (fixed values).
GRID = [("raw", "raw", {}), ("2-of-3", "k_of_n", {"k": 2, "n": 3}), ("3-of-5", "k_of_n", {"k": 3, "n": 5}), ("ewma-0.3", "ewma", {"alpha": 0.3}), ("ewma-0.5", "ewma", {"alpha": 0.5})]


def eer_threshold(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key the equal error rate and the score at it. The score lies on the straight stretch of the curve around the
    crossing, by the rate of false accepts between the stretch's ends; on an upright stretch it is that of its corner. It
    is infinite or undefined (NaN) on a stretch from the origin. Ends are found by aggregates, so nothing is sorted."""
    keys = keys or []
    over = F.col("fnr") > F.col("fpr")
    step = F.struct("score", "own_tp", "own_fp")
    fine = curve.where("pos > 0 AND neg > 0")
    found = V.eer(curve, keys)
    at = fine.groupBy(*keys).agg(F.max_by(step, F.when(~over, F.col("score"))).alias("_b")).where("_b IS NOT NULL")
    at = at.join(found, keys) if keys else at.join(F.broadcast(found))  # one row
    beside = lambda df: fine.join(F.broadcast(df), keys) if keys else fine.join(F.broadcast(df))  # noqa: E731  a row a key
    other = (F.col("own_tp") * F.col("_b.own_fp") != F.col("own_fp") * F.col("_b.own_tp")) | (F.col("own_tp") != F.col("_b.own_tp")) | (F.col("own_fp") != F.col("_b.own_fp"))
    point = F.struct("fpr", "score")
    ends = beside(at).groupBy(*keys).agg(
        F.first("eer").alias("eer"), F.min_by(point, F.when((F.col("score") > F.col("_b.score")) & other, F.col("score"))).alias("_s"), F.max(F.when((F.col("score") < F.col("_b.score")) & other, F.col("score"))).alias("_next")
    )
    last = F.min_by(point, F.when(F.col("_next").isNull() | (F.col("score") > F.col("_next")), F.col("score")))
    both = beside(ends).groupBy(*keys).agg(F.first("eer").alias("eer"), F.first("_s").alias("_s"), last.alias("_e"))
    x0, t0 = F.coalesce("_s.fpr", F.lit(0.0)), F.coalesce("_s.score", F.lit(float("inf")))
    x1, t1 = F.col("_e.fpr"), F.col("_e.score")
    return both.select(*keys, "eer", F.when(x1 == x0, t0).otherwise(t0 + (F.col("eer") - x0) * ((t1 - t0) / F.when(x1 != x0, x1 - x0))).alias("threshold"))


def metrics_payload(scores: DataFrame, budgets: list[float] = (0.01, 0.05)) -> DataFrame:
    """One row: rates, threshold, areas, operating points and FAR/FRR at the threshold of scores (score, label)."""
    curve = V.roc(scores, "score", "label")
    at = eer_threshold(curve)
    with_t = scores.join(F.broadcast(at.select(F.col("threshold").alias("_t"))))  # one row
    good = F.col("score") >= F.col("_t")
    share = lambda c, of: F.count_if(c & of) / F.greatest(F.lit(1), F.count_if(of))
    fixed = with_t.agg(share(good, F.col("label") == 0).alias("far"), share(~good, F.col("label") == 1).alias("frr"), F.count(F.lit(1)).alias("n_scores"))
    out = at
    for part in (V.auc_and_precision(curve), V.operating_points(curve, list(budgets)), fixed):
        out = out.join(F.broadcast(part))  # one row each
    return out


def window_number(row: Column | str) -> Column:
    """The number that ends an id of the form a:b:c, 0 if there is none."""
    return F.coalesce(F.expr("try_cast(element_at(split({}, ':'), -1) AS BIGINT)".format(row)), F.lit(0)) if isinstance(row, str) else F.coalesce(F.element_at(F.split(row, ":"), -1).try_cast("bigint"), F.lit(0))


def score_streams(pairs: DataFrame) -> DataFrame:
    """(stream, attack, at, score) of pair scores (attacked, owner, session, row, score, label): a genuine stream is a
    user's session in window order, an attack stream an impostor's windows against a user by session and window."""
    attack = F.col("label") == 0
    number = window_number("row")
    stream = F.concat_ws("|", F.when(attack, "a").otherwise("g"), F.col("attacked").cast("string"), F.when(attack, F.col("owner").cast("string")).otherwise(F.col("session").cast("string")))
    placed = pairs.select(stream.alias("stream"), attack.alias("attack"), F.when(attack, F.col("session").cast("string")).otherwise("").alias("_s"), number.alias("_n"), "score")
    at = F.row_number().over(Window.partitionBy("stream").orderBy("_s", "_n", "score")) - 1
    return placed.select("stream", "attack", at.alias("at"), "score")


def policy_metrics(streams: DataFrame, threshold: float, stride: float, grid=GRID) -> DataFrame:
    """(policy, idx, detection_rate, time_to_detect, false_alarms_per_hour) of every policy: one sort of the streams."""
    rejects = streams.withColumn("_r", (F.col("score") < F.lit(float(threshold))).cast("int"))
    w = Window.partitionBy("stream").orderBy("at")
    windowed, averaged = rejects, []
    for i, (_, kind, p) in enumerate(grid):
        if kind == "ewma":
            averaged.append((i, p["alpha"]))
        else:
            k, n = p.get("k", 1), p.get("n", 1)
            windowed = windowed.withColumn(f"_a{i}", F.sum("_r").over(w.rowsBetween(-(n - 1), 0)) >= k)
    plain = [i for i, (_, kind, _) in enumerate(grid) if kind != "ewma"]
    per = windowed.groupBy("stream", "attack").agg(
        F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("at", "_r"))), lambda x: x["_r"]).alias("_rs"),
        *[F.min(F.when(F.col(f"_a{i}"), F.col("at"))).alias(f"first{i}") for i in plain], *[F.count_if(f"_a{i}").alias(f"alarms{i}") for i in plain],
    )
    zero = F.struct(F.lit(0.0).alias("e"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("n"))
    for i, alpha in averaged:
        per = per.withColumn("_a", F.aggregate("_rs", zero, _ewma_step(alpha))).withColumn(f"first{i}", F.col("_a.first")).withColumn(f"alarms{i}", F.col("_a.n"))
    each = per.select("attack", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(name).alias("policy"), F.col(f"first{i}").cast("bigint").alias("first"), F.col(f"alarms{i}").cast("bigint").alias("alarms")) for i, (name, _, _) in enumerate(grid)])).alias("x"))
    attack, first = F.col("attack"), F.col("x.first")
    return each.groupBy("x.policy", "x.idx").agg(
        F.avg(F.when(attack, first.isNotNull().cast("double"))).alias("detection_rate"), F.avg(F.when(attack, F.coalesce(first, F.col("n")) * stride)).alias("time_to_detect"),
        F.avg(F.when(~attack, F.col("x.alarms") / (F.col("n") * stride / 3600.0))).alias("false_alarms_per_hour"),
    )


def _ewma_step(alpha: float):
    """The fold of e = alpha r + (1 - alpha) e with the first and the number of places where e is over a half."""

    def step(a: Column, r: Column) -> Column:
        e = F.lit(alpha) * r.cast("double") + F.lit(1 - alpha) * a["e"]
        return F.struct(e.alias("e"), (a["i"] + 1).alias("i"), F.coalesce(a["first"], F.when(e > 0.5, a["i"])).alias("first"), (a["n"] + (e > 0.5).cast("int")).alias("n"))

    return step


def select_policy(metrics: DataFrame, budget: float = float("inf")) -> DataFrame:
    """The policy that detects soonest within the budget of false alarms; of equals the first of the grid."""
    over = F.coalesce(F.col("false_alarms_per_hour") > budget, F.lit(False))
    best = F.min_by(F.struct(*metrics.columns), F.struct(over, F.coalesce("time_to_detect", F.lit(float("inf"))), F.col("idx")))
    return metrics.agg(best.alias("b")).select("b.*")


def pooled_delta(a: DataFrame, b: DataFrame, user: str, replicates: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: mean and interval of EER(b) - EER(a) over replicates that resample the users both have, the same draws
    for both. a, b: (user, score, label)."""
    shared = a.select(user).distinct().join(b.select(user).distinct(), user)
    draws = V.resample_counts(shared, user, replicates, seed)
    rate = lambda s, name: V.eer(V.roc(s.groupBy(user, "score", "label").agg(F.count(F.lit(1)).alias("_c")).join(draws, user).withColumn("_w", F.col("_c") * F.col("times")), "score", "label", ["replicate"], "_w"), ["replicate"]).withColumnRenamed("eer", name)
    deltas = rate(a, "_a").join(rate(b, "_b"), "replicate").select((F.col("_b") - F.col("_a")).alias("_d"))
    q = F.expr(f"percentile(_d, array({alpha / 2}D, {1 - alpha / 2}D))")
    return deltas.agg(F.avg("_d").alias("delta_mean"), q.alias("_q"), F.count("_d").alias("n_effective")).join(F.broadcast(shared.agg(F.count(F.lit(1)).alias("n_shared")))).select("delta_mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n_effective", "n_shared")


def sign_flip_p(diffs: DataFrame, key: str, diff: str, replicates: int = 1000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """One-sided p of the mean difference when signs are exchangeable: (c + 1) / (B + 1). Every pair brings its signs of
    all replicates, so nothing is joined; sums of a replicate pre-aggregate."""
    by = by or []
    known = diffs.where(F.col(diff).isNotNull() & ~F.isnan(F.col(diff))).select(*by, F.col(key).cast("string").alias("_k"), F.col(diff).alias("_d"))
    each = known.select(*by, "_k", "_d", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("_b"))  # 0 is the observed one
    sign = F.when(F.col("_b") == 0, 1.0).otherwise(1.0 - 2.0 * stable_bucket(F.concat_ws(":", F.col("_b").cast("string"), F.col("_k")), seed, 2))
    sums = each.groupBy(*by, "_b").agg(F.round(F.sum(F.col("_d") * sign), 9).alias("_s"))
    seen = sums.groupBy(*by).agg(F.max(F.when(F.col("_b") == 0, F.col("_s"))).alias("_o"), F.collect_list(F.when(F.col("_b") > 0, F.col("_s"))).alias("_f"))
    return seen.select(*by, ((F.size(F.filter("_f", lambda s: s >= F.col("_o"))) + 1) / F.lit(float(replicates + 1))).alias("p_perm"))


def _wilcoxon(plus: float, n: int, ties: float) -> float | None:
    """Two-sided p of a rank sum: exact without ties up to 50 pairs, else by the normal law with ties counted."""
    if not n:
        return None
    if not ties and n <= 50:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        low = min(plus, n * (n + 1) / 2 - plus)
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return math.erfc(abs(plus - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else None


def _tests(plus: pa.Array, n: pa.Array, ties: pa.Array) -> pa.Array:
    return pa.array([_wilcoxon(p or 0.0, k, t or 0.0) for p, k, t in zip(plus.to_pylist(), n.to_pylist(), ties.to_pylist())], pa.float64())


def paired_tests(diffs: DataFrame, diff: str, by: list[str] | None = None) -> DataFrame:
    """Per group of `by`: pairs, wins, losses, rank sum, p of the signed ranks and of the sign test, and the one that
    counts: the sign test where over half of the pairs are ties or the ranks say nothing."""
    by = by or []
    known = diffs.where(F.col(diff).isNotNull() & ~F.isnan(F.col(diff))).select(*by, F.col(diff).alias("_d"))
    part = by or [F.lit(0)]
    size = F.abs("_d")
    same = Window.partitionBy(*part, "_zero", "_m")
    ranked = known.withColumn("_m", F.round(size, 12)).withColumn("_zero", F.col("_d") == 0)
    ranked = ranked.withColumn("_t", F.count(F.lit(1)).over(same)).withColumn("_r", F.rank().over(Window.partitionBy(*part, "_zero").orderBy("_m")) + (F.col("_t") - 1) / 2)
    moved = ~F.col("_zero")
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") < 0).alias("losses"),
        F.sum(F.when(F.col("_d") > 0, F.col("_r"))).alias("rank_sum"), F.sum(F.when(moved, (F.col("_t") * F.col("_t") - 1).cast("double"))).alias("_ties"),
    )
    decisive = F.col("wins") + F.col("losses")
    out = out.withColumn("rank_sum", F.coalesce("rank_sum", F.lit(0.0))).withColumn("p_wilcoxon", F.arrow_udf(_tests, "double")("rank_sum", decisive, "_ties"))
    low = F.least("wins", "losses")
    # the smaller side's binomial tail, term by term: the logarithm of a term stays finite for any number of pairs
    grown = lambda a, k: a["t"] + F.ln((decisive - k + 1) / k)
    none = -decisive * F.ln(F.lit(2.0))
    tail = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(low, F.lit(1))), F.struct(none.alias("t"), F.exp(none).alias("s")), lambda a, k: F.struct(grown(a, k).alias("t"), F.when(k <= low, a["s"] + F.exp(grown(a, k))).otherwise(a["s"]).alias("s")), lambda a: a["s"])
    out = out.withColumn("p_sign", F.when(decisive > 0, F.least(F.lit(1.0), 2 * tail)))
    signs = (F.col("n_pairs") - decisive > 0.5 * F.col("n_pairs")) | F.col("p_wilcoxon").isNull()
    return out.withColumn("test", F.when(signs, "sign").otherwise("wilcoxon")).withColumn("p_value", F.when(signs, F.col("p_sign")).otherwise(F.col("p_wilcoxon"))).drop("_ties")


def delta_table(rates: DataFrame, against: str) -> DataFrame:
    """Per baseline of `rates` (config, user, eer): paired differences to the config `against` over shared users, tests,
    effect size, win rate, and the p-values adjusted over the family."""
    own = rates.where(F.col("config") == against).select("user", F.col("eer").alias("_own"))
    diffs = rates.where(F.col("config") != against).join(own, "user").select("config", (F.col("eer") - F.col("_own")).alias("d"))
    sd = F.stddev_samp("d")
    sizes = diffs.groupBy("config").agg(F.avg("d").alias("mean_delta"), F.when((F.count("d") >= 2) & (sd >= 1e-12), F.avg("d") / sd).otherwise(0.0).alias("cohens_d"), F.avg((F.col("d") > 0).cast("double")).alias("win_rate"))
    return V.holm(paired_tests(diffs, "d", ["config"]).join(sizes, "config"), "p_value")


def select_k(sweep: DataFrame, per_user: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """One row (k, best_k): the smallest k that is not worse than the best by the tolerance or by the paired test. sweep:
    (k, eer); per_user: (k, user, eer). Without a finite rate the smallest k."""
    finite = F.col("eer").isNotNull() & ~F.isnan("eer")
    best = sweep.agg(F.min_by("k", F.when(finite, F.struct("eer", "k"))).alias("best_k"), F.min(F.when(finite, F.col("eer"))).alias("_best"), F.min("k").alias("_least"))
    ours = per_user.join(F.broadcast(best.select(F.col("best_k").alias("k"))), "k").select("user", F.col("eer").alias("_b"))
    tests = paired_tests(per_user.join(ours, "user").select("k", (F.col("eer") - F.col("_b")).alias("d")), "d", ["k"]).select("k", "p_value")
    rated = sweep.where(finite).join(tests, "k", "left").join(F.broadcast(best))
    fine = (F.col("eer") <= F.col("_best") + tolerance) | F.coalesce(F.col("p_value") >= 0.05, F.lit(True))
    chosen = rated.where(fine).agg(F.min("k").alias("_k"))
    return best.join(F.broadcast(chosen)).select(F.coalesce("_k", "best_k", "_least").alias("k"), "best_k")


def uniform_router(row: Column, experts: int, seed: int = 42, slots: int = 8192) -> Column:
    """Logits of the random router: those of a table of `slots` rows of hashed uniform numbers, by the row's id."""
    slot = F.pmod(row, F.lit(slots)).cast("string")
    return F.transform(F.sequence(F.lit(0), F.lit(experts - 1)), lambda i: hash_number(F.concat_ws(":", F.lit(str(seed)), slot, i.cast("string")), 12) / F.lit(float(1 << 48)))


def learned_router(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Logits of a linear router whose weights were learned elsewhere: one row of weights an expert."""
    dot = lambda w: F.aggregate(F.zip_with(features, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(w) + F.lit(float(b)) for w, b in zip(weights, bias)])


def build_router(kind: str, experts: int = 7, seed: int = 42, **options) -> Column:
    """The logits column of a router by its kind; `row`, `probs` or `features` name what it reads."""
    kinds = {
        "hash": lambda: V.hash_router(options["row"], experts),
        "random": lambda: uniform_router(options["row"], experts, seed),
        "fixed": lambda: V.fixed_router(options["probs"]),
        "learned": lambda: learned_router(options["features"], options["weights"], options["bias"]),
        "package": lambda: learned_router(options["features"], options["weights"], options["bias"]),
    }
    if kind not in kinds:
        raise ValueError(f"unknown router {kind!r}; known: {sorted(kinds)}")
    return kinds[kind]()


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def kl_weak(log_probs: Column, weak: Column, confidence: Column, least: float = 0.0) -> Column:
    """Aggregate: divergence of the router from the weak labels, weighted by confidence where that reaches `least`."""
    kl = _total(F.zip_with(weak, log_probs, lambda p, q: F.when(p > 0, p * (F.ln(F.greatest(p, F.lit(1e-8))) - q)).otherwise(0.0)))
    w = F.when(confidence >= least, confidence).otherwise(0.0)
    return F.sum(kl * w) / F.greatest(F.sum(w), F.lit(1e-8))


def load_balance(probs: Column, experts: int = 7) -> Column:
    """Aggregate: how far the mean of the router's probabilities is from even."""
    return sum((F.pow(F.avg(probs[i]) - 1.0 / experts, F.lit(2)) for i in range(experts)), F.lit(0.0)) * experts


def temporal_smoothness(df: DataFrame, probs: str, keys: list[str], order: list[str]) -> DataFrame:
    """One row: mean squared jump of the probabilities from a row to the next of its keys; 0 without any."""
    nxt = F.lead(probs).over(Window.partitionBy(*keys).orderBy(*order))
    jump = _total(F.zip_with(F.col(probs), F.col("_next"), lambda a, b: (a - b) * (a - b)))
    return df.withColumn("_next", nxt).where("_next IS NOT NULL").agg(F.coalesce(F.avg(jump), F.lit(0.0)).alias("smoothness"))


def prototype_loss(df: DataFrame, batch: list[str], user: str, vector: str) -> DataFrame:
    """Per batch: mean over its users of the mean of 1 - cosine to the user's mean direction in the batch."""
    each = df.select(*batch, user, F.monotonically_increasing_id().alias("_row"), V.normalised(F.col(vector)).alias("_v"))
    mean = each.select(*batch, user, F.posexplode("_v").alias("_i", "_x")).groupBy(*batch, user, "_i").agg(F.avg("_x").alias("_m"))
    centre = mean.groupBy(*batch, user).agg(V.normalised(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])).alias("_p"))
    gaps = each.join(centre, [*batch, user]).withColumn("_g", 1 - _total(F.zip_with("_v", "_p", lambda a, b: a * b)))
    return gaps.groupBy(*batch, user).agg(F.avg("_g").alias("_g")).groupBy(*batch).agg(F.avg("_g").alias("proto_loss"))


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.ln(_total(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.element_at(logits, label.cast("int") + 1)


def triplet_loss(df: DataFrame, batch: list[str], user: str, vector: str, margin: float = 0.3) -> DataFrame:
    """Per batch of training rows (bounded by its size): mean over anchors of the farthest row of its user less the
    nearest of another, plus the margin, 0 at least."""
    each = df.select(*batch, F.col(user).alias("_u"), F.monotonically_increasing_id().alias("_row"), V.normalised(F.col(vector)).alias("_v"))
    packed = each.groupBy(*batch).agg(F.collect_list(F.struct("_row", "_u", "_v")).alias("_all"))
    gap = lambda a, b: F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    anchors = packed.select(*batch, "_all", F.explode("_all").alias("a"))
    near = F.transform(F.filter("_all", lambda r: r["_u"] != F.col("a._u")), lambda r: gap(r["_v"], F.col("a._v")))
    far = F.transform(F.filter("_all", lambda r: (r["_u"] == F.col("a._u")) & (r["_row"] != F.col("a._row"))), lambda r: gap(r["_v"], F.col("a._v")))
    loss = anchors.select(*batch, F.array_max(far).alias("_f"), F.array_min(near).alias("_n")).where("_f IS NOT NULL AND _n IS NOT NULL")
    return loss.groupBy(*batch).agg(F.avg(F.greatest(F.lit(0.0), F.col("_f") - F.col("_n") + margin)).alias("triplet_loss"))


def total_loss(parts: DataFrame, scene: float = 1.0, balance: float = 0.005, smooth: float = 0.1) -> DataFrame:
    """Adds total to rows of auth, kl, balance and smooth; a part that is missing counts as 0."""
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * w
    return parts.withColumn("total", part("auth", 1.0) + part("kl", scene) + part("balance", balance) + part("smooth", smooth))


def decoded_topk(column: Column | str) -> Column:
    """The list of a JSON text, an empty one where it is none."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def leakage_checks(rows: DataFrame, pairs: DataFrame, user: str, session: str, day: str, app: str, row: str, held: list[str] = ()) -> DataFrame:
    """One row of six booleans, each true if the split is sound; days and apps count only where the protocol holds them out."""
    meet = lambda c, left: rows.groupBy(c).agg(F.bool_or(F.col("split").isin(*left)).alias("a"), F.bool_or(F.col("split") == "test").alias("b")).agg(~F.coalesce(F.bool_or(F.col("a") & F.col("b")), F.lit(False)))
    yes = rows.sparkSession.range(1).select(F.lit(True))
    outside = pairs.join(rows.where("split = 'test'").select(F.col(row).alias("impostor_row")).distinct(), "impostor_row", "left_anti").agg(F.count(F.lit(1)) == 0)
    parts = {
        "no_session_leak": meet(session, ["train", "val"]), "no_day_leak": meet(day, ["train"]) if day in held else yes, "no_app_leak": meet(app, ["train"]) if app in held else yes,
        "enroll_query_sessions_disjoint": meet(session, ["train", "val"]), "impostor_pool_user_disjoint": pairs.agg(F.coalesce(F.bool_and(F.col("genuine_user") != F.col("impostor_user")), F.lit(True))), "impostor_windows_test_only": outside,
    }
    out = None
    for name, part in parts.items():
        one = part.toDF(name)
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def build_dataset(windows: DataFrame, protocol: str, root: str, user: str = "user_id", session: str = "session_id", day: str = "day_id", app: str = "package_bucket", row: str = "window_id", scene: str = "weak_label_top1", topk: str = "weak_label_topk", n: int = 1, seed: int = 42, split: dict | None = None) -> DataFrame:
    """Split (with the options in `split`), pair impostors, audit, write windows by split, pairs and the manifest below `root`; returns the manifest. An
    audit that fails is an error, and nothing is written."""
    held = {"leave_day_out": [day], "leave_app_out": [app], "combined_day_app": [day, app], "combined": [day, app]}.get(protocol, [])
    rows = S.make_split(windows, protocol, **(split or {}))
    test = rows.where("split = 'test'")
    pairs = S.matched_impostors(test, test, user, row, scene, topk, n, seed)
    audit = leakage_checks(rows, pairs, user, session, day, app, row, held)
    found = audit.first().asDict()
    if not all(found.values()):
        raise ValueError(f"the split leaks: {sorted(k for k, v in found.items() if not v)}")
    manifest = dataset_manifest(rows, pairs, audit, user, scene).withColumns({"protocol": F.lit(protocol), "seed": F.lit(seed)})
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{root}/windows")
    pairs.write.mode("overwrite").parquet(f"{root}/impostor_pairs")
    manifest.write.mode("overwrite").json(f"{root}/manifest")
    return manifest


def dataset_manifest(rows: DataFrame, pairs: DataFrame, audit: DataFrame, user: str, scene: str) -> DataFrame:
    """One row: rows and users by split, scenes of the test rows, pairs and how many match exactly, the audit."""
    of = lambda s: F.col("split") == s
    counts = rows.agg(*[F.count_if(of(s)).alias(f"n_{s}") for s in ("train", "val", "test")], *[F.countDistinct(F.when(of(s), F.col(user))).alias(f"users_{s}") for s in ("train", "val", "test")], F.countDistinct(F.when(of("test"), F.col(scene))).alias("test_scenes"))
    return counts.join(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("matched_exact").alias("n_exact")))).join(F.broadcast(audit))


def evaluate(queries: DataFrame, protos: DataFrame, pairs: DataFrame, user: str, row: str, vector: str) -> DataFrame:
    """Scores of rows against their own user's prototype (label 1) and of impostors' rows against the attacked user's
    (label 0): (row, owner, attacked, score, label). Without pairs every row meets the prototypes of all other users."""
    own = queries.select(F.col(row).alias("row"), F.col(user).alias("owner"), F.col(user).alias("attacked"), vector)
    impostors = pairs.select(F.col("impostor_row").alias("row"), F.col("genuine_user").alias("attacked")).join(own.select("row", "owner", vector), "row").select("row", "owner", "attacked", vector)
    if pairs.isEmpty():  # a stated fallback for small validation sets: the users' prototypes are one row a user
        impostors = own.drop("attacked").join(protos.select(F.col(user).alias("attacked")), F.col("owner") != F.col("attacked")).select("row", "owner", "attacked", vector)
    scored = V.pair_scores(own.union(impostors), protos.withColumnRenamed(user, "owner"), "owner", vector, "attacked")
    return scored.select("row", "owner", "attacked", "score", "label")
