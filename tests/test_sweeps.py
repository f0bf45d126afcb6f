"""Sweeps: gated scores by plain Python, one plan against single runs, failures as rows, the choice of k."""

import math

import numpy as np
from pyspark.sql import functions as F

from loomstead.operators import sweeps as W
from loomstead.operators import verification as V


def plain(gate, scores, k):
    best = sorted(range(len(gate)), key=lambda i: (-gate[i], i))[:k]
    weight = sum(gate[i] for i in best)
    return sum(gate[i] * scores[i] for i in best) / weight if weight > 0 else None


def pairs_of(spark, n=240):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        label = int(i % 3 == 0)
        s = (rng.normal(0.6 if label else 0.3, 0.2, 7)).round(3).tolist()
        rows.append((i, i % 5, label, rng.integers(0, 4, 7).astype(float).tolist(), [1.0] * 7, [0.0] * 7, s))
    return rows, spark.createDataFrame(rows, "id int, user int, label int, soft array<double>, even array<double>, none array<double>, experts array<double>")


def test_scores_rates_and_failures_of_a_sweep(spark):
    rows, pairs = pairs_of(spark)
    gates, ks = {"soft": "soft", "even": "even", "none": "none"}, list(range(1, 8))
    scored = W.sweep_scores(pairs, gates, "experts", ks).cache()
    got = {(r.id, r.config, r.k): r.score for r in scored.collect()}
    assert len(got) == len(rows) * 3 * 7
    for r in rows:
        for k in ks:
            for config, gate in zip(gates, r[3:6]):
                want = plain(gate, r[6], k)
                assert (got[r[0], config, k] is None) if want is None else abs(got[r[0], config, k] - want) < 1e-12
    rates, per_user = (x.cache() for x in W.sweep_rates(scored, "user"))
    found = {(r.config, r.k): r for r in rates.collect()}
    assert len(found) == 21 and all(found["none", k].reason == "no_scores" and found["none", k].eer is None for k in ks)
    for k in ks:  # one run of its own gives the same rate
        own = scored.where((F.col("config") == "even") & (F.col("k") == k))
        assert abs(V.eer(V.roc(own, "score", "label")).first().eer - found["even", k].eer) < 1e-12 and found["even", k].reason is None
    assert per_user.where("config = 'even' AND k = 7").count() == 5
    table = {(r.config, r.k): r for r in W.sweep_table(rates, per_user).collect()}
    best = min(found["even", k].eer for k in ks)
    assert all(abs(table["even", k].delta - (found["even", k].eer - best)) < 1e-12 and not table["none", k].within for k in ks)
    chosen = W.selected_k(rates, per_user, "even").first()
    assert found["even", chosen.best_k].eer == best and chosen.k <= chosen.best_k


def test_one_class_and_nan_and_nothing(spark):
    rows = [("a", 1, 1, 1, 0.5), ("a", 1, 2, 1, 0.7), ("b", 1, 1, 1, 0.9), ("b", 1, 1, 0, 0.1), ("c", 1, 1, 1, math.nan), ("c", 1, 1, 0, None)]
    scored = spark.createDataFrame(rows, "config string, k int, user int, label int, score double")
    rates, per_user = W.sweep_rates(scored, "user")
    assert {r.config: (r.n_scores, r.eer, r.reason) for r in rates.collect()} == {"a": (2, None, "one_class"), "b": (2, 0.0, None), "c": (0, None, "no_scores")}
    assert [tuple(r) for r in per_user.collect()] == [("b", 1, 1, 0.0)]
    assert W.sweep_rates(scored.limit(0), "user")[0].count() == 0
