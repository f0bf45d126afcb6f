import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.operators import ingest as I
from loomstead.operators import splits as S
from loomstead.operators import studies as D
from loomstead.operators import verification as V
from loomstead.sources.batches import BATCH


def test_signed_rank_p_of_known_samples(spark):
    # exact: all ten differences positive gives 2 / 2^10; one small negative one gives 4 / 2^10
    rows = [("a", float(i)) for i in range(1, 11)] + [("b", -1.0)] + [("b", float(i)) for i in range(2, 11)] + [("c", 0.0)] * 3 + [("c", 1.0)]
    out = {r.g: r for r in D.paired_tests(spark.createDataFrame(rows, "g string, d double"), "d", ["g"]).collect()}
    assert out["a"].p_wilcoxon == pytest.approx(2 / 1024) and out["b"].p_wilcoxon == pytest.approx(4 / 1024)
    assert out["a"].p_sign == pytest.approx(2 / 1024) and out["b"].p_sign == pytest.approx(22 / 1024)
    assert (out["c"].test, out["c"].p_value) == ("sign", 1.0) and out["a"].test == "wilcoxon"


def test_signed_rank_p_by_enumeration():
    rng = np.random.default_rng(1)
    for n in (4, 7, 9):
        ranks = np.arange(1, n + 1)
        signs = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        sums = signs @ ranks
        plus = int(sums[rng.integers(2**n)])
        extreme = abs(sums - n * (n + 1) / 4) >= abs(plus - n * (n + 1) / 4) - 1e-9
        assert D._wilcoxon(plus, n, 0.0) == pytest.approx(min(1.0, extreme.mean()))


def test_smallest_k_that_is_not_worse(spark):
    sweep = spark.createDataFrame([(1, 0.201), (2, 0.26), (3, 0.2)], "k int, eer double")
    users = spark.createDataFrame([(k, u, e + u / 100) for k, e in ((1, 0.201), (2, 0.26), (3, 0.2)) for u in range(8)], "k int, user int, eer double")
    assert D.select_k(sweep, users).first().asDict() == {"k": 1, "best_k": 3}
    nothing = spark.createDataFrame([(2, math.nan), (5, math.nan)], "k int, eer double")
    assert D.select_k(nothing, users).first().k == 2
    far = spark.createDataFrame([(1, 0.5), (2, 0.26), (3, 0.2)], "k int, eer double")
    worse = spark.createDataFrame([(k, u, e + u / 100 + (u % 2) * 0.001 * k) for k, e in ((1, 0.5), (2, 0.26), (3, 0.2)) for u in range(8)], "k int, user int, eer double")
    assert D.select_k(far, worse).first().k == 3


def test_threshold_on_the_line_between_vertices(spark):
    scores = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.4, 0), (0.2, 0)], "score double, label int")
    row = D.eer_threshold(V.roc(scores, "score", "label")).first()
    assert row.eer == pytest.approx(1 / 3) and row.threshold == pytest.approx(0.7)


def test_same_configs_have_no_delta(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", float(np.round(rng.normal(label, 0.8), 2)), label) for u in range(8) for label in (0, 1) for _ in range(10)]
    s = spark.createDataFrame(rows, "user string, score double, label int")
    out = D.pooled_delta(s, s, "user", 50).first()
    assert (out.delta_mean, out.low, out.high, out.n_shared, out.n_effective) == (0.0, 0.0, 0.0, 8, 50)


def test_policies_on_golden_streams(spark):
    rows = [("a1", True, i, s) for i, s in enumerate([0.9, 0.9, 0.2, 0.9, 0.9])] + [("a2", True, i, s) for i, s in enumerate([0.9, 0.2, 0.2, 0.9])] + [("g1", False, i, 0.9) for i in range(5)]
    out = {r.policy: r for r in D.policy_metrics(spark.createDataFrame(rows, "stream string, attack boolean, at int, score double"), 0.5, 1.0).collect()}
    assert (out["raw"].detection_rate, out["raw"].time_to_detect) == (1.0, 1.5) and (out["2-of-3"].detection_rate, out["2-of-3"].time_to_detect) == (0.5, 3.5)
    assert all(r.false_alarms_per_hour == 0 for r in out.values())
    assert D.select_policy(D.policy_metrics(spark.createDataFrame(rows, "stream string, attack boolean, at int, score double"), 0.5, 1.0)).first().policy == "raw"


def test_routers_by_name():
    with pytest.raises(ValueError, match="unknown router"):
        D.build_router("oracle")


def test_next_impostors_go_round_without_repeats(spark):
    rows = spark.createDataFrame([(u * 10 + i, f"u{u}", "s", ["s"]) for u in range(4) for i in range(2)], "row int, user string, scene string, top array<string>")
    pairs = S.matched_impostors(rows, rows, "user", "row", "scene", "top", 9).collect()
    for g in {p.genuine_row for p in pairs}:
        own = [p for p in pairs if p.genuine_row == g]
        assert len(own) == 6 and len({p.impostor_row for p in own}) == 6 and all(p.impostor_user != p.genuine_user for p in own)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ring_in_stretches_by_plain_search(spark, parts):
    """One user holds most rows, so that its neighbours on the ring lie stretches away; a scene of one user has no pair."""
    rows = [(i, "u0" if i % 11 else f"u{i % 4}", "s" if i % 5 else "t", ["s"]) for i in range(220)] + [(900 + i, "u9", "alone", ["none"]) for i in range(3)]
    frame = spark.createDataFrame(rows, "row int, user string, scene string, top array<string>")
    place = {r[0]: int(hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()[:13], 16) for r in rows}
    want = set()
    for g, user, scene, _ in rows:
        others = sorted(((place[r] - place[g]) % (1 << 52), r) for r, u, s, _ in rows if s == scene and u != user)
        want |= {(g, r) for _, r in others[:1]}
    pairs = S.matched_impostors(frame, frame, "user", "row", "scene", "top", parts=parts)
    assert {(p.genuine_row, p.impostor_row) for p in pairs.where("matched_exact").collect()} == want


def test_dataset_is_written_only_if_sound(spark, tmp_path):
    rows = [(f"u{u}", f"u{u}s{s}", f"d{s}", "app", f"u{u}s{s}w{w}", "I1", ["I1"]) for u in range(3) for s in range(5) for w in range(3)]
    frame = spark.createDataFrame(rows, "user_id string, session_id string, day_id string, package_bucket string, window_id string, weak_label_top1 string, weak_label_topk array<string>")
    rows_split = S.make_split(frame, "leave_session_out", user="user_id", session="session_id")
    test = rows_split.where("split = 'test'")
    pairs = S.matched_impostors(test, test, "user_id", "window_id", "weak_label_top1", "weak_label_topk")
    audit = D.leakage_checks(rows_split, pairs, "user_id", "session_id", "day_id", "package_bucket", "window_id")
    assert all(audit.first().asDict().values())
    m = D.build_dataset(frame, "leave_session_out", str(tmp_path / "one"), split={"user": "user_id", "session": "session_id"}).first()
    assert m.n_train + m.n_val + m.n_test == len(rows) and m.n_pairs == m.n_exact == m.n_test and m.no_session_leak
    assert spark.read.parquet(str(tmp_path / "one" / "windows")).where("split = 'test'").count() == m.n_test == spark.read.parquet(str(tmp_path / "one" / "impostor_pairs")).count()
    leaking = rows_split.withColumn("split", F.when(F.col("window_id") == "u0s0w0", "test").otherwise(F.when(F.col("session_id") == "u0s0", "train").otherwise(F.col("split"))))
    assert not D.leakage_checks(leaking, pairs, "user_id", "session_id", "day_id", "package_bucket", "window_id").first().no_session_leak


def test_lz4_round_trip(spark):
    frame = spark.createDataFrame([("x" * 1000,), ("",), (None,)], "plain string")
    out = frame.withColumn("back", F.decode(I.lz4_decode(I.lz4_encode(F.encode("plain", "UTF-8"))), "UTF-8")).collect()
    assert [r.back for r in out] == [r.plain for r in out]


def test_canonical_text_forgets_order_and_space(spark):
    rows = spark.createDataFrame([('{"b": [2, 1], "a": {"y": 1, "x": "é"}}',), ('{"a":{"x":"é","y":1},"b":[2,1]}',), (None,)], "t string").select(I.canonical_text("t").alias("c")).collect()
    assert rows[0].c == rows[1].c == '{"a":{"x":"é","y":1},"b":[2,1]}' and rows[2].c is None


def test_batch_contract_reads_key_presence(spark):
    from loomstead.plans.study_queries import FINE

    text = FINE.replace("{device}", "a" * 64).replace("{id}", "0" * 12).replace("{x}", "1.0")
    cases = {"fine": text, "null key": text.replace('"class_name"', '"error":null,"class_name"'), "no touch list": json.dumps({k: v for k, v in json.loads(text).items() if k not in ("touch_events", "skip_events")}).replace('"touch_event_count": 1', '"touch_event_count": 0')}
    frame = spark.createDataFrame(list(cases.items()), "name string, plain string").withColumn("batch", F.from_json("plain", BATCH))
    assert {r.name: r.ok for r in frame.select("name", I.batch_ok().alias("ok")).collect()} == {"fine": True, "null key": False, "no touch list": True}
