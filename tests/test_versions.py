"""Versioned rules, dense codes, audits, and the sign test of many pairs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomstead.operators import audits, codes
from loomstead.operators import rule_versions as RV
from loomstead.operators import studies as D

GOOD = {"version": "1", "rules": [{"id": "e", "target": "text", "action": "REDACT", "pattern": "[0-9]+", "replacement": "#"}], "max_text_length": 20}


def frame(spark, *documents):
    return spark.createDataFrame([(i * 10, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "valid_from bigint, document string")


def test_problems(spark):
    rule = GOOD["rules"][0]
    documents = [
        GOOD, GOOD | {"version": " "}, GOOD | {"max_text_length": 0}, GOOD | {"rule_hash": "xyz"}, GOOD | {"rule_hash": "a" * 64},
        GOOD | {"rules": [rule | {"pattern": "("}, rule | {"id": "p", "pattern": None}, rule | {"id": "t", "target": "screen"}, rule | {"id": "a", "action": "ALLOW", "pattern": None}]}, "[1]", {"version": "2"},
    ]
    got = {r.valid_from: r for r in RV.rule_versions(frame(spark, *documents)).collect()}
    want = [[], ["version_missing"], ["max_text_length_below_one"], ["rule_hash_malformed"], [], ["pattern_does_not_compile:e", "pattern_required:p", "unknown_target_or_action:t"]]
    assert [got[i * 10].problems for i in range(6)] == want
    assert "not_an_object" in got[60].problems and got[70].problems == [] and got[70].max_text_length == RV.DEFAULT_LENGTH
    # a version holds until the next fine one; what is sent along does not change the hash
    assert (got[0].valid_to, got[40].valid_to, got[70].valid_to, got[10].valid_to) == (40, 70, None, None)
    assert got[0].rule_hash == got[40].rule_hash != got[70].rule_hash


def test_rows_by_their_own_version(spark):
    allow = {"id": "keep", "target": "text", "action": "ALLOW", "pattern": "public"}
    later = {"version": "2", "rules": [allow, {"id": "w", "target": "text", "action": "DROP", "pattern": "secret"}, {"id": "n", "target": "node", "action": "DROP", "pattern": "."}, GOOD["rules"][0] | {"replacement": "<$0>"}], "max_text_length": 12}
    versions = RV.rule_versions(frame(spark, GOOD, later))
    rows = spark.createDataFrame([(-1, "before"), (0, "call 555 or 77"), (9, "x" * 30), (10, "call 555 or 77"), (11, "a secret 1"), (12, "public secret 1"), (5_000_000, "99"), (3, None)], "at bigint, text string")
    held = RV.with_version(rows, versions, "at", 1_000_000)
    out = held.select("at", "rule_version", RV.redacted(F.col("text"), F.col("_rules"), F.col("_max_length"), RV.most_rules(versions)).alias("t"))
    assert sorted(map(tuple, out.collect())) == [(0, "1", "call # or #"), (3, "1", None), (9, "1", "x" * 20), (10, "2", "call <555> o"), (11, "2", ""), (12, "2", "public secre"), (5_000_000, "2", "<99>")]


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_dense_codes(spark, ranges):
    values = [f"u{i * i % 997}" for i in range(400)] + [None, "", "zz", "é"]
    df = spark.createDataFrame([(v,) for v in values * 2], "v string").repartition(3)
    out = codes.dense_codes(df, "v", ranges)
    want = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    assert {r.value: r.code for r in out.collect()} == want
    assert ranges == 1 or "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()  # no window over all rows
    coded = codes.with_codes(df, out, "v", "code").where("v IS NULL OR v = 'zz'").select("v", "code").distinct().collect()
    assert {r.v: r.code for r in coded} == {None: None, "zz": want["zz"]}
    numbers = spark.range(50).select((F.col("id") * 3 % 17).alias("n"))
    assert {r.value: r.code for r in codes.dense_codes(numbers, "n", ranges).collect()} == {i: i for i in range(17)}
    assert codes.dense_codes(numbers.limit(0), "n", ranges).count() == 0


def test_audits(spark):
    node = "struct<password:boolean,text:string,text_redacted:string>"
    rows = [("a", [(True, None, "")]), ("a", [(False, "", "<EDITABLE_TEXT_DROPPED>"), (None, "x", "y")]), ("b", [(False, None, None)]), ("c", None), ("d", [])]
    out = {r.k: r for r in audits.privacy_audit(spark.createDataFrame(rows, f"k string, n array<{node}>"), "k", "n").collect()}
    assert (out["a"].n_nodes, out["a"].n_bad, out["a"].leaks, out["a"].violated) == (3, 2, ["password", "text", "text_redacted"], True)
    assert [(out[k].n_nodes, out[k].violated) for k in "bcd"] == [(1, False), (0, False), (0, False)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "d string")
    kinds = [audits.provenance(ids(*d), ids("x", "y"), "d").first().provenance for d in (("x",), ("q", "r"), ("x", "q"), ())]
    assert kinds == ["synthetic", "captured", "mixed", "unknown"]
    runs = spark.createDataFrame([("m1", 3, False), ("m2", 3, True), ("m3", 60, None), ("m4", None, None)], "m string, epochs int, early boolean")
    assert sorted(r.m for r in audits.under_trained(runs, "epochs", 100, "early").collect()) == ["m1", "m4"]


@pytest.mark.parametrize("wins,losses", [(700, 400), (1600, 1400), (5, 2), (5000, 5000)])
def test_sign_test_of_many_pairs(spark, wins, losses):
    rows = spark.range(wins + losses).select(F.when(F.col("id") < wins, 1.0 + F.col("id")).otherwise(-0.5 - F.col("id")).alias("d"))
    got = D.paired_tests(rows, "d").first().p_sign
    n, low = wins + losses, min(wins, losses)
    want = min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(low + 1)))
    assert got == pytest.approx(want, rel=1e-6)
