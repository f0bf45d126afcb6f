"""Envelopes read from their texts: keys beyond the contract's, and missing ones, make them invalid."""

import json

from loomstead.sources.batches import envelopes_of
from test_rules_and_scores import envelope


def test_extra_keys_of_an_envelope(spark):
    from loomstead.operators import ingest as I

    rows = [json.dumps(envelope(b'{}')), json.dumps(envelope(b'{}') | {"note": 1}), "[1]", json.dumps({k: v for k, v in envelope(b'{}').items() if k != "rule_hash"})]
    frame = envelopes_of(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string").orderBy("i"))
    assert [r.reason for r in I.decoded(frame).select("reason").collect()] == [None, "invalid_envelope", "invalid_envelope", "invalid_envelope"]
