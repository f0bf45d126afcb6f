"""Operator 11 against SQL, a plain walk over characters, and the round trip."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomstead.llm import fill_in_middle as fim
from loomstead.llm import queries
from oracle import DATA, same


def by_hand(key, text):
    """The contract, a character at a time."""
    units, at = [], 0
    while at < len(text):
        end = at + 1
        while text[at].isascii() and text[at].isalpha() and end < len(text) and text[end].isascii() and text[end].isalpha():
            end += 1
        units.append(text[at:end])
        at = end
    n, digest = len(units), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(alphabet=st.sampled_from("abZ <>PSM\né\U0001f600\x00"), max_size=40))
def test_one_row(key, text):
    made = fim.Recipe().transform(str(key), text)
    assert made == by_hand(key, text)
    assert fim.restored(made[-1], made[1]) == text


def test_query(spark):
    same(queries.op11_fill_in_middle(spark, DATA), fim.ORACLE)


def test_rows(spark):
    long = "word " * 400_000
    rows = [(1, "ab c"), (None, "ab c"), (2, None), (3, ""), (4, "has <S> in it"), (5, "x<" * 9), (7, long), (7, long), (7, "other"), (8, "été \U0001f600 <P"), (9, "\r\n\x00 z")]
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id bigint, text string, form string, n int")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(fim.F.col("output"), fim.F.col("form"))).toPandas()
    assert len(out) == len(rows)
    want = sorted((repr(k), *map(repr, by_hand("" if k is None else k, t or ""))) for k, t in rows)
    none = lambda v: None if v is None or v != v else v if isinstance(v, str) else int(v)
    got = sorted((repr(none(r.doc_id)), *(repr(none(v)) for v in (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in out.itertuples())
    assert got == want
    assert sorted(out.back) == sorted(t or "" for _, t in rows)
    assert sorted(out.restored_sha256) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert len({re.sub("[0-9]", "", c) for c in fim.fill_in_middle(docs, outputs=False).columns}) == 7
