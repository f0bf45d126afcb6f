"""Operator 12 against the library itself, prefix by prefix."""

import unicodedata

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstead.llm import queries, token_counts
from loomstead.llm.common import table
from oracle import DATA

LIBRARY = Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))

#: Contractions, marks, special strings whole and cut, letters that compose, grow or differ at word ends, other scripts.
PIECES = ["a", "th", "ing", "Hel", "lo", "'", "'s", "'RE", "’ll", " ", "  ", "\n", "\t", " ", "!", "??", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "9", "42", "é", "é", "́", "̸", "İ", "Σ", "ΟΔΟΣ", "я", "中文", "が", "が", "\U0001f600", "͸", "Ɤ", "՘", "\U00011de0", "한", "한", "\x00", "ﬁ", "Ω"]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def counted(text):
    found = list(token_counts.counter().portions(text))
    return "".join(f for f, _ in found), [0, *(int(n) for _, c in found for n in c)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@example("!!<|endoftext|>!! x")
@example("<|endoftext|≯'S")
def test_every_prefix(text):
    form, counts = counted(text)
    assert counts[-1] == library(text)
    assert counts == [library(form[:i]) for i in range(len(form) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text(text):
    assert counted(text)[1][-1] == library(text)


def test_words_by_merging(spark):
    """The table of a word is the library's encoding of each of its beginnings."""
    words = {w for r in table(spark, DATA, "documents").limit(40).collect() for w in r.text.split()}
    words = sorted(words)[:300] + ["x" * 700, "inging" * 50, "antidisestablishmentarianism"]
    for w in words:
        form, counts = counted(w)
        steps = range(len(form) + 1) if len(form) < 60 else range(0, len(form) + 1, 37)
        assert [counts[i] for i in steps] == [library(form[:i]) for i in steps]


def test_portions(monkeypatch):
    texts = ["one two  three ", " ", "   ", "a" * 50 + " b", "x y " * 40, "é <|endoftext|> 'twas " * 9]
    whole = [counted(t) for t in texts]
    for size in (1, 2, 3, 7, 20):
        monkeypatch.setattr(token_counts, "PORTION", size)
        assert [counted(t) for t in texts] == whole
    assert [w[0] for w in whole] == [unicodedata.normalize("NFC", t) for t in texts]


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    out = queries.op12_token_counts(spark, DATA).collect()
    assert len(out) == len(docs)
    for r in out:
        t = docs[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), library(t), library(t) > 2048)
        assert library(t[: r.fit_chars]) <= 2048 and (r.fit_chars == len(t)) >= (not r.over_limit)
    assert any(r.over_limit for r in out)


def test_rows(spark):
    rows = [(1, "It's  here"), (None, "It's  here"), (2, None), (3, ""), (1, "It's  here"), (4, "é <|endoftext|>"), (5, "wordlet " * 200_000)]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], "doc_id bigint, text string, n_tokens int, id string")
    out = token_counts.token_counts(docs).toPandas()
    assert sorted(out.n_tokens) == sorted(library(t or "") for _, t in rows)
    assert out.doc_id.isna().sum() == 1
    assert token_counts.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 3, 9, 10_000])
def test_truncation(spark, budget):
    texts = ["Unbelievably, it's been done again and again!", "antidisestablishmentarianism", "", "  x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = token_counts.prefix_counts(docs)
    out = kept.select("doc_id", token_counts.truncated(F.col("form"), F.col("counts"), budget).alias("t"), token_counts.count_at(F.col("counts"), 5).alias("five")).collect()
    for r in out:
        whole = texts[r.doc_id]
        assert r.five == library(whole[:5])
        assert r.t == whole[: max(i for i in range(len(whole) + 1) if library(whole[:i]) <= budget)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.integers(0, 12), st.sampled_from([2, 5, 1 << 19]))
def test_totals_and_budgets(text, budget, portion):
    own = token_counts.counter()
    token_counts.PORTION = portion
    form, counts = counted(text)
    assert own.count(text) == counts[-1]
    assert own.fitting(text, budget) == max(i for i, n in enumerate(counts) if n <= budget)
    token_counts.PORTION = 1 << 19


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 50)
    own = token_counts.Counter(public_tokenizers.path(token_counts.MODEL))
    text = " ".join(f"w{i}x{i * 7}" for i in range(400))
    assert own.count(text) == library(text)
    assert len(own.runs) <= 52 and len(own.words) <= 52 and own.merges.pairs <= 402
