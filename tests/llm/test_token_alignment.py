"""Operator 13 against both libraries on whole texts, with plain loops over bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstead.llm import queries, token_alignment
from loomstead.llm.common import table
from loomstead.llm.token_counts import byte_letters
from oracle import DATA

A = Tokenizer.from_file(public_tokenizers.path(token_alignment.MODEL_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.MODEL_B))
NAME = {i: n for n, i in A.get_vocab().items()}
BYTE = {c: b for b, c in enumerate(byte_letters())}


def tokens(text):
    """[(id, start, end)] of A and of B over space+text, or two empty lists."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE[c] for c in NAME[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return tuple(out)


def by_hand(texts):
    held, each = Counter(), []
    for t in texts:
        a, b = tokens(t)
        owner = defaultdict(list)
        for j, (_, s, e) in enumerate(b):
            for p in range(s, e):
                owner[p].append(j)
        links = [(i, b[j][0]) for i, s, e in a for j in sorted({j for p in range(s, e) for j in owner[p]})]
        stops = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for stop in stops:
            groups.append(",".join(str(i) for i, s, e in a if low <= s < stop) + "|" + ",".join(str(i) for i, s, e in b if low <= s < stop))
            low = stop
        held.update(set(links))
        each.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(n_a, n_b, n_g, len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for n_a, n_b, n_g, links, g in each]


def compared(spark, texts, frame=None):
    docs = frame if frame is not None else spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = token_alignment.token_alignment(docs).collect()
    got = sorted(tuple(r)[1:] for r in out)
    assert got == sorted(by_hand(texts))
    return out


PIECES = ["a", "the", " the", "ing", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \r", ";\r", "'s", "é", "é", "▁", " ", "　", "中文", "\U0001f600", "<s>", "<0x41>", "<|endoftext|>", "\x00", "\x1f", "9", "2024", "!!", "(x)", "Wörter"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=10).map("".join), st.sampled_from([1, 4, 1 << 19]))
def test_one_text(text, portion):
    token_alignment.PORTION = portion
    totals, digests, keys, times = token_alignment.pair_of().align(["a", text, "a"])
    token_alignment.PORTION = 1 << 20
    want = by_hand([text])[0]
    assert (*totals[1].tolist(), digests[1]) == (*want[:4], want[6])
    a, b = tokens(text)
    links = Counter((i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e)
    own = keys % token_alignment.PLACES == 1
    pairs = keys[own] // token_alignment.PLACES
    assert {(int(p) // token_alignment.STEP, int(p) % token_alignment.STEP): int(n) for p, n in zip(pairs, times[own])} == links


def test_any_text():
    own = token_alignment.pair_of()

    @settings(max_examples=200, deadline=None)
    @given(st.text(min_size=1, max_size=30))
    def check(text):
        (totals, digests, _, _), want = own.align([text]), by_hand([text])[0]
        assert (*totals[0].tolist(), digests[0]) == (*want[:4], want[6])

    check()


def test_corpus(spark):
    texts = ["the cat sat on the mat", "the cat sat", "the dog; the cat", "a literal ▁ mark", "", None, "the cat sat", "x\n\ny  z", "unbelievable" * 30]
    compared(spark, texts)


def test_query(spark):
    docs = [r.text for r in table(spark, DATA, "documents").collect()]
    out = queries.op13_token_alignment(spark, DATA).collect()
    assert sorted(tuple(r)[1:] for r in out) == sorted(by_hand(docs))


def test_rows(spark):
    long = "lorem ipsum dolor " * 60_000
    texts = [long, "lorem", None, "", "lorem", "zzzz " * 500]
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (2, texts[3]), (None, texts[4]), (3, texts[5])]
    frame = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id bigint, text string, slice string, n_a int")
    own = token_alignment.pair_of()
    out = token_alignment.token_alignment(frame).collect()
    assert sorted((r.doc_id is None, r.n_a > 0) for r in out) == [(False, False), (False, False), (False, True), (False, True), (True, True), (True, True)]
    big = next(r for r in out if r.doc_id == 1)
    totals, _, _, times = own.align([long])
    assert (big.n_a, big.n_links) == (totals[0, 0], totals[0, 3]) == (len(A.encode(" " + long).ids), times.sum())
    assert token_alignment.token_alignment(frame.limit(0)).count() == 0
    assert by_hand(["lorem"])[0][:4] == next(tuple(r)[1:5] for r in out if r.doc_id is None)


def test_memory_of_a_worker_is_bounded(monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_BYTES", 4000)
    monkeypatch.setattr(token_alignment, "LESSON", 8)
    own = token_alignment.Pair(public_tokenizers.path(token_alignment.MODEL_A), public_tokenizers.path(token_alignment.MODEL_B))
    lessons, learn = [], own.learn
    monkeypatch.setattr(own, "learn", lambda chunks: (lessons.append(len(chunks)), learn(chunks)))
    texts = [" ".join(f"word{i * 40 + j}x" for j in range(40)) for i in range(20)]
    most = 0
    for text, want in zip(texts, by_hand(texts)):
        totals, digests, _, _ = own.align([text])
        assert (*totals[0].tolist(), digests[0]) == (*want[:4], want[6])
        most = max(most, own.learnt.bytes)
    assert max(lessons) <= 8 and most < 4000 + 40 * 400
    assert len(own.learnt.numbers) < 400  # of 800 different chunks
