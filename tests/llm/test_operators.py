"""Each corpus operator on the defined cases (nulls, empty and long texts, ties, repeats, empty tables, clashing columns)
and against brute force on a small fixture."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import jaccard_join, line_dedup, media_columns, mixture, page_wrappers, piece_sampling, quality_rules, secret_scan, site_quality, suffix_dedup
from loomstead.llm import queries as Q
from loomstead.llm.components import components
from loomstead.llm.suffix_sort import Block
from oracle import DATA, same

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int = 1) -> list[tuple]:
    """A few dozen documents with copies, near copies, shared passages, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstuvé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(60)
    texts = ["\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))) for _ in range(24)]
    texts += [texts[0], texts[1], texts[1], texts[2] + " tail", texts[3].replace(" ", "  ", 2)]
    texts += [texts[i] + "\n" + passage for i in (4, 5, 6)] + [passage]
    texts += [None, "", " \t\n ", "word", "Two Words", "a b c", "ab " * 300, "x" * 500, "▁▁ lower ▁ one\n\n", "same line here again\n" * 9, "\n".join(line(30) for _ in range(120))]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [(None, "a null key", "de", "src1", 10)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """The same with columns under names that operators use inside."""
    extra = ["id", "rid", "key", "th", "_t", "_w", "_row", "_keep", "w", "votes", "n_words", "label", "p", "kept", "gone", "topic", "h", "component"]
    return docs.withColumns({c: F.lit("clash") for c in extra})


def by_id(rows):
    return {r.doc_id: r for r in rows}


ALL = {
    "line_dedup": lambda d: line_dedup.line_dedup(d),
    "without_repeats": lambda d: line_dedup.without_repeats(d),
    "secret_scan": lambda d: secret_scan.secret_scan(d),
    "mixture": lambda d: mixture.mixture(d),
    "sampled": lambda d: mixture.sampled(d),
    "suffix_dedup": lambda d: suffix_dedup.suffix_dedup(d),
    "site_quality": lambda d: site_quality.site_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
    "jaccard": lambda d: jaccard_join.jaccard_components(d),
    "one_of_each": lambda d: jaccard_join.one_of_each(d),
    "encode": lambda d: piece_sampling.encode(d),
    "main_text": lambda d: page_wrappers.main_text(d, "doc_id", "source", "text"),
    "media": lambda d: media_columns.media_columns(d),
    "quality_rules": lambda d: quality_rules.quality_rules(d),
    "keep_good": lambda d: quality_rules.keep_good(d),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, name):
    assert ALL[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_clashing_columns_change_nothing(docs, clash, name):
    plain, odd = ALL[name](docs), ALL[name](clash)
    shared = [c for c in plain.columns if c in odd.columns and c not in ("_row",) and dict(odd.dtypes)[c] == dict(plain.dtypes)[c]]
    assert plain.count() == odd.count()
    rows = lambda d: sorted(map(repr, d.select(*[F.col(f"`{c}`") for c in shared]).collect()))
    if name not in ("sampled", "keep_good", "one_of_each", "line_dedup", "without_repeats"):
        assert rows(plain) == rows(odd)


def lines_to_go(texts):
    """By the rule alone: positions inside common runs of 60 characters or more with an earlier text (texts in order)."""
    lines = [(t or "").split("\n") for t in texts]
    out = []
    for n, mine in enumerate(lines):
        gone = set()
        for other in lines[:n]:
            for i in range(len(mine)):
                for j in range(len(other)):
                    k = 0
                    while i + k < len(mine) and j + k < len(other) and mine[i + k] == other[j + k]:
                        k += 1
                    block = mine[i : i + k]
                    if sum(map(len, block)) >= 60 and any(x.strip(" \t\n\x0b\x0c\r") for x in block):
                        gone |= set(range(i, i + k))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup_by_brute_force(spark, docs, seed):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = [(r.doc_id, r.text) for r in rows]
    rng = random.Random(seed)
    pool = ["", " ", *(c * n for c in "abcdef" for n in (5, 25, 40, 70))]
    texts += [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = {r.doc_id: r for r in line_dedup.line_dedup(frame).collect()}
    for (i, text), gone in zip(texts, lines_to_go([t for _, t in texts])):
        assert out[i]._n_removed == len(gone)
        if text is not None:
            assert out[i].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def test_line_dedup_of_two_frequent_lines(spark):
    a, b = "first line of the block " + "a" * 12, "second line of the block " + "b" * 12
    texts = [a, b] + [f"{a}\n{b}"] * 6
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [out[i] for i in range(8)] == texts[:3] + [""] * 5


def test_line_dedup_finds_blocks_of_frequent_lines(spark):
    # each line is frequent and has a first holder of its own; the block of three is 72 characters, its lines are shorter than the bound
    block = [f"menu line {c} " + c * 12 for c in "abc"]
    texts = [f"own {i}\n{block[i % 3]}\ntail {i}" for i in range(18)] + [f"own {i}\n" + "\n".join(block) + f"\ntail {i}" for i in range(20, 28)]
    assert sum(map(len, block)) >= line_dedup.MIN_CHARS > sum(map(len, block[:2]))
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [out[i].text for i in range(19)] == texts[:19]
    assert [out[i].text for i in range(19, 26)] == [f"own {i + 2}\ntail {i + 2}" for i in range(19, 26)]


def test_runs_cover_every_block():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        sizes = rng.integers(0, 80, n)
        whole = set(zip(*(x.tolist() for x in line_dedup.shortest_runs(sizes, sizes > 0, 60))))
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        start, end = line_dedup.shortest_runs(sizes[a:b], sizes[a:b] > 0, 60)
        assert whole >= {(i + a, j + a) for i, j in zip(start.tolist(), end.tolist())}
        if sizes[a:b].sum() >= 60:
            assert {x for i, j in zip(start.tolist(), end.tolist()) for x in range(i, j)} == set(range(b - a))


def test_patience_finds_moved_blocks():
    a, b = list("xABCyDEF"), list("DEFzABC")
    assert line_dedup.common_blocks(a, b, [10] * 8, [True] * 8, 30) == [1, 2, 3, 5, 6, 7]
    assert line_dedup.common_blocks(a, b, [10] * 8, [True] * 8, 31) == []


def candidates_of(text):
    """Word index and candidate by the rule, in plain Python."""
    out = []
    w = re.split("[ \\t-\\r]+", text or "")
    plain = lambda p: p.replace("(?i)", "")
    for i, x in enumerate(w):
        b1, b2 = w[i - 1] if i else "", w[i - 2] if i > 1 else ""
        inside = re.search(plain(secret_scan.IN_WORD), x, re.I)
        value = inside[1] if inside else None
        if not value and (there := re.search("://[^/\\s:@]*:([^/\\s@]{4,})@", x)):
            value = there[1]
        if not value and (re.search(f"^(?:{secret_scan.ASSIGNS})$", b1) and re.search(plain(secret_scan.NAMES) + "$", b2, re.I) or re.search(plain(secret_scan.NAMES) + f"(?:{secret_scan.ASSIGNS})$", b1, re.I)):
            m = re.search(secret_scan.VALUE, x)
            value = m[1] if m else None
        out += [(i, value, True)] if value else []
        said = b1.lower() in ("is", "is:") and re.search(plain(secret_scan.NAMES) + "$", b2, re.I)
        front = re.match("[A-Za-z0-9+/_=-]*", value or "")[0]
        for c in re.findall(secret_scan.CANDIDATE, x):
            if (said or re.search("[0-9]", c)) and not (value and c in value) and not (front and "=" + front in c):
                out.append((i, c, False))
    return out


def test_secret_candidates_by_brute_force(spark, docs):
    extra = ['password = "hunter2!" x', "the token: abcd.efgh@ijk", "api_key=short1 and pwd:=zz", 'a["secret"]=>value9', "key = a", "token = deadbeefdeadbeef1234 token", "x" * 20 + "1", "my secret is in the auth", "password=", "= : token", "aws_secret_access_key=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY end", "postgres://user:pa55w0rd@host/db", "see http://host:8080/a@b", "the token is abcdefghijklmnopqrst now", "the key is that", "my_token_a=b$cd ef", "secret=ab12cd,key_of_things=ab12cdef12345678"]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None] + [(1000 + i, t) for i, t in enumerate(extra)]
    rows += [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = secret_scan.candidates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = sorted((i, *c) for i, t in rows for c in candidates_of(t))
    assert sorted((r.doc_id, r.word_index, r.candidate, r.assigned) for r in found) == want


def test_secret_scan_on_labelled_findings(spark):
    # rows of another seed: says how well the forest knows its own kinds, not how well it does on documents
    words = secret_scan.corpus_words(spark.read.parquet(f"{DATA}/documents.parquet"))
    model = secret_scan.train(secret_scan.labelled_findings(spark, words=words.frequent), words)
    held_out, names = secret_scan.with_features(secret_scan.labelled_findings(spark, 3000, seed=99, words=words.frequent), words)
    scored = model.transform(secret_scan.VectorAssembler(inputCols=names, outputCol="features").transform(held_out))
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_secret_scan_finds_what_is_planted(spark):
    """The tables plant token assignments, and card, phone and account numbers that are no secrets."""
    frame = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    planted = {(r.doc_id, s) for r in frame.collect() for s in re.findall(r'token = "([0-9a-f]{40})"', r.text or "")}
    out = secret_scan.secret_scan(frame).collect()
    found = {(r.doc_id, r.candidate) for r in out if r.is_secret}
    assert len(planted & found) >= 0.98 * len(planted) and planted
    assert len(found - planted) <= 0.05 * len(planted)


def test_one_candidate_a_value_and_passwords_of_addresses(spark):
    rows = [(1, "aws_secret_access_key=wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"), (2, "use postgres://user:pa55w0rd@host/db here"), (3, "token is abcdefghijklmnopqrst now")]
    found = {(r.doc_id, r.candidate) for r in secret_scan.candidates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {(1, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"), (2, "pa55w0rd"), (3, "abcdefghijklmnopqrst")}


def test_words_of_the_dictionary_are_found_by_their_first_letters(spark):
    known = ["there", "then", "article", "zone"]
    rows = spark.createDataFrame([(w,) for w in [*known, "the", "thenx", "artic", "zon", "", "other", "them"]], "w string")
    found = {r.w for r in rows.where(secret_scan._in_dictionary(F.col("w"), known)).collect()}
    assert found == set(known)


def test_secret_scan_keeps_numbers_and_links_out(spark):
    secret = hashlib.sha1(b"1").hexdigest()
    rows = [(1, f'token = "{secret}" and more'), (2, "call 4952935900253052 now"), (3, "see https://example.com/how-to-article-2024/page-123456 there"), (4, None), (5, ""), (6, 'password = "hX7!kq29" here'), (7, "password = required here"), (1, f'token = "{secret}" and more')]
    rows += [(i, " ".join(f"word{'abcdefghij'[j % 10]} article report release there" for j in range(30))) for i in range(20, 40)]
    out = secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.candidate for r in out if r.is_secret} == {secret, "hX7!kq29"}
    assert sum(r.candidate == secret for r in out) == 2 and {r.doc_id for r in out} == {1, 2, 3, 6, 7}


def filled_targets(have: dict, power: float, budget: float) -> dict:
    """Tokens that each category should give: shares to a power, no category more than it has."""
    total, spent = budget * sum(have.values()), set()
    while True:
        left = {c: v**power for c, v in have.items() if c not in spent}
        rate = (total - sum(have[c] for c in spent)) / sum(left.values())
        more = {c for c in left if left[c] * rate >= have[c]}
        if not more:
            return {c: have[c] if c in spent else left[c] * rate for c in have}
        spent |= more


@pytest.mark.parametrize("budget", [0.3, 0.5])
def test_mixture_meets_targets(spark, budget):
    rows = mixture.measured(spark.read.parquet(f"{DATA}/documents.parquet"), carry=False)
    cells = mixture.fit(rows, budget).toPandas()
    drawn = cells.tokens * cells.p
    assert cells.p.between(0, 1).all() and abs(drawn.sum() - budget * cells.tokens.sum()) < 1e-6 * drawn.sum()
    assert cells.margin_error.max() <= mixture.TOLERANCE
    for m, power in mixture.POWERS.items():
        wanted = filled_targets(cells.groupby(m).tokens.sum().to_dict(), power, budget)
        for category, got in drawn.groupby(cells[m]).sum().items():
            assert got == pytest.approx(wanted[category], rel=1e-6)


def test_mixture_given_targets(spark):
    rows = mixture.measured(spark.read.parquet(f"{DATA}/documents.parquet"), carry=False)
    cells = mixture.fit(rows, 0.05, {"topic": {"long": 0.9}}).toPandas()
    drawn = cells.tokens * cells.p
    assert drawn[cells.topic == "long"].sum() / drawn.sum() == pytest.approx(0.9, rel=1e-6)
    dealt = mixture.fit(rows, 0.05, {"topic": {"long": 0.9}}, cells_in_one=0).toPandas()
    keys = ["source", "lang", "topic"]
    assert np.allclose(cells.sort_values(keys).p, dealt.sort_values(keys).p)


def test_mixture_tells_of_targets_that_cannot_be_met(spark):
    # source a holds all of topic x: half of the tokens from a and a tenth from x cannot be
    rows = spark.createDataFrame([("a", "en", "x", 100), ("b", "en", "y", 100)], "source string, lang string, topic string, n_tokens bigint")
    cells = mixture.fit(rows, 0.5, {"source": {"a": 0.5, "b": 0.5}, "topic": {"x": 0.1, "y": 0.9}}).toPandas()
    assert cells.margin_error.max() > 0.1


def test_mixture_takes_a_topic_column(docs):
    out = mixture.mixture(docs.withColumn("about", F.expr("CASE WHEN doc_id > 4 THEN doc_id % 2 END")), topic="about")
    assert {r.topic for r in out.select("topic").distinct().collect()} == {"0", "1", "(none)"}


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_by_brute_force(docs, hot):
    size = 40
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[i : i + size] for _, b in rows for i in range(len(b) - size + 1))
    for r in suffix_dedup.suffix_dedup(docs, length=size, k=17, hot=hot).collect():
        body = dict(rows)[r.doc_id]
        keep = bytearray(b"\1" * len(body))
        for i in range(len(body) - size + 1):
            if seen[body[i : i + size]] > 1:
                keep[i : i + size] = bytes(size)
        kept = bytes(x for x, k in zip(body, keep) if k)
        spans = sum(1 for i in range(len(body)) if not keep[i] and (i == 0 or keep[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_keeps_what_is_unique_between_repeats(spark):
    # the smallest hash lies in the fixed part of every line, so the first text is one context: its ends repeat, its middle does not
    fixed = hashlib.sha512(b"6").hexdigest()[:100]
    line = lambda i: f"{fixed}{i:08d}\n"
    head, middle, tail = ("".join(line(i) for i in ids) for ids in (range(4), range(100, 112), range(200, 204)))
    rows = list(enumerate([head + middle + tail, head, tail, middle.replace("1", "7")]))
    whole = np.frombuffer(rows[0][1].encode(), np.uint8)
    assert len(suffix_dedup.minimizer_runs(whole, np.array([0, len(whole)]))[0]) == 1
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = rows[r.doc_id][1]
        gone = {i + j for i in range(len(text) - 199) if seen[text[i : i + 200]] > 1 for j in range(200)}
        assert r.kept_text == "".join(c for i, c in enumerate(text) if i not in gone)
        assert r.n_removed == len(gone) and (r.doc_id > 0 or r.n_spans == 2)


def test_suffix_array_order():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abA") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        ends = np.cumsum([len(s) for s in strings])
        block = Block(np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], ends)))
        order = block.suffix_array(40)
        body = bytes(block.text)
        suffixes = [body[i : i + block.rest[i]] for i in order if block.rest[i]]
        assert suffixes == sorted(suffixes, key=lambda s: s + b"\0")
        assert len(order) == len(body)


def test_page_text(spark):
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav class=m><ul><li>A<li>B</ul></nav><div class="ad x">buy</div>
    <article><h1>T &amp; U</h1><p>One <b>bold</b>  text<br>more<p>Two &lt;x&gt;<aside>no</aside><form>f</form><script>var x="</p>"</script><table><tr><td>a<td>b</table>
    <section class="comments"><p>hi</section></article><footer>foot</footer>"""
    rows = [(1, "http://h.example.com/a", page), (2, None, None), (3, "x", ""), (4, "http://h.example.com/b", "<p>plain"), (4, "http://h.example.com/b", "<p>plain"), (5, "http://h/", "<div>" * 5000 + "deep"), (6, "http://h/", "a < b & c <")]
    out = page_wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in out] == ["T & U\nOne bold text more\nTwo <x>\na\nb", "", "", "plain", "plain", "deep", "a < b & c <"]
    assert all(r.n_chars == len(r.text) for r in out)


def test_page_template_text_goes(spark):
    page = lambda i: f"<body><div class=wrap><div class=top>Our site says hello</div><div class=story><h2>Title {i}</h2>" + "".join(f"<p>Paragraph {i} {j}</p>" for j in range(i + 2)) + "</div></div></body>"
    rows = [(i, f"http://s.example.org/{i}", page(i)) for i in range(6)]
    out = page_wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    for i, r in enumerate(out):
        assert r.text == "\n".join([f"Title {i}", *(f"Paragraph {i} {j}" for j in range(i + 2))])


def test_long_template_text_goes(spark):
    notice = " ".join(f"legal{i}" for i in range(400))
    story = lambda i: " ".join(f"story{i}x{j}" for j in range(90))
    rows = [(i, f"http://l.example.org/{i}", f"<body><div class=wrap><div class=legal>{notice}</div><div class=story><p>{story(i)}</p></div></div></body>") for i in range(4)]
    out = page_wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: story(i) for i in range(4)}


def test_copies_of_a_page_are_no_template(spark):
    copy = lambda i: f"<body><script>{i}</script><article><h1>Head</h1><p>Only paragraph</p></article></body>"
    near = lambda i: f"<body><article><h1>Head</h1><p>Only paragraph</p><p>seen {i}</p></article></body>"
    plain = lambda i: f"<body><!--{i}--><div><h1>Head</h1><p>Only paragraph</p></div></body>"
    quote = lambda i: f"<body><div><h2>Title {i}</h2>{'<blockquote>Quoted</blockquote>' if not i else ''}<p>Paragraph {i}</p></div></body>"
    pages = [*(("copy", copy(i)) for i in range(4)), *(("near", near(i)) for i in range(4)), *(("plain", plain(i)) for i in range(4)), *(("quote", quote(i)) for i in (0, 0, 0, 1, 2, 3))]
    rows = [(i, f"http://{host}.example.org/{i}", page) for i, (host, page) in enumerate(pages)]
    out = {r.page_id: r.text for r in page_wrappers.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    body = "Head\nOnly paragraph"
    assert [out[i] for i in range(18)] == [body] * 4 + [f"{body}\nseen {i}" for i in range(4)] + [body] * 4 + ["Title 0\nQuoted\nParagraph 0"] * 3 + [f"Title {i}\nParagraph {i}" for i in (1, 2, 3)]


def test_page_nesting_beyond_the_limit():
    deep = "<div>" * 70 + "deep<nav>menu<div>more menu</div></nav>text" + "</div>" * 70
    page = f"<body><div class=wrap><article><p>first</p>{deep}<p>last</p></article></div><p>outside</p></body>"
    assert text_of(page) == "first\ndeep\ntext\nlast"
    assert text_of("<div>" * 70 + "a<p>b<p>c<div>d</div>e") == "a\nb\nc\nd\ne"


def text_of(page):
    """A page for itself: what it marks as its main part, else all blocks."""
    text, blocks = page_wrappers.read_page(page)
    return "\n".join(b.words for b in blocks) if text is None else text


def texts_of(spark, pages, parts=None):
    frame = spark.createDataFrame([(i, f"http://{host}.example.org/{i}", page) for i, (host, page) in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in page_wrappers.main_text(frame.repartition(parts) if parts else frame).collect()}


def test_articles_keep_what_names_and_templates_speak_against(spark):
    assert text_of('<article><h1>T</h1><p class="notice">one</p><div id="search-results">two</div><span class="share-price">three</span></article>') == "T\none\ntwo\nthree"
    assert text_of('<body><div id="menu-item-text">only text</div></body>') == "only text"
    assert text_of('<body><div class="menu">only text</div></body>') == "only text"
    assert text_of("<main><p>intro</p><article>card</article><p>body</p></main>") == "intro\ncard\nbody"
    assert text_of('<body><main><p>story</p></main><article class="comment">first!</article></body>') == "story"
    assert text_of('<body><article><p>story</p><section class="comments-area"><article class="comment"><p>long reply</p></article></section></article></body>') == "story"
    assert text_of('<article>a<span class="ad">b<span>c</span>d</span>e</article>') == "ae"
    assert text_of("<html><head><title>never closed</head><body><article>text</article></body></html>") == "text"
    assert text_of('<article><p>a<span class="ad">never closed</p><p>b</p></article>') == "anever closed\nb"
    shared = "<article><h2>Summary</h2><p>One story in all pages</p></article>"
    assert set(texts_of(spark, [("s", f"<body><ul class=m><li>menu {i}<li>menu {i + 1}</ul>{shared}</body>") for i in range(4)]).values()) == {"Summary\nOne story in all pages"}


def test_broken_tags_take_linear_time():
    import time

    for broken in ("<a " * 100_000, '<a title="' * 30_001, "<textarea>" * 30_000, '<span class="ad">' * 30_000, "<!-- " * 50_000, '<p a=\'">' * 30_001):
        began = time.time()
        page_wrappers.read_page(broken)
        assert time.time() - began < 6


def plain_host(seed, n=9):
    """Pages of a host without a marked article: a menu, an optional banner, a legal text longer than the stories, links that vary."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    legal, menu = words(150), "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(5))
    pages, wanted = [], []
    for i in range(n):
        paragraphs = [words(rng.randint(8, 30)) for _ in range(rng.randint(1, 5))]
        banner = f"<div>{words(3)}</div>" if i % 3 == 0 else ""
        more = "".join(f"<li><a href=/x>{words(4)}</a></li>" for _ in range(12))
        pages.append(f"<body><div><ul>{menu}</ul></div>{banner}<div><h1>Story {i}</h1><h2>Summary</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div>Share this<ul><li>One</li><li>Two</li></ul></div></div><div><ul>{more}</ul></div><div>{legal}</div></body>")
        wanted.append("\n".join([f"Story {i}", "Summary", *paragraphs]))
    return pages, wanted


def test_wrappers_find_the_main_part_of_unmarked_pages(spark):
    for seed in range(3):
        pages, wanted = plain_host(seed)
        got = texts_of(spark, [("w", p) for p in pages])
        assert [got[i] for i in range(len(pages))] == wanted
    # without other pages of the host there is no wrapper
    assert texts_of(spark, [("w", pages[0])])[0].endswith(pages[0].split("<div>")[-1].split("<")[0])


def test_wrappers_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(8)
    pages = [("w", p) for p in plain_host(1)[0]] + [("v", f"<div><p>{rng.choice('abc')}</p>{'<ul><li>x</ul>' * rng.randint(0, 2)}<p>{i % 4}</p></div>") for i in range(20)]
    one = texts_of(spark, pages)
    assert one == texts_of(spark, pages, 1) == texts_of(spark, pages, 7)
    shuffled = list(enumerate(pages))
    rng.shuffle(shuffled)
    again = texts_of(spark, [p for _, p in shuffled])
    assert {i: again[j] for j, (i, _) in enumerate(shuffled)} == one


def test_pages_without_their_article_tags(spark):
    """The tables' pages with plain elements for article, nav, footer and adverts, so that nothing but the wrapper can tell."""
    frame = spark.read.parquet(f"{DATA}/pages.parquet")
    bare = frame.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"), '<div class="ad">', "<div>"))
    truth = {r.page_id: r.text for r in page_wrappers.main_text(frame).collect()}
    hosts = Counter(r.url.split("/")[2] for r in frame.collect())
    known = {r.page_id for r in frame.collect() if hosts[r.url.split("/")[2]] >= 6}
    got = {r.page_id: r.text for r in page_wrappers.main_text(bare).collect()}
    assert all(truth[i] in got[i] for i in got)  # no article text goes
    assert not known or sum(got[i] == truth[i] for i in known) >= 0.9 * len(known)


def test_pages_of_the_tables_match_their_markup(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in Q.op5_page_wrappers(spark, DATA).collect():
        body = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?p>|</?h\d>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def shingles(text, k):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_jaccard_by_brute_force(spark, docs):
    rng = random.Random(4)
    base = " ".join(f"w{i}" for i in range(60)).split()
    near = []
    for i in range(40):  # near copies of one text, some of them only near each other
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"v{rng.randrange(5)}"
        near.append((1000 + i, " ".join(w), "en", "s", 1))
    frame = docs.union(spark.createDataFrame(near, SCHEMA)).where("doc_id IS NOT NULL")
    sets = {r.doc_id: shingles(r.text, 4) for r in frame.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in jaccard_join.jaccard_components(frame).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_labels_merge_as_if_all_links_were_there(spark):
    rng = random.Random(5)
    first, more = ([(rng.randrange(40), rng.randrange(40)) for _ in range(n)] for n in (14, 12))
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    merged = {r.id: r.component for r in jaccard_join._merged(components(frame(first)), frame(more)).collect()}
    assert merged == {r.id: r.component for r in components(frame(first + more)).collect()}


def test_index_keys_never_miss():
    rng = np.random.default_rng(6)
    bands = jaccard_join.Bands(85, 100)
    for n in [7, 9, 12, 20, 33, 60, 120, 300, 900]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = a.copy()
            while True:  # change as much as the threshold lets
                c = np.unique(np.concatenate((np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, int(rng.integers(0, 2)), dtype=np.uint64))))
                common = len(np.intersect1d(a, c))
                if 100 * common < 85 * (len(a) + len(c) - common):
                    break
                b = c
            if np.array_equal(a, b):
                continue
            assert len(np.intersect1d(jaccard_join.index_keys(a, bands), jaccard_join.index_keys(b, bands)))
            most = (len(a) + len(b)) * 15 // 185
            assert jaccard_join.sketch_distance(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= most


def test_one_of_each_keeps_the_smallest(docs):
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs).collect()}
    assert 0 in kept and 24 not in kept and 25 not in kept and 26 not in kept
    assert {33, 34, 35} <= kept  # null and blank texts


def test_one_of_each_of_repeated_and_keyless_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, "a"), (1, body, "b"), (None, body + " tail", "c"), (None, "other words than those of all the rest here", "d"), (None, "other words than those of all the rest here", "e"), (2, "", "f"), (2, "", "f"), (3, None, "g")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, x string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, rows[3][1]), (1, body), (2, ""), (3, "")]


def test_cut_tables_can_be_cleared(spark):
    from loomstead.llm import common

    frame = common.cut(spark.range(5))
    assert frame.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(frame.inputFiles()[0]).getParent()
    common.clear(spark)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60), (None, 3)], "a bigint, b bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {60: 60, 61: 60}


def test_pieces_decode_to_the_text(docs):
    out = piece_sampling.encode(docs).withColumn("back", piece_sampling.decode(F.col("pieces"))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.lossless and r.back == (texts[r.doc_id] or "") and r.n_pieces == len(r.pieces) for r in out)


def test_pieces_do_not_depend_on_partitioning(docs):
    rows = lambda d: {r.doc_id: r.pieces for r in piece_sampling.encode(d).collect()}
    assert rows(docs.coalesce(1)) == rows(docs.repartition(7))
    assert rows(docs) != {r.doc_id: r.pieces for r in piece_sampling.encode(docs, seed=1).collect()}


def test_piece_frequencies_follow_the_lattice():
    v = piece_sampling.Vocabulary.load()
    word, n = b"thing", 20000
    ids, bounds = piece_sampling.sample(np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word), np.arange(n), v, 7)
    drawn = Counter(tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    known = {p: i for i, p in enumerate(v.pieces) if p and not (len(p) == 1 and v.byte_ids[p[0]] == i)}
    ways = {}

    def spell(at, seq, weight):
        if at == len(word) + 1:
            ways[seq] = np.exp(weight)
        for end in range(at + 1, len(word) + 2):
            if (p := (b" " + word)[at:end]) in known:
                spell(end, (*seq, known[p]), weight + v.weights[known[p]])

    spell(0, (), 0.0)
    total = sum(ways.values())
    for seq, p in ways.items():
        assert abs(drawn[seq] / n - p / total) < 0.015


def test_media_round_trip(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in media_columns.media_columns(docs).collect():
        body = (texts[r.doc_id] or "").encode()
        padded = body + bytes(-len(body) % 64 if body else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = bytes(r.media)
        assert media[-len(padded) :] == padded
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        first = r.keyframe_offsets[0]
        assert media[first : first + r.keyframe_sizes[0]] == padded[:64]
        assert r.duration_seconds == len(padded) / 8000


def test_media_index_of_anything():
    assert media_columns.index_media(b"") == [] and media_columns.index_media(b"no boxes here, only text" * 9) == []
    whole = media_columns.store_payload(bytes(range(256)) * 700)
    assert media_columns.read_payload(whole, media_columns.index_media(whole)[0]) == bytes(range(256)) * 700
    for cut in range(0, 900, 7):
        media_columns.index_media(whole[:cut])


def test_media_index_of_broken_boxes():
    import struct

    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    short = box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", bytes(10)))))
    assert media_columns.index_media(short)[0].timescale == 0
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    assert media_columns.index_media(deep) == []
    huge = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsz", struct.pack(">III", 0, 1, 2**32 - 1)), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 2**32 - 1, 1)), box(b"stco", struct.pack(">III", 0, 1, 8)))))))
    track = media_columns.index_media(huge)[0]
    assert len(track.sizes) <= len(huge) and len(track.offsets()) <= len(huge)
    rng, whole = random.Random(3), media_columns.store_payload(bytes(64 * 3000))
    for _ in range(300):  # whatever bytes change, the walk ends and reads within the file
        broken = bytearray(whole[: rng.randint(0, 1200)])
        for _ in range(rng.randint(1, 8)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.randrange(256)
        for t in media_columns.index_media(bytes(broken)):
            t.keyframes()
            media_columns.read_payload(bytes(broken), t)


def test_media_fragments():
    import struct

    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    head = box(b"moov", box(b"trak", box(b"tkhd", struct.pack(">IIII", 0, 0, 0, 7))), box(b"mvex", box(b"trex", struct.pack(">6I", 0, 7, 1, 1, 0, 0x10000))))
    run = lambda offset: box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 7)), box(b"trun", struct.pack(">IIiI", 0x205, 3, offset, 0), struct.pack(">III", 5, 6, 7))))
    moof = run(len(run(0)) + 8)
    track = media_columns.index_media(head + moof + box(b"mdat", bytes(18)))[0]
    start = len(head) + len(moof) + 8
    assert track.fragments == [(start, 5, True), (start + 5, 6, False), (start + 11, 7, False)]
    assert [x.tolist() for x in track.keyframes()] == [[start], [5]]


def test_quality_rules_statistics(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.quality_rules(docs, keep=["doc_id"]).collect():
        t = texts[r.doc_id]
        w = WORDS.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rules_separate_labels(spark):
    rated = Q.op10_quality_rules(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert rated.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95


def test_site_quality_shrinks_sparse_sites(spark):
    good = "plain words in a line that reads well and goes on for a while with more of them here and there"
    rows = [(i, good, "en", "big", 1) for i in range(60)] + [(100, good, "en", "small", 1)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(60)] + [(100, 0)], "doc_id bigint, quality int")
    out = by_id(site_quality.site_quality(spark.createDataFrame(rows, SCHEMA), labels).collect())
    assert 0.0 < out[100].host_quality < 0.9 and abs(out[0].host_quality - 0.9) < 0.05


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    same(Q.QUERIES[name](spark, DATA), Q.ORACLE_SQL[name])


def test_pipeline_by_plain_python(spark):
    """Each stage on its own input: what the stage keeps follows from the operators' own brute-force forms."""
    import corpus_pipeline as P

    docs = spark.createDataFrame(corpus(8), SCHEMA)
    names = docs.columns
    one = P.rules_stage(spark, docs, DATA)
    rated = by_id(quality_rules.quality_rules(docs).collect())
    assert {r.doc_id for r in one.collect()} == {i for i, r in rated.items() if r.kept}
    two = P.lines_stage(spark, docs, DATA)
    assert two.columns == names and two.where("length(text) <> n_chars").count() == 0
    three = P.jaccard_stage(spark, docs, DATA)
    sets = {r.doc_id: shingles(r.text, 5) for r in docs.collect() if r.doc_id is not None}
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = sorted(r.doc_id for r in three.collect() if r.doc_id is not None)
    assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(near(i, j) for j in sets if j != i) for i in set(sets) - set(kept))
    four = P.mixture_stage(spark, docs, DATA)
    assert four.columns == names and {r.doc_id for r in four.collect()} <= {r.doc_id for r in docs.collect()}
    last = P.pieces_stage(spark, docs, DATA)
    assert last.where("NOT lossless").count() == 0 and last.count() == docs.count()


def test_pipeline_runs_on_the_tables(spark):
    import corpus_pipeline as P

    out = P.run(spark, DATA)
    assert [n for n, _ in P.STAGES][0] == "quality rules" and len(P.STAGES) == 5
    assert 0 < out.count() < spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline_of_an_empty_table_and_of_null_keys(spark, tmp_path):
    import corpus_pipeline as P

    good = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and len(r.text) > 400][:12]
    rows = [(None if i % 4 == 0 else r.doc_id, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(good)] * 2 + [(None, None, None, None, None), (5, "", None, "s", 0)]
    for name, table in (("none", []), ("some", rows)):
        spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = P.run(spark, str(tmp_path / name))
        assert out.where("NOT lossless").count() == 0 and (out.count() == 0) == (name == "none")
    assert out.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").count() == 0


def test_texts_longer_than_a_numpy_pass(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(60_000))
    assert len(long) > 4_500_000
    cut = long[4_193_800:4_195_800]  # around the place where a long text is taken apart
    lines = long.split("\n")
    rows = [(1, long), (2, "own words before " + cut + " own words after"), (3, long.replace(words[0], "changed", 3)), (4, "first\n" + "\n".join(lines[30_000:30_003]) + "\nlast")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(frame.where("doc_id < 3")).collect()}
    assert found[1].n_removed == found[2].n_removed and found[1].n_spans == found[2].n_spans == 1 and len(cut) <= found[2].n_removed <= len(cut) + 2
    parts = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame).collect()}
    assert parts == {1: 1, 2: 2, 3: 1, 4: 4}
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(frame.where("doc_id IN (1, 4)")).collect()}
    assert kept == {1: long, 4: "first\nlast"}
    media = media_columns.media_columns(frame.where("doc_id = 1"), stored=False).first()
    padded = long.encode() + bytes(-len(long) % 64)
    assert media.payload_sha256 == hashlib.sha256(padded).hexdigest() and media.n_samples == len(padded) // 64


def test_line_dedup_of_many_blank_lines(spark):
    """A hundred thousand blank lines between short ones: the last look is linear in the lines."""
    import random

    r = random.Random(5)
    short = lambda: f"word {r.randrange(40)}"
    texts = ["\n".join(short() if r.random() < 0.1 else "" for _ in range(100_000)) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert time.time() - began < 90 and out[0]._n_removed == 0
    lines, other = texts[1].split("\n"), texts[0].split("\n")
    start, end = line_dedup.shortest_runs(np.array([len(x) for x in lines]), np.array([bool(x) for x in lines]), 60)
    start2, end2 = line_dedup.shortest_runs(np.array([len(x) for x in other]), np.array([bool(x) for x in other]), 60)
    held = {"\n".join(other[a:b]) for a, b in zip(start2.tolist(), end2.tolist())}
    gone = {i for a, b in zip(start.tolist(), end.tolist()) if "\n".join(lines[a:b]) in held for i in range(a, b)}
    assert out[1]._n_removed == len(gone)


def test_suffix_dedup_of_many_copies_without_a_key(spark):
    """Ten thousand rows of one text under no key: a place of the text meets each row once, not each row each other."""
    text = "".join(f"clause {i} of the licence; " for i in range(20))
    rows = [(None, text)] * 10_000 + [(1, text[:300]), (2, "nothing shared")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.time()
    out = suffix_dedup.suffix_dedup(docs).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert time.time() - began < 90
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out) == sorted([(-1, len(text), len(text), 10_000), (1, 300, 300, 1), (2, 14, 0, 1)])
