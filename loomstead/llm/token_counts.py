"""Token counts (operator 12): prefix dynamic programming stores the exact token count at every prefix of a text.

The vocabulary's byte-pair merges have a local law: a run of tokens is the encoding of its bytes if and only if every
token is the encoding of its own bytes and every two neighbours are the encoding of theirs. So the encoding of a prefix
of a word is that of a shorter prefix and one more token, the only one that both ends a byte there and stands beside
the shorter prefix's last token. The table of a word keeps that last token and the count at every prefix; a second
row closes each prefix with a token that ends a word, since that is what the library does with a text that stops there.

What stands between two spaces has a table of its own, and a text's counts are those tables laid end to end, so they hold
for every prefix (`prefix_counts`), and questions of truncation and of budgets are looked up (`count_at`, `fitting`,
`truncated`), not encoded again. `token_counts` needs the last entry of each table only, which is kept while memory
allows, and looks into the one table where the limit is passed. Counts are not monotone inside a word (a whole word may
take fewer tokens than its beginning), so the longest prefix within a budget is looked for from the end.

Counts are those of the library without added tokens; the vocabulary's special strings inside a text are one token
each, as is the library's default, and a prefix that stops inside one is ordinary text. Prefixes are those of the
text's normal form C, code point by code point, which is what the library counts: a text in that form, as nearly all
are, is its own.

Defined results: a null or empty text has no tokens; a null key is kept; repeated rows repeat; an empty table gives an
empty one; no column but key and text is read. A long text is worked through a portion at a time.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The vocabulary and the limit of the op12 contract.
MODEL, LIMIT = "word_bpe_49k.json", 2048

#: Code points of a portion of a long text, and of the longest run that is kept; how many runs and words are kept.
PORTION, RUN, KEPT = 1 << 19, 48, 1 << 19

#: What is known beside a token that has not been looked at.
NONE: dict[str, bool] = {}

#: Mark of a token that ends a word in the vocabulary file (fixed value).
END = "</w>"

#: Below this code point all versions of the character tables in use agree; texts beyond it are split by the library.
AGREED = regex.compile("[^\\x00-\\u052f]")
ITEM = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
SPACE = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return out


class Merges:
    """Byte-pair merges of words, prefix by prefix."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        self.vocabulary = vocabulary
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        # by a token's last three letters, the lengths that such tokens have, the longest first
        sizes: dict[str, set[int]] = {}
        for token in vocabulary:
            body = token.removesuffix(END)
            if len(body) > 2:
                sizes.setdefault(body[-3:] + token[len(body) :], set()).add(len(body))
        self.sizes = {tail: (*sorted(s, reverse=True), 2, 1) for tail, s in sizes.items()}
        self.beside: dict[str, dict[str, bool]] = {}
        self.pairs = 0

    def stays(self, left: str, right: str) -> bool:
        """Whether the two tokens, or the right one if the left is empty, are the encoding of their bytes."""
        known = self._encoded(left, right) == [t for t in (left, right) if t]
        if self.pairs > 8 * KEPT:
            self.beside.clear()
            self.pairs = 0
        self.beside.setdefault(left, {})[right] = known
        self.pairs += 1
        return known

    def _encoded(self, left: str, right: str) -> list[str]:
        body = right.removesuffix(END)
        symbols = [*left, *body]
        if len(body) < len(right):
            symbols[-1] += END
        rank, never = self.rank, 1 << 30
        while len(symbols) > 1:
            ranks = [rank.get(p, never) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == never:
                break
            first = ranks.index(best)
            symbols[first : first + 2] = [symbols[first] + symbols[first + 1]]
        return symbols

    def _step(self, letters: str, i: int, end: str, last: list[str], count: list[int]) -> tuple[str, int]:
        """(token, count) that ends the first i letters, given those of all shorter prefixes."""
        vocabulary, beside = self.vocabulary, self.beside
        for n in self.sizes.get(letters[i - 3 : i] + end if i > 2 else "", (2, 1)):
            if n > i:
                continue
            token = letters[i - n : i] + end
            if token in vocabulary:
                left = last[i - n]
                good = beside.get(left, NONE).get(token)
                if good or good is None and self.stays(left, token):
                    return token, count[i - n] + 1
        raise ValueError(f"the vocabulary has no token for {letters!r}")

    def prefixes(self, letters: str, n: int) -> tuple[list[str], list[int]]:
        """Last token and count of every prefix of up to n letters of a word that goes on."""
        last, count = [""], [0]
        for i in range(1, n + 1):
            token, tokens = self._step(letters, i, "", last, count)
            last.append(token)
            count.append(tokens)
        return last, count

    def total(self, letters: str) -> int:
        """Tokens of a word."""
        return self._step(letters, len(letters), END, *self.prefixes(letters, len(letters) - 1))[1]

    def totals(self, letters: str) -> list[int]:
        """Tokens of every prefix of a word, from one byte to all, as if the word ended there."""
        states = self.prefixes(letters, len(letters) - 1)
        return [self._step(letters, i, END, *states)[1] for i in range(1, len(letters) + 1)]


class Counter:
    """Token counts at every prefix, for one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if spec["model"].get("end_of_word_suffix") != END or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a vocabulary of lower-case words with ends")
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.letters = byte_letters()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.nfc, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.runs: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def form(self, text: str) -> str:
        """Normal form C of a text without special strings."""
        if text.isascii() or not AGREED.search(text):
            return unicodedata.normalize("NFC", text)
        return self.nfc.normalize_str(text)

    def items(self, low: str) -> list[str]:
        """Words and white space of a lower-case text, which they tile."""
        if not AGREED.search(low):
            return ITEM.findall(low, concurrent=False)
        out, at = [], 0
        for word, (start, end) in self.split.pre_tokenize_str(low):
            out += [low[at:start], word] if start > at else [word]
            at = end
        return out + [low[at:]] if at < len(low) else out

    def _letters(self, item: str) -> str:
        return item if item.isascii() and item.isalpha() else "".join([self.letters[b] for b in item.encode()])

    def _total(self, item: str) -> int:
        """Tokens of a lower-case item."""
        known = self.words.get(item)
        if known is None:
            known = 0 if SPACE.fullmatch(item) else self.merges.total(self._letters(item))
            if len(item) <= RUN:
                if len(self.words) > KEPT:
                    self.words.clear()
                self.words[item] = known
        return known

    def _word(self, item: str) -> list[int]:
        """Tokens of every prefix of a lower-case item, in code points."""
        if SPACE.fullmatch(item):
            return [0] * len(item)
        if item in CONTRACTIONS:  # cut short, it is a mark and letters
            return [sum([self._total(x) for x in self.items(item[:i])]) for i in range(1, len(item))] + [self._total(item)]
        totals = self.merges.totals(self._letters(item))
        return totals if len(totals) == len(item) else [totals[i - 1] for i in np.cumsum([len(c.encode()) for c in item]).tolist()]

    def _lower(self, form: str) -> str:
        # the library lowers one code point at a time, so a sigma is no other at the end of a word
        return self.lower.normalize_str(form) if AGREED.search(form) else form.replace("Σ", "σ").lower()

    def run_total(self, run: str) -> int:
        """Tokens of what stands between two spaces."""
        known = self.runs.get(run)
        if known is None:
            if run.isascii() and run.isalpha():
                known = self._total(run.lower())
            else:
                known = 0
                for part in self.special.split(run):
                    known += sum([self._total(x) for x in self.items(self._lower(self.form(part)))])
                known += len(self.special.findall(run))
            if len(run) <= RUN:
                if len(self.runs) > KEPT:
                    self.runs.clear()
                self.runs[run] = known
        return known

    def _plain(self, form: str) -> tuple[list[int], str]:
        """Tokens of every prefix of a text without special strings, and its last item in lower case."""
        low = self._lower(form)
        out, base, items = [], 0, self.items(low)
        for item in items:
            table = self._word(item)
            out += [base + n for n in table] if base else table
            base = out[-1]
        if len(low) != len(form):  # letters that become several
            out = [out[i - 1] for i in np.cumsum([len(self._lower(c)) for c in form]).tolist()]
        return out, items[-1] if items else ""

    def _run(self, run: str) -> tuple[str, np.ndarray]:
        """(form, tokens of every prefix) of what stands between two spaces, and once more behind the space."""
        forms, counts, at, tail = [], [], 0, ""
        for found in [*self.special.finditer(run), None]:
            part = self.form(run[at : found.start() if found else len(run)])
            base = counts[-1] if counts else 0
            if part:
                table, tail = self._plain(part)
                forms.append(part)
                counts += [base + n for n in table]
                base = counts[-1]
            if found:  # cut short, it is marks and letters, and its marks join those before it
                joined = tail if part and self.items(tail + found[0][0]) == [tail + found[0][0]] else ""
                less = self._plain(joined)[0][-1] if joined else 0
                counts += [base - less + n for n in self._plain(joined + found[0][:-1])[0][len(joined) :]] + [base + 1]
                forms.append(found[0])
                at, tail = found.end(), ""
        counts.append(counts[-1] if counts else 0)
        return "".join(forms), np.array(counts, np.int64)

    def _portions(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """(runs, whether nothing follows) of a text, portion by portion; a portion but the last takes the space behind it along."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PORTION:
                end = text.rfind(" ", at + 1, at + PORTION)
                end = text.find(" ", at + PORTION) if end < 0 else end
                end = len(text) if end < 0 else end
            yield text[at:end].split(" "), end == len(text)
            at = end + 1

    def count(self, text: str) -> int:
        """Tokens of a text."""
        known, total = self.runs, 0
        for runs, _ in self._portions(text):
            totals = [known.get(r) for r in runs]
            if None in totals:
                totals = [self.run_total(r) if n is None else n for r, n in zip(runs, totals)]
            total += sum(totals)
        return total

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix, of the text's normal form, of `budget` tokens at most.

        The runs' totals add up and never fall, so the prefix ends in or before the first run that goes beyond.
        """
        total = length = 0
        for runs, whole in self._portions(text):
            for i, run in enumerate(runs):
                n = self.run_total(run)
                if total + n > budget:
                    within = np.flatnonzero(total + self._run(run)[1][:-1] <= budget)
                    return length + int(within[-1]) + 1 if len(within) else length
                total, length = total + n, length + len(run if run.isascii() else self._run(run)[0]) + (i + 1 < len(runs) or not whole)
        return length

    def portions(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """(form, counts) of a text, portion by portion: counts[i] tokens in the text up to i + 1 code points into the portion."""
        base = 0
        for parts, whole in self._portions(text):
            runs = [self._run(r) for r in parts]
            sizes = np.array([len(r[1]) for r in runs])
            ends = np.array([r[1][-1] for r in runs])
            # of the last run of a text there is no space behind it
            counts = np.concatenate([r[1] for r in runs]) + np.repeat(base + np.cumsum(ends) - ends, sizes)
            yield " ".join([r[0] for r in runs]) + ("" if whole else " "), counts[:-1] if whole else counts
            base += int(ends.sum())


@lru_cache(maxsize=2)
def counter(model: str | None = None) -> Counter:
    """The counter of a vocabulary file, once in each Python worker; by default that of the installed public tokenizers."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return Counter(model)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, model: str | None = None) -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit, and fit_chars, the code points of the longest prefix
    that has `limit` tokens at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part in slices(batches, "text"):
            n_bytes, n_tokens, fits = [], [], []
            for t in part.column(1).to_pylist():
                n = own.count(t)
                n_bytes.append(len(t.encode()))
                n_tokens.append(n)
                fits.append(own.fitting(t, limit) if n > limit else len(t if t.isascii() else own.form(t)))
            columns = [pa.array(c, pa.int64()) for c in (n_bytes, n_tokens, fits)]
            over = pa.array([n > limit for n in n_tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), columns[0], columns[1], over, columns[2]], names=[key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return _rows(docs, key, text).mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")


def prefix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """One row per document: key, form (the text in normal form C) and counts array<int>, the tokens of its first
    0, 1, 2 ... code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part in slices(batches, "text"):
            forms, counts = [], []
            for t in part.column(1).to_pylist():
                found = list(own.portions(t))
                forms.append("".join(f for f, _ in found))
                counts.append(np.concatenate([[0], *(c for _, c in found)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(forms, pa.string()), pa.array(counts, pa.list_(pa.int32()))], names=[key, "form", "counts"])

    return _rows(docs, key, text).mapInArrow(run, f"`{key}` bigint, form string, counts array<int>")


def count_at(counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first `n_chars` code points; of all if there are fewer."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(counts, F.least(n.cast("int") + 1, F.size(counts)))


def fitting(counts: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix of `budget` tokens at most."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= most, i)))


def truncated(form: Column, counts: Column, budget: Column | int) -> Column:
    """That prefix."""
    return F.substring(form, F.lit(1), fitting(counts, budget))
