"""Cross-tokenizer alignment (operator 13): the tokens of two vocabularies over the same bytes, linked where they overlap.

A text's A tokens and B tokens tile the same bytes. The starts and ends of the B tokens are a static interval index:
they are sorted once, and two bisections stab it for every A token, whose links are the B tokens between them. An
offset that no token of either side spans is a group boundary.

Neither vocabulary joins a letter with a space or a line feed behind it, so both tilings, and with them links and
groups, fall apart at such places. What stands between two of them is a chunk, which is encoded and aligned once and
kept while memory allows; a vocabulary that does join them there (`Pair.borders` looks) gets longer chunks.

How many documents hold a pair of ids linked is a statistic of the corpus. A slice of texts is one row: its different
pairs, in how many of its documents each is, and which. Counts are sums of those by pair, never more than a row for a
pair and slice; every slice then gets the counts of its pairs back and sums them by document. A pair that all documents
hold is one row a slice like any other, so no key is hot and nothing is broadcast or collected.

Defined results: a text that is null or empty, or that either vocabulary does not spell byte by byte, has no tokens;
a null key is kept; rows that repeat a key or a text count each; an empty table gives an empty one; no column but key
and text is read. A long text is worked through a portion at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, slices
from .token_counts import byte_letters

#: The vocabularies of the op13 contract, A and B.
MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: White space of either library (fixed values: the code points with the property of that name).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Code points of a portion of a long text, and of the texts that are aligned at a time; how many chunks and how many
#: bytes of what is known of them are kept; how many chunks are encoded together. A worker's memory follows from these.
PORTION, KEPT, KEPT_BYTES, LESSON = 1 << 20, 1 << 17, 1 << 25, 1 << 14

#: A pair is its A id times STEP, plus its B id; a slice has fewer texts than PLACES.
STEP, PLACES = 1 << 20, 1 << 16


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A index of each link, its B index, ends of the groups) of two tilings of the same bytes, given by their ends."""
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    first = np.searchsorted(ends_b, starts_a, side="right")
    behind = np.searchsorted(starts_b, ends_a, side="left")
    reach = behind - first
    a = np.repeat(np.arange(len(ends_a)), reach)
    b = np.arange(len(a)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first, reach)
    return a, b, ends_a[ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a]


class Spelling:
    """Byte strings of ids, joined for sequences of ids without a loop."""

    def __init__(self, names: list[bytes]) -> None:
        self.joined = np.frombuffer(b"".join(names), np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in names])))
        self.sizes = np.diff(self.bounds)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.joined[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[ids] - ends + sizes, sizes)]


class Learnt:
    """What is known of chunks, by number: tokens of either side, groups, links, the links' pairs, the groups as text."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)
        self.ends = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, chunks: list[str], counts: np.ndarray, pairs: np.ndarray, texts: list[bytes]) -> None:
        self.numbers.update(zip(chunks, range(len(self.texts), len(self.texts) + len(chunks))))
        self.counts, self.pairs = np.concatenate((self.counts, counts)), np.concatenate((self.pairs, pairs))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts[:, 3])))
        self.texts += texts
        self.bytes += pairs.nbytes + sum(map(len, chunks)) + sum(map(len, texts))


#: Number of a chunk that is not spelt byte by byte.
BAD = -1


class Pair:
    """Two vocabularies and the chunks that they have met."""

    def __init__(self, model_a: str, model_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(model_a), sentencepiece.SentencePieceProcessor(model_file=model_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        names_a = [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab(with_added_tokens=False).items():
            names_a[i] = bytes(byte_of[c] for c in name)
        names_b, pieces = [], []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            names_b.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else name.replace("▁", " ").encode())
            pieces.append("" if self.b.is_byte(i) else name.replace("▁", " "))
        self.spell_a, self.spell_b = Spelling(names_a), Spelling(names_b)
        # the groups as text: an id and what follows it, which is a comma, a bar behind a group's A ids, or a semicolon
        self.written = Spelling([f"{i}{c}".encode() for c in ",|;" for i in range(max(len(names_a), len(names_b)))])
        self.width = max(len(names_a), len(names_b))
        self.space = self.b.piece_to_id("▁")
        self.borders = "".join(c for c in " \n" if not any(c in p.lstrip(" ") or c != " " and c in p for p in pieces))
        other = re.escape("".join(c for c in SPACES if c not in self.borders))
        solid, any_ = f"[^{re.escape(SPACES)}]", f"[{re.escape(SPACES)}]"
        # from a border behind something solid to the next: other white space in between belongs to the chunk
        self.chunks = re.compile(f"[{re.escape(self.borders)}]{any_}*{solid}*(?:[{other}]{any_}*{solid}*)*" if self.borders else "(?s:.+)")
        self.cut = re.compile(f"(?<={solid})[{re.escape(self.borders)}]" if self.borders else r"(?!)")
        self.learnt = Learnt()

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of a text that begins with white space."""
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        # the model puts a space before a text: one that begins with a space gives it up, another loses the piece again
        if text[0] == " ":
            ids_b = self.b.encode(text[1:]) if len(text) > 1 else [self.space]
        else:
            ids_b = self.b.encode(text)
            ids_b = ids_b[1:] if ids_b[:1] == [self.space] else []
        return ids_a, np.array(ids_b, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks laid end to end: each but the last ends with something solid, so both vocabularies
        see them one by one."""
        if not chunks:
            return
        whole = "".join(chunks)
        data = np.frombuffer(whole.encode(), np.uint8)
        stops = np.cumsum([len(c) for c in chunks] if whole.isascii() else [len(c.encode()) for c in chunks])
        all_a, all_b = self._encoded(whole)
        ends_a, ends_b = np.cumsum(self.spell_a.sizes[all_a]), np.cumsum(self.spell_b.sizes[all_b])
        upto_a, upto_b = np.searchsorted(ends_a, stops) + 1, np.searchsorted(ends_b, stops) + 1
        spelt = np.array_equal(self.spell_a(all_a), data) and np.array_equal(self.spell_b(all_b), data)
        if not spelt or not np.array_equal(ends_a[upto_a - 1], stops) or not np.array_equal(ends_b[upto_b - 1], stops):
            if len(chunks) == 1:
                self.learnt.numbers[whole] = BAD
            else:  # a few chunks spoil the rest: halves find them
                self.learn(chunks[: len(chunks) // 2])
                self.learn(chunks[len(chunks) // 2 :])
            return
        link_a, link_b, groups = aligned(ends_a, ends_b)
        links, upto = np.searchsorted(link_a, upto_a), np.searchsorted(groups, stops, side="right")
        # the tokens as they are written: group by group, A before B
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        size_a, size_b = np.bincount(group_a, minlength=len(groups)), np.bincount(group_b, minlength=len(groups))
        before_a, before_b = np.cumsum(size_a), np.cumsum(size_b)
        line = np.empty(len(all_a) + len(all_b), np.int64)
        last_a, last_b = np.zeros(len(all_a), bool), np.zeros(len(all_b), bool)
        last_a[before_a - 1], last_b[before_b - 1] = True, True
        line[np.arange(len(all_a)) + (before_b - size_b)[group_a]] = all_a + self.width * last_a
        line[np.arange(len(all_b)) + before_a[group_b]] = all_b + 2 * self.width * last_b
        text = self.written(line).tobytes()
        cuts = [0, *np.cumsum(self.written.sizes[line])[upto_a + upto_b - 1].tolist()]
        counts = np.diff(np.stack((upto_a, upto_b, upto, links), axis=1), axis=0, prepend=0)
        self.learnt.add(chunks, counts, all_a[link_a] * STEP + all_b[link_b], [text[a:b] for a, b in zip(cuts, cuts[1:])])

    def numbered(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers; those not known yet are learnt."""
        if len(self.learnt.numbers) > KEPT or self.learnt.bytes > KEPT_BYTES:
            self.learnt = Learnt()
        numbers = self.learnt.numbers
        fresh = [c for c in set(chunks) if c not in numbers]
        tails = [c for c in fresh if c[-1] in SPACES]  # the end of a text
        solid = sorted(c for c in fresh if c[-1] not in SPACES)
        for at in range(0, len(solid), LESSON):
            self.learn(solid[at : at + LESSON])
        for c in tails:
            self.learn([c])
        return np.array([numbers[c] for c in chunks], np.int64)

    def portions(self, text: str) -> Iterator[str]:
        """A text behind its space, cut between chunks."""
        text = " " + text
        at = 0
        while at < len(text):
            found = self.cut.search(text, at + PORTION) if len(text) - at > PORTION else None
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts: (rows of A tokens, B tokens, groups, links), digests of the groups ('' without tokens), and, by pair and
        text, the different keys `pair * PLACES + place of the text` with how often each is."""
        totals, digests = np.zeros((len(texts), 4), np.int64), [hashlib.sha256() for _ in texts]
        held, bad = [b""] * len(texts), np.zeros(len(texts), bool)
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def work(pieces: list[tuple[int, list[str]]]) -> None:
            numbers = self.numbered([c for _, chunks in pieces for c in chunks])
            sizes = np.array([len(chunks) for _, chunks in pieces])
            place = np.repeat([p for p, _ in pieces], sizes)
            if (numbers == BAD).any():
                bad[place[numbers == BAD]] = True
            good = ~bad[place]
            number, place = numbers[good], place[good]
            learnt = self.learnt
            np.add.at(totals, place, learnt.counts[number])
            reach, first = learnt.counts[number, 3], learnt.ends[number]
            stops = np.cumsum(reach)
            pairs = learnt.pairs[np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - stops + reach, reach)]
            key, n = np.unique(pairs * PLACES + np.repeat(place, reach), return_counts=True)
            keys.append(key)
            times.append(n)
            at = 0
            for (p, chunks), size in zip(pieces, sizes.tolist()):
                if not bad[p]:
                    digests[p].update(held[p])
                    held[p] = b"".join([learnt.texts[i] for i in numbers[at : at + size].tolist()])
                at += size

        open_, waiting = 0, []
        for place, text in enumerate(texts):
            for portion in self.portions(text) if text else ():
                waiting.append((place, self.chunks.findall(portion)))
                open_ += len(portion)
                if open_ >= PORTION:
                    work(waiting)
                    open_, waiting = 0, []
        if waiting:
            work(waiting)
        for place in range(len(texts)):
            digests[place].update(held[place][:-1])  # nothing follows the last group
        totals[bad] = 0
        key, n = keys[-1], times[-1]
        if len(keys) > 2:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(times), minlength=len(key)).astype(np.int64)
        fine = ~bad[key % PLACES]
        return totals, [d.hexdigest() if t else "" for d, t in zip(digests, totals[:, 0].tolist())], key[fine], n[fine]


@lru_cache(maxsize=2)
def pair_of(model_a: str | None = None, model_b: str | None = None) -> Pair:
    """The vocabularies by their files, once in each Python worker; by default those of the installed public tokenizers."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Pair(model_a or public_tokenizers.path(MODEL_A), model_b or public_tokenizers.path(MODEL_B))


DOC = "id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"
SLICE = f"slice bigint, docs array<struct<{DOC}>>, pairs array<bigint>, held array<int>, doc array<int>, times array<int>"


def _slices(rows: DataFrame, model_a: str | None, model_b: str | None) -> DataFrame:
    """One row a slice of texts: its documents, its different pairs, in how many of the documents each is (`held`), and
    for each pair in turn those documents' places (`doc`) and how often they have it (`times`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = pair_of(model_a, model_b), TaskContext.get().partitionId() << 32
        small = (part.slice(at, PLACES) for part in slices(batches, "text", 2 * SLICE_BYTES) for at in range(0, part.num_rows, PLACES))
        for number, part in enumerate(small):
            totals, digests, keys, times = own.align(part.column(1).to_pylist())
            different, held = np.unique(keys // PLACES, return_counts=True)
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            docs = pa.StructArray.from_arrays([part.column(0), *(pa.array(totals[:, c]) for c in range(4)), pa.array(digests, pa.string())], names=names)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (docs, pa.array(different), *(pa.array(x.astype(np.int32)) for x in (held, keys % PLACES, times)))]
            yield pa.RecordBatch.from_arrays([pa.array([first + number]), *lists], names=["slice", "docs", "pairs", "held", "doc", "times"])

    return rows.mapInArrow(run, SLICE)


def pair_counts(coded: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is, and whether no pair of its A id is in more."""
    of = coded.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    counts = cut(of)
    a = F.floor(F.col("pair") / STEP).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    return counts.select("pair", "n", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def token_alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", model_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held, doc, times, counts = (batch.column(c)[i].values for c in range(5))
                best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                if counts is not None and len(counts):
                    n, is_best = (np.repeat(counts.field(c).to_numpy(zero_copy_only=False), held.to_numpy()) for c in (1, 2))
                    doc, times = doc.to_numpy(), times.to_numpy().astype(np.int64)
                    np.add.at(best, doc, times * is_best)
                    np.add.at(total, doc, times * n)
                fields = [rows.field(c) for c in range(6)]
                yield pa.RecordBatch.from_arrays([*fields[:5], pa.array(best), pa.array(total), fields[5]], names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    coded = cut(_slices(rows, model_a, model_b))
    named = coded.select("slice", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(coded), "pair")
    back = named.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("counts"))
    whole = coded.select("slice", "docs", "held", "doc", "times").join(back, "slice", "left").select("docs", "held", "doc", "times", "counts")
    return whole.mapInArrow(run, f"`{key}` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
