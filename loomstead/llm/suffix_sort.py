"""Two-stage suffix sorting of a block of strings, and the common prefixes of neighbours, with numpy.

Suffixes that are smaller than their successor are sorted directly, eight bytes a round, up to the depth that
matters; all others are induced by one scan of the buckets from left to right, a bucket at a time. The block
is the strings one after the other, each with a separator below all bytes; beyond a separator nothing is
compared, so suffixes that agree up to one may stand in any order among themselves.
"""

from __future__ import annotations

import numpy as np


class Block:
    """Strings (uint8, values up to 254, so UTF-8 fits) joined for sorting."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: all strings; offsets: n + 1 bounds into it."""
        n = len(offsets) - 1
        self.starts = offsets[:-1] + np.arange(n)
        self.ends = offsets[1:] + np.arange(n)  # positions of the separators
        self.text = np.zeros(len(data) + n, np.uint8)
        body = np.ones(len(self.text), bool)
        body[self.ends] = False
        self.text[body] = data + np.uint8(1)
        #: Bytes from each position to its separator.
        self.rest = np.repeat(self.ends, self.ends - self.starts + 1) - np.arange(len(self.text))
        padded = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        #: The eight bytes from each position, first byte most significant.
        self.word = np.zeros(len(self.text), np.uint64)
        for j in range(8):
            self.word = self.word << np.uint64(8) | padded[j : j + len(self.text)]

    def smaller_than_successor(self) -> np.ndarray:
        """True for suffixes smaller than the one that starts a byte later."""
        n = len(self.text)
        step = np.diff(self.text.astype(np.int16), append=-1)
        decides = np.where(step != 0, np.arange(n), n - 1)
        decides = np.minimum.accumulate(decides[::-1])[::-1]
        return step[decides] > 0

    def _sorted_directly(self, positions: np.ndarray, depth: int) -> np.ndarray:
        if not len(positions):
            return positions
        order = positions[np.argsort(self.word[positions], kind="stable")]
        key = self.word[order]
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        at, done = np.arange(len(order)), 8
        while True:
            counts = np.bincount(group)
            on = (counts[group] > 1) & (self.rest[order[at]] >= done)
            at, group = at[on], group[on]
            if not len(at) or done >= depth:
                return order
            here = order[at]
            key = self.word[here + done]
            by = np.lexsort((key, group))
            order[at] = here[by]
            key = key[by]  # groups are ascending along `at`, so the sort leaves each where it is
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
            group = np.cumsum(fresh) - 1
            done += 8

    def suffix_array(self, depth: int) -> np.ndarray:
        """All positions in the order of their suffixes, exact in the first `depth` bytes."""
        smaller = self.smaller_than_successor()
        larger = ~smaller
        is_separator = self.text == 0
        larger &= ~is_separator
        direct = self._sorted_directly(np.flatnonzero(smaller & ~is_separator), depth)
        bounds = np.searchsorted(self.text[direct], np.arange(257))
        induced: list[list[np.ndarray]] = [[] for _ in range(257)]
        out = []
        for c in range(256):
            own = np.flatnonzero(is_separator) if c == 0 else direct[bounds[c] : bounds[c + 1]]
            found = induced[c]
            newest = np.concatenate(found) if found else own[:0]
            while len(newest):  # runs of one byte: the predecessors go behind, in the order of their successors
                newest = newest[newest > 0] - 1
                newest = newest[larger[newest] & (self.text[newest] == c)]
                if len(newest):
                    found.append(newest)
            bucket = np.concatenate([*found, own]) if found else own
            if not len(bucket):
                continue
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[larger[before] & (self.text[before] > c)]
            if len(before):
                byte = self.text[before]
                by = np.argsort(byte, kind="stable")
                before, byte = before[by], byte[by]
                cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
                for part in np.split(before, cuts):
                    induced[self.text[part[0]]].append(part)
        return np.concatenate(out)

    def common_prefixes(self, order: np.ndarray, depth: int) -> np.ndarray:
        """Bytes that each suffix of `order` shares with the one before it, `depth` at most; they have that many."""
        out = np.zeros(len(order), np.int64)
        live = np.arange(1, len(order))
        for done in range(0, depth, 8):
            if not len(live):
                break
            differ = self.word[order[live] + done] ^ self.word[order[live - 1] + done]
            same = np.full(len(live), 8)
            off = np.flatnonzero(differ)
            same[off] = sum((differ[off] < np.uint64(1 << 64 - 8 * j)).astype(np.int64) for j in range(1, 8))
            out[live] = np.minimum(done + same, depth)
            live = live[differ == 0]
        return out

    def repeated(self, length: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, first, last) of every stretch of offsets at which a substring of `length` bytes starts that occurs
        twice or more in the block, a string counting `times` over. Substrings of one stretch overlap or touch; bytes
        between two stretches are in no repeated substring."""
        order = self.suffix_array(length)
        order = order[self.rest[order] >= length]
        if not len(order):
            return order, order, order
        owner = np.searchsorted(self.starts, order, side="right") - 1
        opens = np.flatnonzero(self.common_prefixes(order, length) < length)
        total = np.add.reduceat(times[owner], opens)
        found = np.sort(order[np.repeat(total >= 2, np.diff(np.append(opens, len(order))))])
        if not len(found):
            return found, found, found
        owner = np.searchsorted(self.starts, found, side="right") - 1
        opens = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] - found[:-1] > length))))
        who = owner[opens]
        return who, found[opens] - self.starts[who], found[np.append(opens[1:], len(found)) - 1] - self.starts[who]
