"""Fill-in-middle transformation (operator 11): texts cut at unit ends into prefix, middle and suffix, put in another order.

A unit is a run of ASCII letters or any other single code point. An Arrow-batched pandas UDF walks a text once with
`finditer`, keeps the end offset of every unit in a compact array of 32-bit integers, and slices the text at two of
them. What is drawn for a row comes from a digest of the seed and the row's key alone, so a row's form and cuts are
the same in any partitioning and on any retry.

The three marks differ in their letter and begin with the only `<` and end with the only `>` that they hold, so no
mark can begin or end inside another or reach over a cut; a text that holds a mark stays plain. So every
output gives its text back (`restore`), from the output and the form alone.

Defined results: a null or empty text has no units and is plain; a null key draws as the empty string; rows that repeat
a key draw alike; an empty table gives an empty one; no column but key and text is read, so clashing names do no
harm. One text is held at a time besides its batch, with four bytes for each of its units.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle, and the forms (fixed values of the op11 contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Of a hundred rows so many are cut; of a hundred that are cut so many have the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")

COLUMNS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """End offset of every unit of a text, in code points."""
    # one thread a worker: giving the interpreter's lock away for every match would cost more than the match
    return array("I", (m.end() for m in UNIT.finditer(text, concurrent=False)))


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the digest of `seed:key`."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4))


@dataclass(frozen=True)
class Recipe:
    """How rows are drawn."""

    seed: int = 1
    cut_percent: int = CUT_PERCENT
    spm_percent: int = SPM_PERCENT

    def transform(self, key: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of the prefix, of the middle, output) of one row."""
        ends = unit_ends(text)
        n = len(ends)
        one, two, shape, order = draws(self.seed, key)
        if not n or shape % 100 >= self.cut_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return n, PLAIN, None, None, text
        low, high = sorted((one % (n + 1), two % (n + 1)))
        a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if order % 100 < self.spm_percent:
            return n, SPM, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return n, PSM, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made of."""
    if form == PLAIN:
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    head, tail = output[len(first) :].split(second)
    tail, middle = tail.split(MIDDLE)
    prefix, suffix = (tail, head) if form == SPM else (head, tail)
    return "".join((prefix, middle, suffix))


def restore(output: Column, form: Column) -> Column:
    """restored() of a column of outputs; null gives null."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", recipe: Recipe = Recipe(), outputs: bool = True) -> DataFrame:
    """One row per document: key, n, form, prefix_chars, middle_chars (code points, null if plain), output_sha256,
    restored_sha256, and the output itself unless `outputs` is false."""

    @F.pandas_udf(COLUMNS + ", output string" if outputs else COLUMNS)
    def made(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for k, t in zip(keys, texts):
            *row, output = recipe.transform(k, t)
            rows.append((*row, _digest(output), _digest(restored(output, row[1])), *([output] if outputs else [])))
        columns = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if outputs else [])]
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), made(whole(key), whole(text)).alias("_made"))
    return rows.select(F.col("_key").alias(key), "_made.*")


#: The query in DuckDB.
ORACLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo+1:hi], '') AS mid, array_to_string(u[hi+1:n], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
