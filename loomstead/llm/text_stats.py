"""Per-document text statistics by built-in functions only: one narrow projection, no shuffle, no Python.

Words are `[^\\x20\\x09-\\x0D]+`, lines are split at \\n. A null text has no words. Statistics that need
whole-text work beyond the word array (repeated 8-word windows) keep their large intermediates only for
texts that repeat anything, so plain texts cost one hashing pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: White space of the word rule, and the symbols that count as markup (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of a window of the repetition count.
WINDOW = 8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_adjacent"]


def _removed(text: Column, chars: str) -> Column:
    """Characters of `chars` in a text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _pairs(a: Column, shift: int, n: Column, f) -> Column:
    return F.zip_with(a, F.slice(a, F.lit(shift + 1), n), f)


def with_text_stats(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all but clashing statistics by default) plus the statistics in STATS, all bigint."""
    keep = [c for c in df.columns if c not in STATS] if keep is None else keep
    n, none = F.col("_n"), F.array().cast("array<bigint>")
    # one struct holds what is kept, so no name of the input can clash with the steps' own
    step = df.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_keep"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    step = step.select("*", F.btrim("_t", F.lit(SPACES)).alias("_b"))
    step = step.select("*", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", SPACE_CLASS + "+")).alias("_w"),
                       F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"))
    step = step.select("*", F.size("_w").alias("_n"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"))
    for a, b, shift in (("_h1", "_h2", 1), ("_h2", "_h4", 2), ("_h4", "_h8", 4)):
        step = step.select("*", _pairs(F.col(a), shift, n, lambda x, y: F.xxhash64(x, y)).alias(b)).drop(*([a] if a != "_h1" else []))
    step = step.withColumn("_h8", F.slice("_h8", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    step = step.withColumn("_d", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.col("_h8")).otherwise(none)).drop("_h8")
    step = step.withColumn("_s", F.sort_array(F.transform("_d", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).drop("_d")
    m = F.size("_s")
    step = step.withColumn("_e", F.zip_with("_s", F.slice("_s", F.lit(2), m), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    step = step.withColumn("_e", F.zip_with("_e", F.concat(F.array(F.lit(False)), F.slice("_e", F.lit(1), F.greatest(m - 1, F.lit(0)))), lambda a, b: a | F.coalesce(b, F.lit(False))))
    step = step.withColumn("_p", F.sort_array(F.filter(F.zip_with("_s", "_e", lambda s, e: F.when(e, s["i"])), lambda i: i.isNotNull()))).drop("_s", "_e")
    covered = _pairs(F.col("_p"), 1, F.size("_p"), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    adjacent = _pairs(F.col("_h1"), 1, n, lambda a, b: F.coalesce(a == b, F.lit(False)))
    out = step.select(
        "_keep",
        n.cast("bigint").alias("n_words"),
        (F.length("_t") - F.length(F.translate("_t", SPACES, ""))).alias("_blank"),
        F.length("_t").alias("_len"),
        _removed(F.col("_t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("bigint").alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        _removed(F.col("_t"), UPPER).cast("bigint").alias("n_upper"),
        _removed(F.col("_t"), "!").cast("bigint").alias("n_exclaim"),
        F.size(F.filter(adjacent, lambda x: x)).cast("bigint").alias("n_adjacent"),
    )
    out = out.withColumn("word_chars", (F.col("_len") - F.col("_blank")).cast("bigint"))
    return out.select(*[F.col(f"_keep.`{c}`").alias(c) for c in keep], *STATS)


#: The same statistics in DuckDB: `src` holds rid (a row key), and the text. One CTE list without WITH.
STATS_SQL = r"""
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM src),
wins AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM words, UNNEST(range(1, greatest(len(w) - 6, 1))) AS u(i)),
dups AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cover AS (SELECT rid, sum(x) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS x FROM dups) GROUP BY rid),
stats AS (SELECT words.*, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
                 length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
                 len(list_filter(range(1, len(w)), lambda i: w[i] = w[i+1])) AS n_adjacent
          FROM words LEFT JOIN cover USING (rid))
"""
