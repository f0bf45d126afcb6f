"""Quality rules (operator 10): rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule says good, bad or nothing about a document. The votes of all documents are counted by pattern
(three to the power of the rules at most, whatever the corpus size); expectation-maximisation over that
table estimates the class prior and each rule's accuracy within either class, and the posterior probability
of good quality takes the place of a filter that all rules must pass. All of it is DataFrame work: per
round, one aggregate over the pattern table by rule and vote gives the next parameters (a few dozen numbers).

Defined results: a null or blank text has no words and fails the base; repeated rows get one result each;
ties at the threshold count as kept; an empty table gives an empty one; a column of the input that bears
the name of a statistic gives way to it; a null key stays.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text_stats import STATS, STATS_SQL, with_text_stats

ROUNDS, THRESHOLD, SMOOTH = 12, 0.5, 0.1

#: name, bad if, good if, in SQL that Spark and DuckDB share; neither is an abstention.
RULES = [
    ("length", "n_words < 20", "n_words >= 50"),
    ("word_length", "word_chars * 10 < 25 * n_words OR word_chars > 15 * n_words", "word_chars * 10 >= 30 * n_words AND word_chars <= 11 * n_words"),
    ("symbols_per_word", "n_symbols * 100 > 15 * n_words", "n_symbols * 100 <= 2 * n_words"),
    ("symbol_share", "n_symbols * 100 > 4 * word_chars", "n_symbols * 100 <= word_chars"),
    ("exclamations", "n_exclaim * 100 > 30 * n_words", "n_exclaim * 100 <= 5 * n_words"),
    ("capitals", "n_upper * 100 > 40 * word_chars", "n_upper * 100 <= 20 * word_chars"),
    ("repetition", "n_repeat_words * 100 > 30 * n_words", "n_repeat_words = 0"),
    ("stutter", "n_adjacent * 100 > 20 * n_words", "n_adjacent * 100 <= 5 * n_words"),
    ("repeated_lines", "n_dup_lines * 100 > 30 * n_lines", "n_dup_lines = 0"),
]
BASE_FAILED = "n_words < 20 OR n_repeat_words * 100 > 30 * n_words"

#: The pattern of votes, one letter a rule, and the first guess of the posterior by the bad votes in it.
VOTES = "concat(" + ", ".join(f"CASE WHEN {bad} THEN 'B' WHEN {good} THEN 'G' ELSE 'A' END" for _, bad, good in RULES) + ")"
FIRST = "CASE length(votes) - length(replace(votes, 'B', '')) WHEN 0 THEN 0.95D WHEN 1 THEN 0.4D ELSE 0.05D END"


def _step(patterns: DataFrame, q: Column) -> dict[str, float]:
    """M step: prior and accuracies from the pattern counts and posteriors, one row for each rule and vote."""
    each = patterns.select("n", (F.col("n") * q).alias("good"), F.posexplode("each").alias("j", "vote"))
    rows = each.groupBy("j", "vote").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()
    counts: dict[str, float] = defaultdict(float)
    for r in rows:
        counts[f"good{r.vote}{r.j}"], counts[f"bad{r.vote}{r.j}"] = r.good, r.n - r.good
        if r.j == 0:
            counts["good"] += r.good
            counts["bad"] += r.n - r.good
    return counts


def _weights(c: dict[str, float]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good: the prior's, and what a good and a bad vote of each rule add."""
    prior = math.log((c["good"] + SMOOTH) / (c["bad"] + SMOOTH))
    votes = []
    for j in range(len(RULES)):
        right, wrong = ((c[f"{y}G{j}"] + SMOOTH) / (c[f"{y}G{j}"] + c[f"{y}B{j}"] + 2 * SMOOTH) for y in ("good", "bad"))
        votes.append((math.log(right / wrong), math.log((1 - right) / (1 - wrong))))
    return prior, votes


def _posterior(weights: tuple[float, list[tuple[float, float]]]) -> Column:
    """The weights go in as one array and are picked by the votes, so that every round runs the same compiled code."""
    prior, votes = weights
    table = F.array(*[F.lit(float(x)) for j, (g, b) in enumerate(votes) for x in (g + prior * (j == 0), b + prior * (j == 0), prior * (j == 0))])
    odds = F.lit(0.0)
    for j in range(len(votes)):
        odds = odds + F.element_at(table, F.lit(3 * j) + F.expr(f"instr('GBA', substring(votes, {j + 1}, 1))"))
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Rule weights from a frame with the column `votes`: all its rows count, by pattern."""
    counted = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = cut(counted.select("votes", "n", F.array(*[F.substring("votes", j + 1, 1) for j in range(len(RULES))]).alias("each")))
    q = F.expr(FIRST)
    for _ in range(rounds):
        weights = _weights(_step(patterns, q))
        q = _posterior(weights)
    return weights


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns plus the statistics, base_failed, votes, quality (posterior) and kept."""
    rated = with_text_stats(docs, text, keep).withColumn("votes", F.expr(VOTES))
    rated = cut(rated)
    return decide(rated, fit(rated.select("votes"), rounds), threshold)


def decide(rated: DataFrame, weights, threshold: float = THRESHOLD) -> DataFrame:
    out = rated.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", _posterior(weights))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, all columns as they were. Rows and votes are written once: a filter on the
    verdict would otherwise be pushed into the statistics and repeat their expressions many times over."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    rated = cut(with_text_stats(held, "_text", ["_row"]).withColumn("votes", F.expr(VOTES)))
    weights = fit(rated.select("votes"), rounds)
    return decide(rated, weights, threshold).where("kept").select("_row.*")


def _round_sql(i: int) -> str:
    terms = ", ".join(
        f"ln((g{j}G + {SMOOTH}) / (g{j}G + g{j}B + {2 * SMOOTH}) / ((b{j}G + {SMOOTH}) / (b{j}G + b{j}B + {2 * SMOOTH}))) AS wg{j}, "
        f"ln((g{j}B + {SMOOTH}) / (g{j}G + g{j}B + {2 * SMOOTH}) / ((b{j}B + {SMOOTH}) / (b{j}G + b{j}B + {2 * SMOOTH}))) AS wb{j}"
        for j in range(len(RULES))
    )
    sums = ", ".join(
        f"sum(CASE WHEN substr(votes, {j + 1}, 1) = '{v}' THEN n * {w} ELSE 0 END)::DOUBLE AS {y}{j}{v}"
        for j in range(len(RULES)) for y, w in (("g", "q"), ("b", "(1 - q)")) for v in "GB"
    )
    odds = " + ".join(f"CASE substr(votes, {j + 1}, 1) WHEN 'G' THEN wg{j} WHEN 'B' THEN wb{j} ELSE 0 END" for j in range(len(RULES)))
    return (
        f"c{i} AS MATERIALIZED (SELECT sum(n * q)::DOUBLE AS good, sum(n * (1 - q))::DOUBLE AS bad, {sums} FROM q{i}), "
        f"k{i} AS MATERIALIZED (SELECT ln((good + {SMOOTH}) / (bad + {SMOOTH})) AS prior, {terms} FROM c{i}), "
        f"q{i + 1} AS MATERIALIZED (SELECT votes, n, 1 / (1 + exp(-(prior + {odds}))) AS q FROM q{i}, k{i})"
    )


def rules_sql(source: str = "SELECT * FROM documents", rounds: int = ROUNDS) -> str:
    """DuckDB CTEs up to `judged`: the columns of the source plus statistics, base_failed, quality and kept."""
    rounds_sql = ", ".join(_round_sql(i) for i in range(rounds))
    first = FIRST.replace("D ", "::DOUBLE ")
    return f"""src AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM ({source})), {STATS_SQL},
rated AS MATERIALIZED (SELECT *, {VOTES} AS votes FROM stats),
q0 AS MATERIALIZED (SELECT votes, n, {first} AS q FROM (SELECT votes, count(*) AS n FROM rated GROUP BY votes)), {rounds_sql},
judged AS (SELECT rated.*, ({BASE_FAILED}) AS base_failed, q AS quality, NOT ({BASE_FAILED}) AND q >= {THRESHOLD} AS kept FROM rated JOIN q{rounds} USING (votes))"""


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes"]

ORACLE = f"WITH {rules_sql()} SELECT doc_id, {', '.join(COLUMNS)} FROM judged"

assert set(COLUMNS[:5]) <= set(STATS)
