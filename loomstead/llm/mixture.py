"""Mixing sources to target weights (operator 3): iterative proportional fitting, then calibrated sampling.

Tokens are counted by (source, language, topic). Raking scales the cells' inclusion probabilities until the
tokens drawn are expected to meet the target margins of all three, with the bound inside: a cell at
probability 1 stays there while a step solves its category's margin by the others. Rounds go on until no margin
is off by more than TOLERANCE (ROUNDS at most; margin_error then says by how much a cell's margins are missed,
so that targets which no sample can meet together show). A document is in when a hash of the seed and its key
lies below its cell's probability, so a draw does not depend on partitioning. All of it is DataFrame work;
texts are read once, cells, not documents, go through the rounds.

Target margins follow the data unless given: a share to a power below one lifts small sources against
large ones. A category that holds fewer tokens than its share of the budget gives all it has, and the others
of its margin share the rest. The topic is read off the text's form, unless the table has a column for it.

Defined results: a null source, language or topic is a category of its own, named (none); a null or blank text
has no tokens and the topic short; cells without tokens have the budget as probability; a null key draws as an empty
one; rows that repeat a key share their draw; an empty table gives an empty one; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut
from .text_stats import SPACES

ROUNDS, TOLERANCE, BUDGET, SEED = 40, 1e-9, 0.5, 20

#: Exponents of the target shares of source, language and topic.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}

#: Cells up to which raking runs in one task without shuffles, and its rounds in one job there; more cells are dealt
#: by margin. Both give the same result.
CELLS, BATCH = 100_000, 3

#: Form of a text, in SQL that Spark and DuckDB share.
TOPIC = """CASE WHEN n_pipes * 5 > n_words THEN 'table' WHEN n_exclaim * 2 > n_words THEN 'loud'
 WHEN n_words < 50 THEN 'short' WHEN n_words < 500 THEN 'medium' ELSE 'long' END"""


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, carry: bool = True) -> DataFrame:
    """(id, source, lang, topic, n_tokens) of every row, and with `carry` the row itself as _row."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(none)"))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    step = docs.select(
        *row,
        F.col(f"`{key}`").cast("bigint").alias("id"),
        named(source).alias("source"),
        named(lang).alias("lang"),
        *([named(topic).alias("_given")] if topic else []),
        F.btrim(t, F.lit(SPACES)).alias("_t"),
    )
    step = step.select(
        "*",
        F.when(F.col("_t") == "", 0).otherwise(F.size(F.split("_t", SPACE_CLASS + "+"))).cast("bigint").alias("n_words"),
        (F.length("_t") - F.length(F.translate("_t", "|", ""))).alias("n_pipes"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("n_exclaim"),
    )
    form = F.col("_given") if topic else F.expr(TOPIC)
    return step.select(*(["_row"] if carry else []), "id", "source", "lang", form.alias("topic"), F.col("n_words").alias("n_tokens"))


# The steps below are SQL that Spark and DuckDB share; {x} are names of tables, `e` is the power's literal suffix.


def _targets_sql(cells: str, m: str, budget: str, shares: str) -> str:
    """(category, target): the tokens that a margin's categories are to give. Shares are filled up from the category
    that has least tokens for its share: as long as a common rate would ask it for more than it has, it gives all."""
    return f"""SELECT {m} AS category, CASE WHEN spent THEN have ELSE least(have, share * coalesce((total - coalesce(sum(CASE WHEN spent THEN have END) OVER (), 0)) / nullif(sum(CASE WHEN spent THEN 0 ELSE share END) OVER (), 0), 0)) END AS target
FROM (SELECT *, sum(have) OVER (ORDER BY have / share, {m} ROWS UNBOUNDED PRECEDING) + have / share * (1 - sum(share) OVER (ORDER BY have / share, {m} ROWS UNBOUNDED PRECEDING)) <= total AS spent
FROM (SELECT {m}, have, {budget} * sum(have) OVER () AS total, power / sum(power) OVER () AS share FROM
(SELECT {m}, have, {shares} AS power FROM (SELECT {m}, sum(tokens) AS have FROM {cells} GROUP BY {m}) WHERE have > 0) WHERE power > 0))"""


def _step_sql(m: str) -> tuple[str, str]:
    """(error, u) after one margin's step: cells at the bound stay, the others take what is left of the target."""
    capped = f"sum(CASE WHEN u >= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY {m})"
    free = f"sum(CASE WHEN u < 1 THEN tokens * u ELSE 0 END) OVER (PARTITION BY {m})"
    off = f"CASE WHEN {m}_target > 0 THEN abs(({capped} + {free}) / {m}_target - 1) ELSE 0 END"
    factor = f"CASE WHEN {m}_target > {capped} AND {free} > 0 THEN ({m}_target - {capped}) / {free} WHEN {capped} + {free} > 0 THEN {m}_target / ({capped} + {free}) ELSE 1 END"
    return off, f"u * {factor}"


def _power(m: str, given: dict[str, float] | None, suffix: str) -> str:
    """A category's share before it is made to sum to one; given shares stand, the others share what is left by power."""
    if not given:
        return f"pow(have, {POWERS[m]}{suffix})"
    names = {k: "'" + k.replace("'", "''") + "'" for k in given}
    listed = ", ".join(names.values())
    rest = max(0.0, 1.0 - sum(given.values()))
    cases = " ".join(f"WHEN {m} = {names[k]} THEN {float(v)!r}{suffix}" for k, v in given.items())
    return f"CASE {cases} ELSE {rest!r}{suffix} * pow(have, {POWERS[m]}{suffix}) / sum(CASE WHEN {m} IN ({listed}) THEN 0 ELSE pow(have, {POWERS[m]}{suffix}) END) OVER () END"


def fit(rows: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, cells_in_one: int = CELLS) -> DataFrame:
    """(source, lang, topic, tokens, weight, p, margin_error) by cell, weight being p against a plain draw. `targets`
    may give shares of categories by margin; a category that it leaves out shares what is left by tokens."""
    cells = cut(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("tokens")))
    small = cells.count() <= cells_in_one
    now = cells.withColumn("u", F.lit(float(budget)))
    for m in POWERS:
        wanted = cells.sparkSession.sql(_targets_sql("{cells}", m, f"{float(budget)!r}D", _power(m, (targets or {}).get(m), "D")), cells=cells)
        now = now.join(wanted.withColumnRenamed("target", f"{m}_target"), now[m] == wanted["category"], "left").drop("category").fillna(0.0, [f"{m}_target"])
    now = cut(now)
    for done in range(0, ROUNDS, BATCH):
        now = now.coalesce(1) if small else now
        for _ in range(min(BATCH, ROUNDS - done)):
            now = now.withColumn("error", F.lit(0.0))
            for m in POWERS:
                off, u = _step_sql(m)
                now = now.withColumns({"error": F.greatest("error", F.expr(off)), "u": F.expr(u)})
        now = cut(now)
        if (now.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
    p = F.least(F.lit(1.0), "u")
    return now.select("source", "lang", "topic", "tokens", (p / float(budget)).alias("weight"), p.alias("p"), F.col("error").alias("margin_error"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", budget: float = BUDGET, seed: int = SEED, targets=None, topic: str | None = None, carry: bool = True) -> DataFrame:
    """(_row, id, source, lang, topic, n_tokens, weight, p, margin_error, kept) of every row. Without `carry` there is
    no _row, and the narrow rows are written once, so that texts are read once."""
    rows = measured(docs, key, text, source, lang, topic, carry)
    rows = rows if carry else cut(rows)
    cells = fit(rows.drop("_row") if carry else rows, budget, targets)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return rows.join(cells.drop("tokens"), ["source", "lang", "topic"], "left").withColumn("kept", F.coalesce(u < F.col("p"), F.lit(False)))


def sampled(docs: DataFrame, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The documents drawn, columns as they were."""
    return mixture(docs, budget=budget, seed=seed).where("kept").select("_row.*")


def mixture_sql(source: str = "SELECT * FROM documents", budget: float = BUDGET, seed: int = SEED, prefix: str = "mix") -> str:
    """DuckDB CTEs up to `{prefix}_drawn`: the columns of the source plus topic, n_tokens, weight, p and kept. All
    rounds are run: those after convergence change nothing that shows in six decimals."""
    x = prefix
    ctes = [
        rf"""{x}_rows AS MATERIALIZED (SELECT *, {TOPIC} AS topic FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
 length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', '')) AS n_pipes, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS n_exclaim,
 coalesce(source, '(none)') AS m_source, coalesce(lang, '(none)') AS m_lang FROM ({source})))""",
        f"{x}_base AS MATERIALIZED (SELECT m_source AS source, m_lang AS lang, topic, sum(n_words)::DOUBLE AS tokens FROM {x}_rows GROUP BY ALL)",
        *[f"{x}_{m} AS MATERIALIZED ({_targets_sql(f'{x}_base', m, f'{budget}::DOUBLE', _power(m, None, '::DOUBLE'))})" for m in POWERS],
        f"{x}_w0 AS MATERIALIZED (SELECT b.*, {budget}::DOUBLE AS u, "
        + ", ".join(f"coalesce({m}.target, 0) AS {m}_target" for m in POWERS)
        + f" FROM {x}_base b "
        + " ".join(f"LEFT JOIN {x}_{m} {m} ON {m}.category = b.{m}" for m in POWERS)
        + ")",
    ]
    steps = [m for _ in range(ROUNDS) for m in POWERS]
    ctes += [f"{x}_w{n + 1} AS MATERIALIZED (SELECT * REPLACE ({_step_sql(m)[1]} AS u) FROM {x}_w{n})" for n, m in enumerate(steps)]
    ctes.append(
        f"""{x}_drawn AS MATERIALIZED (SELECT d.*, d.n_words AS n_tokens, least(1, u) / {budget}::DOUBLE AS weight, least(1, u) AS p,
 ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < least(1, u) AS kept
 FROM {x}_rows d JOIN {x}_w{len(steps)} c ON c.source = d.m_source AND c.lang = d.m_lang AND c.topic = d.topic)"""
    )
    return ", ".join(ctes)


ORACLE = f"WITH {mixture_sql()} SELECT doc_id, m_source AS source, m_lang AS lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS p, kept FROM mix_drawn"
