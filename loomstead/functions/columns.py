"""Column expressions shared by the operators: clocks, stable hashes, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wall_millis(ts: str) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} AS TIMESTAMP_NTZ)) div 1000")


def moment(ms: str | Column) -> Column:
    """Zone-less UTC timestamp of epoch milliseconds."""
    day = F.lit(86_400_000)
    in_day = (F.pmod(col(ms), day) / 1000).cast("decimal(18,6)")
    return F.expr(EPOCH) + F.make_dt_interval(F.floor(col(ms) / day).cast("int"), F.lit(0), F.lit(0), in_day)


def local_day(ms: str | Column, zone: str = "UTC") -> Column:
    """Calendar day (yyyy-MM-dd) of epoch milliseconds in a zone, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment(ms)), "yyyy-MM-dd")


def hash_number(text: Column, digits: int) -> Column:
    """The first `digits` (15 at most) hex digits of a text's SHA-256 as a bigint."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, digits), 16, 10).cast("bigint")


def stable_bucket(key: str | Column, seed: int | str, buckets: int, digits: int = 12) -> Column:
    """Bucket of a key that never depends on order or partitioning."""
    return hash_number(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), digits) % buckets


def half_even(x: Column) -> Column:
    return F.rint(x)


def round_away(x: str | Column, digits: int) -> Column:
    """A double to so many decimals, ties of the scaled value away from zero, as SQL engines round doubles. (Spark's own
    round() looks at the decimal text of x, which parts from the scaled value near a tie.) Never a negative zero."""
    value, scale = col(x).cast("double"), F.lit(float(10**digits))
    scaled = F.round(value * scale) / scale
    return F.when(F.abs(scaled) == float("inf"), value).otherwise(scaled) + F.lit(0.0)


def quantize(x: str | Column, step: float) -> Column:
    """Nearest multiple of step, ties to the even one."""
    return F.rint(col(x) / F.lit(step)) * F.lit(step)


def clip01(x: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def guarded_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation in [-1, 1]; 0 for fewer than two rows or a side without spread. An aggregate.

    Bounded only where there is one: least() and greatest() pass over nulls."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    flat = (F.count(a) < 2) | (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12)
    r = F.when(~flat, F.covar_pop(a, b) / F.when(spread > 0, spread))
    return F.when(r.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def guarded_skew(x: str) -> Column:
    """Population skewness; 0 below three rows or without spread. An aggregate."""
    return F.coalesce(F.when((F.count(x) >= 3) & (F.stddev_pop(x) >= 1e-12), F.skewness(x)), F.lit(0.0))


def guarded_kurtosis(x: str) -> Column:
    """Population excess kurtosis; 0 below four rows or without spread. An aggregate."""
    return F.coalesce(F.when((F.count(x) >= 4) & (F.stddev_pop(x) >= 1e-12), F.kurtosis(x)), F.lit(0.0))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    t = max(1e-6, temperature)
    e = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length to speak of."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))
