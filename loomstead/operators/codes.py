"""Dense codes: every different value of a column gets its place in sorted order, from 0, without a global window.

Values are dealt to ranges of roughly equal size, whose bounds come from a sample of fixed size; a range is numbered by
itself and begins where the ranges before it end. The bounds decide only how even the ranges are, never a code. What
passes through the driver is a bound and a count for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and sampled values for each bound.
RANGES, SAMPLED = 64, 20


def _bounds(values: DataFrame, ranges: int) -> list:
    """Bounds of ranges of roughly equal size: of the values with the smallest hashes every so many-th."""
    sample = values.orderBy(F.xxhash64("value"), "value").limit(ranges * SAMPLED).orderBy("value").collect()
    step = max(1, len(sample) // ranges)
    return [r.value for r in sample[step::step]]


def _placed(values: DataFrame, bounds: list, kind: str) -> DataFrame:
    """Adds _range, the number of bounds at or below a value, by halving."""
    out = values.withColumn("_range", F.lit(0))
    if not bounds:
        return out
    held, width = F.array(*[F.lit(b).cast(kind) for b in bounds]), 1 << (len(bounds).bit_length() - 1)
    while width:
        at = F.col("_range") + width
        beyond = (at <= len(bounds)) & (F.get(held, F.least(at, F.lit(len(bounds))) - 1) <= F.col("value"))
        out = out.withColumn("_range", F.when(beyond, at).otherwise(F.col("_range")))
        width //= 2
    return out


def dense_codes(values: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """(value, code) of the different non-null values of a column, by value from 0: dense_rank() - 1 in parallel."""
    distinct = values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    bounds = _bounds(distinct, ranges)
    placed = _placed(distinct, bounds, dict(values.dtypes)[column])
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    starts = [0]
    for i in range(len(bounds)):
        starts.append(starts[-1] + counts.get(i, 0))
    start = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_range"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return placed.select("value", (start + number).alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the code of a column as `name`; null stays null."""
    return df.join(codes.select(F.col("value").alias(column), F.col("code").alias(name)), column, "left")
