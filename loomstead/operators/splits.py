"""Leakage-checked train, validation and test splits by stable hashes; impostor pairing; audits.

Assignments are made on the distinct groups (sessions, packages, days) and joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_number, stable_bucket


def assign_by_fraction(groups: DataFrame, key: str, seed: int, val: float, test: float, within: list[str] | None = None) -> DataFrame:
    """Adds split to a frame of distinct keys: by stable bucket, the first share to test, the next to val, the rest
    to train, at least one each; two keys give train and test, a single one train. `within` splits each of its groups."""
    by = within or [F.lit(0)]
    placed = groups.withColumn("_bucket", stable_bucket(key, seed, 1000))
    placed = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_bucket", key))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    n, i = F.col("_n"), F.col("_i")
    n_test, n_val = F.greatest(F.lit(1.0), F.rint(n * test)), F.greatest(F.lit(1.0), F.rint(n * val))
    n_val = F.when(n_test + n_val > n - 1, F.greatest(F.lit(0.0), n - 1 - n_test)).otherwise(n_val)
    n_test = F.least(n_test, n - 1)
    split = F.when(n == 1, "train").when(n == 2, F.when(i == 1, "train").otherwise("test")).when(i <= n_test, "test").when(i <= n_test + n_val, "val").otherwise("train")
    return placed.withColumn("split", split).drop("_bucket", "_i", "_n")


def leave_session_out(rows: DataFrame, user: str, session: str, seed: int = 42, val: float = 0.2, test: float = 0.2) -> DataFrame:
    """Every user's sessions are split on their own; single-session users train only."""
    groups = assign_by_fraction(rows.select(user, session).distinct(), session, seed, val, test, [user])
    return rows.join(groups, [user, session])


def leave_app_out(rows: DataFrame, package: str, seed: int = 42, val: float = 0.25, test: float = 0.25) -> DataFrame:
    return rows.join(assign_by_fraction(rows.select(package).distinct(), package, seed, val, test), package)


def leave_day_out(rows: DataFrame, user: str, day: str) -> DataFrame:
    """A user's last day is test, the day before it val (with three days or more), earlier ones train; one day trains."""
    days = rows.select(user, day).distinct()
    w = Window.partitionBy(user)
    days = days.withColumn("_i", F.row_number().over(w.orderBy(day))).withColumn("_n", F.count(F.lit(1)).over(w))
    split = F.when(F.col("_n") == 1, "train").when(F.col("_i") == F.col("_n"), "test").when((F.col("_i") == F.col("_n") - 1) & (F.col("_n") >= 3), "val").otherwise("train")
    return rows.join(days.select(user, day, split.alias("split")), [user, day])


def combined_day_app(rows: DataFrame, day: str, package: str, seed: int = 42, val: float = 0.2, test: float = 0.25) -> DataFrame:
    """Last day with a test package is test, with a val package val; earlier days with the other packages train; the rest goes."""
    apps = assign_by_fraction(rows.select(package).distinct(), package, seed, val, test).withColumnRenamed("split", "_app")
    last = rows.agg(F.max(day).alias("_last"))
    joined = rows.join(apps, package).join(F.broadcast(last))  # one row
    at_end = F.col(day) == F.col("_last")
    split = F.when(at_end & (F.col("_app") == "test"), "test").when(at_end & (F.col("_app") == "val"), "val").when(~at_end & (F.col("_app") == "train"), "train")
    return joined.withColumn("split", split).where("split IS NOT NULL").drop("_app", "_last")


PROTOCOLS = {"leave_session_out": leave_session_out, "leave_day_out": leave_day_out, "leave_app_out": leave_app_out, "combined_day_app": combined_day_app, "combined": combined_day_app}


def make_split(rows: DataFrame, protocol: str, **options) -> DataFrame:
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown split protocol {protocol!r}; known: {sorted(PROTOCOLS)}")
    return PROTOCOLS[protocol](rows, **options)


def stable_seed(*parts: Column | str, base: int = 42) -> Column:
    """63-bit seed from a base and values."""
    text = F.concat_ws(":", F.lit(str(base)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(1 << 63).cast("decimal(20,0)")


def matched_impostors(genuine: DataFrame, pool: DataFrame, user: str, row: str, scene: str, topk: str, n: int = 1, seed: int = 42, parts: int = 1) -> DataFrame:
    """For each genuine row, n pool rows of other users with its scene; where there is none, rows that have the scene
    among their top scenes. Rows without either are left out.

    Choosing among all pairs of a scene would grow with its square. Pool rows stand on a ring by a hash of seed
    and row instead; a genuine row's own hash is its place, and it takes the next n rows of other users. A scene's
    ring is cut into `parts` stretches, a power of two, so that a pool of few large scenes makes many tasks (the pairs are
    the same; 1 spares the carrying over where pools are small). To step over its own user, each row knows the next
    candidate and the next one of another user, within its stretch or behind it.
    """
    exact = _ring(genuine.select(F.col(row).alias("genuine_row"), F.col(user).alias("genuine_user"), F.col(scene).alias("scene")), pool.select(F.col(row).alias("impostor_row"), F.col(user).alias("impostor_user"), F.col(scene).alias("scene")), n, seed, parts)
    g = genuine.select(F.col(row).alias("genuine_row"), F.col(user).alias("genuine_user"), F.col(scene).alias("scene"))
    left = g.join(exact.select("genuine_row").distinct(), "genuine_row", "left_anti")
    wide = pool.select(F.col(row).alias("impostor_row"), F.col(user).alias("impostor_user"), F.explode(topk).alias("scene"))
    return exact.withColumn("matched_exact", F.lit(True)).unionByName(_ring(left, wide, n, seed, parts).withColumn("matched_exact", F.lit(False)))


def _ring(genuine: DataFrame, pool: DataFrame, n: int, seed: int, parts: int) -> DataFrame:
    """(genuine_row, impostor_row, genuine_user, impostor_user, scene): the next n rows of other users on the ring. A
    round finds the next one from where the last one stands, until a row has n or is once around."""
    place = lambda c: hash_number(F.concat_ws(":", F.lit(str(seed)), F.col(c).cast("string")), 13)
    asks = genuine.withColumn("start", place("genuine_row")).withColumn("h", F.col("start")).withColumn("after", F.lit(None).cast(pool.schema["impostor_row"].dataType))
    ring = pool.select("scene", place("impostor_row").alias("h"), "impostor_row", "impostor_user")
    ring = ring.union(ring.withColumn("h", F.col("h") + F.lit(1 << 52)))  # so that the ring closes
    out = None
    for _ in range(n):
        found = _next_on_ring(asks, ring, parts).where(F.col("h") < F.col("start") + F.lit(1 << 52))
        one = found.select("genuine_row", "impostor_row", "genuine_user", "impostor_user", "scene")
        out = one if out is None else out.unionByName(one)
        asks = found.select("genuine_row", "genuine_user", "scene", "start", "h", F.col("impostor_row").alias("after"))
    return out


def _scanned(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds to rows (h, _at, side, impostor_row, impostor_user) of a stretch of the ring _next, the nearest candidate at or
    behind a row, and _other, the nearest one of another user than that."""
    # going down the ring, a row carries both along
    back = Window.partitionBy(*by).orderBy(F.desc("h"), F.desc_nulls_last("_at"), F.desc("side"))
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_next", F.last(F.when(F.col("side") == 1, F.struct("impostor_row", "impostor_user", "h")), ignorenulls=True).over(upto))
    rows = rows.withColumn("_previous", F.lag("_next").over(back))
    turned = F.when((F.col("side") == 1) & (F.col("_previous.impostor_user") != F.col("impostor_user")), F.col("_previous"))
    return rows.withColumn("_other", F.last(turned, ignorenulls=True).over(upto)).drop("_previous")


def _carried(ring: DataFrame, parts: int) -> DataFrame:
    """(scene, part, _far, _far_other) of each part that has one: the first candidate behind the part, and the first one
    of another user than that. A part's own first two candidates of different users tell all that the parts before it
    need, so a scene's window holds three rows a part, whatever the size of the pool."""
    least = ring.groupBy("scene", "part", "impostor_user").agg(F.min(F.struct("h", "impostor_row")).alias("m"))
    firsts = least.withColumn("_i", F.row_number().over(Window.partitionBy("scene", "part").orderBy("m"))).where("_i <= 2")
    entry = firsts.select("scene", "part", "m.h", F.col("m.impostor_row").alias("_at"), F.lit(1).alias("side"), "m.impostor_row", "impostor_user")
    kind = dict(ring.dtypes)
    none = {c: F.lit(None).cast(kind[c]) for c in ("impostor_row", "impostor_user")}
    ends = ring.select("scene").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    end = ends.select("scene", "part", ((F.col("part") + 1).cast("bigint") * F.lit((1 << 53) // parts)).alias("h"), none["impostor_row"].alias("_at"), F.lit(0).alias("side"), none["impostor_row"].alias("impostor_row"), none["impostor_user"].alias("impostor_user"))
    rows = _scanned(entry.unionByName(end), ["scene"])
    return rows.where("side = 0 AND _next IS NOT NULL").select("scene", "part", F.col("_next").alias("_far"), F.col("_other").alias("_far_other"))


def _next_on_ring(asks: DataFrame, ring: DataFrame, parts: int) -> DataFrame:
    """The asks (genuine_row, genuine_user, scene, start, h, after) with the next row of another user behind (h, after).

    A scene's ring is cut into `parts` equal stretches, each a window of its own; what a stretch does not hold comes from
    the first candidates of those behind it."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    a = asks.select("scene", "h", F.col("after").alias("_at"), F.when(F.col("after").isNull(), 0).otherwise(2).alias("side"), none(ring, "impostor_row"), none(ring, "impostor_user"), "genuine_row", "genuine_user", "start")
    b = ring.select("scene", "h", F.col("impostor_row").alias("_at"), F.lit(1).alias("side"), "impostor_row", "impostor_user", none(asks, "genuine_row"), none(asks, "genuine_user"), none(asks, "start"))
    part = F.floor(F.col("h") / F.lit((1 << 53) // parts)).cast("int")
    fits = lambda c: F.when(F.col(f"{c}.impostor_user") != F.col("genuine_user"), F.col(c))
    rows = _scanned(a.unionByName(b).withColumn("part", part), ["scene", "part"]).where("side <> 1")
    if parts == 1:
        found = rows.withColumn("_pick", F.coalesce(fits("_next"), fits("_other"))).where("_pick IS NOT NULL")
        return found.select("genuine_row", "genuine_user", "scene", "start", "_pick.h", "_pick.impostor_row", "_pick.impostor_user")
    far = _carried(ring.withColumn("part", part), parts).withColumnsRenamed({"scene": "_s", "part": "_p"})
    rows = rows.join(far, F.col("scene").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")), "left")
    found = rows.withColumn("_pick", F.coalesce(fits("_next"), fits("_other"), fits("_far"), fits("_far_other"))).where("_pick IS NOT NULL")
    return found.select("genuine_row", "genuine_user", "scene", "start", "_pick.h", "_pick.impostor_row", "_pick.impostor_user")


def leakage_audit(rows: DataFrame, pairs: DataFrame, user: str, session: str, row: str) -> DataFrame:
    """One row of booleans, each true if the split is sound: sessions, rows and pairs kept apart, impostors from test."""
    shared = lambda c: rows.groupBy(c).agg(F.countDistinct("split").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1))
    one = lambda df, name: df.toDF(name)
    users = pairs.agg(F.coalesce(F.bool_and(F.col("genuine_user") != F.col("impostor_user")), F.lit(True)))
    outside = pairs.join(rows.where("split = 'test'").select(F.col(row).alias("impostor_row")), "impostor_row", "left_anti").agg(F.count(F.lit(1)) == 0)
    parts = [one(shared(session), "session_disjoint"), one(shared(row), "row_disjoint"), one(users, "users_differ"), one(outside, "impostors_from_test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def user_coverage(rows: DataFrame, user: str) -> DataFrame:
    """Per user: whether it is tested and enrolled, for users that lack either."""
    seen = rows.groupBy(user).agg(F.bool_or(F.col("split") == "test").alias("tested"), F.bool_or(F.col("split").isin("train", "val")).alias("enrolled"))
    return seen.where("NOT tested OR NOT enrolled")
