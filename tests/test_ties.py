"""Results that rounding errors, the order of rows or nulls must not decide."""

from datetime import datetime, timedelta
from itertools import permutations

from pyspark.sql import functions as F

from loomstead.functions.columns import guarded_corr, round_away
from loomstead.operators import features as X
from loomstead.plans.catalog import QUERIES  # noqa: F401  enters the queries
from loomstead.plans.feature_queries import window_features


def test_one_pair_has_no_correlation(spark):
    df = spark.createDataFrame([(1, "a", 1, 72.72), (1, "b", 2, 6.98), (2, "a", 1, 1.0), (2, "a", 2, 2.0), (2, "b", 3, 5.0), (2, "b", 4, 4.0), (2, "b", 5, 9.0)], "g int, kind string, t int, v double")
    out = {r.g: r["corr"] for r in X.positional_corr(df, ["g"], "kind", ["t"], "v", "a", "b").collect()}
    assert out[1] == 0.0 and round(out[2], 9) == -1.0
    assert df.where("g = 2 AND kind = 'a'").agg(guarded_corr("v", F.lit(3.0)).alias("c")).first().c == 0.0


def test_rounds_the_scaled_value(spark):
    # 1.005 * 100 is below the tie, 2.675 * 100 is on it
    df = spark.createDataFrame([(1.005,), (2.675,), (-0.125,), (-0.001,), (1e307,), (None,), (float("nan"),)], "x double")
    got = [r.y for r in df.select(round_away("x", 2).alias("y")).collect()]
    assert str(got[:6]) == str([1.0, 2.68, -0.13, 0.0, 1e307, None]) and got[6] != got[6]


def test_sides_do_not_depend_on_arrival(spark):
    # the mean is 0.2; in this order the sum is 0.6000000000000001, in the reverse 0.6
    rows = [(1, 1, 0.1), (1, 2, 0.2), (1, 3, 0.3)]
    one, other = ([X.crossings_and_jerk(spark.createDataFrame(r, "g int, t int, v double").coalesce(1), ["g"], ["t"], "v").first() for r in (rows, rows[::-1])])
    assert one == other and one.zcr == 0.5


def test_order_of_rows_does_not_fire_a_rule(spark, tmp_path):
    # the mean of these is 50; their sum is above 150 in some orders and 150 in others
    hour = datetime(2024, 1, 1)
    rows = []
    for user, values in enumerate(permutations((0.02, 70.3, 79.68))):
        rows += [(10 * user + i, hour + timedelta(minutes=i), user, "click", v) for i, v in enumerate((*values, 1.0))]
        rows[-1] = (rows[-1][0], hour + timedelta(hours=30), user, "click", 1.0)
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    first = window_features(spark, str(tmp_path)).where("window_index = 0").select("ui_node_count_mean", "gyro_mag_mean").collect()
    assert len(first) == 6 and {tuple(r) for r in first} == {(3.0, 0.5)}
