"""Queries over window features, weak labels and flags (survey rows F, B and Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr, hash_number, quantize, round_away
from ..operators import features as X
from ..operators import scene_rules as R
from .catalog import register
from .stream_queries import EV, WIN, stream, windows

DAY = 86_400_000
_M = "count({x}) OVER w"


def rounded(df, *names, digits=6):
    """Round these columns."""
    return df.select(*[round_away(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def r(x, digits=6):
    return f"(round({x}, {digits}) + 0.0)"


SKEW = "CASE WHEN count({x}) >= 3 AND stddev_pop({x}) >= 1e-12 THEN (avg({x}*{x}*{x}) - 3*avg({x})*avg({x}*{x}) + 2*avg({x})*avg({x})*avg({x})) / pow(stddev_pop({x}), 3) ELSE 0 END"
KURT = "CASE WHEN count({x}) >= 4 AND stddev_pop({x}) >= 1e-12 THEN kurtosis_pop({x}) ELSE 0 END"


@register("axis_time_stats", "F1 F4 F5", f"""WITH {EV} SELECT device, {r('avg(value)')} AS v_mean, {r('stddev_pop(value)')} AS v_std, min(value) AS v_min, max(value) AS v_max,
 {r('sqrt(avg(value*value))')} AS v_rms, {r('avg(value*value)', 4)} AS v_energy, {r(SKEW.format(x='value'), 5)} AS v_skew, {r(KURT.format(x='value'), 5)} AS v_kurt FROM ev GROUP BY device""")
def axis_time_stats(spark, sf_dir):
    out = stream(spark, sf_dir).groupBy("device").agg(*X.time_stats("value", "v"))
    return rounded(rounded(rounded(out, "v_mean", "v_std", "v_rms"), "v_energy", digits=4), "v_skew", "v_kurt", digits=5)


@register("zero_crossing_jerk", "F2 F3", f"""WITH {EV}, s AS (SELECT *, value - avg(value) OVER (PARTITION BY device) < 0 AS side FROM ev),
t AS (SELECT device, (side <> lag(side) OVER w)::INT AS turn, value - lag(value) OVER w AS step FROM s WINDOW w AS (PARTITION BY device ORDER BY wall, event_id))
SELECT device, {r('coalesce(avg(turn), 0)')} AS zcr, {r('coalesce(avg(step*step), 0)', 4)} AS jerk FROM t GROUP BY device""")
def zero_crossing_jerk(spark, sf_dir):
    return rounded(rounded(X.crossings_and_jerk(stream(spark, sf_dir), ["device"], ["wall", "event_id"], "value"), "zcr"), "jerk", digits=4)


@register("sampling_rate_estimate", "F7", f"""WITH {EV}, d AS (SELECT device, kind, wall - lag(wall) OVER (PARTITION BY device, kind ORDER BY wall) AS d FROM ev)
SELECT device, kind, {r('coalesce(3600000.0 / median(CASE WHEN d > 0 THEN d END), 100.0)')} AS rate FROM d GROUP BY device, kind""")
def sampling_rate_estimate(spark, sf_dir):
    return rounded(X.sampling_rate(stream(spark, sf_dir), ["device", "kind"], "wall", 3_600_000.0), "rate")


@register("magnitude_corr", "F8 F12", f"""WITH m AS (SELECT l_suppkey, sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax) AS a, l_extendedprice AS b FROM lineitem)
SELECT l_suppkey, {r('avg(a)')} AS mag_mean, {r('stddev_pop(a)')} AS mag_std, {r('avg(a*a)', 4)} AS mag_energy,
 {r('CASE WHEN count(*) < 2 OR stddev_pop(a) < 1e-12 OR stddev_pop(b) < 1e-12 THEN 0 ELSE greatest(-1, least(1, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)))) END')} AS corr FROM m GROUP BY l_suppkey""")
def magnitude_corr(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = li.select("l_suppkey", F.expr("sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax)").alias("a"), F.col("l_extendedprice").alias("b"))
    out = m.groupBy("l_suppkey").agg(F.avg("a").alias("mag_mean"), F.stddev_pop("a").alias("mag_std"), F.avg(F.col("a") * F.col("a")).alias("mag_energy"), guarded_corr("a", "b").alias("corr"))
    return rounded(rounded(out, "mag_mean", "mag_std", "corr"), "mag_energy", digits=4)


@register("positional_corr", "F12 L4", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY device, kind ORDER BY wall, event_id) AS pos FROM ev),
p AS (SELECT x.device, x.value AS a, y.value AS b FROM n x JOIN n y ON x.device = y.device AND x.pos = y.pos AND x.kind = 'click' AND y.kind = 'view')
SELECT device, {r('CASE WHEN count(*) < 2 OR stddev_pop(a) < 1e-12 OR stddev_pop(b) < 1e-12 THEN 0 ELSE greatest(-1, least(1, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)))) END')} AS corr FROM p GROUP BY device""")
def positional_corr(spark, sf_dir):
    return rounded(X.positional_corr(stream(spark, sf_dir), ["device"], "kind", ["wall", "event_id"], "value", "click", "view"), "corr")


@register("orientation_circular", "F10 F11", f"""WITH s AS (SELECT l_suppkey, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax * 100 - 4 AS z FROM lineitem),
o AS (SELECT l_suppkey, x, y, atan2(-x, sqrt(y*y + z*z)) AS pitch, atan2(y, z) AS roll, atan2(y, x) AS h FROM s)
SELECT l_suppkey, {r('avg(pitch)')} AS pitch_mean, {r('stddev_pop(pitch)')} AS pitch_std, {r('avg(roll)')} AS roll_mean, {r('stddev_pop(roll)')} AS roll_std,
 (abs(avg(x)) > abs(avg(y)))::DOUBLE AS landscape, {r('sqrt(pow(avg(cos(h)), 2) + pow(avg(sin(h)), 2))')} AS heading_stability FROM o GROUP BY l_suppkey""")
def orientation_circular(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = li.select("l_suppkey", (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100 - 5).alias("y"), (F.col("l_tax") * 100 - 4).alias("z"))
    out = s.groupBy("l_suppkey").agg(*X.orientation("x", "y", "z"), X.heading_stability("x", "y"))
    return rounded(out, "pitch_mean", "pitch_std", "roll_mean", "roll_std", "heading_stability")


@register("motion_bins", "F13", f"""WITH {WIN} SELECT device, window_index, {r('avg((value < 20)::INT)')} AS motion_low, {r('avg((value >= 20 AND value < 80)::INT)')} AS motion_mid, {r('avg((value >= 80)::INT)')} AS motion_high,
 count(*) FILTER (value > 80) AS bursts FROM wi GROUP BY device, window_index""")
def motion_bins(spark, sf_dir):
    out = windows(spark, sf_dir).groupBy("device", "window_index").agg(*X.motion_bins(F.col("value"), 20.0, 80.0))
    return rounded(out, "motion_low", "motion_mid", "motion_high")


KINDS = ["click", "view", "signup", "purchase", "error"]
MIX = f"""{WIN}, c AS (SELECT device, window_index, kind, count(*) AS n FROM wi GROUP BY ALL),
mix AS (SELECT device, window_index, {', '.join(f"coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS n_{k}" for k in KINDS)}, sum(n) / 24.0 AS rate, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM c GROUP BY device, window_index)"""


@register("event_counts_rate_entropy", "F14 F15 F16", f"WITH {MIX} SELECT * REPLACE ({r('rate')} AS rate, {r('entropy')} AS entropy) FROM mix")
def event_counts_rate_entropy(spark, sf_dir):
    return rounded(X.event_mix(windows(spark, sf_dir), ["device", "window_index"], "kind", KINDS, 24.0), "rate", "entropy")


#: The Fourier sums of every window's mean-free values, written out.
SPECTRA = f"""{WIN}, v AS (SELECT device, window_index, value::DOUBLE - avg(value::DOUBLE) OVER g AS x, row_number() OVER (PARTITION BY device, window_index ORDER BY wall, event_id) - 1 AS t, count(*) OVER g AS n FROM wi WINDOW g AS (PARTITION BY device, window_index)),
pw AS (SELECT device, window_index, n, k, pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2) AS p FROM v, UNNEST(range(0, n // 2 + 1)) AS u(k) GROUP BY ALL),
sh AS (SELECT device, window_index, n, k, k * (1.0 / (n * (1.0 / 50.0))) AS f, p / nullif(sum(p) OVER g, 0) AS q, sum(p) OVER g AS total FROM pw WINDOW g AS (PARTITION BY device, window_index)),
sp AS (SELECT device, window_index, first(f ORDER BY round(q, 9) DESC, k) AS domfreq, sum(f * q) AS speccentroid, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) AS specentropy,
 sum(CASE WHEN f < 3 THEN q ELSE 0 END) AS band0_3, sum(CASE WHEN f >= 3 AND f < 8 THEN q ELSE 0 END) AS band3_8, sum(CASE WHEN f >= 8 AND f < 15 THEN q ELSE 0 END) AS band8_15, any_value(n) AS n, any_value(total) AS total FROM sh GROUP BY ALL)
SELECT device, window_index, """ + ", ".join(f"CASE WHEN n < 2 OR total < 1e-12 THEN 0.0 ELSE {r(c)} END AS {c}" for c in X.SPECTRUM) + " FROM sp"


@register("spectral_features", "F6", f"WITH {SPECTRA}")
def spectral_features(spark, sf_dir):
    return rounded(X.spectra(windows(spark, sf_dir), ["device", "window_index"], ["wall", "event_id"], "value", 50.0), *X.SPECTRUM)


PARTS = [("anodized", "edit"), ("brass", "list"), ("steel", "switch"), ("copper", "webview"), ("nickel", "text")]
PART_CASE = "CASE " + " ".join(f"WHEN contains(lower(coalesce(p_type, '')), '{a}') THEN '{b}'" for a, b in PARTS) + " ELSE 'other' END"


@register("class_bucket_histogram", "F18 F19", f"SELECT p_brand, {PART_CASE} AS bucket, count(*) AS n FROM part GROUP BY ALL")
def class_bucket_histogram(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy("p_brand", X.class_bucket(F.col("p_type"), PARTS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("tree_diff_l1", "F27", """WITH h AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL),
cs AS (SELECT DISTINCT c FROM h), ms AS (SELECT DISTINCT month FROM h), g AS (SELECT ms.month, cs.c, coalesce(h.n, 0) AS n FROM ms CROSS JOIN cs LEFT JOIN h ON h.month = ms.month AND h.c = cs.c),
d AS (SELECT month, n, lag(n) OVER (PARTITION BY c ORDER BY month) AS p FROM g)
SELECT month, abs(sum(n) - sum(p))::BIGINT AS node_delta, sum(abs(n - p))::BIGINT AS category_l1, coalesce(bool_or(n <> p), false) AS changed FROM d GROUP BY month""")
def tree_diff_l1(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).pivot("o_orderpriority").count().na.fill(0)
    kinds = [c for c in h.columns if c != "month"]
    months = h.select("month", F.array(*[F.col(f"`{c}`") for c in kinds]).alias("n"))
    # a row a month: the window without a partition runs over months, not orders
    prev = months.withColumn("p", F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("month")))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    steps = F.zip_with("n", "p", lambda a, b: F.abs(a - b))
    return prev.select("month", F.abs(add("n") - add("p")).alias("node_delta"), add(steps).alias("category_l1"), F.coalesce(F.exists(steps, lambda x: x > 0), F.lit(False)).alias("changed"))


@register("structural_hash", "F28", "SELECT l_orderkey, ('0x' || substr(sha256(string_agg(concat_ws('|', l_linenumber, l_returnflag, l_linestatus), chr(10) ORDER BY l_linenumber, concat_ws('|', l_linenumber, l_returnflag, l_linestatus))), 1, 8))::BIGINT AS structure FROM lineitem GROUP BY l_orderkey")
def structural_hash(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws("|", F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus").alias("line")))), lambda x: x["line"])
    return li.groupBy("l_orderkey").agg(X.structural_hash(lines).alias("structure"))


@register("bucket_hash", "F29 N9 G1", """SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 1024 AS package_hash, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 2147483648 AS window_hash,
 ('0x' || substr(sha256('42:' || c_name), 1, 12))::BIGINT % 1000 AS split_bucket FROM customer""")
def bucket_hash(spark, sf_dir):
    from ..functions.columns import stable_bucket

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    h = hash_number(F.col("c_name"), 8)
    return c.select("c_custkey", (h % 1024).alias("package_hash"), (h % (1 << 31)).alias("window_hash"), stable_bucket("c_name", 42, 1000).alias("split_bucket"))


#: Window features of the event stream under the names that the rules read.
NAMED = {
    "evt_click_count": "n_click", "evt_scroll_count": "n_view", "evt_textchanged_count": "n_signup", "evt_windowstate_count": "n_purchase", "evt_focus_count": "n_error",
    "evt_rate": "rate", "motion_energy_low": "low", "motion_energy_mid": "mid", "motion_energy_high": "high", "gyro_mag_mean": "mean", "ui_node_count_mean": "n", "ui_stable_ms": "span", "touch_rate": "rate",
}
FEATURES = f"""{MIX}, mo AS (SELECT device, window_index, avg((value < 20)::INT) AS low, avg((value >= 20 AND value < 80)::INT) AS mid, avg((value >= 80)::INT) AS high, avg(value) / 100 AS mean, count(*)::DOUBLE AS n,
 (max(wall) - min(wall)) / 10000.0 AS span, count(DISTINCT kind) AS kinds, bool_or(gap) AS any_gap FROM wi GROUP BY device, window_index),
f0 AS (SELECT * FROM mix JOIN mo USING (device, window_index)),
f AS (SELECT device, window_index, kinds, any_gap, n_error, n_signup, {', '.join(f'coalesce({NAMED[c]}, 0)::DOUBLE AS {c}' if c in NAMED else f'0::DOUBLE AS {c}' for c in R.READABLE)} FROM f0)"""
SCORED = f"{FEATURES}, sc AS (SELECT *, [{', '.join(R.score_sql(s) for s in R.SCENES)}] AS scores FROM f)"
LABELLED = f"""{SCORED}, ex AS (SELECT *, list_transform(scores, lambda s: exp(s - list_max(scores))) AS e FROM sc), pr AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex),
lb AS (SELECT *, list_reverse_sort(probs) AS sp, list_transform(list_reverse_sort(list_transform(range(1, 8), lambda i: {{'s': scores[i], 'i': i}}))[1:3], lambda x: 'I' || (x.i - 1)) AS topk FROM pr)"""


def window_features(spark, sf_dir):
    w = windows(spark, sf_dir)
    mix = X.event_mix(w, ["device", "window_index"], "kind", KINDS, 24.0)
    v = F.col("value")
    mean = F.round(F.avg("value"), 9)  # a rule's bound must not be crossed by the sum's rounding, which the order of rows decides
    motion = w.groupBy("device", "window_index").agg(
        F.avg((v < 20).cast("int")).alias("low"), F.avg(((v >= 20) & (v < 80)).cast("int")).alias("mid"), F.avg((v >= 80).cast("int")).alias("high"), (mean / 100).alias("mean"),
        F.count(F.lit(1)).cast("double").alias("n"), ((F.max("wall") - F.min("wall")) / 10000.0).alias("span"), F.countDistinct("kind").alias("kinds"), F.bool_or("time_gap").alias("any_gap"),
    )
    both = mix.join(motion, ["device", "window_index"])
    return both.select("device", "window_index", "kinds", "any_gap", "n_error", "n_signup", *[F.col(a).alias(c) for c, a in NAMED.items()])


@register("rule_scores", "B1 B8 L5", f"WITH {SCORED} SELECT device, window_index, {', '.join(f'round(scores[{i + 1}], 6) + 0.0 AS s{i}' for i in range(7))} FROM sc")
def rule_scores(spark, sf_dir):
    out = R.weak_labels(window_features(spark, sf_dir), ["device", "window_index"])
    return out.select("device", "window_index", *[(F.round(F.col("scores")[i], 6) + 0.0).alias(f"s{i}") for i in range(7)])


_LABEL_COLUMNS = f"""device, window_index, topk[1] AS top1, array_to_string(topk, ',') AS topk, {r('greatest(0, least(1, sp[1] - sp[4]))')} AS confidence,
 {r('-list_sum(list_transform(probs, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END))')} AS entropy, sp[1] < 0.35 OR greatest(0, least(1, sp[1] - sp[4])) < 0.1 AS low_confidence"""


@register("softmax_topk_confidence", "B9 B10 B11", f"WITH {LABELLED} SELECT {_LABEL_COLUMNS} FROM lb")
def softmax_topk_confidence(spark, sf_dir):
    out = R.weak_labels(window_features(spark, sf_dir), ["device", "window_index"])
    return rounded(out.select("device", "window_index", "top1", F.array_join("topk", ",").alias("topk"), "confidence", "entropy", "low_confidence"), "confidence", "entropy")


@register("weak_label_windows", "W3 W6 F14 B1 B11 F32", f"WITH {LABELLED} SELECT {_LABEL_COLUMNS}, {r('evt_rate')} AS evt_rate, {r('motion_energy_high')} AS motion_energy_high FROM lb")
def weak_label_windows(spark, sf_dir):
    f = window_features(spark, sf_dir).withColumns({"rate": F.col("evt_rate"), "high": F.col("motion_energy_high")})
    out = R.weak_labels(f, ["device", "window_index", "rate", "high"])  # what the result needs is kept along, so windows are computed once
    out = out.select("device", "window_index", "top1", F.array_join("topk", ",").alias("topk"), "confidence", "entropy", "low_confidence", F.col("rate").alias("evt_rate"), F.col("high").alias("motion_energy_high"))
    return rounded(out, "confidence", "entropy", "evt_rate", "motion_energy_high")


@register("quality_flags", "Q1 Q2 Q3 Q4 Q5 Q6 Q7", f"""WITH {LABELLED} SELECT device, window_index, array_to_string(list_filter([CASE WHEN kinds < 3 THEN 'missing_sensor' END, CASE WHEN ui_node_count_mean < 3 THEN 'low_record_count' END,
 CASE WHEN n_signup = 0 THEN 'missing_ui' END, CASE WHEN any_gap THEN 'time_gap' END, CASE WHEN kinds > 1 THEN 'app_transition_window' END, CASE WHEN n_error > 2 THEN 'privacy_violation' END,
 CASE WHEN sp[1] < 0.35 OR greatest(0, least(1, sp[1] - sp[4])) < 0.1 THEN 'low_confidence_label' END], lambda x: x IS NOT NULL), ',') AS flags FROM lb""")
def quality_flags(spark, sf_dir):
    f = window_features(spark, sf_dir).withColumn("nodes", F.col("ui_node_count_mean"))
    labels = R.weak_labels(f, ["device", "window_index", "kinds", "any_gap", "n_error", "n_signup", "nodes"])
    conditions = {
        "missing_sensor": F.col("kinds") < 3, "low_record_count": F.col("nodes") < 3, "missing_ui": F.col("n_signup") == 0, "time_gap": F.col("any_gap"),
        "app_transition_window": F.col("kinds") > 1, "privacy_violation": F.col("n_error") > 2,
    }
    return labels.select("device", "window_index", F.array_join(R.quality_flags(conditions, F.col("low_confidence")), ",").alias("flags"))


@register("canonical_scenes", "P5", """SELECT doc_id, CASE WHEN c IN ('I0', 'I1', 'I2', 'I3', 'I4', 'I5') THEN c WHEN c = 'I6' AND lang IS DISTINCT FROM 'de' THEN 'I6' WHEN c = 'I7' THEN 'I6' END AS scene
FROM (SELECT doc_id, lang, 'I' || (doc_id % 10) AS c FROM documents)""")
def canonical_scenes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.concat(F.lit("I"), (F.col("doc_id") % 10).cast("string")).alias("c"))
    return d.select("doc_id", R.canonical_scene(F.col("c"), F.col("lang"), "de").alias("scene"))


@register("privacy_quantize", "P11", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 0.5, 0) * 0.5 AS price, round_even(l_discount / 0.05, 0) * 0.05 AS discount FROM lineitem")
def privacy_quantize(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", quantize("l_extendedprice", 0.5).alias("price"), quantize("l_discount", 0.05).alias("discount"))
