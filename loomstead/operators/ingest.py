"""Validation of envelopes and capture batches as columns: the first failing reason, duplicates, redaction."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract.
ALGORITHM = "LZ4_FRAME+JSON"
ENVELOPE_KEYS = ["algorithm", "batch_id", "created_at_wall_millis", "device_id", "payload_base64", "payload_sha256_hex", "rule_hash", "rule_version"]
BATCH_KEYS = [
    "app_package_name", "base_elapsed_nanos", "batch_id", "collection_source", "context_events", "context_features", "device_id", "diagnostics",
    "ended_at_wall_millis", "record_type", "sampling_rate_hz", "sensor_samples", "session_id", "started_at_wall_millis",
]
TEXT_EVENTS = ["TYPE_VIEW_TEXT_CHANGED", "TYPE_VIEW_TEXT_SELECTION_CHANGED", "TYPE_VIEW_TEXT_TRAVERSED_AT_MOVEMENT_GRANULARITY"]
FORBIDDEN_DETAIL = ["before_text_length", "text_total_length", "content_description_length", "text_entry_count", "added_count", "removed_count"]
INDEX_DETAIL = ["from_index", "to_index", "item_count", "current_item_index"]
FORBIDDEN_NODE_KEYS = ["contentDescription", "content_description", "hintText", "hint_text", "error", "paneTitle", "containerTitle"]
CATEGORIES = ["I0", "I1", "I2", "I3", "I4", "I5", "I6", "I7", "C0", "C1", "C2", "C3", "C4", "C5", "C6"]
SOURCES = ["BUILTIN_TASK", "THIRD_PARTY_APP"]
SENSORS = ["ACCELEROMETER", "GYROSCOPE", "MAGNETIC_FIELD"]
TOUCHES = ["TOUCH_INTERACTION_START", "TOUCH_INTERACTION_END", "TOUCH_DOWN", "TOUCH_UP", "TOUCH_POINTER_DOWN", "TOUCH_POINTER_UP", "TOUCH_CANCEL"]
ORIENTATIONS = ["portrait", "landscape", "portrait_reverse", "landscape_reverse", "unknown"]
TASK_FIELDS = ["task_sequence", "task_id", "task_name", "task_intuitive_description", "task_category", "task_session_id", "task_started_at_wall_millis", "task_elapsed_seconds_at_batch_end"]
ECHOED = ["collection_source", "task_category", "task_id", "task_sequence", "task_name", "task_intuitive_description", "task_session_id"]
TEXTS_REQUIRED = ["session_id", "app_package_name", "app_version", "rule_version", "rule_hash", "consent_version"]
HEX64 = "^[a-f0-9]{64}$"
UUID = "^(urn:uuid:)?\\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\\}?$"
BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"

REASONS = [
    "invalid_envelope", "invalid_base64", "payload_hash_mismatch", "corrupted_lz4_payload", "invalid_json", "schema_validation_failed",
    "envelope_batch_device_id_mismatch", "envelope_batch_id_mismatch", "duplicate_batch_id_conflict", "disk_space_below_threshold", "storage_write_failed",
]


def canonical_uuid(c: Column) -> Column:
    """Lower-case hyphenated form of a UUID in any of its spellings; null if it is none."""
    bare = F.lower(F.regexp_replace(c, "^urn:uuid:|[{}-]", ""))
    return F.when(c.rlike(UUID), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def envelope_ok(extra_keys: Column | None = None) -> Column:
    c = F.col
    fine = (
        (c("algorithm") == ALGORITHM) & (F.length("payload_base64") > 0) & c("device_id").rlike(HEX64) & c("payload_sha256_hex").rlike(HEX64) & c("rule_hash").rlike(HEX64)
        & canonical_uuid(c("batch_id")).isNotNull() & (c("created_at_wall_millis") >= 0) & c("rule_version").isNotNull()
    )
    if extra_keys is not None:
        fine = fine & (F.size(F.array_except(extra_keys, F.array(*[F.lit(k) for k in ENVELOPE_KEYS]))) == 0)
    return F.coalesce(fine, F.lit(False))


def _unpack(column: pa.Array) -> pa.Array:
    out = []
    for x in column:
        data = x.as_py()
        try:
            out.append(None if data is None else pa.input_stream(pa.py_buffer(data), compression="lz4").read())
        except (OSError, pa.ArrowInvalid):
            out.append(None)
    return pa.array(out, pa.binary())


def lz4_decode(packed: Column | str) -> Column:
    """Plain bytes of LZ4 frames; null where a frame is broken."""
    return F.arrow_udf(_unpack, "binary")(packed)


def _pack(column: pa.Array) -> pa.Array:
    out = []
    for x in column.to_pylist():
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as f:
            f.write(x or b"")
        out.append(None if x is None else sink.getvalue().to_pybytes())
    return pa.array(out, pa.binary())


def lz4_encode(plain: Column | str) -> Column:
    """LZ4 frames of plain bytes."""
    return F.arrow_udf(_pack, "binary")(plain)


def enveloped(batches: DataFrame, plain: str = "plain") -> DataFrame:
    """Adds the payload columns of an envelope around the document in `plain`."""
    packed = batches.withColumn("_packed", lz4_encode(F.encode(plain, "UTF-8")))
    return packed.withColumns({"payload_base64": F.regexp_replace(F.base64("_packed"), "[\\r\\n]", ""), "payload_sha256_hex": F.sha2("_packed", 256), "algorithm": F.lit(ALGORITHM)}).drop("_packed")


def decoded(envelopes: DataFrame) -> DataFrame:
    """Adds packed (compressed bytes), plain (text) and reason (of the envelope's own stages, null if fine). Where the
    envelope's text is there (`envelope_json`), keys beyond the contract's make it invalid."""
    keys = F.coalesce(F.json_object_keys("envelope_json"), F.array(F.lit(""))) if "envelope_json" in envelopes.columns else None
    strict = F.when(F.col("payload_base64").rlike(BASE64), F.try_to_binary("payload_base64", F.lit("base64")))
    out = envelopes.withColumn("packed", strict).withColumn("plain", F.decode(lz4_decode("packed"), "UTF-8"))
    reason = (
        F.when(~envelope_ok(keys), "invalid_envelope").when(F.col("packed").isNull(), "invalid_base64").when(F.sha2("packed", 256) != F.col("payload_sha256_hex"), "payload_hash_mismatch")
        .when(F.col("plain").isNull(), "corrupted_lz4_payload").when(F.json_object_keys("plain").isNull(), "invalid_json")
    )
    return out.withColumn("reason", reason)


def _all(conditions) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: Keys of every node and the detail of every event of a raw batch document, whatever else the schema reads.
KEYS_SCHEMA = "struct<context_events:array<struct<event_type:string,event_detail:map<string,string>,root_nodes:array<map<string,string>>>>>"


def privacy_ok(b: str, raw: Column | str) -> Column:
    """No window title, no password node, no node text, no forbidden node key (null or not), no text telemetry."""
    keys = F.from_json(raw, KEYS_SCHEMA)["context_events"]
    some = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    no_text = lambda n: F.length(F.concat_ws("", n["text"], n["text_redacted"], n["content_desc_redacted"])) == 0
    nodes = "array<map<string,string>>"
    index_set = lambda d: reduce(lambda x, y: x | y, [F.coalesce(F.try_element_at(d, F.lit(k)), F.lit("-1")) != "-1" for k in INDEX_DETAIL])
    bad_key = F.exists(some(keys, "array<" + KEYS_SCHEMA.split("array<", 1)[1].rsplit(">>", 1)[0] + ">"), lambda e: (
        F.exists(some(e["root_nodes"], nodes), lambda n: F.coalesce(F.arrays_overlap(F.map_keys(n), _names(FORBIDDEN_NODE_KEYS)), F.lit(False)))
        | F.coalesce(F.arrays_overlap(F.map_keys(e["event_detail"]), _names(FORBIDDEN_DETAIL)), F.lit(False))
        | (F.coalesce(e["event_type"].isin(TEXT_EVENTS), F.lit(False)) & F.coalesce(index_set(e["event_detail"]), F.lit(False)))
    ))
    quiet = F.forall(F.col(f"{b}.context_events"), lambda e: (F.coalesce(F.length(e["window_title_redacted"]), F.lit(0)) == 0) & F.coalesce(F.forall(e["root_nodes"], lambda n: ~F.coalesce(n["password"], F.lit(False)) & no_text(n)), F.lit(True)))
    return ~bad_key & F.coalesce(quiet, F.lit(True))


def ranges_ok(b: str) -> Column:
    """Samples, touches, events and features: names that are known, times that are not negative."""
    c = lambda f: F.col(f"{b}.{f}")
    each = lambda f, test: F.coalesce(F.forall(c(f), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))
    since = lambda x, *fields: _all([x[f] >= 0 for f in fields])
    placed = lambda o: o.isNull() | o.isin(ORIENTATIONS)
    return (
        each("sensor_samples", lambda s: s["sensor_type"].isin(SENSORS) & since(s, "timestamp_elapsed_nanos", "wall_time_estimated_millis") & s["x"].isNotNull() & s["y"].isNotNull() & s["z"].isNotNull())
        & each("touch_events", lambda t: t["event_type"].isin(TOUCHES) & t["event_id"].isNotNull() & since(t, "event_time_uptime_millis", "event_time_wall_millis", "collected_at_wall_millis"))
        & each("context_events", lambda e: e["event_id"].isNotNull() & e["event_type"].isNotNull() & since(e, "event_time_wall_millis") & placed(e["coarse_orientation"]))
        & each("context_features", lambda f: f["feature_id"].isNotNull() & f["event_id"].isNotNull() & since(f, "computed_at_wall_millis") & f["collection_source"].isin(SOURCES) & (f["task_category"].isNull() | f["task_category"].isin(CATEGORIES)) & placed(f["coarse_orientation"]))
    )


def task_ok(b: str) -> Column:
    """A task of our own names itself fully and consistently; a batch of another app names none."""
    c = lambda f: F.col(f"{b}.{f}")
    builtin = (c("collection_source") == "BUILTIN_TASK") & _all([c(t).isNotNull() for t in TASK_FIELDS]) & c("task_category").isin(CATEGORIES) & (c("task_id") == c("task_category")) & c("task_sequence").eqNullSafe(F.expr(f"try_cast(substring({b}.task_id, 2) AS BIGINT)"))
    return builtin | ((c("collection_source") == "THIRD_PARTY_APP") & _all([c(t).isNull() for t in TASK_FIELDS]))


def counts_ok(b: str) -> Column:
    """Diagnostics: the fixed values, the counts of what the batch holds, the sampling rate where it is given."""
    c = lambda f: F.col(f"{b}.{f}")
    size = lambda f: F.coalesce(F.array_size(c(f)), F.lit(0))
    count = lambda d, f: F.coalesce(c(f"diagnostics.{d}"), F.lit(0)) == size(f)
    rate = c("diagnostics.sampling_rate_hz").isNull() | (c("diagnostics.sampling_rate_hz") == c("sampling_rate_hz"))
    fixed = c("diagnostics.redaction_applied") & (c("diagnostics.compression") == "lz4_frame") & (c("diagnostics.encryption") == "none")
    return fixed & rate & count("sensor_sample_count", "sensor_samples") & count("context_event_count", "context_events") & count("touch_event_count", "touch_events")


def batch_ok(b: str = "batch", raw: Column | str = "plain") -> Column:
    """The batch contract over a parsed struct and its document: ids, times, task fields, echoed fields of features,
    references to events, counts, known names, privacy. A null anywhere that matters fails."""
    c = lambda f: F.col(f"{b}.{f}")
    features, events = c("context_features"), c("context_events")
    echo = F.coalesce(F.forall(features, lambda f: _all([f[x].eqNullSafe(c(x)) for x in ECHOED])), F.lit(True))
    known = F.coalesce(F.size(F.array_except(F.transform(features, lambda f: f["event_id"]), F.transform(events, lambda e: e["event_id"]))) == 0, F.coalesce(F.size(features) < 1, F.lit(True)))
    ids = c("device_id").rlike(HEX64) & canonical_uuid(c("batch_id")).isNotNull() & (c("record_type") == "collection") & _all([c(t).isNotNull() for t in TEXTS_REQUIRED]) & (F.length(c("session_id")) > 0)
    times = (c("started_at_wall_millis") >= 0) & (c("started_at_wall_millis") <= c("ended_at_wall_millis")) & (c("base_elapsed_nanos") >= 0) & (c("sampling_rate_hz") > 0) & (c("batch_duration_seconds") >= 0)
    return F.coalesce(ids & times & task_ok(b) & echo & known & counts_ok(b) & ranges_ok(b) & privacy_ok(b, raw), F.lit(False))


def _canonical(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in column.to_pylist()], pa.string())


def canonical_text(document: Column | str) -> Column:
    """A JSON document with sorted keys at every depth and no spaces: equal for documents that say the same."""
    return F.arrow_udf(_canonical, "string")(document)


def rated(envelopes: DataFrame, batch_schema: str, checks: Column | None = None) -> DataFrame:
    """Envelopes with packed, plain, batch, day (UTC, of the batch's start), content (hash of the canonical text) and
    the first failing reason, null for what may be stored. `checks` stands for batch_ok where it is given."""
    out = decoded(envelopes).withColumn("batch", F.from_json("plain", batch_schema))
    reason = F.coalesce(
        "reason", F.when(~F.coalesce(batch_ok() if checks is None else checks, F.lit(False)), "schema_validation_failed").when(F.col("batch.device_id") != F.col("device_id"), "envelope_batch_device_id_mismatch")
        .when(canonical_uuid(F.col("batch.batch_id")) != canonical_uuid(F.col("batch_id")), "envelope_batch_id_mismatch"),
    )
    out = out.withColumn("reason", reason).withColumn("day", F.date_format(F.timestamp_millis("batch.started_at_wall_millis"), "yyyy-MM-dd"))
    return out.withColumn("content", F.when(F.col("reason").isNull(), F.sha2(canonical_text("plain"), 256)))


def status_of(reason: Column | str) -> Column:
    """The answer to an envelope: 200 stored or sent again, 409 conflict, 507 storage, 400 all else."""
    c = F.col(reason) if isinstance(reason, str) else reason
    return F.when(c.isNull(), 200).when(c == "duplicate_batch_id_conflict", 409).when(c.isin("disk_space_below_threshold", "storage_write_failed"), 507).otherwise(400)


def duplicates(df: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Adds outcome: stored for a key's first arrival, duplicate if the content is the same, conflict if it is not."""
    first = F.first(content).over(Window.partitionBy(*keys).orderBy(*order))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("outcome", F.when(n == 1, "stored").when(F.col(content) == first, "duplicate").otherwise("conflict"))


#: Redaction rules: (id, pattern, replacement); patterns that Java and RE2 read alike (fixed values).
REDACTIONS = [
    ("email", "(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}", "<EMAIL>"),
    ("url", "https?://[^ \\t\\n]+", "<URL>"),
    ("opaque_token", "\\b[A-Fa-f0-9]{32,}\\b", "<TOKEN>"),
    ("long_number", "\\b[0-9]{12,19}\\b", "<NUM>"),
]


def redact(text: Column, rules: list[tuple[str, str, str]] = REDACTIONS) -> Column:
    for _, pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def sanitized_detail(detail: Column, is_text: Column) -> Column:
    """An event's detail map without the forbidden keys, and on text events without index keys."""
    kept = F.map_filter(detail, lambda k, v: ~k.isin(FORBIDDEN_DETAIL))
    return F.when(is_text, F.map_filter(kept, lambda k, v: ~k.isin(INDEX_DETAIL))).otherwise(kept)


def sanitized_batch(raw: Column | str, batch: str = "batch") -> Column:
    """The context events of a parsed batch with sanitized detail maps, other fields as they are."""
    return F.transform(F.col(f"{batch}.context_events"), lambda e: e.withField("event_detail", sanitized_detail(e["event_detail"], e["event_type"].isin(TEXT_EVENTS))))


def drop_columns(df: DataFrame, names: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """Without the columns of these names and of names that begin so."""
    return df.drop(*[c for c in df.columns if c in names or any(c.startswith(p) for p in prefixes)])


def client_hash(address: Column | str, salt: str) -> Column:
    """What logs keep of a client's address: 16 hex digits of a salted hash."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), address), 256), 1, 16)


def rule_problems(rules: DataFrame) -> DataFrame:
    """(id, problem) of redaction rules (id, target, action, pattern) that break the contract: names out of range, REDACT
    or DROP without a pattern, a pattern that does not compile."""
    known = F.col("target").isin("text", "content_description", "node") & F.col("action").isin("REDACT", "DROP", "ALLOW")
    needs = F.col("action").isin("REDACT", "DROP") & (F.coalesce(F.length("pattern"), F.lit(0)) == 0)
    problem = F.when(~F.coalesce(known, F.lit(False)), "unknown_target_or_action").when(needs, "pattern_required").when(~F.coalesce(F.arrow_udf(_compiles, "boolean")("pattern"), F.lit(True)), "pattern_does_not_compile")
    return rules.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def _compiles(column: pa.Array) -> pa.Array:
    def fine(p: str | None) -> bool:
        try:
            re.compile(p or "")
            return True
        except re.error:
            return False

    return pa.array([fine(p) for p in column.to_pylist()])


def rules_hash(document: Column | str) -> Column:
    """The hash of a rule document: of its canonical text, so that spelling does not matter."""
    return F.sha2(canonical_text(document), 256)


def quarantine_record(df: DataFrame, raw: str) -> DataFrame:
    """What quarantine may keep of a payload: the hash of its canonical text and at most fifty sorted top-level keys."""
    return df.withColumn("payload_sha256", F.sha2(F.coalesce(canonical_text(raw), F.col(raw)), 256)).withColumn("top_keys", F.slice(F.array_sort(F.json_object_keys(raw)), 1, 50)).drop(raw)


