"""Reading and writing capture batches: document trees, envelopes, flattened sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import BATCH_KEYS

SAMPLE = "struct<sensor_type:string,timestamp_elapsed_nanos:bigint,wall_time_estimated_millis:bigint,x:double,y:double,z:double,accuracy:int>"
TOUCH = "struct<event_id:string,event_type:string,event_time_uptime_millis:bigint,event_time_wall_millis:bigint,collected_at_wall_millis:bigint>"
NODE = (
    "struct<node_id:string,class_name:string,viewIdResourceName:string,bounds_grid:struct<left:bigint,top:bigint,right:bigint,bottom:bigint>,clickable:boolean,editable:boolean,scrollable:boolean,"
    "checkable:boolean,checked:boolean,enabled:boolean,focused:boolean,selected:boolean,visible_to_user:boolean,long_clickable:boolean,password:boolean,input_type_category:string,child_count:int,"
    "text:string,text_redacted:string,content_desc_redacted:string,actions_summary:array<string>,depth:int>"
)
EVENT = (
    "struct<event_id:string,event_type:string,event_time_wall_millis:bigint,app_package_name:string,foreground_activity_class_name:string,foreground_component_name:string,input_method_visible:boolean,"
    f"coarse_orientation:string,window_title_redacted:string,root_nodes:array<{NODE}>,redaction_summary:map<string,bigint>,event_detail:map<string,string>>"
)
FEATURE = (
    "struct<feature_id:string,event_id:string,computed_at_wall_millis:bigint,collection_source:string,task_sequence:bigint,task_id:string,task_name:string,task_intuitive_description:string,task_category:string,"
    "task_session_id:string,node_class_histogram:map<string,bigint>,event_type:string,coarse_orientation:string,estimated_context_category:string>"
)
BATCH = (
    "batch_id string, device_id string, session_id string, record_type string, collection_source string, app_package_name string, sampling_rate_hz bigint, batch_duration_seconds bigint, app_version string, rule_version string, rule_hash string, consent_version string, task_sequence bigint, task_id string, task_name string, "
    "task_intuitive_description string, task_category string, task_session_id string, task_started_at_wall_millis bigint, task_elapsed_seconds_at_batch_end bigint, started_at_wall_millis bigint, "
    f"ended_at_wall_millis bigint, base_elapsed_nanos bigint, sensor_samples array<{SAMPLE}>, touch_events array<{TOUCH}>, context_events array<{EVENT}>, context_features array<{FEATURE}>, skip_events array<string>, "
    "diagnostics struct<sensor_sample_count:bigint,context_event_count:bigint,touch_event_count:bigint,redaction_applied:boolean,compression:string,encryption:string,sampling_rate_hz:int>"
)


def _folder(spark: SparkSession, *parts: str) -> tuple:
    """(file system, path) in whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def device_ids(spark: SparkSession, root: str) -> list[str]:
    """The device folders below root/devices, sorted; none if there is no such folder."""
    fs, path = _folder(spark, root, "devices")
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []


def read_batches(spark: SparkSession, root: str, strict: bool = False, device_id: str | None = None) -> DataFrame:
    """One row per batch document of root/devices (of one device, if asked; of root itself where there is no such
    folder): the parsed columns and `raw`. Documents without a required key, or that are no JSON object, are left
    out; strict stops at the first. Sidecars and category views are skipped."""
    fs, path = _folder(spark, root, "devices")
    below = f"{root}/devices/{device_id}" if device_id else f"{root}/devices" if fs.exists(path) else root
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(below, wholetext=True)
    path = F.col("_metadata.file_path")
    docs = files.where(~path.contains("/by_category/") & ~path.endswith(".meta.json")).select(F.col("value").alias("raw"))
    return parsed(docs, strict)


def parsed(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Documents (`raw` and other columns) with the columns of a batch; those without a required key, or that are no JSON
    object, are left out, or stop a strict read."""
    keys = F.json_object_keys("raw")
    fine = F.coalesce((F.size(F.array_except(F.array(*[F.lit(k) for k in BATCH_KEYS]), keys)) == 0) & (F.get_json_object("raw", "$.record_type") == "collection"), F.lit(False))
    if strict:
        docs = docs.withColumn("raw", F.when(fine, F.col("raw")).otherwise(F.raise_error(F.lit("a batch lacks required keys"))))
    else:
        docs = docs.where(fine)
    return docs.select("*", F.from_json("raw", BATCH).alias("_b")).select(*docs.columns, "_b.*")


ENVELOPE = "algorithm string, payload_base64 string, payload_sha256_hex string, device_id string, batch_id string, rule_version string, rule_hash string, created_at_wall_millis bigint"


def envelopes_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """Envelopes from their JSON texts, one a row: their fields, and the text as `envelope_json`, by which ingest sees keys
    that an envelope must not have."""
    return texts.select(F.col(text).alias("envelope_json"), F.from_json(text, ENVELOPE).alias("_e")).select("envelope_json", "_e.*")


def read_envelopes(spark: SparkSession, root: str) -> DataFrame:
    return envelopes_of(spark.read.text(f"{root}/envelopes", wholetext=True))


def samples(batches: DataFrame) -> DataFrame:
    """The long sample table of batches, with batch order, clock base and a stable position."""
    order = Window.partitionBy("device_id").orderBy("started_at_wall_millis", "batch_id")
    b = batches.withColumn("batch_order", F.row_number().over(order) - 1)
    base = F.coalesce("base_elapsed_nanos", F.array_min(F.transform("sensor_samples", lambda s: s["timestamp_elapsed_nanos"])), F.lit(0))
    b = b.withColumn("base_elapsed_nanos", base)
    keep = ["device_id", "batch_id", "batch_order", "base_elapsed_nanos", "session_id", "app_package_name", "task_category", "task_name"]
    long = b.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("session_id", "app_package_name") else F.col(c) for c in keep], F.posexplode("sensor_samples").alias("pos", "s"))
    return long.select(*[F.col(c).alias("uploaded_session_id") if c == "session_id" else F.col(c) for c in keep], "pos", F.coalesce("s.sensor_type", F.lit("unknown")).alias("sensor_type"), "s.timestamp_elapsed_nanos", F.col("s.wall_time_estimated_millis").alias("wall"), "s.x", "s.y", "s.z", "s.accuracy")


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report: one part with a header. Reports are small; tables go to write_table."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines with sorted keys and the time they were written (UTC)."""
    stamped = df.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.select(*sorted(stamped.columns)).write.mode("append").json(path)


def write_by_category(batches: DataFrame, path: str, category: str = "task_category") -> None:
    """The category view: batch ids and devices in folders of their task's category."""
    batches.select("device_id", "batch_id", category).write.mode("overwrite").partitionBy(category).parquet(path)
