"""Run directories of JSON lines: strict and tolerant scans, guarded sinks.

A run has run.json and screens.jsonl, candidates.jsonl, errors.jsonl. Paths are Spark paths, so any store
that Spark reads will do.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORAGE_VERSIONS = ("1.0.0", "1.1.0", "1.2.0", "1.3.0", "1.4.0")
DOCUMENT_VERSIONS = ("stage0-v1", "r05-document-v1")
BOX = "struct<box_id:string,raw_text:string,confidence:double,bbox:string,original_index:int,screen_index:int>"
SEGMENT = "struct<segment_id:string,order:int,screen_index:int,normalized_text:string,comparison_text:string,box_ids:array<string>>"
SCREENS = (
    "run_id string, candidate_record_id string, screen_id string, screen_index int, attempt_index int, capture_type string, is_formal_screen boolean, captured_at string, record_type string,"
    f" storage_schema_version string, raw_boxes array<{BOX}>, raw_text string, exact_hash string, fingerprint_version string, normalized_text string, comparison_text string,"
    " normalization_status string, normalization_config_digest string, aggregation_status string, aggregation_config_digest string, similarity_score double, similarity_hash string, position_status string, legacy_match boolean,"
    f" segments array<{SEGMENT}>, matched array<int>, new array<int>, uncertain array<int>, warnings array<string>, overlap_char_count int, new_text_char_count int, uncertain_char_count int,"
    " overlap_segment_count int, new_segment_count int, certain_new_segment_count int, uncertain_segment_count int, duplicate_risk string, similarity_status string, comparison_class string,"
    " effective_new_status string, warning_codes array<string>, explicit_reference_id string, load_health boolean, ocr_health boolean, identity_health boolean, saved boolean"
)
EMBEDDED = "array<struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in re.split(r",\s(?![^<]*>)", SCREENS)) + ">>"
CANDIDATES = (
    "run_id string, candidate_record_id string, sequence_number int, created_at string, completed_at string, capture_status string, document_version string, storage_schema_version string, record_type string,"
    " document_text string, document_build_status string, screens " + EMBEDDED + ", versions map<string,string>, first_predicted_end_screen int, first_predicted_end_reason string"
)
ERRORS = "record_type string, storage_schema_version string, run_id string, occurred_at string, operation string, error_type string, context map<string,string>"
CONTEXT_KEYS = ("candidate_record_id", "screen_id", "screen_index", "operation", "attempt_index")


def lines(spark: SparkSession, path: str, schema: str, versions: tuple[str, ...] = STORAGE_VERSIONS, extra: tuple[str, tuple[str, ...]] | None = None, numbered: bool = True) -> DataFrame:
    """Lines of a JSON-lines file with columns of `schema`, path and line number, and issue: why a line cannot be used.

    malformed (not JSON, not an object, or of other types), missing_version, invalid_version_type,
    unsupported_version, in that order, with the version's field, what it says and what is supported; unknown
    members are ignored. Blank lines are no records. `numbered=False` saves counting the lines.
    """
    raw = spark.read.text(path).withColumn("path", F.col("_metadata.file_path")).withColumn("block", F.col("_metadata.file_block_start")).withColumn("at", F.monotonically_increasing_id())
    line = F.lit(None).cast("long")
    if numbered:  # a line's number: its place in its part of the file, after the lines of the parts before
        parts = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select("path", "block", (before - F.col("first") + 1).alias("shift"))
        raw, line = raw.join(parts, ["path", "block"]), F.col("at") + F.col("shift")
    raw = raw.withColumn("line", line).where(F.trim("value") != "")
    whole = T._parse_datatype_string(schema)
    as_read = T.StructType([*whole.fields, T.StructField("_bad", T.StringType())])
    p = F.from_json("value", as_read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    checks = (("storage_schema_version", versions), *([extra] if extra else []))
    s = raw.withColumn("r", p).withColumn("_v", F.try_parse_json("value"))
    issue = F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "malformed")
    for name, allowed in checks:
        member = F.try_variant_get("_v", f"$.{name}", "variant")
        issue = (
            issue.when(member.isNull() | F.is_variant_null(member), "missing_version").when(F.schema_of_variant(member) != "STRING", "invalid_version_type")
            .when(~F.col(f"r.{name}").isin(*allowed), "unsupported_version")
        )
    issue = issue.when(F.col("r._bad").isNotNull(), "malformed")
    field = actual = supported = F.lit(None)
    for name, allowed in reversed(checks):
        wrong = F.coalesce(~F.col(f"r.{name}").isin(*allowed), F.lit(True))
        field, actual, supported = F.when(wrong, F.lit(name)).otherwise(field), F.when(wrong, F.col(f"r.{name}")).otherwise(actual), F.when(wrong, F.array(*map(F.lit, allowed))).otherwise(supported)
    s = s.withColumn("issue", issue)
    by_version = F.col("issue").isin("missing_version", "invalid_version_type", "unsupported_version")
    told = [F.when(by_version, x).alias(n) for n, x in (("version_field", field), ("actual_version", F.when(F.col("issue") == "unsupported_version", actual)), ("supported_versions", supported))]
    return s.select("path", "line", "issue", *told, *[F.col(f"r.`{f.name}`").alias(f.name) for f in whole])


ISSUE = ("path", "line", "issue", "version_field", "actual_version", "supported_versions")


def usable(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The lines without an issue; strict fails the query at the first line with one (naming no content)."""
    if strict:
        rows = rows.withColumn("issue", F.when(F.col("issue").isNotNull(), F.raise_error(F.concat(F.lit("unusable line "), F.col("line"), F.lit(": "), F.col("issue"))).cast("string")))
    return rows.where("issue is null").drop(*ISSUE)


def issues(rows: DataFrame) -> DataFrame:
    """Why lines cannot be used, never what they hold."""
    return rows.where("issue is not null").select(*ISSUE)


def matching(rows: DataFrame, run_id: str | None = None, candidate_record_id: str | None = None, record_type: str | None = None) -> DataFrame:
    """Rows of a run, candidate and record type; a candidate named in the context counts as well."""
    for name, want in (("run_id", run_id), ("record_type", record_type)):
        if want is not None:
            rows = rows.where(F.col(name) == want)
    if candidate_record_id is not None:
        own = F.col("candidate_record_id") if "candidate_record_id" in rows.columns else F.lit(None).cast("string")
        rows = rows.where(F.coalesce(own, F.try_element_at("context", F.lit("candidate_record_id"))) == candidate_record_id if "context" in rows.columns else own == candidate_record_id)
    return rows


def screens(spark, run_dir: str, strict: bool = False, **want) -> DataFrame:
    return matching(usable(lines(spark, f"{run_dir}/screens.jsonl", SCREENS, numbered=strict), strict), **want)


def candidates(spark, run_dir: str, strict: bool = False, **want) -> DataFrame:
    return matching(usable(lines(spark, f"{run_dir}/candidates.jsonl", CANDIDATES, extra=("document_version", DOCUMENT_VERSIONS), numbered=strict), strict), **want)


def errors(spark, run_dir: str, strict: bool = False, **want) -> DataFrame:
    return matching(usable(lines(spark, f"{run_dir}/errors.jsonl", ERRORS, numbered=strict), strict), **want)


def manifest(spark, run_dir: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{run_dir}/run.json")


def load_run(spark, run_dir: str, strict: bool = False) -> dict[str, DataFrame]:
    """All of a run as lazy frames: manifest, screens, candidates, errors, issues."""
    parts = {
        "screens": lines(spark, f"{run_dir}/screens.jsonl", SCREENS),
        "candidates": lines(spark, f"{run_dir}/candidates.jsonl", CANDIDATES, extra=("document_version", DOCUMENT_VERSIONS)),
        "errors": lines(spark, f"{run_dir}/errors.jsonl", ERRORS),
    }
    found = None
    for name, rows in parts.items():
        i = issues(rows).withColumn("object_type", F.lit(name))
        found = i if found is None else found.union(i)
    return {"manifest": manifest(spark, run_dir), "issues": found} | {k: usable(v, strict) for k, v in parts.items()}


# --- sinks ---------------------------------------------------------------------------------------------------------


def record_json(*columns) -> Column:
    """Compact JSON of columns, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def record_digest(*columns) -> Column:
    return F.sha2(record_json(*columns), 256)


def identity_mismatches(rows: DataFrame, run: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with mismatch: the columns in which they differ (null-safe) from their run's manifest (one row per run)."""
    m = run.select("run_id", *[F.col(c).alias(f"_m_{c}") for c in columns])
    j = rows.join(m, "run_id", "left")
    return j.withColumn("mismatch", F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_m_{c}")), F.lit(c)) for c in columns]))).drop(*[f"_m_{c}" for c in columns])


def append(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines, nulls kept."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def create(rows: DataFrame, path: str) -> None:
    """Write rows as JSON lines at a path that must not exist."""
    rows.write.mode("error").option("ignoreNullFields", "false").json(path)


def accepted_candidates(candidate_screens: DataFrame, saved_screens: DataFrame) -> DataFrame:
    """candidate_screens (run_id, candidate_record_id, screen_id, digest) by candidate, with whole: each embedded screen was saved with the same digest."""
    saved = saved_screens.select("run_id", "candidate_record_id", "screen_id", F.col("digest").alias("_d")).distinct()
    j = candidate_screens.join(saved, ["run_id", "candidate_record_id", "screen_id"], "left")
    return j.groupBy("run_id", "candidate_record_id").agg(F.bool_and(F.coalesce(F.col("digest") == F.col("_d"), F.lit(False))).alias("whole"))


def safe_context(context: Column) -> Column:
    return F.map_filter(context, lambda k, v: k.isin(*CONTEXT_KEYS))


def save_screens(rows: DataFrame, run: DataFrame, path: str, identity: tuple[str, ...]) -> DataFrame:
    """Append the screens whose identity columns are those of their run's manifest, with the digest of each record; returns those that are refused, with mismatch."""
    checked = identity_mismatches(rows, run, identity)
    good = checked.where(F.size("mismatch") == 0).drop("mismatch")
    append(good.withColumn("record_digest", record_digest(*sorted(good.columns))), path)
    return checked.where(F.size("mismatch") > 0)


def error_rows(failures: DataFrame, version: str = STORAGE_VERSIONS[-1]) -> DataFrame:
    """failures (run_id, occurred_at, operation, error_type, context map) as error records: context keys by whitelist, names by grammar, nothing of the text."""
    name = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z_][A-Za-z0-9_.]{0,127}$"), F.col(c)).otherwise("unexpected_error")
    return failures.select(F.lit("error").alias("record_type"), F.lit(version).alias("storage_schema_version"), "run_id", "occurred_at", name("operation").alias("operation"), name("error_type").alias("error_type"), safe_context(F.col("context")).alias("context"))


SCREENING_LOGS = ("ai_results", "ai_errors", "decisions")


def screening_logs(run_dir: str, logs: dict[str, DataFrame]) -> None:
    """Create the three logs of a screening run; none of them may exist before any is written."""
    if set(logs) != set(SCREENING_LOGS):
        raise ValueError(f"logs are {SCREENING_LOGS}")
    for name in SCREENING_LOGS:
        rows = logs[name]
        p = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{run_dir}/{name}.jsonl")
        if p.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(p):
            raise FileExistsError(name)
    for name in SCREENING_LOGS:
        create(logs[name], f"{run_dir}/{name}.jsonl")


def sidecar(rows: DataFrame, run_dir: str, digest: str, header: dict | None = None) -> None:
    """Write formal screens' similarity beside a run, ordered, after a header line, at a path of the configuration's digest; it must not exist.

    Each row carries the digest of the screen it was made from (see record_digest).
    """
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("not a digest")
    spark = rows.sparkSession
    formal = rows.where("is_formal").withColumn("source_screen_digest", record_digest(*sorted(rows.columns))).select(F.struct(F.lit("r06_sidecar_screen").alias("record_type"), "*").alias("row"), F.struct("sequence_number", "candidate_record_id", "screen_index", "screen_id").alias("place"))
    lines_ = formal.orderBy("place").select(F.to_json("row", {"ignoreNullFields": "false"}).alias("value"))
    head = {"record_type": "r06_sidecar_manifest", "similarity_config_digest": digest} | (header or {})
    first = spark.createDataFrame([(json.dumps(head, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1)
    first.union(lines_).write.mode("error").text(f"{run_dir}/r06-sidecar-{digest}.jsonl")


def owned_digests(screens_: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """(run_id, candidate_record_id, screen_id, digest): digests belong to their candidate and are released with it when it is finished."""
    own = screens_.select("run_id", "candidate_record_id", "screen_id", record_digest(*sorted(screens_.columns)).alias("digest"))
    return own if finished is None else own.join(finished.select("run_id", "candidate_record_id").distinct(), ["run_id", "candidate_record_id"], "left_anti")


def sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the JSON-lines files of a folder, one file at a time in the order of their times: a recorded sequence as a scan."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(path)


def write_manifest(run: DataFrame, path: str) -> None:
    """Replace a run's one-row manifest."""
    run.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def finished(run: DataFrame, screens_: DataFrame, candidates_: DataFrame, errors_: DataFrame, status: str, ended_at: str) -> DataFrame:
    """The manifest of a run that ends: status, time and record counts."""
    for name, rows in (("screen", screens_), ("candidate", candidates_), ("error", errors_)):
        n = rows.groupBy("run_id").agg(F.count("*").alias("_n"))
        column = "error_count" if name == "error" else f"{name}_record_count"
        run = run.drop(column).join(n, "run_id", "left").withColumn(column, F.coalesce("_n", F.lit(0))).drop("_n")
    return run.withColumn("status", F.lit(status)).withColumn("ended_at", F.lit(ended_at))


def batch_sink(path: str):
    """For foreachBatch: a batch replaces its own folder, so that a batch that is tried again is written once."""
    return lambda df, batch: df.write.mode("overwrite").json(f"{path}/batch={batch}")


def two_phase_sink(path: str):
    """For foreachBatch: a batch is first written aside and then moved to its place by one rename; a batch that is in place is not written again."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        aside, place = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_pending-{batch}", f"batch={batch}"))
        fs = place.getFileSystem(conf)
        if fs.exists(place):
            return
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/_pending-{batch}")
        fs.rename(aside, place)

    return write


class Breaker:
    """Gives up after three failures in a row."""

    def __init__(self, limit: int = 3):
        self.limit, self.failures, self.open = limit, 0, False

    def run(self, write, *args) -> bool:
        if self.open:
            return False
        try:
            write(*args)
        except Exception:  # the sink's own errors of any kind count
            self.failures += 1
            self.open = self.failures >= self.limit
            return False
        self.failures = 0
        return True


def profiles(spark, root: str) -> DataFrame:
    """(screening_profile_id, profile_version, criteria, criteria_digest, created_at) of sp_*/versions/*.json."""
    schema = "screening_profile_id string, profile_version int, criteria array<struct<criterion_id:string,criterion_text:string,rule:string>>, criteria_digest string, created_at string"
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/sp_*/versions/*.json")


def profile(versions: DataFrame, profile_id: str, version: int | None = None) -> DataFrame:
    """One version of a profile, the latest if none is named."""
    mine = versions.where(F.col("screening_profile_id") == profile_id)
    return mine.where(F.col("profile_version") == version) if version is not None else mine.orderBy(F.desc("profile_version")).limit(1)
