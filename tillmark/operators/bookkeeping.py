"""Import files, attempts and jobs: content duplicates, attempt versions, statuses and counters.

Any number of files may share one content, so nothing below sorts or collects the copies of a hash:
copies are reduced by partial aggregates and the result is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.fixed import DEFAULT_PROFILE, ReportProfile
from tillmark.functions.marks import published_file_status
from tillmark.operators.joins import lookup_join

OPEN_STATUSES = ("PENDING", "PROCESSING")


def mark_duplicates(files: DataFrame, key: str = "sha256") -> DataFrame:
    """WN1: the first file of a content owns the artifact, later ones are marked as duplicates of it."""
    owners = files.groupBy(key).agg(F.min(F.struct("created_at", "file_id")).alias("first"))
    owners = owners.select(key, F.col("first.file_id").alias("owner_file_id"))
    return lookup_join(files, owners, [key]).withColumn("deduplicated", F.col("file_id") != F.col("owner_file_id"))


def original_files(files: DataFrame) -> DataFrame:
    """WN3: earliest file of each artifact that is not itself a duplicate; artifacts without one are absent."""
    return files.filter(~F.col("deduplicated")).groupBy("raw_artifact_id").agg(
        F.min(F.struct("created_at", "id")).alias("first")
    ).select("raw_artifact_id", F.col("first.id").alias("original_file_id"))


def with_duplicate_of(files: DataFrame) -> DataFrame:
    """WN3: duplicates point to the original file, or to nothing when there is none."""
    return lookup_join(files, original_files(files), ["raw_artifact_id"], "left").withColumn(
        "duplicate_of_import_file_id", F.when(F.col("deduplicated"), F.col("original_file_id"))
    ).drop("original_file_id")


def latest_attempts(attempts: DataFrame, profile: ReportProfile = DEFAULT_PROFILE) -> DataFrame:
    """WN2: newest attempt per artifact among those of the current reader version."""
    ours = attempts.filter(
        (F.col("parser_name") == profile.parser_name) & (F.col("parser_version") == profile.parser_version)
    )
    columns = ["attempt_count", "id", "status", *(["records_found"] if "records_found" in attempts.columns else [])]
    newest = ours.groupBy("raw_artifact_id").agg(F.max(F.struct(*columns)).alias("a"))
    return newest.select(
        "raw_artifact_id",
        F.col("a.id").alias("latest_attempt_id"),
        F.col("a.status").alias("latest_status"),
        F.col("a.attempt_count").alias("latest_count"),
        *([F.col("a.records_found").alias("latest_records")] if len(columns) == 4 else []),
    )


def next_attempt_number(latest_count: Column) -> Column:
    """WN4."""
    return (F.coalesce(latest_count, F.lit(0)) + 1).cast("int")


def needs_parse(latest_status: Column) -> Column:
    """VR8: content never parsed, or only with a failure."""
    return latest_status.isNull() | (latest_status == "FAILED")


def arriving_file_status(latest_status: Column, published: Column) -> Column:
    """VR8: status of a file whose content has been seen; a new attempt starts as PROCESSING."""
    return (
        F.when(needs_parse(latest_status) | latest_status.isin(*OPEN_STATUSES), "PROCESSING")
        .when(latest_status == "INVALID", "INVALID")
        .otherwise(published_file_status(published, latest_status))
    )


def sync_linked(files: DataFrame) -> DataFrame:
    """JN13: files that wait for an attempt take over the result of a settled file of that attempt."""
    settled = (
        files.filter(F.col("parse_attempt_id").isNotNull() & ~F.col("status").isin(*OPEN_STATUSES))
        .groupBy("parse_attempt_id")
        .agg(F.min(F.struct("created_at", "id", "status", "completed_at")).alias("s"))
        .select(
            "parse_attempt_id",
            F.col("s.status").alias("_status"),
            F.col("s.completed_at").alias("_completed_at"),
        )
    )
    waiting = (F.col("status") == "PROCESSING") & F.col("_status").isNotNull()
    return lookup_join(files, settled, ["parse_attempt_id"], "left").withColumns(
        {
            "status": F.when(waiting, F.col("_status")).otherwise(F.col("status")),
            "completed_at": F.when(waiting, F.col("_completed_at")).otherwise(F.col("completed_at")),
        }
    ).drop("_status", "_completed_at")


def job_status(files: Column, waiting: Column, imported: Column, failed: Column) -> Column:
    """AG7: null while a file is still open. A file with a warning counts as imported."""
    return (
        F.when(waiting > 0, F.lit(None).cast("string"))
        .when((files == 0) | ((failed > 0) & (imported == 0)), "FAILED")
        .when(failed > 0, "PARTIAL_SUCCESS")
        .otherwise("SUCCEEDED")
    )


def job_rollup(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """AG7: jobs (id, ...) with file counts and ``rolled_status``; jobs without files are kept."""
    counted = files.groupBy(F.col("import_job_id").alias("id")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status").isin(*OPEN_STATUSES)).alias("waiting"),
        F.count_if(F.col("status").isin("IMPORTED", "WARNING")).alias("imported"),
        F.count_if(F.col("status").isin("INVALID", "FAILED")).alias("failed"),
    )
    names = ["files", "waiting", "imported", "failed"]
    filled = jobs.join(counted, "id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    return filled.withColumn("rolled_status", job_status(*[F.col(n) for n in names]))


def file_counters() -> list[Column]:
    """AG10 over import files, open ones not counted: usable in ``agg`` and in ``observe``."""
    settled = ~F.col("status").isin(*OPEN_STATUSES)
    took_ms = F.unix_millis("completed_at") - F.unix_millis("created_at")
    return [
        F.count_if(F.col("deduplicated") & settled).alias("duplicates"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"),
        F.count_if(F.col("status").isin("INVALID", "FAILED")).alias("failures"),
        F.coalesce(F.sum(F.when(settled & (took_ms > 0), took_ms)), F.lit(0)).alias("duration_ms"),
    ]


#: AG10: names of the counters, and the columns that hold them.
COUNTERS = {
    "imports.completed": "completed", "imports.duplicates": "duplicates", "imports.warnings": "warnings",
    "imports.failures": "failures", "imports.duration.ms": "duration_ms", "raw.storage.bytes": "raw_storage_bytes",
}


def counter_row(jobs: DataFrame, files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """AG10: one row with a column per counter, from one pass over each table."""
    done = jobs.agg(F.count_if(F.col("status").isin("SUCCEEDED", "PARTIAL_SUCCESS", "FAILED")).alias("completed"))
    stored = artifacts.agg(
        F.coalesce(F.sum(F.when(F.col("byte_size") > 0, F.col("byte_size"))), F.lit(0)).alias("raw_storage_bytes")
    )
    return done.crossJoin(files.agg(*file_counters())).crossJoin(stored).select(*(F.col(c).cast("long") for c in COUNTERS.values()))


def counters_by_name(rows: DataFrame) -> DataFrame:
    """AG10: rows of counters, added up, as (name, value)."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS.values()])
    named = [F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for name, c in COUNTERS.items()]
    return sums.select(F.explode(F.array(*named)).alias("counter")).select("counter.*")


def import_counters(jobs: DataFrame, files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """AG10: one row (name, value) per counter of whole tables."""
    return counters_by_name(counter_row(jobs, files, artifacts))
