"""Import history: jobs with their files, and the detail of one file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.functions.hints import read_hints
from tillmark.functions.numbers import plain_text
from tillmark.operators.joins import lookup_join
from tillmark.operators.paging import Page, take_page

QUANTITY_CODES = ("SOURCE_QUANTITY_MATCH", "SOURCE_QUANTITY_MISMATCH")


@dataclass(frozen=True)
class FileDetail:
    file: DataFrame
    validations: DataFrame


def product_samples(movements: DataFrame) -> DataFrame:
    """WN10: product of the first movement that names one, per attempt."""
    named = movements.filter(F.col("product_name").isNotNull())
    return named.groupBy("parse_attempt_id").agg(
        F.min(F.struct("source_record_index", "product_name", "external_product_id")).alias("s")
    ).select(
        "parse_attempt_id",
        F.col("s.product_name").alias("product_name"),
        F.col("s.external_product_id").alias("product_external_id"),
    )


def attempt_revenue(movements: DataFrame) -> DataFrame:
    """AG9: OUT revenue per attempt, published or not; 0 for an attempt without such rows."""
    out = F.when(F.col("direction") == "OUT", F.col("total"))
    return movements.groupBy("parse_attempt_id").agg(
        F.coalesce(F.sum(out), F.lit(0)).cast("decimal(38,2)").alias("parsed_revenue")
    )


def quantity_checks(validations: DataFrame) -> DataFrame:
    """WN11: the declared-quantity check per attempt, first by code."""
    return validations.filter(F.col("code").isin(*QUANTITY_CODES)).groupBy("parse_attempt_id").agg(
        F.min(F.struct("code", "source_value", "calculated_value", "status")).alias("q")
    ).select(
        "parse_attempt_id",
        F.col("q.source_value").alias("source_quantity"),
        F.col("q.calculated_value").alias("parsed_quantity"),
        F.col("q.status").alias("quantity_validation_status"),
    )


def file_summaries(files: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """JN12: files with attempt, product sample, quantity check and revenue.

    Movements and validations are cut to the attempts in question and reduced to one row per attempt
    before they are joined; several files may share an attempt.
    """
    attempts = files.select("parse_attempt_id").filter(F.col("parse_attempt_id").isNotNull()).distinct()
    movements = lookup_join(tables["parsed_movement"], attempts, ["parse_attempt_id"], "left_semi")
    checks = lookup_join(tables["validation_result"], attempts, ["parse_attempt_id"], "left_semi")
    about = (
        lookup_join(
            tables["parse_attempt"].select(
                F.col("id").alias("parse_attempt_id"), "records_found", F.col("status").alias("parse_status"),
                "parser_name", "parser_version",
            ),
            attempts, ["parse_attempt_id"], "left_semi",
        )
        .join(product_samples(movements), "parse_attempt_id", "left")
        .join(quantity_checks(checks), "parse_attempt_id", "left")
        .join(attempt_revenue(movements), "parse_attempt_id", "left")
    )
    revenue = F.when(F.col("parse_status").isNotNull(), F.coalesce(F.col("parsed_revenue"), F.lit(0).cast("decimal(38,2)")))
    return lookup_join(files, about, ["parse_attempt_id"], "left").withColumns(
        {
            "parsed_revenue": plain_text(revenue),
            "parsed_quantity": plain_text(F.col("parsed_quantity")),
            "source_quantity": plain_text(F.col("source_quantity")),
        }
    )


FILE_COLUMNS = (
    "original_filename", "status", "deduplicated", "duplicate_of_import_file_id", "parse_attempt_id", "created_at",
    "completed_at", "records_found", "parse_status", "product_name", "product_external_id", "parsed_quantity",
    "parsed_revenue", "source_quantity", "quantity_validation_status",
)


def jobs_with_files(jobs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """JN12 and TK5: one row per job and file; a job without files keeps one row with a null file.

    Rows stay flat, because a job may hold any number of files.
    """
    wanted = jobs.select(F.col("id").alias("import_job_id"))
    chosen = lookup_join(tables["import_file"], wanted, ["import_job_id"], "left_semi")
    files = file_summaries(chosen, tables)
    listed = files.select("import_job_id", F.col("id").alias("file_id"), *[F.col(c).alias(f"file_{c}") for c in FILE_COLUMNS])
    about = jobs.select(
        F.col("id").alias("import_job_id"), F.col("status").alias("job_status"),
        F.col("created_at").alias("job_created_at"), F.col("completed_at").alias("job_completed_at"),
    )
    # Files look their job up, so a job with very many files is not gathered in one task.
    without_files = about.join(chosen.select("import_job_id").distinct(), "import_job_id", "left_anti")
    rows = lookup_join(listed, about, ["import_job_id"]).unionByName(without_files, allowMissingColumns=True)
    return rows.orderBy(F.desc("job_created_at"), "import_job_id", "file_created_at", "file_id")


def import_jobs(tables: dict[str, DataFrame], page: int | None = None, size: int | None = None) -> Page:
    """QY6: newest jobs first."""
    found = take_page(tables["import_job"], [F.desc("created_at"), F.col("id")], page, size)
    return Page(jobs_with_files(found.content, tables), found.info)


def import_job(tables: dict[str, DataFrame], job_id: str) -> DataFrame:
    """QY6: one job with its files, or no row."""
    return jobs_with_files(tables["import_job"].filter(F.col("id") == job_id), tables)


def validations_of(validations: DataFrame, attempts: DataFrame) -> DataFrame:
    """TK7 and PF9: validation rows of the attempts as texts, by code."""
    numbers = ("source_value", "calculated_value", "difference", "tolerance")
    return (
        lookup_join(validations, attempts, ["parse_attempt_id"], "left_semi")
        .orderBy("code", "source_locator")
        .select(
            "code", "status", *[plain_text(F.col(c)).alias(c) for c in numbers], "rule_version", "source_locator"
        )
    )


def import_file(tables: dict[str, DataFrame], job_id: str, file_id: str) -> FileDetail:
    """QY7 and PF8: a file of the given job with artifact, attempt, hints and validations."""
    files = tables["import_file"].filter((F.col("id") == file_id) & (F.col("import_job_id") == job_id))
    artifacts = tables["raw_artifact"].select(F.col("id").alias("raw_artifact_id"), "sha256", "byte_size")
    attempts = tables["parse_attempt"].select(
        F.col("id").alias("parse_attempt_id"), F.col("status").alias("parse_status"), "records_found", "parser_name",
        "parser_version",
    )
    detail = files.join(artifacts, "raw_artifact_id").join(attempts, "parse_attempt_id", "left").select(
        "id", "import_job_id", "raw_artifact_id", "parse_attempt_id", "original_filename", "source", "status",
        "deduplicated", "duplicate_of_import_file_id", "sha256", "byte_size", "parse_status", "records_found",
        "parser_name", "parser_version", read_hints(F.col("filename_hints")).alias("filename_hints"), "created_at",
        "completed_at",
    )
    attempt_ids = files.filter(F.col("parse_attempt_id").isNotNull()).select("parse_attempt_id")
    return FileDetail(detail, validations_of(tables["validation_result"], attempt_ids))
