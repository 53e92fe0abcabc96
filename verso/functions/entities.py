"""Tasks and validations as structs, and their transitions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PENDING, TRANSLATED, FAILED = "pending", "translated", "failed"
METADATA = "struct<file_path:string,line_number:bigint,context_before:array<string>,context_after:array<string>,character_name:string>"


def new_task(task_id: Column, text: Column, source: Column, target: Column, now: Column) -> Column:
    """A pending task without metadata."""
    nothing = F.array().cast("array<string>")
    metadata = F.struct(F.lit(None).alias("file_path"), F.lit(None).alias("line_number"), nothing.alias("context_before"), nothing.alias("context_after"), F.lit(None).alias("character_name"))
    return F.struct(
        task_id.alias("id"),
        text.alias("source_text"),
        F.lit(None).cast("string").alias("translated_text"),
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.struct(source.alias("source"), target.alias("target")).alias("language_pair"),
        metadata.cast(METADATA).alias("metadata"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def with_metadata(task: Column, **fields: Column) -> Column:
    """The task with some fields of its metadata set; its time stays."""
    for name, value in fields.items():
        task = task.withField(f"metadata.{name}", value)
    return task


def mark_translated(task: Column, text: Column, now: Column) -> Column:
    return task.withField("translated_text", text).withField("status", F.lit(TRANSLATED)).withField("error", F.lit(None).cast("string")).withField("updated_at", now)


def mark_failed(task: Column, error: Column, now: Column) -> Column:
    """The task as failed; a translation that it had stays."""
    return task.withField("status", F.lit(FAILED)).withField("error", error).withField("updated_at", now)


def valid() -> Column:
    nothing = F.array().cast("array<string>")
    return F.struct(F.lit(True).alias("is_valid"), nothing.alias("errors"), nothing.alias("warnings"))


def add_error(validation: Column, error: Column) -> Column:
    """A further error, if there is one, makes the validation invalid."""
    added = validation.withField("is_valid", F.lit(False)).withField("errors", F.array_append(validation["errors"], error))
    return F.when(error.isNotNull(), added).otherwise(validation)


def add_warning(validation: Column, warning: Column) -> Column:
    added = validation.withField("warnings", F.array_append(validation["warnings"], warning))
    return F.when(warning.isNotNull(), added).otherwise(validation)
