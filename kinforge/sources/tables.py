"""Job, slot, candidate and feedback tables as Parquet: reads, appends, older snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: defaults of a new row ----------------------------------------------------
SLOT_DEFAULTS = {"confidence": "", "confidence_score": 0, "confidence_level": "Unknown", "verification_notes": "", "accepted": 0, "sources": "[]", "missing_info": "[]"}
CANDIDATE_DEFAULTS = {"search_pass": 1, "selected": 0, "rejection_reason": "", "raw_data": "{}", "source_origin": "tree"}
FEEDBACK_DEFAULTS = {"ancestor_name": "", "surname": "", "location": "", "admin_notes": ""}
JOB_DEFAULTS = {"status": "pending", "generations": 6}


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Absent columns are added, nulls filled."""
    for name, value in defaults.items():
        if name in rows.columns:
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
        else:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def append(rows: DataFrame, path: str, defaults: dict) -> None:
    with_defaults(rows, defaults).write.mode("append").parquet(path)


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """An older snapshot beside a newer one: columns the old lacks take their defaults."""
    both = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)), allowMissingColumns=True)
    for name, value in defaults.items():
        if name not in old.columns:
            both = both.withColumn(name, F.when(F.col("_old") & F.col(name).isNull(), F.lit(value)).otherwise(F.col(name)))
    return both.drop("_old")


def jobs_page(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return jobs.orderBy(F.desc("created_on"), F.desc("job_id")).offset(offset).limit(limit)


def json_field(c: Column, path: str, default: str = "") -> Column:
    """A field of a JSON text; the default when the text or the field is unreadable."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), path, "string"), F.lit(default))
