"""Job facts, read from the settings as a map from key to VARIANT.

The settings are parsed once per job; every fact looks its keys up in the same map.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transhume.functions.scalars import first_set
from transhume.functions.types import members, truthy

# Task key in the settings -> job type, first present wins.
TASK_TYPES = (
    ("notebook_task", "notebook"),
    ("spark_jar_task", "jar"),
    ("spark_python_task", "python"),
    ("spark_submit_task", "spark-submit"),
    ("dbt_task", "dbt"),
)
FILE_ARRIVAL_KEY = "file_arrival_notification"


def settings_map(settings: Column) -> Column:
    return members(F.try_parse_json(settings))


def set_text(value: Column) -> Column:
    """Text of a VARIANT that holds anything."""
    return F.when(truthy(value), F.try_variant_get(value, "$", "string"))


def job_type(settings: Column) -> Column:
    kind = F.when(F.coalesce(F.size(settings), F.lit(0)) <= 0, "unknown")
    for key, name in TASK_TYPES:
        kind = kind.when(truthy(settings[key]), name)
    return kind.otherwise("other")


def job_schedule(settings: Column) -> Column:
    schedule = settings["schedule"]
    return F.coalesce(
        set_text(F.try_variant_get(schedule, "$.quartz_cron_expression", "variant")),
        set_text(F.try_variant_get(schedule, "$.cron", "variant")),
    )


def job_trigger(settings: Column, text: Column, is_paused: Column) -> Column:
    paused = F.coalesce(is_paused, F.lit(False)) & F.is_variant_null(
        settings["email_notifications"]
    )
    return (
        F.when(job_schedule(settings).isNotNull(), "scheduled")
        .when(F.contains(F.lower(text), F.lit(FILE_ARRIVAL_KEY)), "file-arrival")
        .when(F.coalesce(paused, F.lit(False)), "paused")
        .otherwise("ad-hoc")
    )


def job_name(settings: Column, name: Column, job_id: Column) -> Column:
    fallback = F.concat(F.lit("job_"), F.coalesce(job_id.cast("string"), F.lit("None")))
    return F.coalesce(set_text(settings["name"]), F.nullif(name, F.lit("")), fallback)


def job_run_as(settings: Column, creator: Column, created_by: Column) -> Column:
    return F.coalesce(
        set_text(settings["run_as_user"]),
        set_text(settings["run_as"]),
        first_set([creator, created_by], ""),
    )
