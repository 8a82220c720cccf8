"""Structured replies of a reviewing model, stored as raw JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transhume.functions.types import is_object, member, scalar_kind, truthy
from transhume.values import REPLY_WRAPPERS

# The fields, each with the two keys it is looked for under and its default; the
# length of the preview.
SCORE = ("complexity_score", "complexity", 3)
RISK = ("risk_assessment", "risk", "medium")
CHALLENGES = ("migration_challenges", "challenges", "[]")
FEATURES = ("databricks_specific_features", "features", "[]")
HOURS = ("estimated_effort_hours", "effort_hours", 8.0)
ADVICE = ("aws_service_recommendations", "recommendations", "[]")
PREVIEW = 200


def is_text(value: Column) -> Column:
    return scalar_kind(value) == "STRING"


def unwrap(reply: Column) -> Column:
    """The first wrapper member that is an object or text, else the reply; text is read again."""
    inner = []
    for key in REPLY_WRAPPERS:
        found = member(reply, key)
        inner.append(F.when(is_object(found) | is_text(found), found))
    found = F.coalesce(*inner, reply)
    again = F.try_parse_json(F.try_variant_get(found, "$", "string"))
    return F.when(is_text(found), again).otherwise(found)


def chosen(reply: Column, *keys: str) -> Column:
    """The first of the keys holding anything, as VARIANT."""
    found = [member(reply, key) for key in keys]
    return F.coalesce(*[F.when(truthy(value), value) for value in found])


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def reply_fields(reply: Column, raw: Column) -> Column:
    """The six fields with their defaults, and a preview of the raw text when unreadable.

    List fields are JSON text, since their items may be of any shape.  A score or effort that is
    no number makes the whole reply unreadable.
    """
    score_value = chosen(reply, *SCORE[:2])
    score_text = as_text(score_value)
    hours_text = as_text(chosen(reply, *HOURS[:2]))
    # A JSON number may have a fraction, which is cut off; a text must be a whole number.
    cut = score_text.try_cast("double").try_cast("int")
    score = F.when(is_text(score_value), score_text.try_cast("int")).otherwise(cut)
    hours = hours_text.try_cast("double")
    readable = F.coalesce(
        is_object(reply)
        & (score_text.isNull() | score.isNotNull())
        & (hours_text.isNull() | hours.isNotNull()),
        F.lit(False),
    )

    def field(spec: tuple, value: Column | None = None) -> Column:
        name, other, default = spec
        value = as_text(chosen(reply, name, other)) if value is None else value
        kept = F.when(readable, F.coalesce(value, F.lit(default))).otherwise(F.lit(default))
        return kept.alias(name)

    return F.struct(
        field(SCORE, score),
        field(RISK),
        field(CHALLENGES),
        field(FEATURES),
        field(HOURS, hours),
        field(ADVICE),
        F.when(~readable, F.left(raw, F.lit(PREVIEW))).alias("raw_response_preview"),
    )
