"""Filters.  All are plain predicates, so Spark moves them to the scan where it can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.operators.fields import existing

ALL = "All"  # fixed value: the choice that filters nothing


def facet_filter(df: DataFrame, **facets: str | None) -> DataFrame:
    """Equality per column; ``All`` or None filters nothing."""
    for name, value in facets.items():
        if value is not None and value != ALL:
            df = df.where(F.col(name) == value)
    return df


def search(
    df: DataFrame,
    query: str,
    cols: Sequence[str] = ("path", "name", "owner"),
    regex: bool = False,
) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case."""
    if not query:
        return df
    wanted = query.lower()
    found = F.lit(False)
    for name in cols:
        value = F.lower(F.coalesce(name, F.lit("")))
        found = found | (value.rlike(wanted) if regex else F.contains(value, F.lit(wanted)))
    return df.where(found)


def cascade_filter(
    tables: DataFrame, catalog: str | None = ALL, schema: str | None = ALL
) -> DataFrame:
    return facet_filter(tables, catalog=catalog, schema=schema)


def format_filter(tables: DataFrame, keep: str = "DELTA") -> DataFrame:
    """Tables of one format; a table without a format stays."""
    aliases = existing(tables, "data_source_format", "format", "storage_format")
    fmt = F.coalesce(scalars.first_set(aliases, ""), F.lit(""))
    return tables.where((fmt == "") | (F.upper(fmt) == keep.upper()))


def non_empty(df: DataFrame, col: str = "content") -> DataFrame:
    return df.where(F.length(col) > 0)


def high_usage(
    costs: DataFrame,
    n: int = 5,
    threshold: float = 1000,
    order: str = "ord",
    hours: str = "dbu_hours",
) -> DataFrame:
    """Of the first ``n`` clusters in input order, those above the threshold.

    The limit comes first, as asked for; Spark keeps n rows per task and never sorts the whole.
    """
    return costs.orderBy(order).limit(n).where(F.col(hours) > threshold)
