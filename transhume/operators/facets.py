"""All facets of a list in one pass: their values, and how many rows each would show.

A list with several choices shows beside each value the rows it would give, under the choices of the other
facets.  Asked one by one that is a scan and a distinct for each facet.  Here a row counts, for each facet, if it
meets the choices of all others; grouping sets then count all facets from one scan, with partial sums by
value, so that one exchange of counts is all that is shuffled, and a value that most rows have is a row a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.operators.filters import ALL


def facet_counts(
    df: DataFrame,
    facets: Sequence[str],
    choices: Mapping[str, str | None] | None = None,
    matching: Column | None = None,
) -> DataFrame:
    """(facet, value, n, n_all): every value of every facet, with the rows that it has under the choices of
    the other facets, and without any choice.  ``matching`` is a condition on all rows, a search say.

    ``All`` or None chooses nothing.  Null is no value, but rows that have it count for the other facets.  A
    value is text, as a choice is.  No facet and no row give nothing."""
    if not facets:
        return df.sparkSession.createDataFrame([], "facet STRING, value STRING, n BIGINT, n_all BIGINT")
    chosen = {f: v for f, v in (choices or {}).items() if v is not None and v != ALL}
    unknown = set(chosen) - set(facets)
    if unknown:
        raise ValueError(f"choices of no facet: {sorted(unknown)}")
    rows = df if matching is None else df.where(matching)

    def meets(facet: str) -> Column:
        if facet not in chosen:
            return F.lit(True)
        return F.coalesce(F.col(f"`{facet}`").cast("string") == chosen[facet], F.lit(False))

    def shown(facet: str) -> Column:
        out = F.lit(True)
        for other in facets:
            out = out & meets(other) if other != facet else out
        return out.cast("long")

    names = [f"f{i}" for i in range(len(facets))]
    flat = rows.select(
        *[F.col(f"`{f}`").cast("string").alias(name) for f, name in zip(facets, names)],
        *[shown(f).alias(f"n{i}") for i, f in enumerate(facets)],
    )
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(facets))]
    inside = [F.grouping(name).alias(f"g{i}") for i, name in enumerate(names)]
    sets = flat.groupingSets([[F.col(name)] for name in names], *[F.col(name) for name in names])
    counted = sets.agg(F.count(F.lit(1)).alias("n_all"), *sums, *inside)

    def of_set(columns: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col(f"g{i}") == 0, c) for i, c in enumerate(columns)])

    return counted.select(
        of_set([F.lit(f) for f in facets]).alias("facet"),
        of_set([F.col(name) for name in names]).alias("value"),
        of_set([F.col(f"n{i}") for i in range(len(facets))]).alias("n"),
        "n_all",
    ).where("value IS NOT NULL")
