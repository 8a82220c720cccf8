"""Pages that name each other: put in order, with what is missing, repeated or going round.

A listing that came in pages has a chain of them: the first was asked for without a token, and each names the
token of the next.  Saved pages are in any order, and a place in the chain is only known from the page before.
Places are found by pointer doubling: every page knows the page 1, 2, 4, 8 .. steps on, and the set of pages
reached from the first ones doubles in each round.  A chain of a million pages takes twenty rounds of joins on
tokens, whatever the number of chains beside it; no chain is walked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.session import scratch_dir
from transhume.sources.ordinals import running_totals

FIRST = ""  # the token of a first page
CHAIN = ["listing", "token"]


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, so that a round doesn't repeat those before it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_token(names: tuple[str, ...] = ("next_page_token", "next_page")) -> Column:
    """Where a page names its successor, in this order."""
    return scalars.first_set([F.col(name) for name in names], "")


def places(links: DataFrame) -> DataFrame:
    """(listing, token, place) of all pages that a first page leads to; links: (listing, token, next), a
    row for each page and a next that is a page's token.  In a chain that runs into itself a page has the
    place where it is met first."""
    jump = kept(links, "jumps")
    # a first page may also be named as the next of another; it is first all the same
    starts = links.where(F.col("token") == FIRST).select("listing", "token")
    reached = kept(starts.withColumn("place", F.lit(0).cast("long")), "reached")
    step, n = 1, -1
    while n != (n := reached.count()):
        on = jump.withColumnRenamed("next", "to")
        further = reached.join(on, CHAIN).select(
            "listing", F.col("to").alias("token"), (F.col("place") + step).alias("place")
        )
        both = reached.unionByName(further).groupBy(*CHAIN).agg(F.min("place").alias("place"))
        reached = kept(both, "reached")
        ahead = jump.select("listing", F.col("token").alias("next"), F.col("next").alias("after"))
        doubled = jump.join(ahead, ["listing", "next"]).select("listing", "token", F.col("after").alias("next"))
        jump = kept(doubled, "jumps")
        step *= 2
    return reached


def page_chain(pages: DataFrame) -> DataFrame:
    """One row for each page and each missing one, by (listing, token, next): place, given, status.

    ``pages`` may repeat a page; null and empty tokens are those of first pages, null and empty nexts of last
    ones.  Where repeats name different nexts the least of them holds.  status is
      ok            reached from the first page, and its next is too
      next missing  no page has the token it names
      loops         its next stands before it, or is itself
      unreached     no first page leads to it: something before it is missing, or it is in a loop of its own
      missing       named by a page, but not there; it has no place
    """
    tokens = pages.select(
        F.coalesce("listing", F.lit("")).alias("listing"),
        F.coalesce("token", F.lit(FIRST)).alias("token"),
        scalars.unless(F.col("next"), "").alias("next"),
    )
    nodes = kept(tokens.groupBy(*CHAIN).agg(F.min("next").alias("next"), F.count(F.lit(1)).alias("given")), "pages")
    named = nodes.where("next IS NOT NULL").select("listing", F.col("next").alias("token"), F.col("token").alias("next"))
    there = nodes.select(*CHAIN)
    links = nodes.select("listing", "token", "next").join(
        there.withColumnRenamed("token", "next"), ["listing", "next"], "left_semi"
    )
    # a listing of one page has no link; its first page is reached all the same
    alone = nodes.where(F.col("token") == FIRST).select("listing", "token", F.lit(None).cast("string").alias("next"))
    placed = places(links.unionByName(alone.join(links.select(*CHAIN), CHAIN, "left_anti")))
    of_next = placed.select("listing", F.col("token").alias("next"), F.col("place").alias("_next_place"))
    rows = nodes.join(placed, CHAIN, "left").join(of_next, ["listing", "next"], "left")
    gone = named.join(there, CHAIN, "left_anti").select(*CHAIN).distinct()
    lost = gone.select("listing", F.col("token").alias("next"), F.lit(True).alias("_lost"))
    status = (
        F.when(F.col("place").isNull(), "unreached")
        .when(F.col("_lost"), "next missing")
        .when(F.col("_next_place") <= F.col("place"), "loops")
        .otherwise("ok")
    )
    rows = rows.join(lost, ["listing", "next"], "left").withColumn("status", status)
    rows = rows.select(*CHAIN, "next", "place", "given", "status")
    absent = gone.withColumns({"given": F.lit(0).cast("long"), "status": F.lit("missing")})
    return rows.unionByName(absent, allowMissingColumns=True)


def read_chain(spark: SparkSession, path: str, schema: str, listing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items in order, the chain's pages) of saved pages, JSON lines with ``page_token`` and a next token.

    ``schema`` has the array column first; ``listing`` names a further text column that tells listings
    apart.  Items come from reached pages, each page once, with ``ord`` from 0 on over all listings in order of
    their names.  Of repeated pages the one whose items' hash is least gives them."""
    array = schema.split()[0]
    extra = f", {listing} STRING" if listing else ""
    full = f"{schema}, page_token STRING, next_page_token STRING, next_page STRING{extra}"
    name = F.coalesce(F.col(listing), F.lit("")) if listing else F.lit("")
    raw = spark.read.schema(full).json(path).select(
        name.alias("listing"), F.coalesce("page_token", F.lit(FIRST)).alias("token"), next_token().alias("next"), F.col(array).alias("items")
    )
    chain = kept(page_chain(raw), "chain")
    once = raw.groupBy(*CHAIN).agg(F.min_by("items", F.xxhash64(F.to_json(F.struct("items")))).alias("items"))
    sizes = kept(
        once.join(chain.where("place IS NOT NULL").select(*CHAIN, "place"), CHAIN).withColumn("n", F.coalesce(F.greatest(F.size("items"), F.lit(0)), F.lit(0))),
        "chained",
    )
    starts = running_totals(sizes.select("listing", "place", "n"), ["listing", "place"], "n", "_start")
    items = sizes.join(starts.select("listing", "place", "_start"), ["listing", "place"])
    items = items.select("listing", "place", "_start", F.posexplode("items").alias("_at", "item"))
    return items.select("listing", "place", (F.col("_start") + F.col("_at")).alias("ord"), "item.*"), chain
