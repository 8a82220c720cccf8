"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Level one groups documents by the length of the normalised text, level two splits the groups that
have more than one member by a hash of the first characters, and only what still has company is
hashed in full.  Levels one and two work on a narrow table without text.  What survives them goes
into a bit set of fixed size, so that the second scan reads and hashes those texts alone and no text
is ever shuffled.  All of it is DataFrame expressions.

Null text counts as empty, and empty texts are equal to each other.  A document is known by its
doc_id; rows that repeat a doc_id within a group each count in the group's size and share one verdict.
The smallest id that is not null is preferred, so a group keeps a null id only if it has no other.

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared

PREFIX = 64


def normalised(text: str | Column = "text") -> Column:
    """The text without white space; null gives an empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), shared.BLANK + "+", "")


def _row_hash(key: str, text: str) -> Column:
    """Of the id and the raw length: cheap, equal for equal rows, and spread over all bits."""
    return F.xxhash64(F.lit(7), F.col(key), F.length(text))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Levels one and two: (row hash) of each document that shares length and prefix with another."""
    norm = normalised(text)
    shapes = shared.written(
        docs.select(
            _row_hash(key, text).alias("row"),
            F.length(norm).alias("n"),
            F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"),
        ),
        "exact-shapes",
    )
    # the levels work on counts, which are combined before any shuffle, so a hot length is one row a task
    counts = shapes.groupBy("n", "prefix").agg(F.count(F.lit(1)).alias("m"))
    lengths = counts.groupBy("n").agg(F.sum("m").alias("all")).where("all > 1").select("n")
    pairs = counts.where("m > 1").join(lengths, "n", "left_semi").select("n", "prefix")
    pairs = shared.written(pairs, "exact-pairs")
    return shapes.join(pairs, ["n", "prefix"], "left_semi").select("row")


def refine(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """One row per document: key, the columns of `keep`, keep_id, group_size and kept.

    Of equal texts the one with the most code points stays, then the smallest key.
    """
    keep = keep or []
    bits = shared.filter_of(candidates(docs, key, text), "row")
    bits = shared.written(bits, "exact-filter")
    whole = F.sha2(normalised(text), 256)
    names = [key, *keep]
    needed = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, text, *keep])])
    scan = shared.marked(needed.withColumn("_row", _row_hash(key, text)), F.col("_row"), bits)
    rows = scan.select(
        *[F.col(f"`{c}`") for c in names],
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_points"),
        # a document alone gets a mark of its own that no digest equals, spread over all tasks
        F.when(F.col("_maybe"), whole).otherwise(F.concat(F.lit("-"), F.col("_row"))).alias("_full"),
        F.col("_maybe").alias("_shared"),
    )
    groups = (
        rows.where("_shared")
        .groupBy("_full", "_points")
        .agg(F.min(key).alias("_id"), F.count(F.lit(1)).alias("_n"))
        .groupBy("_full")
        .agg(F.max_by("_id", "_points").alias("_keep"), F.sum("_n").alias("_size"))
        .where("_size > 1")
        .withColumnRenamed("_full", "_group")
    )
    # a table of its own, so that Spark can split the join at a group of very many copies
    groups = shared.written(groups, "exact-groups")
    joined = rows.join(groups, F.col("_full") == F.col("_group"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col("_group").isNull(), F.col(key)).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("_group").isNull(), True)
        .otherwise(F.col(key).eqNullSafe(F.col("_keep")))
        .alias("kept"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with.

    Of rows that repeat id and normalised text of one that stays, one stays.
    """
    digest = F.sha2(normalised(text), 256)
    narrow = docs.select(F.col(key).alias("i"), F.col(text).alias("x"), digest.alias("d"))
    verdicts = refine(narrow, "i", "x", ["d"]).where("group_size > 1").select("i", "d", "kept")
    verdicts = shared.written(verdicts, "exact-verdicts")
    again = verdicts.where("kept").groupBy("i", "d").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    again = shared.written(again.select("i", "d"), "exact-again")
    gone = verdicts.where("not kept").select("i", "d").unionByName(again)
    rows = shared.packed(docs, id=F.col(key), digest=digest)
    stay = shared.without(rows, gone, {"id": "i", "digest": "d"})
    same = rows["id"].eqNullSafe(again["i"]) & (rows["digest"] == again["d"])
    once = rows.join(again, same, "left_semi").dropDuplicates(["id", "digest"])
    return stay.unionByName(once).select("row.*")
