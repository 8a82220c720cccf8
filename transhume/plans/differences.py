"""Rows that differ between a table and its copy, found by a tree of fingerprints.

Rows fall into leaves by a hash of their key.  A leaf's fingerprint is its number of rows and two order-free sums
over row hashes, a node's the sums of those below it.  Trees are small (FAN to the power of DEPTH leaves) and are
saved, so two tables can be compared again and again without reading either.  The comparison descends from the
root, only below nodes that differ, and reads the tables again only for the leaves found.  A table stored by
leaf (write_by_leaf) is then read in the folders of these leaves alone; of other tables, rows of equal leaves
end at the scan and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.plans.migration import hashable
from transhume.session import scratch_dir

FAN = 16
DEPTH = 3
LEAF = "_leaf"
SUMS = ["n", "hash_sum", "hash_xor"]


def leaf_of(df: DataFrame, keys: list[str], depth: int = DEPTH) -> Column:
    """The leaf of a row; that of a table stored by leaf is read, not computed."""
    if LEAF in df.columns:
        return F.col(LEAF).cast("int")
    return F.pmod(F.xxhash64(*[hashable(df, name) for name in keys]), F.lit(FAN**depth)).cast("int")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[hashable(df, name) for name in sorted(df.columns) if name != LEAF])


def save_tree(df: DataFrame, keys: list[str], path: str, depth: int = DEPTH) -> DataFrame:
    """Write the fingerprints of all nodes, a folder for each level, and give them as read back."""
    spark = df.sparkSession
    hashed = df.select(leaf_of(df, keys, depth).alias("node"), row_hash(df).alias("h"))
    rows = hashed.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"),
    )
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/level={depth}")
    leaves = spark.read.schema(rows.schema).parquet(f"{path}/level={depth}")
    if depth:
        # the leaves are few, and each level is taken from them
        up = [(level, FAN ** (depth - level)) for level in range(depth)]
        above = leaves.select(
            F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col("node") / size).cast("int").alias("node")) for level, size in up])).alias("at"),
            *SUMS,
        )
        nodes = above.groupBy("at").agg(
            F.sum("n").alias("n"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor")
        )
        nodes.coalesce(1).select("at.node", *SUMS, "at.level").write.mode("append").partitionBy("level").parquet(path)
    return read_tree(spark, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    kind = "node INT, n BIGINT, hash_sum DECIMAL(38,0), hash_xor BIGINT, level INT"
    return spark.read.schema(kind).parquet(path)


def differing_leaves(source: DataFrame, copy: DataFrame, depth: int = DEPTH) -> list[int]:
    """The leaves whose fingerprints differ, by descending both trees."""
    nodes = [0]
    for level in range(depth + 1):
        here = (F.col("level") == level) & F.col("node").isin(nodes)
        a, b = (t.where(here).select("node", F.struct(*SUMS).alias(name)) for t, name in ((source, "a"), (copy, "b")))
        rows = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).collect()
        nodes = sorted(r["node"] for r in rows)
        if not nodes:
            return []
        if level < depth:
            nodes = [n * FAN + i for n in nodes for i in range(FAN)]
    return nodes


def write_by_leaf(df: DataFrame, keys: list[str], path: str, depth: int = 2) -> None:
    """Store a table by leaf, a folder each.  The rows of a key are spread over tasks, whatever their number."""
    placed = df.withColumn(LEAF, leaf_of(df, keys, depth))
    salt = F.pmod(row_hash(df), F.lit(8))
    placed.repartition(F.col(LEAF), salt).write.mode("overwrite").partitionBy(LEAF).parquet(path)


def differing_rows(
    source: DataFrame,
    copy: DataFrame,
    keys: list[str],
    depth: int = DEPTH,
    trees: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """keys, kind, n_source, n_copy of every key whose rows differ: missing, added or changed.

    Null keys are keys like others, and a key may have many rows; it is changed where the rows differ in
    number or content.  Both tables need the same columns and types.
    """
    spark = source.sparkSession
    if trees is None:
        root = scratch_dir(spark, "fingerprints")
        trees = tuple(save_tree(df, keys, f"{root}/{name}", depth) for name, df in (("source", source), ("copy", copy)))
    leaves = differing_leaves(*trees, depth)

    def side(df: DataFrame, here: int) -> DataFrame:
        found = df.where(leaf_of(df, keys, depth).isin(leaves)) if leaves else df.where(F.lit(False))
        h = row_hash(df).cast("decimal(20,0)")
        zero, one = F.lit(0), F.lit(1)
        return found.select(
            F.struct(*[F.col(f"`{name}`") for name in keys]).alias("key"),
            (one if here == 0 else zero).cast("long").alias("s"),
            (zero if here == 0 else one).cast("long").alias("c"),
            (h if here == 0 else -h).cast("decimal(21,0)").alias("h"),
            row_hash(df).alias("x"),
        )

    sums = side(source, 0).unionByName(side(copy, 1)).groupBy("key")
    rows = sums.agg(F.sum("s").alias("n_source"), F.sum("c").alias("n_copy"), F.sum("h").alias("h"), F.bit_xor("x").alias("x"))
    kind = F.when(F.col("n_copy") == 0, "missing").when(F.col("n_source") == 0, "added").otherwise("changed")
    differ = (F.col("n_source") != F.col("n_copy")) | (F.col("h") != 0) | (F.col("x") != 0)
    return rows.where(differ).select("key.*", kind.alias("kind"), "n_source", "n_copy")
