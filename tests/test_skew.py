"""One key holding a third of all rows: results stay whole, and what is shuffled stays small."""

from pyspark.sql import functions as F

from transhume.operators import aggregates, joins, rewrite

N = 60_000


def hot(i):
    """A third of the rows on one key, the others spread."""
    return F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (i % 5000).cast("string")))


def test_last_of_a_hot_path(spark):
    runs = spark.range(N).select(
        hot(F.col("id")).alias("path"),
        F.col("id").alias("ord"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("risk"),
    )
    assets = spark.range(N).select(hot(F.col("id")).alias("path"), F.col("id").alias("asset"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.with_analysis(assets, runs)
        assert joined.count() == N and joined.select("asset").distinct().count() == N
        risks = [r[0] for r in joined.where("path = 'hot'").select("risk").distinct().collect()]
        assert risks == [f"r{N - 3}"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_of_a_hot_table(spark):
    i = F.col("id")
    tables = spark.range(N).select(
        i.alias("ord"), F.lit("c").alias("catalog"), F.lit("s").alias("schema"), hot(i).alias("name")
    )
    names = spark.createDataFrame([("c.s.hot",), ("c.s.k7",)], "fq_name STRING")
    found = {r["fq_name"]: r["ord"] for r in joins.resolve_tables(names, tables).collect()}
    assert found == {"c.s.hot": 0, "c.s.k7": 7}


def test_hot_catalog_sums_exactly(spark):
    tables = spark.range(N).select(
        hot(F.col("id")).alias("catalog"), (F.lit(2**40) + F.col("id")).alias("size_bytes")
    )
    rows = {r["catalog"]: r["size_bytes"] for r in aggregates.storage_by_catalog(tables).collect()}
    assert rows["hot"] == sum(2**40 + i for i in range(0, N, 3))


def test_one_huge_source_among_many(spark):
    """The huge file is a third of all lines; only its changed lines are shuffled."""
    huge = "\n".join(f"line {i}" if i % 100 else f"display({i})" for i in range(20_000))
    rows = [("huge", "SQL", huge)] + [(f"p{i}", "SQL", "x = 1\n" * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "path STRING, language STRING, content STRING")
    counts = {r["path"]: r for r in rewrite.diff_counts(rewrite.convert_assets(df)).collect()}
    assert len(counts) == 401
    assert (counts["huge"]["kept"], counts["huge"]["removed"], counts["huge"]["added"]) == (
        19_800,
        200,
        200,
    )
    assert all(counts[f"p{i}"]["kept"] == 100 for i in range(400))


def test_many_missing_owners(spark):
    assets = spark.range(N).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("o")).alias("owner"),
    )
    status = assets.select(
        "path",
        F.lit(None).cast("string").alias("owner"),
        F.struct(
            F.lit("").alias("owner"),
            F.col("path").alias("created_by"),
            F.lit("u").alias("created_by_user"),
        ).alias("object_meta"),
        F.lit("x").alias("created_by"),
    )
    doubled = status.unionAll(status)
    rows = joins.with_owner(assets, doubled)
    assert rows.count() == N
    assert rows.where("owner = path").count() == N // 3


def test_paths_repeated_on_both_sides(spark):
    """A path that is a third of both sides gives one row per listed asset, not all pairs."""
    listing = spark.range(N).select(hot(F.col("id")).alias("path"), F.col("id").alias("asset"))
    bodies = spark.range(N).select(
        hot(F.col("id")).alias("path"), F.concat(F.lit("s"), (F.col("id") % 3)).alias("content")
    )
    rows = joins.with_body(listing, bodies)
    assert rows.count() == N and rows.select("asset").distinct().count() == N
