"""Exported JSON listings, written by Spark from the views for the source queries to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.session import scratch_dir
from workload import views


def save(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def asset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per asset, in order: the asset, and the folder it is in."""
    rows = views.assets(spark, sf_dir).drop("content").orderBy("ord")
    folder = F.regexp_replace("path", "/[^/]+$", "")
    nothing = F.lit(None).cast("string")

    def item(kind: str, **cols: object) -> object:
        names = ("path", "language", "owner", "created_at", "modified_at", "last_modified")
        return F.struct(
            F.lit(kind).alias("object_type"),
            *[cols.get(name, nothing).alias(name) for name in names],
            cols.get("object_id", F.lit(None).cast("long")).alias("object_id"),
            F.struct(cols.get("meta_owner", nothing).alias("owner")).alias("object_meta"),
        )

    asset = item(
        "NOTEBOOK",
        path=F.col("path"),
        language=F.when(F.col("ord") % 4 != 0, F.col("language")),
        owner=F.col("owner"),
        created_at=F.col("created_at"),
        modified_at=F.col("modified_at"),
        last_modified=F.col("last_modified"),
        object_id=F.col("object_id"),
        meta_owner=F.when(F.col("ord") % 12 == 1, F.lit("meta")),
    )
    return rows.select(F.array(item("DIRECTORY", path=folder), asset).alias("objects"))


def body_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 bodies; every 13th has a character too many, every 17th is no UTF-8, every 19th empty.

    The character does no harm where padding has ended the text before it.  Of the others, every 23rd
    has needless padding at its end, and every 29th a stray character and a line end in front.
    """
    rows = views.assets(spark, sf_dir)
    encoded = F.encode("content", "UTF-8")
    whole = F.base64(encoded)
    body = (
        F.when(F.col("ord") % 13 == 0, F.concat(whole, F.lit("A")))
        .when(F.col("ord") % 17 == 0, F.base64(F.concat(F.unhex(F.lit("FF")), encoded)))
        .when(F.col("ord") % 19 == 0, F.lit(""))
        .when(F.col("ord") % 23 == 0, F.concat(whole, F.lit("===")))
        .when(F.col("ord") % 29 == 0, F.concat(F.lit("-\n"), whole))
        .otherwise(whole)
    )
    return rows.select("ord", "path", "language", body.alias("content"))


# One more character is one too many only where no padding ends the text, at whole threes of bytes.
CUT = "(ord % 13 = 0 AND strlen(content) % 3 = 0)"
UNREADABLE = f"({CUT} OR (ord % 13 <> 0 AND ord % 17 = 0))"
BAD_BODY = f"({UNREADABLE} OR (ord % 13 <> 0 AND ord % 19 = 0))"


def column_json() -> str:
    """Column entries of five shapes, as SQL giving JSON text for the column number i."""
    return """CASE i % 5
        WHEN 0 THEN concat('{"name":"c', i, '","type":"bigint"}')
        WHEN 1 THEN concat('{"column_name":"c', i, '","nullable":false,',
            '"data_type":{"type":"decimal","precision":', 10 + i % 9, ',"scale":2}}')
        WHEN 2 THEN concat('"c', i, ' array<int>  big"')
        WHEN 3 THEN concat('{"field":"c', i, '","is_nullable":0,',
            '"type":{"type":"array","elementType":{"type":"decimal"}}}')
        ELSE concat('{"col_name":"c', i, '","dtype":{"type":"struct","fields":[',
            '{"name":"a","type":"int"},{"field":"b","dtype":{"type":"array",',
            '"elementType":"string"}}]}}') END"""


# The same entries as the reader gives them, name:type:nullable.
COLUMN_TEXT = """list_aggregate(list_transform(range(1, {n} + 1), lambda i: 'c' || i || ':'
  || CASE i % 5 WHEN 0 THEN 'bigint:true'
     WHEN 1 THEN 'decimal(' || (10 + i % 9) || ',2):false'
     WHEN 2 THEN 'array<int> big:true'
     WHEN 3 THEN 'array<decimal>:false'
     ELSE 'struct<a:int, b:array<string>>:true' END), 'string_agg', '|')"""


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per table, in order, as JSON text, since the column entries differ in shape."""
    rows = views.tables(spark, sf_dir).orderBy("ord")
    numbers = "sequence(1, cast(ord % 12 as int) + 1)"
    entries = F.expr(
        f"concat('[', array_join(transform({numbers}, i -> {column_json()}), ','), ']')"
    )
    info = F.to_json(
        F.struct(
            "name",
            F.col("catalog").alias("catalog_name"),
            F.col("schema").alias("schema_name"),
            "table_type",
            F.when(F.col("ord") % 2 == 0, F.col("data_source_format")).alias("data_source_format"),
            F.when(F.col("ord") % 2 == 1, F.col("data_source_format")).alias("format"),
            "storage_location",
            "size_bytes",
            "created_at",
            "updated_at",
            "owner",
            "comment",
        )
    )
    merged = F.when(
        F.col("ord") % 10 != 0,
        F.concat(F.expr("left(info, length(info) - 1)"), F.lit(',"columns":'), entries, F.lit("}")),
    ).otherwise(F.col("info"))
    with_info = rows.withColumn("info", info)
    page = F.concat(F.lit('{"tables":['), merged, F.lit(']}'))
    return with_info.select(page.alias("value"))


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.jobs(spark, sf_dir).orderBy("ord").withColumn(
        "info",
        F.to_json(F.struct("job_id", "id", "name", "is_paused", "creator_user_name", "created_by")),
    )
    sep = F.when(F.col("info") == "{}", "").otherwise(",")
    job = F.concat(
        F.expr("left(info, length(info) - 1)"), sep, F.lit('"settings":'), "settings", F.lit("}")
    )
    return rows.select(F.concat(F.lit('{"jobs":['), job, F.lit("]}")).alias("value"))


def cluster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.clusters(spark, sf_dir).orderBy("ord").drop("ord")
    return rows.select(F.array(F.struct(*rows.columns)).alias("clusters"))


def export_dir(spark: SparkSession, sf_dir: str, *parts: str) -> str:
    """A fresh folder with the named listings in it."""
    root = scratch_dir(spark, "export")
    if "assets" in parts:
        asset_pages(spark, sf_dir).write.json(f"{root}/assets")
    if "bodies" in parts:
        body_rows(spark, sf_dir).select("path", "content").write.json(f"{root}/bodies")
    if "tables" in parts:
        table_pages(spark, sf_dir).write.text(f"{root}/tables")
    if "jobs" in parts:
        job_pages(spark, sf_dir).write.text(f"{root}/jobs")
    if "clusters" in parts:
        cluster_pages(spark, sf_dir).write.json(f"{root}/clusters")
    return root
