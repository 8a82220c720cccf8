"""Source queries: each writes its export with Spark, then reads it as a user would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.session import scratch_dir
from transhume.sources import files, listings
from workload import listings as export
from workload import views
from workload.listings import BAD_BODY, COLUMN_TEXT
from workload.registry import query
from workload.views import ASSETS, CLUSTERS, JOBS, TABLES, TIMES, iso_sql, with_

LISTED_OWNER = "coalesce(nullif(owner, ''), CASE WHEN ord % 12 = 1 THEN 'meta' END, '')"
LISTED_LANGUAGE = "CASE WHEN ord % 4 <> 0 THEN language ELSE 'PYTHON' END"


@query(
    "src_assets",
    with_(ASSETS, TIMES)
    + f"""SELECT ord, path, language, content, size, object_id, created_at, modified_at, owner FROM (
    SELECT 2 * row_number() OVER (ORDER BY ord) - 1 AS ord, {BAD_BODY} AS bad, path,
      {LISTED_LANGUAGE} AS language, content, CAST(size AS INTEGER) AS size,
      object_id, {iso_sql("created_raw")} AS created_at, {iso_sql("modified_raw")} AS modified_at,
      {LISTED_OWNER} AS owner
    FROM times) WHERE NOT bad""",
)
def src_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = export.export_dir(spark, sf_dir, "assets", "bodies")
    return listings.read_assets(spark, f"{root}/assets", f"{root}/bodies")


@query(
    "src_scope",
    with_(ASSETS)
    + """SELECT path, 'subtree' AS scope FROM assets_v WHERE starts_with(path, '/Users/')
    UNION ALL
    SELECT path, 'folder' AS scope FROM assets_v
    WHERE regexp_replace(path, '/[^/]+$', '') = '/Shared/src3'""",
)
def src_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = views.assets(spark, sf_dir).select("path")
    below = listings.scope_assets(assets, "/Users/").withColumn("scope", F.lit("subtree"))
    inside = listings.scope_assets(assets, "/Shared/src3", recursive=False)
    return below.unionByName(inside.withColumn("scope", F.lit("folder")))


@query(
    "src_decode",
    with_(ASSETS) + f"SELECT path, content FROM assets_v WHERE NOT {BAD_BODY}",
)
def src_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.body_rows(spark, sf_dir).select("path", "content")
    return listings.decode_content(rows, "content")


LISTED_TABLE = f"""SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, name, catalog, schema, coalesce(table_type, 'MANAGED') AS table_type,
  data_source_format, coalesce(storage_location, '') AS storage_location,
  CASE WHEN ord % 10 <> 0 THEN {COLUMN_TEXT.format(n="(ord % 12 + 1)")} ELSE '' END AS columns_text,
  coalesce(size_bytes, 0)::BIGINT AS size_bytes, created_at, updated_at,
  coalesce(owner, '') AS owner, comment
FROM tables_v"""


@query("src_tables", with_(TABLES) + LISTED_TABLE)
def src_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = export.export_dir(spark, sf_dir, "tables")
    rows = listings.read_tables(spark, f"{root}/tables")
    return rows.withColumn("columns_text", views.columns_text()).drop("columns")


@query(
    "src_pages",
    with_(ASSETS)
    + """SELECT path, object_type, object_id FROM (
      SELECT path, 'NOTEBOOK' AS object_type, object_id FROM assets_v
      UNION ALL
      SELECT regexp_replace(path, '/[^/]+$', ''), 'DIRECTORY', NULL FROM assets_v)""",
)
def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transhume.schemas import LISTING

    root = scratch_dir(spark, "pages")
    pages = export.asset_pages(spark, sf_dir)
    pages.withColumn("page", F.pmod(F.hash(F.col("objects.path")), F.lit(4))).write.partitionBy(
        "page"
    ).json(root)
    rows = listings.read_pages(spark, f"{root}/page=*", LISTING)
    return rows.select("path", "object_type", "object_id")


ENUMERATED = """SELECT {scope} AS scope, ord, catalog, schema, name FROM tables_v"""


@query(
    "src_enumerate",
    with_(TABLES)
    + f"""{ENUMERATED.format(scope="'all'")}
        WHERE catalog <> 'cat_4' AND schema IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 40)
    UNION ALL {ENUMERATED.format(scope="'one catalog'")}
        WHERE catalog = 'cat_4'
          AND (catalog, schema) IN (SELECT catalog, schema FROM tables_v)
    UNION ALL {ENUMERATED.format(scope="'one schema'")}
        WHERE catalog <> 'cat_4' AND schema = 'Brand#3'""",
)
def src_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    tables = views.tables(spark, sf_dir).select("ord", "catalog", "schema", "name")
    catalogs = tables.select(F.col("catalog").alias("name")).where("name <> 'cat_4'").distinct()
    big = part.where("p_size > 40").select(F.col("p_brand").alias("name")).distinct()
    pairs = tables.select("catalog", F.col("schema").alias("name")).distinct()
    listed = pairs.join(big, "name", "left_semi")
    runs = {
        "all": listings.enumerate_tables(catalogs, listed, tables),
        "one catalog": listings.enumerate_tables(catalogs, pairs, tables, catalog="cat_4"),
        "one schema": listings.enumerate_tables(catalogs, pairs, tables, schema="Brand#3"),
    }
    rows = [df.select(F.lit(scope).alias("scope"), "*") for scope, df in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(
        "scope", "ord", "catalog", "schema", "name"
    )


@query(
    "src_fallback",
    with_(TABLES)
    + """SELECT 'first' AS case_name, name, size_bytes FROM tables_v
    UNION ALL SELECT 'second', s_name, s_suppkey FROM supplier""",
)
def src_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = views.tables(spark, sf_dir).select("name", "size_bytes")
    second = views.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("size_bytes")
    )
    some = listings.with_fallback(first, second)
    none = listings.with_fallback(first.where("size_bytes < 0"), second)
    return some.select(F.lit("first").alias("case_name"), "*").unionByName(
        none.select(F.lit("second").alias("case_name"), "*")
    )


@query(
    "src_jobs",
    with_(JOBS)
    + "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, job_id, name, schedule FROM jobs_v",
)
def src_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = export.export_dir(spark, sf_dir, "jobs")
    return listings.read_jobs(spark, f"{root}/jobs").select("ord", "job_id", "name", "schedule")


@query(
    "src_clusters",
    with_(CLUSTERS)
    + """SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, cluster_id, num_workers, min_workers, driver_node_type_id, node_type_id, start_time,
      NULL::BIGINT AS created_time, terminated_time, NULL::BIGINT AS end_time FROM clusters_v""",
)
def src_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = export.export_dir(spark, sf_dir, "clusters")
    rows = listings.read_clusters(spark, f"{root}/clusters")
    return rows.withColumn("min_workers", F.col("autoscale.min_workers")).drop("autoscale")


@query(
    "src_table_or_path",
    """SELECT 'by name' AS found, n_nationkey::BIGINT AS id, n_name AS name FROM nation
    UNION ALL SELECT 'by location', c_custkey, c_name FROM customer""",
)
def src_table_or_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.table(spark, sf_dir, "nation").createOrReplaceTempView("known_nation")
    by_name = files.read_table(spark, "known_nation", f"{sf_dir}/none.parquet")
    by_place = files.read_table(spark, "unknown_customer", f"{sf_dir}/customer.parquet")
    return by_name.select(
        F.lit("by name").alias("found"),
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
    ).unionByName(
        by_place.select(
            F.lit("by location").alias("found"),
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
        )
    )


@query("src_latest", "SELECT c_custkey AS id, c_name AS name FROM customer")
def src_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "results")
    rows = {
        "migration_results_20240101.json": ("supplier", "s_suppkey", "s_name"),
        "migration_results_20240301.json": ("customer", "c_custkey", "c_name"),
        "other_results_20250101.json": ("part", "p_partkey", "p_name"),
    }
    for name, (source, key, label) in rows.items():
        df = views.table(spark, sf_dir, source)
        df.select(F.col(key).alias("id"), F.col(label).alias("name")).write.json(f"{root}/{name}")
    return files.read_latest(spark, root).select("id", "name")


@query(
    "src_manifest",
    """SELECT 'lang=' || lang AS folder, sum(strlen(text) + 1)::BIGINT AS n_bytes
    FROM documents GROUP BY lang""",
)
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "texts")
    views.table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(
        root
    )
    # Beside the data Spark leaves a marker and, on a local disk, hidden checksum files.
    found = files.file_manifest(spark, root).where(F.col("relative").rlike(r"/part-[^/]*\.txt$"))
    folder = F.substring_index("relative", "/", 1)
    return (
        found
        .groupBy(folder.alias("folder"))
        .agg(F.sum("length").alias("n_bytes"))
    )
