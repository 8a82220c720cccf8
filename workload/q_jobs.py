"""Sinks and whole jobs: written to a fresh folder, read back, and returned as rows."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.functions import scalars
from transhume.operators import aggregates
from transhume.plans import analysis as plan
from transhume.plans import conversion, migration, reports
from transhume.session import scratch_dir
from transhume.sinks import objects, parts
from transhume.sinks import reports as sinks
from transhume.sources.files import file_manifest, read_table
from workload import listings as export
from workload import views
from workload.listings import BAD_BODY, UNREADABLE
from workload.q_fields import TRIGGER
from workload.q_reports import LAST, analyses, overview
from workload.q_scan import ANALYSIS, BUCKET, CONVERTED, DIFF, LABEL, PCT, converted
from workload.registry import query
from workload.views import ASSETS, JOBS, SCAN, TABLES, confidence_sql, with_

# Bytes of a range where files are copied in parts.
RANGE = 1 << 20

GIVEN = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


# The whole number that leads each given table.
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": "conv_id",
}


def counts_sql() -> str:
    """Row count and sum of keys of every given table."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS n_rows, sum({key})::BIGINT AS key_sum FROM {name}"
        for name, key in KEYS.items()
    )


def contents(
    spark: SparkSession, folder: str, suffix: str = "", names: Collection[str] = tuple(KEYS)
) -> DataFrame:
    """Row count and sum of keys of every given table, or of those named, as it was written below a folder."""
    none = spark.createDataFrame([], "name STRING, n_rows BIGINT, key_sum BIGINT")
    found = [
        spark.read.parquet(f"{folder}/{name}{suffix}").agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col(key).cast("long")).alias("key_sum"),
        )
        for name, key in KEYS.items()
        if name in names
    ]
    return reduce(DataFrame.unionByName, found, none)


def given_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables as a listing, with their places and columns."""
    rows = []
    for name in GIVEN:
        fields = views.table(spark, sf_dir, name).schema.fields
        columns = [(f.name, f.dataType.simpleString(), f.nullable) for f in fields]
        # Every other one is known to be Parquet, and is moved by its files.
        fmt = "PARQUET" if GIVEN.index(name) % 2 else None
        rows.append(("lake", "given", name, f"{sf_dir}/{name}.parquet", fmt, columns))
    return spark.createDataFrame(
        rows,
        "catalog STRING, schema STRING, name STRING, storage_location STRING, "
        "data_source_format STRING, columns ARRAY<STRUCT<name: STRING, type: STRING, nullable: BOOLEAN>>",
    )


@query("sink_export", "SELECT * FROM lineitem")
def sink_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = {
        "catalog": "lake",
        "schema": "given",
        "name": "lineitem",
        "storage_location": f"{sf_dir}/lineitem.parquet",
    }
    place, _ = sinks.export_table(spark, info, scratch_dir(spark, "exported"))
    return spark.read.parquet(place)


@query("sink_copy", f"SELECT *, 0::BIGINT AS n_differing FROM ({counts_sql()})")
def sink_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies read as tables, and their bytes compared; long files go in ranges of a megabyte.

    A table is a file or a folder of files."""
    root = scratch_dir(spark, "copied")
    manifest = file_manifest(spark, sf_dir)
    parts.copy_large(manifest, root, RANGE).write.json(f"{root}-status")
    compared = views.kept(parts.compare_files(manifest, root, RANGE), "compared")
    name = F.regexp_replace(F.substring_index("key", "/", 1), "\\.parquet$", "").alias("name")
    differing = compared.groupBy(name).agg(F.sum("n_differing").alias("n_differing"))
    return contents(spark, root, ".parquet").join(differing, "name")


@query(
    "sink_sidecar",
    with_(TABLES)
    + """SELECT 'migrated-tables/' || catalog || '/' || schema || '/' || name || '/schema.json' AS key,
      true AS ok, true AS whole, name, table_type, size_bytes, coalesce(n_cols, 0) AS n_columns,
      comment AS notes, 12 AS n_members FROM tables_v""",
)
def sink_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file read back, beside what the writer reports of it; one that it failed to write is not read."""
    root = scratch_dir(spark, "sidecars")
    tables = views.tables(spark, sf_dir)
    sinks.write_sidecars(tables, root).write.parquet(f"{root}-status")
    status = spark.read.parquet(f"{root}-status")
    found = views.kept(objects.get_texts(status.where("ok"), root), "texts")
    schema = """name STRING, table_type STRING, size_bytes BIGINT, notes STRING,
        columns ARRAY<STRUCT<name: STRING, type: STRING, nullable: BOOLEAN>>"""
    body = F.from_json("text", schema)
    return status.join(found, "key", "left").select(
        "key",
        "ok",
        (F.octet_length("text") == F.col("n_bytes")).alias("whole"),
        body["name"].alias("name"),
        body["table_type"].alias("table_type"),
        body["size_bytes"].alias("size_bytes"),
        F.size(body["columns"]).alias("n_columns"),
        body["notes"].alias("notes"),
        F.size(F.json_object_keys("text")).alias("n_members"),
    )


@query(
    "sink_converted",
    with_(ASSETS, CONVERTED) + "SELECT converted_key, after FROM full_converted",
)
def sink_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "converted")
    rows = converted(spark, sf_dir)
    sinks.write_converted(rows, root, one_file_each=False)
    return spark.read.parquet(f"{root}/migrated-notebooks").select("converted_key", "after")


OVERVIEW = ANALYSIS + f"""SELECT path, split_part(path, '/', -1) AS name,
  coalesce(owner, '') AS owner, complexity, risk, issues, suggestions, size_kb,
  {PCT} AS confidence_pct, {LABEL} AS confidence_label FROM analysis"""

OVERVIEW_SCHEMA = """path STRING, name STRING, owner STRING, complexity STRING, risk STRING,
    issues STRING, suggestions STRING, size_kb DOUBLE, confidence_pct INT, confidence_label STRING"""


@query(
    "sink_csv",
    OVERVIEW.replace("coalesce(owner, '') AS owner", "nullif(owner, '') AS owner")
    .replace("risk, issues,", "risk, nullif(issues, '') AS issues,")
    .replace(" suggestions,", " nullif(suggestions, '') AS suggestions,", 1),
)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    sinks.write_csv(overview(spark, sf_dir), path)
    rows = spark.read.schema(OVERVIEW_SCHEMA).option("header", True).option("escape", '"').csv(path)
    texts = ("owner", "issues", "suggestions")
    return rows.withColumns({name: F.nullif(F.col(name), F.lit("")) for name in texts})


@query("sink_json", OVERVIEW)
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "json")
    sinks.write_json(overview(spark, sf_dir), path)
    return spark.read.schema(OVERVIEW_SCHEMA).json(path)


# What a snapshot holds, row by row: the part, a name, its content, and the time.
SNAPSHOT = """SELECT 'assets' AS part, path AS name, md5(content) AS content FROM assets_v {assets}
    UNION ALL SELECT 'analyses', path, risk || '/' || complexity || '/' || issues FROM analysis {assets}
    UNION ALL SELECT 'tables', catalog || '.' || schema || '.' || name, 
      coalesce(size_bytes, 0)::VARCHAR FROM tables_v {tables}
    UNION ALL SELECT 'jobs', coalesce(job_id::VARCHAR, ''),
      CASE WHEN ord % 2 = 0 THEN 'order ' || ord END FROM jobs_v
    UNION ALL SELECT 'clusters', cluster_id, num_workers::VARCHAR FROM clusters_v"""
SNAPSHOT_SCHEMAS = {
    "assets": "path STRING, content STRING, generated_at STRING",
    "analyses": "path STRING, risk STRING, complexity STRING, issues ARRAY<STRING>, generated_at STRING",
    "tables": "catalog STRING, schema STRING, name STRING, size_bytes BIGINT, generated_at STRING",
    "jobs": "job_id BIGINT, settings STRING, generated_at STRING",
    "clusters": "cluster_id STRING, num_workers INT, generated_at STRING",
}
SNAPSHOT_ROWS = {
    "assets": ("path", "md5(cast(content AS BINARY))"),
    "analyses": ("path", "concat_ws('/', risk, complexity, array_join(issues, ', '))"),
    "tables": ("concat_ws('.', catalog, schema, name)", "cast(coalesce(size_bytes, 0) AS STRING)"),
    "jobs": ("coalesce(cast(job_id AS STRING), '')", "get_json_object(settings, '$.name')"),
    "clusters": ("cluster_id", "cast(num_workers AS STRING)"),
}


def snapshot_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a written snapshot, read from its files."""
    found = [
        spark.read.schema(SNAPSHOT_SCHEMAS[part])
        .json(f"{root}/{part}")
        .selectExpr(f"'{part}' AS part", f"{name} AS name", f"{content} AS content", "generated_at")
        for part, (name, content) in SNAPSHOT_ROWS.items()
    ]
    return reduce(DataFrame.unionByName, found)


def snapshot_sql(assets: str = "", tables: str = "") -> str:
    rows = SNAPSHOT.format(assets=assets, tables=tables)
    return with_(ASSETS, SCAN, TABLES, JOBS, views.CLUSTERS) + (
        f"SELECT *, '{views.AS_OF_TEXT}' AS generated_at FROM ({rows})"
    )


@query("sink_inventory", snapshot_sql())
def sink_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from workload.q_scan import analysis

    root = scratch_dir(spark, "inventory")
    parts = {
        "assets": views.assets(spark, sf_dir),
        "analyses": analysis(spark, sf_dir),
        "tables": views.tables(spark, sf_dir),
        "jobs": views.jobs(spark, sf_dir),
        "clusters": views.clusters(spark, sf_dir),
    }
    sinks.write_inventory(parts, root, views.AS_OF_TEXT)
    return snapshot_rows(spark, root)


@query(
    "sink_conv_report",
    with_(ASSETS, CONVERTED, DIFF)
    + """, w AS (SELECT path, md5(string_agg(op || line, chr(10) ORDER BY seq)) AS diffs_md5,
      md5(string_agg(line, chr(10) ORDER BY seq) FILTER (op <> '+')) AS before_md5,
      md5(string_agg(line, chr(10) ORDER BY seq) FILTER (op <> '-')) AS after_md5 FROM diff GROUP BY path)
    SELECT path, converted_key, true AS uploaded, before_md5, after_md5, diffs_md5, content_lines + 0 AS n_before,
      content_lines + header_lines AS n_after, content_lines + changed + header_lines AS n_ops
    FROM (SELECT path, converted_key,
      length(before) - length(replace(before, chr(10), '')) AS content_lines,
      length(after) - length(replace(after, chr(10), '')) -
        (length(body) - length(replace(body, chr(10), ''))) AS header_lines,
      CAST(regexp_matches(before, 'dbutils\\.fs') AS INT) + CAST(contains(before, 'display(df)') AS INT)
        + CAST(contains(before, '/dbfs/t') AS INT) AS changed FROM full_converted) JOIN w USING (path)""",
)
def sink_conv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "report")
    rows = converted(spark, sf_dir).withColumn("uploaded", F.lit(True))
    sinks.write_conversion_report(rows, path)
    schema = """path STRING, converted_key STRING, uploaded BOOLEAN, before_lines ARRAY<STRING>,
        after_lines ARRAY<STRING>, diffs ARRAY<STRUCT<op: STRING, line: STRING>>"""
    report = spark.read.schema(schema).json(path)
    return report.select(
        "path",
        "converted_key",
        "uploaded",
        F.size("before_lines").cast("long").alias("n_before"),
        F.size("after_lines").cast("long").alias("n_after"),
        F.size("diffs").cast("long").alias("n_ops"),
        F.md5(F.array_join("before_lines", "\n")).alias("before_md5"),
        F.md5(F.array_join("after_lines", "\n")).alias("after_md5"),
        F.md5(F.array_join(F.transform("diffs", lambda d: F.concat(d["op"], d["line"])), "\n")).alias("diffs_md5"),
    )


# Whole jobs ------------------------------------------------------------------------------------


@query(
    "job_migrate",
    f"""SELECT 'lake.given.' || name AS fq_name, n_rows, true AS ok, n_rows AS n_read, key_sum,
      true AS described FROM ({counts_sql()})
    UNION ALL SELECT 'lake.given.absent', NULL, false, NULL, NULL, true
    UNION ALL SELECT 'lake.given.gone', NULL, false, NULL, NULL, true""",
)
def job_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables, and two whose files do not exist; copies and sidecars are read back.

    What the move failed to write is not read: its row tells, and the others are as they are."""
    tables = given_tables(spark, sf_dir)
    without = tables.where("name IN ('region', 'nation')").withColumns(
        {
            "name": F.when(F.col("name") == "region", "absent").otherwise("gone"),
            "storage_location": F.lit(f"{sf_dir}/absent.parquet"),
        }
    )
    root = scratch_dir(spark, "migrated")
    status = views.kept(migration.migrate_tables(spark, tables.unionByName(without), root), "moved")
    table_name = F.element_at(F.split("fq_name", "\\."), -1).alias("name")
    moved = [row["name"] for row in status.where("ok").select(table_name).collect()]
    read = contents(spark, f"{root}/migrated-tables/lake/given", names=moved).select(
        F.concat(F.lit("lake.given."), "name").alias("fq_name"),
        F.col("n_rows").alias("n_read"),
        "key_sum",
    )
    file = F.when(F.col("ok"), sinks.HIDDEN_SIDECAR).otherwise(sinks.SIDECAR)
    status = status.withColumn("key", F.concat_ws("/", "dest_key", file))
    written = status.where("sidecar_ok")
    sidecars = views.kept(objects.get_texts(written, root), "texts").select(
        "key", F.concat(F.lit("lake.given."), F.get_json_object("text", "$.name")).alias("described")
    )
    joined = status.join(read, "fq_name", "left").join(sidecars, "key", "left")
    described = F.coalesce(F.col("described") == F.col("fq_name"), F.lit(False))
    return joined.select("fq_name", "n_rows", "ok", "n_read", "key_sum", described.alias("described"))


@query(
    "job_analyze",
    snapshot_sql(
        f"WHERE NOT {BAD_BODY}",
        "WHERE data_source_format = '' OR upper(data_source_format) = 'DELTA'",
    ),
)
def job_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = export.export_dir(spark, sf_dir, "assets", "bodies", "tables", "jobs", "clusters")
    out = scratch_dir(spark, "snapshot")
    plan.run_full(spark, root, out, views.AS_OF_TEXT)
    return snapshot_rows(spark, out)


@query("job_overview", OVERVIEW)
def job_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(spark, sf_dir)


REPORT_PCT, REPORT_LABEL = confidence_sql("complexity", "coalesce(n_issues, 0)", "size_kb")
REPORT_BASE = """rows_v AS (
SELECT ord, path, split_part(path, '/', -1) AS name, language,
  coalesce(nullif(owner, ''), CASE WHEN split_part(trim(path, '/'), '/', 1) = 'Users'
    THEN split_part(trim(path, '/'), '/', 2) ELSE split_part(trim(path, '/'), '/', 1) END) AS owner,
  CASE WHEN ord % 3 = 0 THEN replace(replace(modified_at, 'T', ' '), 'Z', '') ELSE '' END
    AS last_modified,
  round_even(size / 1024::DOUBLE, 2) AS size_kb,
  CAST(length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS lines
FROM assets_v)"""


@query(
    "job_report",
    with_(ASSETS, REPORT_BASE, LAST)
    + f"""SELECT path, name, language, owner, last_modified, size_kb, lines,
      coalesce(risk, 'unknown') AS risk, 'Not enabled' AS status,
      {REPORT_PCT} AS confidence_pct, {REPORT_LABEL} AS confidence_label
    FROM rows_v LEFT JOIN last_run USING (ord)""",
)
def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asset_report(views.assets(spark, sf_dir), analyses(spark, sf_dir))


@query(
    "job_report_inline",
    with_(ASSETS, SCAN, REPORT_BASE)
    + f"""SELECT path, name, language, owner, last_modified, size_kb, lines, risk,
      'Not enabled' AS status, {REPORT_PCT} AS confidence_pct, {REPORT_LABEL} AS confidence_label
    FROM rows_v JOIN (SELECT ord, risk, complexity, n_issues FROM analysis) USING (ord)""",
)
def job_report_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asset_report_inline(views.assets(spark, sf_dir))


@query(
    "job_errors",
    with_(ASSETS, CONVERTED)
    + f"""SELECT path, CASE WHEN NOT {UNREADABLE} THEN converted_key END AS converted_key,
      CASE WHEN {UNREADABLE} THEN NULL WHEN ord % 13 <> 0 AND ord % 19 = 0 THEN '' ELSE body END AS body,
      CASE WHEN {UNREADABLE} THEN 'source is not base64-encoded UTF-8 text' END AS error
    FROM converted JOIN (SELECT path, ord, content FROM assets_v) USING (path)""",
)
def job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversion.convert_with_errors(export.body_rows(spark, sf_dir), BUCKET)
    return rows.select("path", "converted_key", "body", "error")


@query(
    "job_validate",
    """SELECT name, n_rows AS source_rows, n_rows + CASE WHEN name = 'events' THEN -1 ELSE 0 END
      AS copy_rows, name <> 'events' AS count_ok, name <> 'customer' AS schema_ok,
      name NOT IN ('events', 'customer', 'orders') AS content_ok
    FROM (SELECT 'lineitem' AS name, count(*) AS n_rows FROM lineitem
      UNION ALL SELECT 'documents', count(*) FROM documents
      UNION ALL SELECT 'events', count(*) FROM events
      UNION ALL SELECT 'customer', count(*) FROM customer
      UNION ALL SELECT 'orders', count(*) FROM orders)""",
)
def job_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole copies, one that lost a row, one of other types, one with changed values."""
    root = scratch_dir(spark, "validated")
    checks = []
    for name in ("lineitem", "documents", "events", "customer", "orders"):
        source = views.table(spark, sf_dir, name)
        copy = source
        if name == "events":
            copy = source.where("event_id <> 0")
        if name == "customer":
            copy = source.withColumn("c_nationkey", F.col("c_nationkey").cast("double") + 0.5)
        if name == "orders":
            copy = source.withColumn("o_totalprice", F.col("o_totalprice") + 0.01)
        copy.write.parquet(f"{root}/{name}")
        check = migration.validate_export(source, read_table(spark, None, f"{root}/{name}"))
        checks.append(check.select(F.lit(name).alias("name"), "*"))
    result = checks[0]
    for other in checks[1:]:
        result = result.unionByName(other)
    return result


@query(
    "job_quick",
    with_(ASSETS) + f"SELECT 'assets' AS part, count(*) AS n FROM assets_v WHERE NOT {BAD_BODY}",
)
def job_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.run_quick(spark, export.export_dir(spark, sf_dir, "assets", "bodies"))


@query(
    "job_tables",
    with_(TABLES)
    + """SELECT name, catalog, schema, data_source_format AS format,
      coalesce(storage_location, '') AS location,
      round_even(coalesce(size_bytes, 0) / 1048576::DOUBLE, 2) AS size_mb,
      coalesce(size_bytes, 0)::BIGINT AS size_bytes, coalesce(n_cols, 0) AS n_columns
    FROM tables_v""",
)
def job_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.table_report(views.tables(spark, sf_dir))


@query(
    "job_jobs",
    with_(JOBS)
    + f"""SELECT CASE WHEN any_id <> 0 THEN any_id END AS job_id, name, type, run_as, {TRIGGER}
    FROM jobs_v""",
)
def job_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.job_report(views.jobs(spark, sf_dir))
