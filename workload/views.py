"""Inventory views over the given tables, once as DataFrames and once as SQL.

The given tables hold no workspace, so each part of one is derived from a table, row by row:
assets from documents, tables from part, jobs from orders, clusters from events, replies from
conversations.  Every row of the base table is used, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.session import scratch_dir

AS_OF = 1706659200  # 2024-01-31T00:00:00Z
AS_OF_TEXT = "2024-01-31T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the scratch folder: what tasks read from single files is read once."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows that stand for much work, dealt out over all tasks: a small file gives one task or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def case(selector: str, **cases: str) -> Column:
    """CASE over a small integer, keys are n0, n1, .."""
    whens = " ".join(f"WHEN {key[1:]} THEN {value}" for key, value in cases.items())
    return F.expr(f"CASE {selector} {whens} END")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    blank = "CASE WHEN doc_id % 50 = 0 THEN 60 WHEN doc_id % 10 = 1 THEN 12 ELSE 1 END"
    pad = F.expr(f"repeat('\\n', {blank})")
    markers = [
        (7, 'files = dbutils.fs.ls("dbfs:/raw")\n'),
        (5, "display(df)\n"),
        (11, "%sql\n"),
        (3, 'df = spark.read.format("delta").load("/dbfs/t")\n'),
    ]
    hits = [
        F.when(F.col("doc_id") % n == 0, F.lit(line)).otherwise(F.lit("")) for n, line in markers
    ]
    root = F.expr(
        "CASE WHEN doc_id % 10 < 6 THEN '/Users/' WHEN doc_id % 10 < 8 THEN '/Shared/' ELSE '/' END"
    )
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    millis = (F.lit(1704067200000) + F.col("doc_id") * 60000).cast("string")
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.concat(root, "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        case("doc_id % 4", n0="'PYTHON'", n1="'SQL'", n2="'SCALA'", n3="'R'").alias("language"),
        F.concat("text", pad, *hits).alias("content"),
        F.col("doc_id").alias("object_id"),
        F.when(F.col("doc_id") % 5 == 0, millis)
        .when(F.col("doc_id") % 5 == 1, iso)
        .when(F.col("doc_id") % 5 == 2, (F.col("doc_id") * 1000 + 1).cast("string"))
        .when(F.col("doc_id") % 5 == 3, F.lit("garbage"))
        .alias("created_at"),
        F.when(F.col("doc_id") % 3 == 0, iso)
        .when(F.col("doc_id") % 3 == 1, F.lit(""))
        .alias("modified_at"),
        F.when(F.col("doc_id") % 6 == 1, millis).alias("last_modified"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("owner_"), "lang"))
        .when(F.col("doc_id") % 3 == 1, F.lit(""))
        .alias("owner"),
    ).withColumn("size", F.length("content").cast("long"))


ASSETS = """assets_b AS (
SELECT doc_id AS ord,
  CASE WHEN doc_id % 10 < 6 THEN '/Users/' WHEN doc_id % 10 < 8 THEN '/Shared/' ELSE '/' END
    || source || '/' || doc_id AS path,
  CASE doc_id % 4 WHEN 0 THEN 'PYTHON' WHEN 1 THEN 'SQL' WHEN 2 THEN 'SCALA' ELSE 'R' END
    AS language,
  text || repeat(chr(10), CASE WHEN doc_id % 50 = 0 THEN 60 WHEN doc_id % 10 = 1 THEN 12 ELSE 1 END)
    || CASE WHEN doc_id % 7 = 0 THEN 'files = dbutils.fs.ls("dbfs:/raw")' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN 'display(df)' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN '%sql' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 3 = 0
       THEN 'df = spark.read.format("delta").load("/dbfs/t")' || chr(10) ELSE '' END AS content,
  doc_id AS object_id,
  strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CAST(1704067200000 + doc_id * 60000 AS VARCHAR) AS millis,
  lang
FROM documents),
assets_v AS (
SELECT ord, path, language, content, object_id,
  CASE ord % 5 WHEN 0 THEN millis WHEN 1 THEN iso WHEN 2 THEN CAST(ord * 1000 + 1 AS VARCHAR)
    WHEN 3 THEN 'garbage' END AS created_at,
  CASE ord % 3 WHEN 0 THEN iso WHEN 1 THEN '' END AS modified_at,
  CASE WHEN ord % 6 = 1 THEN millis END AS last_modified,
  CASE ord % 3 WHEN 0 THEN 'owner_' || lang WHEN 1 THEN '' END AS owner,
  length(content) AS size
FROM assets_b)"""

# Times as the listing reader and the alias operators give them.
TIMES = """times AS (
SELECT *,
  coalesce(nullif(modified_at, ''), nullif(last_modified, ''), nullif(created_at, ''))
    AS modified_raw,
  created_at AS created_raw
FROM assets_v)"""


def iso_sql(col: str, threshold: str = "1000000000") -> str:
    """SQL for the normalised time of the values the asset view has."""
    ms = f"CASE WHEN CAST({col} AS BIGINT) > {threshold} THEN CAST({col} AS BIGINT)"
    ms += f" ELSE CAST({col} AS BIGINT) * 1000 END"
    return (
        f"CASE WHEN regexp_matches({col}, '^[0-9]+$') THEN "
        f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE {col} END"
    )


SCAN = r"""scan_h AS (
SELECT *,
  regexp_matches(content, '\bdbutils\b') AS h_dbutils,
  regexp_matches(content, '\bdisplay\b') AS h_display,
  regexp_matches(content, '\bdisplayHTML\b') AS h_html,
  regexp_matches(content, '(?m)^%sql') AS h_sql,
  regexp_matches(content, '\bspark\.(read|sql|createDataFrame)\b') AS h_spark,
  regexp_matches(content, '\bdelta\.tables\b|\bDeltaTable\b') AS h_delta,
  regexp_replace(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS norm
FROM assets_v),
scan_l AS (
SELECT *, CAST(length(norm) - length(replace(norm, chr(10), ''))
    + CASE WHEN norm = '' OR right(norm, 1) = chr(10) THEN 0 ELSE 1 END AS INTEGER) AS loc
FROM scan_h),
scan AS (
SELECT *,
  CASE WHEN loc < 100 THEN 'simple' WHEN loc < 500 THEN 'medium' ELSE 'complex' END AS complexity,
  concat_ws('|', CASE WHEN h_dbutils THEN 'dbutils' END, CASE WHEN h_display THEN 'display' END,
    CASE WHEN h_html THEN 'displayHTML' END, CASE WHEN h_sql THEN 'sql_cell_magic' END,
    CASE WHEN h_spark THEN 'pyspark' END, CASE WHEN h_delta THEN 'delta' END) AS detected,
  h_dbutils::INT + h_display::INT + h_html::INT + h_sql::INT + h_spark::INT + h_delta::INT AS n_hits,
  CASE WHEN h_dbutils THEN 'Uses dbutils - these utilities are Databricks-specific.' ELSE '' END
    AS issues,
  CASE WHEN h_dbutils THEN 1 ELSE 0 END AS n_issues,
  concat_ws(', ',
    CASE WHEN h_dbutils THEN 'Replace dbutils calls with boto3 or AWS equivalents.' END,
    CASE WHEN h_display
      THEN 'Uses display() - consider rendering in alternative AWS tooling.' END) AS suggestions
FROM scan_l),
analysis AS (
SELECT *,
  CASE WHEN complexity = 'complex' OR n_issues > 0 THEN 'red' WHEN complexity = 'medium'
    THEN 'yellow' ELSE 'green' END AS risk,
  CASE WHEN n_hits > 0 THEN 'Detected ' || n_hits || ' Databricks-specific patterns. Complexity: '
    || complexity || '.'
    ELSE 'Complexity: ' || complexity || '. No obvious Databricks-specific patterns detected.' END
    AS summary,
  round_even(size / 1024::DOUBLE, 2) AS size_kb
FROM scan)"""


def confidence_sql(complexity: str, n_issues: str, size_kb: str) -> tuple[str, str]:
    pct = f"""CAST(round_even(greatest(0.0, least(1.0,
      (CASE {complexity} WHEN 'simple' THEN 1.0 WHEN 'moderate' THEN 0.6 WHEN 'complex' THEN 0.3
        ELSE 0.5 END)::DOUBLE
      * (1 - least({n_issues} * 0.15::DOUBLE, 0.9::DOUBLE))
      * (CASE WHEN {size_kb} <= 100 THEN 1.0 WHEN {size_kb} <= 500 THEN 0.9
        WHEN {size_kb} <= 2000 THEN 0.7 ELSE 0.5 END)::DOUBLE)) * 100, 0) AS INTEGER)"""
    label = f"CASE WHEN {pct} >= 80 THEN 'High' WHEN {pct} >= 50 THEN 'Medium' ELSE 'Low' END"
    return pct, label


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    columns = F.expr("""transform(sequence(1, cast(p_partkey % 60 as int) + 1), i -> named_struct(
        'name', concat('c', i),
        'type', CASE WHEN p_partkey % 7 = 0 AND i = 1 THEN ''
            WHEN i % 3 = 0 THEN 'bigint' WHEN i % 3 = 1 THEN 'string' ELSE 'decimal(10,2)' END,
        'nullable', i % 2 = 0))""")
    return part.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("cat_"), (F.col("p_size") % 5).cast("string")).alias("catalog"),
        F.col("p_brand").alias("schema"),
        case("p_partkey % 3", n0="'MANAGED'", n1="'EXTERNAL'").alias("table_type"),
        case("p_partkey % 4", n0="'DELTA'", n1="'delta'", n2="'PARQUET'", n3="''").alias(
            "data_source_format"
        ),
        F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("/data/"), "p_type")).alias(
            "storage_location"
        ),
        F.when(F.col("p_partkey") % 9 != 0, columns).alias("columns"),
        F.when(
            F.col("p_partkey") % 17 != 0,
            F.floor(F.col("p_retailprice") * 100).cast("long") * 10000,
        ).alias("size_bytes"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit("2024-01-15T12:00:00Z").alias("updated_at"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("admin")).alias("owner"),
        F.col("p_name").alias("comment"),
    )


TABLES = """tables_v AS (
SELECT p_partkey AS ord, 't' || p_partkey AS name, 'cat_' || (p_size % 5) AS catalog,
  p_brand AS schema,
  CASE p_partkey % 3 WHEN 0 THEN 'MANAGED' WHEN 1 THEN 'EXTERNAL' END AS table_type,
  CASE p_partkey % 4 WHEN 0 THEN 'DELTA' WHEN 1 THEN 'delta' WHEN 2 THEN 'PARQUET' ELSE '' END
    AS data_source_format,
  CASE WHEN p_partkey % 6 <> 0 THEN '/data/' || p_type END AS storage_location,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 60 + 1 AS INTEGER) END AS n_cols,
  p_partkey % 7 = 0 AS first_untyped,
  CASE WHEN p_partkey % 17 <> 0
    THEN CAST(floor(p_retailprice * 100) AS BIGINT) * 10000 END AS size_bytes,
  '2024-01-01T00:00:00Z' AS created_at, '2024-01-15T12:00:00Z' AS updated_at,
  CASE WHEN p_partkey % 2 = 0 THEN 'admin' END AS owner, p_name AS comment
FROM part)"""

# The column list of a table as text, name:type:nullable, for the first n columns.
COLUMNS_TEXT = """list_aggregate(list_transform(range(1, {n} + 1), lambda i: 'c' || i || ':'
  || CASE WHEN first_untyped AND i = 1 THEN '' WHEN i % 3 = 0 THEN 'bigint'
     WHEN i % 3 = 1 THEN 'string' ELSE 'decimal(10,2)' END
  || ':' || CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END), 'string_agg', '|')"""


def columns_text(col: str = "columns") -> Column:
    entry = "concat(c.name, ':', c.type, ':', cast(c.nullable as string))"
    return F.expr(f"array_join(transform({col}, c -> {entry}), '|')")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    spans = events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    user = F.col("user_id")
    start = F.unix_millis(F.col("a").cast("timestamp"))
    end = F.unix_millis(F.col("b").cast("timestamp"))
    return spans.select(
        user.alias("ord"),
        F.concat(F.lit("u"), user.cast("string")).alias("cluster_id"),
        (user % 5).cast("int").alias("num_workers"),
        F.when(user % 2 == 0, F.struct(F.lit(3).alias("min_workers"))).alias("autoscale"),
        case("user_id % 4", n0="'m5.2xlarge'", n1="''").alias("driver_node_type_id"),
        case(
            "user_id % 5", n0="'i3.large'", n1="'i3.xlarge'", n2="'i3.2xlarge'", n3="'m5.metal'"
        ).alias("node_type_id"),
        F.when(user % 7 == 0, F.lit(None))
        .when(user % 5 == 1, F.floor(start / 1000))
        .otherwise(start)
        .cast("long")
        .alias("start_time"),
        F.lit(None).cast("long").alias("created_time"),
        F.when(user % 3 != 0, end).alias("terminated_time"),
        F.lit(None).cast("long").alias("end_time"),
    )


CLUSTERS = """clusters_b AS (
SELECT user_id AS ord, epoch_us(min(ts)) // 1000 AS a, epoch_us(max(ts)) // 1000 AS b
FROM events GROUP BY user_id),
clusters_v AS (
SELECT ord, 'u' || ord AS cluster_id, CAST(ord % 5 AS INTEGER) AS num_workers,
  CASE WHEN ord % 2 = 0 THEN 3 END AS min_workers,
  CASE ord % 4 WHEN 0 THEN 'm5.2xlarge' WHEN 1 THEN '' END AS driver_node_type_id,
  CASE ord % 5 WHEN 0 THEN 'i3.large' WHEN 1 THEN 'i3.xlarge' WHEN 2 THEN 'i3.2xlarge'
    WHEN 3 THEN 'm5.metal' END AS node_type_id,
  CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 5 = 1 THEN a // 1000 ELSE a END AS start_time,
  CASE WHEN ord % 3 <> 0 THEN b END AS terminated_time
FROM clusters_b)"""

UNITS = "CASE WHEN {0} LIKE '%xlarge%' THEN 4 WHEN {0} LIKE '%large%' THEN 8 ELSE 4 END"

COSTS = f"""costs_b AS (
SELECT *, coalesce(nullif(driver_node_type_id, ''), node_type_id) AS driver_type,
  greatest(coalesce(nullif(num_workers, 0), min_workers, 0), 0) AS workers,
  CASE WHEN start_time > 1000000000000 THEN start_time / 1000.0::DOUBLE
    ELSE start_time::DOUBLE END AS start_s,
  terminated_time / 1000.0::DOUBLE AS end_s
FROM clusters_v),
costs_h AS (
SELECT *, greatest(0.0::DOUBLE, CASE WHEN start_s IS NULL THEN 24.0 * 30 * 0.25
  ELSE (coalesce(end_s, {AS_OF}::DOUBLE) - greatest(start_s, {AS_OF - 30 * 86400}::DOUBLE)) / 3600.0
  END::DOUBLE) AS hours
FROM costs_b),
costs AS (
SELECT *, ({UNITS.format("driver_type")} + workers * ({UNITS.format("node_type_id")})) * hours
  AS dbu_hours
FROM costs_h)"""

# Totals of both sides, with storage at the default price.
TOTALS = """totals AS (
SELECT sum(dbu_hours) AS hours, sum(dbu_hours) * 0.4::DOUBLE AS source_compute,
  sum(dbu_hours) * 0.052624::DOUBLE + sum(dbu_hours) * 2 * 0.0057785::DOUBLE AS target_compute,
  (SELECT sum(coalesce(size_bytes, 0))::BIGINT / 1073741824.0::DOUBLE * 0.023::DOUBLE
   FROM tables_v) AS storage
FROM costs)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their raw settings as JSON text."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    key = F.col("o_orderkey")
    hour = (F.col("o_custkey") % 24).cast("string")
    member = [
        F.when(key % 2 == 0, F.concat(F.lit('"name": "order '), key.cast("string"), F.lit('"'))),
        case(
            "o_orderkey % 6",
            n0="""'"notebook_task": {"path": "/a"}'""",
            n1="""'"spark_jar_task": {"main": "x"}'""",
            n2="""'"spark_python_task": {"file": "f"}'""",
            n3="""'"spark_submit_task": {"parameters": []}'""",
            n4="""'"dbt_task": {"commands": ["run"]}'""",
        ),
        F.when(
            key % 4 == 0,
            F.concat(
                F.lit('"schedule": {"quartz_cron_expression": "0 0 '), hour, F.lit(' * * ?"}')
            ),
        ).when(
            key % 8 == 1, F.concat(F.lit('"schedule": {"cron": "0 '), hour, F.lit(' * * *"}'))
        ),
        F.when(key % 12 == 2, F.lit('"File_Arrival_Notification": {"url": "s3://in"}')),
        F.when(key % 3 == 0, F.lit('"email_notifications": null')),
        F.when(key % 5 == 0, F.concat(F.lit('"run_as_user": "user'), hour, F.lit('"'))).when(
            key % 5 == 1, F.lit('"run_as": {"service": "svc"}')
        ),
    ]
    settings = F.concat(F.lit("{"), F.concat_ws(", ", *member), F.lit("}"))
    return orders.select(
        key.alias("ord"),
        F.when(key % 10 != 9, key).alias("job_id"),
        F.when(key % 10 == 9, key + 7).alias("id"),
        F.when(key % 2 == 1, F.when(key % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")))
        .alias("name"),
        settings.alias("settings"),
        (F.col("o_orderstatus") == "P").alias("is_paused"),
        F.when(key % 5 == 2, F.lit("creator")).when(key % 5 == 3, F.lit("")).alias(
            "creator_user_name"
        ),
        F.when(key % 5 >= 2, F.lit("maker")).alias("created_by"),
    )


JOBS = """jobs_v AS (
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey END AS job_id,
  CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey ELSE o_orderkey + 7 END AS any_id,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey
    WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END,
    'job_' || CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey::VARCHAR ELSE 'None' END) AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN '0 0 ' || (o_custkey % 24) || ' * * ?'
    WHEN o_orderkey % 8 = 1 THEN '0 ' || (o_custkey % 24) || ' * * *' END AS schedule,
  o_orderkey % 12 = 2 AS on_file,
  o_orderkey % 3 = 0 AND o_orderstatus = 'P' AS paused,
  CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 6 = 5 AND o_orderkey % 8 <> 1
      AND o_orderkey % 5 > 1 THEN 'unknown'
    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'notebook' WHEN 1 THEN 'jar' WHEN 2 THEN 'python'
      WHEN 3 THEN 'spark-submit' WHEN 4 THEN 'dbt' ELSE 'other' END END AS type,
  CASE o_orderkey % 5 WHEN 0 THEN 'user' || (o_custkey % 24) WHEN 1 THEN '{"service":"svc"}'
    WHEN 2 THEN 'creator' ELSE 'maker' END AS run_as
FROM orders)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model replies of four shapes: full, alias keys, nested text, not JSON."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    full = F.to_json(
        F.struct(
            (F.col("turn") + 1).alias("complexity_score"),
            F.lit("high").alias("risk_assessment"),
            F.array("role", F.lit("b")).alias("migration_challenges"),
            F.array(F.lit("f")).alias("databricks_specific_features"),
            F.lit(12.5).alias("estimated_effort_hours"),
            F.col("text").alias("note"),
        )
    )
    alias = F.to_json(
        F.struct(
            F.struct(
                F.lit("7").alias("complexity"),
                F.col("role").alias("risk"),
                F.lit(2).alias("effort_hours"),
                F.col("text").alias("note"),
            ).alias("output")
        )
    )
    nested = F.to_json(
        F.struct(
            F.to_json(
                F.struct(
                    F.lit(0).alias("complexity_score"),
                    F.lit("").alias("risk"),
                    F.array(F.col("role")).alias("challenges"),
                    F.col("text").alias("note"),
                )
            ).alias("body")
        )
    )
    broken = F.concat(F.lit("no json: "), "text")
    kind = F.col("conv_id") % 4
    raw = F.when(kind == 0, full).when(kind == 1, alias).when(kind == 2, nested).otherwise(broken)
    return talk.select("conv_id", "turn", "role", raw.alias("raw"))


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
