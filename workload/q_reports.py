"""Filter, join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.operators import aggregates, cost, filters, joins
from transhume.plans import reports
from workload import listings as export
from workload import views
from workload.q_fields import FQ_TEXT, OWNER
from workload.q_scan import ANALYSIS, analysis
from workload.registry import query
from workload.views import (
    ASSETS,
    CLUSTERS,
    COLUMNS_TEXT,
    COSTS,
    JOBS,
    TABLES,
    with_,
)


@query(
    "flt_facets",
    ANALYSIS
    + "SELECT path, language, risk FROM analysis WHERE language = 'PYTHON' AND risk = 'red'",
)
def flt_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis(spark, sf_dir).select("path", "language", "risk", "complexity")
    found = filters.facet_filter(rows, language="PYTHON", risk="red", complexity="All")
    return found.drop("complexity")


@query(
    "flt_search",
    with_(ASSETS)
    + f"""SELECT path, owner FROM (SELECT path, split_part(path, '/', -1) AS name, {OWNER} AS owner
      FROM assets_v) WHERE contains(lower(path), 'rc1') OR contains(lower(name), 'rc1')
      OR contains(lower(owner), 'rc1')""",
)
def flt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.report_fields(views.assets(spark, sf_dir)).select("path", "name", "owner")
    return filters.search(rows, "RC1").select("path", "owner")


@query(
    "flt_cascade",
    with_(TABLES)
    + "SELECT name, catalog, schema FROM tables_v WHERE catalog = 'cat_2' AND schema = 'Brand#4'",
)
def flt_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tables(spark, sf_dir).select("name", "catalog", "schema")
    return filters.cascade_filter(rows, "cat_2", "Brand#4")


@query(
    "flt_format",
    with_(TABLES)
    + """SELECT name, data_source_format FROM tables_v
    WHERE data_source_format = '' OR upper(data_source_format) = 'DELTA'""",
)
def flt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.format_filter(views.tables(spark, sf_dir)).select("name", "data_source_format")


@query(
    "flt_content",
    with_(ASSETS) + "SELECT path, content FROM assets_v WHERE ord % 4 <> 3",
)
def flt_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    emptied = F.when(F.col("ord") % 8 == 3, F.lit("")).when(F.col("ord") % 4 != 3, F.col("content"))
    rows = views.assets(spark, sf_dir).withColumn("content", emptied)
    return filters.non_empty(rows).select("path", "content")


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cluster_cost(views.clusters(spark, sf_dir), views.AS_OF, 0.4, keep=["ord"])


@query(
    "flt_high_usage",
    with_(CLUSTERS, COSTS)
    + """SELECT cluster_id, round(dbu_hours, 6) AS dbu_hours
    FROM (SELECT * FROM costs ORDER BY ord LIMIT 5) WHERE dbu_hours > 1000""",
)
def flt_high_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.high_usage(costs(spark, sf_dir))
    return rows.select("cluster_id", F.round("dbu_hours", 6).alias("dbu_hours"))


# Joins -----------------------------------------------------------------------------------------


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses of the labelled documents, two runs each; the second run is the last."""
    labels = views.table(spark, sf_dir, "labels")
    paths = views.assets(spark, sf_dir).select(F.col("ord").alias("doc_id"), "path")
    runs = F.inline(
        F.array(
            F.struct(F.lit(0).alias("run"), F.lit("green").alias("risk")),
            F.struct(
                F.lit(1).alias("run"),
                F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 0, "yellow")
                .otherwise("green").alias("risk"),
            ),
        )
    )
    rows = labels.join(paths, "doc_id").select("doc_id", "path", "quality", "toxic", runs)
    return rows.select(
        "path",
        (F.col("doc_id") * 2 + F.col("run")).alias("ord"),
        "risk",
        F.when(F.col("quality") == 1, "simple").otherwise("complex").alias("complexity"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(
            F.array().cast("array<string>")
        ).alias("issues"),
    )


LAST = """last_run AS (
SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'red' WHEN quality = 0 THEN 'yellow' ELSE 'green' END
  AS risk, CASE WHEN quality = 1 THEN 'simple' ELSE 'complex' END AS complexity,
  CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_issues FROM labels)"""


@query(
    "join_analysis",
    with_(ASSETS, LAST)
    + """SELECT path, language, coalesce(risk, 'unknown') AS risk, complexity
    FROM assets_v LEFT JOIN last_run USING (ord)""",
)
def join_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir).select("path", "language")
    return joins.with_analysis(rows, analyses(spark, sf_dir)).select(
        "path", "language", "risk", "complexity"
    )


# Selected names: one per table, of which a quarter matches; and each table occurs twice.
TWICE = """SELECT ord * 2 + k AS ord, catalog, schema, name, size_bytes + k AS size_bytes
  FROM tables_v, (VALUES (0), (1)) AS copies(k)"""


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tables(spark, sf_dir).select("ord", "catalog", "schema", "name", "size_bytes")
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select(
        (F.col("ord") * 2 + F.col("k")).alias("ord"),
        "catalog",
        "schema",
        "name",
        (F.col("size_bytes") + F.col("k")).alias("size_bytes"),
    )


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tables(spark, sf_dir).selectExpr(FQ_TEXT)


@query(
    "join_selection",
    with_(TABLES)
    + """SELECT catalog || '.' || schema || '.' || name AS fq_name, catalog, schema, name,
      ord * 2 AS ord, size_bytes FROM tables_v WHERE ord % 4 = 0""",
)
def join_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.resolve_tables(selected(spark, sf_dir), twice(spark, sf_dir)).select(
        "fq_name", "catalog", "schema", "name", "ord", "size_bytes"
    )


@query(
    "join_missing",
    with_(TABLES)
    + f"""SELECT DISTINCT fq_name FROM (SELECT ord, {FQ_TEXT} FROM tables_v)
    WHERE ord % 4 <> 0""",
)
def join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing_tables(selected(spark, sf_dir), twice(spark, sf_dir))


@query(
    "join_columns",
    with_(TABLES)
    + f"""SELECT name, CASE WHEN ord % 4 = 0 THEN 'x' || ord || ':int:true'
        WHEN n_cols IS NULL THEN NULL ELSE {COLUMNS_TEXT.format(n='n_cols')} END AS columns_text
    FROM tables_v""",
)
def join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = views.tables(spark, sf_dir).select("ord", "catalog", "schema", "name", "columns")
    entry = F.expr("named_struct('name', concat('x', ord), 'type', 'int', 'nullable', true)")
    empty = F.expr("filter(columns, c -> false)")
    detail = F.when(F.col("ord") % 4 == 0, F.array(entry)).when(F.col("ord") % 4 == 1, empty)
    details = tables.withColumn("columns", detail).drop("ord")
    rows = joins.with_columns_detail(tables, details)
    return rows.select("name", views.columns_text().alias("columns_text"))


@query(
    "join_body",
    with_(ASSETS)
    + f"""SELECT path, language, content, CAST(size AS INTEGER) AS size FROM assets_v
    WHERE NOT {export.BAD_BODY}""",
)
def join_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    from transhume.sources.listings import decode_content

    listed = views.assets(spark, sf_dir).select("path", "language")
    bodies = decode_content(export.body_rows(spark, sf_dir).select("path", "content"))
    return joins.with_body(listed, bodies).select("path", "language", "content", "size")


@query(
    "join_owner",
    with_(ASSETS)
    + """SELECT path, coalesce(nullif(owner, ''), CASE ord % 7 WHEN 0 THEN 'o' || ord
      WHEN 1 THEN 'm' || ord WHEN 2 THEN 'c' || ord WHEN 3 THEN 'b' || ord WHEN 4 THEN 'u' || ord
      END, '') AS owner FROM assets_v""",
)
def join_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir).select("ord", "path", "owner")

    def text(rest: int, letter: str) -> F.Column:
        found = F.concat(F.lit(letter), F.col("ord").cast("string"))
        return F.when(F.col("ord") % 7 == rest, found)

    status = rows.select(
        "path",
        F.coalesce(text(0, "o"), F.lit("")).alias("owner"),
        F.struct(
            text(1, "m").alias("owner"),
            text(2, "c").alias("created_by"),
            text(4, "u").alias("created_by_user"),
        ).alias("object_meta"),
        text(3, "b").alias("created_by"),
    )
    return joins.with_owner(rows.drop("ord"), status.where("owner <> 'none'"))


@query(
    "join_prices",
    with_(TABLES)
    + """SELECT name, (SELECT max(p_retailprice) FROM part WHERE p_brand = 'Brand#1') / 10000
        AS "Brand#1", 0.023::DOUBLE AS s3_standard_gb_month,
      round(coalesce(size_bytes, 0) / 1073741824::DOUBLE * 0.023, 6) AS monthly FROM tables_v""",
)
def join_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    prices = part.groupBy(F.col("p_brand").alias("key")).agg(
        (F.max("p_retailprice") / 10000).alias("value")
    )
    rows = views.tables(spark, sf_dir).select("name", "size_bytes")
    rows = joins.with_prices(rows, prices, {"Brand#1": 0.5, "s3_standard_gb_month": 0.023})
    gb = F.coalesce("size_bytes", F.lit(0)) / F.lit(1073741824.0)
    return rows.select(
        "name",
        "Brand#1",
        "s3_standard_gb_month",
        F.round(gb * F.col("s3_standard_gb_month"), 6).alias("monthly"),
    )


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(analysis(spark, sf_dir))


@query(
    "join_complement",
    ANALYSIS
    + """SELECT path, CASE WHEN complexity = 'simple' AND issues = '' THEN 'auto' ELSE 'review' END
      AS list FROM analysis""",
)
def join_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overview(spark, sf_dir)
    auto = joins.auto_list(rows).select("path", F.lit("auto").alias("list"))
    return auto.unionByName(joins.review_list(rows).select("path", F.lit("review").alias("list")))


# Aggregations ----------------------------------------------------------------------------------


@query(
    "agg_risk",
    ANALYSIS
    + """SELECT risk, sum(n)::BIGINT AS n FROM (
      SELECT risk, count(*) AS n FROM analysis GROUP BY risk
      UNION ALL SELECT unnest(['green', 'yellow', 'red']), 0) GROUP BY risk""",
)
def agg_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.risk_counts(analysis(spark, sf_dir))


@query(
    "agg_readiness",
    ANALYSIS
    + """SELECT count(*) FILTER (complexity = 'simple' AND n_issues = 0) AS n_auto,
      count(*) FILTER (NOT (complexity = 'simple' AND n_issues = 0)) AS n_review FROM analysis""",
)
def agg_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.readiness_counts(analysis(spark, sf_dir))


@query(
    "agg_storage_catalog",
    with_(TABLES)
    + """SELECT catalog, sum(coalesce(size_bytes, 0))::BIGINT AS size_bytes,
      round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE, 6) AS size_gb,
      round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE * 0.023, 6)
        AS monthly_storage_cost_usd FROM tables_v GROUP BY catalog""",
)
def agg_storage_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.storage_by_catalog(views.tables(spark, sf_dir))
    names = ("size_gb", "monthly_storage_cost_usd")
    return rows.withColumns({name: F.round(name, 6) for name in names})


@query(
    "agg_storage_total",
    with_(TABLES)
    + """SELECT round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE * 0.023, 4)
        AS total_monthly_usd,
      round(sum(coalesce(size_bytes, 0))::BIGINT / 1073741824::DOUBLE * 0.023 * 12, 4)
        AS total_annual_usd FROM tables_v""",
)
def agg_storage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.storage_totals(aggregates.storage_by_catalog(views.tables(spark, sf_dir)))
    return rows.select(*[F.round(name, 4).alias(name) for name in rows.columns])


@query(
    "agg_summary",
    """SELECT 'assets' AS part, count(*) AS n FROM documents
    UNION ALL SELECT 'tables', count(*) FROM part
    UNION ALL SELECT 'jobs', count(*) FROM orders
    UNION ALL SELECT 'clusters', count(DISTINCT user_id) FROM events""",
)
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary_counts(
        assets=views.assets(spark, sf_dir),
        tables=views.tables(spark, sf_dir),
        jobs=views.jobs(spark, sf_dir),
        clusters=views.clusters(spark, sf_dir),
    )


@query(
    "agg_facets",
    with_(TABLES)
    + """SELECT DISTINCT table_type AS value, 'type' AS facet FROM tables_v
      WHERE table_type IS NOT NULL
    UNION ALL SELECT DISTINCT schema, 'schema' FROM tables_v""",
)
def agg_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tables(spark, sf_dir)
    types = aggregates.facet_values(rows, "table_type").select(
        F.col("table_type").alias("value"), F.lit("type").alias("facet")
    )
    schemas = aggregates.facet_values(rows, "schema")
    return types.unionByName(
        schemas.select(F.col("schema").alias("value"), F.lit("schema").alias("facet"))
    )


@query("agg_cap", with_(ASSETS) + "SELECT path, language FROM assets_v ORDER BY path LIMIT 3")
def agg_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.work_list(views.assets(spark, sf_dir).select("path", "language"))


@query(
    "set_union_inventory",
    with_(ASSETS, TABLES, JOBS, CLUSTERS)
    + """SELECT 'asset' AS kind, path, NULL AS name, NULL::BIGINT AS job_id, NULL AS cluster_id,
        size AS size_bytes FROM assets_v
    UNION ALL SELECT 'table', NULL, name, NULL, NULL, size_bytes FROM tables_v
    UNION ALL SELECT 'job', NULL, CASE WHEN ord % 2 = 0 THEN NULL WHEN ord % 3 = 0 THEN ''
        ELSE name END, job_id, NULL, NULL FROM jobs_v
    UNION ALL SELECT 'cluster', NULL, NULL, NULL, cluster_id, NULL FROM clusters_v""",
)
def set_union_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = aggregates.union_inventory(
        asset=views.assets(spark, sf_dir).select("path", F.col("size").alias("size_bytes")),
        table=views.tables(spark, sf_dir).select("name", "size_bytes"),
        job=views.jobs(spark, sf_dir).select("job_id", "name"),
        cluster=views.clusters(spark, sf_dir).select("cluster_id"),
    )
    return feed.select("kind", "path", "name", "job_id", "cluster_id", "size_bytes")
