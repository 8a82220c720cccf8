"""Field queries: one derived field (or a few) over a whole view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.operators import fields
from transhume.values import PROMPT
from workload import listings as export
from workload import views
from workload.listings import COLUMN_TEXT
from workload.registry import query
from workload.views import ASSETS, COLUMNS_TEXT, JOBS, TABLES, TIMES, iso_sql, with_


@query(
    "fn_alias",
    with_(ASSETS, TIMES)
    + "SELECT ord, created_raw AS created, modified_raw AS modified FROM times",
)
def fn_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir)
    rows = fields.first_set(rows, "created", fields.CREATED_ALIASES)
    rows = fields.first_set(rows, "modified", fields.MODIFIED_ALIASES)
    return rows.select("ord", "created", "modified")


@query(
    "fn_timestamp",
    with_(ASSETS)
    + f"""SELECT ord, {iso_sql("created_at")} AS created,
      {iso_sql("created_at", "1000000000000")} AS created_sane FROM assets_v""",
)
def fn_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir).select(
        "ord", F.col("created_at").alias("created"), F.col("created_at").alias("created_sane")
    )
    return fields.norm_timestamp(fields.norm_timestamp(rows, "created"), "created_sane", 1e12)


@query(
    "fn_display_ts",
    with_(ASSETS)
    + """SELECT ord, CASE WHEN ord % 5 = 1 THEN replace(replace(created_at, 'T', ' '), 'Z', '')
      WHEN ord % 5 = 2 THEN '2023-12-31 00:00:00' ELSE '' END AS last_modified
    FROM assets_v""",
)
def fn_display_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir)
    raw = F.when(F.col("ord") % 5 == 2, F.lit("12/31/2023")).otherwise(F.col("created_at"))
    rows = rows.select("ord", raw.alias("raw"))
    return fields.display_ts(rows, "raw").select("ord", "last_modified")


@query(
    "fn_basename",
    with_(ASSETS) + "SELECT path, split_part(path, '/', -1) AS name FROM assets_v",
)
def fn_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.base_name(views.assets(spark, sf_dir)).select("path", "name")


OWNER = """coalesce(nullif(owner, ''), CASE WHEN split_part(trim(path, '/'), '/', 1) = 'Users'
  THEN split_part(trim(path, '/'), '/', 2) ELSE split_part(trim(path, '/'), '/', 1) END)"""


@query("fn_owner", with_(ASSETS) + f"SELECT path, {OWNER} AS owner FROM assets_v")
def fn_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.owner_from_path(views.assets(spark, sf_dir)).select("path", "owner")


@query(
    "fn_size_units",
    with_(TABLES)
    + """SELECT name, round_even(coalesce(size_bytes, 0) / 1024::DOUBLE, 2) AS size_kb,
      round_even(coalesce(size_bytes, 0) / 1048576::DOUBLE, 2) AS size_mb,
      round(coalesce(size_bytes, 0) / 1073741824::DOUBLE, 9) AS size_gb FROM tables_v""",
)
def fn_size_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.size_units(views.tables(spark, sf_dir), "size_bytes")
    return rows.select("name", "size_kb", "size_mb", F.round("size_gb", 9).alias("size_gb"))


@query(
    "fn_newlines",
    with_(ASSETS)
    + """SELECT path, CAST(length(content) - length(replace(content, chr(10), '')) AS INTEGER)
      AS lines FROM assets_v""",
)
def fn_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.newline_count(views.assets(spark, sf_dir)).select("path", "lines")


@query("fn_loc", with_(ASSETS, views.SCAN) + "SELECT path, loc FROM scan")
def fn_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.loc(views.assets(spark, sf_dir)).select("path", "loc")


MIDDLE = """CASE WHEN length({0}) <= 8000 THEN {0} ELSE left({0}, 4800)
  || chr(10) || chr(10) || '...TRUNCATED...' || chr(10) || chr(10) || right({0}, 3200) END"""


@query(
    "fn_truncate",
    with_(ASSETS) + f"SELECT path, {MIDDLE.format('content')} AS content FROM assets_v",
)
def fn_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.truncate_middle(views.assets(spark, sf_dir), "content").select("path", "content")


@query(
    "fn_preview",
    with_(ASSETS)
    + """SELECT path,
      CASE WHEN size > 1000 THEN left(content, 1000) || '...' ELSE content END AS short,
      CASE WHEN size > 2000 THEN left(content, 2000) || '...' ELSE content END AS long,
      left(content, 4000) AS plain FROM assets_v""",
)
def fn_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.assets(spark, sf_dir)
    rows = fields.preview(rows, "content", 1000, out="short")
    rows = fields.preview(rows, "content", 2000, out="long")
    rows = fields.preview(rows, "content", 4000, ellipsis="", out="plain")
    return rows.select("path", "short", "long", "plain")


def prompt_sql(body: str) -> str:
    before, after = PROMPT.replace("\n", "' || chr(10) || '").split("{path}")
    return f"'{before}' || path || '{after}' || {body}"


@query(
    "fn_prompt",
    with_(ASSETS)
    + f"""SELECT path, {prompt_sql("left(content, 4000)")} AS prompt,
      {prompt_sql("(" + MIDDLE.format("content") + ")")} AS long_prompt FROM assets_v""",
)
def fn_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.build_prompt(views.assets(spark, sf_dir))
    return fields.build_prompt(rows, n=None, out="long_prompt").select(
        "path", "prompt", "long_prompt"
    )


def variant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with raw column entries as ARRAY<VARIANT>, up to 59 each."""
    rows = views.spread(views.tables(spark, sf_dir).select("name", "ord"))
    numbers = "sequence(1, cast(ord % 59 as int) + 1)"
    entry = f"parse_json({export.column_json()})"
    return rows.withColumn("columns", F.expr(f"transform({numbers}, i -> {entry})"))


@query(
    "fn_columns",
    with_(TABLES)
    + f"SELECT name, {COLUMN_TEXT.format(n='(ord % 59 + 1)')} AS columns_text FROM tables_v",
)
def fn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.normalize_columns(variant_columns(spark, sf_dir))
    return rows.select("name", views.columns_text().alias("columns_text"))


TYPE_JSON = """CASE ord % 8
    WHEN 0 THEN concat('{"type":"decimal","precision":', ord % 38, ',"scale":2}')
    WHEN 1 THEN '{"type":"decimal"}'
    WHEN 2 THEN concat('{"type":"struct","fields":[{"name":"a', ord, '","type":"int"},',
        '{"name":"b","type":{"type":"array","elementType":{"type":"struct","fields":[',
        '{"field":"c","data_type":"date"}]}}}]}')
    WHEN 3 THEN concat('{"type":"array","elementType":{"type":"numeric","precision":10,"scale":',
        ord % 7, '}}')
    WHEN 4 THEN '{"type":"map","keyType":"string","valueType":"int"}'
    WHEN 5 THEN concat('{"odd":', ord, '}')
    WHEN 6 THEN concat('"varchar(', ord, ')"')
    ELSE 'null' END"""


@query(
    "fn_render_type",
    with_(TABLES)
    + """SELECT ord, CASE ord % 8 WHEN 0 THEN 'decimal(' || (ord % 38) || ',2)'
      WHEN 1 THEN 'decimal'
      WHEN 2 THEN 'struct<a' || ord || ':int, b:array<struct<c:date>>>'
      WHEN 3 THEN 'array<decimal(10,' || (ord % 7) || ')>' WHEN 4 THEN 'map'
      WHEN 5 THEN '{"odd":' || ord || '}' WHEN 6 THEN 'varchar(' || ord || ')'
      ELSE 'string' END AS type FROM tables_v""",
)
def fn_render_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.expr(f"parse_json({TYPE_JSON})")
    rows = views.tables(spark, sf_dir).select("ord", parsed.alias("type"))
    return fields.render_type(rows, "type")


@query(
    "fn_col_count",
    with_(TABLES) + "SELECT name, coalesce(n_cols, 0) AS n_columns FROM tables_v",
)
def fn_col_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.column_count(views.tables(spark, sf_dir)).select("name", "n_columns")


@query(
    "fn_needs_fetch",
    with_(TABLES)
    + "SELECT name, n_cols IS NULL OR first_untyped AS needs_fetch FROM tables_v",
)
def fn_needs_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.needs_column_fetch(views.tables(spark, sf_dir)).select("name", "needs_fetch")


@query(
    "fn_col_head",
    with_(TABLES)
    + f"""SELECT name, CASE WHEN n_cols IS NULL THEN NULL
        ELSE {COLUMNS_TEXT.format(n='least(n_cols, 50)')} END AS shown_text,
      CASE WHEN n_cols > 50 THEN n_cols - 50 ELSE 0 END AS n_more FROM tables_v""",
)
def fn_col_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.column_head(views.tables(spark, sf_dir))
    return rows.select("name", views.columns_text("shown").alias("shown_text"), "n_more")


FQ = """CASE WHEN ord % 5 <> 0 THEN catalog END AS catalog, schema,
  CASE WHEN ord % 8 <> 0 THEN name END AS name"""


@query(
    "fn_fqname",
    with_(TABLES)
    + f"""SELECT ord, coalesce(catalog, 'unknown') || '.' || schema || '.' || coalesce(name, '')
      AS fq_name FROM (SELECT ord, {FQ} FROM tables_v)""",
)
def fn_fqname(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tables(spark, sf_dir).selectExpr("ord", *[c.strip() for c in FQ.split(",")])
    return fields.fq_name(rows).select("ord", "fq_name")


FQ_TEXT = """CASE ord % 4 WHEN 0 THEN catalog || '.' || schema || '.' || name
  WHEN 1 THEN catalog || '.' || schema || '.' || name || '.v.' || ord
  WHEN 2 THEN catalog || '.' || schema ELSE name END AS fq_name"""


@query(
    "fn_parse_fq",
    with_(TABLES)
    + """SELECT ord, CASE WHEN ord % 4 = 3 THEN '' ELSE catalog END AS catalog,
      CASE WHEN ord % 4 = 3 THEN '' ELSE schema END AS schema,
      CASE ord % 4 WHEN 2 THEN '' WHEN 1 THEN name || '.v.' || ord ELSE name END AS name
    FROM tables_v""",
)
def fn_parse_fq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.tables(spark, sf_dir).selectExpr("ord", FQ_TEXT)
    return fields.parse_fq(rows).drop("fq_name")


@query(
    "fn_dest_key",
    with_(ASSETS, TABLES)
    + """SELECT 'table' AS kind, ord, 'root/migrated-tables/' || CASE WHEN ord % 5 = 0
        THEN 'default' ELSE catalog END || '/' || schema || '/' || CASE WHEN ord % 8 = 0
        THEN 'table' ELSE name END AS dest_key FROM tables_v
    UNION ALL
    SELECT 'asset', ord, 'root/migrated-notebooks/' || ltrim(path, '/') FROM assets_v""",
)
def fn_dest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = views.tables(spark, sf_dir).selectExpr("ord", *[c.strip() for c in FQ.split(",")])
    tables = fields.dest_key(tables, "root").select(F.lit("table").alias("kind"), "ord", "dest_key")
    assets = fields.dest_key(views.assets(spark, sf_dir), "root")
    return tables.unionByName(assets.select(F.lit("asset").alias("kind"), "ord", "dest_key"))


@query(
    "fn_join_lists",
    with_(TABLES)
    + """SELECT ord, CASE WHEN ord % 3 = 0 THEN '' WHEN ord % 3 = 1 THEN name
      ELSE name || ', ' || schema END AS items FROM tables_v""",
)
def fn_join_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.when(F.col("ord") % 3 == 1, F.array("name")).when(
        F.col("ord") % 3 == 2, F.array("name", "schema")
    )
    rows = views.tables(spark, sf_dir).select("ord", items.alias("items"))
    return fields.join_lists(rows, ["items"])


@query("fn_job_type", with_(JOBS) + "SELECT ord, type FROM jobs_v")
def fn_job_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.job_type(views.jobs(spark, sf_dir)).select("ord", "type")


TRIGGER = """CASE WHEN schedule IS NOT NULL THEN 'scheduled' WHEN on_file THEN 'file-arrival'
  WHEN paused THEN 'paused' ELSE 'ad-hoc' END AS trigger"""


@query("fn_job_trigger", with_(JOBS) + f"SELECT ord, {TRIGGER} FROM jobs_v")
def fn_job_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.job_trigger(views.jobs(spark, sf_dir)).select("ord", "trigger")


@query(
    "fn_job_runas",
    with_(JOBS)
    + "SELECT ord, CASE WHEN any_id <> 0 THEN any_id END AS job_id, name, run_as FROM jobs_v",
)
def fn_job_runas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.job_run_as(views.jobs(spark, sf_dir)).select("ord", "job_id", "name", "run_as")


@query(
    "fn_reply",
    """SELECT conv_id, turn,
      CASE conv_id % 4 WHEN 0 THEN turn + 1 WHEN 1 THEN 7 ELSE 3 END::INTEGER AS complexity_score,
      CASE conv_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN role ELSE 'medium' END AS risk_assessment,
      CASE conv_id % 4 WHEN 0 THEN '["' || role || '","b"]' WHEN 2 THEN '["' || role || '"]'
        ELSE '[]' END AS migration_challenges,
      CASE conv_id % 4 WHEN 0 THEN '["f"]' ELSE '[]' END AS databricks_specific_features,
      CASE conv_id % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 2 ELSE 8 END::DOUBLE AS estimated_effort_hours,
      '[]' AS aws_service_recommendations,
      CASE WHEN conv_id % 4 = 3 THEN left('no json: ' || text, 200) END AS raw_response_preview
    FROM conversations""",
)
def fn_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.parse_reply(views.replies(spark, sf_dir)).drop("role", "raw")


@query(
    "fn_enrich_status",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Used: model ' || conv_id
      WHEN 'assistant' THEN 'Error: ' || text ELSE 'Not enabled' END AS status
    FROM conversations""",
)
def fn_enrich_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = views.table(spark, sf_dir, "conversations")
    model = F.concat(F.lit("model "), F.col("conv_id").cast("string"))
    info = F.when(
        F.col("role") != "system",
        F.struct(
            (F.col("role") == "user").alias("ok"),
            model.alias("model_id"),
            F.col("text").alias("error"),
        ),
    )
    return fields.enrichment_status(talk.withColumn("enrichment", info)).select(
        "conv_id", "turn", "status"
    )
