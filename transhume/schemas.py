"""Read schemas of the exported JSON, and the typed layouts the operators work on."""

# A STRING field takes whatever JSON value is there as text, so dates may come as numbers or text
# and `settings` keeps its raw JSON.  VARIANT keeps values whose shape differs from row to row.
LISTING = """objects ARRAY<STRUCT<
    path STRING, object_type STRING, language STRING, object_id BIGINT, owner STRING,
    object_meta STRUCT<owner STRING>, created_at STRING, created_time STRING,
    modified_at STRING, updated_at STRING, modified STRING, last_modified STRING>>"""

BODIES = "path STRING, content STRING"

OWNER_STATUS = """path STRING, owner STRING,
    object_meta STRUCT<owner STRING, created_by STRING, created_by_user STRING>,
    created_by STRING"""

TABLES = """tables ARRAY<STRUCT<
    name STRING, catalog_name STRING, schema_name STRING, table_type STRING,
    data_source_format STRING, format STRING, storage_format STRING, storage_location STRING,
    columns ARRAY<VARIANT>, size_bytes BIGINT, created_at STRING, updated_at STRING,
    owner STRING, comment STRING>>"""

JOBS = """jobs ARRAY<STRUCT<
    job_id BIGINT, id BIGINT, name STRING, settings STRING, is_paused BOOLEAN,
    creator_user_name STRING, created_by STRING>>"""

CLUSTERS = """clusters ARRAY<STRUCT<
    cluster_id STRING, num_workers INT, autoscale STRUCT<min_workers: INT>,
    driver_node_type_id STRING, node_type_id STRING, start_time BIGINT, created_time BIGINT,
    terminated_time BIGINT, end_time BIGINT>>"""

COLUMN_ENTRY = "STRUCT<name: STRING, type: STRING, nullable: BOOLEAN>"
COLUMN_LIST = f"ARRAY<{COLUMN_ENTRY}>"
