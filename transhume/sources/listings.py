"""Exported JSON listings as typed DataFrames.

A listing is a folder (or glob) of JSON lines, each a page with one array.  Pages are exploded
where they are read; several files or pages need no union, since one read takes them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume import schemas
from transhume.functions import jobs, scalars, text, types
from transhume.operators.fields import CREATED_ALIASES, MODIFIED_ALIASES, with_settings
from transhume.operators.joins import with_body
from transhume.sources import ordinals


def read_pages(
    spark: SparkSession, path: str, schema: str, multi_line: bool = False, ordered: bool = False
) -> DataFrame:
    """All items of all pages below a path or glob; ``schema`` has the one array column.

    JSON lines are split over tasks.  ``multi_line`` reads pretty-printed files, each as a whole
    by one task, so such pages should be many and not large.  ``ordered`` adds ``ord``, the item's
    number in input order, for which the listing is counted first.
    """
    pages = spark.read.schema(schema).json(path, multiLine=multi_line)
    if ordered:
        return ordinals.items_in_order(pages, pages.columns[0])
    return pages.select(F.explode(pages.columns[0]).alias("item")).select("item.*")


def read_assets(
    spark: SparkSession,
    path: str,
    bodies: str | None = None,
    ms_threshold: float = 1e9,
    multi_line: bool = False,
    distinct_paths: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """The listed code assets; with ``bodies`` joined to their decoded sources.

    ``ord`` is their place in the listing, folders included; without ``ordered`` it is left out.
    """

    def time_of(aliases: tuple[str, ...]) -> Column:
        raw = scalars.first_set([F.col(name) for name in aliases], "", "0")
        return scalars.norm_timestamp(raw, ms_threshold)

    listed = read_pages(spark, path, schemas.LISTING, multi_line, ordered)
    listed = listed.where(F.col("object_type") == "NOTEBOOK")
    assets = listed.select(
        "path",
        F.coalesce("language", F.lit("PYTHON")).alias("language"),
        "object_id",
        time_of(CREATED_ALIASES).alias("created_at"),
        time_of(MODIFIED_ALIASES).alias("modified_at"),
        F.coalesce(
            scalars.first_set([F.col("owner"), F.col("object_meta.owner")], ""), F.lit("")
        ).alias("owner"),
        *place_of(ordered),
    )
    if bodies is None:
        return assets
    return with_body(assets, read_bodies(spark, bodies), distinct_paths)


def place_of(ordered: bool) -> list[Column]:
    return [F.col("ord")] if ordered else []


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Exported sources, base64 in the file; undecodable and empty ones are left out."""
    return decode_content(spark.read.schema(schemas.BODIES).json(path), "content")


def decoded(body: Column) -> Column:
    """Base64 to UTF-8 text, null when either reading fails; stray characters are skipped.

    Line ends are taken out by plain replaces.  Other stray characters are rare, so the costly
    clean-up runs only on bodies that hold some; the possessive test passes over the rest quickly.
    """
    body = F.replace(F.replace(body, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit(""))

    def cleaned(b: Column) -> Column:
        pure = b.rlike("^[A-Za-z0-9+/]*+={0,2}$") & (F.length(b) % 4 == 0)
        return F.when(pure, b).otherwise(padded(F.regexp_replace(b, "[^A-Za-z0-9+/=]", "")))

    def read(clean: Column) -> Column:
        raw = F.when(F.length(clean) % 4 == 0, F.try_to_binary(clean, F.lit("base64")))
        return F.try_validate_utf8(raw.cast("string"))

    # each step is computed once for a body, however often the next one looks at it
    return scalars.bind(scalars.bind(body, cleaned), read)


def padded(body: Column) -> Column:
    """Base64 with padding anywhere, as a lenient reader takes it: characters count by fours, padding
    that does not complete a four is skipped, and the first that does ends the text."""
    def next_part(state: Column, part: Column) -> Column:
        place = F.length(state["text"]) % 4
        pads = F.when(place >= 2, state["pads"] + 1).otherwise(state["pads"])
        done = state["done"] | ((place >= 2) & (place + pads >= 4))
        more = ~done & (part != "")
        return F.struct(
            F.when(more, F.concat(state["text"], part)).otherwise(state["text"]).alias("text"),
            F.when(more, F.lit(0)).otherwise(pads).alias("pads"),
            done.alias("done"),
        )

    def whole(parts: Column) -> Column:
        start = F.struct(
            F.get(parts, F.lit(0)).alias("text"), F.lit(0).alias("pads"), F.lit(False).alias("done")
        )
        return F.aggregate(F.slice(parts, 2, F.size(parts)), start, next_part)

    return closed(scalars.bind(F.split(body, "=", -1), whole))


def closed(state: Column) -> Column:
    """The text with the padding it lacks, where padding ended it."""

    def close(s: Column) -> Column:
        lacking = (F.lit(4) - F.length(s["text"]) % 4) % 4
        return F.when(s["done"], F.concat(s["text"], F.repeat(F.lit("="), lacking))).otherwise(s["text"])

    return scalars.bind(state, close)


def decode_content(df: DataFrame, col: str = "content") -> DataFrame:
    """Decode and drop what is empty or undecodable.

    The drop is an explode of a list of none or one, as a filter would move below the projection
    and decode every body a second time.
    """
    others = [name for name in df.columns if name != col]
    kept = F.filter(F.array(col), lambda text: F.length(text) > 0)
    return df.withColumn(col, decoded(F.col(col))).select(*others, F.explode(kept).alias(col))


def scope_assets(df: DataFrame, prefix: str = "/", recursive: bool = True) -> DataFrame:
    """Assets below a folder, or directly in it."""
    folder = prefix.rstrip("/")
    if recursive:
        return df.where(F.col("path").startswith(folder + "/"))
    return df.where(text.parent_path(F.col("path")) == folder)


def read_tables(
    spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = True
) -> DataFrame:
    """The listed tables with defaults filled in, column metadata normalised, and their place (``ord``)."""
    listed = read_pages(spark, path, schemas.TABLES, multi_line, ordered)
    fmt = scalars.first_set(
        [F.col("data_source_format"), F.col("format"), F.col("storage_format")], ""
    )
    return listed.select(
        "name",
        F.col("catalog_name").alias("catalog"),
        F.col("schema_name").alias("schema"),
        F.coalesce("table_type", F.lit("MANAGED")).alias("table_type"),
        F.coalesce(fmt, F.lit("")).alias("data_source_format"),
        F.coalesce("storage_location", F.lit("")).alias("storage_location"),
        types.column_entries(F.col("columns")).alias("columns"),
        F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
        "created_at",
        "updated_at",
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce("comment", F.lit("")).alias("comment"),
        *place_of(ordered),
    )


def read_jobs(
    spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = True
) -> DataFrame:
    """Jobs with name, schedule and place (``ord``); the raw settings stay for the job report."""
    listed = with_settings(read_pages(spark, path, schemas.JOBS, multi_line, ordered))
    return listed.select(
        "job_id",
        jobs.job_name(F.col("_settings"), F.col("name"), F.col("job_id")).alias("name"),
        jobs.job_schedule(F.col("_settings")).alias("schedule"),
        "id",
        "settings",
        "is_paused",
        "creator_user_name",
        "created_by",
        *place_of(ordered),
    )


def read_clusters(
    spark: SparkSession, path: str, multi_line: bool = False, ordered: bool = True
) -> DataFrame:
    """The listed clusters as they are, with their place (``ord``)."""
    return read_pages(spark, path, schemas.CLUSTERS, multi_line, ordered)


def read_owner_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OWNER_STATUS).json(path)


def enumerate_tables(
    catalogs: DataFrame,
    schema_list: DataFrame,
    tables: DataFrame,
    catalog: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Tables of the listed catalogs and schemas, optionally of one.

    Naming a catalog or a schema replaces the listing of that level, as no lookup is needed.
    Join strategy is left to Spark, which broadcasts a side only when its size allows.
    """
    if catalog is None:
        names = catalogs.select(F.col("name").alias("catalog")).distinct()
        tables = tables.join(names, "catalog", "left_semi")
    else:
        tables = tables.where(F.col("catalog") == catalog)
    if schema is None:
        pairs = schema_list.select("catalog", F.col("name").alias("schema")).distinct()
        tables = tables.join(pairs, ["catalog", "schema"], "left_semi")
    else:
        tables = tables.where(F.col("schema") == schema)
    return tables


def enumerate_metastore(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """Names of the tables the session's own catalogs list."""
    current = spark.catalog.currentCatalog()
    rows = []
    try:
        for cat in [catalog] if catalog else [c.name for c in spark.catalog.listCatalogs()]:
            spark.catalog.setCurrentCatalog(cat)
            for db in spark.catalog.listDatabases():
                for table in spark.catalog.listTables(db.name):
                    if not table.isTemporary:
                        rows.append((cat, db.name, table.name, table.tableType))
    finally:
        spark.catalog.setCurrentCatalog(current)
    return spark.createDataFrame(
        rows, "catalog STRING, schema STRING, name STRING, table_type STRING"
    )


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first source, or the second one when the first has no rows.

    The test is a scalar subquery that stops at the first row, so it costs no join.
    """
    return primary.unionByName(fallback.where(~primary.exists()))
