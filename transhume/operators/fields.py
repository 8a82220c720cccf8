"""Derived fields, one operator each.  All are narrow: no shuffle, no Python on the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.functions import jobs, replies, scalars, text, types
from transhume.values import PROMPT, TRUNCATE_LIMIT

# Where the times of an asset are looked for, in this order.
MODIFIED_ALIASES = (
    "modified_at",
    "updated_at",
    "modified",
    "last_modified",
    "created_at",
    "created_time",
)
CREATED_ALIASES = ("created_at", "created_time")


def existing(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(name) for name in names if name in df.columns]


def first_set(df: DataFrame, out: str, aliases: Sequence[str]) -> DataFrame:
    """The first alias column that is set; empty text and zero count as not set."""
    return df.withColumn(out, scalars.first_set(existing(df, *aliases), "", "0"))


def norm_timestamp(df: DataFrame, col: str, ms_threshold: float = 1e9) -> DataFrame:
    return df.withColumn(col, scalars.norm_timestamp(F.col(col), ms_threshold))


def display_ts(df: DataFrame, col: str, out: str = "last_modified") -> DataFrame:
    return df.withColumn(out, scalars.display_ts(F.col(col)))


def base_name(df: DataFrame, col: str = "path", out: str = "name") -> DataFrame:
    return df.withColumn(out, text.base_name(F.col(col)))


def owner_from_path(df: DataFrame, out: str = "owner") -> DataFrame:
    """The explicit owner if there is one, else the one the path tells."""
    known = [scalars.unless(col, "") for col in existing(df, "owner")]
    return df.withColumn(out, F.coalesce(*known, text.owner_from_path(F.col("path"))))


def size_units(df: DataFrame, bytes_col: str) -> DataFrame:
    size = F.col(bytes_col)
    return df.withColumns(
        {
            "size_kb": scalars.kilobytes(size),
            "size_mb": scalars.megabytes(size),
            "size_gb": scalars.gigabytes(size),
        }
    )


def newline_count(df: DataFrame, col: str = "content", out: str = "lines") -> DataFrame:
    return df.withColumn(out, text.newline_count(F.col(col)))


def loc(df: DataFrame, col: str = "content", out: str = "loc") -> DataFrame:
    return df.withColumn(out, text.line_count(F.col(col)))


def truncate_middle(df: DataFrame, col: str, limit: int = TRUNCATE_LIMIT) -> DataFrame:
    return df.withColumn(col, text.truncate_middle(F.col(col), limit))


def preview(
    df: DataFrame, col: str, n: int = 1000, ellipsis: str = "...", out: str = "preview"
) -> DataFrame:
    return df.withColumn(out, text.preview(F.col(col), n, ellipsis))


def build_prompt(
    df: DataFrame, template: str = PROMPT, n: int | None = 4000, out: str = "prompt"
) -> DataFrame:
    """Template with ``{path}`` filled in, then the first ``n`` characters of the content.

    Without ``n`` the content is cut in the middle instead, keeping both ends.
    """
    before, _, after = template.partition("{path}")
    pieces = [F.lit(before)]
    if "{path}" in template:
        pieces += [F.coalesce(F.col("path"), F.lit("")), F.lit(after)]
    content = F.coalesce(F.col("content"), F.lit(""))
    body = text.truncate_middle(content) if n is None else F.left(content, F.lit(n))
    return df.withColumn(out, F.concat(*pieces, body))


def normalize_columns(df: DataFrame, col: str = "columns", depth: int = types.DEPTH) -> DataFrame:
    """ARRAY<VARIANT> column metadata to typed entries."""
    return df.withColumn(col, types.column_entries(F.col(col), depth))


def render_type(df: DataFrame, variant_col: str, depth: int = types.DEPTH) -> DataFrame:
    return df.withColumn(variant_col, types.render_type(F.col(variant_col), depth))


def column_count(df: DataFrame, out: str = "n_columns") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.size("columns"), F.lit(0)))


def needs_column_fetch(df: DataFrame, out: str = "needs_fetch") -> DataFrame:
    """True without columns, or when a column has no type."""
    untyped = F.exists("columns", lambda c: F.coalesce(c["type"], F.lit("")) == "")
    empty = F.coalesce(F.size("columns"), F.lit(0)) <= 0
    return df.withColumn(out, empty | F.coalesce(untyped, F.lit(False)))


def column_head(df: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` columns to show, and how many more there are."""
    size = F.coalesce(F.size("columns"), F.lit(0))
    return df.withColumns(
        {"shown": F.slice("columns", 1, n), "n_more": F.greatest(size - n, F.lit(0))}
    )


def fq_name(df: DataFrame, out: str = "fq_name") -> DataFrame:
    return df.withColumn(out, scalars.fq_name(F.col("catalog"), F.col("schema"), F.col("name")))


def parse_fq(df: DataFrame, col: str = "fq_name") -> DataFrame:
    return df.withColumn("_fq", scalars.parse_fq(F.col(col))).select("*", "_fq.*").drop("_fq")


def dest_key(df: DataFrame, root: str = "", out: str = "dest_key") -> DataFrame:
    """Key of an asset (by its path) or else of a table (by its three name parts)."""
    if "path" in df.columns:
        key = scalars.asset_key(F.col("path"))
    else:
        schema = scalars.first_set(existing(df, "schema", "db"), "")
        name = scalars.first_set(existing(df, "name", "table_name"), "")
        key = scalars.table_key(F.col("catalog"), schema, name)
    root = root.rstrip("/")
    return df.withColumn(out, F.concat(F.lit(root + "/"), key) if root else key)


def join_lists(df: DataFrame, cols: Sequence[str], sep: str = ", ") -> DataFrame:
    joined = {col: F.coalesce(F.array_join(col, sep), F.lit("")) for col in cols}
    return df.withColumns(joined)


def with_settings(df: DataFrame) -> DataFrame:
    """Add the parsed job settings, which the three job operators below share."""
    return df.withColumn("_settings", jobs.settings_map(F.col("settings")))


def from_settings(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    if "_settings" in df.columns:
        return df.withColumns(columns)
    return with_settings(df).withColumns(columns).drop("_settings")


def job_type(df: DataFrame, out: str = "type") -> DataFrame:
    return from_settings(df, {out: jobs.job_type(F.col("_settings"))})


def job_trigger(df: DataFrame, out: str = "trigger") -> DataFrame:
    trigger = jobs.job_trigger(F.col("_settings"), F.col("settings"), F.col("is_paused"))
    return from_settings(df, {out: trigger})


def job_run_as(df: DataFrame) -> DataFrame:
    """Job id, name and the user it runs as, each over its aliases."""
    settings = F.col("_settings")
    run_as = jobs.job_run_as(settings, F.col("creator_user_name"), F.col("created_by"))
    job_id = F.coalesce(*[F.nullif(col, F.lit(0)) for col in existing(df, "job_id", "id")])
    return from_settings(
        df,
        {
            "name": jobs.job_name(settings, F.col("name"), F.col("job_id")),
            "run_as": run_as,
            "job_id": job_id,
        },
    )


def parse_reply(df: DataFrame, col: str = "raw") -> DataFrame:
    """Raw reply text to the six typed fields plus a preview of unreadable text.

    Parsing is staged so that each reply is read once, not once per field.
    """
    parsed = df.withColumn("_reply", replies.unwrap(F.try_parse_json(F.col(col))))
    fields = parsed.withColumn("_fields", replies.reply_fields(F.col("_reply"), F.col(col)))
    return fields.select("*", "_fields.*").drop("_reply", "_fields")


def enrichment_status(df: DataFrame, col: str = "enrichment", out: str = "status") -> DataFrame:
    """Text for an enrichment struct (ok, model_id, error)."""
    info = F.col(col)
    error = scalars.unless(info["error"], "")
    return df.withColumn(
        out,
        F.when(F.coalesce(info["ok"], F.lit(False)), F.concat(F.lit("Used: "), info["model_id"]))
        .when(error.isNotNull(), F.concat(F.lit("Error: "), error))
        .otherwise("Not enabled"),
    )
