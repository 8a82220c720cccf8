"""Rule-based rewrite of sources and the line diff between before and after.

Everything happens inside the row: a source is rewritten, split and compared where it is read, so
neither the rewrite nor the diff shuffles.  Only the order-free tally shuffles, and it sends the
changed lines alone.

Lines pair up by expressions alone wherever rules account for the change.  For texts that came about
otherwise, ``sequence=True`` finds a longest common subsequence of the lines, in Arrow batches of the
sources that don't line up; the others send nothing there.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars, sequences, text
from transhume.operators.fields import existing
from transhume.session import small_batches
from transhume.values import Rewrite

DIFF_OP = "struct<op: string, line: string>"
LINE_MARK = "\ue000"  # a private-use character


def rewrite(
    df: DataFrame,
    text_col: str = "content",
    rules: Sequence[Rewrite] = values.REWRITES,
    bucket: str | None = None,
    out: str | None = None,
) -> DataFrame:
    """Apply the rules in order, each to the output of the one before.

    Each rule is its own projection, and a literal test decides whether the regular expression
    runs at all; a rule without special characters is a plain replace.
    """
    out = out or text_col
    df = df if out == text_col else df.withColumn(out, F.col(text_col))
    for rule in rules:
        body = F.col(out)
        replacement = rule.replacement.replace("{bucket}", bucket or values.DEFAULT_BUCKET)
        if re.fullmatch(r"[\w/:]+", rule.pattern):
            changed = F.replace(body, F.lit(rule.pattern), F.lit(replacement))
        else:
            pattern = text.java_regex(rule.pattern)
            changed = F.regexp_replace(body, pattern, text.replacement_text(replacement))
        if rule.hints:
            changed = F.when(text.contains_any(body, rule.hints), changed).otherwise(body)
        df = df.withColumn(out, changed)
    return df


def header_text(language: Column, headers: Mapping[str, str] = values.HEADERS) -> Column:
    """The text put in front of a source, by language (any case); empty for the others."""
    header = F.lit("")
    for name, body in headers.items():
        header = F.when(F.upper(language) == name.upper(), body + "\n").otherwise(header)
    return header


def inject_header(
    df: DataFrame, headers: Mapping[str, str] = values.HEADERS, col: str = "content"
) -> DataFrame:
    return df.withColumn(col, F.concat(header_text(F.col("language"), headers), F.col(col)))


def convert_assets(
    df: DataFrame,
    bucket: str | None = None,
    rules: Sequence[Rewrite] = values.REWRITES,
    headers: Mapping[str, str] = values.HEADERS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One conversion row per asset: path, converted_key, language, before, header, body, after."""
    path = F.coalesce(
        scalars.first_set(existing(df, "path", "name"), ""), F.lit(values.UNNAMED_ASSET)
    )
    rows = df.select(
        path.alias("path"),
        scalars.asset_key(path).alias("converted_key"),
        scalars.text_or(F.col("language"), "PYTHON").alias("language"),
        F.coalesce("content", F.lit("")).alias("before"),
        *keep,
    )
    rows = rewrite(rows, "before", rules, bucket, out="body")
    rows = rows.withColumn("header", header_text(F.col("language"), headers))
    return rows.withColumn("after", F.concat("header", "body"))


def zipped(left: Column, right: Column) -> Column:
    return F.arrays_zip(left.alias("l"), right.alias("r"))


def end_pairs(before: Column, after: Column) -> Column:
    """Pairs of the common lines at both ends; what lies between is removed and added whole."""
    n_before, n_after = F.size(before), F.size(after)
    shorter = F.least(n_before, n_after)

    def run(left: Column, right: Column) -> Column:
        same = F.zip_with(
            F.slice(left, 1, shorter), F.slice(right, 1, shorter), lambda l, r: l == r
        )
        first = F.array_position(same, False)
        return F.when(first > 0, (first - 1).cast("int")).otherwise(shorter)

    head = run(before, after)
    tail = F.least(run(F.reverse(before), F.reverse(after)), shorter - head)
    nothing = F.lit(None).cast("string")
    left = F.concat(
        F.slice(before, F.lit(1), n_before - tail),
        F.array_repeat(nothing, n_after - tail - head),
        F.slice(before, n_before - tail + 1, tail),
    )
    right = F.concat(
        F.slice(after, F.lit(1), head),
        F.array_repeat(nothing, n_before - tail - head),
        F.slice(after, head + 1, n_after - head),
    )
    return zipped(left, right)


def sequence_pairs(before: Column, after: Column) -> Column:
    """Pairs along a longest common subsequence of the lines; null where either side is."""

    @F.arrow_udf("array<struct<l: string, r: string>>")
    def paired(left: pa.Array, right: pa.Array) -> pa.Array:
        return sequences.paired_lists(left, right)

    return paired(before, after)


def joined_lines(source: Column, rule: Rewrite) -> Column:
    """The source with the line ends inside matches of a rule turned into a mark, in one pass.

    What stands between the matches, and the matches, are put together again.
    """
    pattern = text.java_regex(rule.pattern)

    def marked(body: Column) -> Column:
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        joined = F.transform(found, lambda match: F.regexp_replace(match, text.LINE_END, LINE_MARK))
        pieces = F.zip_with(
            F.split(body, pattern, -1),
            joined,
            lambda piece, match: F.concat(piece, F.coalesce(match, F.lit(""))),
        )
        return F.array_join(pieces, "")

    return scalars.bind(source, marked)


def diff_ops(
    df: DataFrame,
    before: str = "before",
    body: str = "body",
    header: str | None = "header",
    rules: Sequence[Rewrite] = values.REWRITES,
    sequence: bool = False,
) -> DataFrame:
    """Add ``pairs`` (l, r) of body lines, ``header_lines`` and the ``aligned`` flag.

    A null side marks a removed or added line.  With equal line counts the lines pair up by
    position.  Where rules took line ends away, each match over several lines is paired as one;
    where even that does not line up, only the common lines at both ends pair up, or with ``sequence``
    those of a longest common subsequence.  Without rules (texts that were edited by hand, say) lines
    pair up by position only if no longer subsequence can be expected: ``sequence`` then compares all
    texts that differ.
    """
    head = text.lines(F.col(header)) if header else F.array().cast("array<string>")
    split = df.withColumns({"_before": text.lines(F.col(before)), "header_lines": head})
    # Most sources are not changed by any rule, and those are split once.
    unchanged = F.when(F.col(body) == F.col(before), F.col("_before"))
    split = split.withColumn("_after", unchanged.otherwise(text.lines(F.col(body))))
    same_size = F.size("_before") == F.size("_after")
    by_place = same_size if rules or not sequence else F.col(body) == F.col(before)
    split = split.withColumn("aligned", by_place)
    # The marked source is null, and costs nothing, wherever lines pair up by position.
    marked = ~F.col("aligned") & ~F.contains(F.col(before), F.lit(LINE_MARK))
    split = split.withColumn("_marked", F.when(marked, F.col(before)))
    for rule in rules:
        split = split.withColumn("_marked", joined_lines(F.col("_marked"), rule))
    split = split.withColumn("_marked", text.lines(F.col("_marked")))
    joins = F.coalesce(F.size("_marked") == F.size("_after"), F.lit(False)) & F.lit(bool(rules))
    by_match = F.flatten(
        F.zip_with("_marked", "_after", lambda l, r: zipped(F.split(l, LINE_MARK), F.array(r)))
    )
    if sequence:
        small_batches(df.sparkSession)
        split = split.withColumn("_done", F.col("aligned") | joins)
        sides = [F.when(~F.col("_done"), F.col(c)) for c in ("_before", "_after")]
        split = split.withColumn("_other", sequence_pairs(*sides))
        other = F.col("_other")
    else:
        other = end_pairs(F.col("_before"), F.col("_after"))
    pairs = (
        F.when(F.col("aligned"), zipped(F.col("_before"), F.col("_after")))
        .when(joins, by_match)
        .otherwise(other)
    )
    split = split.withColumns({"pairs": pairs, "aligned": F.col("aligned") | joins})
    return split.drop("_before", "_after", "_marked", "_done", "_other")


def op_list(pairs: Column, header_lines: Column, apart: bool = False) -> Column:
    """All diff operations in order: header lines as added, then the body.

    A run of changed pairs gives all its removed lines, then all its added ones.  Runs are the
    gaps between equal pairs, so each pair is visited once.  Where no pair holds two different lines its runs
    have that order already, as ``diff_ops`` gives them, and each pair is one operation.  ``apart`` says that no row
    has such a pair, and saves the look at each: sequences that are compared without rules have none.
    """

    def ops(sign: str, lines: Column) -> Column:
        present = F.filter(lines, F.isnotnull)
        listed = F.transform(present, lambda l: F.struct(F.lit(sign).alias("op"), l.alias("line")))
        return listed.cast(f"array<{DIFF_OP}>")

    def up_to(last: Column, upto: Column) -> Column:
        """The equal pair at ``last`` (if any) and the changed ones after it, before ``upto``."""
        same = F.struct(F.lit(" ").alias("op"), F.get(pairs, last)["l"].alias("line")).cast(DIFF_OP)
        run = F.slice(pairs, last + 2, upto - last - 1)
        none = F.array().cast(f"array<{DIFF_OP}>")
        removed = ops("-", F.transform(run, lambda p: p["l"]))
        added = ops("+", F.transform(run, lambda p: p["r"]))
        return F.concat(
            F.when(last >= 0, F.array(same)).otherwise(none),
            F.when(upto - last > 1, F.concat(removed, added)).otherwise(none),
        )

    equal = F.filter(
        F.transform(pairs, lambda p, i: F.when(p["l"] == p["r"], i)), F.isnotnull
    )
    starts = F.concat(F.array(F.lit(-1)), equal)
    ends = F.concat(equal, F.array(F.size(pairs)))
    by_run = F.flatten(F.zip_with(starts, ends, up_to))

    def sign(l: Column, r: Column) -> Column:
        return F.when(l.isNull(), "+").when(r.isNull(), "-").otherwise(" ")

    # Two lists zipped: a struct made for each pair by itself would be copied once more.
    signs = F.zip_with(pairs["l"], pairs["r"], sign)
    lines = F.zip_with(pairs["l"], pairs["r"], lambda l, r: F.coalesce(l, r))
    each = F.arrays_zip(signs.alias("op"), lines.alias("line")).cast(f"array<{DIFF_OP}>")
    if apart:
        return F.concat(ops("+", header_lines), each)
    # a pair of nothing at all is no operation
    mixed = F.exists(
        pairs, lambda p: F.coalesce(p["l"] != p["r"], F.lit(False)) | (p["l"].isNull() & p["r"].isNull())
    )
    return F.concat(ops("+", header_lines), F.when(mixed, by_run).otherwise(each))


def line_diff(df: DataFrame, key: str = "path", **args: Any) -> DataFrame:
    """One row per diff operation: key, seq, op (' ', '-', '+'), line, aligned."""
    ops = op_list(F.col("pairs"), F.col("header_lines"))
    rows = diff_ops(df, **args).select(key, "aligned", F.posexplode(ops).alias("seq", "_op"))
    return rows.select(key, "seq", "_op.op", "_op.line", "aligned")


def diff_head(df: DataFrame, n: int = 200, key: str = "path", **args: Any) -> DataFrame:
    """The first ``n`` operations of each asset, cut inside the row."""
    # Every header line and every pair gives an operation, and a cut run loses only its last ones.
    ops = op_list(F.slice("pairs", 1, n), F.slice("header_lines", 1, n))
    rows = diff_ops(df, **args).select(key, F.posexplode(F.slice(ops, 1, n)).alias("seq", "_op"))
    return rows.select(key, "seq", "_op.op", "_op.line")


def diff_counts(df: DataFrame, key: str = "path", **args: Any) -> DataFrame:
    """Lines kept, removed and added per asset, whatever their order; header lines on their own.

    Lines that pair up equal are counted inside the row.  Only the changed lines are exploded and
    grouped; a line both removed and added counts as kept.
    """
    unequal = F.filter("pairs", lambda p: ~p["l"].eqNullSafe(p["r"]))
    rows = diff_ops(df, **args).select(
        key,
        F.size("header_lines").alias("n_header"),
        F.size("pairs").alias("n_pairs"),
        unequal.alias("changed"),
    )

    def entry(line: Column, before: int, after: int, same: Column, header: Column) -> Column:
        return F.struct(
            line.cast("string").alias("line"),
            F.lit(before).alias("before"),
            F.lit(after).alias("after"),
            same.cast("bigint").alias("same"),
            header.cast("bigint").alias("header"),
        )

    def side(name: str, before: int, after: int) -> Column:
        lines = F.filter(F.col("changed")[name], F.isnotnull)
        return F.transform(lines, lambda line: entry(line, before, after, F.lit(0), F.lit(0)))

    # One entry per asset carries what was counted inside the row; its line is null.
    n_same = F.col("n_pairs") - F.size("changed")
    whole = entry(F.lit(None), 0, 0, n_same, F.col("n_header"))
    entries = F.concat(F.array(whole), side("l", 1, 0), side("r", 0, 1))
    exploded = rows.select(key, F.explode(entries).alias("e")).select(key, "e.*")
    # Grouping by (key, line) first spreads one huge file over the cluster.
    sums = [F.sum(name).alias(name) for name in ("before", "after", "same", "header")]
    by_line = exploded.groupBy(key, "line").agg(*sums)
    both = F.least("before", "after")
    return by_line.groupBy(key).agg(
        F.sum(F.col("same") + both).alias("kept"),
        F.sum(F.col("before") - both).alias("removed"),
        F.sum(F.col("after") - both).alias("added"),
        F.sum("header").alias("header_added"),
    )


def conversion_tally(df: DataFrame, ok: str = "uploaded") -> DataFrame:
    return df.agg(
        F.count_if(F.col(ok)).alias("n_uploaded"), F.count(F.lit(1)).alias("n_total")
    )
