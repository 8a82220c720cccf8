"""Rule scan of the sources: patterns, size class, messages, risk, confidence.

Plan shape: one narrow stage over the content.  The two results that need the text (the detected
patterns and the line count) are projected first; all later fields only read those, so the text
is scanned once and Spark keeps the steps in one code-generated stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume import values
from transhume.functions import scalars, text
from transhume.operators.fields import existing
from transhume.values import Rule


def found(*cases: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order.

    Joining one-item lists stays inside generated code, where dropping nulls from a list would not.
    """
    none = F.array().cast("array<string>")
    if not cases:
        return none
    return F.concat(*[F.when(test, F.array(F.lit(text))).otherwise(none) for test, text in cases])


def pattern_scan(
    df: DataFrame,
    text_col: str = "content",
    rules: Sequence[Rule] = values.RULES,
    out: str = "detected_patterns",
) -> DataFrame:
    """Names of the rules whose pattern occurs, in rule order."""
    body = F.col(text_col)
    hits = [(text.matches(body, rule.pattern, rule.hints), rule.name) for rule in rules]
    return df.withColumn(out, found(*hits))


def size_class(loc: Column, bounds: tuple[int, int] = values.SIZE_BOUNDS) -> Column:
    return F.when(loc < bounds[0], "simple").when(loc < bounds[1], "medium").otherwise("complex")


def rule_messages(
    df: DataFrame,
    rules: Sequence[Rule] = values.RULES,
    kind: str = "issue",
    detected: str = "detected_patterns",
    out: str | None = None,
) -> DataFrame:
    """The ``issue`` or ``suggestion`` texts of the detected rules, in rule order."""
    texts = [(rule.name, getattr(rule, kind)) for rule in rules if getattr(rule, kind)]
    messages = found(*[(F.array_contains(detected, name), text) for name, text in texts])
    return df.withColumn(out or f"{kind}s", messages)


def risk(df: DataFrame, out: str = "risk") -> DataFrame:
    return df.withColumn(
        out,
        F.when((F.col("complexity") == "complex") | (F.size("issues") > 0), "red")
        .when(F.col("complexity") == "medium", "yellow")
        .otherwise("green"),
    )


def summary(df: DataFrame, out: str = "summary") -> DataFrame:
    found = F.size("detected_patterns")
    some = F.format_string(values.SUMMARY_SOME, found, F.col("complexity"))
    none = F.format_string(values.SUMMARY_NONE, F.col("complexity"))
    return df.withColumn(out, F.when(found > 0, some).otherwise(none))


def analyze_assets(
    df: DataFrame,
    rules: Sequence[Rule] = values.RULES,
    bounds: tuple[int, int] = values.SIZE_BOUNDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One analysis row per asset, with the ``keep`` columns of the input beside it."""
    path = scalars.first_set(existing(df, "path", "object_path", "name"), "")
    language = existing(df, "language") or [F.lit(None)]
    scanned = df.select(
        F.coalesce(path, F.lit("<unknown>")).alias("path"),
        F.coalesce(*language, F.lit("python")).alias("language"),
        F.coalesce("content", F.lit("")).alias("content"),
        *[name for name in keep if name not in ("path", "language", "content")],
    )
    scanned = pattern_scan(scanned, "content", rules)
    scanned = scanned.withColumn("loc", text.line_count(F.col("content")))
    if "content" not in keep:
        scanned = scanned.drop("content")
    scanned = scanned.withColumn("complexity", size_class(F.col("loc"), bounds))
    scanned = rule_messages(scanned, rules, "issue")
    scanned = rule_messages(scanned, rules, "suggestion")
    return summary(risk(scanned))


def confidence(
    df: DataFrame,
    complexity: str = "complexity",
    n_issues: str | Column = "n_issues",
    size_kb: str = "size_kb",
) -> DataFrame:
    """Percent and label; the size class ``medium`` has no weight of its own (other)."""
    weight = F.lit(values.OTHER_WEIGHT)
    for name, value in values.COMPLEXITY_WEIGHT.items():
        weight = F.when(F.lower(F.col(complexity)) == name, value).otherwise(weight)
    count = F.col(n_issues) if isinstance(n_issues, str) else n_issues
    penalty = F.least(
        F.coalesce(count, F.lit(0)) * values.ISSUE_PENALTY, F.lit(values.MAX_PENALTY)
    )
    size = F.coalesce(F.col(size_kb), F.lit(0.0))
    factor = F.lit(values.OVERSIZE_FACTOR)
    for limit, value in reversed(values.SIZE_FACTORS):
        factor = F.when(size <= limit, value).otherwise(factor)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight * (1 - penalty) * factor))
    label = F.lit(values.LOWEST_LABEL)
    for floor, name in reversed(values.CONFIDENCE_LABELS):
        label = F.when(F.col("confidence_pct") >= floor, name).otherwise(label)
    scored = df.withColumn("confidence_pct", F.bround(score * 100).cast("int"))
    return scored.withColumn("confidence_label", label)


def is_auto() -> Column:
    """Simple and without issues; never null."""
    no_issues = F.coalesce(F.size("issues"), F.lit(0)) <= 0
    return F.coalesce((F.col("complexity") == "simple") & no_issues, F.lit(False))


def readiness(df: DataFrame, out: str = "readiness") -> DataFrame:
    return df.withColumn(out, F.when(is_auto(), "auto").otherwise("review"))


def literal_scan(
    df: DataFrame,
    text_col: str = "content",
    literals: Sequence[str] = values.LITERALS,
    out: str = "literals",
) -> DataFrame:
    """Which of the plain substrings occur, in list order."""
    hits = [(F.contains(text_col, F.lit(literal)), literal) for literal in literals]
    return df.withColumn(out, found(*hits))
