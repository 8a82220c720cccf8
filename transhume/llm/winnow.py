"""Benchmark decontamination by winnowing.

Words are lower-cased (A to Z) runs of letters, digits and everything beyond ASCII.  Every 8 consecutive
words are hashed, and of every 3 consecutive hashes the least one is the fingerprint of the 10 words they
span.  Two texts that share 10 words in a row therefore share a fingerprint, whatever stands around them.

1. Every document's distinct fingerprints meet those of the benchmark.  What meets nothing is done.
2. Documents that met one are read again.  Each window of 10 words that has a shared fingerprint is
   extended to all its words and compared with the windows of the items; those that agree are hits.
3. An item of fewer than 10 words is one window of its own length; where there are such items, all words of
   that many in a row are compared with them, as no fingerprint of 8 words covers them.

The benchmark's windows are written as tables, so Spark knows their size and broadcasts them only if they
are small.  All of it is DataFrame expressions; texts stay where they are read but for those documents
that may be hit.

A null or wordless text has no words and no hits; a null or wordless item is never found.  A document is
known by doc_id and text, so rows that repeat an id are judged each by their own text, and repeated items
count once by item_id (a null item_id is left out of the list).

An empty table gives no rows.  Further columns, whatever their names, and very long texts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transhume.llm import shared

GRAM = 8
SPAN = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A to Z are lower-cased, where words are only counted.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column = "text") -> Column:
    """The words of a text; none for null."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() is fast and right where a text is ASCII alone; elsewhere only A to Z may change
    plain = F.octet_length(column) == F.char_length(column)
    lowered = F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _pairs(column: str, step: int) -> Column:
    """Hash of each entry and the one `step` after it; the last entries lack a partner."""
    return F.expr(f"zip_with({column}, slice({column}, {step + 1}, size({column})), (a, b) -> xxhash64(a, b))")


def _least(column: str, other: str, step: int) -> Column:
    return F.expr(f"zip_with({column}, slice({other}, {step + 1}, size({other})), (a, b) -> least(a, b))")


def with_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _n (words), _prints (fingerprint of each window of 10) and _spans (hash of its words)."""
    names = [F.col(f"`{c}`") for c in df.columns if c != text]
    hashed = df.withColumn("_w", words(text)).select(*names, F.expr("transform(_w, x -> xxhash64(x))").alias("_h1"))
    two = hashed.withColumn("_h2", _pairs("_h1", 1)).withColumn("_n", F.size("_h1")).drop("_h1")
    eight = two.withColumn("_h4", _pairs("_h2", 2)).withColumn("_h8", _pairs("_h4", 4)).drop("_h4")
    least = eight.withColumn("_m2", _least("_h8", "_h8", 1)).withColumn("_m3", _least("_m2", "_h8", 2))
    full = F.greatest(F.col("_n") - (SPAN - 1), F.lit(0))
    whole = F.expr(f"zip_with(_h8, slice(_h2, {GRAM + 1}, size(_h2)), (a, b) -> xxhash64(a, b))")
    return least.select(
        *names, "_n", F.slice("_m3", F.lit(1), full).alias("_prints"), F.slice(whole, F.lit(1), full).alias("_spans")
    )


def _grams(n: int) -> Column:
    """Hash of each n words in a row, from _w."""
    every = f"transform(sequence(1, size(_w) - {n - 1}), i -> xxhash64({n}, array_join(slice(_w, i, {n}), ' ')))"
    return F.expr(f"CASE WHEN size(_w) >= {n} THEN {every} ELSE array() END")


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(fingerprint, span, item) of the windows of long items, and (n, span, item) of short ones."""
    named = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    long = with_windows(named).select("item", F.explode(F.arrays_zip("_prints", "_spans")).alias("w"))
    long = long.select(F.col("w._prints").alias("print"), F.col("w._spans").alias("span"), "item").distinct()
    counted = named.select("item", words("text").alias("_w")).withColumn("n", F.size("_w"))
    short = counted.where((F.col("n") > 0) & (F.col("n") < SPAN)).select(
        "n", F.xxhash64(F.col("n"), F.array_join("_w", " ")).alias("span"), "item"
    )
    return shared.written(long, "winnow-items"), shared.written(short.distinct(), "winnow-short")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc"].eqNullSafe(right["doc"]) & (left["t"] == right["t"])


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(doc, t, at, n, span) of every window found in a document, and (n, span, item) of the items."""
    long, short = item_windows(items, item)
    prints = shared.written(long.select("print").distinct(), "winnow-prints")
    spans = shared.written(long.select("print", F.col("span").alias("s")).distinct(), "winnow-spans")
    rows = docs.select(F.col(key).alias("doc"), shared.text_hash(text).alias("t"), F.col(text).alias("text"))
    seen = with_windows(rows).select("doc", "t", F.explode(F.array_distinct("_prints")).alias("print"))
    met = shared.written(seen.join(prints, "print", "left_semi").select("doc", "t").distinct(), "winnow-met")
    bits = shared.filter_of(met.select(F.xxhash64("doc", "t").alias("k")), "k")
    near = shared.maybe_in(rows, F.xxhash64("doc", "t"), bits)
    again = near.join(met, _same(near, met), "left_semi").select("doc", "t", "text").dropDuplicates(["doc", "t"])
    windows = with_windows(again).select("doc", "t", F.posexplode(F.arrays_zip("_prints", "_spans")).alias("at", "w"))
    windows = windows.select("doc", "t", "at", F.col("w._prints").alias("print"), F.col("w._spans").alias("span"))
    agree = (windows["print"] == spans["print"]) & (windows["span"] == spans["s"])
    found = windows.join(spans, agree, "left_semi").select("doc", "t", "at", F.lit(SPAN).alias("n"), "span")
    # at most nine lengths
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):
        own = shared.written(short.where(F.col("n") == n).select("span").distinct(), "winnow-own")
        lists = rows.select("doc", "t", words("text").alias("_w"))
        grams = lists.select("doc", "t", F.posexplode(_grams(n)).alias("at", "span"))
        few = grams.join(own, "span", "left_semi").distinct()
        found = found.unionByName(few.select("doc", "t", "at", F.lit(n).alias("n"), "span"))
    names = long.select(F.lit(SPAN).alias("n"), "span", "item").unionByName(short.select("n", "span", "item"))
    return shared.written(found, "winnow-hits"), names.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as strings), contaminated."""
    found, names = hits(docs, items, key, text, item)
    # words covered: what each window adds beyond the end of those before it, over (doc, t)
    ends = "max(at + n) OVER (PARTITION BY doc, t ORDER BY at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    added = F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest(F.col("at"), F.coalesce("before", F.lit(0))))
    covered = found.withColumn("before", F.expr(ends)).withColumn("added", added)
    n_hit = covered.groupBy("doc", "t").agg(F.sum("added").alias("n_hit"))
    spans = found.select("doc", "t", "n", "span").distinct()
    listed = spans.join(names, ["n", "span"]).groupBy("doc", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    marks = n_hit.join(listed, n_hit["doc"].eqNullSafe(listed["doc"]) & (n_hit["t"] == listed["t"]), "left")
    marks = shared.written(marks.select(n_hit["doc"], n_hit["t"], "n_hit", "items"), "winnow-marks")
    counted = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD), F.lit(0)))
    rows = docs.select(
        F.col(key).alias("_doc"), shared.text_hash(text).alias("_t"), counted.cast("long").alias("n_words")
    )
    joined = rows.join(marks, rows["_doc"].eqNullSafe(marks["doc"]) & (rows["_t"] == marks["t"]), "left")
    count = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("_doc").alias(key),
        "n_words",
        count.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (count > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    found, _ = hits(docs, items, key, text, item)
    rows = shared.packed(docs, id=F.col(key), t=shared.text_hash(text))
    return shared.without(rows, found, {"id": "doc", "t": "t"}).select("row.*")
