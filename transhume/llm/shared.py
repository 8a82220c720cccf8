"""Tables in the shared folder, and fixed-size membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transhume.session import scratch_dir

#: Characters that separate words and are left out of normalised texts: space, tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"

#: A filter has at most this many words of 64 bits, 24 bytes each where it is broadcast (6 MB).
FILTER_WORDS = 1 << 18


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, with its file system in its name."""
    return qualified(spark, scratch_dir(spark, label))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the session's default file system reads it; never a bare local path."""
    jvm, jsc = spark._jvm, spark._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(jsc.hadoopConfiguration()).makeQualified(place).toString()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    jvm, jsc = spark._jvm, spark._jsc
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """At most so many rows at once between Spark and Python: texts may be long, and a worker keeps the
    memory of its largest batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that written() made."""
    remove(df.sparkSession, *{path.rpartition("/")[0] for path in df.inputFiles()})


def text_hash(text: str | Column = "text") -> Column:
    """64 bits of a text; tells apart rows that share a doc_id.  Null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def filter_of(hashes: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """A bit set of 64-bit hashes as (word, mask): `words` rows at most, whatever the input.

    Bits are the lowest ones of the hash, 64 to a row, combined before the shuffle.
    """
    place = F.col(key).bitwiseAND(F.lit(words * 64 - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
    return (
        hashes.select(F.shiftright(place, 6).alias("_word"), bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_mask"))
    )


def marked(df: DataFrame, key: Column, bits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Adds _maybe: whether the 64-bit hash may be in the filter.  It is true for all members, and for
    few others until the filter fills up.  The filter has a fixed largest size, so it is broadcast."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    word = F.shiftright(key.bitwiseAND(F.lit(words * 64 - 1)), 6)
    hit = F.getbit("_mask", key.bitwiseAND(F.lit(63)).cast("int")) == 1
    joined = df.withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    return joined.select(*columns, F.coalesce(hit, F.lit(False)).alias("_maybe"))


def maybe_in(df: DataFrame, key: Column, bits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose hash may be in the filter."""
    return marked(df, key, bits, words).where("_maybe").drop("_maybe")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Every row as one column `row` beside working columns, which so can't clash with its own."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[value.alias(name) for name, value in columns.items()])


def without(rows: DataFrame, gone: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """The packed rows that have no match in `gone` (null equals null); pairs: column of rows to column
    of gone.

    Rows that a filter of fixed size rules out stay where they are; the others go through the join.
    """
    gone = written(gone.select(*pairs.values()).distinct(), "gone")
    bits = written(filter_of(gone.select(F.xxhash64(*pairs.values()).alias("k")), "k"), "gone-filter")
    seen = marked(rows, F.xxhash64(*pairs), bits)
    doubt = seen.where("_maybe")
    same = [doubt[a].eqNullSafe(gone[b]) for a, b in pairs.items()]
    stay = doubt.join(gone, same, "left_anti")
    return seen.where("not _maybe").unionByName(stay).drop("_maybe")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
