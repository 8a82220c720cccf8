"""From raw documents to packed sequences: five stages, each written and read again.

language     what is in no learned language goes
exact        of equal texts one stays
near         of documents linked by 5-word shingles one stays
benchmark    documents that hold passages of the benchmark go
packing      what is left, cut and packed into sequences: each piece with its ids and place

packing.sequences() gives the ids of each sequence from the last stage's rows.

Null texts have no language and go first; without any label nothing is rejected, and they are equal to empty
ones.  Rows without an id are documents like others.  Of repeated rows one stays after the second stage.
Stages before the last give the columns that came, whatever their names.  Empty tables give no rows, and an
empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transhume.llm import encoding, exact, jaccard, language, packing, shared, winnow


#: Bytes of texts at once between Spark and Python.  Executors keep the memory of the largest batch, on both
#: sides, until the last stage ends.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of at most that many bytes, or one longer text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in learned languages.  Without labels nothing can be told, and all stay."""
    small_batches(spark)
    model = language.fit(docs)
    return language.keep_known(docs, model) if model.langs else docs


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids, a digest of these, and their places in sequences."""
    small_batches(spark)
    return packing.digests(packing.pack(docs, encoding.default_path("byte_bpe_50k.json"), forget=True))


STAGES = [
    ("language", known_language),
    ("exact", exact_dedup),
    ("near", near_dedup),
    ("benchmark", decontaminate),
    ("packing", pack),
]

#: Tokenizer ids and the search for a packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    rows = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        rows = shared.written(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
