import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of the given tables: (doc_id, text, lang), (item_id, text), (vec_id, embedding) and
    (doc_id, quality, toxic) rows."""

    def make(docs, items=(), vectors=(), labels=()):
        folder = str(tmp_path_factory.mktemp("sf"))
        full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs]
        spark.createDataFrame(full, DOCS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        items = spark.createDataFrame(list(items), "item_id BIGINT, text STRING")
        items.coalesce(1).write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
        vectors = spark.createDataFrame(list(vectors), "vec_id BIGINT, embedding ARRAY<FLOAT>")
        vectors.coalesce(1).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
        labels = spark.createDataFrame(list(labels), "doc_id BIGINT, quality INT, toxic INT")
        labels.coalesce(1).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        return folder

    return make
