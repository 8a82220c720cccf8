"""The queries with SQL against DuckDB, on given tables and on awkward rows."""

import pyarrow as pa
import pytest
from compare import database, differences
from texts import DISTINCT, LONG

from transhume.llm.queries import QUERIES, SQL

ITEMS = [
    (1, " ".join(LONG.split()[20:35])),
    (2, " ".join(LONG.split()[30:45]).upper()),
    (3, "one two"),
    (4, "a a a"),
    (5, None),
    (6, "..."),
    (10, " ".join(LONG.split()[20:35])),
    (7, "nothing like this occurs anywhere at all in any of the documents here"),
]


@pytest.mark.parametrize("name", list(SQL))
def test_given_tables(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, sf_dir), database(sf_dir), SQL[name]) == []


VECTORS = [
    *[(i, [((i * 37 + j * 11) % 23 - 11) / 7 for j in range(64)]) for i in range(40)],
    (100, [0.0] * 64),
    (101, [0.0] * 64),
    (102, [0.0] * 63),
    (103, [0.0] * 65),
    (104, None),
    (105, [None] + [0.0] * 63),
    (106, [float("nan")] + [0.0] * 63),
    (107, [float("-inf")] + [0.0] * 63),
    (108, []),
    (None, [1.0] * 64),
]
LABELS = [(0, 1, 0), (5, 1, None), (5, 0, 1), (6, None, 1), (7, 0, 0), (999, 1, 1), (None, 1, 1)]


@pytest.fixture(scope="module")
def awkward(tables):
    return tables([(i, t, "en") for i, t in DISTINCT], ITEMS, VECTORS, LABELS)


@pytest.mark.parametrize("name", list(SQL))
def test_awkward_rows(spark, awkward, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{awkward}/{table}.parquet/*.parquet')")
    assert differences(QUERIES[name](spark, awkward), con, SQL[name]) == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, tables([])).collect() == []


def test_pipeline_moves_small_batches(spark):
    import corpus_pipeline

    docs = spark.range(0, 1500, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text", "'en' AS lang")
    corpus_pipeline.known_language(spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    largest = max(r["n"] for r in docs.select("text").mapInArrow(sizes, "n BIGINT").collect())
    assert largest < 2 * corpus_pipeline.BATCH_BYTES


def peak_mb(work):
    import tracemalloc

    tracemalloc.start()
    try:
        for _ in work:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def long_texts(n):
    return [" ".join(f"w{(i * 7919 + j * 31) % 9973}x{j % 977}" for j in range(1500)) for i in range(n)]


def test_predictor_holds_little_at_once():
    from transhume.llm import language

    texts = pa.array(long_texts(200))
    counts = language._count(iter([pa.RecordBatch.from_arrays([texts, pa.array(["en"] * 200)], names=["text", "lang"])]))
    model = language.Model(pa.Table.from_batches(list(counts)))
    keys = pa.array(range(200), pa.int64())
    batch = pa.RecordBatch.from_arrays([keys, texts, keys], names=["doc_id", "text", "row"])
    assert peak_mb(language._predictor(model)(iter([batch]))) < 20


def test_lean_encoder_holds_little_at_once():
    from transhume.llm import encoding

    encoder = encoding.Encoder(encoding.default_path("byte_bpe_50k.json"), **encoding.LEAN)
    texts = pa.array(long_texts(200))
    for _ in encoder.encode(texts):  # its pieces are known from here on
        pass
    assert peak_mb(encoder.encode(texts)) < 22
