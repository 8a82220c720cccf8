"""All facets in one pass against one by one, and what the plan does."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from transhume.operators import facets, filters

RANDOM = random.Random(31)
KIND = "a STRING, b STRING, `c d` INT, path STRING"
ROWS = [
    (RANDOM.choice(["x", "y", "z", None]), RANDOM.choice(["", "All", "k"]), RANDOM.choice([1, 2, None]), f"/p{i}")
    for i in range(300)
]
NAMES = ["a", "b", "c d"]


def plain(rows, choices, text=""):
    out = {}
    rows = [dict(zip(["a", "b", "c d", "path"], r)) for r in rows if text in r[3]]
    chosen = {f: v for f, v in choices.items() if v not in (None, "All")}
    for facet in NAMES:
        every = Counter(r[facet] for r in rows)
        some = Counter(
            r[facet] for r in rows if all(r[f] is not None and str(r[f]) == v for f, v in chosen.items() if f != facet)
        )
        for value, n in every.items():
            if value is not None:
                out[facet, str(value)] = (some[value], n)
    return out


CHOICES = [{}, {"a": "x"}, {"a": "x", "c d": "2"}, {"a": "All", "b": None}, {"a": "absent"}, {"a": "y", "b": "k", "c d": "1"}]


@pytest.mark.parametrize("choices", CHOICES)
def test_counts_are_those_of_each_facet_alone(spark, choices):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    rows = facets.facet_counts(df, NAMES, choices).collect()
    assert {(r["facet"], r["value"]): (r["n"], r["n_all"]) for r in rows} == plain(ROWS, choices)
    assert len(rows) == len({(r["facet"], r["value"]) for r in rows})


def test_same_rows_as_the_filters(spark):
    df = spark.createDataFrame(ROWS, KIND)
    rows = facets.facet_counts(df, ["a", "b"], {"a": "x", "b": "k"}).collect()
    for r in rows:
        other = {"a": {"b": "k"}, "b": {"a": "x"}}[r["facet"]]
        assert r["n"] == filters.facet_filter(df, **other).where(F.col(r["facet"]) == r["value"]).count()


def test_search_and_empty(spark):
    df = spark.createDataFrame(ROWS, KIND)
    rows = facets.facet_counts(df, NAMES, {"a": "x"}, F.contains("path", F.lit("7"))).collect()
    assert {(r["facet"], r["value"]): (r["n"], r["n_all"]) for r in rows} == plain(ROWS, {"a": "x"}, "7")
    assert facets.facet_counts(df.limit(0), NAMES).collect() == []
    assert facets.facet_counts(df, []).collect() == []
    with pytest.raises(ValueError, match="no facet"):
        facets.facet_counts(df, ["a"], {"b": "k"})


def test_one_scan_and_one_exchange(spark, tmp_path):
    spark.createDataFrame(ROWS, KIND).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    plan = facets.facet_counts(df, NAMES, {"a": "x"})._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) == 1
    assert len(re.findall(r"Exchange ", plan)) == 1
    assert "path" not in re.search(r"ReadSchema: (.*)", plan).group(1)
