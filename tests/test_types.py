"""Type descriptions of any depth against a plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from transhume.functions import types


def plain(value):
    """A type description as text: null, scalars, decimals, structs, arrays, nested types, JSON."""
    if value is None:
        return "string"
    if not isinstance(value, dict):
        return text(value, True)
    if text(value.get("type")) in ("decimal", "numeric"):
        p, s = text(value.get("precision")), text(value.get("scale"))
        return f"decimal({p},{s})" if p and s else "decimal"
    fields = value.get("fields")
    if isinstance(fields, list):
        if not all(isinstance(f, dict) for f in fields):
            return "string"
        return "struct<" + ", ".join(map(field, fields)) + ">"
    if "elementType" in value:
        return f"array<{plain(value['elementType'])}>"
    if value.get("type") is not None:
        return plain(value["type"])
    return text(value)


def field(f):
    name = next((t for k in ("name", "field") if (t := text(f.get(k)))), "None")
    kind = next((f[k] for k in ("type", "data_type", "dtype") if f.get(k) is not None), None)
    return f"{name}:{plain(kind)}"


def text(value, shown=False):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value) if shown else str(value).lower()
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def nested(depth):
    kind = "int"
    for i in range(depth):
        inner = {"type": "struct", "fields": [{"name": f"a{i}", "type": kind}, {"field": "b"}]}
        kind = inner if i % 2 else {"type": "array", "elementType": kind}
    return kind


def some_type(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        odd = ["int", "", None, True, False, 7, 'a"b{', "x,y]", {}, {"u": 1}, ["z"]]
        return rng.choice([*odd, {"type": "decimal", "precision": 9, "scale": 2}, {"type": "numeric"}])
    inner = [some_type(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    names = rng.choice(["name", "field", "title"]), rng.choice(["type", "data_type", "dtype", "other"])
    return rng.choice(
        [
            {"type": "struct", "fields": [{names[0]: f"c{i}", names[1]: t} for i, t in enumerate(inner)]},
            {"type": "array", "elementType": some_type(rng, depth - 1)},
            {"type": some_type(rng, depth - 1), "nullable": False},
            {"fields": [*inner, "loose"], "type": some_type(rng, depth - 1)},
            {"fields": [None, *[{"name": "n", "type": t} for t in inner]]},
        ]
    )


def rendered(spark, values, depth):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i INT, j STRING")
    kind = types.render_type(F.try_parse_json("j"), depth)
    return [r["t"] for r in df.select("i", kind.alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("depth", [0, 1, types.DEPTH])
def test_random_types(spark, depth):
    rng = random.Random(depth)
    values = [some_type(rng, rng.randint(0, 6)) for _ in range(400)]
    assert rendered(spark, values, depth) == [plain(v) for v in values]


def test_three_to_thirty_levels(spark):
    values = [nested(n) for n in (3, 8, 9, 15, 30, 60)]
    assert rendered(spark, values, types.DEPTH) == [plain(v) for v in values]
    assert "{" not in rendered(spark, values[-1:], types.DEPTH)[0]


def test_column_entries_of_a_small_table_are_dealt_over_all_tasks(spark, tmp_path):
    from workload import q_fields

    rows = spark.range(40).selectExpr(
        "id AS p_partkey", "concat('part ', id) AS p_name", "'Brand#1' AS p_brand", "'type' AS p_type",
        "cast(id % 50 AS int) AS p_size", "cast(id AS double) AS p_retailprice",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = q_fields.fn_columns(spark, str(tmp_path))
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 40
