"""Files written by the sinks, read back by plain Python where the form matters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from transhume.operators import rewrite
from transhume.plans import analysis, conversion, migration
from transhume.sinks import objects
from transhume.sinks import reports as sinks
from transhume.sources import files, listings


def table_rows(spark):
    return spark.createDataFrame(
        [
            ("c", "s", "t", 5, [("a", "int", True)], None),
            (None, "", None, None, None, "note"),
        ],
        "catalog STRING, schema STRING, name STRING, size_bytes LONG, "
        "columns ARRAY<STRUCT<name: STRING, type: STRING, nullable: BOOLEAN>>, comment STRING",
    )


def test_sidecars(spark, tmp_path):
    status = sinks.write_sidecars(table_rows(spark), f"file:{tmp_path}").collect()
    assert all(row["ok"] for row in status)
    full = json.load(open(tmp_path / "migrated-tables/c/s/t/schema.json"))
    assert full["columns"] == [{"name": "a", "type": "int", "nullable": True}]
    assert full["size_bytes"] == 5 and full["partitions"] == [] and full["notes"] == ""
    bare = json.load(open(tmp_path / "migrated-tables/default/default/table/schema.json"))
    assert bare["columns"] == [] and bare["name"] is None and bare["notes"] == "note"
    assert list(bare) == [
        "name",
        "catalog",
        "schema",
        "table_type",
        "storage_location",
        "size_bytes",
        "created_at",
        "updated_at",
        "owner",
        "columns",
        "partitions",
        "notes",
    ]


def test_converted_sources_at_their_keys(spark, tmp_path):
    df = spark.createDataFrame(
        [("/Users/é/a b.py", "SQL", "display(x)\n"), ("/../x", "SQL", "y"), ("/d", "SQL", "")],
        "path STRING, language STRING, content STRING",
    )
    status = sinks.write_converted(rewrite.convert_assets(df), str(tmp_path)).collect()
    found = {row["key"]: (row["ok"], row["n_bytes"]) for row in status}
    assert found == {
        "migrated-notebooks/Users/é/a b.py": (True, 9),
        "migrated-notebooks/../x": (False, 0),
        "migrated-notebooks/d": (True, 0),
    }
    assert open(tmp_path / "migrated-notebooks/Users/é/a b.py").read() == "print(x)\n"
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if n.startswith(".")]


def test_copy_keeps_places_and_bytes(spark, tmp_path):
    source, target = tmp_path / "from here", tmp_path / "to"
    (source / "a/b/a").mkdir(parents=True)
    (source / "_delta_log").mkdir()
    (source / "no files").mkdir()
    blob = bytes(range(256)) * 50000
    (source / "a/b/a/x.bin").write_bytes(blob)
    (source / "_delta_log/0.json").write_bytes(b"{}")
    (source / ".hidden").write_bytes(b"h")
    (source / "empty").write_bytes(b"")
    wanted = {("a/b/a/x.bin", len(blob)), ("_delta_log/0.json", 2), (".hidden", 1), ("empty", 0)}
    for location in (str(source), f"file:{str(source).replace(' ', '%20')}/"):
        manifest = files.file_manifest(spark, location)
        assert {(r["relative"], r["length"]) for r in manifest.collect()} == wanted
        assert manifest.where("modified_at IS NULL").isEmpty()
    status = objects.copy_files(manifest, f"file://{target}").collect()
    assert {(r["key"], r["n_bytes"]) for r in status if r["ok"]} == wanted
    assert (target / "a/b/a/x.bin").read_bytes() == blob
    assert sorted(n for _, _, names in os.walk(target) for n in names) == [
        ".hidden",
        "0.json",
        "empty",
        "x.bin",
    ]


def test_copy_reports_failures(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/absent", "x")], "path STRING, relative STRING")
    row = objects.copy_files(rows, str(tmp_path / "to")).first()
    assert not row["ok"] and row["error"]


def test_csv_and_json_keep_odd_values(spark, tmp_path):
    rows = [("a,b", 'say "x"\nnext', None), ("", "\\", "é")]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING")
    sinks.write_json(df, f"{tmp_path}/json")
    back = spark.read.schema(df.schema).json(f"{tmp_path}/json")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    sinks.write_csv(df, f"{tmp_path}/csv")
    import pandas as pd

    parts = [p for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")]
    read = pd.concat(pd.read_csv(tmp_path / "csv" / p, keep_default_na=False) for p in parts)
    assert sorted(map(tuple, read.values)) == sorted(
        [("a,b", 'say "x"\nnext', ""), ("", "\\", "é")]
    )


def test_conversion_report(spark, tmp_path):
    df = spark.createDataFrame(
        [("p", "SCALA", "a\ndisplay(x)")], "path STRING, language STRING, content STRING"
    )
    rows = rewrite.convert_assets(df).withColumn("uploaded", F.lit(False))
    sinks.write_conversion_report(rows, f"{tmp_path}/report")
    row = spark.read.json(f"{tmp_path}/report").first()
    assert row["before_lines"] == ["a", "display(x)"] and row["uploaded"] is False
    assert row["after_lines"][-2:] == ["a", "print(x)"]
    assert [d["op"] for d in row["diffs"][-3:]] == [" ", "-", "+"]


def test_batch_conversion(spark, tmp_path):
    df = spark.createDataFrame(
        [("/a", "SQL", "display(x)"), ("a", "SQL", "display(x)"), ("/../b", "SQL", "y")],
        "path STRING, language STRING, content STRING",
    )
    status = conversion.convert_batch(spark, df, f"{tmp_path}/out", report=f"{tmp_path}/report")
    found = {r["converted_key"]: (r["uploaded"], r["error"]) for r in status.collect()}
    assert found["migrated-notebooks/a"] == (True, None)
    assert found["migrated-notebooks/../b"] == (False, "key leaves the root")
    report = spark.read.json(f"{tmp_path}/report")
    assert sorted((r["path"], r["uploaded"]) for r in report.collect()) == [
        ("/../b", False),
        ("/a", True),
        ("a", True),
    ]
    assert open(tmp_path / "out/migrated-notebooks/a").read() == "print(x)"


def test_latest_result(spark, tmp_path):
    for name, value in (("r_1.json", 1), ("r_3.json", 3), ("other_9.json", 9)):
        spark.range(value, value + 1).write.json(f"{tmp_path}/dir/{name}")
    (tmp_path / "dir/r_2.json").write_text('{"id": 2}\n')
    assert files.read_latest(spark, f"{tmp_path}/dir", "r_*.json").first()["id"] == 3
    (tmp_path / "dir/r_4.json").write_text('{"id": 4}\n')
    assert files.read_latest(spark, f"{tmp_path}/dir", "r_*.json").first()["id"] == 4
    with pytest.raises(FileNotFoundError):
        files.read_latest(spark, f"{tmp_path}/dir", "none_*.json")
    saved = {"notebooks": [{"path": "p"}], "generated_at": "now"}
    (tmp_path / "dir/r_5.json").write_text(json.dumps(saved, indent=2))
    row = files.read_latest(spark, f"{tmp_path}/dir", "r_*.json", multi_line=True).first()
    assert row["notebooks"][0]["path"] == "p" and row["generated_at"] == "now"


def test_pretty_printed_pages(spark, tmp_path):
    for i in range(3):
        page = {"clusters": [{"cluster_id": f"c{i}", "num_workers": i}, {"cluster_id": "x"}]}
        (tmp_path / f"page{i}.json").write_text(json.dumps(page, indent=2))
    rows = listings.read_clusters(spark, str(tmp_path), multi_line=True)
    assert rows.count() == 6 and rows.where("num_workers IS NULL").count() == 3


def test_fallback(spark):
    some, none = spark.range(2), spark.range(0)
    other = spark.range(10, 13)
    assert listings.with_fallback(some, other).count() == 2
    assert listings.with_fallback(none, other).count() == 3


def test_migration_goes_on_after_a_failure(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/data")
    tables = spark.createDataFrame(
        [("c", "s", "bad", f"{tmp_path}/absent"), ("c", "s", "good", f"{tmp_path}/data")],
        "catalog STRING, schema STRING, name STRING, storage_location STRING",
    )
    rows = {r["fq_name"]: r for r in migration.migrate_tables(spark, tables, str(tmp_path)).collect()}
    assert not rows["c.s.bad"]["ok"] and rows["c.s.bad"]["error"]
    assert rows["c.s.good"]["n_rows"] == 7
    assert all(row["sidecar_ok"] for row in rows.values())
    assert spark.read.parquet(f"{tmp_path}/migrated-tables/c/s/good").count() == 7
    assert os.path.exists(tmp_path / "migrated-tables/c/s/bad/schema.json")


def test_validation(spark):
    source = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    swapped = source.withColumn("v", F.when(F.col("id") == 5, 99).otherwise(F.col("v")))
    doubled = source.where("id <> 3").unionAll(source.where("id = 4"))

    def check(copy, **args):
        row = migration.validate_export(source, copy, **args).first()
        return row["count_ok"], row["schema_ok"], row["content_ok"]

    assert check(source.repartition(7).select("v", "id")) == (True, True, True)
    assert check(swapped.select("id", "v")) == (True, True, False)
    assert check(doubled) == (True, True, False)
    assert check(source.unionAll(source.limit(2))) == (False, True, False)
    assert check(source, keys=["id"], pct=20.0) == (True, True, True)
    missed = migration.validate_export(source, swapped, keys=["id"], pct=100.0).first()
    assert not missed["content_ok"]


def test_validation_of_nested_values(spark, tmp_path):
    source = spark.range(50).selectExpr(
        "id", "map('a', id) AS m", "array(struct(id AS x, map(id, 'y') AS z)) AS `n.s`"
    )
    source.write.parquet(f"{tmp_path}/copy")
    copy = spark.read.parquet(f"{tmp_path}/copy")
    assert tuple(migration.validate_export(source, copy).first()) == (50, 50, True, True, True)
    other = copy.withColumn("m", F.expr("map('a', id + 1)"))
    assert not migration.validate_export(source, other).first()["content_ok"]


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame(
        [("a", "PYTHON", "ZGlzcGxheSh4KQ=="), ("b", "SQL", "A"), ("c", "SQL", None)],
        "path STRING, language STRING, content STRING",
    )
    rows = {r["path"]: r for r in conversion.convert_with_errors(df).collect()}
    assert rows["a"]["body"] == "print(x)" and rows["a"]["error"] is None
    assert rows["b"]["after"] is None and rows["b"]["error"]
    assert rows["c"]["converted_key"] is None and rows["c"]["error"]


def test_scope(spark):
    paths = ["/a/x", "/a/b/y", "/ab/z", "/top"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")

    def found(prefix, recursive):
        return sorted(r[0] for r in listings.scope_assets(df, prefix, recursive).collect())

    assert found("/", True) == sorted(paths) and found("/", False) == ["/top"]
    assert found("/a/", True) == ["/a/b/y", "/a/x"] and found("/a", False) == ["/a/x"]


def test_metastore_listing(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS listed")
    spark.range(3).write.mode("overwrite").saveAsTable("listed.numbers")
    try:
        rows = listings.enumerate_metastore(spark).where("name = 'numbers'").collect()
        assert [(r["schema"], r["table_type"]) for r in rows] == [("listed", "MANAGED")]
        assert files.read_table(spark, "listed.numbers").count() == 3
    finally:
        spark.sql("DROP DATABASE listed CASCADE")
    with pytest.raises(ValueError):
        files.read_table(spark, "listed.numbers")


def test_full_analysis_of_an_export(spark, tmp_path):
    """The whole path on hand-written listings: bad sources dropped, formats kept, times filled."""

    def page(name, rows, key):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "p.json").write_text(json.dumps({key: rows}) + "\n")

    page(
        "assets",
        [
            {"object_type": "NOTEBOOK", "path": "/a", "created_time": 1704067200000, "owner": ""},
            {"object_type": "NOTEBOOK", "path": "/b", "object_meta": {"owner": "eve"}},
            {"object_type": "DIRECTORY", "path": "/c"},
        ],
        "objects",
    )
    (tmp_path / "in/bodies").mkdir()
    bodies = [{"path": "/a", "content": "ZGlzcGxheSh4KQ=="}, {"path": "/b", "content": "?"}]
    (tmp_path / "in/bodies/p.json").write_text("\n".join(map(json.dumps, bodies)))
    page("tables", [{"name": "csv", "format": "CSV"}, {"name": "x"}], "tables")
    page("jobs", [{"job_id": 3, "settings": {"schedule": {"cron": "0 1"}}}], "jobs")
    page("clusters", [{"cluster_id": "c", "autoscale": {"min_workers": 2}}], "clusters")
    parts = analysis.run_full(spark, f"{tmp_path}/in", f"{tmp_path}/out", "now")
    asset = parts["assets"].first()
    assert (asset["path"], asset["language"], asset["size"]) == ("/a", "PYTHON", 10)
    assert asset["modified_at"] == "2024-01-01T00:00:00Z" and asset["generated_at"] == "now"
    found = parts["analyses"].first()
    assert found["detected_patterns"] == ["display"] and found["size"] == 10
    table = parts["tables"].first()
    assert (table["name"], table["table_type"], table["columns"]) == ("x", "MANAGED", [])
    assert parts["tables"].count() == 1
    job = parts["jobs"].first()
    assert (job["name"], job["schedule"]) == ("job_3", "0 1")
    assert parts["clusters"].first()["autoscale"]["min_workers"] == 2
    assert analysis.run_quick(spark, f"{tmp_path}/in").first()["n"] == 1
    other = spark.createDataFrame([], parts["tables"].drop("generated_at").schema)
    again = analysis.run_full(
        spark, f"{tmp_path}/in", f"{tmp_path}/o2", "now", "ORC", other_tables=other
    )
    assert [r["name"] for r in again["tables"].collect()] == ["x"]
