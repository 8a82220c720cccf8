"""Table moves with clashes and repeats, file addresses, and repeated bodies."""

import pytest
from pyspark.sql import functions as F

from transhume import storage
from transhume.operators import joins
from transhume.plans import migration
from transhume.sinks import objects
from transhume.sources import files
from workload import q_jobs


def test_every_listed_table_has_a_status(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        spark.range(n).write.parquet(f"{tmp_path}/in/{name}")
    rows = [
        ("c", "s", "one", f"{tmp_path}/in/a"),
        ("c", "s", "one", f"{tmp_path}/in/a"),  # listed twice
        ("c", "s", "two", f"{tmp_path}/in/a"),
        ("c", "s", "two", f"{tmp_path}/in/b"),  # another place, same key
        ("c", "s", "gone", f"{tmp_path}/in/none"),
        (None, None, None, f"{tmp_path}/in/a"),
        (None, None, None, f"{tmp_path}/in/b"),  # both without names
    ]
    tables = spark.createDataFrame(
        rows, "catalog STRING, schema STRING, name STRING, storage_location STRING"
    )
    status = migration.migrate_tables(spark, tables, f"{tmp_path}/out", batch=1).collect()
    assert len(status) == len(rows)
    found = sorted((r["dest_key"].rsplit("/", 1)[1], r["ok"], r["n_rows"]) for r in status)
    assert found == sorted(
        [("one", True, 3)] * 2 + [("two", False, None)] * 2 + [("gone", False, None)]
        + [("table", False, None)] * 2
    )
    assert {r["error"] for r in status if r["dest_key"].endswith("two")} == {migration.CLASH}


def test_addresses(spark, tmp_path):
    assert storage.resolve(spark, "s3a://bucket/key") == "s3://bucket/key"
    assert storage.resolve(spark, "hdfs://nn:8020/a") == "hdfs://nn:8020/a"
    assert storage.resolve(spark, str(tmp_path)) == f"file:{tmp_path}"
    with pytest.raises(ValueError):
        storage.open_root(str(tmp_path))


class Cluster:
    """The session as on a cluster, whose shared folder is a path without scheme."""

    def __init__(self, spark):
        self.spark, self.conf = spark, self

    def get(self, key, *default):
        return "spark://host:7077" if key == "spark.master" else self.spark.conf.get(key, *default)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_paths_without_scheme_on_a_cluster(spark, tmp_path):
    assert storage.resolve(Cluster(spark), str(tmp_path)) == f"file:{tmp_path}"
    (tmp_path / "migration_results_1.json").write_text('{"id": 1}\n')
    assert files.latest_path(Cluster(spark), str(tmp_path), "*.json").endswith("_1.json")


def test_mounted_folders_are_listed_copied_and_read(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x.txt").write_text("one")
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.moves.link./given", f"file://{tmp_path}/in")
    hadoop.set("fs.viewfs.mounttable.moves.link./given/far", f"file://{tmp_path}/far")
    try:
        assert storage.resolve(spark, "viewfs://moves/given/far/a") == f"file://{tmp_path}/far/a"
        assert storage.resolve(spark, "viewfs://moves/givenness") == "viewfs://moves/givenness"
        found = files.file_manifest(spark, "viewfs://moves/given")
        assert [r["relative"] for r in found.collect()] == ["d/x.txt"]
        named = found.withColumn("path", F.concat(F.lit("viewfs://moves/given/"), "relative"))
        out = "viewfs://moves/given/far"
        assert [r["ok"] for r in objects.copy_files(named, out).collect()] == [True]
        texts = objects.get_texts(found.select(F.col("relative").alias("key")), out)
        assert [r["text"] for r in texts.collect()] == ["one"]
    finally:
        hadoop.unset("fs.viewfs.mounttable.moves.link./given")
        hadoop.unset("fs.viewfs.mounttable.moves.link./given/far")


def test_repeated_bodies_do_not_multiply(spark):
    listing = spark.createDataFrame([("p",), ("p",), ("q",), ("r",)], "path STRING")
    bodies = spark.createDataFrame(
        [("p", "one"), ("p", "one"), ("p", "other"), ("q", "x"), ("r", ""), ("s", "y")],
        "path STRING, content STRING",
    )
    rows = joins.with_body(listing, bodies).groupBy("path").agg(
        F.count("*").alias("n"), F.count_distinct("content").alias("k")
    )
    assert sorted(map(tuple, rows.collect())) == [("p", 2, 1), ("q", 1, 1)]


def test_latest_result_in_a_store_that_only_spark_reads(spark, tmp_path):
    for name, number in (("r_1.json", 1), ("r_3.json", 3), ("other_9.json", 9)):
        spark.range(number, number + 1).write.json(f"{tmp_path}/{name}")
    spark.range(2, 3).coalesce(1).write.json(f"{tmp_path}/r_2.json")
    hadoop = spark._jsc.hadoopConfiguration()
    given = {
        "fs.onlyspark.impl": "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme",
        "fs.viewfs.overload.scheme.target.onlyspark.impl": "org.apache.hadoop.fs.LocalFileSystem",
        "fs.viewfs.mounttable.results.link./saved": f"file://{tmp_path}",
    }
    for key, value in given.items():
        hadoop.set(key, value)
    try:
        rows = files.read_latest(spark, "onlyspark://results/saved", "r_*.json").collect()
        assert [row["id"] for row in rows] == [3]
        assert files.latest_path(spark, "onlyspark://results/saved", "none_*.json") is None
    finally:
        for key in given:
            hadoop.unset(key)


def test_copies_of_tables_that_are_folders_are_compared(spark, tmp_path):
    for name, key in q_jobs.KEYS.items():
        rows = spark.range(1, 4).select(F.col("id").alias(key), F.lit("x").alias("other"))
        rows.repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    found = q_jobs.sink_copy(spark, str(tmp_path)).collect()
    assert {(r["name"], r["n_rows"], r["key_sum"], r["n_differing"]) for r in found} == {
        (name, 3, 6, 0) for name in q_jobs.KEYS
    }
    assert len(found) == len(q_jobs.KEYS)


def test_a_table_that_is_not_moved_is_a_row_of_the_migration(spark, tmp_path):
    for name, key in q_jobs.KEYS.items():
        rows = spark.range(1, 4).select(F.col("id").alias(key), F.lit("x").alias("other"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "nation.parquet" / "_delta_log").mkdir()
    (tmp_path / "nation.parquet" / "_delta_log" / "0.json").write_text("{}")
    found = q_jobs.job_migrate(spark, str(tmp_path)).collect()
    rows = {r["fq_name"].rsplit(".", 1)[1]: tuple(r)[1:] for r in found}
    assert len(found) == len(rows) == len(q_jobs.KEYS) + 2
    for name in ("nation", "absent", "gone"):
        assert rows.pop(name) == (None, False, None, None, True)
    assert set(rows.values()) == {(3, True, 3, 6, True)}


def test_a_sidecar_that_is_not_written_is_a_row(spark, tmp_path):
    rows = [(1, "one", "b", "t", 1, 1.5), (2, "two", "b" * 300, "t", 1, 1.5), (3, "three", "b", "t", 1, 1.5)]
    part = spark.createDataFrame(
        rows,
        "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    )
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = q_jobs.sink_sidecar(spark, str(tmp_path)).collect()
    assert sorted((r["ok"], r["whole"], r["name"]) for r in found if r["ok"]) == [(True, True, "t1"), (True, True, "t3")]
    failed = [(r["whole"], r["name"], r["n_members"]) for r in found if not r["ok"]]
    assert failed == [(None, None, None)]
