"""Large files in ranges, whole tables as files, and the listing they start from."""

import os
import re

import pytest
from pyspark.sql import functions as F

from transhume.operators import joins
from transhume.plans import migration, table_files
from transhume.sinks import objects, parts
from transhume.sources import files

MANIFEST = "path STRING, relative STRING, length BIGINT, modified_at TIMESTAMP"


def source_files(folder):
    sizes = {"empty": 0, "one": 1, "even": 4000, "odd": 4001, "long/é x": 100_003}
    for name, size in sizes.items():
        place = folder / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(os.urandom(size))
    return sizes


def written(folder):
    return {
        os.path.relpath(os.path.join(at, name), folder): open(os.path.join(at, name), "rb").read()
        for at, _, names in os.walk(folder)
        for name in names
    }


def test_long_files_are_copied_by_many_tasks(spark, tmp_path):
    sizes = source_files(tmp_path / "from")
    manifest = files.file_manifest(spark, str(tmp_path / "from"))
    cut = parts.ranges(manifest, 1000).where("key = 'long/é x'")
    assert cut.count() == 101 and cut.agg(F.sum("size")).first()[0] == 100_003
    dealt = cut.repartition(8, "stamp", "part").select(F.spark_partition_id()).distinct()
    assert dealt.count() > 1
    status = parts.copy_large(manifest, str(tmp_path / "to"), 1000).collect()
    assert {(r["key"], r["n_bytes"]) for r in status if r["ok"]} == set(sizes.items())
    assert written(tmp_path / "to") == written(tmp_path / "from")
    assert not os.listdir(tmp_path / "to/.parts")


def test_only_missing_ranges_are_copied_again(spark, tmp_path):
    source_files(tmp_path / "from")
    manifest = files.file_manifest(spark, str(tmp_path / "from")).where("relative = 'odd'")
    root = f"file:{tmp_path}/to"
    cut = parts.ranges(manifest, 1000)
    first = {r["part"]: r for r in parts.copy_ranges(cut, root).collect()}
    assert sorted(first) == [0, 1, 2, 3, 4] and not any(r["reused"] for r in first.values())
    place = tmp_path / "to/.parts" / first[0]["stamp"]
    os.remove(place / "00000002")
    (place / "00000003").write_bytes(b"short")  # left half
    again = {r["part"]: r for r in parts.copy_ranges(cut, root).collect()}
    assert [again[i]["reused"] for i in range(5)] == [True, True, False, False, True]
    assert {i: r["crc"] for i, r in again.items()} == {i: r["crc"] for i, r in first.items()}
    assert all(r["ok"] for r in parts.copy_large(manifest, root, 1000).collect())
    assert written(tmp_path / "to")["odd"] == written(tmp_path / "from")["odd"]


def test_a_range_that_changed_is_not_put_together(spark, tmp_path):
    source_files(tmp_path / "from")
    manifest = files.file_manifest(spark, str(tmp_path / "from")).where("relative = 'odd'")
    root = f"file:{tmp_path}/to"
    done = parts.copy_ranges(parts.ranges(manifest, 1000), root).collect()
    kept = spark.createDataFrame(done, parts.RANGE_STATUS)
    (tmp_path / "to/.parts" / done[0]["stamp"] / "00000001").write_bytes(bytes(1000))
    gathered = F.sort_array(F.collect_list(F.struct("part", "n_bytes", "crc")))
    rows = kept.groupBy("key", "stamp").agg(
        gathered.alias("p"), F.sum("n_bytes").alias("length"), F.min("error").alias("error")
    )
    rows = rows.selectExpr("key", "stamp", "length", "error", "p.n_bytes AS sizes", "p.crc AS crcs")
    row = parts.assemble(rows, root).first()
    assert not row["ok"] and "range 1 has changed" in row["error"]
    assert not os.path.exists(tmp_path / "to/odd")


def test_failures_of_ranges(spark, tmp_path):
    source_files(tmp_path / "from")
    rows = [
        (f"{tmp_path}/from/absent", "absent", 5000, None),
        (f"{tmp_path}/from/odd", "shorter than listed", 9000, None),
        (f"{tmp_path}/from/odd", "../out", 4001, None),
        (f"{tmp_path}/from/odd", "fine", 4001, None),
    ]
    status = parts.copy_large(spark.createDataFrame(rows, MANIFEST), str(tmp_path / "to"), 1000)
    found = {r["key"]: (r["ok"], r["error"]) for r in status.collect()}
    assert {key for key, (ok, _) in found.items() if ok} == {"fine"}
    assert all(error for ok, error in found.values() if not ok) and len(found) == 4
    with pytest.raises(ValueError):
        parts.ranges(spark.createDataFrame(rows, MANIFEST), 0)


def test_differing_copies_are_found(spark, tmp_path):
    source_files(tmp_path / "from")
    manifest = files.file_manifest(spark, str(tmp_path / "from"))
    parts.copy_large(manifest, str(tmp_path / "to"), 1000).collect()
    place = tmp_path / "to/long/é x"
    data = bytearray(place.read_bytes())
    data[50_500] ^= 1
    data[99_999] ^= 1
    place.write_bytes(data)
    os.remove(tmp_path / "to/one")
    (tmp_path / "to/even").write_bytes((tmp_path / "to/even").read_bytes() + b"more")
    (tmp_path / "to/empty").write_bytes(b"more")
    found = {tuple(r) for r in parts.compare_files(manifest, str(tmp_path / "to"), 1000).collect()}
    assert found == {
        ("long/é x", 101, 2, 50_000),
        ("one", 1, 1, 0),
        ("even", 4, 1, 3000),
        ("empty", 1, 1, 0),
        ("odd", 5, 0, None),
    }


def test_empty_manifest(spark, tmp_path):
    none = spark.createDataFrame([], MANIFEST)
    assert parts.copy_large(none, str(tmp_path / "to")).count() == 0
    assert parts.compare_files(none, str(tmp_path / "to")).count() == 0
    assert table_files.copy_tables(
        spark.createDataFrame([], "dest_key STRING, location STRING"), str(tmp_path / "to")
    ).isEmpty()


def test_walk_from_many_starts(spark, tmp_path):
    source_files(tmp_path / "from")
    rows = [
        (f"file:{tmp_path}/from", "a"),
        (f"file:{tmp_path}/from/long", "b"),
        (f"file:{tmp_path}/from/one", "c"),  # a file
        (f"file:{tmp_path}/nothing", "d"),
    ]
    starts = spark.createDataFrame(rows, "path STRING, relative STRING")
    found = {r["relative"] for r in files.walk(spark, starts, must_exist=False).collect()}
    assert found == {"a/empty", "a/one", "a/even", "a/odd", "a/long/é x", "b/é x", "c/one"}
    with pytest.raises(Exception, match="nothing"):
        files.walk(spark, starts).count()


def test_tables_are_moved_as_files(spark, tmp_path):
    spark.range(50).withColumn("p", F.col("id") % 3).write.partitionBy("p").parquet(f"{tmp_path}/in/parts")
    spark.range(7).repartition(3).write.parquet(f"{tmp_path}/in/plain")
    spark.range(9).coalesce(1).write.parquet(f"{tmp_path}/in/single")
    single = next((tmp_path / "in/single").glob("part-*.parquet"))
    (tmp_path / "in/plain/nested").mkdir()
    (tmp_path / "in/plain/nested/x.parquet").write_bytes(b"Spark does not read this")
    spark.range(5).write.parquet(f"{tmp_path}/in/logged")
    (tmp_path / "in/logged/_delta_log").mkdir()
    (tmp_path / "in/logged/_delta_log/0.json").write_text("{}")
    (tmp_path / "in/broken").mkdir()
    (tmp_path / "in/broken/x.parquet").write_text("not Parquet")
    (tmp_path / "in/none").mkdir()
    out = f"{tmp_path}/out"
    # what an earlier export left
    spark.range(1000).repartition(5).write.parquet(f"{out}/migrated-tables/c/s/plain")
    spark.range(3).write.parquet(f"{out}/migrated-tables/c/s/broken")
    rows = [
        ("c", "s", "parts", f"{tmp_path}/in/parts", "parquet"),
        ("c", "s", "plain", f"file:{tmp_path}/in/plain", "PARQUET"),
        ("c", "s", "one/file", str(single), "Parquet"),
        ("c", "s", "logged", f"{tmp_path}/in/logged", "parquet"),
        ("c", "s", "broken", f"{tmp_path}/in/broken", "parquet"),
        ("c", "s", "none", f"{tmp_path}/in/none", "parquet"),
        ("c", "s", "gone", f"{tmp_path}/in/gone", "parquet"),
        ("c", "s", "by job", f"{tmp_path}/in/plain/part*", "parquet"),
        ("c", "s", "job", f"{tmp_path}/in/plain", None),
        ("c", "s", "self", f"{out}/migrated-tables/c/s/self/p=1", "parquet"),
    ]
    spark.range(4).write.parquet(f"{out}/migrated-tables/c/s/self/p=1")
    tables = spark.createDataFrame(
        rows, "catalog STRING, schema STRING, name STRING, storage_location STRING, data_source_format STRING"
    )
    status = {
        r["fq_name"][4:]: (r["ok"], r["n_rows"], r["error"])
        for r in migration.migrate_tables(spark, tables, out).collect()
    }
    fine = {name: n for name, (ok, n, _) in status.items() if ok}
    assert fine == {"parts": 50, "plain": 7, "one/file": 9, "by job": 7, "job": 7}
    assert status["logged"][2] == table_files.LOGGED and status["none"][2] == table_files.NO_FILES
    assert status["gone"][2] == table_files.NO_FILES and status["broken"][2]
    assert status["self"][2] == table_files.INSIDE
    for name, n in fine.items():
        place = tmp_path / "out/migrated-tables/c/s" / name
        assert spark.read.parquet(str(place)).count() == n
        assert (place / "_schema.json").exists()
    assert spark.read.parquet(f"{out}/migrated-tables/c/s/parts").where("p = 1").count() == 17
    assert spark.read.parquet(f"{out}/migrated-tables/c/s/self/p=1").count() == 4
    assert (tmp_path / "out/migrated-tables/c/s/gone/schema.json").exists()


def test_moves_verify_their_bytes(spark, tmp_path, monkeypatch):
    spark.range(100).repartition(2).write.parquet(f"{tmp_path}/in")
    tables = spark.createDataFrame([("k", f"{tmp_path}/in")], "dest_key STRING, location STRING")
    row = table_files.copy_tables(tables, f"{tmp_path}/out", part_bytes=300, verify=True).first()
    assert row["ok"] and row["n_rows"] == 100 and row["n_files"] == 2


def test_texts_by_their_keys(spark, tmp_path):
    texts = spark.createDataFrame([("a/é", "x\ny"), ("b", "")], "key STRING, body STRING")
    objects.put_texts(texts, str(tmp_path), "key", "body").collect()
    keys = spark.createDataFrame([("a/é",), ("b",), ("absent",), ("../b",)], "key STRING")
    found = {tuple(r) for r in objects.get_texts(keys, str(tmp_path)).collect()}
    assert found == {("a/é", "x\ny"), ("b", ""), ("absent", None), ("../b", None)}


def test_bodies_are_scanned_once(spark, tmp_path):
    """Also where only the count is wanted; and the one that stays doesn't depend on the order."""
    bodies = spark.range(100).selectExpr("concat('p', id % 40) AS path", "concat('text ', id) AS content")
    bodies.write.parquet(f"{tmp_path}/bodies")
    stored = spark.read.parquet(f"{tmp_path}/bodies")
    listing = spark.range(40).selectExpr("concat('p', id) AS path")
    rows = joins.with_body(listing, stored)
    for df in (rows, rows.groupBy().count()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet", plan)) == 1
    turned = joins.with_body(listing, stored.orderBy(F.desc("content")))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, turned.collect()))
    assert rows.count() == 40
