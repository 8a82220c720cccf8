"""Analysis by distinct content: same rows as a whole scan, and only what is new is scanned."""

import base64
import json
import os

from pyspark.sql import functions as F

from transhume import values
from transhume.operators import scan
from transhume.plans import analysis, incremental
from transhume.values import Rule

KIND = "path STRING, language STRING, content STRING, size LONG"
ROWS = [
    *[(f"/p{i}", "SQL", f"line {i % 7}\n" + "dbutils.fs\n" * (i % 3), i) for i in range(40)],
    *[(f"/copy{i}", None, "display(x)\n", i) for i in range(30)],
    ("/null", None, None, None), ("/empty", "R", "", 0), (None, None, "é %sql", 1), ("/p1", "SQL", "again", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def same(found, plain):
    assert set(found.columns) == set(plain.columns)
    assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def stored(spark, store, rules=values.RULES, bounds=values.SIZE_BOUNDS):
    path = f"{store}/rules={incremental.rule_version(rules, bounds)}"
    return spark.read.schema(incremental.RESULT).parquet(path)


def test_second_run_scans_changed_sources_only(spark, tmp_path):
    store, df = f"{tmp_path}/store", frame(spark, ROWS)
    same(incremental.analyze(df, store, keep=["size"]), scan.analyze_assets(df, keep=["size"]))
    n = len({row[2] or "" for row in ROWS})
    assert stored(spark, store).count() == n
    before = set(os.listdir(f"{store}/rules={incremental.rule_version()}"))
    assert incremental.add_results(df, store) == 0
    assert set(os.listdir(f"{store}/rules={incremental.rule_version()}")) == before
    changed = [(p, lang, f"{c}spark.read" if p in ("/p3", "/p4", "/copy1") else c, s) for p, lang, c, s in ROWS]
    assert incremental.add_results(frame(spark, changed), store) == 3
    assert stored(spark, store).count() == n + 3
    same(incremental.analyze(frame(spark, changed), store), scan.analyze_assets(frame(spark, changed)))


def test_old_results_are_read_not_made_again(spark, tmp_path):
    store, df = f"{tmp_path}/store", frame(spark, ROWS)
    incremental.add_results(df, store)
    marked = stored(spark, store).withColumn("summary", F.lit("from the store")).collect()
    other = f"{tmp_path}/other"
    spark.createDataFrame(marked, incremental.RESULT).write.parquet(f"{other}/rules={incremental.rule_version()}")
    new = [*ROWS, ("/new", "SQL", "brand new", 3)]
    rows = incremental.analyze(frame(spark, new), other).collect()
    assert {r["path"] for r in rows if r["summary"] != "from the store"} == {"/new"}


def test_other_rules_have_results_of_their_own(spark, tmp_path):
    store, df = f"{tmp_path}/store", frame(spark, ROWS)
    rules = [Rule("line", "line [0-3]", ("line",), issue="is a line")]
    incremental.add_results(df, store)
    same(incremental.analyze(df, store, rules, (1, 2)), scan.analyze_assets(df, rules, (1, 2)))
    same(incremental.analyze(df, store), scan.analyze_assets(df))
    versions = {incremental.rule_version(r, b) for r in (rules, values.RULES) for b in ((1, 2), (100, 500))}
    assert len(versions) == 4


def test_empty_repeated_and_stored_twice(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert incremental.analyze(frame(spark, []), store).collect() == []
    assert not os.path.exists(store)
    twice = frame(spark, ROWS + ROWS)
    same(incremental.analyze(twice, store), scan.analyze_assets(twice))
    version = incremental.rule_version()
    stored(spark, store).write.mode("append").parquet(f"{store}/copy")
    spark.read.parquet(f"{store}/copy").write.mode("append").parquet(f"{store}/rules={version}")
    same(incremental.analyze(twice, store), scan.analyze_assets(twice))


def test_snapshot_is_the_same_with_stored_results(spark, tmp_path):
    def page(folder, key, items):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "p.json").write_text(json.dumps({key: items}))

    page("assets", "objects", [{"object_type": "NOTEBOOK", "path": p} for p in ("/a", "/b")])
    (tmp_path / "in/bodies").mkdir()
    bodies = [{"path": p, "content": base64.b64encode(b"display(x)").decode()} for p in ("/a", "/b")]
    (tmp_path / "in/bodies/p.json").write_text("\n".join(map(json.dumps, bodies)))
    page("tables", "tables", [{"name": "x"}])
    page("jobs", "jobs", [{"job_id": 3}])
    page("clusters", "clusters", [{"cluster_id": "c"}])
    run = [
        analysis.run_full(spark, f"{tmp_path}/in", f"{tmp_path}/out{i}", "now", results=results)["analyses"]
        for i, results in enumerate([None, f"{tmp_path}/store", f"{tmp_path}/store"])
    ]
    same(run[1], run[0])
    same(run[2], run[0])
    assert run[0].count() == 2 and stored(spark, f"{tmp_path}/store").count() == 1
