"""The row-wise operators take a streaming DataFrame as it is."""

from pyspark.sql import functions as F

from transhume.operators import rewrite, scan
from workload import views


def test_scan_and_diff_of_a_stream(spark, tmp_path):
    assets = views.assets(spark, "/root/testdata/sf0.001")
    assets.write.parquet(f"{tmp_path}/assets")

    def work(df):
        scanned = scan.analyze_assets(df).select("path", F.col("risk").alias("text"))
        diff = rewrite.line_diff(rewrite.convert_assets(df)).where("op <> ' '")
        return scanned.unionByName(diff.select("path", F.col("line").alias("text")))

    stream = spark.readStream.schema(assets.schema).parquet(f"{tmp_path}/assets")
    query = (
        work(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    query.awaitTermination(120)
    query.stop()
    expected = work(assets)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == expected.count()
    assert found.exceptAll(expected).isEmpty()
