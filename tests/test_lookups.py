from pyspark.sql import functions as F

from courtside.sources.tables import with_blooms


def rows_scanned(frame) -> int:
    """Rows that the scan gave to the plan, by its own metric, after the query has run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_an_absent_name_reads_no_rows_where_ranges_overlap(spark, tmp_path):
    # Each file spans the whole range of names, and no dictionary tells what it holds.
    rows = spark.range(20_000).select("id", F.concat(F.lit("n"), F.sha2(F.col("id").cast("string"), 256)).alias("player_name"))
    for kind in ("plain", "blooms"):
        writer = rows.repartition(4, "id").write.option("parquet.enable.dictionary", "false")
        (with_blooms(writer, ["player_name"], 10_000) if kind == "blooms" else writer).parquet(f"{tmp_path}/{kind}")
    absent = "n8" + "0" * 63
    present = rows.where("id = 77").first().player_name
    looked_up = {
        kind: [rows_scanned(spark.read.parquet(f"{tmp_path}/{kind}").where(F.col("player_name") == name)) for name in (absent, present)]
        for kind in ("plain", "blooms")
    }
    assert looked_up["plain"][0] > 0 and looked_up["blooms"][0] == 0
    assert 0 < looked_up["blooms"][1] < looked_up["plain"][1]
    found = spark.read.parquet(f"{tmp_path}/blooms").where(F.col("player_name") == present)
    assert [row.id for row in found.collect()] == [77]
