from tessella.streaming.running import run_minmax


def test_running_minmax(spark, tmp_path):
    source = str(tmp_path / "in")
    for k, values in enumerate([[3.0, 4.0], [1.0, 9.0]]):
        spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(source)
        run_minmax(stream, ["v"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out" / "version=1")).first()
    assert (row["data_min"], row["data_max"]) == (1.0, 9.0)
