from pyspark.sql import functions as F

from panelforge.streaming import sessions


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 02:00:00", 2.0), (1, "2024-01-02 00:00:00", 3.0), (2, "2024-01-01 00:00:00", 4.0), (9, "2024-03-01 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in sessions.gap_sessions(df).where("user_id < 9").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.gap_sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("sessions_out").where("user_id < 9").collect()}
    assert batch == got and len(batch) == 3
