from pyspark.sql import functions as F

from tessera.streaming import windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id").cast("int") * 7)).alias("ts"), (F.col("id") % 3).alias("k"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    show = lambda d: sorted((r["window"].start, r["k"], r["n"]) for r in d.collect())
    assert show(spark.table("counts")) == show(windowed_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", ["k"]))
