from pyspark.sql import functions as F

from spanforge.operators.kmeans import IntervalKMeans
from spanforge.streaming.assign import cluster_counts
from tests.helpers import SIMPLE, frame


def test_counts_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    f = frame(spark, SIMPLE)
    model = IntervalKMeans(2, n_init=2).fit(f)
    timed = f.df.withColumn("at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, row_id * 7)"))
    last = timed.limit(1).withColumn("at", F.expr("timestamp '2024-01-02 00:00:00'"))  # closes the windows before it
    timed.write.parquet(str(tmp_path / "in"))
    query = cluster_counts(spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), model, "at").writeStream.outputMode("append")
    query = query.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start().awaitTermination()
    last.write.mode("append").parquet(str(tmp_path / "in"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, cluster_counts(timed, model, "at").collect())) and len(got) >= 4
