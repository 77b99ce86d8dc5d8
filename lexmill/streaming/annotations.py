"""The annotation log as a stream: running item means with late rows and duplicates handled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas


def read_annotations(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder that annotation files are added to, or a single file."""
    reader = spark.readStream.schema(schemas.ANNOTATIONS).option("maxFilesPerTrigger", files_per_trigger)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(folder)


def running_means(stream: DataFrame) -> DataFrame:
    """(item_id, n_labels, mean_label), updated with every batch; the state has a row for each item."""
    return stream.filter("label is not null").groupBy("item_id").agg(F.count("*").alias("n_labels"), F.avg("label").alias("mean_label"))


def hourly_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """(hour, annotator_id, n): labels by hour and annotator; rows later than the delay are dropped, rows sent
    twice count once."""
    timed = stream.filter("created_at is not null").withWatermark("created_at", delay)
    once = timed.dropDuplicatesWithinWatermark(["item_id", "annotator_id", "created_at"])
    return once.groupBy(F.window("created_at", "1 hour").alias("w"), "annotator_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "annotator_id", "n")


def run_to_end(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Processes all that is available and returns the result table (in memory; for bounded results)."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def upsert_means(stream: DataFrame, target: str, checkpoint: str):
    """Writes each batch's changed means to its own folder of ``target``; the last folder of an item wins."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return running_means(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_means(spark: SparkSession, target: str) -> DataFrame:
    df = spark.read.parquet(target)
    return df.groupBy("item_id").agg(F.max_by(F.struct("n_labels", "mean_label"), "batch").alias("m")).select("item_id", "m.*")
