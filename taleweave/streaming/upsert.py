"""Resumable upsert of chapter drafts: micro-batches merged into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taleweave.operators.resolve import upsert


def start_upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str], fill: list[str]) -> StreamingQuery:
    """Merge every micro-batch of ``stream`` (keys, fill, ord) into versions of a table under ``target``.

    A version is written under its batch id, so a batch that is replayed after a
    failure overwrites its own version and reads the one before it: the state
    after a replay is the state before.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        known = versions(spark, target)
        before = [v for v in known if v < epoch]
        state = spark.read.parquet(f"{target}/v={before[-1]}") if before else batch.select(*keys, *fill).limit(0)
        upsert(state, batch, keys, fill).write.mode("overwrite").parquet(f"{target}/v={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def latest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v={versions(spark, target)[-1]}")


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with late rows up to the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
