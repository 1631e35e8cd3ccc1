"""Incremental forms of the batch merges on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(stream: DataFrame, key: str, order: list[str], rest: list[str]) -> DataFrame:
    """The last row by key, kept as state; use output mode ``update`` or ``complete``."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def run_upsert(stream: DataFrame, table_path: str, checkpoint: str, key: str, order: list[str]):
    """Fold each micro-batch into the table at ``table_path``: the last row by key wins.

    Versions are numbered by micro-batch, so a batch that is run again after a failure writes the same version again. The last two versions
    stay: the one before is what a batch that is run again starts from. A run without new data gives the table as it is.
    """
    spark = stream.sparkSession
    path = lambda v: f"{table_path}/v={v:012d}"
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions() -> list[int]:
        """Versions that were written whole."""
        if not fs.exists(root):
            return []
        names = [x.getPath() for x in fs.listStatus(root)]
        return sorted(int(x.getName()[2:]) for x in names if x.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def fold(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != key]
        before = [v for v in versions() if v < epoch]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(path(before[-1]))) if before else batch
        merged = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")
        merged.write.mode("overwrite").parquet(path(epoch))
        for old in before[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(path(old)), True)

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = versions()
    return spark.read.schema(stream.schema).parquet(path(found[-1])) if found else spark.createDataFrame([], stream.schema)


def accept_revisions(edits: DataFrame, stored: DataFrame, record: str, base: str) -> DataFrame:
    """Edits with the revision they make, or ``stale``: where their base isn't the record's stored revision (0 without one), or another edit of it came first (by ``edit_id``)."""
    now = stored.select(F.col(record).alias("__record"), F.col("revision").alias("__now"))
    joined = edits.join(now, F.col(record) == F.col("__record"), "left")
    current = F.col(base) == F.coalesce("__now", F.lit(0))
    order = F.row_number().over(Window.partitionBy(record, current).orderBy("edit_id"))
    marked = joined.withColumn("stale", ~current | (order > 1))
    return marked.select(*edits.columns, "stale", F.when(~F.col("stale"), F.col(base) + 1).alias("revision"))
