"""What several of the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one or two longs up to this count may be broadcast (hashed, some 30 MB); larger sets are joined by shuffling.
BROADCAST_IDS = 500_000
#: Bytes of texts in a batch sent to Python.
BATCH_BYTES = 16 << 20
_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attesta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with bounded rows and bytes in a batch sent to Python: whole texts are large, and a worker's memory is not.

    The two settings belong to the session: Spark has none for a single DataFrame.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, str(most))
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/attesta-{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage without tying the rows to any executor; a lost executor
    costs nothing but its running tasks. ``drop`` deletes the table; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        _delete(table.cut_path)


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_left() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may have ended before
            _left.pop(path, None)


def shield(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column under a working name that clashes with none, and these names by column."""
    every = {c: f"__in{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in every.items()]), every


def unshield(found: DataFrame, names: dict[str, str], out: list[str]) -> DataFrame:
    """The input's columns under their own names, but for those that ``out`` replaces, and the columns ``out``."""
    return found.select(*[F.col(n).alias(c) for c, n in names.items() if c not in out], *out)


def given_name(id_col: str, out: list[str]) -> str:
    """The name under which ids are given back: ``id_col``, or with ``_in`` after it where an output column has that name."""
    while id_col in out:
        id_col += "_in"
    return id_col


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi (or anti) join on a distinct id column, broadcast only when counted small."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def hash32(*columns: Column | str) -> Column:
    """Unsigned 32 bits of MD5 over the columns' text: the same in other SQL engines."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def positions(df: DataFrame, group: str, place: str, order: list[str], into: str, rows_per_bucket: int = 1024, most_buckets: int = 1_000_000) -> DataFrame:
    """Zero-based rank of each row within its group, ordered by ``place`` then ``order``.

    ``place`` is a hash column in [0, 2**32). Groups are cut into buckets of about
    ``rows_per_bucket`` rows by ranges of that hash, ranked bucket by bucket, and shifted by
    the rows of earlier buckets, so a group that holds most rows is spread over many tasks.
    The number of distinct groups must be bounded by a parameter of the caller: the
    table of their counts is broadcast. Null groups aren't allowed.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    total = Window.partitionBy()
    sizes = sizes.withColumn("__per", F.greatest(F.lit(rows_per_bucket), F.sum("__size").over(total) / F.lit(most_buckets)))
    sizes = sizes.select(group, F.ceil(F.col("__size") / F.col("__per")).cast("long").alias("__buckets"))
    dealt = df.join(F.broadcast(sizes), group).withColumn("__bucket", F.floor(F.col(place) * F.col("__buckets") / F.lit(2**32)).cast("long"))
    counts = dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__bucket").orderBy(place, *order)
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, [group, "__bucket"]).withColumn(into, (F.col("__before") + F.col("__rank")).cast("long")).drop("__bucket", "__buckets", "__before", "__rank")
