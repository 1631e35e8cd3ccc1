"""Sources and sinks: delimited tables, JSON batches, embedded data, atomic and checked output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; an empty cell is an empty string, not null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return rows.fillna("")


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return read_csv(spark, path, columns)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_ndjson(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """One record a line; ``_bad`` is true where a required field is missing or of another type."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull()
    for field in required:
        bad = bad | F.col(field).isNull()
    return rows.withColumn("_bad", bad).drop("_corrupt")


def read_ndjson_base64(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of base64-wrapped newline-delimited JSON in a column; blank lines are skipped."""
    lines = df.select(F.explode(F.split(F.decode(F.unbase64(column), "utf-8"), "\n")).alias("line")).filter(F.trim("line") != "")
    return lines.select(F.from_json("line", schema).alias("row")).select("row.*")


def read_batches(spark: SparkSession, path: str, collection: str, row_schema: str, on_duplicate: str = "error", key: str = "review_id", expected: int | None = None) -> DataFrame:
    """Rows of ``batch_id, <collection>[]`` documents. Repeated keys raise, or the last by file name and position wins."""
    files = spark.read.schema(f"batch_id string, {collection} array<struct<{row_schema}>>").option("multiLine", True).json(path)
    rows = files.select("batch_id", F.col("_metadata.file_name").alias("_file"), F.posexplode(collection).alias("_pos", "row")).select("batch_id", "_file", "_pos", "row.*")
    if on_duplicate == "last":
        rest = [c for c in rows.columns if c != key]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_file", "_pos")).alias("x")).select(key, "x.*")
    elif not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated {key}")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return rows


def scan_array(text: str, variable: str) -> str:
    """The JSON array after ``var <variable> =``, brackets matched outside strings. Raises without the variable or the array's end."""
    start = re.search(rf"\bvar\s+{re.escape(variable)}\s*=\s*(?=\[)", text)
    if not start:
        raise ValueError(f"no array {variable}")
    depth, at = 0, start.end()
    for token in re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]]', re.DOTALL).finditer(text, at):
        depth += {"[": 1, "]": -1}.get(token[0], 0)
        if not depth:
            return text[at : token.end()]
    raise ValueError(f"array {variable} doesn't end")


def read_embedded_array(pages: DataFrame, html_col: str, variable: str, schema: str) -> DataFrame:
    """Records of a JSON array in a page's script, with the page's other columns. A page without the array, or with one that doesn't end, raises."""

    @F.pandas_udf("string")
    def literal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: scan_array(x or "", variable))

    rows = pages.withColumn("__rows", F.from_json(literal(html_col), f"array<struct<{schema}>>"))
    return rows.select("*", F.posexplode("__rows").alias("_pos", "__row")).select(*[c for c in pages.columns if c != html_col], "_pos", "__row.*")


def read_script_json(pages: DataFrame, html_col: str, element: str, schema: str) -> DataFrame:
    body = F.regexp_extract(html_col, rf'(?s)<script[^>]*\bid="{element}"[^>]*>(.*?)</script>', 1)
    return pages.select(F.from_json(body, schema).alias("data"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blanks and # comments are dropped."""
    rows = spark.read.text(path).select(F.trim("value").alias("url"))
    return rows.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def write_atomic(df: DataFrame, path: str, fields: list[str], fmt: str = "csv") -> None:
    """The listed fields to a new folder beside ``path``, which then takes its place. An empty table is refused."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    spark = df.sparkSession
    df.select(*fields).write.mode("overwrite").option("header", True).format(fmt).save(f"{path}.new")
    jvm = spark.sparkContext._jvm
    new, now, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The old table is moved aside, not deleted, until the new one stands: a crash in between leaves both.
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"cannot move {now} to {old}")
    if not fs.rename(new, now):
        raise OSError(f"cannot move {new} to {now}")
    fs.delete(old, True)


def is_stale(df: DataFrame, written: DataFrame) -> bool:
    """Whether a written table differs from what would be written now."""
    return not df.exceptAll(written).isEmpty() or not written.exceptAll(df).isEmpty()


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch`` from 1: rows in order, ``size`` to a batch."""
    from attesta.operators.relational import numbered

    return numbered(df, order, "__at", 0).withColumn("batch", F.expr(f"__at div {size} + 1").cast("long")).drop("__at")


def manifest(counts: dict[str, int], hashes: dict[str, str]) -> str:
    return json.dumps({"counts": counts, "sha256": hashes}, sort_keys=True, indent=2) + "\n"


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-256 over name, a zero byte and the raw digest of each of a bounded set of files, by name."""
    both = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    parts = F.transform(both, lambda f: F.concat(F.encode(f["name"], "utf-8"), F.unhex(F.lit("00")), F.unhex(f["sha256"])))
    return files.agg(F.sha2(F.aggregate(parts, F.unhex(F.lit("")), lambda whole, part: F.concat(whole, part)), 256).alias("fingerprint"))


def sha256_sums(files: DataFrame) -> DataFrame:
    """Lines of a checksum file, by name."""
    return files.select(F.concat_ws("  ", "sha256", "name").alias("line"), "name").orderBy("name").select("line")
