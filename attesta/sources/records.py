"""Records of work: journals that make a run resumable, histories, packages of aggregates, and what fetchers leave behind."""

from __future__ import annotations

import gzip
import io
import json
import os
import tempfile
from collections.abc import Iterator
from urllib import robotparser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import constants as K
from attesta.functions import values as V

JOURNAL = "batch_id string, status string, at timestamp"
TERMINAL = ["complete", "complete_with_invalid", "failed_diagnosed"]


def journal_state(journal: DataFrame) -> DataFrame:
    """(batch_id, status): the latest entry of each batch."""
    return journal.groupBy("batch_id").agg(F.max_by("status", "at").alias("status"))


def next_batches(planned: DataFrame, journal: DataFrame, limit: int) -> DataFrame:
    """The batches to send now: those without an entry, the first ``limit`` by id. A batch that was started and has no end stops the run."""
    state = journal_state(journal)
    open_ = [r["batch_id"] for r in state.filter(~F.col("status").isin(*TERMINAL)).orderBy("batch_id").limit(5).collect()]
    if open_:
        raise ValueError(f"unresolved batches, first: {open_}")
    return planned.join(state, "batch_id", "left_anti").orderBy("batch_id").limit(limit)


def unfinished(expected: DataFrame, output: DataFrame, keys: list[str], valid) -> DataFrame:
    """Expected keys without a valid row in an output that already exists: only these are made again."""
    return expected.join(output.filter(valid).select(*keys).distinct(), keys, "left_anti")


def append_history(rows: DataFrame, path: str) -> None:
    """Add rows to a history of JSON lines; nothing written before is touched."""
    rows.write.mode("append").json(path)


def save_json(value, path: str) -> None:
    """A small document on the driver's disk, whole or not at all, readable by its owner only."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)  # with mode 0600
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, sort_keys=True, indent=2)
        out.write("\n")
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, path)


def gzip_bytes(content: bytes) -> bytes:
    """The same gzip bytes for the same content, at any time."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as packed:
        packed.write(content)
    return out.getvalue()


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, content) of gzip files, unpacked; a file that isn't whole raises."""

    @F.pandas_udf(T.BinaryType())
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: gzip.decompress(bytes(x)))

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), unpacked("content").alias("content"))
    return files.select("name", F.sha2("content", 256).alias("sha256"), "content")


def tracked_texts(spark: SparkSession, root: str, names: list[str], most_bytes: int = 2_000_000) -> DataFrame:
    """(name, text) of the listed files of up to ``most_bytes`` bytes, for scans; larger ones aren't texts to scan."""
    listed = spark.createDataFrame([(n,) for n in names], "name string")  # a repository's list of files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    files = files.withColumn("name", F.regexp_extract("path", f"/{os.path.basename(root.rstrip('/'))}/(.*)$", 1))
    return files.join(F.broadcast(listed), "name", "left_semi").select("name", F.decode("content", "utf-8").alias("text"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, publisher) of the sources that a registry document lists."""
    rows = spark.read.schema("sources array<struct<id:string,url:string,publisher:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("sources").alias("s")).select("s.*")


def robots_decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url) with ``allowed`` and ``robots_status`` by the robots texts (origin, body) of their origins.

    An origin without a text, or whose text is null because it couldn't be fetched in time, allows everything and says so. Texts are parsed once for each origin of a batch.
    """
    origin = F.lower(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1))
    joined = urls.withColumn("__origin", origin).join(robots.select(F.col("origin").alias("__origin"), F.col("body").alias("__body")), "__origin", "left")

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, wanted in batches:
            parsed = {}
            for body in bodies.dropna().unique():
                parsed[body] = robotparser.RobotFileParser()
                parsed[body].parse(body.splitlines())
            yield pd.Series([None if body not in parsed else parsed[body].can_fetch(agent, url) for body, url in zip(bodies, wanted, strict=True)], dtype=object)

    found = joined.withColumn("__ok", allowed("__body", "url"))
    status = F.when(F.col("__ok").isNull(), "robots_unavailable_allow").when(F.col("__ok"), "robots_allowed").otherwise("robots_disallowed")
    return found.select(*urls.columns, F.coalesce("__ok", F.lit(True)).alias("allowed"), status.alias("robots_status"))


def write_package(documents: dict[str, str], path: str) -> str:
    """Aggregate JSON documents, a manifest and checksums in a folder on the driver's disk; returns the manifest.

    A document with a key that tells of single rows raises before anything is written.
    """
    import hashlib
    import re

    pattern = re.compile(r'(?<!\\)"(' + "|".join(K.FORBIDDEN_KEYS) + r')"\s*:')
    for name, body in documents.items():
        if found := pattern.findall(json.dumps(json.loads(body)).lower()):
            raise ValueError(f"{name} has {sorted(set(found))}")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    bodies = {name: json.dumps(json.loads(body), indent=2, sort_keys=True, ensure_ascii=False) + "\n" for name, body in documents.items()}
    manifest = json.dumps({"files": {n: sha(b) for n, b in sorted(bodies.items())}, "row_level_data": False}, indent=2, sort_keys=True) + "\n"
    bodies["release_manifest.json"] = manifest
    sums = "".join(f"{sha(b)}  {n}\n" for n, b in sorted(bodies.items()))
    os.makedirs(path, exist_ok=True)
    for name, body in (bodies | {"SHA256SUMS": sums}).items():
        with open(os.path.join(path, name), "w", encoding="utf-8") as out:
            out.write(body)
    return manifest


def page_document(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``json``: each row's listed fields as JSON that can stand in a page's script."""
    return rows.select(V.in_page_json(F.to_json(F.struct(*fields))).alias("json"))
