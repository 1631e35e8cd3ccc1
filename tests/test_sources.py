import base64
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import relational
from attesta.sources import files, records
from attesta.streaming import increments


def test_csv_keeps_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,\n"a, b",""\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()] == [("1", ""), ("a, b", "")]
    assert files.read_csv_or_empty(spark, str(tmp_path / "none.csv"), ["x"]).count() == 0


def test_ndjson(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query_id": "q", "urls": ["u"]}\n\n{"query_id": "r"}\n')
    rows = files.read_ndjson(spark, str(tmp_path / "a.json"), "query_id string, urls array<string>", ["query_id", "urls"])
    assert sorted((r["query_id"], r["_bad"]) for r in rows.collect()) == [("q", False), ("r", True)]
    wrapped = spark.createDataFrame([(base64.b64encode(b'{"a": 1}\n\n{"a": 2}').decode(),)], "w string")
    assert sorted(r["a"] for r in files.read_ndjson_base64(wrapped, "w", "a int").collect()) == [1, 2]


def test_batches(spark, tmp_path):
    for name, rows in (("batch-001", [("r1", "yes"), ("r2", "no")]), ("batch-002", [("r1", "no")])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"batch_id": name, "results": [{"review_id": k, "label": v} for k, v in rows]}))
    with pytest.raises(ValueError, match="repeated"):
        files.read_batches(spark, str(tmp_path), "results", "review_id string, label string")
    last = files.read_batches(spark, str(tmp_path), "results", "review_id string, label string", "last")
    assert {r["review_id"]: r["label"] for r in last.collect()} == {"r1": "no", "r2": "no"}
    with pytest.raises(ValueError, match="instead of"):
        files.read_batches(spark, str(tmp_path), "results", "review_id string, label string", "last", expected=5)


def test_atomic_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x")], "k long, v string, extra string")
    files.write_atomic(rows, str(tmp_path / "out"), ["k", "v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["k", "v"]
    with pytest.raises(ValueError, match="empty"):
        files.write_atomic(rows.filter("k > 1"), str(tmp_path / "out"), ["k"])
    assert not files.is_stale(rows, rows) and files.is_stale(rows, rows.filter("k > 1"))
    assert files.fingerprint(files.file_hashes(spark, str(tmp_path / "out"))).count() == 1


def test_embedded(spark):
    html = spark.createDataFrame([(1, 'x var companies = [{"name": "A ] B"}, {"name": "C"}];')], "id long, html string")
    assert [r["name"] for r in files.read_embedded_array(html, "html", "companies", "name string").orderBy("_pos").collect()] == ["A ] B", "C"]
    script = spark.createDataFrame([('<script id="dataset" type="application/json">{"a": 1}</script>',)], "html string")
    assert files.read_script_json(script, "html", "dataset", "a int").first()["data"]["a"] == 1


def test_streaming_upsert_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, f"v{i}") for i in range(40)], "k long, t long, v string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: increments.run_upsert(stream, str(tmp_path / "table"), str(tmp_path / "ck"), "k", ["t"])
    state = lambda found: sorted(tuple(r) for r in found.select("k", "t").collect())
    assert state(run()) == [(k, 35 + k) for k in range(5)]
    assert state(run()) == [(k, 35 + k) for k in range(5)]  # nothing new
    spark.createDataFrame([(2, 99, "new")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert state(run()) == [(0, 35), (1, 36), (2, 99), (3, 38), (4, 39)]
    assert len([x for x in os.listdir(tmp_path / "table") if x.startswith("v=")]) <= 2


def test_revisions(spark):
    edits = spark.createDataFrame([("r", 0, 1), ("r", 0, 2), ("s", 3, 3), ("t", 2, 4), ("s", 4, 5)], "record string, base long, edit_id long")
    stored = spark.createDataFrame([("s", 3), ("t", 5)], "record string, revision long")
    found = increments.accept_revisions(edits, stored, "record", "base")
    assert sorted((r["edit_id"], r["stale"], r["revision"]) for r in found.select("edit_id", "stale", F.coalesce("revision", F.lit(-1)).alias("revision")).collect()) == [(1, False, 1), (2, True, -1), (3, False, 4), (4, True, -1), (5, True, -1)]


def test_fingerprint_bytes(spark):
    rows = [("b.json", hashlib.sha256(b"2").hexdigest()), ("a.json", hashlib.sha256(b"1").hexdigest())]
    whole = b"".join(n.encode() + b"\0" + bytes.fromhex(h) for n, h in sorted(rows))
    assert files.fingerprint(spark.createDataFrame(rows, "name string, sha256 string")).first()[0] == hashlib.sha256(whole).hexdigest()


def test_atomic_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in (1, 2):
        files.write_atomic(spark.createDataFrame([(k,)], "k long"), path, ["k"], "parquet")
    assert [r["k"] for r in spark.read.parquet(path).collect()] == [2] and os.listdir(tmp_path) == ["t"]


def test_journal(spark):
    planned = spark.createDataFrame([(f"b{k}",) for k in range(5)], "batch_id string")
    entries = [("b0", "started", 1), ("b0", "complete", 2), ("b1", "failed_diagnosed", 3)]
    journal = spark.createDataFrame(entries, "batch_id string, status string, at long")
    assert [r["batch_id"] for r in records.next_batches(planned, journal, 2).collect()] == ["b2", "b3"]
    with pytest.raises(ValueError, match="b2"):
        records.next_batches(planned, journal.union(spark.createDataFrame([("b2", "started", 4)], journal.schema)), 2)
    output = spark.createDataFrame([("b0", True), ("b3", False)], "batch_id string, ok boolean")
    assert sorted(r["batch_id"] for r in records.unfinished(planned, output, ["batch_id"], F.col("ok")).collect()) == ["b1", "b2", "b3", "b4"]


def test_snapshots_and_packages(spark, tmp_path):
    packed = records.gzip_bytes(b"page")
    assert packed == records.gzip_bytes(b"page")
    (tmp_path / "a.gz").write_bytes(packed)
    assert bytes(records.read_snapshots(spark, str(tmp_path / "a.gz")).first()["content"]) == b"page"
    out = tmp_path / "package"
    records.write_package({"m.json": '{"n": 1}'}, str(out))
    sums = dict(reversed(x.split("  ")) for x in (out / "SHA256SUMS").read_text().splitlines())
    assert sums["m.json"] == hashlib.sha256((out / "m.json").read_bytes()).hexdigest()
    with pytest.raises(ValueError, match="review_id"):
        records.write_package({"m.json": '{"a": [{"Review_ID": 1}]}'}, str(tmp_path / "no"))
    records.save_json({"a": 1}, str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").stat().st_mode & 0o777 == 0o600
    for k in (1, 2):
        records.append_history(spark.createDataFrame([(k,)], "k long"), str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 2


def test_listed_files_and_registry(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("text")
    (tmp_path / "src" / "big.txt").write_text("x" * 50)
    found = records.tracked_texts(spark, str(tmp_path / "src"), ["a.txt", "big.txt"], 20).collect()
    assert [(r["name"], r["text"]) for r in found] == [("a.txt", "text")]
    (tmp_path / "sources.json").write_text('{"sources": [{"id": "s", "url": "https://a.com", "publisher": "p"}]}')
    assert records.read_registry(spark, str(tmp_path / "sources.json")).first()["publisher"] == "p"
    (tmp_path / "urls.txt").write_text("# comment\n\nhttps://a.com\n")
    assert [r["url"] for r in files.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.com"]


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.com/private/x",), ("https://a.com/x",), ("https://b.com/x",), ("https://c.com/",)], "url string")
    robots = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /private/"), ("https://c.com", None)], "origin string, body string")
    found = {r["url"]: (r["allowed"], r["robots_status"]) for r in records.robots_decisions(urls, robots, "bot").collect()}
    assert found["https://a.com/private/x"] == (False, "robots_disallowed") and found["https://a.com/x"] == (True, "robots_allowed")
    assert found["https://b.com/x"] == found["https://c.com/"] == (True, "robots_unavailable_allow")


def test_numbering_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    found = {r["k"]: r["at"] for r in relational.numbered(rows, ["k"], "at", 0).collect()}
    assert found == {k: k for k in range(1000)}


def test_allocation_that_does_not_fit(spark):
    strata = spark.createDataFrame([("a", 3), ("b", 1)], "s string, n long")
    assert {r["s"]: r["allocation"] for r in relational.largest_remainder(strata, "s", "n", 2).collect()} == {"a": 1, "b": 1}
    with pytest.raises(Exception, match="allocation"):
        relational.largest_remainder(strata, "s", "n", 10).collect()
