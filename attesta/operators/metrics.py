"""Report metrics: fixed sets of counts and gates, each one pass of partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import constants as K
from attesta.functions.stats import wilson
from attesta.operators.adjudication import consistent_positive


def pilot_metrics(rows: DataFrame, baseline: DataFrame, count_gate: int = 25, bound_gate: float = 0.55) -> DataFrame:
    """One row: reviewed, strict, new and small firms, precision with its Wilson bounds, lift over the baseline's count, and the two gates.

    Reviewed rows have a reviewer's confidence; strict ones are reviewed and valid; new ones are strict and not in the baseline.
    """
    reviewed = F.coalesce(F.col("reviewer1_confidence"), F.lit("")) != ""
    strict = reviewed & F.coalesce(F.col("is_valid_supplier_strict"), F.lit(False))
    counts = rows.agg(
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(strict).alias("strict"),
        F.count_if(strict & (F.col("baseline_disposition") == "novel_candidate")).alias("net_new"),
        F.count_if(strict & (F.col("sme_status") == "probable_sme")).alias("probable_sme"),
    )
    whole = counts.join(F.broadcast(baseline.agg(F.count(F.lit(1)).alias("denominator"))), how="cross")  # one row by one row
    low, high = wilson(F.col("strict"), F.col("reviewed"))
    whole = whole.withColumns({"precision": F.try_divide("strict", "reviewed"), "low": low, "high": high, "lift": F.try_divide("net_new", "denominator")})
    return whole.withColumns({"count_gate": F.col("net_new") >= count_gate, "bound_gate": F.col("low") >= bound_gate})


def quote_categories(rows: DataFrame, label: str, quote: Column, found: Column) -> DataFrame:
    """By label: rows, quotes found in their evidence, empty quotes, and others."""
    empty = F.trim(F.coalesce(quote, F.lit(""))) == ""
    hit = ~empty & F.coalesce(found, F.lit(False))
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("literal_pass"), F.count_if(empty).alias("empty"), F.count_if(~empty & ~hit).alias("nonempty_fail"))


def stage_changes(merged: DataFrame, primary: str, fields: list[str]) -> DataFrame:
    """(what, n): rows whose primary label changed from whole-record to field-wise merging, rows with any change, with a change elsewhere only, and by field."""
    differs = lambda f: ~F.col(f"whole_{f}").eqNullSafe(F.col(f))
    some = F.exists(F.array(*[differs(f) for f in fields]), lambda x: x)
    counts = {"primary": differs(primary), "any_field": some, "other_only": some & ~differs(primary)} | {f"field_{f}": differs(f) for f in fields}
    return _named(merged, counts)


def _named(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in counts])).alias("x")).select("x.*")


def overwrite_transitions(merged: DataFrame, primary: str, labels: list[str]) -> DataFrame:
    """(from, to, n) for all pairs of labels: primary labels that both reviewers agreed on and whole-record merging overwrites."""
    a, b, c = (F.col(f"{x}.{primary}") for x in "abc")
    over = (F.size("names") > 0) & a.eqNullSafe(b) & (a != c)
    rows = merged.filter(over).select(a.alias("from"), c.alias("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    grid = merged.sparkSession.createDataFrame([(x, y) for x in labels for y in labels], "from string, to string")
    return grid.join(rows, ["from", "to"], "left").select("from", "to", F.coalesce("n", F.lit(0)).alias("n"))


def overwrite_triggers(merged: DataFrame, primary: str, fields: list[str]) -> DataFrame:
    """(what, n): which other fields' disagreement sent the overwritten rows to the adjudicator."""
    a, b, c = (F.col(f"{x}.{primary}") for x in "abc")
    over = merged.filter((F.size("names") > 0) & a.eqNullSafe(b) & (a != c))
    return _named(over, {f: F.array_contains("names", f) for f in fields if f != primary})


def positive_contracts(rows: DataFrame, state_name: Column, expected_state: Column) -> DataFrame:
    """One row: positive rows, those whose components disagree, those whose state is another than the one asked for."""
    positive = F.col("eqdp") == "yes"
    return rows.agg(F.count_if(positive).alias("positive_rows"), F.count_if(positive & ~consistent_positive()).alias("component_violations"), F.count_if(positive & ~state_name.eqNullSafe(expected_state)).alias("state_mismatches"))


def label_counts(rows: DataFrame, label: str, labels: list[str] = K.LABELS) -> DataFrame:
    """(what, n) of every fixed label, zero where it doesn't occur."""
    return _named(rows, {x: F.col(label) == x for x in labels})


def row_accounting(planned: DataFrame, attempted: DataFrame, returned: DataFrame, key: str, batch: str) -> DataFrame:
    """(status, n): each planned row counted once, as valid, invalid, omitted by its answer, failed with its batch, or not attempted.

    ``attempted`` has batch and ok, ``returned`` key and valid. The counts sum to the planned rows.
    """
    status = F.when(F.col("valid"), "valid").when(~F.col("valid"), "invalid").when(F.col("ok"), "omitted").when(~F.col("ok"), "failed").otherwise("not_attempted")
    rows = planned.select(key, batch).join(attempted.select(batch, "ok"), batch, "left").join(returned.select(key, "valid"), key, "left")
    return _named(rows.withColumn("status", status), {s: F.col("status") == s for s in ("valid", "invalid", "omitted", "failed", "not_attempted")}).withColumnRenamed("what", "status")


def coverage_by_label(rows: DataFrame, label: str, status: str, statuses: list[str]) -> DataFrame:
    """By reference label the rows of each status, zero-filled."""
    return rows.groupBy(label).agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])


def map_sum(rows: DataFrame, usage: str) -> DataFrame:
    """(key, total) over all rows' maps."""
    return rows.select(F.explode(usage).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def fetch_counts(links: DataFrame, pages: DataFrame, query: str, url: str) -> DataFrame:
    """By query: distinct pages linked, and those fetched with a status of 200 to 299."""
    joined = links.select(query, url).distinct().join(pages.select(url, "http_status"), url, "left")
    return joined.groupBy(query).agg(F.count(F.lit(1)).alias("linked"), F.count_if(F.col("http_status").between(200, 299)).alias("succeeded"))


def retries(manifest: DataFrame) -> DataFrame:
    """One row: batches, and those that took over one attempt; a batch without a number took one."""
    return manifest.agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.coalesce(F.col("attempt"), F.lit(1)) > 1).alias("retried"))


def size_summary(rows: DataFrame) -> DataFrame:
    """(what, n): rows with supported evidence, with a number, with a finite upper bound, of owners alone, with a federal representation."""
    status = F.col("size_evidence_status")
    return _named(
        rows,
        {
            "supported": status != "insufficient",
            "numerical": status.isin(*K.SIZE_STATUSES[:4]),
            "finite_upper": F.col("employee_upper").isNotNull(),
            "owner_only": F.col("owner_only_supported"),
            "federal": F.col("sba_status_supported"),
        },
    )
