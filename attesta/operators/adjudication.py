"""Decisions of reviewers laid over records: overlays, overrides, defaults, provenance and the checks they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import constants as K
from attesta.operators import relational as R


def consistent_positive() -> Column:
    """Whether the components of a positive row agree: all four are yes, the production is of an accepted kind, no exclusion is given. Nulls don't agree."""
    parts = [F.col(f) == "yes" for f in K.COMPONENT_FIELDS] + [F.col("production_presence").isin(*K.PRODUCTION_KINDS), F.col("primary_exclusion_reason") == "none"]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole & part
    return F.coalesce(whole, F.lit(False))


def review_scope(scope: str) -> Column:
    """Rows to review: direct companies with both signals, and with the US signal for the subset. An unknown scope raises."""
    if scope not in ("direct_semiconductor_manufacturing", "us_signal_subset"):
        raise ValueError(f"no such scope: {scope}")
    wanted = (F.col("source_kind_prelabel") == "direct_company_candidate") & F.col("semiconductor_signal") & F.col("manufacturing_signal")
    return wanted & F.col("us_presence_signal") if scope == "us_signal_subset" else wanted


def overlay(rows: DataFrame, decisions: DataFrame, key: str, cells: dict[str, Column]) -> DataFrame:
    """``rows`` with ``cells`` (expressions over the decision's columns as d.<name>) where a decision has the row's key, unchanged elsewhere.

    ``decisions`` has unique keys. Cells that rows lack are added, null where nothing is decided.
    """
    d = decisions.withColumn("__decided", F.lit(True)).alias("d")
    joined = rows.alias("r").join(d, F.col(f"r.{key}") == F.col(f"d.{key}"), "left")
    decided = F.col("d.__decided").isNotNull()
    own = {c: F.col(f"r.{c}") for c in rows.columns}
    new = {c: F.when(decided, cell).otherwise(own[c]) if c in own else F.when(decided, cell) for c, cell in cells.items()}
    return joined.select(*[cell.alias(c) for c, cell in (own | new).items()])


def override(rows: DataFrame, corrections: DataFrame, key: str, fields: list[str], source_col: str, source: str) -> DataFrame:
    """A later stage's ``fields`` in place of those of rows with a correction, all of them and nulls too, with ``source`` as their provenance."""
    cells = {f: F.col(f"d.{f}") for f in fields} | {source_col: F.lit(source)}
    return overlay(rows, corrections, key, cells)


def first_evidence(fetched: DataFrame) -> DataFrame:
    """One row for each URL and content hash: the first by file and position."""
    order = F.struct("file_pos", "row_pos")
    rest = [c for c in fetched.columns if c not in ("canonical_url", "page_sha256")]
    best = fetched.groupBy("canonical_url", "page_sha256").agg(F.min_by(F.struct(*rest), order).alias("x"))
    return best.select("canonical_url", "page_sha256", "x.*")


def verification_faults(decisions: DataFrame, fetched: DataFrame) -> DataFrame:
    """``decisions`` with ``faults``: why each may not stand, empty if it may.

    A strict positive needs a confirmation URL. A decision with a URL needs a fetch of that URL with that hash and the same status and robots
    metadata, and a strict positive one that was allowed and succeeded (200 to 299).
    """
    seen = first_evidence(fetched).select(F.col("canonical_url").alias("__url"), F.col("page_sha256").alias("__sha"), F.col("http_status").alias("__status"), F.col("robots_status").alias("__robots"))
    url, sha = F.col("independent_confirmation_url"), F.col("independent_source_sha256")
    joined = decisions.join(seen, (url == F.col("__url")) & (sha == F.col("__sha")), "left")
    given, met = F.coalesce(url, F.lit("")) != "", F.col("__url").isNotNull()
    strict = F.col("strict_supplier_valid")
    faults = F.array_compact(
        F.array(
            F.when(~F.col("sme_status_verified").isin(*K.SME_STATUSES), "sme_status"),
            F.when(strict & ~given, "no_url"),
            F.when(given & ~met, "not_fetched"),
            F.when(met & ~F.col("independent_http_status").eqNullSafe(F.col("__status")), "http_status_differs"),
            F.when(met & ~F.col("independent_robots_status").eqNullSafe(F.col("__robots")), "robots_status_differs"),
            F.when(strict & met & ~(F.col("__status").between(200, 299) & (F.col("__robots") == "robots_allowed")), "not_allowed_or_not_2xx"),
        )
    )
    return joined.select(*decisions.columns, faults.alias("faults"))


def with_defaults(rows: DataFrame, decisions: DataFrame, key: str, evidence_col: str, defaults: dict[str, Column], fields: list[str]) -> DataFrame:
    """Each row's decision: the reviewers' where there is one, ``defaults`` where its evidence is empty; ``final_source`` says which.

    A row with evidence but no decision keeps nulls and the source ``missing``.
    """
    d = decisions.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__has"))
    joined = rows.join(d, F.col(key) == F.col("__key"), "left")
    empty = F.trim(F.coalesce(F.col(evidence_col), F.lit(""))) == ""
    source = F.when(empty, "automatic_empty_context").when(F.col("__has"), "reviewed").otherwise("missing")
    return joined.select(*rows.columns, *[F.when(empty, defaults[f]).otherwise(F.col(f"__{f}")).alias(f) for f in fields], source.alias("final_source"))


def fieldwise_rows(a: DataFrame, b: DataFrame, c: DataFrame, key: str, key_fields: list[str], other_fields: list[str]) -> DataFrame:
    """Two reviews of the same keys and an adjudicator's of the disputed ones, joined and merged.

    A key field is a's where both agree and c's where not; other fields follow the base row, which is c's if any key field is disputed. Also
    gives ``whole_<field>`` of the merge by whole records, ``disputed`` (names joined by |), ``final_source`` and ``covered``: whether
    exactly the disputed keys are in c and both reviews have the key.
    """
    side = lambda df, x: df.select(key, F.struct(*key_fields, *other_fields).alias(x))
    joined = side(a, "a").join(side(b, "b"), key, "full").join(side(c, "c"), key, "left")
    rows = joined.withColumn("names", R.disputed("a", "b", key_fields))
    routed = F.size("names") > 0
    base = lambda f: F.when(routed & F.col("c").isNotNull(), F.col(f"c.{f}")).otherwise(F.col(f"a.{f}"))
    return rows.select(
        key,
        "a",
        "b",
        "c",
        "names",
        *R.fieldwise("a", "b", "c", key_fields),
        *[base(f).alias(f) for f in other_fields],
        *[base(f).alias(f"whole_{f}") for f in key_fields],
        F.array_join("names", "|").alias("disputed"),
        F.when(routed, "fieldwise_C_adjudication").otherwise("AB_agreement").alias("final_source"),
        (F.col("a").isNotNull() & F.col("b").isNotNull() & (routed == F.col("c").isNotNull())).alias("covered"),
    )


def flagged_clusters(rows: DataFrame, cluster: str, name: str, state: str, visibility: str) -> DataFrame:
    """Clusters to look at: over one name, over one state, or a visibility other than a domain of their own; with their rows nested, sorted."""
    grouped = rows.groupBy(cluster).agg(
        F.array_sort(F.collect_set(name)).alias("names"),
        F.array_sort(F.collect_set(state)).alias("states"),
        F.array_sort(F.collect_set(visibility)).alias("visibility"),
        F.array_sort(F.collect_list(F.struct(name, state))).alias("evidence"),
    )
    plain = (F.size("names") <= 1) & (F.size("states") <= 1) & (F.col("visibility") == F.array(F.lit("dedicated_business_domain")))
    return grouped.filter(~plain)
