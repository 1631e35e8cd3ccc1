"""Checks of rows and sets: each says what is wrong instead of stopping at the first fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import constants as K


def flags(**faults: Column) -> Column:
    """Names of the faults that hold, in the order given; null conditions don't hold."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in faults.items()]))


def require(df: DataFrame, fault: Column, what: str) -> DataFrame:
    """``df``, failing in the task that meets a row with ``fault``."""
    bad = F.when(fault, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))
    return df.filter(bad)


def schema_faults(given: DataFrame, fields: dict[str, tuple[list[str] | None, int | None]]) -> Column:
    """Faults of rows of text fields (name -> allowed values, greatest length): missing and extra columns, nulls, values, lengths."""
    out = {f"missing_{f}": F.lit(True) for f in fields if f not in given.columns}
    out |= {f"extra_{c}": F.lit(True) for c in given.columns if c not in fields}
    for name, (allowed, longest) in fields.items():
        if name in given.columns:
            out[f"null_{name}"] = F.col(name).isNull()
            if allowed is not None:
                out[f"enum_{name}"] = ~F.col(name).isin(*allowed)
            if longest is not None:
                out[f"length_{name}"] = F.length(name) > longest
    return flags(**out)


def identity_failures(returned: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: objects returned, distinct ids, ids not asked for, extra rows of repeated ids, ids asked for that are absent."""
    got = returned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sides = got.join(expected.select(key).distinct().withColumn("asked", F.lit(True)), key, "full")
    n, asked = F.coalesce("n", F.lit(0)), F.coalesce("asked", F.lit(False))
    return sides.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("returned_objects"),
        F.count_if(n > 0).alias("unique_returned_ids"),
        F.count_if((n > 0) & ~asked).alias("unexpected_unique_ids"),
        F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).alias("duplicate_extra_rows"),
        F.count_if((n == 0) & asked).alias("requested_ids_absent"),
    )


def size_faults(status: Column, lower: Column, upper: Column, owner: Column, sba: Column, quote: Column, quote_found: Column) -> Column:
    """Faults of size evidence: what its status says must hold of its bounds, supports and quote."""
    blank, no_low, no_high = F.trim(quote) == "", lower.isNull(), upper.isNull()
    wrong = (
        F.when(status == "insufficient", ~no_low | ~no_high | owner | sba | ~blank)
        .when(status == "exact_employee_count", no_low | no_high | ~lower.eqNullSafe(upper))
        .when(status == "employee_range", no_low | no_high | F.coalesce(lower > upper, F.lit(False)))
        .when(status == "employee_lower_bound", no_low | ~no_high)
        .when(status == "employee_upper_bound", ~no_low | no_high)
        .when(status == "owner_only_or_nonemployer_explicit", ~no_low | ~no_high | ~owner)
        .when(status == "sba_self_certification_explicit", ~no_low | ~no_high | ~sba)
    )
    return flags(status=~status.isin(*K.SIZE_STATUSES), bounds=wrong, quote=(status != "insufficient") & (blank | ~quote_found))


def decision_faults(decisions: DataFrame, expected: DataFrame, key: str, enums: dict[str, list[str]]) -> DataFrame:
    """(key, fault): repeated, missing and extra keys, and fields outside their values. Empty if the decisions may be applied."""
    counted = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sides = counted.join(expected.select(key).distinct().withColumn("asked", F.lit(True)), key, "full")
    ids = sides.select(key, F.explode(flags(repeated=F.col("n") > 1, missing=F.col("n").isNull(), extra=F.col("asked").isNull())).alias("fault"))
    values = decisions.select(key, F.explode(flags(**{f"enum_{f}": ~F.coalesce(F.col(f).isin(*allowed), F.lit(False)) for f, allowed in enums.items()})).alias("fault"))
    return ids.unionByName(values)


def field_mismatches(rebuilt: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, mismatches): rows whose rebuilt and stored values differ, null equal to null; a key on one side only counts for every field."""
    a = rebuilt.select(key, F.struct(*fields).alias("a"))
    b = stored.select(key, F.struct(*fields).alias("b"))
    joined = a.join(b, key, "full")
    one_side = F.col("a").isNull() | F.col("b").isNull()
    counts = joined.agg(*[F.count_if(one_side | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mismatches")) for f in fields])).alias("x")).select("x.*")


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that are in ``names``, in lower case, sorted."""
    return sorted({c.lower() for c in df.columns} & {n.lower() for n in names})


def answer_faults(enums: dict[str, list[str]], required: list[str], submitted: Column) -> Column:
    """Faults of a person's answers: values, and for submitted ones also what must be filled in and go together."""
    empty = lambda f: F.trim(F.coalesce(F.col(f), F.lit(""))) == ""
    out = {f"enum_{f}": ~empty(f) & ~F.col(f).isin(*allowed) for f, allowed in enums.items()}
    out |= {f"required_{f}": submitted & empty(f) for f in required}
    positive, excluded = F.col("eqdp") == "yes", F.col("primary_exclusion_reason") != "none"
    out["positive_with_exclusion"] = submitted & positive & excluded
    out["negative_without_exclusion"] = submitted & ~positive & ~excluded
    out["minutes"] = ~F.col("review_minutes").between(0, 10000) | (submitted & (F.coalesce("review_minutes", F.lit(0)) <= 0))
    return flags(**out)


def frozen_faults(files: DataFrame, frozen: DataFrame) -> DataFrame:
    """(name, fault): files that are absent, added or changed since their hashes (name, sha256) were frozen."""
    sides = files.select("name", F.col("sha256").alias("now")).join(frozen.select("name", F.col("sha256").alias("then")), "name", "full")
    return sides.select("name", F.explode(flags(absent=F.col("now").isNull(), added=F.col("then").isNull(), changed=F.col("now") != F.col("then"))).alias("fault"))


def release_faults(texts: DataFrame, sums: DataFrame, required: list[str], markers: list[str]) -> DataFrame:
    """(name, fault) of a release's files (name, text): required ones missing, sums (name, sha256) that differ, forbidden markers."""
    have = texts.select("name", "text", F.sha2("text", 256).alias("now"))
    wanted = texts.sparkSession.createDataFrame([(n,) for n in required], "name string")  # the fixed list of a release's files
    missing = wanted.join(have, "name", "left_anti").select("name", F.lit("missing").alias("fault"))
    differ = sums.join(have, "name", "left").filter("now is null or now <> sha256").select("name", F.lit("checksum").alias("fault"))
    marked = have.select("name", F.explode(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col("text"), m))).alias("m"))
    return missing.unionByName(differ).unionByName(marked.select("name", F.concat(F.lit("marker "), "m").alias("fault")))


def not_subset(items: Column, allowed: Column) -> Column:
    """The items outside ``allowed``, sorted: empty for a subset."""
    return F.array_sort(F.array_except(items, allowed))


def partitions(groups: Column, names: Column) -> Column:
    """Whether the nested groups hold every name exactly once and nothing else."""
    return F.array_sort(F.flatten(groups)) == F.array_sort(names)
