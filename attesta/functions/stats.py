"""Statistics as column expressions and small aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """95% Wilson score interval, clamped to [0, 1]; (0, 0) without trials."""
    n = total.cast("double")
    p = successes / n
    z2 = F.lit(Z * Z)
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    half = F.lit(Z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / scale
    bound = lambda x: F.when(total <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    return bound(centre - half), bound(centre + half)


def confusion(pairs: DataFrame, a: str, b: str, labels_a: list, labels_b: list) -> DataFrame:
    """(a, b, n) for every pair of the given labels, zero-filled; other values aren't counted."""
    kinds = dict(pairs.dtypes)
    grid = pairs.sparkSession.createDataFrame([(x, y) for x in labels_a for y in labels_b], f"`{a}` {kinds[a]}, `{b}` {kinds[b]}")
    rows = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(rows, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kappa(pairs: DataFrame, a: str, b: str, degenerate: float | None = 1.0) -> DataFrame:
    """One row: n, agreed, agreement and Cohen's kappa; null-safe equality, ``degenerate`` where chance agreement is certain."""
    rows = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = rows.agg(F.sum("n").alias("n"), F.sum(F.when(F.expr("a <=> b"), F.col("n")).otherwise(0)).alias("agreed"))
    left = rows.groupBy("a").agg(F.sum("n").alias("na"))
    right = rows.groupBy("b").agg(F.sum("n").alias("nb"))
    both = left.join(right, F.expr("a <=> b")).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    one = whole.join(both, F.lit(True)).withColumn("chance", F.coalesce("chance", F.lit(0)))
    # (po - pe) / (1 - pe) with whole numbers: one division.
    above = F.col("agreed") * F.col("n") - F.col("chance")
    most = F.col("n") * F.col("n") - F.col("chance")
    value = F.when(most == 0, F.lit(degenerate).cast("double")).otherwise(F.try_divide(above, most))
    return one.select(F.col("n").cast("long").alias("n"), F.col("agreed").cast("long").alias("agreed"), F.try_divide("agreed", "n").alias("agreement"), value.alias("kappa"))


def stratified_bootstrap(rows: DataFrame, stratum: str, yes: str, weight: str, replicates: int = 10_000, seed: int = 20260730) -> DataFrame:
    """One row: the weighted rate of ``yes``, and low and high of its 95% percentile interval; none of an empty table.

    Each replicate draws from every stratum as many rows as it has, with replacement, and its estimate is the sum of the weights (one over the
    inclusion probability) of the drawn rows with ``yes`` over that of all drawn rows. The bounds are the
    estimates at floor(0.025 (B - 1)) and floor(0.975 (B - 1)) in order. Rows of one stratum, weight and answer are alike, so a replicate draws
    how many of each such class it gets (multinomial), which has the same distribution as drawing rows. A null answer is a no.
    The classes go to every task: a few for each stratum if weights belong to strata, at most as many as rows.
    """
    if replicates < 1:
        raise ValueError("replicates is a positive integer")
    answer = F.coalesce(F.col(yes).cast("boolean"), F.lit(False))
    counted = rows.groupBy(F.col(stratum).alias("s"), F.col(weight).cast("double").alias("w"), answer.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    classes = sorted(((r["s"] is not None, str(r["s"])), r["w"], r["y"], r["n"]) for r in counted.collect())
    strata: dict = {}
    for s, w, y, n in classes:
        strata.setdefault(s, []).append((w, y, n))
    own = [tuple(np.array(x) for x in zip(*group, strict=True)) for group in strata.values()]
    spark = rows.sparkSession
    if not own:
        return spark.createDataFrame([], "rate double, low double, high double, replicates long")
    rate = float(sum((w * y * n).sum() for w, y, n in own) / sum((w * n).sum() for w, _, n in own))
    held = spark.sparkContext.broadcast(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                top = whole = 0.0
                for w, y, n in held.value:
                    drawn = w * rng.multinomial(n.sum(), n / n.sum())
                    top, whole = top + drawn[y].sum(), whole + drawn.sum()
                out.append(top / whole)
            yield pd.DataFrame({"estimate": out})

    estimates = spark.range(replicates).mapInPandas(run, "estimate double")
    # All replicates, a number that the caller sets, are put in order in one array.
    found = estimates.agg(F.sort_array(F.collect_list("estimate")).alias("e"))
    at = lambda q: F.col("e")[math.floor(q * (replicates - 1))]
    return found.select(F.lit(rate).alias("rate"), at(0.025).alias("low"), at(0.975).alias("high"), F.size("e").cast("long").alias("replicates"))
