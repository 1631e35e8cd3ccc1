"""Joins, roll-ups, integrity checks and merges that queries compose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.session import settle


def numbered(df: DataFrame, order: list[str], into: str, start: int = 1) -> DataFrame:
    """Numbers from ``start`` in order, for tables of any size: ranges of the order are numbered each by itself and shifted by the rows before them.

    Only a count for each partition meets in one place.
    """
    ranged = df.repartitionByRange(*order)
    ranged = settle(ranged.withColumn("__part", F.spark_partition_id()))  # the ranges are sampled, so they are fixed before they are counted
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(bases), "__part").withColumn(into, (F.col("__base") + at + (start - 1)).cast("long")).drop("__part", "__base")


def ordinal(df: DataFrame, order: list, into: str, start: int = 1) -> DataFrame:
    """Numbers from ``start`` in order. The rows go to one task: for tables of bounded size."""
    return df.withColumn(into, F.row_number().over(Window.orderBy(*order)) + (start - 1))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order."""
    ranked = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__at = 1").drop("__at")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order, by a partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty if the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key with its side: both, left or right."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def upsert(current: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``change`` in place of equal keys; ``change`` has unique keys."""
    return current.join(change.select(*keys), keys, "left_anti").unionByName(change)


def set_overlap(rows: DataFrame, group: list[str], item: str, in_a: Column, in_b: Column) -> DataFrame:
    """Per group: items of a, of b, of both, of either, and their Jaccard ratio (null without items)."""
    items = rows.groupBy(*group, item).agg(F.bool_or(in_a).alias("a"), F.bool_or(in_b).alias("b"))
    counts = items.groupBy(*group).agg(*[F.count_if(c).alias(n) for n, c in (("n_a", F.col("a")), ("n_b", F.col("b")), ("n_both", F.col("a") & F.col("b")), ("n_either", F.col("a") | F.col("b")))])
    return counts.withColumn("jaccard", F.try_divide("n_both", "n_either"))


def disputed(a: str, b: str, fields: list[str]) -> Column:
    """Names of the fields in which two sides differ, null equal to null."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields]))


def fieldwise(a: str, b: str, c: str, fields: list[str]) -> list[Column]:
    """Each field from a where a and b agree, else from the adjudicator c."""
    return [F.when(F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.col(f"{a}.{f}")).otherwise(F.col(f"{c}.{f}")).alias(f) for f in fields]


def largest_remainder(strata: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """Whole allocations that sum to ``total``: floors, then one more by descending fraction, ties by descending name, within each size.

    Strata are few; shares are compared as whole numbers. Raises where the strata can't hold ``total`` in this way.
    """
    every = Window.partitionBy()
    rows = strata.withColumn("__all", F.sum(size).over(every)).withColumn("base", F.expr(f"{size} * {total} div __all").cast("long"))
    rows = rows.withColumn("__rest", F.col(size) * total - F.col("base") * F.col("__all")).withColumn("__left", F.lit(total) - F.sum("base").over(every))
    rows = rows.withColumn("__at", F.row_number().over(Window.orderBy(F.desc("__rest"), F.desc(name))))
    given = F.least(F.col(size), F.col("base") + (F.col("__at") <= F.col("__left")).cast("long"))
    rows = rows.withColumn("allocation", given.cast("long"))
    short = F.sum("allocation").over(every) < total
    rows = rows.withColumn("allocation", F.when(short, F.raise_error(F.lit("the strata are smaller than their allocation")).cast("long")).otherwise(F.col("allocation")))
    return rows.drop("__all", "__rest", "__left", "__at", "base")


def sample_strata(rows: DataFrame, strata: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows of each stratum, as many as its ``allocation``, first by a seeded hash of the key.

    ``strata`` (stratum, size, allocation) is bounded by the caller. Only rows whose hash lies a little above their stratum's share are ranked;
    should a stratum then lack rows, which is all but impossible, everything is ranked.
    """
    placed = rows.join(F.broadcast(strata), "stratum").withColumn("__place", F.sha2(F.concat_ws("|", F.lit(seed), key), 256))
    share = F.conv(F.substring("__place", 1, 8), 16, 10).cast("double") / F.lit(2**32)
    near = placed.filter(share <= (F.col("allocation") + 8 * F.sqrt("allocation") + 40) / F.col("size"))
    short = near.groupBy("stratum", "allocation").agg(F.count(F.lit(1)).alias("n")).filter("n < allocation").limit(1).count()
    missing = strata.filter("allocation > 0").join(near.select("stratum").distinct(), "stratum", "left_anti").limit(1).count()
    order = Window.partitionBy("stratum").orderBy("__place", key)
    return (placed if short or missing else near).withColumn("__at", F.row_number().over(order)).filter("__at <= allocation").drop("__at", "__place")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, label): least vertex reachable, by label propagation with pointer jumping until nothing changes."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = settle(both)
    labels = settle(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels["v"] == heard["a"]).select("v", F.col("label").alias("old"), F.least("label", "heard").alias("next"))
        far = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        found = settle(step.join(far, "next", "left").select("v", "old", F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = found.select("v", "label")
        if not found.filter("old <> label").limit(1).count():
            return labels


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among the finished ones: what a resumed run has still to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """``rows`` with ``place``, a seeded hash of the key, in its order: a shuffle that any run repeats."""
    return rows.withColumn("place", F.sha2(F.concat_ws("|", F.lit(str(seed)), key), 256)).orderBy("place", key)


def shuffled_batches(rows: DataFrame, seed: int, batch: str, key: str) -> DataFrame:
    """``place`` from 1 of each row in its batch, shuffled by the seed plus the batch number."""
    order = F.sha2(F.concat_ws("|", (F.lit(seed) + F.col(batch)).cast("string"), key), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(order, key)).cast("long"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def best_match(candidates: DataFrame, baseline: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per candidate (id, name): id, base, method, score of its baseline entry.

    ``baseline`` has base, name and a unique pos. Names are compared normalised: an equal one wins with score 1, the first in order of
    pos; else the entry with the greatest Jaccard ratio of words of over one character does, the first of equal ones,
    if the ratio is at least ``threshold``. Below it base and method are empty and the score is kept; it is 0 where no word is
    shared or the name is empty. Only pairs that share a word are scored, by an inverted index. Candidates' ids are unique.
    """
    names = candidates.select("id", text.normalize_name(F.col("name")).alias("name"), text.token_set(F.col("name")).alias("t"))
    held = baseline.select("base", "pos", text.normalize_name(F.col("name")).alias("name"), text.token_set(F.col("name")).alias("bt"))
    same = held.filter("name <> ''").groupBy("name").agg(F.min_by("base", "pos").alias("same"))
    index = held.select("base", "pos", F.size("bt").alias("nb"), F.explode("bt").alias("w"))
    words = names.join(same, "name", "left_anti").select("id", F.size("t").alias("n"), F.explode("t").alias("w"))
    pairs = words.join(index, "w").groupBy("id", "base", "pos", "n", "nb").agg(F.count(F.lit(1)).alias("i"))
    pairs = pairs.withColumn("score", F.col("i") / (F.col("n") + F.col("nb") - F.col("i")))
    best = pairs.groupBy("id").agg(F.max_by(F.struct("base", "score"), F.struct("score", -F.col("pos"))).alias("best"))
    rows = names.select("id", "name").join(same, "name", "left").join(best, "id", "left")
    score = F.when(F.col("same").isNotNull(), 1.0).otherwise(F.coalesce("best.score", F.lit(0.0)))
    near = F.col("best.score") >= threshold
    base = F.when(F.col("same").isNotNull(), F.col("same")).when(near, F.col("best.base")).otherwise("")
    method = F.when(F.col("same").isNotNull(), "exact_normalized_name").when(near, "token_jaccard_review").otherwise("")
    return rows.select("id", base.alias("base"), method.alias("method"), score.alias("score"))
