"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries find the digests that many rows share. The candidates are
counted exactly, and the verified winners - at most ``counters`` of them - are
broadcast, so rows of very frequent texts are settled on the map side. All other
digests go through an ordinary shuffle of digests and ids; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_IDS, cut, shield


def merge_summary(kept: dict, more: dict, counters: int) -> dict:
    """Misra-Gries merge: add the counts, then subtract the (counters+1)-th largest."""
    for key, n in more.items():
        kept[key] = kept.get(key, 0) + n
    if len(kept) <= counters:
        return kept
    least = sorted(kept.values(), reverse=True)[counters]
    return {key: n - least for key, n in kept.items() if n > least}


def heavy_digests(digests: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests; every one held by over 2/(counters+1) of the rows is among them."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            kept = merge_summary(kept, batch["digest"].value_counts().to_dict(), counters)
        yield pd.DataFrame({"digest": list(kept), "n": list(kept.values())})

    parts = digests.select("digest").mapInPandas(summarise, "digest binary, n long")
    found = parts.groupBy("digest").agg(F.sum("n").alias("n"))
    return found.filter("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, however long; null counts as empty, so nulls and empty texts form one
    group. The row with the largest id stays, one with a null id only where all ids of the group
    are null. Of rows that repeat both the id and the text that stay, one is marked kept, any of them.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # The number of a row is fixed by writing it; it tells apart rows that repeat each other.
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = F.broadcast(heavy_digests(rows, counters))
    totals = [F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size")]
    winners = F.broadcast(cut(rows.join(heavy, "digest").groupBy("digest").agg(*totals).filter("group_size > 1"), "winners"))
    settled = rows.join(winners, "digest")
    rest = rows.join(winners.select("digest"), "digest", "left_anti")
    others = rest.join(rest.groupBy("digest").agg(*totals), "digest")
    found = settled.unionByName(others)
    return found.select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    The dropped (id, digest) keys are broadcast while they are counted to be at most
    ``BROADCAST_IDS`` (some 30 MB), and joined by shuffling beyond that. Where rows repeat the id and the text that stay, one of them stays.
    """
    found = cut(exact_dedup(docs, id_col, text_col, counters), "copies")
    key = [F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha")]
    gone = cut(found.filter("not kept and not (doc_id <=> keep_id)").select(*key).distinct(), "dropped")
    again = cut(found.filter("not kept and doc_id <=> keep_id").select(*key).distinct(), "repeated")
    few = lambda keys: F.broadcast(keys) if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else keys
    own, names = shield(docs)
    own = own.withColumn("__digest", F.unhex(F.sha2(F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")), 256)))
    same = F.col(names[id_col]).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha"))
    stay = own.join(few(gone), same, "left_anti")
    if again.limit(1).count():
        repeated = few(again)
        one = stay.join(repeated, same, "left_semi").dropDuplicates([names[id_col], "__digest"])
        stay = stay.join(repeated, same, "left_anti").unionByName(one)
    return stay.select(*[F.col(n).alias(c) for c, n in names.items()])
