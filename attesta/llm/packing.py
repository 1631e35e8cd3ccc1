"""Variable-capacity best-fit packing.

Documents are cut into pieces of at most the longest permitted length. Pieces of equal length are
interchangeable, so best-fit-decreasing runs on the histogram of lengths - at most as
many entries as the longest length, whatever the number of documents - and places runs of equal
pieces into runs of equal bins at once. That gives the same bins as placing pieces
one by one. The result is a table of runs that each piece finds by its length and its rank among the pieces
of that length.

A bin is opened at the permitted length with the least cost for a token it can expect to hold
(cost of the length over the expected fill from what is still unplaced); in the end each bin shrinks to
the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_IDS, cut, given_name, hash32, positions


def word_count(text_col: str = "text") -> Column:
    """Words of non-white-space, the default token measure."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def bin_cost(length: int, quadratic: float) -> float:
    """Cost of one sequence: linear layers plus attention."""
    return length + quadratic * length * length


def pack_histogram(histogram: dict[int, int], lengths: tuple[int, ...], quadratic: float) -> tuple[list[tuple], dict[int, int]]:
    """Best-fit-decreasing over (length -> pieces).

    Returns runs (piece length, first rank, end rank, first bin, pieces a bin, offset in the bin) and groups of equal bins
    [first bin, bins, opened length, used]. A run of pieces fills its bins in rank order.
    """
    lengths = tuple(sorted(lengths))
    groups: dict[int, list[list[int]]] = defaultdict(list)  # room -> [first bin, bins, capacity, used]
    rooms: list[int] = []  # the keys of groups, in order
    runs, bins = [], 0
    closed: list[list[int]] = []
    below = sum(n * size for size, n in histogram.items())

    def put(room: int, group: list[int]) -> None:
        if room not in groups:
            insort(rooms, room)
        groups[room].append(group)

    for size in sorted(histogram, reverse=True):
        count, rank = histogram[size], 0
        below -= size * count
        while count:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                # Open: what a bin can hold is its capacity, as far as unplaced pieces reach to fill it.
                def price(capacity: int) -> tuple[float, int]:
                    alike = min(count, capacity // size)
                    fill = alike * size + min(capacity - alike * size, below)
                    return bin_cost(capacity, quadratic) / fill, -capacity

                capacity = min((c for c in lengths if c >= size), key=price)
                each = min(count, capacity // size)
                opened = count // each
                group = [bins, opened, capacity, 0]
                bins += opened
            else:
                room = rooms[at]
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
                each = min(room // size, count)
                if each * group[1] > count:  # only part of this group's bins
                    part = count // each
                    put(room, [group[0] + part, group[1] - part, group[2], group[3]])
                    group = [group[0], part, group[2], group[3]]
            runs.append((size, rank, rank + each * group[1], group[0], each, group[3]))
            rank += each * group[1]
            count -= each * group[1]
            group = [group[0], group[1], group[2], group[3] + each * size]
            if group[2] > group[3]:
                put(group[2] - group[3], group)
            else:
                closed.append(group)
    closed += [g for held in groups.values() for g in held]
    return runs, closed


#: Over any rank: lengths and ranks are searched as one number.
_STRIDE = 2**44


def run_table(runs: list[tuple], groups: list[list[int]], lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Arrays by (length, first rank): first bin, pieces a bin, offset, and the bins' final contents and length.

    Runs are split where their bins end in different groups, so the table has one entry for each group and run of
    pieces in it: a number bounded by the longest length, not by the documents.
    """
    groups = sorted(groups)
    starts = [g[0] for g in groups]
    rows = []
    for size, first, end, bin_, each, at in runs:
        last = bin_ + (end - first) // each
        k = bisect_right(starts, bin_) - 1
        while bin_ < last:
            b, n, _, used = groups[k]
            stop = min(last, b + n)
            rows.append((size, first, bin_, each, at, used, next(c for c in lengths if c >= used)))
            first += (stop - bin_) * each
            bin_, k = stop, k + 1
    rows.sort()
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 7).T.copy())


OUT = ["piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_used", "bin_length"]
_BINS = "bin_id long, bin_offset long, bin_used long, bin_length long"


def cut_pieces(docs: DataFrame, longest: int, tokens: Column, id_col: str, place: Column | None = None) -> DataFrame:
    """__id, __place, piece, start and n_tokens of every piece of at most ``longest`` tokens."""
    place = F.lit(None).cast("long") if place is None else place
    counted = docs.select(F.col(f"`{id_col}`").alias("__id"), place.alias("__place"), tokens.cast("long").alias("__tokens")).filter("__tokens > 0")
    pieces = counted.withColumn("piece", F.explode(F.expr(f"sequence(0L, (__tokens - 1) div {longest})")))
    return pieces.select("__id", "__place", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("__tokens") - F.col("piece") * longest).cast("long").alias("n_tokens"))


def places(table: tuple[np.ndarray, ...], n: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
    """Places of pieces by their lengths ``n`` and ranks among the pieces of that length."""
    size, first, bins, each, offset, used, length = table
    at = np.searchsorted(size * _STRIDE + first, n * _STRIDE + rank, "right") - 1
    step = rank - first[at]
    return {"bin_id": bins[at] + step // each[at], "bin_offset": offset[at] + step % each[at] * n, "bin_used": used[at], "bin_length": length[at]}


def pack(docs: DataFrame, lengths: tuple[int, ...] = (1024, 2048, 4096, 8192), tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", quadratic: float = 1 / 65536) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, bin_offset, bin_used, bin_length.

    ``tokens`` counts a row's tokens (default: words). A piece spans ``[start, start + n_tokens)`` of its row's tokens, so a very long text gives
    many. Rows without tokens (null, empty or blank texts) need no place and give no piece; every other token is in exactly one bin.
    Rows that share an id, or whose id is null, are packed each; pieces of equal length tie by a hash of the id, then the id. Other columns are ignored,
    whatever their names; an id column named as an output column is given back with ``_in`` after its name. An empty table gives an empty result.
    """
    lengths = tuple(sorted({int(x) for x in lengths}))
    longest = lengths[-1]
    pieces = cut(cut_pieces(docs, longest, word_count(text_col) if tokens is None else tokens, id_col), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `longest` rows
    table = run_table(*pack_histogram(histogram, lengths, quadratic), lengths)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = places(held.value, x["n_tokens"].to_numpy(), x["__rank_of"].to_numpy())
            yield x[["__id", "piece", "start", "n_tokens"]].assign(**found)

    ranked = positions(pieces.withColumn("__place", hash32("__id", "piece")), "n_tokens", "__place", ["__id", "piece"], "__rank_of")
    kind = dict(docs.dtypes)[id_col]
    placed = ranked.select("__id", "piece", "start", "n_tokens", "__rank_of").mapInPandas(place, f"__id {kind}, piece long, start long, n_tokens long, {_BINS}")
    return placed.withColumnRenamed("__id", given_name(id_col, OUT))


def pack_pieces(pieces: DataFrame, lengths: tuple[int, ...], window: int, quadratic: float = 1 / 65536) -> DataFrame:
    """``pieces`` (__id, __place, piece, start, n_tokens) with their bins, packed within windows of ``window`` places.

    Pieces of one window share bins, with none of another; pieces of equal length are taken
    in the order of places; bins are numbered window by window, within one by their earliest piece. Each
    window is packed in one task, which holds numbers only: no more rows than the window's pieces.
    """
    lengths = tuple(sorted({int(x) for x in lengths}))
    if window < 1:
        raise ValueError("window is a positive integer")
    columns = ["__window", "__id", "__place", "piece", "start", "n_tokens"]
    kind = dict(pieces.dtypes)["__id"]

    def fill(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["__place", "__id", "piece"], ignore_index=True)
        rank = x.groupby("n_tokens").cumcount().to_numpy()
        runs, groups = pack_histogram(x["n_tokens"].value_counts().to_dict(), lengths, quadratic)
        found = places(run_table(runs, groups, lengths), x["n_tokens"].to_numpy(), rank)
        found["bin_id"] = pd.factorize(found["bin_id"])[0]  # by the first piece in order
        return x[columns].assign(**found)

    windowed = pieces.select(F.expr(f"__place div {window}").alias("__window"), *columns[1:])
    schema = f"__window long, __id {kind}, __place long, piece long, start long, n_tokens long, {_BINS}"
    filled = cut(windowed.groupBy("__window").applyInPandas(fill, schema), "windows")
    # One row a window. Ranges of windows are summed first, so that no task holds a row for each window of a large corpus.
    bins = filled.groupBy("__window").agg((F.max("bin_id") + 1).alias("__bins")).withColumn("__range", F.expr("__window div 4096"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = bins.groupBy("__range").agg(F.sum("__bins").alias("__all"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__all").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__far"))
    within = F.coalesce(F.sum("__bins").over(before(Window.partitionBy("__range").orderBy("__window"))), F.lit(0))
    bases = bins.withColumn("__near", within).join(ranges, "__range").select("__window", (F.col("__near") + F.col("__far")).alias("__base"))
    placed = filled.join(bases, "__window").withColumn("bin_id", F.col("bin_id") + F.col("__base"))
    return placed.select("__id", "__place", *OUT)


def pack_in_order(docs: DataFrame, lengths: tuple[int, ...] = (1024, 2048, 4096, 8192), place_col: str = "mix_pos", window: int = 1024, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", quadratic: float = 1 / 65536) -> DataFrame:
    """``pack`` within windows of ``window`` places, so that the bins follow the order of ``place_col``.

    A row belongs to the window of its place (a whole number from 0, not null and its own: rows that share a place are ordered by id, and a
    window holds as many rows as it has places). The last bins of each window stay less full than those of ``pack``.
    """
    pieces = cut_pieces(docs, max(map(int, lengths)), word_count(text_col) if tokens is None else tokens, id_col, F.col(f"`{place_col}`").cast("long"))
    return pack_pieces(pieces, lengths, window, quadratic).drop("__place").withColumnRenamed("__id", given_name(id_col, OUT))


def pack_texts(pieces: DataFrame, lengths: tuple[int, ...] = (1024, 2048, 4096, 8192), place_col: str = "mix_pos", window: int = 1024, id_col: str = "doc_id", text_col: str = "text", quadratic: float = 1 / 65536) -> DataFrame:
    """Training sequences: ``pack_pieces`` over pieces that carry their text (``token_pieces``), each row with its piece's text.

    The texts of a bin's pieces, in the order of ``bin_offset``, make its sequence; those of a document's pieces, in their order, the
    document. Places are as for ``pack_in_order``. The texts don't pass through the packing: a few places are broadcast to them, more are
    joined by shuffling.
    """
    own = pieces.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{place_col}`").cast("long").alias("__place"), "piece", "start", "n_tokens", F.col(f"`{text_col}`").alias("__text"))
    own = cut(own, "token-pieces")
    placed = cut(pack_pieces(own, lengths, window, quadratic), "placed").select("__id", "__place", "piece", *OUT[3:])
    placed = F.broadcast(placed) if placed.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2 else placed
    same = own["__id"].eqNullSafe(placed["__id"]) & (own["__place"] == placed["__place"]) & (own["piece"] == placed["piece"])
    joined = own.join(placed, same).select(own["__id"], own["piece"], "start", "n_tokens", *OUT[3:], F.col("__text"))
    return joined.withColumnRenamed("__id", given_name(id_col, [*OUT, text_col])).withColumnRenamed("__text", text_col)
