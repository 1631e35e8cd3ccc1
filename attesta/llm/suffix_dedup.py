"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else too.

Strings of ``length`` bytes are equal only if their minimisers (the least hash among their 16-byte strings) are, so each
text is cut into segments whose strings share one minimiser, and only segments with a minimiser found twice or more
go on. Equal segments are settled by their digest. Of the different ones under a minimiser, one of each
goes into a block whose Burrows-Wheeler transform is searched for common prefixes by interval expansion (``prefix_intervals``).
A minimiser with more than ``most_segments`` different segments, or ``HOT_BYTES`` of them, as around a passage in very many documents, would make
an unbounded block: its strings are counted by digest instead, which is exact as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop, given_name, keep_ids, small_batches
from attesta.llm.prefix_intervals import repeated_starts
from attesta.llm.shingles import _tables, mix

GRAM = 16
#: Bytes of a text handled at a time; longer texts go in pieces that overlap.
PIECE = 1 << 19
#: Bytes of segments in one transform.
BLOCK = 1 << 20
#: Bytes of different segments of one minimiser that one transform takes.
HOT_BYTES = 4 << 20
_NO_ID = -(2**63)
_KEY = ["id", "twin"]


def _segments(text: bytes, length: int) -> Iterator[tuple]:
    """Of each piece: its offset, then first start, end of starts, minimiser, digest and self-repeat of its segments."""
    for offset in range(0, max(1, len(text) - length + 1), PIECE):
        raw = np.frombuffer(text[offset : offset + PIECE + length - 1], np.uint8)
        n = len(raw)
        if n < length:
            return
        power, inverse = _tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
        width, least, span = length - GRAM + 1, grams, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: n - length + 1], least[width - span : width - span + n - length + 1])
        edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        stop = np.concatenate((edge[1:], [len(least)]))
        digest = mix((total[stop + length - 1] - total[edge]) * inverse[edge] + stop.astype(np.uint64) - edge.astype(np.uint64))
        yield offset, edge, stop, least[edge], digest, _held_twice(grams, edge, stop + width - 1, least[edge])


def _held_twice(grams: np.ndarray, first: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether a segment holds its minimiser more than once, so that its own strings may be equal."""
    values = np.unique(anchor)
    at = np.flatnonzero(grams <= values[-1])
    rank = np.searchsorted(values, grams[at])
    own = values[rank] == grams[at]
    place = np.sort(rank[own] * (2 * PIECE) + at[own])
    mine = np.searchsorted(values, anchor) * (2 * PIECE)
    return np.searchsorted(place, mine + end) - np.searchsorted(place, mine + first) > 1


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, id, twin, start, size, many) of every segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            count = 0
            for key, twin, text in zip(batch["id"], batch["twin"], batch["text"], strict=True):
                for offset, first, stop, anchor, digest, many in _segments(bytes(text), length):
                    out.append(((key, twin), len(first), offset + first, stop - first + length - 1, anchor, digest, many))
                    count += len(first)
                if count > 100_000:
                    yield table(out)
                    out, count = [], 0
            yield table(out)

    def table(out: list[tuple]) -> pd.DataFrame:
        both = lambda k, kind: np.concatenate([x[k] for x in out]).astype(kind) if out else np.zeros(0, kind)
        key = np.repeat(np.array([x[0] for x in out], np.int64).reshape(-1, 2), np.array([x[1] for x in out], np.int64), axis=0)
        return pd.DataFrame({"anchor": both(4, np.uint64).view(np.int64), "digest": both(5, np.uint64).view(np.int64), "id": key[:, 0], "twin": key[:, 1], "start": both(2, np.int64), "size": both(3, np.int32), "many": both(6, bool)})

    return docs.mapInPandas(run, "anchor long, digest long, id long, twin long, start long, size int, many boolean")


def _expand(block: list[tuple[tuple[int, int], int, bytes, bool]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans (id, twin, from, to) of repeated strings among the segments of a block."""
    raw = np.frombuffer(b"\0".join(x[2] for x in block) + b"\0", np.uint8).astype(np.int16) + 1
    sizes = np.array([len(x[2]) for x in block])
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 0
    found = repeated_starts(raw, length)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
    for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        at = int(np.searchsorted(ends, lo))
        key, start, text, settled = block[at]
        if not settled:
            base = start - (int(ends[at]) - len(text))
            yield *key, base + lo, base + hi - 1 + length


def repeats(docs: DataFrame, length: int, most_segments: int) -> DataFrame:
    """(id, twin, lo, hi): spans of bytes covered by strings that start anywhere else too."""
    every = cut(segments(docs, length), "every")
    shared = every.groupBy("anchor").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c")).filter("c > 1").select("anchor")
    found = cut(every.join(shared, "anchor"), "segments")
    kinds = found.groupBy("anchor", "digest", "size").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "twin", "start", "many")).alias("one"))
    kinds = cut(kinds.select("anchor", "digest", "size", "times", "one.*"), "kinds")
    equal = found.join(kinds.filter("times > 1").select("anchor", "digest", "size"), ["anchor", "digest", "size"], "left_semi")
    spans = equal.select(*_KEY, F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))

    drop(every)
    differing = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes"), F.max(F.col("many") & (F.col("times") == 1)).alias("many")).filter("kinds > 1 or many").drop("many")
    chosen = kinds.join(differing, "anchor").select("anchor", *_KEY, "start", "size", (F.col("times") > 1).alias("settled"), ((F.col("kinds") > most_segments) | (F.col("bytes") > HOT_BYTES)).alias("hot"))
    asked = cut(chosen.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "start", "size", "settled", "hot")).alias("asked")), "asked")
    texts = keep_ids(docs, asked.select("id").distinct(), "id").join(asked, _KEY)
    piece = F.expr("substring(text, int(x.start) + 1, x.size)")
    pieces = cut(texts.select(*_KEY, "text", F.explode("asked").alias("x")).select("x.anchor", *_KEY, "x.start", piece.alias("piece"), "x.settled", "x.hot"), "pieces")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            out: list[tuple] = []
            for anchor, key, twin, start, text, settled in zip(batch["anchor"], batch["id"], batch["twin"], batch["start"], batch["piece"], batch["settled"], strict=True):
                if anchor != last and size > BLOCK:
                    out += _expand(block, length)
                    block, size = [], 0
                block.append(((key, twin), start, bytes(text), settled))
                size += len(block[-1][2]) + 1
                last = anchor
            yield pd.DataFrame(out, columns=[*_KEY, "lo", "hi"])
        yield pd.DataFrame(list(_expand(block, length)) if block else [], columns=[*_KEY, "lo", "hi"])

    usual = pieces.filter("not hot").select("anchor", *_KEY, "start", "piece", "settled")
    grown = usual.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(expand, "id long, twin long, lo long, hi long")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, twin, start, text, settled in zip(batch["id"], batch["twin"], batch["start"], batch["piece"], batch["settled"], strict=True):
                text = bytes(text)
                own = [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(len(text) - length + 1)]
                yield pd.DataFrame({"digest": own, "id": key, "twin": twin, "start": np.arange(start, start + len(own)), "settled": settled})

    single = pieces.filter("hot").select(*_KEY, "start", "piece", "settled").mapInPandas(windows, "digest binary, id long, twin long, start long, settled boolean")
    single = cut(single, "windows")
    twice = single.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest")
    starts = single.filter("not settled").join(twice, "digest", "left_semi").select(*_KEY, "start")
    # Neighbouring starts make one span: a document's starts less their rank are equal within a run.
    rank = F.dense_rank().over(Window.partitionBy(*_KEY).orderBy("start"))
    runs = starts.withColumn("run", F.col("start") - rank).groupBy(*_KEY, "run").agg(F.min("start").alias("lo"), (F.max("start") + length).alias("hi"))
    counted = runs.select(*_KEY, "lo", "hi")
    return spans.union(grown).union(counted)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most_segments: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans, kept_bytes.

    Texts are UTF-8 bytes; a null one is empty. ``spans`` are the maximal removed runs [lo, hi) and ``kept_bytes`` the others
    joined, which may not be whole characters. Strings are judged on the input, matches never cross documents, and texts
    shorter than ``length`` lose nothing; of tied strings none stays. Very long texts go in pieces that overlap, whole. Rows that share an id, and rows
    without one, are documents of their own: repeated rows are covered by each other. Other columns are ignored, whatever their names; an id column named as
    a result is given back with ``_in`` after its name. An empty table gives an empty result.
    """
    docs = small_batches(docs).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    # Rows that share an id are told apart by their texts; equal texts have equal results.
    shared = cut(docs.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id"), "shared-ids")
    twin = F.lit(0).cast("long")
    if shared.limit(1).count():
        marked = docs.join(shared.withColumn("again", F.lit(True)), "id", "left")
        docs, twin = marked, F.when(F.col("again"), F.xxhash64("text")).otherwise(twin)
    docs = docs.select("id", twin.alias("twin"), "text")
    spans = cut(repeats(docs, length, most_segments), "spans")
    own = cut(spans.groupBy(*_KEY).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("found")), "spans-by-id")
    drop(spans)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, found in zip(batch["id"], batch["text"], batch["found"], strict=True):
                text, runs = bytes(text), []
                for x in () if found is None else found:
                    if runs and x["lo"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["hi"])
                    else:
                        runs.append([x["lo"], x["hi"]])
                kept, at = [], 0
                for lo, hi in runs:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                rows.append((key, len(text), sum(hi - lo for lo, hi in runs), [{"lo": lo, "hi": hi} for lo, hi in runs], b"".join(kept)))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "spans", "kept_bytes"])

    schema = "id long, n_bytes long, n_removed long, spans array<struct<lo:bigint,hi:bigint>>, kept_bytes binary"
    clean = own.select("id").distinct()
    hit = keep_ids(docs, clean, "id").join(own, _KEY, "left").mapInPandas(apply, schema)
    clean = keep_ids(docs, clean, "id", "left_anti").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)").alias("spans"), F.col("text").alias("kept_bytes"))
    found = clean.unionByName(hit)
    name = given_name(id_col, ["n_bytes", "n_removed", "spans", "kept_bytes"])
    return found.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", name)
