"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts strings of up to five bytes in all trusted texts. Counts, continuation counts, discounts, interpolation
weights and probabilities are DataFrame joins and aggregations over the table of distinct strings.

For scoring, documents go into blocks of some 32 MB. Each block names the distinct strings and contexts of its texts; a join by string with
the model, sharded by hash over the executors, gives back those that the model knows; and each block meets its own answers in one task, which adds up the
log probabilities of its documents. The model is never in one place, and a string that a block holds a thousand times is joined once.
A document is kept if its perplexity is within its language's quantile
among the trusted texts, times a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, drop, given_name, keep_ids, small_batches

ORDER = 5
#: Text bytes handled at a time.
CHUNK = 1 << 20
#: Text bytes of a block.
BLOCK = 32 << 20
#: Bins of a log perplexity of one, for the quantiles.
BINS = 10_000


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes that end at each byte, padded with zeros before a text, as one number; and the texts' bounds."""
    pad = b"\0" * (ORDER - 1)
    raw = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    grams = np.zeros(max(0, len(raw) - ORDER + 1), np.int64)
    for k in range(ORDER):
        grams = (grams << 8) | raw[k : k + len(grams)]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return grams[keep], np.concatenate(([0], np.cumsum(sizes)))


def grouped(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of about a chunk; a longer text is alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > CHUNK:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def count_strings(texts: DataFrame) -> DataFrame:
    """(gram, c): how often each string of ORDER bytes occurs in column ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in grouped(bytes(x) for x in batch["text"]):
                for lo in range(0, max(1, sum(map(len, part))), 8 * CHUNK):
                    grams, times = np.unique(packed(part)[0][lo : lo + 8 * CHUNK], return_counts=True)
                    yield pd.DataFrame({"gram": grams, "c": times})

    return texts.mapInPandas(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more; within what the counts allow."""
    if not ones or not twos:
        return 0.5, 0.75, 0.9
    y = ones / (ones + 2 * twos)
    d1 = 1 - 2 * y * twos / ones
    d2 = 2 - 3 * y * threes / twos
    d3 = 3 - 4 * y * fours / threes if threes else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def train(texts: DataFrame) -> DataFrame:
    """(level, is_context, gram, value): log probabilities of strings and log interpolation weights of contexts."""
    levels = {ORDER: cut(count_strings(texts), "counts")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(2 ** (8 * k) - 1)).alias("gram")
        levels[k] = cut(levels[k + 1].groupBy(shorter).agg(F.count(F.lit(1)).alias("c")), "continuations")
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        n = [F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]
        d1, d2, d3 = discounts(*levels[k].agg(*[x.alias(f"n{i}") for i, x in enumerate(n)]).first())
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        own = levels[k].select("gram", "c", F.shiftright("gram", 8).alias("context"))
        context = own.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(discount) / F.sum("c")).alias("weight"))
        own = own.join(context, "context").withColumn("alone", (F.col("c") - discount) / F.col("total"))
        if lower is None:
            own = own.withColumn("p", F.col("alone") + F.col("weight") / 256)
        else:
            tail = F.col("gram").bitwiseAND(F.lit(2 ** (8 * (k - 1)) - 1))
            own = own.withColumn("tail", tail).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail").withColumn("p", F.col("alone") + F.col("weight") * F.col("q"))
        lower = cut(own.select("gram", "p", "context", "weight"), "level")
        parts.append(lower.select(F.lit(k).alias("level"), F.lit(False).alias("is_context"), "gram", F.log("p").alias("value")))
        parts.append(lower.groupBy("context").agg(F.first("weight").alias("weight")).select(F.lit(k).alias("level"), F.lit(True).alias("is_context"), F.col("context").alias("gram"), F.log("weight").alias("value")))
    return cut(reduce(DataFrame.union, parts), "model")


def log_probabilities(grams: np.ndarray, model: dict) -> np.ndarray:
    """Of each packed string's last byte after the others: the longest string known, after the weights of the contexts above it."""
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        own = grams[open_] & (2 ** (8 * k) - 1)
        keys, values = model[(k, False)]
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        if known.any():
            out[open_[known]] += values[at[known]]
        open_ = open_[~known]
        if not len(open_):
            return out
        keys, weights = model[(k, True)]
        own = (grams[open_] & (2 ** (8 * k) - 1)) >> 8
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        if len(keys):
            out[open_] += np.where(keys[at] == own, weights[at], 0.0)
    out[open_] += np.log(1 / 256)
    return out


def strings_asked(grams: np.ndarray) -> np.ndarray:
    """The keys of all strings and contexts that the distinct packed ``grams`` can need."""
    asked = []
    for k in range(ORDER, 0, -1):
        grams = np.unique(grams & (2 ** (8 * k) - 1))
        asked += [key_of(k, False, grams), key_of(k, True, np.unique(grams >> 8))]
    return np.concatenate(asked)


def key_of(level, is_context, gram):
    """One number for a string or context of a level; the same over columns and arrays."""
    return gram + (2 * level + is_context) * 2 ** (8 * ORDER)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, held): the rows (id, lang, text) of ``docs`` in blocks, compressed, each block from one task's rows in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size, k = [], 0, 0
        task = TaskContext.get().partitionId()

        def packed_block() -> pd.DataFrame:
            table = pa.table({"id": pa.array([r[0] for r in part], pa.int64()), "lang": pa.array([r[1] for r in part], pa.string()), "text": pa.array([r[2] for r in part], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pd.DataFrame({"block": [task * 2**24 + k], "held": [sink.getvalue().to_pybytes()]})

        for batch in batches:
            for key, lang, text in zip(batch["id"], batch["lang"], batch["text"], strict=True):
                if part and size + len(text) > BLOCK:
                    yield packed_block()
                    part, size, k = [], 0, k + 1
                part.append((None if pd.isna(key) else int(key), lang if isinstance(lang, str) else None, bytes(text)))
                size += len(text)
        if part:
            yield packed_block()

    return docs.mapInPandas(run, "block long, held binary")


def rows_of(held: bytes) -> tuple[list, list, list[bytes]]:
    table = pa.ipc.open_stream(held).read_all()
    return table["id"].to_pylist(), table["lang"].to_pylist(), table["text"].to_pylist()


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(id, lang, n, loglik): one row for each row of ``docs`` (id, lang, text).

    The blocks are shuffled once, for what they ask and for their scores.
    """
    held = blocks(docs).repartition("block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, own in zip(batch["block"], batch["held"], strict=True):
                found = [np.unique(grams[lo : lo + 8 * CHUNK]) for part in grouped(iter(rows_of(own)[2])) for grams in (packed(part)[0],) for lo in range(0, len(grams), 8 * CHUNK)]
                if found:
                    yield pd.DataFrame({"block": block, "key": strings_asked(np.unique(np.concatenate(found)))})

    known = model.select(key_of(F.col("level"), F.col("is_context").cast("long"), F.col("gram")).cast("long").alias("key"), "value")
    answers = held.mapInPandas(ask, "block long, key long").join(known, "key").select("block", "key", F.col("value").cast("float").alias("value"))

    def add_up(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("key")
        keys, values = answers["key"].to_numpy(np.int64), answers["value"].to_numpy(float)
        arrays = {}
        for k in range(1, ORDER + 1):
            for context in (False, True):
                lo, hi = np.searchsorted(keys, [key_of(k, context, 0), key_of(k, context, 2 ** (8 * ORDER))])
                arrays[(k, context)] = keys[lo:hi] - key_of(k, context, 0), values[lo:hi]
        ids, langs, sizes, sums = [], [], [], []
        for one in own["held"]:
            some_ids, some_langs, texts = rows_of(one)
            ids, langs = ids + some_ids, langs + some_langs
            sizes += [len(x) for x in texts]
            for part in grouped(iter(texts)):
                grams, bounds = packed(part)
                total = np.zeros(len(grams) + 1)
                for lo in range(0, len(grams), 8 * CHUNK):
                    one_each, back = np.unique(grams[lo : lo + 8 * CHUNK], return_inverse=True)
                    total[lo + 1 : lo + 1 + len(back)] = log_probabilities(one_each, arrays)[back]
                total = np.cumsum(total)
                sums += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
        return pd.DataFrame({"id": pd.array(ids, "Int64"), "lang": langs, "n": sizes, "loglik": sums})

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add_up, "id long, lang string, n long, loglik double")


def limits(known: DataFrame, by: list[str], quantile: float, margin: float) -> DataFrame:
    """``own``: the ``quantile`` of the perplexities by ``by``, times ``margin``.

    Taken from counts of log perplexities rounded to 1/BINS, so neither order nor partitioning matters, and no task holds more than the bins.
    """
    bins = known.groupBy(*by, F.round(F.log("perplexity") * BINS).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*by)
    upto = bins.withColumn("upto", F.sum("c").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(whole))
    return upto.filter(F.col("upto") >= F.col("all") * quantile).groupBy(*by).agg((F.exp(F.min("bin") / BINS) * margin).alias("own"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, margin: float = 1.15) -> DataFrame:
    """One row per row of ``docs``: id, lang, n_bytes, perplexity (of a byte), threshold, kept.

    ``trusted`` has the ids of trusted documents (other columns ignored, null ids too). Four fifths of them train the model; the perplexities
    of the others give each language's ``quantile`` (those of all where there are no others). A language without such text, and a null
    one, uses the quantile over all languages; a text at the limit is kept. A null or empty text
    has no perplexity and isn't kept. Without any trusted text nothing has a threshold and everything with text is kept. Texts of any length are
    scored whole. Rows that share an id are scored each by itself; all of them train the model if the id is trusted. Other columns are ignored, whatever
    their names; id and language columns named as results are given back with ``_in`` after their names. An empty table gives an empty result.
    """
    own = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    ids = cut(trusted.select(F.col(f"`{id_col}`").cast("long").alias("id")).filter("id is not null").distinct(), "trusted")
    # A fifth of the trusted texts stays out of the model, so their perplexities are those of unseen text.
    apart = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    model = train(keep_ids(own, ids.filter(~apart), "id").select("text"))
    scored = score(own, model)
    scored = cut(scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("loglik") / F.col("n")))), "scores")
    known = cut(keep_ids(scored, ids, "id").filter("perplexity is not null"), "known")
    if known.filter(apart).limit(1).count():
        known = known.filter(apart)
    of_all = limits(known, [], quantile, margin).first()
    by_language = limits(known.filter("lang is not null"), ["lang"], quantile, margin)
    found = scored.join(by_language, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(of_all and of_all["own"]).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    drop(model)
    out = ["n_bytes", "perplexity", "threshold", "kept"]
    return found.select(F.col("id").alias(given_name(id_col, out)), F.col("lang").alias(given_name(lang_col, out)), F.col("n").alias("n_bytes"), "perplexity", "threshold", kept.alias("kept"))
