"""Language identification with language-bitmask n-gram filters.

Each language's profile is the set of character n-grams of its labelled texts. All profiles share one bit-sliced Bloom
filter: slot ``i`` holds a bitmask of languages (a word for every 64 of them), and the AND of an n-gram's slots is the set of languages
that contain it, found in one look-up for all languages. A document's popcounts by language are corrected for the
false-positive rate of that language's slice, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import shield, small_batches, unshield

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class BitmaskFilter:
    """languages, n-gram length, hashes, the slots (rows of 64 languages, one bit for each), and false-positive rates by language."""

    languages: list[str]
    n: int
    hashes: int
    slots: np.ndarray
    false_rate: np.ndarray


def letters_only(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space, and a space at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    keep = _LETTER[np.minimum(codes, len(_LETTER) - 1)]
    codes = np.where(keep, codes, np.uint32(32))
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)]))
    space = codes == 32
    return codes[~(space & np.concatenate(([False], space[:-1])))]


#: Which code points are letters; those past the basic plane count as one.
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)] + [True])


def ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of code points, as unsigned 64-bit numbers."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out = out * _MIX + wide[k : len(codes) - n + 1 + k]
    out ^= out >> np.uint64(31)
    return out * _MIX2


def _places(grams: np.ndarray, hashes: int, bits: int) -> Iterator[np.ndarray]:
    for k in range(hashes):
        mixed = (grams + np.uint64(k) * _MIX2) * _MIX
        yield (mixed >> np.uint64(64 - bits)).astype(np.int64)


def slot_masks(table: DataFrame, languages: list[str], hashes: int, bits: int) -> np.ndarray:
    """The slots of a filter from distinct (lang, gram) rows: masks are united by slot on the executors."""
    at = {language: k for k, language in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = batch["gram"].to_numpy(np.int64).view(np.uint64)
            order = batch["lang"].map(at).to_numpy(np.int64)
            mask = (np.uint64(1) << (order & 63).astype(np.uint64)).view(np.int64)
            for places in _places(grams, hashes, bits):
                yield pd.DataFrame({"word": order >> 6, "slot": places, "mask": mask})

    united = table.select("lang", "gram").mapInPandas(run, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    slots = np.zeros(((len(languages) + 63) // 64, 1 << bits), np.uint64)
    found = united.toPandas()  # at most 2 ** bits rows for every 64 languages
    slots[found["word"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return slots


def sealed(languages: list[str], n: int, hashes: int, slots: np.ndarray) -> BitmaskFilter:
    """A filter with the false-positive rate that each language's share of set slots gives."""
    load = np.array([(slots[at >> 6] >> np.uint64(at & 63) & np.uint64(1)).mean() for at in range(len(languages))])
    return BitmaskFilter(languages, n, hashes, slots, load**hashes)


def languages_of(grams: np.ndarray, model: BitmaskFilter) -> np.ndarray:
    """For each n-gram the bitmask of all languages that contain it, in rows of 64 languages."""
    masks = np.full((len(model.slots), len(grams)), ~np.uint64(0))
    for places in _places(grams, model.hashes, int(model.slots.shape[1]).bit_length() - 1):
        masks &= model.slots[:, places]
    return masks


def score(text: str | None, model: BitmaskFilter) -> tuple[str, float]:
    """The language and its share among the corrected counts; ``und`` and 0 without letters or a learned language."""
    if not text or not any(c.isalpha() for c in text) or not model.languages:
        return "und", 0.0
    grams = ngrams(letters_only(text), model.n)
    masks = languages_of(grams, model)
    hits = np.array([np.count_nonzero(masks[at >> 6] & (np.uint64(1) << np.uint64(at & 63))) for at in range(len(model.languages))], float)
    # Observed = true + (all - true) * rate, so true = (observed - all * rate) / (1 - rate).
    true = np.maximum(0, hits - len(grams) * model.false_rate) / np.maximum(1e-9, 1 - model.false_rate)
    best = int(np.argmax(true))
    total = true.sum()
    return model.languages[best], float(true[best] / total) if total > 0 else 1 / len(model.languages)


def learn(labelled: DataFrame, n: int = 4, sample: int = 4000, bits: int = 20, hashes: int = 2) -> BitmaskFilter:
    """A filter from (id, text, lang) rows.

    About ``sample`` rows of each language are read, those with the smallest hash of the id: the bound on labelled rows. Every
    n-gram of their whole texts belongs to the language's profile; none is left out. ``bits`` sets the slots (2 ** bits), whose load the false-positive
    rates follow. Rows without id, text or language teach nothing.
    """
    labelled = labelled.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    languages = sorted(counts)
    if not counts:
        return sealed([], n, hashes, np.zeros((0, 1 << bits), np.uint64))
    limit = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, sample / c) * 2**32)])
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(2**32)) < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                grams = np.unique(ngrams(letters_only(text), n))
                held.setdefault(lang, []).append(grams)
                size += len(grams)
            if size > 2_000_000:
                yield from merged(held)
                held, size = {}, 0
        yield from merged(held)

    def merged(held: dict[str, list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            yield pd.DataFrame({"lang": lang, "gram": np.unique(np.concatenate(parts)).view(np.int64)})

    table = chosen.mapInPandas(count, "lang string, gram long").distinct()
    return sealed(languages, n, hashes, slot_masks(table, languages, hashes, bits))


def identify(docs: DataFrame, model: BitmaskFilter, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``.

    The text alone decides, all of it, so repeated rows and rows that share an id agree. A null text or one without a letter gets ``und`` and score 0. Ties go to
    the first language in alphabetical order. Input columns named as the output ones may hold the text and are replaced; an empty table gives an
    empty result.
    """
    parts = (model.languages, model.n, model.hashes, model.slots, model.false_rate)
    held = docs.sparkSession.sparkContext.broadcast(parts)  # plain values need no import of this package to load

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = BitmaskFilter(*held.value)
        for batch in texts:
            yield pd.DataFrame([score(x, own) for x in batch], columns=["lang_pred", "score"])

    own, names = shield(small_batches(docs))
    found = own.withColumn("__found", predict(F.col(names[text_col]).cast("string")))
    for name in ("lang_pred", "score"):
        found = found.withColumn(name, F.col(f"__found.{name}"))
    return unshield(found, names, ["lang_pred", "score"])
