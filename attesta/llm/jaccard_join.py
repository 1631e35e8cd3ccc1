"""N-gram Jaccard join: size-aware, heavy-light.

Documents are sets of five-word shingles and link at a Jaccard similarity of 0.8 or more.

* Equal sets are one class; one representative goes on.
* Shingles are put in one order for all documents: by hash, with the most frequent ones (a
  bounded Misra-Gries summary over all shingles) last. Linked sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of either
  one, and two of them among the first ``n - ceil(0.8 n) + 2``.
* Light sets (up to ``boundary`` shingles) enumerate the 2-subsets of their prefix: a shared subset is a candidate.
* Heavy sets are found by scanning the inverted lists of their prefix. Sets from four fifths of the boundary are in these lists
  too, so pairs across it are found.
* The boundary is where the estimated records of both sides together are fewest.
* Candidates are compared on the shingles of their whole texts.

Lists are worked through in rounds, and documents already joined are one component from then on. In a round each list (of a
subset or a shingle) whose members belong to different components names one pivot, and the members outside the pivot's
component are compared with it: linear in the list, however long. The first round's pivots are the members whose lists are the longest, so the likely
centres of groups; later ones are drawn by hash, another one for each list. What the rounds leave in different components is then compared pair by
pair within the lists, so that every link between two components is found and no group meets itself again.

Each set carries a bitmap in which every shingle toggles one bit: two bitmaps differ in at most as many bits as the
sets in shingles, so pairs whose bitmaps differ in more than links allow are never compared. Bitmaps of single pairs have at least twice as many
places as shingles. Those in the lists have few places, and large sets would fill them, so
they are cut into parts by hash: if two sets link, then in some part the shares of both do too, since the ratio of two sums is at
most the largest ratio of their terms. Parts are listed and compared by bitmap like sets of their own.

Shingles are 64-bit hashes: two different ones are taken for equal with a chance of one in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import BROADCAST_IDS, cut, drop, keep_ids, small_batches
from attesta.llm.components import components
from attesta.llm.shingles import mix, shingle_sets

NO_ID = -(2**63)
#: Longs of the bitmap in which each shingle of a set toggles one bit.
BITS = 8
#: Sets above this size are never light, so the size histogram is bounded.
MOST_LIGHT = 200
#: Sets of this size are cut into 4 parts, those of 4 times the size into 16, and so on.
CUT = 512
#: Cost of one comparison within a list, in records written and shuffled; a posting meets this many others at most, as rounds are linear.
COMPARE, MET = 1 / 32, 64
#: Lists of a shingle that the summary counts more often are counted in parts of about this many rows.
HOT = 1000
#: Lists of up to this many members give their pairs as they are, which is linear; longer ones are compared by short bitmaps first.
SHORT = 8
#: In a round, a pivot must share one in this many of a document's prefix shingles: chance meetings are left for the last pass.
SHARED = 8
#: Longs of the bitmaps that may be broadcast, 16 MB.
BROADCAST_LONGS = 2_000_000
#: Pivots that a document is compared with in a round, those that share the most lists with it.
PIVOTS = 4


def needed(n):
    """Least overlap of a set of n shingles with any set that it links to."""
    return -(-4 * n // 5)


def _texts(batch: pd.Series) -> list[bytes]:
    return [bytes(x) for x in batch]


def _trim(fresh: np.ndarray, kept: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: add the counts of ``fresh`` tokens to the summary, subtract the (most+1)-th largest from all."""
    fresh.sort()
    first = np.flatnonzero(np.concatenate(([True], fresh[1:] != fresh[:-1])))
    tokens = np.concatenate((fresh[first], kept[0]))
    counts = np.concatenate((np.diff(np.append(first, len(fresh))), kept[1]))
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    tokens, counts = tokens[first], np.add.reduceat(counts, first)
    if len(tokens) > most:
        least = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        tokens, counts = tokens[counts > least], counts[counts > least] - least
    return tokens, counts


def bitmaps(own: np.ndarray, part: np.ndarray | int = 0, parts: int = 1) -> np.ndarray:
    """Parity of the shingles of each part in each of 64 * BITS places."""
    place = (own >> np.uint64(20)).astype(np.int64) & (64 * BITS - 1)
    flips = np.bincount(place + part * (64 * BITS), minlength=parts * 64 * BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(parts, BITS)


def places_of(n: int) -> int:
    """Places of the bitmap for single pairs whose larger set has n shingles: a power of two."""
    return max(512, 1 << (2 * n - 1).bit_length())


def wide(own: np.ndarray, places: int) -> np.ndarray:
    at = (own >> np.uint64(20)).astype(np.int64) & (places - 1)
    flips = np.bincount(at, minlength=places)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def levels(n: int) -> range:
    """The levels, of 4 ** level parts, at which a set of n shingles is listed: its own and that of a linked larger set.

    A pair meets at the level of its larger set.
    """
    level = lambda x: next(k for k in range(64) if x < CUT * 4**k)
    return range(level(n), level(5 * n // 4) + 1)


def most_apart(n: str, m: str) -> str:
    """SQL: the most shingles that only one of two linked sets has. The overlap is at least 4/9 of both sizes together."""
    return f"{n} + {m} - 2 * ((4 * ({n} + {m}) + 8) div 9)"


def may_link(a: str, b: str, n: str, m: str) -> str:
    """SQL: sizes and short bitmaps allow a link."""
    differ = " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BITS))
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and {differ} <= {most_apart(n, m)}"


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and long bitmaps allow a link. ``sets``: id, n, bits, up (bits for a pair with a larger set)."""
    # Sizes alone rule out most pairs, so the bitmaps are joined to the others only.
    size = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(x + "n"))
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").filter("5 * least(an, bn) >= 4 * greatest(an, bn)")
    pairs = cut(pairs.select("a", "b").distinct(), "sized-pairs")
    few = pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(x + c) for c in ("n", "bits", "up")])
    found = side("a").join(F.broadcast(pairs) if few else pairs, "a")
    found = found.select("a", "b", "an", "abits", "aup")
    if few:
        found = cut(found, "sided")
        longs = found.agg(F.sum(F.size("abits") + F.coalesce(F.size("aup"), F.lit(0)))).first()[0] or 0
        found = F.broadcast(found) if longs <= BROADCAST_LONGS else found
    met = keep_ids(side("b"), pairs.select("b").distinct(), "b")
    found = met.join(found, "b").filter("5 * least(an, bn) >= 4 * greatest(an, bn)")
    same = "case when size(abits) = size(bbits) then struct(abits as x, bbits as y) when size(abits) < size(bbits) then struct(aup as x, bbits as y) else struct(abits as x, bup as y) end"
    differ = "aggregate(zip_with(pair.x, pair.y, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return found.withColumn("pair", F.expr(same)).filter(f"{differ} <= {most_apart('an', 'bn')}").select("a", "b")


def sketch(docs: DataFrame, counters: int) -> DataFrame:
    """Rows of kind 0: id, n, digest and bitmaps of the set; of kind 1: frequent shingles of a task and their counts; of kind 2: counts of
    one shingle in 256, for the cost of scanning lists."""
    columns = ["kind", "id", "n", "d1", "d2", "bits", "up", "token", "times"]

    def counts(kind: int, tokens: np.ndarray, times: np.ndarray) -> pd.DataFrame:
        none = pd.Series([[]] * len(tokens), dtype=object)
        return pd.DataFrame({"kind": kind, "id": 0, "n": 0, "d1": 0, "d2": 0, "bits": none, "up": none, "token": tokens.view(np.int64), "times": times}, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            rows = []
            for key, own in zip(batch["id"], shingle_sets(_texts(batch["text"])), strict=True):
                digest = xxhash.xxh3_128_intdigest(own.tobytes())
                here, up = places_of(len(own)), places_of(5 * len(own) // 4)
                rows.append((0, key, len(own), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, wide(own, here), wide(own, up) if up > here else None, 0, 0))
                waiting.append(own)
                size += len(own)
                if size > 250_000:
                    tokens = np.concatenate(waiting)
                    yield counts(2, *np.unique(tokens[tokens & np.uint64(255) == 0], return_counts=True))
                    kept = _trim(tokens, kept, counters)
                    waiting, size = [], 0
            yield pd.DataFrame(rows, columns=columns)
        if size:
            tokens = np.concatenate(waiting)
            yield counts(2, *np.unique(tokens[tokens & np.uint64(255) == 0], return_counts=True))
            kept = _trim(tokens, kept, counters)
        often = kept[1] > 1
        yield counts(1, kept[0][often], kept[1][often])

    return docs.mapInPandas(run, "kind int, id long, n long, d1 long, d2 long, bits array<long>, up array<long>, token long, times long")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose texts link. ``a`` may be in very many pairs.

    A few pairs are broadcast to the texts, more are joined by shuffling; texts of ``a`` travel once and meet their pairs by a join that splits
    skewed keys.
    """
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    few = pairs.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(F.broadcast(pairs) if few else pairs, "b")
    left = keep_ids(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), pairs.select("a").distinct(), "a")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list({bytes(x): None for x in (*batch["ta"], *batch["tb"])})
            sets = dict(zip(texts, shingle_sets(texts), strict=True))
            linked = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                own, other = sets[bytes(ta)], sets[bytes(tb)]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = np.count_nonzero(own[at] == other) if len(own) else 0
                linked.append(5 * both >= 4 * (len(own) + len(other) - both) > 0)
            yield batch.loc[np.array(linked, bool), ["a", "b"]]

    joined = right.join(left, "a").select("a", "b", "ta", "tb")
    links = cut(joined.mapInPandas(compare, "a long, b long").distinct(), "links")
    drop(pairs)
    return links


def choose_boundary(sizes: dict[int, int], scanned: float) -> int:
    """The set size up to which 2-subsets cost fewer records than scanned lists, whose postings cost ``1 + scanned`` each."""

    def light(n: int) -> float:
        p = min(n, n - needed(n) + 2)
        return p * (p - 1) / 2

    def heavy(n: int) -> float:
        return (n - needed(n) + 1) * (1 + scanned)

    def cost(x: int) -> float:
        return sum(c * (light(n) * (n <= x) + heavy(n) * (5 * n > 4 * x)) for n, c in sizes.items())

    return min(range(1, MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _ordered(own: np.ndarray, often: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the common order, and the summary's counts of its shingles."""
    if not len(often):
        return own, np.zeros(len(own), np.int64)
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    rank = np.where(often[at] == own, times[at], 0)
    order = np.lexsort((own, rank)) if rank.any() else np.arange(len(own))
    return own[order], rank[order]


def _parts(own: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each shingle, told by its low bits, and the parts' sizes."""
    part = (own & np.uint64(4**level - 1)).astype(np.int64)
    return part, np.bincount(part, minlength=4**level)


def postings(docs: DataFrame, held, boundary: int) -> DataFrame:
    """(token, part, id, times): the subset keys of light sets (part 0) and the prefix shingles of the parts of heavy ones.

    ``part`` is 4 ** level plus the part's number; ``times`` is the summary's count, 0 where it has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for key, own in zip(batch["id"], shingle_sets(_texts(batch["text"])), strict=True):
                n = len(own)
                if n < 2:
                    continue
                own, rank = _ordered(own, *held.value)
                if n <= boundary:
                    p = own[: n - needed(n) + 2]
                    i, j = np.triu_indices(len(p), 1)
                    lo, hi = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                    out.append((mix(lo * np.uint64(0x9E3779B97F4A7C15) + hi), np.zeros(len(i), np.int64), key, np.minimum(rank[i], rank[j])))
                    size += len(i)
                if 5 * n > 4 * boundary:
                    for level in levels(n):
                        part, sizes = _parts(own, level)
                        by_part = np.argsort(part, kind="stable")
                        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        first = by_part[place < np.repeat(sizes - needed(sizes) + 1, sizes)]
                        out.append((own[first], 4**level + part[first], key, rank[first]))
                        size += len(first)
                if size > 200_000:
                    yield table(out)
                    out, size = [], 0
        yield table(out)

    def table(out: list[tuple]) -> pd.DataFrame:
        joined = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)
        ids = np.repeat(np.array([x[2] for x in out], np.int64), [len(x[0]) for x in out]) if out else np.zeros(0, np.int64)
        return pd.DataFrame({"token": joined(0).view(np.int64), "part": joined(1), "id": ids, "times": joined(3)})

    return docs.mapInPandas(run, "token long, part long, id long, times long")


def marks(docs: DataFrame, boundary: int) -> DataFrame:
    """(id, part, from_n, n, size, bits) of the parts with shingles of each set, as ``postings`` numbers them.

    ``from_n`` is the least size of the larger set of a pair that meets at the part's level.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, own in zip(batch["id"], shingle_sets(_texts(batch["text"])), strict=True):
                n = len(own)
                if n <= boundary:
                    rows.append((key, 0, 0, n, n, bitmaps(own)[0]))
                if 5 * n > 4 * boundary:
                    for level in levels(n):
                        part, sizes = _parts(own, level)
                        bits = bitmaps(own, part, 4**level)
                        rows += [(key, 4**level + k, CUT * 4 ** (level - 1) if level else 0, n, int(sizes[k]), bits[k]) for k in np.flatnonzero(sizes).tolist()]
            yield pd.DataFrame(rows, columns=["id", "part", "from_n", "n", "size", "bits"])

    return docs.mapInPandas(run, "id long, part long, from_n long, n long, size long, bits array<long>")


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``shared`` with ``comp``: the component of each member, by now."""
    return with_labels(shared, labels) if labels is not None else shared.withColumn("comp", F.col("id"))


def pivot_round(shared: DataFrame, labels: DataFrame | None, sets: DataFrame, docs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between each list's pivot and its members outside the pivot's component; and the rows of the lists that were still mixed.

    Lists are joined by shuffling at any size, never broadcast.
    """
    own = labelled(shared.select("token", "part", "id"), labels)
    if turn == 0:  # each member is a component of its own
        score = shared.groupBy("id").agg(F.sum(F.log2("c")).cast("float").alias("score"))
        score = cut(score, "score")
        few = score.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        rated = own.join(F.broadcast(score) if few else score, "id")
        rated = rated.groupBy("token", "part").agg(F.max(F.struct("score", F.bitwise_not("id").alias("key"))).alias("top"))
        pivots = rated.select("token", "part", F.bitwise_not("top.key").alias("pivot")).withColumn("pivot_comp", F.col("pivot"))
    else:
        rate = F.struct(F.xxhash64("id", "token", F.lit(turn)).alias("key"), "id", "comp")
        pivots = own.groupBy("token", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(rate).alias("top"))
        pivots = pivots.filter("lo < hi").select("token", "part", F.col("top.id").alias("pivot"), F.col("top.comp").alias("pivot_comp"))
    mixed = cut(own.join(pivots.hint("merge"), ["token", "part"]).select("token", "part", "id", "comp", "pivot", "pivot_comp"), "mixed")
    met = cut(mixed.filter("comp <> pivot_comp").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("met")), "met-all")
    every = met
    met = cut(every.join(sets.select("id", "n"), "id").filter(f"met * {SHARED} * 5 >= n").select("id", "pivot", "met").distinct(), "met")
    drop(every)
    allowed = likely(met.select(F.col("pivot").alias("a"), F.col("id").alias("b")), sets)
    chosen = met.join(allowed.select(F.col("a").alias("pivot"), F.col("b").alias("id")).distinct(), ["id", "pivot"])
    best = Window.partitionBy("id").orderBy(F.desc("met"), "pivot")  # a document's pivots: no more than its lists
    chosen = chosen.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PIVOTS)
    links = verify(chosen.select(F.col("pivot").alias("a"), F.col("id").alias("b")), docs)
    drop(met)
    return links, mixed


def left_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, boundary: int) -> DataFrame:
    """All pairs (a, b) within a list, of different components, whose sizes and bitmaps allow a link.

    Pairs of short lists are compared by their long bitmaps only, so only members of long lists carry short ones.
    """
    own = labelled(shared.select("token", "part", "id"), labels)
    mixed = own.groupBy("token", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi").select("token", "part", "members")
    every = cut(own.join(mixed.hint("merge"), ["token", "part"]).select("token", "part", "id", "comp", "members"), "mixed")
    short = every.filter(f"members <= {SHORT}")
    end = lambda x: short.select("token", "part", F.col("id").alias(x), F.col("comp").alias("c" + x))
    met = end("a").join(end("b").hint("merge"), ["token", "part"]).filter("ca < cb").select("a", "b")
    own = every.filter(f"members > {SHORT}").drop("members")
    marked = marks(keep_ids(docs, own.select("id").distinct(), "id"), boundary)
    lists = cut(own.join(marked, ["id", "part"]), "lists")
    side = lambda x: lists.select("token", "part", *["from_n"][: x == "a"], F.col("id").alias(x), F.col("comp").alias("c" + x), F.col("n").alias("n" + x), F.col("size").alias("s" + x), F.col("bits").alias("b" + x))
    # A pair meets at the level of its larger set, two light sets by their subsets only.
    near = F.expr(f"ca < cb and 5 * least(na, nb) >= 4 * greatest(na, nb) and greatest(na, nb) >= from_n and {may_link('ba', 'bb', 'sa', 'sb')}")
    near = near & ((F.col("part") == 0) | (F.greatest("na", "nb") > boundary))
    pairs = side("a").join(side("b").hint("merge"), ["token", "part"]).filter(near).select("a", "b")
    near_pairs = cut(pairs.union(met).distinct(), "near-pairs")
    pairs = cut(likely(near_pairs, sets), "left-pairs")
    drop(every, lists, near_pairs)
    return pairs


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """``comp`` for each row: its label, or its own key where it has none."""
    named = labels.select(F.col("v").alias(key), F.col("label").alias("__label"))
    if named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    return rows.join(named, key, "left").withColumn("comp", F.coalesce("__label", key)).drop("__label")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 200_000, frequent: int = 200_000, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z), split at ASCII white space, and linked as the module says; ``component_id`` is the least id
    reachable. A text with one to four words has one shingle, all of it; a null, empty or blank text has none and is linked with
    nothing. Very long texts are hashed in chunks and listed in parts, whole. Ties (equal similarity) all link. A null id counts as the least of
    all and is given back as null. Rows that share an id are one document of the graph: what links to either row links to both.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spark = docs.sparkSession
    sketches = cut(sketch(docs, counters), "sketches")
    rows = sketches.filter("kind = 0").select("id", "n", "d1", "d2")
    sets = sketches.filter("kind = 0 and n > 0").select("id", "n", "bits", "up")
    often = sketches.filter("kind = 1").groupBy("token").agg(F.sum("times").alias("times")).filter("times > 8")
    often = sorted((np.uint64(r["token"] & (2**64 - 1)), r["times"]) for r in often.orderBy(F.desc("times"), "token").limit(frequent).collect())
    held = spark.sparkContext.broadcast((np.array([t for t, _ in often], np.uint64), np.array([c for _, c in often], np.int64)))  # at most `frequent`
    cost = sketches.filter("kind = 2").groupBy("token").agg(F.sum("times").alias("c")).agg(F.sum(F.col("c") * F.least(F.col("c") - 1, F.lit(MET))), F.sum("c")).first()
    scanned = COMPARE * (cost[0] or 0) / (cost[1] or 1)

    classes = cut(rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("first")), "classes")
    placed = cut(rows.join(classes, ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("first", "id").alias("first")), "placed")
    # An id with rows in different classes is one vertex: its rows' representatives are linked.
    twice = cut(placed.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.count_distinct("first").alias("k")).filter("k > 1").select("id"), "twice")
    links = [placed.join(twice, "id").select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b")]
    copies = cut(placed.filter("id <> first").join(twice, "id", "left_anti").select("id").distinct(), "copies")

    sizes = {r["s"]: r["c"] for r in classes.filter(f"n <= {MOST_LIGHT}").groupBy(F.col("n").alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}
    boundary = choose_boundary(sizes, scanned)
    own = keep_ids(docs, copies, "id", "left_anti")
    listed = postings(own, held, boundary)
    # Each list is counted in one task, but one of a frequent shingle, which is shared for sure, in salted parts; the others
    # are short, as the summary's error bounds them.
    salt = F.pmod(F.xxhash64("id"), 1 + F.expr(f"times div {HOT}"))
    in_list = F.count(F.lit(1)).over(Window.partitionBy("token", "part", "salt"))
    counted = listed.withColumn("salt", salt).withColumn("c", F.greatest(in_list, "times")).filter("c > 1")
    shared = cut(counted.select("token", "part", "id", "c"), "shared")

    labels, made = None, []
    for turn in range(rounds):
        found, mixed = pivot_round(shared, labels, sets, own, turn)
        drop(shared)
        shared = mixed  # lists of one component stay so
        made.append(found)
        if turn and found.limit(1).count() == 0:
            break
        links.append(found)
        labels = components(reduce(DataFrame.union, links))
    pairs = left_pairs(shared, labels, sets, own, boundary)
    found = verify(pairs, own)
    if found.limit(1).count():
        labels = components(reduce(DataFrame.union, [*links, found]))
    drop(shared, pairs, found, *made, sketches, classes, copies, twice)
    rows = placed.join(labels.select(F.col("v").alias("first"), "label"), "first", "left")
    null = lambda c: F.when(c != NO_ID, c)
    return rows.select(null(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(F.coalesce("label", "first")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the least id, with all its columns; of rows that share that id one stays, any of them.

    A null id counts as the least. Rows without words are near copies of none, but one of each id.
    """
    own = docs.withColumn("__key", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)))
    found = cut(jaccard_components(docs, id_col, text_col), "components")
    gone = found.filter("not (component_id <=> doc_id)").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__key")).distinct()
    stay = keep_ids(own, cut(gone, "near-copies"), "__key", "left_anti")
    again = cut(found.groupBy("doc_id").count().filter("count > 1").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__key")), "repeated-ids")
    if again.limit(1).count():
        stay = keep_ids(stay, again, "__key", "left_anti").unionByName(keep_ids(stay, again, "__key").dropDuplicates(["__key"]))
    return stay.select(*docs.columns)
