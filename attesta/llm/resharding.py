"""Minimum-cost-flow resharding.

Rows belong to blocks: a block is a range of the text hash, so equal texts share a block,
and texts whose rows alone are large form blocks of their own (sliced by id hash only when the rows of one
would not fit any shard). From the old shards' sizes and the new shards' capacities a
minimum-cost flow (a byte that stays costs 0, a byte that moves costs 1) says how many bytes
each old shard sends to each new one; whole blocks then realise that flow. Only the block table -
bounded by ``blocks`` plus the large texts - reaches the driver; rows are routed by a
broadcast of it, and only shards that lose or gain rows are rewritten.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import cut, hash32, positions, shield, unshield

#: The old shard of rows that have none yet: every place costs them a move.
NO_SHARD = -1
OUT = ["size", "text_crc32", "old_shard", "shard", "slot", "block"]


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each supply to each demand at the least total cost (successive shortest paths).

    ``sum(supply) <= sum(demand)``; all supply is sent. The sizes are numbers of shards.
    """
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    potential = [0] * (n + m)
    for start in range(n):
        while left[start]:
            distance, back, heap = {start: 0}, {}, [(0, start)]
            while heap:
                d, v = heappop(heap)
                if d > distance[v]:
                    continue
                if v < n:
                    steps = [(n + j, cost[v][j]) for j in range(m)]
                else:
                    steps = [(i, -cost[i][v - n]) for i in range(n) if flow[i][v - n]]
                for to, price in steps:
                    reached = d + price + potential[v] - potential[to]
                    if to not in distance or reached < distance[to]:
                        distance[to], back[to] = reached, v
                        heappush(heap, (reached, to))
            ends = [n + j for j in range(m) if room[j] and n + j in distance]
            end = min(ends, key=lambda v: (distance[v] + potential[v], v))
            most = max(distance.values())
            for v in range(n + m):
                potential[v] += distance.get(v, most)
            path, v = [], end
            while v != start:
                path.append((back[v], v))
                v = back[v]
            sent = min([left[start], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
            for a, b in path:
                if a < n:
                    flow[a][b - n] += sent
                else:
                    flow[b][a - n] -= sent
            left[start] -= sent
            room[end - n] -= sent
    return flow


def plan_transfers(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[int, int]:
    """New shard of each (block, old shard, bytes): whole blocks that realise the flow.

    Large blocks first; a block goes where its old shard still has the most bytes to send
    and the block fits, staying if it can, else to the shard with the most room.
    """
    shards = sorted({old for _, old, _ in blocks})
    place = {old: i for i, old in enumerate(shards)}
    supply = [0] * len(shards)
    for _, old, size in blocks:
        supply[place[old]] += size
    demand = list(capacities)
    flow = min_cost_flow(supply, demand, [[int(old != j) for j in range(len(demand))] for old in shards])
    room, new = list(demand), {}
    late = []
    for block, old, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        row = flow[place[old]]
        fits = [j for j in range(len(demand)) if row[j] >= size and room[j] >= size]
        if not fits:
            late.append((block, old, size))
            continue
        to = old if old in fits else max(fits, key=lambda j: (row[j], -j))
        new[block] = to
        row[to] -= size
        room[to] -= size
    for block, old, size in late:
        to = max(range(len(demand)), key=lambda j: (room[j], j == old, -j))
        new[block] = to
        room[to] -= size
    return new


def reshard(docs: DataFrame, new_shards: int = 16, old_shards: int = 12, old_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = 4096, large: int = 256, rows_per_bucket: int = 1024) -> DataFrame:
    """All rows and columns of ``docs`` with size, text_crc32, old_shard, shard, slot and block.

    Sizes are the text's UTF-8 bytes (null: none) plus one, however long. The law is ``bytes``: the new shards get equal capacities
    and end within about one block of each other. ``old_col`` names the present shard (0-based; null or negative: none yet, given back
    as null); without it the rows are taken as laid out by text hash over ``old_shards``. Equal texts of one old shard stay together unless
    their rows would not fit one new shard. ``slot`` numbers a shard's rows from 0 without gaps, by id hash; rows that share an id, or have none, take either
    order. Null ids hash as empty text. Input columns named as the output ones may be read (as ``old_col`` too) and are replaced. An empty table
    gives an empty one. Rows of a shard lie by slot, in runs of about ``rows_per_bucket`` in one partition.
    """
    own, names = shield(docs)
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    old = F.greatest(F.coalesce(F.col(names[old_col]).cast("int"), F.lit(NO_SHARD)), F.lit(NO_SHARD)) if old_col else F.pmod(F.floor(crc / F.lit(65536)), F.lit(old_shards)).cast("int")
    sized = own.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": crc, "__text": F.xxhash64(text), "__slicer": hash32(names[id_col]), "old_shard": old})
    thin = cut(sized.select("size", "text_crc32", "__text", "__slicer", "old_shard"), "sizes")
    total = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = -(-total // new_shards)

    # Texts whose copies make up over 1/large of a shard: fewer than new_shards * large of them.
    big = thin.groupBy("old_shard", "__text").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__n"))
    big = big.filter(F.col("__bytes") > max(1, capacity // large))
    big = big.withColumn("__slices", F.least(F.col("__n"), F.when(F.col("__bytes") <= capacity, 1).otherwise(F.ceil(F.col("__bytes") * 16 / F.lit(max(1, capacity))))).cast("long"))
    big = F.broadcast(cut(big.select("old_shard", "__text", "__slices"), "large-texts"))

    def keyed(rows: DataFrame) -> DataFrame:
        small = F.pmod("text_crc32", F.lit(blocks)).cast("string")
        sliced = F.concat_ws(":", "__text", F.pmod("__slicer", F.col("__slices")))
        return rows.join(big, ["old_shard", "__text"], "left").withColumn("__key", F.when(F.col("__slices").isNull(), small).otherwise(sliced))

    # One row for each block: at most old shards * blocks, and the large texts.
    sizes = keyed(thin).groupBy("old_shard", "__key").agg(F.sum("size").alias("bytes")).collect()
    sizes = sorted((r["old_shard"], r["__key"], r["bytes"]) for r in sizes)
    new = plan_transfers([(i, old, size) for i, (old, _, size) in enumerate(sizes)], [capacity] * new_shards) if sizes else {}
    schema = T.StructType([T.StructField("old_shard", T.IntegerType()), T.StructField("__key", T.StringType()), T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType())])
    routes = docs.sparkSession.createDataFrame([(old, key, i, new[i]) for i, (old, key, _) in enumerate(sizes)], schema)
    routed = keyed(sized).join(F.broadcast(routes), ["old_shard", "__key"]).withColumn("__place", F.col("__slicer"))
    found = positions(routed, "shard", "__place", [names[id_col], "text_crc32"], "slot", rows_per_bucket)
    return unshield(found.withColumn("old_shard", F.when(F.col("old_shard") != NO_SHARD, F.col("old_shard"))), names, OUT)


def affected_shards(resharded: DataFrame) -> list[int]:
    """The new shards that don't hold exactly their old rows."""
    moved = (~F.col("old_shard").eqNullSafe(F.col("shard"))).cast("int")
    came = resharded.groupBy("shard").agg(F.max(moved).alias("changed"))
    went = resharded.filter("old_shard is not null").groupBy(F.col("old_shard").alias("shard")).agg(F.max(moved).alias("changed"))
    return sorted(r["shard"] for r in came.unionByName(went).filter("changed = 1").select("shard").distinct().collect())  # a number a shard


def rewrite_affected(resharded: DataFrame, path: str) -> list[int]:
    """Write the new shards that don't hold exactly their old rows, by shard; returns them.

    Each file holds rows of one shard by slot, as ``reshard`` laid them out. A shard that kept its rows and gained none isn't written: its files
    are right as they are. A task that is lost is run again and writes the same rows.
    """
    affected = affected_shards(resharded)
    rows = resharded.filter(F.col("shard").isin(affected))
    rows.write.partitionBy("shard").parquet(path)
    return affected


def reshard_files(docs: DataFrame, path: str, rows_per_file: int = 4096, **settings) -> DataFrame:
    """``reshard``, with the affected shards written to ``path``; rows of those shards are read back from the files."""
    found = reshard(docs, rows_per_bucket=rows_per_file, **settings)
    affected = rewrite_affected(found, path)
    schema = T.StructType(sorted(found.schema.fields, key=lambda x: x.name == "shard"))
    stayed = found.filter(~F.col("shard").isin(affected))
    if not affected:
        return stayed
    return docs.sparkSession.read.schema(schema).parquet(path).select(*found.columns).unionByName(stayed)
