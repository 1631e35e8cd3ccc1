"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. Time runs in rounds; in a round source ``i`` places its
quota ``a_i`` of blocks (its integer weight) among ``C`` slots, so its weight there is
``a_i / C``. Block ``j`` of the quota (from 1) is released at slot ``floor((j-1) C / a_i)``, has the
deadline ``ceil(j C / a_i)``, and slots go to the released block with the earliest deadline
(ties: the larger quota, then the source's name). At every slot each source's count is then less than one
block away from its share. A source whose rows end takes its remaining blocks as its
quota of that round and none later, which leaves the others' ratio unchanged. Rows are never
repeated or dropped.

Only as many kinds of round exist as sources end at different times, so the schedule
is a table bounded by the weights: it is built in SQL, one row for each kind of
round, and broadcast to the rows. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import hash32, positions

REST = "(rest)"
OUT = ["mix_source", "mix_block", "mix_round", "mix_release", "mix_deadline", "mix_slot", "mix_pos", "mix_on_target"]

#: One round under earliest-deadline-first: `quotas` and `slots` to an array of (idx, nth, release, deadline), one for each slot.
_ROUND = """
aggregate(
  sequence(1, slots),
  named_struct('done', transform(quotas, q -> 0L), 'picks', cast(array() as array<struct<idx:int,nth:bigint,release:bigint,deadline:bigint>>)),
  (acc, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(quotas) - 1), i -> acc.done[i] < quotas[i] and acc.done[i] * slots div quotas[i] <= t - 1),
      i -> named_struct('deadline', ((acc.done[i] + 1) * slots + quotas[i] - 1) div quotas[i], 'less', -quotas[i], 'idx', i)))),
    best -> named_struct(
      'done', transform(acc.done, (n, i) -> if(i = best.idx, n + 1L, n)),
      'picks', concat(acc.picks, array(named_struct('idx', best.idx, 'nth', acc.done[best.idx] + 1L,
                                                    'release', acc.done[best.idx] * slots div quotas[best.idx], 'deadline', best.deadline)))))[0],
  acc -> acc.picks)
"""


def source_counts(docs: DataFrame, source: Column, weights: dict[str, int], block_rows: int) -> DataFrame:
    """For each named source with rows: weight, blocks, full rounds, and the blocks left for the round after."""
    weight = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(weights.items()))])
    found = docs.groupBy(source.alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("weight", weight[F.col("mix_source")].cast("long")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    return found.selectExpr("mix_source", "weight", "blocks", "blocks div weight as full", "blocks % weight as left_over")


def round_kinds(counts: DataFrame) -> DataFrame:
    """One row for each run of rounds with equal quotas: first round, end, slots, base slot, sources, picks."""
    sides = counts.agg(F.sort_array(F.collect_list(F.struct("mix_source", "weight", "full", "left_over"))).alias("all"))
    starts = sides.selectExpr("all", "explode(array_distinct(flatten(transform(all, s -> array(0L, s.full, s.full + 1))))) as first")
    quotas = starts.selectExpr("*", "transform(all, s -> case when first < s.full then s.weight when first = s.full then s.left_over else 0L end) as quotas")
    quotas = quotas.selectExpr("*", "aggregate(quotas, 0L, (x, y) -> x + y) as slots", "forall(all, s -> first < s.full) as on_target").filter("slots > 0")
    # All rows of this table, at most twice the sources plus one, are put in order in one array.
    runs = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("first", "slots", "quotas", "on_target"))).alias("runs"), F.first("all").alias("all"))
    runs = runs.selectExpr("all", "posexplode(runs) as (at, run)", "runs")
    runs = runs.selectExpr("all", "run.*", "aggregate(slice(runs, 1, at), named_struct('base', 0L, 'prev', cast(null as struct<first:bigint,slots:bigint>)), (a, r) -> named_struct('base', a.base + coalesce((r.first - a.prev.first) * a.prev.slots, 0L), 'prev', named_struct('first', r.first, 'slots', r.slots))) as acc")
    runs = runs.selectExpr("all", "first", "slots", "quotas", "on_target", "acc.base + coalesce((first - acc.prev.first) * acc.prev.slots, 0L) as base")
    return runs.withColumn("picks", F.expr(_ROUND))


def mix(docs: DataFrame, weights: dict[str, int], source_col: str = "source", id_col: str = "doc_id", block_rows: int = 16, rest_weight: int = 1, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mixture.

    ``weights`` gives positive integers by source name; every other source, and null,
    belongs to one pool named ``(rest)`` with ``rest_weight``. Rows of a source are taken in
    the order of a seeded hash of the id, then id (nulls first); rows that share an id have either order.
    Adds ``mix_source``, ``mix_block`` (0-based within the source), ``mix_round``, ``mix_release`` and
    ``mix_deadline`` (slots within the round), ``mix_slot`` (over the whole run), ``mix_pos`` (slot times block_rows
    plus the place in the block: gaps occur only after a source's last, short block) and ``mix_on_target`` (no source
    had run out in this round). Columns of these names in the input are replaced. An empty table
    gives an empty one. The text isn't read here, so its length and nulls don't matter.
    """
    weights = {str(k): int(v) for k, v in weights.items()} | {REST: int(rest_weight)}
    if min(weights.values()) < 1 or block_rows < 1:
        raise ValueError("weights and block_rows are positive integers")
    kept = [c for c in docs.columns if c not in OUT]
    own = {c: f"__in{i}" for i, c in enumerate(kept)}  # so that no name clashes with a working column
    docs, source_col, id_col = docs.select(*[F.col(c).alias(n) for c, n in own.items()]), own[source_col], own[id_col]
    source = F.coalesce(F.when(F.col(source_col).isin(*weights), F.col(source_col)), F.lit(REST))
    kinds = round_kinds(source_counts(docs, source, weights, block_rows))
    slots = kinds.selectExpr("all", "first", "slots", "base", "on_target", "posexplode(picks) as (slot, pick)")
    slots = slots.selectExpr("all[pick.idx].mix_source as mix_source", "pick.nth as nth", "first", "slots", "base", "slot", "pick.release as mix_release", "pick.deadline as mix_deadline", "on_target as mix_on_target")
    firsts = kinds.select(F.explode("all").alias("one"), "first").groupBy(F.col("one.mix_source").alias("mix_source")).agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    weight = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(weights.items()))])

    placed = positions(docs.withColumn("mix_source", source).withColumn("__place", hash32(F.lit(seed), F.col(id_col))), "mix_source", "__place", [id_col], "__at")
    placed = placed.withColumn("mix_block", F.expr(f"__at div {block_rows}")).withColumn("__weight", weight[F.col("mix_source")].cast("long"))
    placed = placed.withColumn("mix_round", F.expr("mix_block div __weight")).withColumn("nth", F.expr("mix_block % __weight + 1"))
    placed = placed.join(F.broadcast(firsts), "mix_source")
    placed = placed.withColumn("first", F.expr("array_max(filter(firsts, f -> f <= mix_round))"))
    joined = placed.join(F.broadcast(slots), ["mix_source", "nth", "first"])
    joined = joined.withColumn("mix_slot", F.expr("base + (mix_round - first) * slots + slot")).withColumn("mix_pos", F.expr(f"mix_slot * {block_rows} + __at % {block_rows}"))
    return joined.select(*[F.col(n).alias(c) for c, n in own.items()], *OUT)


def mixed_documents(docs: DataFrame, weights: dict[str, int], keep: tuple[str, ...] = (), **settings) -> DataFrame:
    """The rows of ``docs`` in mixture order, with their own columns and those of ``mix`` named in ``keep``.

    Later steps that shuffle lose the order of rows: they need ``mix_pos``.
    """
    return mix(docs, weights, **settings).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos").select(*[c for c in docs.columns if c not in keep], *keep)
