"""Entity resolution: clusters of names, bounds on the number of entities, edges between them, ids, and the graph of companies and sites."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import values as V
from attesta.functions.text import stable_id
from attesta.operators import relational as R
from attesta.session import settle


#: Names of two lengths meet by their shared subsequences if the longer has at most so many of the length they must share, else by rare strings.
MOST_SUBSEQUENCES = 300


def _subsequences(name: str, dropped: str) -> Column:
    """The distinct texts that remain of column ``name`` when ``dropped`` of its characters go."""
    one_less = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substr(s, F.lit(1), k - 1), F.substr(s, k + 1)))
    each = F.aggregate(F.sequence(F.lit(1), F.col(dropped)), F.array(F.col(name)), lambda found, _: F.array_distinct(F.flatten(F.transform(found, one_less))))
    return F.when(F.col(dropped) > 0, each).otherwise(F.array(F.col(name)))


def alias_candidates(names: DataFrame, block: str, name: str, ratio: float) -> DataFrame:
    """(block, a, b), a before b: pairs of a block's distinct names that may be aliases, each once; no alias is missing.

    A close match at ``ratio`` of names of ``n`` and ``m`` characters has ``ratio (n + m) / 2`` in common in the same order. Names short enough
    (``MOST_SUBSEQUENCES``) meet by a shared subsequence of that length, so they are close but for the matcher's choice of blocks. Of other lengths, each
    unmatched character of the shorter name spoils three of its strings of three characters at most, each of the longer two, so one of the shorter
    name's rarest strings, as many as may be spoiled and one more, is among the longer's; the empty string, which all names share, is the last. A name
    inside another shares its rarest string (names of three characters on). Acronyms meet by the acronym.
    """
    own = names.select(F.col(block).alias("k"), F.col(name).alias("x")).filter("k IS NOT NULL AND x <> ''").distinct()
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few names make many rows, so their size is no measure
    own = settle(own.withColumn("n", F.length("x")).repartition(parts, "k", "x"))
    lengths = own.groupBy("k", "n").agg(F.count(F.lit(1)).alias("c"))
    shared = F.ceil(F.lit(ratio / 2) * (F.col("n") + F.col("m")) - 1e-9).cast("int")
    longest = {u: max((m for m in range(u, MOST_SUBSEQUENCES + 1) if comb(m, u) <= MOST_SUBSEQUENCES), default=0) for u in range(1, 11)}
    few = reduce(lambda found, u: found | (F.col("m") - shared == u) & (F.col("m") <= longest[u]), longest, F.lit(False))
    sizes = lengths.join(lengths.select("k", F.col("n").alias("m")), "k").filter("n < m OR n = m AND c > 1").filter((shared <= F.col("n")) & (shared < F.col("m"))).select("k", "n", "m", shared.alias("s"), few.alias("few"))

    near = sizes.filter("few")
    wanted = near.select("k", "n", "s").unionByName(near.select("k", F.col("m").alias("n"), "s")).distinct()
    cut = own.join(wanted, ["k", "n"]).withColumn("u", F.col("n") - F.col("s")).select("k", "s", "x", "n", F.explode(_subsequences("x", "u")).alias("v")).withColumn("v", F.xxhash64("v"))
    met = cut.join(cut.select("k", "s", "v", F.col("x").alias("y"), F.col("n").alias("m")), ["k", "s", "v"]).filter("x < y").filter(shared == F.col("s")).select("k", "x", "y")

    grams = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), lambda i: F.substr("x", i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    each = own.select("k", "x", "n", F.explode(F.array_append(F.array_distinct(grams), F.lit(""))).alias("gram"))
    rarest = Window.partitionBy("k", "x").orderBy("c", F.col("gram") == "", "gram")  # a name's strings
    ranked = each.join(each.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("c")), ["k", "gram"]).withColumn("at", F.row_number().over(rarest)).filter("c > 1")
    lists = each.select("k", "gram", F.col("n").alias("m"), F.col("x").alias("y"))
    far = sizes.filter("NOT few").withColumn("most", 3 * (F.col("n") - F.col("s")) + 2 * (F.col("m") - F.col("s")) + 1)
    probes = ranked.join(far, ["k", "n"]).filter("at <= most").select("k", "gram", "m", "x", "n")
    met = met.unionByName(probes.join(lists, ["k", "gram", "m"]).filter("n < m OR x < y").select("k", "x", "y"))
    inner = ranked.filter("at = 1 AND gram <> ''").join(lengths.groupBy("k").agg(F.max("n").alias("longest")), "k").filter("n < longest").select("k", "gram", "x", "n")
    met = met.unionByName(inner.join(lists, ["k", "gram"]).filter("n < m").filter(F.contains("y", "x")).select("k", "x", "y"))

    initials = F.array_join(F.transform(F.filter(F.split("x", " "), lambda w: (w != "") & ~w.isin("the", "and", "of")), lambda w: w.substr(1, 1)), "")
    short = own.select("k", "x", initials.alias("key")).filter("key <> ''")
    joined = own.select("k", F.col("x").alias("y"), F.replace("x", F.lit(" "), F.lit("")).alias("key"))
    met = met.unionByName(short.join(joined, ["k", "key"]).select("k", "x", "y"))
    return met.filter("x <> y").select(F.col("k").alias(block), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def alias_edges(names: DataFrame, block: str, name: str, alias, least_length: int = 6, ratio: float = 0.91) -> DataFrame:
    """(block, a, b): pairs of a block's distinct names, a before b, of which one is an alias of the other in either direction.

    ``alias`` is ``alias_udf`` of the same ``least_length`` (three at least) and ``ratio``; each pair is judged once.
    """
    if least_length < 3:
        raise ValueError("names inside others are found from three characters on")
    return alias_candidates(names, block, name, ratio).filter(alias("a", "b"))


def name_clusters(names: DataFrame, block: str, name: str, alias) -> DataFrame:
    """(block, name, cluster): names of a block connected by aliases share the least of their names."""
    edges = alias_edges(names, block, name, alias)
    key = lambda c: F.to_json(F.struct(F.col(block).alias("k"), F.col(c).alias("n")))
    labels = R.components(edges.select(key("a").alias("x"), key("b").alias("y")), "x", "y")
    own = names.select(block, name).distinct().withColumn("v", key(name))
    found = own.join(labels, "v", "left")
    return found.select(block, name, F.coalesce(F.get_json_object("label", "$.n"), F.col(name)).alias("cluster"))


def entity_bounds(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: lower, conservative and upper number of entities among ``rows`` (domain, name, state, visibility).

    A domain of its own business is one entity for the lower count, and for the conservative one too if its names make one cluster; any other domain
    counts its names by state. The upper count is of names by state and domain. Empty names make no cluster.
    """
    by_domain = rows.groupBy("domain").agg(F.count_distinct(F.struct("name", "state")).alias("pairs"), (F.collect_set("visibility") == F.array(F.lit("dedicated_business_domain"))).alias("own"))
    held = clusters.filter("name <> ''").groupBy("domain").agg(F.count_distinct("cluster").alias("k"))
    counted = by_domain.join(held, "domain", "left")
    one = F.col("own") & F.coalesce(F.col("k") == 1, F.lit(False))
    return counted.agg(
        F.sum(F.when(F.col("own"), 1).otherwise(F.col("pairs"))).alias("lower"),
        F.sum(F.when(one, 1).otherwise(F.col("pairs"))).alias("conservative"),
        F.sum("pairs").alias("upper"),
    )


def sensitivity(count: Column, unresolved: Column) -> tuple[Column, Column]:
    """The least and greatest number of entities if each unresolved pair may be one: never under one."""
    return F.greatest(F.lit(1), count - unresolved), count


def exact_edges(units: DataFrame) -> DataFrame:
    """(first, other, name, state): units (unit, domain, names, states) of different domains that share a name and a state, each linked to the first.

    An inverted index over names and states; a key with all its units in one domain gives none.
    """
    keys = units.select("unit", "domain", F.explode("names").alias("name"), "states").select("unit", "domain", "name", F.explode("states").alias("state"))
    index = keys.groupBy("name", "state").agg(F.min("unit").alias("first"), F.min("domain").alias("lo"), F.max("domain").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    return keys.join(index, ["name", "state"]).filter("unit <> first").select("first", F.col("unit").alias("other"), "name", "state").distinct()


def apply_decisions(domains: DataFrame, decisions: DataFrame) -> DataFrame:
    """Operating units (unit, domain, names, corporate) of domains (domain, names) by decisions (domain, decision, groups).

    Without a decision all names are one unit. Units of a domain share a corporate group unless the decision says they are separate. Groups that
    don't hold every name once raise.
    """
    joined = domains.join(decisions, "domain", "left")
    groups = F.coalesce("groups", F.array("names"))
    whole = F.array_sort(F.flatten(groups)) == F.array_sort("names")
    checked = joined.withColumn("groups", F.when(whole, groups).otherwise(F.raise_error(F.concat(F.lit("groups don't cover "), "domain")).cast("array<array<string>>")))
    apart = F.coalesce(~F.col("decision").isin("single_operating_entity", "single_corporate_multiple_operating_entities"), F.lit(False))
    units = checked.select("domain", apart.alias("apart"), F.posexplode("groups").alias("at", "names"))
    unit = F.concat_ws("#", "domain", "at")
    return units.select(unit.alias("unit"), "domain", "names", F.when(F.col("apart"), unit).otherwise(F.col("domain")).alias("corporate"))


def decision_edges(pairs: DataFrame) -> DataFrame:
    """``pairs`` (same_operating, same_corporate: yes, no or unclear) with ``edge``: both, corporate, unresolved or none."""
    op, corp = F.col("same_operating"), F.col("same_corporate")
    edge = F.when(op == "yes", "both").when(corp == "yes", "corporate").when((op == "unclear") | (corp == "unclear"), "unresolved").otherwise("none")
    return pairs.withColumn("edge", edge)


def entity_ids(members: DataFrame, label: str, item: str, prefix: str) -> DataFrame:
    """(label, entity_id, members): an id of each component from the set of its items, whatever their order."""
    grouped = members.groupBy(label).agg(F.array_sort(F.collect_list(item)).alias("members"))
    return grouped.select(label, V.set_id(prefix, F.col("members")).alias("entity_id"), "members")


def entity_contexts(mapping: DataFrame, contexts: DataFrame) -> DataFrame:
    """(entity, sha256, context, review_id): the distinct contexts of each entity's reviews, the first review of each."""
    joined = mapping.select("review_id", "entity").join(contexts, "review_id")
    return joined.groupBy("entity", "sha256", "context").agg(F.min("review_id").alias("review_id"))


def baseline_ids(candidates: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, base): the baseline entry of the candidate's normalised name, the last by ``pos`` where several share it; empty without one."""
    last = baseline.groupBy("key").agg(F.max_by("base", "pos").alias("base"))
    return candidates.join(last, "key", "left").select("id", F.coalesce("base", F.lit("")).alias("base"))


SETS = {"types": "company_types", "activities": "activities", "announcements": "announcement_types"}


def canonical_records(raw: DataFrame) -> DataFrame:
    """Raw records in their canonical form; those without a name are dropped.

    Texts are trimmed with single spaces and never null, lists are sets in order, the state is ``state_clone`` or else ``state``.
    """
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    rows = raw.select(
        tidy("name").alias("name"),
        V.clean_list(F.col("company_type")).alias("company_types"),
        tidy("city").alias("city"),
        F.coalesce(F.nullif(tidy("state_clone"), F.lit("")), tidy("state")).alias("state"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        V.clean_list(F.col("company_activity")).alias("activities"),
        V.clean_list(F.col("announcement_type")).alias("announcement_types"),
    )
    return rows.filter("name <> ''")


def facilities(records: DataFrame) -> DataFrame:
    """One row for each site (company, city in any case, state, place): its sets united and sorted, with the number of distinct records."""
    company = stable_id("company", F.lower("name"))
    place = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")  # noqa: E731  a missing or zero coordinate is no place
    site = stable_id("facility", company, F.lower("city"), F.col("state"), place("latitude"), place("longitude"))
    record = V.canonical_json(**{c: F.col(c) for c in records.columns})
    rows = records.withColumns({"company_id": company, "facility_id": site, "record": stable_id("record", record)})
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("facility_id").agg(F.min("company_id").alias("company_id"), *[united(c).alias(n) for n, c in SETS.items()], F.count_distinct("record").alias("records"))


def suppliers(records: DataFrame, sites: DataFrame, wanted: tuple[str, ...] = ("Equipment", "Materials"), making: str = "Manufacturing") -> DataFrame:
    """(company_id, sites, manufacturing_sites) of companies with one of the ``wanted`` types among all their records."""
    types = records.groupBy(stable_id("company", F.lower("name")).alias("company_id")).agg(F.array_distinct(F.flatten(F.collect_set("company_types"))).alias("types"))
    counts = sites.groupBy("company_id").agg(F.count(F.lit(1)).alias("sites"), F.count_if(F.array_contains("activities", making)).alias("manufacturing_sites"))
    return types.filter(F.arrays_overlap("types", F.array(*[F.lit(x) for x in wanted]))).join(counts, "company_id").select("company_id", "sites", "manufacturing_sites")
