"""The registered queries: each is an operator of the library on the test tables, with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import constants as K
from attesta.functions import pages as P
from attesta.functions import stats, text
from attesta.operators import relational as R
from attesta.plans.registry import query, table


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


SQL_HOST = "lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SQL_DOMAIN = f"""CASE WHEN array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), '.') IN ({_sql_list(text.SECOND_LEVEL)})
  THEN array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), '.') ELSE array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), '.') END"""
SQL_PAGES = f"SELECT *, {SQL_DOMAIN} AS domain FROM (SELECT *, string_split(regexp_replace({SQL_HOST}, '^www\\.', ''), '.') AS l FROM pages)"


def _pages(spark, d):
    return table(spark, d, "pages").withColumn("domain", text.registrable_domain(text.host(F.col("url"))))


# --- URLs, names, ids -----------------------------------------------------------------------------


@query("registrable_domain", f"SELECT page_id, {SQL_HOST} AS host, domain FROM ({SQL_PAGES})")
def registrable_domain(spark, d):
    return _pages(spark, d).select("page_id", text.host(F.col("url")).alias("host"), "domain")


@query(
    "canonical_url",
    f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS scheme, {SQL_HOST} AS host,
  regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?[^/?#:]+:(\\d+)', 1) AS port,
  regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_sql_list(text.TRACKING)}) AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_')) AS q
  FROM pages)
SELECT page_id, CASE WHEN host = '' THEN '' ELSE scheme || '://' || host || CASE WHEN port NOT IN ('', '80', '443') THEN ':' || port ELSE '' END
  || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical_url
FROM p""",
)
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@query(
    "normalize_name",
    f"""
WITH n AS (SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part),
w AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM n)
SELECT kind, id, array_to_string(list_filter(w, lambda x: x NOT IN ({_sql_list(text.SUFFIXES)})), ' ') AS normalized,
  array_to_string(list_filter(w, lambda x: x NOT IN ({_sql_list(text.SUFFIXES_GROUP)})), ' ') AS normalized_group,
  array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ({_sql_list(text.SUFFIXES)}) AND x NOT IN ('the', 'and', 'of')), lambda x: x[1]), '') AS acronym FROM w""",
)
def normalize_name(spark, d):
    rows = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = rows.unionByName(table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return rows.select("kind", "id", text.normalize_name(F.col("name")).alias("normalized"), text.normalize_name(F.col("name"), text.SUFFIXES_GROUP).alias("normalized_group"), text.acronym(F.col("name")).alias("acronym"))


@query(
    "stable_ids",
    "SELECT c_custkey, 'CUS-' || substr(sha256(lower(c_name)), 1, 20) AS company_id, 'FAC-' || substr(sha256(c_custkey || '|' || n_name || '|' || c_mktsegment), 1, 20) AS facility_id FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def stable_ids(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", text.stable_id("CUS", F.lower("c_name")).alias("company_id"), text.stable_id("FAC", F.col("c_custkey"), F.col("n_name"), F.col("c_mktsegment")).alias("facility_id"))


# --- roll-ups and graph ---------------------------------------------------------------------------


@query(
    "domain_rollup_best_page",
    f"""
SELECT domain, min(page_id) FILTER (rank = 1) AS best_page, count(*) AS pages, bool_or(has_query) AS any_query, arg_min(url, (length(url), rank)) AS shortest_url,
  array_to_string(list_sort(list_distinct(list(section))), '|') AS sections
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY has_query DESC, length(html) DESC, page_id) AS rank
  FROM (SELECT *, contains(url, '?') AS has_query, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM ({SQL_PAGES})))
GROUP BY domain""",
)
def domain_rollup(spark, d):
    pages = _pages(spark, d).withColumn("has_query", F.col("url").contains("?")).withColumn("section", F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1))
    # One aggregation, so large domains combine on the map side; strength is the order of the pages.
    strength = F.struct((~F.col("has_query")).alias("q"), (-F.length("html")).alias("l"), "page_id")
    return pages.groupBy("domain").agg(
        F.min_by("page_id", strength).alias("best_page"),
        F.count(F.lit(1)).alias("pages"),
        F.bool_or("has_query").alias("any_query"),
        F.min_by("url", F.struct(F.length("url").alias("n"), strength.alias("s"))).alias("shortest_url"),
        F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"),
    )


@query(
    "entity_graph_edges",
    """
WITH e AS (SELECT 'S' || s_suppkey AS source_id, 'SUPPLIER' AS source_type, 'LOCATED_IN' AS relation_type, n_name AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', 'LOCATED_IN', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'C' || c_custkey, 'CUSTOMER', 'HAS_ACTIVITY', c_mktsegment FROM customer
UNION ALL SELECT 'N' || n_nationkey, 'NATION', 'PART_OF', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'REL-' || substr(sha256(source_id || '|' || relation_type || '|' || 'REF-' || substr(sha256(target), 1, 20)), 1, 20) AS relation_id,
  source_id, source_type, relation_type, 'REF-' || substr(sha256(target), 1, 20) AS target_id, target AS label FROM e""",
)
def entity_graph_edges(spark, d):
    nation = table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    region = nation.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def edges(df, key, mark, kind, relation, target):
        return df.select(F.concat(F.lit(mark), key).alias("source_id"), F.lit(kind).alias("source_type"), F.lit(relation).alias("relation_type"), F.col(target).alias("label"))

    every = R.union_all(edges(supplier, "s_suppkey", "S", "SUPPLIER", "LOCATED_IN", "n_name"), edges(customer, "c_custkey", "C", "CUSTOMER", "LOCATED_IN", "n_name"), edges(customer, "c_custkey", "C", "CUSTOMER", "HAS_ACTIVITY", "c_mktsegment"), edges(region, "n_nationkey", "N", "NATION", "PART_OF", "r_name"))
    every = every.withColumn("target_id", text.stable_id("REF", F.col("label")))
    return every.select(text.stable_id("REL", F.col("source_id"), F.col("relation_type"), F.col("target_id")).alias("relation_id"), "source_id", "source_type", "relation_type", "target_id", "label")


@query(
    "reference_integrity",
    """
SELECT 'orders_customer' AS contract, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
UNION ALL SELECT 'lineitem_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
UNION ALL SELECT 'orders_key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem_key', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
)
def reference_integrity(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    customer = table(spark, d, "customer").filter("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"))
    part = table(spark, d, "part").filter("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    found = {
        "orders_customer": R.orphans(orders, customer, ["o_custkey"]),
        "lineitem_orders": R.orphans(lines, orders.select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"]),
        "lineitem_part": R.orphans(lines, part, ["l_partkey"]),
        "orders_key": R.duplicates(orders, ["o_orderkey"]),
        "lineitem_key": R.duplicates(lines, ["l_orderkey"]),
    }
    return R.union_all(*[rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("contract"), "violations") for name, rows in found.items()])


@query(
    "query_lattice",
    """
SELECT printf('LTQ%04d', row_number() OVER (ORDER BY p_type, n_nationkey, c_mktsegment)) AS query_id, p_type AS capability, n_name AS state, c_mktsegment AS intent,
  trim(regexp_replace(replace(replace(replace('{c}  makers {i} in  {s}', '{c}', lower(p_type)), '{i}', lower(c_mktsegment)), '{s}', n_name), '\\s+', ' ', 'g')) AS query
FROM (SELECT DISTINCT p_type FROM part) , nation, (SELECT DISTINCT c_mktsegment FROM customer)""",
)
def query_lattice(spark, d):
    """Three dimensions of bounded size, crossed: the lattice is the feature."""
    rows = table(spark, d, "part").select("p_type").distinct().crossJoin(table(spark, d, "nation").select("n_nationkey", "n_name")).crossJoin(table(spark, d, "customer").select("c_mktsegment").distinct())
    rows = R.ordinal(rows, ["p_type", "n_nationkey", "c_mktsegment"], "at")
    words = F.lit("{c}  makers {i} in  {s}")
    for slot, value in (("{c}", F.lower("p_type")), ("{i}", F.lower("c_mktsegment")), ("{s}", F.col("n_name"))):
        words = F.replace(words, F.lit(slot), value)
    return rows.select(F.format_string("LTQ%04d", "at").alias("query_id"), F.col("p_type").alias("capability"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("intent"), F.trim(F.regexp_replace(words, r"\s+", " ")).alias("query"))


# --- tagging and predicates -----------------------------------------------------------------------

TAGS = {"greek": ["the", "tion"], "romance": ["eau", "que"], "german": ["sch", "und"], "secret": ["token", "password"]}


@query("signal_tagging", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_sql_any('lower(text)', terms)} THEN '{name}' ELSE '' END" for name, terms in sorted(TAGS.items())) + "], lambda x: x <> ''), '|') AS tags, " + _sql_any("lower(text)", K.MANUFACTURING_TERMS) + " AS manufacturing, " + _sql_any("lower(text)", K.US_TERMS) + " AS us FROM documents")
def signal_tagging(spark, d):
    tags = F.array_compact(F.array(*[F.when(text.any_term(F.col("text"), terms), F.lit(name)) for name, terms in sorted(TAGS.items())]))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"), text.any_term(F.col("text"), K.MANUFACTURING_TERMS).alias("manufacturing"), text.any_term(F.col("text"), K.US_TERMS).alias("us"))


@query(
    "source_kind",
    f"""
SELECT page_id, CASE WHEN domain IN ({_sql_list(K.AGGREGATOR_DOMAINS)}) THEN 'aggregator_or_directory' WHEN domain IN ({_sql_list(K.NON_COMPANY_DOMAINS)}) THEN 'news_government_research_or_logistics'
  WHEN {_sql_any("lower(url || ' ' || regexp_extract(html, '<title>([^<]*)</title>', 1))", K.NON_COMPANY_HINTS)} THEN 'review_non_company_possible' ELSE 'direct_company_candidate' END AS kind FROM ({SQL_PAGES})""",
)
def source_kind(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kind = F.when(F.col("domain").isin(*K.AGGREGATOR_DOMAINS), "aggregator_or_directory").when(F.col("domain").isin(*K.NON_COMPANY_DOMAINS), "news_government_research_or_logistics")
    kind = kind.when(text.any_term(F.concat_ws(" ", "url", title), K.NON_COMPANY_HINTS), "review_non_company_possible").otherwise("direct_company_candidate")
    return _pages(spark, d).select("page_id", kind.alias("kind"))


@query("review_scope_filter", "SELECT page_id, status BETWEEN 200 AND 399 AS ok_pilot, status BETWEEN 200 AND 299 AS ok_long_tail FROM (SELECT page_id, html, 100 + least(length(html) // 10, 499) AS status FROM pages) WHERE contains(lower(html), 'the') AND status BETWEEN 200 AND 399")
def review_scope(spark, d):
    """Both definitions of success, on a status made from the page's length as the table has none."""
    pages = table(spark, d, "pages").withColumn("status", 100 + F.least(F.expr("length(html) div 10"), F.lit(499)))
    kept = pages.filter(F.lower("html").contains("the") & F.col("status").between(200, 399))
    return kept.select("page_id", F.col("status").between(200, 399).alias("ok_pilot"), F.col("status").between(200, 299).alias("ok_long_tail"))


@query(
    "retry_classification",
    f"""
SELECT event_id, CASE WHEN k IN ({', '.join(map(str, K.FINAL_STATUSES))}) THEN 'never' WHEN k IN ({', '.join(map(str, K.RETRY_STATUSES))}) THEN 'temporary_http_' || k WHEN value > 50 THEN 'temporary_connection_error' ELSE 'none' END AS reason
FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) + 400 AS k FROM events WHERE event_type = 'error')""",
)
def retry_classification(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") + 400
    rows = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "value", k.alias("k"))
    reason = F.when(F.col("k").isin(*K.FINAL_STATUSES), "never").when(F.col("k").isin(*K.RETRY_STATUSES), F.concat(F.lit("temporary_http_"), "k")).when(F.col("value") > 50, "temporary_connection_error").otherwise("none")
    return rows.select("event_id", reason.alias("reason"))


@query(
    "state_normalization",
    "WITH s AS (SELECT lang AS raw FROM documents UNION SELECT r_name FROM region UNION SELECT '' UNION SELECT 'Oklahoma' UNION SELECT ' texas ')\nSELECT raw, CASE WHEN length(trim(raw)) = 2 THEN upper(trim(raw)) WHEN upper(trim(raw)) = 'OKLAHOMA' THEN 'OK' WHEN upper(trim(raw)) = 'TEXAS' THEN 'TX' ELSE '' END AS code, CASE WHEN trim(raw) = '' THEN 'missing' WHEN length(trim(raw)) = 2 THEN 'as_provided_code' WHEN upper(trim(raw)) IN ('OKLAHOMA', 'TEXAS') THEN 'normalized_full_name' ELSE 'unrecognized' END AS flag FROM s",
)
def state_normalization(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("raw")).union(table(spark, d, "region").select("r_name"))
    rows = rows.union(spark.createDataFrame([("",), ("Oklahoma",), (" texas ",)], "raw string")).distinct()
    up = F.upper(F.trim("raw"))
    names = F.create_map(*[F.lit(x) for pair in K.STATES.items() for x in pair])
    code = F.when(up.rlike("^[A-Z]{2}$"), up).otherwise(F.coalesce(F.try_element_at(names, up), F.lit("")))
    flag = F.when(up == "", "missing").when(up.rlike("^[A-Z]{2}$"), "as_provided_code").when(code != "", "normalized_full_name").otherwise("unrecognized")
    return rows.select("raw", code.alias("code"), flag.alias("flag"))


# --- overlap --------------------------------------------------------------------------------------

SQL_OVERLAP = "SELECT l_suppkey, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_either FROM (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY 1, 2) GROUP BY 1"


def _overlap(spark, d):
    return R.set_overlap(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")


@query("provider_url_overlap", f"SELECT *, n_both / nullif(n_either, 0) AS jaccard FROM ({SQL_OVERLAP})")
def provider_url_overlap(spark, d):
    return _overlap(spark, d)


@query(
    "pooled_vs_macro_jaccard",
    f"SELECT s_nationkey AS nation, count(*) AS queries, sum(n_both)::BIGINT AS both_n, sum(n_either)::BIGINT AS either_n, sum(n_both) / nullif(sum(n_either), 0) AS pooled, round(sum(n_both / nullif(n_either, 0)) / count(*), 9) AS macro_all, round(avg(n_both / nullif(n_either, 0)), 9) AS macro_seen FROM ({SQL_OVERLAP}) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
)
def pooled_vs_macro(spark, d):
    """Means to nine decimals, so that the order of their sums does not show."""
    rows = _overlap(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("queries"), F.sum("n_both").alias("both_n"), F.sum("n_either").alias("either_n"), F.try_divide(F.sum("n_both"), F.sum("n_either")).alias("pooled"), F.round(F.sum("jaccard") / F.count(F.lit(1)), 9).alias("macro_all"), F.round(F.avg("jaccard"), 9).alias("macro_seen"))


@query("provider_attribution", "SELECT n_nationkey, CASE WHEN c AND s THEN 'both' WHEN c THEN 'first_only' WHEN s THEN 'second_only' ELSE 'neither' END AS origin FROM (SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS c, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) AS s FROM nation)")
def provider_attribution(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey")
    c = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("c", F.lit(True))
    s = table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("s", F.lit(True))
    origin = F.when(F.col("c") & F.col("s"), "both").when(F.col("c"), "first_only").when(F.col("s"), "second_only").otherwise("neither")
    return nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", origin.alias("origin"))


@query(
    "multi_dimension_rollup",
    "SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'segment' END AS dimension, coalesce(o_orderstatus, o_orderpriority, c_mktsegment) AS value, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment))",
)
def multi_dimension_rollup(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sets = rows.groupingSets([["o_orderstatus"], ["o_orderpriority"], ["c_mktsegment"]], "o_orderstatus", "o_orderpriority", "c_mktsegment")
    which = F.when(F.grouping("o_orderstatus") == 0, "status").when(F.grouping("o_orderpriority") == 0, "priority").otherwise("segment")
    found = sets.agg(which.alias("dimension"), F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return found.select("dimension", F.coalesce("o_orderstatus", "o_orderpriority", "c_mktsegment").alias("value"), "orders", "customers")


@query("coverage_comparison", "SELECT coalesce(a.k, b.k) AS nation, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) b ON a.k = b.k")
def coverage_comparison(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return R.coverage(a, table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("nation")), "nation")


# --- statistics -----------------------------------------------------------------------------------

_Z = repr(stats.Z)
_Z2 = repr(stats.Z * stats.Z)


@query(
    "wilson_interval",
    f"""
WITH g AS (SELECT lang, sum(quality)::BIGINT AS successes, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT *, successes / total::DOUBLE AS p, total::DOUBLE AS n, 1 + {_Z2}::DOUBLE / total AS s FROM g)
SELECT lang, successes, total, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p + {_Z2}::DOUBLE / (2 * n)) / s - {_Z}::DOUBLE * sqrt((p * (1 - p) + {_Z2}::DOUBLE / (4 * n)) / n) / s)) AS low,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p + {_Z2}::DOUBLE / (2 * n)) / s + {_Z}::DOUBLE * sqrt((p * (1 - p) + {_Z2}::DOUBLE / (4 * n)) / n) / s)) AS high FROM p""",
)
def wilson_interval(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.groupBy("lang").agg(F.sum("quality").alias("successes"), F.count(F.lit(1)).alias("total"))
    low, high = stats.wilson(F.col("successes"), F.col("total"))
    return rows.select("lang", "successes", "total", low.alias("low"), high.alias("high"))


ORDER_LABELS = (["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("confusion_matrix", f"SELECT x.a AS o_orderstatus, y.b AS o_orderpriority, coalesce(n, 0) AS n FROM (SELECT unnest([{_sql_list(ORDER_LABELS[0])}]) AS a) x CROSS JOIN (SELECT unnest([{_sql_list(ORDER_LABELS[1])}]) AS b) y LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) c ON c.o_orderstatus = x.a AND c.o_orderpriority = y.b")
def confusion_matrix(spark, d):
    return stats.confusion(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", *ORDER_LABELS)


@query(
    "cohen_kappa",
    "WITH c AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels GROUP BY 1, 2), w AS (SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (a = b), 0)::BIGINT AS agreed FROM c),\nm AS (SELECT sum(x.n * y.n)::BIGINT AS chance FROM (SELECT a, sum(n)::BIGINT AS n FROM c GROUP BY 1) x JOIN (SELECT b, sum(n)::BIGINT AS n FROM c GROUP BY 1) y ON x.a = y.b)\nSELECT n, agreed, agreed / n AS agreement, (agreed * n - chance) / (n * n - chance) AS kappa FROM w, m",
)
def cohen_kappa(spark, d):
    return stats.kappa(table(spark, d, "labels").selectExpr("string(quality) as q", "string(toxic) as t"), "q", "t")


@query(
    "weighted_rate",
    "WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), l AS (SELECT lang, count(*) AS n, sum(quality)::BIGINT AS yes FROM labels JOIN documents USING (doc_id) GROUP BY 1)\nSELECT lang, size, n, yes, n / size AS inclusion_probability, size * yes / n AS weighted_yes FROM s JOIN l USING (lang)",
)
def weighted_rate(spark, d):
    """Stratum by stratum: weights are size over sample; the rate is the ratio of the summed columns."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sampled = table(spark, d, "labels").join(docs, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("yes"))
    rows = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).join(sampled, "lang")
    return rows.withColumn("inclusion_probability", F.col("n") / F.col("size")).withColumn("weighted_yes", F.col("size") * F.col("yes") / F.col("n"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    """The weighted rate of good labels with its interval of 10,000 replicates; a language's weight is its documents over its labels."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sampled = table(spark, d, "labels").join(docs, "doc_id").select("lang", (F.col("quality") == 1).alias("yes"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    weights = sizes.join(sampled.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")), F.expr("lang <=> l")).select("l", (F.col("size") / F.col("n")).alias("weight"))
    return stats.stratified_bootstrap(sampled.join(F.broadcast(weights), F.expr("lang <=> l")), "lang", "yes", "weight", 10_000)


# --- sampling -------------------------------------------------------------------------------------

SQL_ALLOCATION = """WITH s AS (SELECT lang || '|' || source AS stratum, count(*) AS size FROM documents GROUP BY 1),
a AS (SELECT *, size * 100 // sum(size) OVER () AS base, (size * 100) % (sum(size) OVER ())::BIGINT AS rest FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, stratum DESC) AS k, 100 - sum(base) OVER () AS left_over FROM a)
SELECT stratum, size, least(size, base + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS allocation FROM r"""


def _allocation(spark, d):
    strata = table(spark, d, "documents").groupBy(F.concat_ws("|", "lang", "source").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return R.largest_remainder(strata, "stratum", "size", 100)


@query("largest_remainder_alloc", SQL_ALLOCATION)
def largest_remainder_alloc(spark, d):
    return _allocation(spark, d)


@query(
    "stratified_sample",
    f"WITH al AS ({SQL_ALLOCATION}), k AS (SELECT doc_id, stratum, allocation, size, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260730|' || doc_id), doc_id) AS k FROM (SELECT doc_id, lang || '|' || source AS stratum FROM documents) JOIN al USING (stratum))\nSELECT doc_id, stratum, allocation / size AS inclusion_probability, ('0x' || substr(md5('second|' || doc_id), 1, 8))::BIGINT % 4 = 0 AS double_review FROM k WHERE k.k <= allocation",
)
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("|", "lang", "source").alias("stratum"))
    second = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("second"), "doc_id")), 1, 8), 16, 10).cast("long") % 4 == 0
    kept = R.sample_strata(docs, _allocation(spark, d), "doc_id", "20260730")
    return kept.select("doc_id", "stratum", (F.col("allocation") / F.col("size")).alias("inclusion_probability"), second.alias("double_review"))


# --- adjudication ---------------------------------------------------------------------------------

FIELDS = ["eqdp", "reason", "scale"]
SQL_SIDES = """h AS (SELECT doc_id, quality, toxic, ('0x' || substr(md5('a|' || doc_id), 1, 8))::BIGINT AS ha, ('0x' || substr(md5('b|' || doc_id), 1, 8))::BIGINT AS hb, ('0x' || substr(md5('c|' || doc_id), 1, 8))::BIGINT AS hc FROM labels),
s AS (SELECT doc_id, CASE WHEN ha % 7 = 0 THEN 'unclear' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a_eqdp, CASE WHEN hb % 5 = 0 THEN 'unclear' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS b_eqdp, CASE WHEN hc % 3 = 0 THEN 'unclear' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS c_eqdp,
 CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS a_reason, CASE WHEN toxic = 1 AND hb % 2 = 0 THEN 'toxic' ELSE 'none' END AS b_reason, CASE WHEN toxic = 1 AND hc % 2 = 0 THEN 'toxic' ELSE 'none' END AS c_reason,
 CASE WHEN ha % 4 = 0 THEN NULL ELSE (ha % 3)::VARCHAR END AS a_scale, CASE WHEN ha % 4 = 0 THEN NULL WHEN hb % 6 = 0 THEN '9' ELSE (ha % 3)::VARCHAR END AS b_scale, (hc % 3)::VARCHAR AS c_scale FROM h)"""
SQL_FINAL = f"""{SQL_SIDES}, f AS (SELECT *, (a_eqdp IS DISTINCT FROM b_eqdp) AS d1, (a_reason IS DISTINCT FROM b_reason) AS d2, (a_scale IS DISTINCT FROM b_scale) AS d3 FROM s),
m AS (SELECT *, CASE WHEN d1 THEN c_eqdp ELSE a_eqdp END AS eqdp, CASE WHEN d2 THEN c_reason ELSE a_reason END AS reason, CASE WHEN d3 THEN c_scale ELSE a_scale END AS scale, CASE WHEN d1 OR d2 OR d3 THEN c_eqdp ELSE a_eqdp END AS whole_eqdp,
  array_to_string(list_filter([CASE WHEN d1 THEN 'eqdp' ELSE '' END, CASE WHEN d2 THEN 'reason' ELSE '' END, CASE WHEN d3 THEN 'scale' ELSE '' END], lambda x: x <> ''), '|') AS disputed FROM f)"""


def _merged(spark, d):
    h = lambda x: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(x), "doc_id")), 1, 8), 16, 10).cast("long")
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic", h("a").alias("ha"), h("b").alias("hb"), h("c").alias("hc"))
    label = lambda unclear: F.when(unclear, "unclear").when(F.col("quality") == 1, "yes").otherwise("no")
    toxic = lambda also: F.when((F.col("toxic") == 1) & also, "toxic").otherwise("none")
    own = F.when(F.col("ha") % 4 != 0, (F.col("ha") % 3).cast("string"))
    a = F.struct(label(F.col("ha") % 7 == 0).alias("eqdp"), toxic(F.lit(True)).alias("reason"), own.alias("scale"))
    b = F.struct(label(F.col("hb") % 5 == 0).alias("eqdp"), toxic(F.col("hb") % 2 == 0).alias("reason"), F.when(own.isNull(), None).when(F.col("hb") % 6 == 0, "9").otherwise(own).alias("scale"))
    c = F.struct(label(F.col("hc") % 3 == 0).alias("eqdp"), toxic(F.col("hc") % 2 == 0).alias("reason"), (F.col("hc") % 3).cast("string").alias("scale"))
    rows = rows.select("doc_id", a.alias("a"), b.alias("b"), c.alias("c")).withColumn("fields", R.disputed("a", "b", FIELDS))
    whole = F.when(F.size("fields") > 0, F.col("c.eqdp")).otherwise(F.col("a.eqdp"))
    return rows.select("doc_id", "a", "b", "c", "fields", *R.fieldwise("a", "b", "c", FIELDS), whole.alias("whole_eqdp"))


@query("fieldwise_adjudication", f"WITH {SQL_FINAL} SELECT doc_id, eqdp, reason, scale, whole_eqdp, disputed FROM m")
def fieldwise_adjudication(spark, d):
    return _merged(spark, d).select("doc_id", *FIELDS, "whole_eqdp", F.array_join("fields", "|").alias("disputed"))


@query("routing_audit", f"WITH {SQL_FINAL} SELECT count(*) AS n, count(*) FILTER (disputed <> '') AS routed, count(*) FILTER (disputed <> '' AND NOT d1) AS at_risk, count(*) FILTER (disputed <> '' AND NOT d1 AND c_eqdp <> a_eqdp) AS overwritten, count(*) FILTER (disputed <> '' AND NOT d1 AND c_eqdp <> a_eqdp) / nullif(count(*) FILTER (disputed <> '' AND NOT d1), 0) AS fraction FROM m")
def routing_audit(spark, d):
    routed = F.size("fields") > 0
    at_risk = routed & ~F.array_contains("fields", "eqdp")
    over = at_risk & (F.col("c.eqdp") != F.col("a.eqdp"))
    return _merged(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(routed).alias("routed"), F.count_if(at_risk).alias("at_risk"), F.count_if(over).alias("overwritten"), F.try_divide(F.count_if(over), F.count_if(at_risk)).alias("fraction"))


@query("stage_transitions", f"WITH {SQL_FINAL} SELECT whole_eqdp AS before, eqdp AS after, count(*) AS n FROM m GROUP BY 1, 2")
def stage_transitions(spark, d):
    return _merged(spark, d).groupBy(F.col("whole_eqdp").alias("before"), F.col("eqdp").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("agreement_by_field", f"WITH {SQL_FINAL} SELECT 'eqdp' AS field, count(*) FILTER (NOT d1) AS agreed, count(*) AS n FROM m UNION ALL SELECT 'reason', count(*) FILTER (NOT d2), count(*) FROM m UNION ALL SELECT 'scale', count(*) FILTER (NOT d3), count(*) FROM m")
def agreement_by_field(spark, d):
    rows = _merged(spark, d).select("fields", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"))
    return rows.groupBy("field").agg(F.count_if(~F.array_contains("fields", F.col("field"))).alias("agreed"), F.count(F.lit(1)).alias("n"))


@query("label_reason_crosstab", f"WITH {SQL_FINAL} SELECT reason, count(*) FILTER (eqdp = 'yes') AS yes, count(*) FILTER (eqdp = 'no') AS no, count(*) FILTER (eqdp = 'unclear') AS unclear FROM m GROUP BY 1")
def label_reason_crosstab(spark, d):
    return _merged(spark, d).groupBy("reason").pivot("eqdp", ["yes", "no", "unclear"]).count().na.fill(0)


@query(
    "row_quarantine",
    "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN flags = '' THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN l.doc_id IS NULL THEN '' ELSE flags END AS flags FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN lang NOT IN ('en', 'fr') THEN 'lang_enum' ELSE '' END, CASE WHEN length(text) > 3000 THEN 'max_length' ELSE '' END, CASE WHEN n_chars <> length(text) THEN 'count' ELSE '' END], lambda x: x <> ''), '|') AS flags FROM documents) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def row_quarantine(spark, d):
    """Documents that were answered (have a label): valid, or invalid with flags; the others are missing. Nothing is relabelled."""
    expected = table(spark, d, "documents")
    answered = table(spark, d, "labels").select("doc_id").distinct().withColumn("given", F.lit(True))
    flags = F.array_compact(F.array(F.when(~F.col("lang").isin("en", "fr"), "lang_enum"), F.when(F.length("text") > 3000, "max_length"), F.when(F.col("n_chars") != F.length("text"), "count")))
    rows = expected.select("doc_id", F.array_join(flags, "|").alias("found")).join(answered, "doc_id", "left")
    joined = F.when(F.col("given"), F.col("found")).otherwise("")
    return rows.select("doc_id", F.when(F.col("given").isNull(), "missing").when(joined == "", "valid").otherwise("invalid").alias("status"), joined.alias("flags"))


# --- text and pages -------------------------------------------------------------------------------


@query(
    "quote_containment",
    "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0",
)
def quote_containment(spark, d):
    """Literal containment of every quote, by an automaton of all quotes or of each part of very many."""
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return P.contained(table(spark, d, "documents").select("doc_id", "text"), quotes)


@query("html_visible_text")
def html_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", P.evidence_text("html").alias("evidence"), P.without_cookies(P.page_fields("html").text).alias("visible"))


@query("html_title_meta", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title_meta(spark, d):
    return table(spark, d, "pages").select("page_id", P.page_title(F.col("html")).alias("title"))


@query("evidence_windows")
def evidence_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", P.windows_udf("keyword", ["tion", "sch", "quality"])("text").alias("evidence"))


@query("size_term_windows")
def size_term_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", P.windows_udf("size")("text").alias("evidence"), F.array_join(P.windows_udf("pilot")("text"), "\n").alias("pilot"))


@query(
    "forbidden_pattern_scan",
    "SELECT doc_id, regexp_matches(text, '(?i)(token|password|secret|api_key)\\s*[=:]') AS secret, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, regexp_matches(text, '(?i)licen[sc]e') AS licence, contains(text, '/Users/') OR contains(text, '/home/') AS home_path FROM documents",
)
def forbidden_pattern_scan(spark, d):
    has = lambda pattern: F.col("text").rlike(pattern)
    return table(spark, d, "documents").select("doc_id", has(r"(?i)(token|password|secret|api_key)\s*[=:]").alias("secret"), has(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("email"), has("(?i)licen[sc]e").alias("licence"), (F.col("text").contains("/Users/") | F.col("text").contains("/home/")).alias("home_path"))


# --- entities -------------------------------------------------------------------------------------


@query(
    "best_baseline_match",
    """
WITH p AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS t,
  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM part),
b AS (SELECT p_brand AS base, min(p_partkey) AS pos, list_sort(list_distinct(flatten(list(t)))) AS bt FROM p GROUP BY 1),
j AS (SELECT p_partkey, base, pos, array_to_string(bt, ' ') = name AS same, len(list_intersect(t, bt)) / len(list_distinct(list_concat(t, bt))) AS score FROM p CROSS JOIN b),
k AS (SELECT p_partkey, base, same, CASE WHEN same THEN 1.0::DOUBLE ELSE score END AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY same DESC, score DESC, pos) AS k FROM j)
SELECT p_partkey, CASE WHEN score >= 0.8 THEN base ELSE '' END AS base, CASE WHEN same THEN 'exact_normalized_name' WHEN score >= 0.8 THEN 'token_jaccard_review' ELSE '' END AS method, score FROM k WHERE k = 1""",
)
def best_baseline_match(spark, d):
    """Each part's name against the words of every brand's parts: exact name first, else the nearest from 0.80 on."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    words = part.select("p_partkey", "p_brand", F.explode_outer(text.token_set(F.col("p_name"))).alias("w"))
    base = words.groupBy(F.col("p_brand").alias("base")).agg(F.min("p_partkey").alias("pos"), F.array_join(F.sort_array(F.collect_set("w")), " ").alias("name"))
    found = R.best_match(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), base, 0.8)
    return found.select(F.col("id").alias("p_partkey"), "base", "method", "score")


@query("blocked_alias_pairs")
def blocked_alias_pairs(spark, d):
    """Suppliers of a nation whose names may be aliases: the least supplier of each name stands for it, and those of the same name are linked to that one."""
    from attesta.operators.entities import alias_edges

    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", text.normalize_name(F.col("s_name")).alias("name"))
    edges = alias_edges(rows, "s_nationkey", "name", text.alias_udf(5, 0.88, False), 5, 0.88)
    first = rows.groupBy("s_nationkey", "name").agg(F.min("s_suppkey").alias("first"))
    end = lambda side, key: first.select("s_nationkey", F.col("name").alias(side), F.col("first").alias(key))
    different = edges.join(end("a", "x"), ["s_nationkey", "a"]).join(end("b", "y"), ["s_nationkey", "b"]).select("s_nationkey", "x", "y", F.lit(False).alias("same_name"))
    equal = first.join(rows, ["s_nationkey", "name"]).filter("first <> s_suppkey").select("s_nationkey", F.col("first").alias("x"), F.col("s_suppkey").alias("y"), F.lit(True).alias("same_name"))
    return different.unionByName(equal).select("s_nationkey", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "same_name")


@query(
    "entity_components",
    f"""
WITH RECURSIVE p AS (SELECT page_id, domain, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) || '|' || page_id % 40 AS k FROM ({SQL_PAGES})),
e AS (SELECT a.page_id AS x, b.page_id AS y FROM p a JOIN p b ON a.domain = b.domain OR a.k = b.k),
r(v, u) AS (SELECT page_id, page_id FROM p UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u)
SELECT v AS page_id, min(u) AS entity FROM r GROUP BY 1""",
)
def entity_components(spark, d):
    """Pages that share a domain, or a section and residue, by star edges to the least page of each key."""
    pages = _pages(spark, d).select("page_id", "domain", F.concat_ws("|", F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1), F.col("page_id") % 40).alias("k"))
    edges = R.union_all(*[pages.join(pages.groupBy(c).agg(F.min("page_id").alias("hub")), c).select("page_id", "hub") for c in ("domain", "k")])
    found = R.components(edges, "page_id", "hub").select(F.col("v").alias("page_id"), F.col("label").alias("entity"))
    return found


@query("dedup_by_content_hash", "SELECT sha256(text) AS content, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def dedup_by_content_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


# --- increments, revisions, batches ---------------------------------------------------------------


@query(
    "incremental_upsert",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
)
def incremental_upsert(spark, d):
    """Customers' latest orders before a date, then the later ones merged in: equal to the latest of all."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp")
    before = R.last_wins(orders.filter(F.col("o_orderdate") < cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    after = R.last_wins(orders.filter(F.col("o_orderdate") >= cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return R.upsert(before, after, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("latest_revision", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def latest_revision(spark, d):
    return R.last_wins(table(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("request_gap_check", "SELECT user_id, count(*) AS gaps, count(*) FILTER (gap < 60000000) AS short, min(gap) AS least_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")
def request_gap_check(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap")).filter("gap is not null")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("gap") < 60_000_000).alias("short"), F.min("gap").alias("least_us"))


@query("batching", "SELECT (row_number() OVER (ORDER BY conv_id, turn) - 1) // 10 + 1 AS batch, conv_id, turn FROM conversations")
def batching(spark, d):
    from attesta.sources.files import batches

    return batches(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 10).select("batch", "conv_id", "turn")


@query("disjoint_split", f"SELECT page_id, domain, 'eval' AS split FROM (SELECT page_id, domain, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS k FROM ({SQL_PAGES}) WHERE domain NOT IN (SELECT domain FROM ({SQL_PAGES}) WHERE contains(url, '//shop.') OR contains(url, 'example.net'))) WHERE k = 1")
def disjoint_split(spark, d):
    """One page of each registrable domain that the development set (shops and the .net pages) doesn't touch."""
    pages = _pages(spark, d).select("page_id", "url", "domain")
    taken = pages.filter(F.contains("url", F.lit("//shop.")) | F.contains("url", F.lit("example.net"))).select("domain").distinct()
    return pages.join(taken, "domain", "left_anti").groupBy("domain").agg(F.min("page_id").alias("page_id")).select("page_id", "domain", F.lit("eval").alias("split"))


@query("manifest_fingerprint", "SELECT 'nation' AS name, count(*) AS n, sha256(string_agg(sha256(n_nationkey || '|' || n_name || '|' || n_regionkey), chr(10) ORDER BY sha256(n_nationkey || '|' || n_name || '|' || n_regionkey))) AS digest FROM nation UNION ALL SELECT 'region', count(*), sha256(string_agg(sha256(r_regionkey || '|' || r_name), chr(10) ORDER BY sha256(r_regionkey || '|' || r_name))) FROM region")
def manifest_fingerprint(spark, d):
    """Row count and hash of sorted row hashes of the reference tables, whose size is fixed."""

    def one(name, columns):
        rows = table(spark, d, name).select(F.sha2(F.concat_ws("|", *columns), 256).alias("h"))
        return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("digest")).select(F.lit(name).alias("name"), "n", "digest")

    return one("nation", ["n_nationkey", "n_name", "n_regionkey"]).unionByName(one("region", ["r_regionkey", "r_name"]))


@query("explode_multi_value_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def explode_counts(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("budget_running_sum", "SELECT o_custkey, o_orderkey, cents FROM (SELECT *, sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)) WHERE run <= 50000000")
def budget_running_sum(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", cents.alias("cents"))
    run = F.sum("cents").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).filter("run <= 50000000").drop("run")
