"""Queries of adjudication, constraints, entity resolution, report metrics and scalar values, with their SQL.

The tables have no reviews, so reviews, decisions and fetches are derived from their columns by the same expressions on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import constants as K
from attesta.functions import names as N
from attesta.functions import text
from attesta.functions import values as V
from attesta.operators import adjudication as A
from attesta.operators import constraints as C
from attesta.operators import entities as E
from attesta.operators import metrics as M
from attesta.operators import relational as R
from attesta.plans.queries import FIELDS, SQL_FINAL, _sql_any, _sql_list
from attesta.plans.registry import query, table

_FORMS = K.FORM_WORDS
_SUFFIX, _GROUP = "|".join(text.SUFFIXES), "|".join(text.SUFFIXES_GROUP)


def _sql_flags(**faults: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' ELSE '' END" for n, c in faults.items()) + "], lambda x: x <> ''), '|')"


def _h(salt: str):
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), "doc_id")), 1, 8), 16, 10).cast("long")


def _sides(spark, d):
    """Three reviewers' tables: a and b of all labelled documents, c of the disputed ones."""
    from attesta.plans.queries import _merged

    rows = _merged(spark, d)
    side = lambda x, note: rows.select("doc_id", *[F.col(f"{x}.{f}").alias(f) for f in FIELDS], F.concat(F.lit(note), "doc_id").alias("note"))
    return side("a", "a"), side("b", "b"), side("c", "c").join(rows.filter("size(fields) > 0").select("doc_id"), "doc_id", "left_semi")


def _final(spark, d):
    return A.fieldwise_rows(*_sides(spark, d), "doc_id", FIELDS, ["note"])


# --- names and scalar values ----------------------------------------------------------------------

_NAMED = "SELECT s_suppkey, s_name || ' Mfg Technologies (' || n_name || ') Group Co., L.L.C.' AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_KEY = "trim(regexp_replace(regexp_replace({x}, '\\b({w})\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_LONG = "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in K.ABBREVIATIONS.items()) + " ELSE w END"


def _named(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.concat("s_name", F.lit(" Mfg Technologies ("), "n_name", F.lit(") Group Co., L.L.C.")).alias("name"))


@query(
    "name_variants",
    f"""
WITH n AS ({_NAMED}), k AS (SELECT s_suppkey, {_KEY.format(x="lower(name)", w=_SUFFIX)} AS plain, {_KEY.format(x="lower(name)", w=_GROUP)} AS grouped,
  {_KEY.format(x="regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g')", w=_FORMS)} AS forms FROM n)
SELECT *, array_to_string(list_transform(string_split(forms, ' '), lambda w: {_LONG}), ' ') AS expanded FROM k""",
)
def name_variants(spark, d):
    key = lambda v: N.name_key(F.col("name"), v)
    return _named(spark, d).select("s_suppkey", key("plain").alias("plain"), key("group").alias("grouped"), key("forms").alias("forms"), key("expanded").alias("expanded"))


_TITLE = "trim(regexp_extract(html, '<title>([^<|&]*)', 1))"


@query(
    "candidate_names",
    f"""
WITH p AS (SELECT page_id, trim(regexp_split_to_array({_TITLE}, '\\s+[|—–-]\\s+')[1]) AS t, regexp_extract(url, '^https?://([^.]*)', 1) AS label FROM pages)
SELECT page_id, CASE WHEN length(t) BETWEEN 2 AND 119 AND lower(t) NOT IN ('home', 'homepage') THEN t ELSE upper(label[1:1]) || lower(label[2:]) END AS name FROM p""",
)
def candidate_names(spark, d):
    title = F.trim(F.regexp_extract("html", "<title>([^<|&]*)", 1))
    label = F.regexp_extract("url", "^https?://([^.]*)", 1)
    return table(spark, d, "pages").select("page_id", N.candidate_name(F.lit(None).cast("string"), title, label).alias("name"))


@query("clean_lists", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_name, ' ' || p_type || ' ', p_brand, p_type, ' '].list_transform(lambda x: trim(x)), lambda x: x <> ''))), '|') AS items FROM part")
def clean_lists(spark, d):
    items = F.array("p_name", F.concat(F.lit(" "), "p_type", F.lit(" ")), "p_brand", "p_type", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", F.array_join(V.clean_list(items), "|").alias("items"))


@query("fixed_decimals", "SELECT o_orderkey, printf('%.3f', o_totalprice / 7) AS three, printf('%.12f', o_totalprice / 700000000) AS twelve FROM orders")
def fixed_decimals(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.fixed(3)(F.col("o_totalprice") / 7).alias("three"), V.fixed(12)(F.col("o_totalprice") / 700000000).alias("twelve"))


@query("token_costs", "SELECT conv_id, turn, length(text) * 300000 + turn * 2500000 AS pico FROM conversations")
def token_costs(spark, d):
    cost = V.token_cost(F.length("text"), F.col("turn"), "0.30", "2.50")
    return table(spark, d, "conversations").select("conv_id", "turn", (cost * F.lit(10**12).cast("decimal(13,0)")).cast("long").alias("pico"))


@query("retry_delays", "SELECT event_id, CASE WHEN value > 50 THEN greatest(1.0, value, value * 2) WHEN value > 20 THEN greatest(1.0, value, 90.0) ELSE greatest(1.0, value) END AS delay FROM events")
def retry_delays(spark, d):
    date = F.date_format(F.col("ts") + F.expr("interval 90 seconds"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    said = F.when(F.col("value") > 50, (F.col("value") * 2).cast("string")).when(F.col("value") > 20, date)
    return table(spark, d, "events").select("event_id", V.retry_delay(F.col("value"), said, F.col("ts")).alias("delay"))


_SAID = "CASE WHEN value > 60 THEN 'API error: ' || (400 + CAST(json_extract_string(props, '$.k') AS BIGINT)) WHEN value > 40 THEN 'Socket hang up' WHEN value > 30 THEN 'quota exceeded, status 503' WHEN value > 20 THEN 'status=503 busy' ELSE '' END"
_SAID_CODE = "TRY_CAST(nullif(regexp_extract(said, '(?:api error:|http(?: status)?:?|status(?:_code)?[=:]?)\\s*(\\d{3})\\b', 1), '') AS INTEGER)"


@query(
    "retry_reasons",
    f"""
WITH e AS (SELECT event_id, value, lower({_SAID}) AS said, CASE WHEN event_type = 'error' THEN 'TimeoutError' ELSE 'ValueError' END AS kind FROM events), c AS (SELECT *, {_SAID_CODE} AS code FROM e)
SELECT event_id, CASE WHEN {_sql_any("said", K.FINAL_WORDS)} OR coalesce(code IN ({", ".join(map(str, K.FINAL_STATUSES))}), false) THEN NULL WHEN code IN ({", ".join(map(str, K.RETRY_STATUSES))}) THEN 'temporary_http_' || code
  WHEN {_sql_any("said", K.CONNECTION_WORDS)} THEN 'temporary_connection_error' WHEN kind IN ({_sql_list(K.TRANSPORT_ERRORS)}) THEN 'transport_' || kind END AS reason FROM c""",
)
def retry_reasons(spark, d):
    said = F.when(F.col("value") > 60, F.concat(F.lit("API error: "), (400 + F.get_json_object("props", "$.k").cast("long")).cast("string")))
    said = said.when(F.col("value") > 40, "Socket hang up").when(F.col("value") > 30, "quota exceeded, status 503").when(F.col("value") > 20, "status=503 busy").otherwise("")
    kind = F.when(F.col("event_type") == "error", "TimeoutError").otherwise("ValueError")
    return table(spark, d, "events").select("event_id", V.retry_reason(F.lit(None), said, kind).alias("reason"))


@query("json_bodies", "SELECT event_id, CASE WHEN value > 20 THEN props END AS body FROM events")
def json_bodies(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    said = F.when(F.col("value") > 60, fenced).when(F.col("value") > 40, F.concat(F.lit(" "), "props")).when(F.col("value") > 20, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.lit("The answer is {"))
    return table(spark, d, "events").select("event_id", V.json_body(said).alias("body"))


@query("canonical_row_hash", """SELECT n_nationkey, 'row-' || substr(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_none":null,"n_regionkey":' || n_regionkey || '}'), 1, 20) AS id FROM nation""")
def canonical_row_hash(spark, d):
    row = V.canonical_json(n_regionkey=F.col("n_regionkey"), n_name=F.col("n_name"), n_nationkey=F.col("n_nationkey"), n_none=F.lit(None).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", text.stable_id("row", row).alias("id"))


@query("forbidden_key_scan", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'candidate_id|review_id' ELSE '' END AS keys FROM events")
def forbidden_key_scan(spark, d):
    inner = F.to_json(F.struct(F.array(F.struct(F.col("event_id").alias("Review_ID"), F.lit('a "rationale": inside').alias("x"))).alias("list"), F.lit(1).alias("candidate_id")))
    document = F.when(F.col("event_type") == "error", inner).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(V.forbidden_keys(document, K.FORBIDDEN_KEYS), "|").alias("keys"))


@query("set_ids", "SELECT o_custkey, 'cluster-' || substr(sha256(string_agg(DISTINCT o_orderpriority, '||' ORDER BY o_orderpriority)), 1, 20) AS id FROM orders GROUP BY 1")
def set_ids(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(V.set_id("cluster", F.collect_set("o_orderpriority")).alias("id"))


@query("capability_groups", "SELECT doc_id, " + _sql_flags(**{g: f"n_chars > 100 AND {_sql_any('lower(text)', t)}" for g, t in K.CAPABILITIES.items()}) + " AS groups, n_chars > 100 AND " + _sql_any("lower(text)", K.SEMICONDUCTOR_TERMS) + " AS semiconductor FROM documents")
def capability_groups(spark, d):
    """Capability groups and a signal of usable texts."""
    usable = F.col("n_chars") > 100
    found = C.flags(**{group: usable & text.any_term(F.col("text"), terms) for group, terms in K.CAPABILITIES.items()})
    return table(spark, d, "documents").select("doc_id", F.array_join(found, "|").alias("groups"), (usable & text.any_term(F.col("text"), K.SEMICONDUCTOR_TERMS)).alias("semiconductor"))


# --- adjudication ---------------------------------------------------------------------------------


@query("fieldwise_rows", f"WITH {SQL_FINAL} SELECT doc_id, eqdp, reason, scale, CASE WHEN disputed <> '' THEN 'c' ELSE 'a' END || doc_id AS note, whole_eqdp, disputed, CASE WHEN disputed <> '' THEN 'fieldwise_C_adjudication' ELSE 'AB_agreement' END AS final_source, true AS covered FROM m")
def fieldwise_rows(spark, d):
    return _final(spark, d).select("doc_id", *FIELDS, "note", "whole_eqdp", "disputed", "final_source", "covered")


@query("quote_override", f"WITH {SQL_FINAL} SELECT m.doc_id, CASE WHEN l.toxic = 1 THEN 'no' ELSE eqdp END AS eqdp, CASE WHEN l.toxic = 1 THEN NULL ELSE scale END AS scale, CASE WHEN l.toxic = 1 THEN 'literal_quote_reaudit' WHEN disputed <> '' THEN 'fieldwise_C_adjudication' ELSE 'AB_agreement' END AS final_source FROM m JOIN labels l USING (doc_id)")
def quote_override(spark, d):
    corrections = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit("no").alias("eqdp"), F.lit(None).cast("string").alias("scale"))
    return A.override(_final(spark, d), corrections, "doc_id", ["eqdp", "scale"], "final_source", "literal_quote_reaudit").select("doc_id", "eqdp", "scale", "final_source")


@query(
    "decision_overlay",
    "SELECT c_custkey, CASE WHEN k IS NULL THEN c_mktsegment ELSE top END AS c_mktsegment, CASE WHEN k IS NULL THEN NULL WHEN most > 300000 THEN 'pending_second_source' ELSE 'False' END AS strict FROM customer LEFT JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS top, max(o_totalprice) AS most FROM orders GROUP BY 1) ON k = c_custkey",
)
def decision_overlay(spark, d):
    decisions = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("top"), F.max("o_totalprice").alias("most"))
    strict = F.when(F.col("d.most") > 300000, "pending_second_source").otherwise("False")
    return A.overlay(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), decisions, "c_custkey", {"c_mktsegment": F.col("d.top"), "strict": strict})


_FETCHED = "SELECT page_id, url, sha256(html) AS sha, CASE WHEN length(html) > 3000 THEN 404 ELSE 200 END AS status, CASE WHEN contains(url, 'ref=') THEN 'robots_disallowed' ELSE 'robots_allowed' END AS robots FROM pages"


@query(
    "verification_gate",
    f"""
WITH f AS ({_FETCHED}), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, sha ORDER BY page_id) AS k FROM f) WHERE k = 1),
d AS (SELECT page_id, CASE WHEN contains(html, '<nav>') THEN url ELSE '' END AS u, CASE WHEN contains(html, 'the') THEN sha256(html) ELSE 'other' END AS s, length(url) < 45 AS strict FROM pages),
j AS (SELECT d.*, g.url IS NOT NULL AS met, g.status, g.robots FROM d LEFT JOIN g ON d.u = g.url AND d.s = g.sha)
SELECT page_id, {_sql_flags(no_url="strict AND u = ''", not_fetched="u <> '' AND NOT met", http_status_differs="met AND status <> 200", robots_status_differs="met AND robots <> 'robots_allowed'", not_allowed_or_not_2xx="strict AND met AND NOT (status BETWEEN 200 AND 299 AND robots = 'robots_allowed')")} AS faults FROM j""",
)
def verification_gate(spark, d):
    pages = table(spark, d, "pages")
    sha = F.sha2("html", 256)
    fetched = pages.select(F.col("url").alias("canonical_url"), sha.alias("page_sha256"), F.when(F.length("html") > 3000, 404).otherwise(200).alias("http_status"), F.when(F.contains("url", F.lit("ref=")), "robots_disallowed").otherwise("robots_allowed").alias("robots_status"), F.lit(0).alias("file_pos"), F.col("page_id").alias("row_pos"))
    decisions = pages.select(
        "page_id",
        F.when(F.contains("html", F.lit("<nav>")), F.col("url")).otherwise("").alias("independent_confirmation_url"),
        F.when(F.contains("html", F.lit("the")), sha).otherwise("other").alias("independent_source_sha256"),
        F.lit(200).alias("independent_http_status"),
        F.lit("robots_allowed").alias("independent_robots_status"),
        (F.length("url") < 45).alias("strict_supplier_valid"),
        F.lit("unknown").alias("sme_status_verified"),
    )
    return A.verification_faults(decisions, fetched).select("page_id", F.array_join("faults", "|").alias("faults"))


@query("default_decisions", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'insufficient' WHEN quality IS NOT NULL THEN 'q' || quality END AS status, CASE WHEN source = 'src1' THEN 'automatic_empty_context' WHEN quality IS NOT NULL THEN 'reviewed' ELSE 'missing' END AS final_source FROM documents LEFT JOIN labels USING (doc_id)")
def default_decisions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("source") != "src1", F.col("source")).alias("context"))
    decisions = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("status"))
    return A.with_defaults(rows, decisions, "doc_id", "context", {"status": F.lit("insufficient")}, ["status"]).select("doc_id", "status", "final_source")



@query("flagged_clusters", "WITH c AS (SELECT s_suppkey AS cluster, p_type AS name, l_returnflag AS state, CASE WHEN s_acctbal < 0 THEN 'hosted' ELSE 'dedicated_business_domain' END AS visibility FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50)\nSELECT cluster, string_agg(DISTINCT name, '|' ORDER BY name) AS names, string_agg(DISTINCT state, '|' ORDER BY state) AS states, count(*) AS n FROM c GROUP BY 1 HAVING count(DISTINCT name) > 1 OR count(DISTINCT state) > 1 OR bool_or(visibility = 'hosted')")
def flagged_clusters(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity >= 50").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("s_suppkey").alias("cluster"), F.col("p_type").alias("name"), F.col("l_returnflag").alias("state"), F.when(F.col("s_acctbal") < 0, "hosted").otherwise("dedicated_business_domain").alias("visibility"))
    return A.flagged_clusters(rows, "cluster", "name", "state", "visibility").select("cluster", F.array_join("names", "|").alias("names"), F.array_join("states", "|").alias("states"), F.size("evidence").cast("long").alias("n"))


_SCOPE = "source = 'src0' AND contains(lower(text), 'the') AND contains(lower(text), 'and')"


@query("review_scopes", f"SELECT doc_id, {_SCOPE} AS whole, {_SCOPE} AND contains(lower(text), 'tion') AS us FROM documents")
def review_scopes(spark, d):
    has = lambda x: F.contains(F.lower("text"), F.lit(x))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("source") == "src0", "direct_company_candidate").otherwise("other").alias("source_kind_prelabel"), has("the").alias("semiconductor_signal"), has("and").alias("manufacturing_signal"), has("tion").alias("us_presence_signal"))
    return rows.select("doc_id", A.review_scope("direct_semiconductor_manufacturing").alias("whole"), A.review_scope("us_signal_subset").alias("us"))


def _positives(spark, d):
    """Rows with all component fields, from labels."""
    pick = lambda salt, k: F.when(_h(salt) % k == 0, "no").otherwise("yes")
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("eqdp"), F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("primary_exclusion_reason"), F.when(_h("p") % 5 == 0, "none").otherwise(K.PRODUCTION_KINDS[0]).alias("production_presence"), pick("i", 11).alias("identity_status"), pick("d", 13).alias("direct_producer_status"), F.lit("yes").alias("capability_match"), F.lit("yes").alias("commercial_offering"))
    return rows


_SQL_H = "('0x' || substr(md5('{s}|' || doc_id), 1, 8))::BIGINT"
_SQL_POSITIVES = f"SELECT doc_id, quality = 1 AS yes, coalesce(toxic <> 1, true) AND {_SQL_H.format(s='p')} % 5 <> 0 AND {_SQL_H.format(s='i')} % 11 <> 0 AND {_SQL_H.format(s='d')} % 13 <> 0 AS consistent FROM labels"


@query("positive_consistency", f"SELECT doc_id, consistent, yes AND NOT consistent AS violates FROM ({_SQL_POSITIVES})")
def positive_consistency(spark, d):
    return _positives(spark, d).select("doc_id", A.consistent_positive().alias("consistent"), ((F.col("eqdp") == "yes") & ~A.consistent_positive()).alias("violates"))


@query("positive_contract_counts", f"SELECT count(*) FILTER (yes) AS positive_rows, count(*) FILTER (yes AND NOT consistent) AS component_violations, count(*) FILTER (yes AND lang <> 'en') AS state_mismatches FROM ({_SQL_POSITIVES}) JOIN documents USING (doc_id)")
def positive_contract_counts(spark, d):
    rows = _positives(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return M.positive_contracts(rows, F.col("lang"), F.lit("en"))


@query("failed_quotes", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND NOT contains(text, 'the')")
def failed_quotes(spark, d):
    """Positive rows whose quote isn't in their text."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.filter((F.col("quality") == 1) & ~F.contains("text", F.lit("the"))).select("doc_id")


@query("multi_quote_containment", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), lower(source[1:2])) AS all_held FROM documents")
def multi_quote_containment(spark, d):
    """All quotes, normalised, are in the normalised text."""
    quotes = F.array(F.lit("the"), F.substring("source", 1, 2))
    whole = N.size_quote_key(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", whole.alias("t"), quotes.alias("q"))
    return rows.select("doc_id", F.forall("q", lambda q: F.contains(F.col("t"), F.lower(q))).alias("all_held"))


@query("state_matches", "SELECT c_custkey, replace(trim(lower(' ' || n_name || '. ')), '.', '') IN (lower(n_name), lower(r_name)) AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def state_matches(spark, d):
    """The production state is the queried one's name or abbreviation, whatever its case and periods."""
    states = F.broadcast(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    rows = table(spark, d, "customer").join(states, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.replace(F.trim(F.lower(F.concat(F.lit(" "), "n_name", F.lit(". ")))), F.lit("."), F.lit(""))
    return rows.select("c_custkey", said.isin(F.lower("n_name"), F.lower("r_name")).alias("ok"))


# --- constraints ----------------------------------------------------------------------------------


@query("identity_failures", "WITH r AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1), e AS (SELECT p_partkey AS k FROM part WHERE p_size > 25)\nSELECT (SELECT sum(n) FROM r)::BIGINT AS returned_objects, (SELECT count(*) FROM r) AS unique_returned_ids, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM e)) AS unexpected_unique_ids, (SELECT sum(n - 1) FROM r)::BIGINT AS duplicate_extra_rows, (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM r)) AS requested_ids_absent")
def identity_failures(spark, d):
    returned = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    return C.identity_failures(returned, table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("k")), "k")


_SIZED = "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'exact_employee_count' WHEN p_type = 'STANDARD' THEN 'employee_range' WHEN p_type = 'PROMO' THEN 'employee_lower_bound' WHEN p_size > 40 THEN 'guess' ELSE 'insufficient' END AS s, CASE WHEN p_size > 5 THEN p_size END AS lo, CASE WHEN p_size > 10 THEN 20 END AS hi, CASE WHEN p_size > 3 THEN p_name ELSE '' END AS q FROM part"


@query(
    "size_bound_faults",
    f"SELECT p_partkey, {_sql_flags(status=f's NOT IN ({_sql_list(K.SIZE_STATUSES)})', bounds=chr(32).join(['CASE s WHEN', repr('insufficient'), 'THEN lo IS NOT NULL OR hi IS NOT NULL OR q <> ' + repr(''), 'WHEN', repr('exact_employee_count'), 'THEN lo IS NULL OR hi IS NULL OR lo <> hi WHEN', repr('employee_range'), 'THEN lo IS NULL OR hi IS NULL OR lo > hi WHEN', repr('employee_lower_bound'), 'THEN lo IS NULL OR hi IS NOT NULL END']), quote=chr(32).join(['s <>', repr('insufficient'), 'AND (q =', repr(''), 'OR NOT contains(q,', repr('ring'), '))']))} AS faults FROM ({_SIZED})",
)
def size_bound_faults(spark, d):
    t = F.col("p_type")
    status = F.when(t == "ECONOMY", "exact_employee_count").when(t == "STANDARD", "employee_range").when(t == "PROMO", "employee_lower_bound").when(F.col("p_size") > 40, "guess").otherwise("insufficient")
    quote = F.when(F.col("p_size") > 3, F.col("p_name")).otherwise("")
    faults = C.size_faults(status, F.when(F.col("p_size") > 5, F.col("p_size")), F.when(F.col("p_size") > 10, F.lit(20)), F.lit(False), F.lit(False), quote, F.contains(quote, F.lit("ring")))
    return table(spark, d, "part").select("p_partkey", F.array_join(faults, "|").alias("faults"))


@query("decision_faults", "WITH d AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_totalprice > 450000), e AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), n AS (SELECT k, count(*) AS n FROM d GROUP BY 1)\nSELECT k, 'repeated' AS fault FROM n WHERE n > 1 UNION ALL SELECT k, 'missing' FROM e WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, 'extra' FROM n WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'enum_s' FROM d WHERE s NOT IN ('F', 'O')")
def decision_faults(spark, d):
    decisions = table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return C.decision_faults(decisions, table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k", {"s": ["F", "O"]})


@query("final_field_equality", f"WITH {SQL_FINAL} SELECT 'eqdp' AS field, count(*) FILTER (eqdp IS DISTINCT FROM a_eqdp) AS mismatches FROM m UNION ALL SELECT 'reason', count(*) FILTER (reason IS DISTINCT FROM a_reason) FROM m UNION ALL SELECT 'scale', count(*) FILTER (scale IS DISTINCT FROM a_scale) FROM m")
def final_field_equality(spark, d):
    return C.field_mismatches(_final(spark, d), _sides(spark, d)[0], "doc_id", FIELDS)


@query(
    "answer_faults",
    f"WITH {SQL_FINAL}, a AS (SELECT *, NOT d3 AS sub, CASE WHEN d1 THEN 0 ELSE 7 END AS minutes FROM m) SELECT doc_id, {_sql_flags(enum_scale=chr(32).join(['coalesce(scale,', repr(''), ') <>', repr(''), 'AND scale NOT IN (', repr('0'), ',', repr('1'), ')']), required_scale=chr(32).join(['sub AND coalesce(scale,', repr(''), ') =', repr('')]), positive_with_exclusion=chr(32).join(['sub AND eqdp =', repr('yes'), 'AND reason <>', repr('none')]), negative_without_exclusion=chr(32).join(['sub AND eqdp <>', repr('yes'), 'AND reason =', repr('none')]), minutes='sub AND minutes <= 0')} AS faults FROM a",
)
def answer_faults(spark, d):
    rows = _final(spark, d).select("doc_id", "eqdp", "scale", F.col("reason").alias("primary_exclusion_reason"), (~F.array_contains("names", "scale")).alias("submitted"), F.when(F.array_contains("names", "eqdp"), 0).otherwise(7).alias("review_minutes"))
    return rows.select("doc_id", F.array_join(C.answer_faults({"scale": ["0", "1"]}, ["scale"], F.col("submitted")), "|").alias("faults"))


@query("schema_faults", f"SELECT doc_id, {_sql_flags(missing_status='true', extra_doc_id='true', enum_lang=chr(32).join(['lang NOT IN (', repr('en'), ',', repr('fr'), ')']), length_source='length(source) > 4')} AS faults FROM documents")
def schema_faults(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    faults = C.schema_faults(rows, {"status": (None, None), "lang": (["en", "fr"], None), "source": (None, 4)})
    return rows.select("doc_id", F.array_join(faults, "|").alias("faults"))


@query("subset_and_partition", "SELECT o_custkey, coalesce(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')), '') AS outside, count(*) = count(DISTINCT o_orderpriority) AS partitions FROM orders GROUP BY 1")
def subset_and_partition(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("names"), F.collect_list(F.array("o_orderpriority")).alias("groups"))
    return rows.select("o_custkey", F.array_join(C.not_subset(F.col("names"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))), "|").alias("outside"), C.partitions(F.col("groups"), F.col("names")).alias("partitions"))


@query("release_scan", "SELECT n_name AS name, 'marker NATION_1' AS fault FROM nation WHERE contains(n_name, 'NATION_1') UNION ALL SELECT n_name, 'checksum' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'README.md', 'missing'")
def release_scan(spark, d):
    nation = table(spark, d, "nation")
    texts = nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("text"))
    sums = nation.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "0").otherwise(F.sha2("n_name", 256)).alias("sha256"))
    return C.release_faults(texts, sums, ["README.md", "NATION_0"], ["NATION_1", *K.FORBIDDEN_TEXT])


@query("frozen_inputs", "SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 'absent' WHEN n_regionkey = 1 THEN 'added' ELSE 'changed' END AS fault FROM nation WHERE n_regionkey < 3")
def frozen_inputs(spark, d):
    nation = table(spark, d, "nation")
    now = nation.filter("n_regionkey <> 0").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"))
    then = nation.filter("n_regionkey <> 1").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "0").otherwise(F.sha2("n_name", 256)).alias("sha256"))
    return C.frozen_faults(now, then)


# --- report metrics -------------------------------------------------------------------------------

_W = "1.959963984540054"


@query(
    "pilot_metrics",
    f"""
WITH s AS (SELECT s_acctbal > 0 AS rev, s_acctbal > 4000 AS strict, s_nationkey > 12 AS novel, s_acctbal > 8000 AS small FROM supplier),
c AS (SELECT count(*) FILTER (rev) AS reviewed, count(*) FILTER (rev AND strict) AS strict, count(*) FILTER (rev AND strict AND novel) AS net_new, count(*) FILTER (rev AND strict AND small) AS probable_sme, (SELECT count(DISTINCT p_brand) FROM part) AS denominator FROM s),
w AS (SELECT *, strict / reviewed AS p, {_W} * {_W} AS z2, reviewed::DOUBLE AS n FROM c),
b AS (SELECT *, greatest(0, ((p + z2 / (2 * n)) / (1 + z2 / n)) - {_W} * sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)) AS low FROM w)
SELECT reviewed, strict, net_new, probable_sme, denominator, round(p, 9) AS precision, round(low, 9) AS low, round(net_new / denominator, 9) AS lift, net_new >= 25 AS count_gate, low >= 0.55 AS bound_gate FROM b""",
)
def pilot_metrics(spark, d):
    bal = F.col("s_acctbal")
    rows = table(spark, d, "supplier").select(F.when(bal > 0, "high").otherwise("").alias("reviewer1_confidence"), (bal > 4000).alias("is_valid_supplier_strict"), F.when(F.col("s_nationkey") > 12, "novel_candidate").otherwise("known").alias("baseline_disposition"), F.when(bal > 8000, "probable_sme").otherwise("unknown").alias("sme_status"))
    found = M.pilot_metrics(rows, table(spark, d, "part").select("p_brand").distinct())
    return found.select("reviewed", "strict", "net_new", "probable_sme", "denominator", *[F.round(c, 9).alias(c) for c in ("precision", "low", "lift")], "count_gate", "bound_gate")


@query("quote_categories", "WITH q AS (SELECT quality, CASE WHEN source = 'src0' THEN substr(text, 11, 30) WHEN source = 'src1' THEN '' ELSE 'no such quote' END AS q, text FROM documents JOIN labels USING (doc_id))\nSELECT quality, count(*) AS rows, count(*) FILTER (trim(q) <> '' AND contains(text, q)) AS literal_pass, count(*) FILTER (trim(q) = '') AS empty, count(*) FILTER (trim(q) <> '' AND NOT contains(text, q)) AS nonempty_fail FROM q GROUP BY 1")
def quote_categories(spark, d):
    quote = F.when(F.col("source") == "src0", F.substring("text", 11, 30)).when(F.col("source") == "src1", "").otherwise("no such quote")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("q", quote)
    return M.quote_categories(rows, "quality", F.col("q"), F.contains("text", F.col("q")))


_WHOLE = "SELECT *, CASE WHEN disputed <> '' THEN c_reason ELSE a_reason END AS whole_reason, CASE WHEN disputed <> '' THEN c_scale ELSE a_scale END AS whole_scale FROM m"
_ANY = "(whole_eqdp <> eqdp OR whole_reason <> reason OR whole_scale IS DISTINCT FROM scale)"


@query(
    "stage_change_counts",
    f"WITH {SQL_FINAL}, w AS ({_WHOLE}) SELECT 'primary' AS what, count(*) FILTER (whole_eqdp <> eqdp) AS n FROM w UNION ALL SELECT 'any_field', count(*) FILTER ({_ANY}) FROM w UNION ALL SELECT 'other_only', count(*) FILTER ({_ANY} AND whole_eqdp = eqdp) FROM w UNION ALL SELECT 'field_eqdp', count(*) FILTER (whole_eqdp <> eqdp) FROM w UNION ALL SELECT 'field_reason', count(*) FILTER (whole_reason <> reason) FROM w UNION ALL SELECT 'field_scale', count(*) FILTER (whole_scale IS DISTINCT FROM scale) FROM w",
)
def stage_change_counts(spark, d):
    return M.stage_changes(_final(spark, d), "eqdp", FIELDS)


_OVER = "disputed <> '' AND NOT d1 AND c_eqdp <> a_eqdp"


@query("overwrite_transitions", f"WITH {SQL_FINAL}, l AS (SELECT unnest(['yes', 'no', 'unclear']) AS x) SELECT p.x AS \"from\", q.x AS \"to\", (SELECT count(*) FROM m WHERE {_OVER} AND a_eqdp = p.x AND c_eqdp = q.x) AS n FROM l p, l q")
def overwrite_transitions(spark, d):
    return M.overwrite_transitions(_final(spark, d), "eqdp", K.LABELS)


@query("overwrite_triggers", f"WITH {SQL_FINAL} SELECT 'reason' AS what, count(*) FILTER ({_OVER} AND d2) AS n FROM m UNION ALL SELECT 'scale', count(*) FILTER ({_OVER} AND d3) FROM m")
def overwrite_triggers(spark, d):
    return M.overwrite_triggers(_final(spark, d), "eqdp", FIELDS)


@query("label_counts", f"WITH {SQL_FINAL} SELECT l.what, (SELECT count(*) FROM m WHERE eqdp = l.what) AS n FROM (SELECT unnest(['yes', 'no', 'unclear']) AS what) l")
def label_counts(spark, d):
    return M.label_counts(_final(spark, d), "eqdp")


_ATTEMPTS = "SELECT conv_id, bool_and(length(text) < 3000) AS ok FROM conversations GROUP BY 1 HAVING count(*) > 2"


@query(
    "row_accounting",
    f"WITH a AS ({_ATTEMPTS}), s AS (SELECT CASE WHEN ok IS NULL THEN 'not_attempted' WHEN ok AND role = 'user' THEN 'omitted' WHEN NOT ok AND role = 'user' THEN 'failed' WHEN length(text) > 100 THEN 'valid' ELSE 'invalid' END AS status FROM conversations LEFT JOIN a USING (conv_id)) SELECT l.status, (SELECT count(*) FROM s WHERE s.status = l.status) AS n FROM (SELECT unnest(['valid', 'invalid', 'omitted', 'failed', 'not_attempted']) AS status) l",
)
def row_accounting(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("key"), "role", F.length("text").alias("n"))
    attempted = turns.groupBy("conv_id").agg(F.bool_and(F.col("n") < 3000).alias("ok"), F.count(F.lit(1)).alias("k")).filter("k > 2")
    returned = turns.join(attempted, "conv_id", "left_semi").filter("role <> 'user'").select("key", (F.col("n") > 100).alias("valid"))
    return M.row_accounting(turns, attempted, returned, "key", "conv_id")


@query("coverage_by_label", "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS \"none\" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_by_label(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("none")
    return M.coverage_by_label(rows.withColumn("status", status), "lang", "status", ["good", "bad", "none"])


@query("map_sums", "SELECT 'k' AS key, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def map_sums(spark, d):
    usage = F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("long"), F.col("event_type"), F.lit(1).cast("long"))
    return M.map_sum(table(spark, d, "events").select(usage.alias("usage")), "usage")


@query("fetch_counts", "SELECT l_suppkey, count(DISTINCT l_partkey) AS linked, count(DISTINCT l_partkey) FILTER (p_size BETWEEN 10 AND 30) AS succeeded FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def fetch_counts(spark, d):
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size").between(10, 30), 204).otherwise(503).alias("http_status"))
    return M.fetch_counts(table(spark, d, "lineitem"), pages, "l_suppkey", "l_partkey")


@query("retry_counts", "SELECT count(*) AS batches, count(*) FILTER (value > 50) AS retried FROM events")
def retry_counts(spark, d):
    return M.retries(table(spark, d, "events").select(F.when(F.col("value") > 50, 3).when(F.col("value") > 20, 1).alias("attempt")))


@query("size_summary", f"SELECT * FROM (SELECT 'supported' AS what, count(*) FILTER (s <> 'insufficient') AS n FROM ({_SIZED}) UNION ALL SELECT 'numerical', count(*) FILTER (s IN ({_sql_list(K.SIZE_STATUSES[:4])})) FROM ({_SIZED}) UNION ALL SELECT 'finite_upper', count(hi) FROM ({_SIZED}) UNION ALL SELECT 'owner_only', count(*) FILTER (q = '') FROM ({_SIZED}) UNION ALL SELECT 'federal', 0 FROM region WHERE r_regionkey = 0)")
def size_summary(spark, d):
    t, n = F.col("p_type"), F.col("p_size")
    status = F.when(t == "ECONOMY", "exact_employee_count").when(t == "STANDARD", "employee_range").when(t == "PROMO", "employee_lower_bound").when(n > 40, "guess").otherwise("insufficient")
    return M.size_summary(table(spark, d, "part").select(status.alias("size_evidence_status"), F.when(n > 10, 20).alias("employee_upper"), (n <= 3).alias("owner_only_supported"), F.lit(False).alias("sba_status_supported")))


# --- entities -------------------------------------------------------------------------------------

_ROWS = "SELECT p_brand || '-' || p_size AS domain, lower(p_type) AS name, p_name AS state, CASE WHEN p_size > 25 THEN 'dedicated_business_domain' ELSE 'directory' END AS visibility FROM part"


@query(
    "entity_bounds",
    f"WITH r AS ({_ROWS}), g AS (SELECT domain, count(DISTINCT (name, state)) AS pairs, bool_and(visibility = 'dedicated_business_domain') AS own, count(DISTINCT name) AS k FROM r GROUP BY 1) SELECT sum(CASE WHEN own THEN 1 ELSE pairs END)::BIGINT AS lower, sum(CASE WHEN own AND k = 1 THEN 1 ELSE pairs END)::BIGINT AS conservative, sum(pairs)::BIGINT AS upper, greatest(1, sum(pairs) - 40)::BIGINT AS least FROM g",
)
def entity_bounds(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("domain"), N.name_key(F.col("p_type"), "forms").alias("name"), F.col("p_name").alias("state"), F.when(F.col("p_size") > 25, "dedicated_business_domain").otherwise("directory").alias("visibility"))
    clusters = E.name_clusters(rows.filter("name <> ''"), "domain", "name", text.alias_udf(6, 0.91, True))
    least, most = E.sensitivity(F.col("upper"), F.lit(40))
    return E.entity_bounds(rows, clusters).select("lower", "conservative", most.alias("upper"), least.alias("least"))


_UNITS = "SELECT s_suppkey AS unit, 'd' || s_nationkey AS domain, p_type AS name, l_returnflag AS state FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49"


@query(
    "exact_name_edges",
    f"WITH u AS (SELECT DISTINCT * FROM ({_UNITS})), n AS (SELECT DISTINCT unit, domain, name FROM u), s AS (SELECT DISTINCT unit, state FROM u), k AS (SELECT unit, domain, name, state FROM n JOIN s USING (unit)), i AS (SELECT name, state, min(unit) AS first FROM k GROUP BY 1, 2 HAVING count(DISTINCT domain) > 1) SELECT DISTINCT first, unit AS other, name, state FROM k JOIN i USING (name, state) WHERE unit <> first",
)
def exact_name_edges(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity >= 49").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    units = rows.groupBy(F.col("s_suppkey").alias("unit"), F.concat(F.lit("d"), "s_nationkey").alias("domain")).agg(F.collect_set("p_type").alias("names"), F.collect_set("l_returnflag").alias("states"))
    return E.exact_edges(units)


@query(
    "entity_decisions",
    "WITH g AS (SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '+' ORDER BY c_mktsegment) AS names FROM customer GROUP BY 1)\nSELECT 'd' || c_nationkey || '#0' AS unit, 'd' || c_nationkey AS domain, names, 'd' || c_nationkey AS corporate FROM g WHERE c_nationkey >= 10 UNION ALL SELECT 'd' || c_nationkey || '#' || k, 'd' || c_nationkey, string_split(names, '+')[k + 1], CASE WHEN c_nationkey < 5 THEN 'd' || c_nationkey || '#' || k ELSE 'd' || c_nationkey END FROM (SELECT *, unnest(range(len(string_split(names, '+')))) AS k FROM g WHERE c_nationkey < 10)",
)
def entity_decisions(spark, d):
    domains = table(spark, d, "customer").groupBy(F.concat(F.lit("d"), "c_nationkey").alias("domain"), "c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("names"))
    decisions = domains.filter("c_nationkey < 10").select("domain", F.when(F.col("c_nationkey") < 5, "separate_entities").otherwise("single_corporate_multiple_operating_entities").alias("decision"), F.transform("names", lambda n: F.array(n)).alias("groups"))
    return E.apply_decisions(domains.drop("c_nationkey"), decisions).select("unit", "domain", F.array_join("names", "+").alias("names"), "corporate")


@query("alias_decision_edges", "WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unclear' END AS a, CASE WHEN o_totalprice > 400000 THEN 'yes' WHEN o_totalprice > 200000 THEN 'unclear' ELSE 'no' END AS b FROM orders)\nSELECT o_orderkey, CASE WHEN a = 'yes' THEN 'both' WHEN b = 'yes' THEN 'corporate' WHEN a = 'unclear' OR b = 'unclear' THEN 'unresolved' ELSE 'none' END AS edge FROM p")
def alias_decision_edges(spark, d):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    same = F.when(status == "F", "yes").when(status == "O", "no").otherwise("unclear")
    corporate = F.when(price > 400000, "yes").when(price > 200000, "unclear").otherwise("no")
    return E.decision_edges(table(spark, d, "orders").select("o_orderkey", same.alias("same_operating"), corporate.alias("same_corporate"))).select("o_orderkey", "edge")


@query("entity_contexts", "SELECT source AS entity, sha256(text) AS sha256, lang AS context, min(doc_id) AS review_id FROM documents GROUP BY ALL")
def entity_contexts(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "review_id")
    contexts = docs.select("review_id", F.sha2("text", 256).alias("sha256"), F.col("lang").alias("context"))
    return E.entity_contexts(docs.select("review_id", F.col("source").alias("entity")), contexts)


@query("baseline_ids", "WITH b AS (SELECT lower(p_name) AS key, max(p_partkey) AS base FROM part GROUP BY 1) SELECT c_custkey AS id, coalesce(base::VARCHAR, '') AS base FROM customer LEFT JOIN b ON key = CASE WHEN c_acctbal > 0 THEN 'red widget' ELSE lower(c_mktsegment) END")
def baseline_ids(spark, d):
    baseline = table(spark, d, "part").select(N.name_key(F.col("p_name")).alias("key"), F.col("p_partkey").cast("string").alias("base"), F.col("p_partkey").alias("pos"))
    name = F.when(F.col("c_acctbal") > 0, "Red Widget, Inc.").otherwise(F.col("c_mktsegment"))
    return E.baseline_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.name_key(name).alias("key")), baseline)


_RAW = "SELECT s_name, p_type, p_brand, l_returnflag, n_name, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"
_COMPANY = "'company-' || substr(sha256(lower(s_name)), 1, 20)"
_FACILITY = f"'facility-' || substr(sha256({_COMPANY} || '|' || lower(n_name) || '|' || n_name || '||' || CASE WHEN s_nationkey <> 0 THEN s_nationkey::VARCHAR ELSE '' END), 1, 20)"


def _records(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = rows.select(F.concat(F.lit(" "), "s_name").alias("name"), F.array("p_type", F.lit("")).alias("company_type"), F.col("n_name").alias("city"), F.lit("").alias("state_clone"), F.col("n_name").alias("state"), F.lit(None).cast("int").alias("lat"), F.col("s_nationkey").alias("lon"), F.array("p_brand").alias("company_activity"), F.array("l_returnflag").alias("announcement_type"))
    return E.canonical_records(raw)


@query("facility_merge", f"SELECT {_FACILITY} AS facility_id, any_value({_COMPANY}) AS company_id, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS activities, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS announcements, count(DISTINCT (p_type, p_brand, l_returnflag)) AS records FROM ({_RAW}) GROUP BY 1")
def facility_merge(spark, d):
    joined = [F.array_join(c, "|").alias(c) for c in E.SETS]
    return E.facilities(_records(spark, d)).select("facility_id", "company_id", *joined, "records")


@query("supplier_scope", f"SELECT company_id, count(*) AS sites, count(*) FILTER (made) AS manufacturing_sites FROM (SELECT {_COMPANY} AS company_id, {_FACILITY} AS f, bool_or(p_brand = 'Brand#2') AS made, bool_or(p_type IN ('ECONOMY', 'PROMO')) AS wanted FROM ({_RAW}) GROUP BY 1, 2) GROUP BY 1 HAVING bool_or(wanted)")
def supplier_scope(spark, d):
    records = _records(spark, d)
    return E.suppliers(records, E.facilities(records), ("ECONOMY", "PROMO"), "Brand#2")


# --- order, attempts, resuming --------------------------------------------------------------------


@query("attempt_numbers", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error'")
def attempt_numbers(spark, d):
    attempts = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", F.row_number().over(attempts).cast("long").alias("attempt"))


@query("resume_window", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 1500) ORDER BY conv_id, turn LIMIT 50")
def resume_window(spark, d):
    """The next rows to send: those not done, the first 50 in order. The limit is the feature."""
    turns = table(spark, d, "conversations")
    done = turns.filter(F.length("text") > 1500).select("conv_id").distinct()
    return R.not_done(turns, done, ["conv_id"]).orderBy("conv_id", "turn").limit(50).select("conv_id", "turn")


@query("seeded_shuffle", "SELECT c_custkey, sha256('7|' || c_custkey) AS place FROM customer ORDER BY place, c_custkey")
def seeded_shuffle(spark, d):
    return R.shuffled(table(spark, d, "customer").select("c_custkey"), 7, "c_custkey")


@query("batch_shuffle", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY sha256((20260801 + conv_id) || '|' || turn), turn) AS place FROM conversations")
def batch_shuffle(spark, d):
    return R.shuffled_batches(table(spark, d, "conversations").select("conv_id", "turn"), 20260801, "conv_id", "turn")


@query("ordered_rows", "SELECT s_suppkey, lower(s_name) AS name FROM supplier ORDER BY lower(s_name), s_suppkey")
def ordered_rows(spark, d):
    """Sorted by a key in one case, then a second key."""
    return table(spark, d, "supplier").select("s_suppkey", F.lower("s_name").alias("name")).orderBy("name", "s_suppkey")
