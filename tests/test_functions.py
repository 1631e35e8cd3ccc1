import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import names, pages, stats, text, values
from attesta.operators import entities
from attesta.operators import relational as R
from attesta.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.COM/a/?utm_source=x&id=2#part", "https://example.com/a?id=2"),
        ("http://user:pw@example.com:443//a//b/", "http://example.com/a/b"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("http://example.com/?a=&b=1&GCLID=2", "http://example.com/?a=&b=1"),
        ("ftp://example.com/a", ""),
        ("mailto:x", ""),
    ],
)
def test_canonical_url(spark, url, expected):
    assert one(spark, text.canonical_url(F.lit(url))) == expected


def test_domains_and_names(spark):
    assert one(spark, text.registrable_domain(F.lit("www.example.com"))) == "example.com"
    assert one(spark, text.registrable_domain(F.lit("a.example.co.uk"))) == "example.co.uk"
    assert one(spark, text.normalize_name(F.lit("GPR Company, Inc."))) == "gpr"
    assert one(spark, text.normalize_name(F.lit("Applied Materials, Inc."))) == "applied materials"
    assert one(spark, text.token_jaccard(text.token_set(F.lit("Acme Steel Group")), text.token_set(F.lit("Acme Works")))) == pytest.approx(1 / 3)


def test_booleans_fail_closed(spark):
    assert one(spark, text.parse_bool(F.lit(" True "))) is True
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, text.parse_bool(F.lit("pending")))


def test_wilson(spark):
    low, high = stats.wilson(F.lit(29), F.lit(75))
    assert one(spark, low) == pytest.approx(0.285, abs=1e-3)
    assert one(spark, high) == pytest.approx(0.500, abs=1e-3)
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0, 0)


def test_kappa(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b")], "x string, y string")
    assert stats.kappa(same, "x", "y").first()["kappa"] == 1.0
    sure = spark.createDataFrame([("a", "a")], "x string, y string")
    assert stats.kappa(sure, "x", "y", None).first()["kappa"] is None
    mixed = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, None)], "x string, y string")
    assert stats.kappa(mixed, "x", "y").first()["agreed"] == 3


def test_fieldwise_locks_agreed_fields(spark):
    rows = spark.sql("select named_struct('e','yes','s','1') a, named_struct('e','no','s','1') b, named_struct('e','no','s','2') c")
    found = rows.select(*R.fieldwise("a", "b", "c", ["e", "s"]), R.disputed("a", "b", ["e", "s"]).alias("d")).first()
    assert (found["e"], found["s"], found["d"]) == ("no", "1", ["e"])


def test_largest_remainder(spark):
    strata = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "name string, size long")
    found = {r["name"]: r["allocation"] for r in R.largest_remainder(strata, "name", "size", 7).collect()}
    assert sum(found.values()) == 7
    assert found == {"a": 4, "b": 2, "c": 1}


def test_pooled_and_macro(spark):
    rows = spark.createDataFrame([("q1", "u1", "A"), ("q1", "u1", "B"), *[("q2", f"v{i}", "A") for i in range(9)], ("q2", "v0", "B"), *[("q3", f"w{i}", "B") for i in range(4)]], "q string, u string, p string")
    found = R.set_overlap(rows, ["q"], "u", F.col("p") == "A", F.col("p") == "B").agg(F.sum("n_both"), F.sum("n_either"), F.avg("jaccard")).first()
    assert (found[0], found[1]) == (2, 14)
    assert found[2] == pytest.approx(10 / 27)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)], "a long, b long")
    found = {r["v"]: r["label"] for r in R.components(edges, "a", "b").collect()}
    assert {found[i] for i in range(1, 31)} == {1}
    assert found[51] == 50 and found[60] == 60


def test_upsert_and_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in R.last_wins(old.union(new).withColumn("t", F.col("v")), ["k"], ["t"]).select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_pages():
    page = pages.read_page("<title>Acme | Home</title><meta property='og:site_name' content='Acme'><script>hidden()</script><nav>menu</nav><p>We make  parts</p>")
    assert " ".join(page.title) == "Acme | Home"
    assert page.meta == {"og:site_name": "Acme"}
    assert "hidden" not in " ".join(page.text)
    assert "menu" not in " ".join(pages.read_page("<nav>menu</nav><p>parts</p>", True).text)


def test_windows():
    body = "x" * 5000 + " lithography " + "y" * 5000
    found = pages.keyword_window(body, ["lithography"], 900)
    assert "lithography" in found and len(found.replace(pages.BREAK, "")) <= 900
    assert pages.keyword_window("", ["a"]) == ""
    assert pages.size_window("nothing here") == ""
    assert "12 employees" in pages.size_window("We have 12 employees")
    assert pages.pilot_windows("a wafer") == ["a wafer"]
    assert pages.merge_spans([(0, 10), (50, 60), (300, 310)], 100) == [(0, 60), (300, 310)]


def test_cookie_text(spark):
    found = one(spark, pages.without_cookies(F.lit("We use cookies to improve. Products machined parts")))
    assert "cookies" not in found and "machined parts" in found


def test_scanned_array():
    assert files.scan_array('<script>var rows = [{"n": "A ] Co"}, [1]];</script>', "rows") == '[{"n": "A ] Co"}, [1]]'
    for broken in ("var other = 1", 'var rows = [{"n": "]"}'):
        with pytest.raises(ValueError):
            files.scan_array(broken, "rows")


def test_clean_and_quotes(spark):
    rows = spark.createDataFrame([("A &amp;  B ",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.clean("t")).collect()] == ["A & B", None]
    quotes = spark.createDataFrame([("“Made in–house…”",)], "t string")
    assert quotes.select(text.quote_key("t")).first()[0] == "made in-house..."


def test_alias(spark):
    alias = text.alias_udf(5, 0.88, False)
    rows = spark.createDataFrame([("acme steel", "acme steel works"), ("abc", "abd"), ("", "x")], "a string, b string")
    assert [r[0] for r in rows.select(alias("a", "b")).collect()] == [True, False, False]


@pytest.mark.parametrize("most", [20_000, 3])
def test_contained_at_every_size(spark, monkeypatch, most):
    """Short quotes, and ones inside words or after tabs and brackets, are found in one part of the quotes and in many."""
    monkeypatch.setattr(pages, "MOST_QUOTES", most)
    texts = [(1, "a [quoted] passage\tafter a tab"), (2, "inside unquotedwords"), (3, None), (4, ""), (5, "x" * 60 + "(" + "y" * 50)]
    quotes = [(1, "quoted"), (2, "after"), (3, "a"), (4, "y" * 45), (5, ""), (6, None), (7, "absent"), (7, "tab"), (7, "passage"), (8, "quoted"), (9, "x" * 41)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = pages.contained(docs, spark.createDataFrame(quotes, "item_id long, quote string"))
    assert sorted(map(tuple, found.collect())) == sorted((k, d) for k, q in quotes if q for d, t in texts if q in (t or ""))


def test_best_match(spark):
    names = [(1, "Acme Steel, Inc."), (2, "red blue green gray extra"), (3, "red blue"), (4, "unknown"), (5, None), (6, ""), (7, "steel acme")]
    baseline = [("B9", "acme STEEL", 5), ("B1", "Acme-Steel", 3), ("B2", "red blue green gray", 1), ("B3", "gray green blue red", 2), ("B4", "", 0)]
    frame = spark.createDataFrame(names, "id long, name string")
    found = {r["id"]: tuple(r)[1:] for r in R.best_match(frame, spark.createDataFrame(baseline, "base string, name string, pos long")).collect()}
    none = ("", "", 0.0)
    # an exact name beats order of words; of equal ratios the first; below 0.80 only the score stays
    assert found == {1: ("B1", "exact_normalized_name", 1.0), 2: ("B2", "token_jaccard_review", 0.8), 3: ("", "", 0.5), 4: none, 5: none, 6: none, 7: ("B1", "token_jaccard_review", 1.0)}


def test_stratified_bootstrap_weighs_strata(spark):
    strata = {"a": (30.0, 30, 10), "b": (0.5, 300, 290), None: (4.0, 50, 20)}
    rows = [(s, w, k < yes) for s, (w, n, yes) in strata.items() for k in range(n)] + [("b", 0.5, None)]
    strata["b"] = (0.5, 301, 290)
    frame = spark.createDataFrame(rows, "s string, w double, y boolean").repartition(3)
    found = stats.stratified_bootstrap(frame, "s", "y", "w").first()
    whole = sum(w * n for w, n, _ in strata.values())
    rate = sum(w * yes for w, _, yes in strata.values()) / whole
    spread = sum((w * n / whole) ** 2 * (yes / n) * (1 - yes / n) / n for w, n, yes in strata.values()) ** 0.5
    assert found["replicates"] == 10_000 and found["rate"] == pytest.approx(rate)
    assert found["low"] == pytest.approx(rate - 1.96 * spread, abs=0.02) and found["high"] == pytest.approx(rate + 1.96 * spread, abs=0.02)
    assert stats.stratified_bootstrap(frame, "s", "y", "w").first() == found
    # weights that differ within a stratum, against drawing row by row
    rng = np.random.default_rng(5)
    w, y = np.array([1.0] * 20 + [9.0] * 20), np.array([True, False] * 10 + [True] * 15 + [False] * 5)
    drawn = rng.integers(0, 40, (4000, 40))
    brute = np.sort((w[drawn] * y[drawn]).sum(1) / w[drawn].sum(1))
    other = stats.stratified_bootstrap(spark.createDataFrame([("x", float(a), bool(b)) for a, b in zip(w, y, strict=True)], "s string, w double, y boolean"), "s", "y", "w", 4000).first()
    assert other["low"] == pytest.approx(brute[99], abs=0.02) and other["high"] == pytest.approx(brute[3899], abs=0.02)
    assert stats.stratified_bootstrap(frame.limit(0), "s", "y", "w").count() == 0


def test_name_keys(spark):
    key = lambda x, v: one(spark, names.name_key(F.lit(x), v))
    assert key("Smith &amp; Sons, Inc.", "plain") == "smith sons"
    assert key("Straße GmbH", "plain") == "strasse gmbh"
    assert key("Acme Group LLC", "plain") == "acme group" and key("Acme Group LLC", "group") == "acme"
    assert key("Acme (West) L.L.C. Mfg", "expanded") == "acme manufacturing"
    assert key("Acme (West) L.L.C. Mfg", "forms") == "acme mfg"
    assert one(spark, text.acronym(F.lit("The Gas Products Research Co."))) == "gpr"


def test_candidate_names(spark):
    name = lambda s, t: one(spark, names.candidate_name(F.lit(s), F.lit(t), F.lit("acme-tools.com")))
    assert name("Acme | Home", "x") == "Acme"
    assert name("Home", "Acme Tools — Parts") == "Acme Tools"
    assert name(None, "x") == "Acme Tools" and name("A-B Co", "") == "A-B Co"


def test_canonical_urls(spark):
    url = lambda x: one(spark, text.canonical_url(F.lit(x)))
    assert url(" https://a.com/x ") == "https://a.com/x"
    assert url("https://a.com/x?q=a%20b&flag") == "https://a.com/x?q=a+b&flag="
    assert url("HTTP://u:p@A.com:80//x//y/?UTM_source=1&b=%7E*&a=#f") == "http://a.com/x/y?b=~%2A&a="
    assert url("ftp://a.com") == "" and url("https://a.com?q=%zz") == "https://a.com/?q=%25zz"


def test_values(spark):
    assert one(spark, values.json_body(F.lit("```json\n{\"a\": 1}\n```"))) == '{"a": 1}'
    assert one(spark, values.json_body(F.lit("not json"))) is None
    assert one(spark, values.forbidden_keys(F.lit('{"A":[{"Review_Id":1}],"b":"\\"rationale\\": x"}'), ["review_id", "rationale"])) == ["review_id"]
    assert one(spark, values.redacted(F.lit("key abc"), ["abc"])) == "key [REDACTED]"
    assert one(spark, values.in_page_json(F.lit('"</script>"'))) == '"\\u003c/script>"'
    reason = lambda status, said, kind=None: one(spark, values.retry_reason(F.lit(status), F.lit(said), F.lit(kind).cast("string")))
    assert reason(503, "busy") == "temporary_http_503" and reason(None, "API error: 429 slow") == "temporary_http_429"
    assert reason(503, "Quota exceeded") is None and reason(401, "connection reset") is None
    assert reason(None, "ECONNRESET") == "temporary_connection_error" and reason(None, "", "TimeoutError") == "transport_TimeoutError"
    assert reason(None, "", "ValueError") is None


def test_page_titles_and_meta():
    page = pages.read_page('<meta name="a" content="x"><meta name="a"><svg><title>In  svg</title>hidden</svg><p>seen</p>')
    assert page.meta == {"a": "x"} and page.title == ["In svg"] and page.text == ["seen"]


def test_alias_candidates_miss_no_alias(spark):
    import itertools
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = ["acme tools", "general gas products", "vacuum pumps west", "abc", "ggp", "precision machine works of ohio"]
    every = set(base)
    for name in base * 12:
        letters = list(name)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["q", " "]])
        every.add("".join(letters).strip())
    every.discard("")
    initials = lambda n: "".join(w[0] for w in n.split() if w not in ("the", "and", "of"))
    same = lambda a, b: min(len(a), len(b)) >= 6 and (a in b or b in a) or initials(a) == b.replace(" ", "") or initials(b) == a.replace(" ", "") or SequenceMatcher(None, a, b).ratio() >= 0.91
    expected = {(a, b) for a, b in itertools.combinations(sorted(every), 2) if same(a, b) or same(b, a)}
    found = {(r["a"], r["b"]) for r in entities.alias_candidates(spark.createDataFrame([(1, n) for n in every], "k int, n string"), "k", "n", 0.91).collect()}
    assert expected <= found


def test_numbered_names_meet_only_if_close(spark):
    """Names that share all but a few digits: the candidates are the pairs with 16 of 18 characters in common, not all of the block."""
    import itertools

    block = [f"supplier {n:09d}" for n in range(0, 60000, 401)]
    frame = spark.createDataFrame([(1, n) for n in block], "k int, n string")
    pairs = list(itertools.combinations(block, 2))
    common = text.common_lengths([a for a, _ in pairs], [b for _, b in pairs])
    found = entities.alias_candidates(frame, "k", "n", 0.88).select("a", "b").collect()
    assert sorted(map(tuple, found)) == sorted(p for p, n in zip(pairs, common, strict=True) if n >= 16)


def test_common_lengths():
    import random

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    a, b = [["".join(rng.choices("ab \0é𐍈", k=rng.randint(0, 70))) for _ in range(400)] for _ in "ab"]
    found = text.common_lengths(a, b).tolist()
    assert found == [brute(x, y) if max(len(x), len(y)) < 64 else min(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    assert text.common_lengths([], []).size == 0


@pytest.mark.parametrize("most", [300, 0])
@pytest.mark.parametrize("least_length, ratio", [(5, 0.88), (6, 0.91), (3, 0.6)])
def test_alias_edges_equal_brute_force(spark, monkeypatch, most, least_length, ratio):
    """Names of all lengths, by shared subsequences and by rare strings alone."""
    import itertools
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(entities, "MOST_SUBSEQUENCES", most)
    rng = random.Random(7)
    every = {(3, "a"), (3, ""), (3, None), (None, "abcdef"), (4, "one name"), (2, "aaaaaaaaaaaa"), (2, "aaaaaaabaaaaaa"), (2, "x" * 70), (2, "x" * 68 + "yz")}
    for k in (1, 2):
        base = ["".join(rng.choices("abc ", k=n)).strip() + "d" for n in (2, 4, 7, 9, 12, 18, 22, 27, 40)] + ["acme incorporated works of ohio number 17"]
        for name in base * 6:
            letters = list(name)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["b"]])
            every.add((k, "".join(letters) + rng.choice(["", "", " tail of it"])))
    ratio_of = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    held = sorted(x for x in every if x[0] and x[1])
    expected = {(k, a, b) for (k, a), (j, b) in itertools.combinations(held, 2) if k == j and (min(len(a), len(b)) >= least_length and (a in b or b in a) or ratio_of(a, b) >= ratio)}
    frame = spark.createDataFrame(list(every) * 2, "k int, n string")
    found = entities.alias_edges(frame, "k", "n", text.alias_udf(least_length, ratio, False), least_length, ratio)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate")  # each pair is judged once, after the distinct
