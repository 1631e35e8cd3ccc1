import os

import duckdb
import pytest

from attesta.plans import evidence, queries  # noqa: F401  register
from attesta.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    return sorted(tuple("<null>" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns) > 1
        return
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = con.sql(registry.ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_titles_equal_sql_on_odd_pages(spark, tmp_path):
    """References cut off, doubled or unknown, white space of every kind, titles that are none, and no page at all."""
    titles = ["and&amp", "a &amp;amp; b &amp;lt;", "&lt;b&gt; &quot;q&quot; &#x27;s&#x27;", "&copy; &nbsp; &#39;", "&#x27", " a \t\n\r\f b\x0b ", "\u00a0a\u3000", "a\x0b\n", "a\u2028", "", " \n"]
    pages = [f"<title>{t}</title>" for t in titles]
    pages += [None, "", "no title", "<TITLE>a</TITLE>", "<title lang='en'>a</title>", "<title>a<b>c</b></title><title>d</title>", "<title></title><title>e</title>", "<title>f", "<script>'<title>g</title>'</script><title>h</title>"]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    expected = dict(con.sql(registry.ORACLES["html_title_meta"]).fetchall())
    assert len(expected) == len(pages) and expected[0] == "and&amp"
    assert dict(map(tuple, registry.QUERIES["html_title_meta"](spark, str(tmp_path)).collect())) == expected


def test_alias_pairs_of_many_suppliers_of_a_name(spark, tmp_path):
    """Copies of a name are linked to its least supplier, which alone stands in the pairs; no link between different names goes."""
    names = ["Acme Steel Works", "Acme Steel Work", "Other Pumps", "Acme Steel Works", None, None]
    rows = [(k * len(names) + i, n, nation) for k in range(4) for i, n in enumerate(names) for nation in [i // 4]]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["blocked_alias_pairs"](spark, str(tmp_path)).collect()
    alike = [(0, 0, r[0]) for r in rows if r[1] == names[0] and r[0] != 0] + [(0, 1, r[0]) for r in rows if r[1] == names[1] and r[0] != 1] + [(0, 2, r[0]) for r in rows if r[1] == names[2] and r[0] != 2]
    assert sorted(map(tuple, got)) == sorted([(0, 0, 1, False), *[(*x, True) for x in alike]])
