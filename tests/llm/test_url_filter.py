import duckdb

from tabloom.llm import queries
from tabloom.llm.url_filter import url_filter


def test_longest_rule_wins(spark):
    urls = ["http://A.Example.COM/en/7/x?q", "http://example.com/en/8", "http://notexample.net/de/8", "x://b.example.net/de/80#f", "mailto:a", None, "", "http://com/en/", "http://org"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df, queries.RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("net/de/", "block") and got[3][2:] == ("example.net/de/8", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == ("com/en/", "block") and got[8] == ("org", "", None, "allow")
    assert url_filter(df.limit(0), queries.RULES).count() == 0


def test_words_of_the_contract(spark):
    """Each rule of the contract with its own word; the query judges by these."""
    assert queries.RULES == [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = ["http://a.com/en/1", "http://example.com/en/70", "http://a.net/de/8", "http://b.example.net/de/81", "http://example.net/de/7", "http://org/es/", "http://org/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.rule, r.verdict) for r in url_filter(df, queries.RULES).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]


def test_many_ends_and_long_urls(spark):
    """Thousands of partial ends under one host, and urls of a megabyte: the longest end wins."""
    rules = [("block", "a.com", f"/p{i}") for i in range(3000)] + [("allow", "a.com", "/p12/x"), ("allow", "a.com", "/p12/x/yy"), ("block", "com", "")]
    long = "http://a.com/p12/x/yyz/" + "s/" * 500_000
    df = spark.createDataFrame([(1, "http://a.com/p1234567"), (2, long), (3, "http://a.com/p12/xq"), (4, "http://b." + "c." * 5000 + "com/q"), (5, "http://a.com/q")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(df, rules).collect()}
    assert got == {1: ("a.com/p1234", "block"), 2: ("a.com/p12/x/yy", "allow"), 3: ("a.com/p12/x", "allow"), 4: ("com", "block"), 5: ("com", "block")}


def test_queries_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df, rel = queries.QUERIES[name](spark, sf_dir), con.sql(sql)
        assert df.columns == rel.columns
        assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)
