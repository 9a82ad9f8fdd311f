"""Canonical URLs without a scheme or a host, and revisits of them."""

from pyspark.sql import functions as F

from locusframe.llm import warc


def test_urls_without_scheme_or_host(spark):
    want = {
        "https://www.Example.com/a/": "example.com/a",
        "//example.com/a?b=2&a=1": "example.com/a?a=1&b=2",
        "example.com/a#x": "example.com/a",
        "other.org/zzz": "other.org/zzz",
        "localhost:8080/x": "localhost:8080/x",
        "example.com:80": "example.com",
        "git+ssh://host/x": "host/x",
        "foo:bar": None,
        "mailto:a@b.org": None,
        "": None,
        "  ": None,
        "/path/only": None,
        "http:///x": None,
        "?q=1": None,
        None: None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").withColumn("key", warc.canonical_url(F.col("u"))).collect()
    assert {r["u"]: r["key"] for r in rows} == want


def test_revisits_without_a_host_stay_unresolved(spark):
    rows = [("a", "http://www.example.com/a", 1, 200, '"x"'), ("b", "other.org/zzz", 2, 304, '"x"'), ("c", "foo:bar", 3, 304, '"x"'), ("d", "", 4, 304, None), ("e", "example.com/a", 5, 304, '"x"'), ("f", "", 0, 200, None)]
    records = spark.createDataFrame([(i, u, t, s, e, None, None, None) for i, u, t, s, e in rows], "record_id string, url string, ts long, status int, etag string, last_modified long, digest string, headers map<string,string>")
    got = {r["record_id"]: (r["state"], r["response_id"]) for r in warc.resolve_revisits(records).collect()}
    assert got == {"a": ("response", "a"), "b": ("no_response", None), "c": ("no_url", None), "d": ("no_url", None), "e": ("resolved", "a"), "f": ("response", "f")}
