import datetime

from unitloom.llm import urls

DAY = lambda n: datetime.date(2024, 1, n)


def test_verdicts_follow_the_list_of_the_day(spark):
    entries = spark.createDataFrame(
        [("example.com", DAY(2), "block", "a"), ("example.com", DAY(10), "remove", "a"), ("good.example.com", DAY(3), "allow", "b"), ("example.com/bad", DAY(4), "block", "c"), ("X.org", DAY(1), "allow", "t"), ("x.org", DAY(1), "block", "t"), (None, DAY(1), "block", "n"), ("y.org", None, "block", "n"), ("z.org", DAY(1), "odd", "n")],
        "key string, at date, action string, category string",
    )
    asked = [
        ("http://example.com/a", DAY(1), False, None), ("http://example.com/a", DAY(2), True, "example.com"), ("http://example.com/a", DAY(10), False, None), ("https://u:p@Good.Example.com:8080/x", DAY(5), False, "good.example.com"),
        ("http://good.example.com/bad/x", DAY(5), False, "good.example.com"), ("http://www.example.com/bad/x?y#z", DAY(11), True, "example.com/bad"), ("http://x.org./", DAY(1), True, "x.org"), ("not a url", DAY(5), False, None), (None, DAY(5), False, None), ("http://example.com/a", None, False, None), ("http://example.com/a", DAY(2), True, "example.com"),
    ]
    frame = spark.createDataFrame([(u, d, i, "k", True) for i, (u, d, *_) in enumerate(asked)], "url string, fetched date, n long, key string, blocked boolean")
    out = {r["n"]: (r["b"], r["rule"]) for r in urls.evaluate(frame, entries).selectExpr("row.n", "blocked as b", "rule").collect()}
    assert out == {i: (b, rule) for i, (_, _, b, rule) in enumerate(asked)}
    assert urls.evaluate(frame.limit(0), entries).collect() == []
    assert not any(r["blocked"] for r in urls.evaluate(frame, entries.limit(0)).collect())


def test_entries_of_any_depth_and_case(spark):
    keys = ["example.com/a/b", "example.com/page.html", "Example.com/Ads", "example.com/dir/"]
    entries = spark.createDataFrame([(k, DAY(1), "block", "c") for k in keys], "key string, at date, action string, category string")
    asked = [
        ("http://example.com/a/b/c.html", "example.com/a/b"), ("http://www.example.com/a/b", "example.com/a/b"), ("http://example.com/a/bc", None), ("http://example.com/a", None),
        ("http://example.com/page.html?x=1", "example.com/page.html"), ("http://EXAMPLE.com/Ads/1", "example.com/Ads"), ("http://example.com/ads/1", None), ("http://example.com/dir", "example.com/dir"), ("http://example.com/dir/x/y", "example.com/dir"),
    ]
    frame = spark.createDataFrame([(u, DAY(2)) for u, _ in asked], "url string, fetched date")
    assert {r["url"]: (r["blocked"], r["rule"]) for r in urls.evaluate(frame, entries).selectExpr("row.url", "blocked", "rule").collect()} == {u: (rule is not None, rule) for u, rule in asked}
