from datetime import datetime

from lodestrata.llm import urlfilter


def day(d):
    return datetime(2024, 1, d)


def test_verdicts_at_fetch_time(spark):
    log = [("example.com", True, day(3), 0), ("example.com", False, day(6), 0), ("example.com", True, day(9), 0), ("a.example.com/x", True, day(1), 0), ("same.org", True, day(2), 0), ("same.org", False, day(2), 1), (None, True, day(1), 0), ("example.com", True, day(3), 0)]
    pages = [
        (1, "http://a.example.com/y", day(2), None),
        (2, "http://user@A.Example.com.:80/y?q#f", day(3), "example.com"),
        (3, "http://a.example.com/y", day(6), None),
        (4, "https://a.example.com/x/z", day(7), "a.example.com/x"),
        (5, "https://a.example.com/xz", day(10), "example.com"),
        (6, None, day(4), None),
        (7, "no url", day(4), None),
        (8, "http://same.org", day(5), None),
        (9, "http://b.example.com", None, None),
        (None, "http://example.com", day(4), "example.com"),
    ]
    rows = pages + [pages[1]] + [(1000 + k, "http://hot.example.com/", day(4), "example.com") for k in range(300)]
    c = spark.createDataFrame([(i, u, t, "e") for i, u, t, _ in rows], "page_id long, url string, fetched timestamp, entry string")
    got = urlfilter.verdicts(c, spark.createDataFrame(log, "entry string, listed boolean, dated timestamp, seq int")).collect()
    assert len(got) == len(rows)
    want = {i: e for i, _, _, e in rows}
    assert all(r.entry == want[r.page_id] and r.blocked == (r.entry is not None) for r in got)
    assert sum(r.page_id == 2 for r in got) == 2
    assert urlfilter.verdicts(c.where("false"), spark.createDataFrame(log, "entry string, listed boolean, dated timestamp, seq int")).count() == 0


def test_what_is_asked_for(spark):
    urls = {"http://1.2.3.4/a": ["1.2.3.4", "1.2.3.4/a"], "http://[2001:db8::1]:80/": ["[2001:db8::1]"], "http://x.a.co.uk": ["x.a.co.uk", "a.co.uk"], "http://b.a.de/": ["b.a.de", "a.de"], "http://co.uk": ["co.uk"], "http://localhost": ["localhost"]}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host = urlfilter.host_of(df["url"])
    got = df.select("url", urlfilter.requests(host, urlfilter.path_of(df["url"])).alias("asked")).collect()
    assert {r.url: r.asked for r in got} == urls
