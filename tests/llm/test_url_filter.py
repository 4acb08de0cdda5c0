from __future__ import annotations

import datetime as dt

from holdfast.llm import url_filter

D = dt.date


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, fetched_at date").selectExpr("*", "url AS host", "1 AS entry", "2 AS capture")


EVENTS = [
    ("bad.com", "add", D(2024, 1, 10)), ("bad.com", "remove", D(2024, 2, 1)), ("bad.com", "add", D(2024, 3, 1)),
    ("ok.org/spam/", "add", D(2024, 1, 1)), ("bad.com/a/", "add", D(2024, 1, 1)),
    ("tie.net", "add", D(2024, 1, 1)), ("tie.net", "remove", D(2024, 1, 1)), ("bad.com", "add", D(2024, 1, 10)),
    (None, "add", D(2024, 1, 1)), ("x.com", "maybe", D(2024, 1, 1)), ("y.com", "add", None),
]


def test_captures_are_judged_as_of_their_time(spark):
    pages = [
        (1, "http://bad.com/", D(2024, 1, 9)), (2, "http://bad.com/", D(2024, 1, 10)), (3, "https://a.b.BAD.com:80/z", D(2024, 1, 31)),
        (4, "http://bad.com", D(2024, 2, 1)), (5, "http://notbad.com/", D(2024, 1, 15)), (6, "http://bad.com/?q=1", D(2025, 1, 1)),
        (7, "http://ok.org/spam/x.html", D(2024, 5, 1)), (8, "http://ok.org/spamming", D(2024, 5, 1)),
        (9, "http://bad.com/a/b", D(2024, 1, 20)), (10, "http://tie.net/", D(2024, 5, 1)), (11, "http://u:p@bad.com/", D(2024, 1, 20)),
    ]
    events = spark.createDataFrame(EVENTS, "entry string, action string, listed_at date")
    out = {r["page_id"]: r for r in url_filter.judge(frame(spark, pages), events).collect()}
    assert {i for i, r in out.items() if r["blocked"]} == {2, 3, 6, 7, 9, 11}
    assert (out[9]["entry"], out[9]["n_active"], out[9]["listed_at"]) == ("bad.com/a/", 2, D(2024, 1, 1))
    assert out[6]["listed_at"] == D(2024, 3, 1) and out[3]["host"] == "a.b.bad.com"


def test_edges(spark):
    events = spark.createDataFrame(EVENTS, "entry string, action string, listed_at date")
    pages = frame(spark, [(1, None, D(2024, 1, 20)), (2, "http://bad.com", None), (None, "http://bad.com", D(2024, 1, 20)),
                          (3, "no url", D(2024, 1, 20)), (4, "http://bad.com/" + "a/" * 400, D(2024, 1, 20)), (4, "http://bad.com/" + "a/" * 400, D(2024, 1, 20))])
    out = url_filter.judge(pages, events).collect()
    assert len(out) == 6 and sorted((r["page_id"] or 0) for r in out if r["blocked"]) == [0, 4, 4]
    assert url_filter.judge(pages.limit(0), events).collect() == []
    assert not any(r["blocked"] for r in url_filter.judge(pages, events.limit(0)).collect())


def test_hosts_of_entries_and_captures_are_written_alike(spark):
    events = spark.createDataFrame([
        ("Bad.COM", "add", D(2024, 1, 1)), ("bad.com.", "remove", D(2024, 2, 1)), ("Dot.net./Spam/", "add", D(2024, 1, 1)),
        ("[2001:DB8::1]", "add", D(2024, 1, 1)), ("[::ffff:1.2.3.4]", "add", D(2024, 1, 1)),
    ], "entry string, action string, listed_at date")
    pages = [
        (1, "http://www.bad.com/", D(2024, 1, 5)), (2, "http://BAD.com./", D(2024, 1, 5)), (3, "http://bad.com/", D(2024, 2, 5)),
        (4, "http://dot.net/Spam/x", D(2024, 1, 5)), (5, "http://dot.net/spam/x", D(2024, 1, 5)), (6, "http://[2001:db8::1]:80/", D(2024, 1, 5)),
        (7, "http://[2001:db8::2]/", D(2024, 1, 5)), (8, "http://u@[::FFFF:1.2.3.4]/a/", D(2024, 1, 5)), (9, "http://[::1.2.3.4]/", D(2024, 1, 5)),
    ]
    out = {r["page_id"]: r for r in url_filter.judge(frame(spark, pages), events).collect()}
    assert {i for i, r in out.items() if r["blocked"]} == {1, 2, 4, 6, 8}
    assert (out[2]["host"], out[7]["host"], out[4]["entry"]) == ("bad.com", "[2001:db8::2]", "dot.net/Spam/")


def test_the_plan_has_no_python(spark, sf_dir):
    from holdfast.llm.queries import op7_exact_dedup, op10_url_filter

    for query in (op7_exact_dedup, op10_url_filter):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
