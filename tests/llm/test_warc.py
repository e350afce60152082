import random

from vetra.llm import warc

HEAD = {"ETag": "x", "Server": "one", "Date": "d0"}


def rec(i, url, ts, kind="response", profile=None, etag=None, day=None, headers=None):
    return (i, url, ts, kind, profile, etag, day, f"sha-{i}" if kind == "response" else None, headers)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, warc.RECORD).selectExpr("*", "1 AS slice", "2 AS o", "'z' AS url_key").repartition(3)
    return {r.record_id: r for r in warc.resolve(df, **more).collect()}


def test_latest_earlier_response_validators_and_headers(spark):
    ask = lambda i, url, ts, **k: rec(i, url, ts, "revisit", warc.NOT_MODIFIED, **k)
    got = run(spark, [
        rec(1, "http://www.A.com/x/?utm_source=f#top", 10, etag='"a"', headers=HEAD), rec(2, "https://a.com/x", 20, etag='"b"', headers=HEAD), rec(3, "a.com:80/x/index.html", 40, etag='"c"'),
        ask(10, "https://a.com/x/", 30, etag='W/"b"', headers={"date": "d1", "Server": "two"}), ask(11, "http://a.com/x", 20, etag='"a"'), ask(12, "http://a.com/x", 10, etag='"a"'),
        ask(13, "http://a.com/x", 99, etag='"b"'), ask(14, "http://a.com/x", 99), ask(15, "http://a.com/y", 99), ask(16, None, 99), ask(17, "http://a.com/x", None),
        rec(18, "http://a.com/x", 99, "revisit", "identical-payload-digest"), rec(4, None, 5), rec(5, "http://a.com/d", 1, day="mon"), ask(19, "http://a.com/d", 2, day="mon"), ask(20, "http://a.com/d", 2, day="tue"),
    ])
    assert {i: (r.status, r.original_id) for i, r in got.items()} == {
        10: ("resolved", 2), 11: ("resolved", 1), 12: ("missing", None), 13: ("changed", 3), 14: ("unvalidated", 3), 15: ("missing", None), 16: ("missing", None), 17: ("missing", None),
        18: ("other", None), 19: ("resolved", 5), 20: ("changed", 5),
    }
    assert got[10].headers == {"etag": "x", "server": "one", "date": "d1"} and got[10].digest == "sha-2" and got[13].headers is None


def test_against_brute_force_over_slices(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        url = rnd.choice(["h.com/hot"] * 5 + ["h.com/a", "h.com/b"])
        if rnd.random() < 0.3:
            rows.append(rec(i, url, rnd.randrange(300), etag=rnd.choice(["1", "2"])))
        else:
            rows.append(rec(i, url, rnd.randrange(300), "revisit", warc.NOT_MODIFIED, etag=rnd.choice(["1", "2"])))
    want = {}
    for r in rows:
        if r[3] == "revisit":
            o = max(((x[2], x[0], x[5]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]), default=None)
            want[r[0]] = ("missing", None) if o is None else ("resolved" if o[2] == r[5] else "changed", o[1])
    for size in (7, 1000):
        assert {i: (r.status, r.original_id) for i, r in run(spark, rows, slice_seconds=size).items()} == want


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    twice = [rec(1, "u.com", 1, etag="e"), rec(1, "u.com", 1, etag="e"), rec(2, "u.com", 5, "revisit", warc.NOT_MODIFIED, etag="e"), rec(2, "u.com", 5, "revisit", warc.NOT_MODIFIED, etag="e")]
    assert warc.resolve(spark.createDataFrame(twice, warc.RECORD)).count() == 2
