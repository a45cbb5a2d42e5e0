"""Temporal list join against a scan of all events for each capture."""

import datetime as dt
import random

from ragscope.llm.url_filters import filter_captures

DAY = dt.date(2024, 1, 1)


def active(events, pattern, day):
    own = {}
    for p, a, d in events:
        if p and a in ("remove", "allow", "block") and d is not None and p.lower().strip(".") == pattern and d <= day:
            own.setdefault(d, []).append(a)
    if not own:
        return None
    last = own[max(own)]
    return max(last, key=["remove", "allow", "block"].index)


def test_against_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "y.x.org", "hot.net"]
    day = lambda: DAY + dt.timedelta(days=rng.randint(0, 200))
    events = [(rng.choice([*hosts, "com", "Example.com", ".x.org", "", None]), rng.choice(["block", "allow", "remove", "odd", None]), rng.choice([day(), day(), None])) for _ in range(120)]
    captures = [(i, rng.choice(["http://", "HTTPS://u:p@"]) + (h := rng.choice([*hosts, "hot.net", "hot.net", "Hot.NET.", "none.io"])) + rng.choice(["", "/p?q", ":80/"]), rng.choice([day(), day(), None]), h) for i in range(400)]
    captures += [(900, None, DAY, None), (901, "", DAY, None), (902, "no url", DAY, None), (0, *captures[0][1:])]
    cdf = spark.createDataFrame(captures, "host int, url string, fetched_on date, pattern string").repartition(4)
    edf = spark.createDataFrame(events, "pattern string, action string, listed_on date")
    got = filter_captures(cdf, edf).collect()
    want = []
    for i, url, d, h in captures:
        host = h.lower().rstrip(".") if h else None
        labels = host.split(".") if host else []
        hits = [(p, a) for k in range(len(labels)) if d and (a := active(events, p := ".".join(labels[k:]), d)) in ("allow", "block")]
        want.append((i, host, len(hits), hits[0][0] if hits else None, bool(hits) and hits[0][1] == "block"))
    assert sorted(((r.host, r._u_host, r._u_active, r._u_decided_by, r._u_blocked) for r in got), key=str) == sorted(want, key=str)
    assert filter_captures(cdf.limit(0), edf).count() == 0
    assert filter_captures(cdf, edf.limit(0)).where("_u_blocked").count() == 0
