"""The URL filter meets the whole list history: every event is a fetch, on all days."""

from datetime import datetime, timedelta

from pathloom.llm import queries as q


def tables(spark, folder):
    t, day = datetime(2024, 1, 1), timedelta(days=1)
    events = [
        (100, t, 1, "error"), (101, t + 2 * day, 1, "click"), (102, t + 9 * day, 1, "signup"), (103, t + 20 * day, 1, "click"),
        (104, t + 25 * day, 1, "error"), (106, t + 29 * day, 1, "click"), (107, t + 29 * day, 7, "view"), (108, t + 30 * day, 2, "click"),
    ]
    pages = [(1, "https://a.example.com/x"), (2, "https://b.example.org"), (3, "https://c.example.net"), (4, None)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_every_event_is_a_capture(spark, tmp_path):
    got = q.op3_url_filter(spark, tables(spark, tmp_path)).collect()
    # on the list from day 0 to day 9 and again from day 25; user 7 has no page, pages 3 and 4 no fetch
    want = [
        (100, 1, "block"), (101, 1, "block"), (102, 1, "pass"), (103, 1, "pass"), (104, 1, "block"), (106, 1, "block"),
        (107, 7, "unknown"), (108, 2, "pass"), (None, 3, "unknown"), (None, 4, "unknown"),
    ]
    assert sorted(((r["event_id"], r["page_id"], r["verdict"]) for r in got), key=repr) == sorted(want, key=repr)


def test_all_fetch_times_against_brute_force(spark, sf):
    """Latest entry of each list and pattern at each fetch time, one by one in Python."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", q.url_filter.host_of(q.F.col("url")).alias("host")).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type").collect()
    kinds = {"error": ("block", True), "signup": ("block", False), "purchase": ("allow", True), "view": ("allow", False)}
    history = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        host = pages[e["user_id"]]["host"]
        if e["event_type"] in kinds and host:
            name, adds = kinds[e["event_type"]]
            pattern = host.partition(".")[2] if e["event_id"] % 7 == 0 and "." in host else host
            history.setdefault((name, pattern), []).append((e["ts"], adds))
    want = {}
    for e in events:
        host = pages[e["user_id"]]["host"]
        best, n = {"block": None, "allow": None}, 0
        labels = host.split(".") if host else []
        for name in best:
            for i in range(max(len(labels) - 1, 0)):
                pattern = ".".join(labels[i:])
                past = [adds for ts, adds in history.get((name, pattern), []) if ts <= e["ts"]]
                if past and past[-1]:
                    n += 1
                    best[name] = best[name] or pattern
        block = len(best["block"] or "") > len(best["allow"] or "")
        want[e["event_id"]] = (n, best["block"], best["allow"], "unknown" if len(labels) < 2 else "block" if block else "pass")
    got = q.op3_url_filter(spark, sf).filter("event_id is not null").collect()
    assert len(got) == len(events)
    assert {r["event_id"]: (r["n_active"], r["block_pattern"], r["allow_pattern"], r["verdict"]) for r in got} == want
