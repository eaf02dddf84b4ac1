import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quayside.llm import queries, url_filter

HOSTS = {
    "http://[2001:db8::1]:80/x": "[2001:db8::1]",
    "http://user:p@ss@example.com/": "example.com",
    "http://ex%61mple.com/x": "example.com",
    "http://ex%zzmple.com/x": "ex%zzmple.com",
    "http:\\\\bad.example\\path": "bad.example",
    "https://good.example\\@evil.example/": "good.example",
    "  HTTP://WWW.Example.COM.:8080?q=//x": "example.com",
    "//cdn.example/a": "cdn.example",
    "http://a.b?x=http://c.d/": "a.b",
    "mailto:x@y.z": None,
    "http:///path": None,
    "http://:80/": None,
    "not a url": None,
    "": None,
    None: None,
}


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def keys(url):
    """By hand, from host and path."""
    host, path = url
    labels, steps = host.split("."), [x for x in path.split("/") if x]
    return {"h:" + ".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {"p:" + host + "/" + "/".join(steps[: i + 1]) for i in range(len(steps))}


def active(events, key, at):
    """Replays the events of one key, a day's remove last."""
    on = False
    for _, action, when in sorted((e for e in events if e[0] == key and None not in e), key=lambda e: (e[2], e[1])):
        if when <= at:
            on = action == "add"
    return on


def test_hosts(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string")
    assert {r["url"]: r["h"] for r in df.select("url", url_filter.host_of(F.col("url")).alias("h")).collect()} == HOSTS


def test_paths(spark):
    df = spark.createDataFrame([("http://a.b\\c/d?e#f",), ("http://a.b",), ("//a.b/x#y/z",)], "url string")
    assert [r[0] for r in df.select(url_filter.path_of(F.col("url"))).collect()] == ["/c/d", "", "/x"]


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.example", "b.a.example", "c.b.a.example", "d.test", "x.d.test", "single"]
    urls = [(rng.choice(hosts), "/".join(["", *[rng.choice("pqr") for _ in range(rng.randint(0, 3))]])) for _ in range(120)]
    every = sorted(set().union(*map(keys, urls)))
    events = [(rng.choice(every), rng.choice(["add", "add", "remove"]), day(rng.randint(0, 20))) for _ in range(200)]
    events += [(None, "add", day(1)), (every[0], None, day(1)), (every[0], "add", None), (every[1], "other", day(1)), events[0], events[0]]
    captures = [(i, f"http://{h}{p}", day(rng.randint(0, 25))) for i, (h, p) in enumerate(urls)]
    captures += [captures[0], captures[0], (None, captures[1][1], captures[1][2]), (500, None, day(3)), (501, captures[2][1], None), (502, "http://a.example/" + "s/" * 3000, day(20))]
    urls += [urls[0], urls[0], urls[1], None, urls[2], ("a.example", "/" + "s/" * 3000)]
    df = spark.createDataFrame([(*c, "x", "y", 1) for c in captures], "page_id bigint, url string, fetched date, key string, host string, n_active int")
    listed = spark.createDataFrame([(*e, "z") for e in events], "key string, action string, day date, url string")
    got = sorted((tuple(r) for r in url_filter.filter_captures(df, listed).collect()), key=str)
    want = []
    for (i, url, at), u in zip(captures, urls):
        hit = sorted(k for k in keys(u) if active(events, k, at)) if u and at else []
        want.append((i, url, u and u[0], at, len(hit), hit[0] if hit else None, bool(hit)))
    assert got == sorted(want, key=str) and 20 < sum(r[-1] for r in want) < 110


def test_hot_hosts_are_dealt_out(spark):
    captures = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.example/"), "id").alias("url"), F.lit(day(5)).alias("fetched"))
    events = spark.createDataFrame([("h:hot.example", "add", day(1))], "key string, action string, day date")
    out = url_filter.filter_captures(captures, events)
    assert out.where("blocked").count() == 400 and "salt" in out._jdf.queryExecution().optimizedPlan().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, fetched date")
    events = spark.createDataFrame([], "key string, action string, day date")
    assert url_filter.filter_captures(none, events).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c", day(1))], "page_id bigint, url string, fetched date")
    assert [tuple(r) for r in url_filter.filter_captures(one, events).collect()] == [(1, "http://a.b/c", "a.b", day(1), 0, None, False)]


def test_sql_agrees(spark, tmp_path):
    """On the table, and on hosts of every awkward kind."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    odd = [(10_000 + 7 * n + i, u, None) for n, u in enumerate(HOSTS) for i in range(7)]
    pages.union(spark.createDataFrame(odd, "page_id bigint, url string, html string")).write.parquet(f"{tmp_path}/pages.parquet")
    columns = ["page_id", "url", "host", "fetched", "n_active", "matched", "blocked"]
    got = sorted((tuple(r) for r in queries.op3_url_filter(spark, str(tmp_path)).select(columns).collect()), key=str)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op3_url_filter']})").fetchall()
    assert got == sorted(want, key=str)
