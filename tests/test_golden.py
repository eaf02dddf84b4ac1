"""Literal cases: small inputs with the results that a fleet's own tests expect."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.operators import byteops as B
from quayside.operators import catalog as K
from quayside.operators import ordered as O
from quayside.operators import selection as P
from quayside.operators import telemetry as T
from quayside.plans.queries_ordered import evict_safe

c = F.col
NOW = dt.datetime(2024, 1, 1, 12)


def at(ts=NOW):
    return F.expr(f"TIMESTAMP_NTZ '{ts}'")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("bigint")


REPLICA = "file_path string, peer_id string, storage_tier string, file_size bigint, last_accessed timestamp_ntz, is_chunked boolean, chunk_size bigint, chunks array<struct<index:int,peer_id:string,chunk_id:string>>, seq bigint"


def replicas(spark, *rows):
    return spark.createDataFrame([(*r[:4], NOW, bool(r[4]), 0, [(i, r[1], f"{r[0]}_chunk_{i}") for i in r[4]], n) for n, r in enumerate(rows)], REPLICA)


def test_world_view(spark):
    view = K.world_view(replicas(spark, ("/data/a.bin", "peer-a", " NVMe ", 1024, [0, 1]), ("/data/a.bin", "peer-b", "peer", 1000, [1]), ("/x", "p", "", 1, []))).orderBy("file_path").collect()
    assert (view[0]["replica_count"], view[0]["tier_replicas"], view[0]["chunk_replicas"], view[0]["size"]) == (2, "nvme:1,peer:1", "0:1,1:2", 1024)
    assert (view[1]["tier_replicas"], view[1]["chunk_replicas"]) == ("unknown:1", None)


def test_manifest(spark):
    got = K.manifest(replicas(spark, ("a.txt", "p", "nvme", 100, []), ("a.txt", "q", "nvme", 200, []), ("b.txt", "p", "nvme", 50, [0, 1, 2]))).orderBy("file_path").collect()
    assert [(r["file_path"], r["size"], r["chunk_count"]) for r in got] == [("a.txt", 200, 0), ("b.txt", 50, 3)]


def peers(spark):
    rows = [("cpu-a", "active", {"pool": "cpu", "zone": "a"}), ("gpu-a", "active", {"pool": "gpu", "zone": "a"}), ("gpu-b", "inactive", {"pool": "gpu", "zone": "b"}), ("plain", "active", {})]
    return spark.createDataFrame([(*r, NOW) for r in rows], "id string, status string, labels map<string,string>, last_heartbeat timestamp_ntz")


@pytest.mark.parametrize("pct,labels,ids,want", [(0, {}, [], ["cpu-a", "gpu-a", "plain"]), (0, {"pool": "gpu"}, [], ["gpu-a"]), (0, {"zone": "a"}, [], ["cpu-a", "gpu-a"]), (34, {}, [], ["cpu-a", "gpu-a"]), (1, {}, [], ["cpu-a"]), (0, {"pool": "gpu"}, ["plain"], [])])
def test_warm_nodes(spark, pct, labels, ids, want):
    assert [r["id"] for r in P.warm_nodes(peers(spark), at(), "", pct, labels, ids).orderBy("id").collect()] == want


def test_selection_errors(spark):
    with pytest.raises(ValueError):
        P.warm_nodes(peers(spark), at(), "", 101)
    with pytest.raises(ValueError):
        P.warm_plan("sideways", "")
    with pytest.raises(ValueError):
        K.warm_targets(replicas(spark), "", 4)
    assert P.warm_plan("cloud-first", "max") == (["cloud", "peer"], 4, 16) and P.warm_plan("cloud-only", "") == (["cloud"], 2, 4)


def test_rotation_takes_all_over_keys(spark):
    three = spark.createDataFrame([("node-a",), ("node-b",), ("node-c",)], "id string")
    for pct, n in ((33, 1), (34, 2), (50, 2), (0, 3), (100, 3)):
        assert [P.rotated_share(three, k, pct).count() for k in ("", "/a", "/models/x")] == [n] * 3
    assert P.rotated_share(three, "", 50).count() == 2 and {r[0] for k in "abcdefgh" for r in P.rotated_share(three, k, 1).collect()} == {"node-a", "node-b", "node-c"}


def test_hashes(spark):
    h, w, z = one(spark, S.fnv1a_32(F.lit("abc")), S.fnv1a_64(F.lit("foobar")), S.fnv1a_32(F.lit("")))
    assert (h, w & (2**64 - 1), z) == (0x1A47E90B, 0x85944171F73967E8, 2166136261)


def test_stale_heartbeats(spark):
    rows = [("a", NOW - dt.timedelta(seconds=5)), ("b", NOW - dt.timedelta(seconds=600)), ("c", None)]
    t = spark.createDataFrame(rows, "id string, last_heartbeat timestamp_ntz")
    assert sorted(r["id"] for r in K.fresh_peers(t, at()).collect()) == ["a", "c"]


def test_chunk_math(spark):
    cases = [(0, 4, 0), (1, 4, 1), (4, 4, 1), (5, 4, 2), (24, 4, 6), (24, 0, 0), (-1, 4, 0)]
    assert one(spark, *[S.chunk_count(lit(a), lit(b)).alias(f"c{i}") for i, (a, b, _) in enumerate(cases)]) == tuple(x for *_, x in cases)
    for args, want in (((0, 4, 4), (0, 4)), ((5, 2, 4), (4, 4)), ((2, 9, 4), (2, 4)), ((-1, 3, 4), (0, 3)), ((3, 1, 4), (3, 3))):
        a, b = S.clamp_slice(*map(lit, args))
        assert one(spark, a.alias("a"), b.alias("b")) == want
    assert one(spark, *[S.persist_workers(lit(n)).alias(f"w{n}") for n in (1, 3, 8, 64, 640, 100000)]) == (1, 3, 4, 8, 16, 16)
    gib = S.GIB
    assert one(spark, S.cache_budget(lit(100 * gib), F.lit(0.0), lit(0)).alias("a"), S.cache_budget(lit(100 * gib), F.lit(5.0), lit(10 * gib)).alias("b")) == (80 * gib, 10 * gib)


def test_paths(spark):
    p = lambda x: F.lit(x)
    got = one(spark, S.parent_path(p("/a_chunk_1_chunk_2")).alias("a"), S.parent_path(p("_chunk_1")).alias("b"), S.parent_path(p("/a_chunk_x")).alias("c"), S.parent_path(p("/a_chunk_99999999999999999999")).alias("d"), S.clean_path(p("a//b/./../c/..")).alias("e"), S.clean_path(p("")).alias("f"), S.host_part(p("h:1")).alias("g"), S.chunk_index(p("/a_chunk_-3")).alias("h"))
    assert got == ("/a_chunk_1", None, None, None, "/a", "/", "h", -3)
    assert one(spark, S.disk_name(p("/dev/nvme0n1p2")).alias("a"), S.disk_name(p("/dev/mmcblk0p1")).alias("b"), S.disk_name(p("/dev/xvdb1")).alias("c"), S.disk_class(p("sda"), p("0")).alias("d"), S.disk_class(p("sda"), p("1")).alias("e"), S.disk_class(p("sda"), F.lit(None)).alias("f")) == ("nvme0n1", "mmcblk0", "xvdb", "ssd", "disk", "unknown")
    assert one(spark, K.is_pinned(p("/a/b"), ["/a"]).alias("a"), K.is_pinned(p("/ab"), ["/a"]).alias("b"), K.is_pinned(p("/a"), ["/", ""]).alias("c"), K.is_pinned(p("/a"), ["/"], True).alias("d")) == (True, False, False, True)


def choice(spark, rows, now=NOW):
    t = spark.createDataFrame([("n", t, NOW - dt.timedelta(seconds=age), i, ms, ok, False) for i, (t, ms, ok, age) in enumerate(rows)], "node string, tier string, ts timestamp_ntz, seq int, ms double, ok boolean, miss boolean")
    return tuple(O.tier_choice(O.ewma(t, ["node", "tier"]), at(now)).first()[1:3])


def test_tier_order(spark):
    good = [("peer", 2.0, True, 0)] * 8 + [("cloud", 60.0, True, 0)] * 8
    assert choice(spark, good) == ("peer", False)
    assert choice(spark, [("peer", 2.0, False, 0)] * 8 + [("cloud", 60.0, True, 0)] * 8) == ("cloud", False)
    assert choice(spark, [("peer", 10.0, True, 0)] * 8 + [("cloud", 11.0, True, 0)] * 8) == ("peer", True)
    assert choice(spark, [("peer", 2.0, False, 60)] * 8 + [("cloud", 60.0, True, 0)] * 8)[0] == "peer"
    assert choice(spark, [("peer", 2.0, True, 0)] * 2 + good[8:]) == ("peer", None)


def test_ewma_and_misses(spark):
    rows = [("k", NOW, i, x, True, False) for i, x in enumerate([10.0, 20.0, 30.0])] + [("k", NOW, 9, 5.0, False, True)] * 12 + [("m", NOW, 1, 1.0, False, True)] * 12
    got = {r["k"]: r for r in O.ewma(spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq int, ms double, ok boolean, miss boolean"), ["k"]).collect()}
    assert abs(got["k"]["latency_ms"] - 18.1) < 1e-9 and got["k"]["misses"] == 12 and (got["m"]["samples"], got["m"]["misses"]) == (0, 12)


def test_reader_heat(spark):
    rows = [("/f", "h0:1", -20), ("/f", "h1:1", 0), ("/f", "h1:2", 0), ("/f_chunk_3", "h2:9", 0)]
    t = spark.createDataFrame([(p, r, NOW + dt.timedelta(minutes=m)) for p, r, m in rows], "path string, reader string, ts timestamp_ntz")
    assert [tuple(r) for r in O.recent_readers(t, at()).collect()] == [("/f", 2)]
    assert one(spark, *[S.heat_target(lit(b), lit(n), most=m).alias(f"x{i}") for i, (b, n, m) in enumerate([(3, 0, 8), (3, 6, 8), (3, 20, 8), (3, 20, 4), (10, 0, 8)])]) == (3, 6, 8, 4, 10)


def test_reconcile(spark):
    t = spark.createDataFrame([("/a", NOW, 2), ("/b", NOW - dt.timedelta(1), 5), ("/c", NOW - dt.timedelta(2), 9), ("/d", NOW, 0)], "file_path string, last_accessed timestamp_ntz, deficit bigint")
    assert [(r["file_path"], r["copies"]) for r in O.reconcile(t, 8).orderBy("file_path").collect()] == [("/a", 2), ("/b", 5), ("/c", 1)]


@pytest.mark.parametrize("whole", [False, True])
def test_eviction(spark, whole):
    t = spark.createDataFrame([(f"f{i}", 1000, NOW + dt.timedelta(hours=9 * i), False, True) for i in range(9)], "file_path string, size bigint, last_accessed timestamp_ntz, pinned boolean, safe boolean")
    gone = {r["file_path"] for r in (O.evict_globally(t, 9000, 7500) if whole else O.evict(t, 9000, 7500, [])).collect()}
    assert gone == {"f0", "f1"}


def test_evict_safe(spark):
    e = spark.createDataFrame([("/a", 4000, False, 0, 0, False), ("/b", 2500, True, 3, 1000, False), ("/c", 2500, True, 3, 1000, False), ("/d", 1, False, 0, 0, True)], "file_path string, size bigint, is_chunked boolean, num_chunks bigint, chunk_size bigint, persisted boolean")
    o = spark.createDataFrame([("/a", 1000), ("/b_chunk_0", 1000), ("/b_chunk_2", 500), ("/c_chunk_0", 1000), ("/c_chunk_2", 200)], "file_path string, cloud_size bigint")
    assert [r["safe"] for r in evict_safe(e, o).orderBy("file_path").collect()] == [False, True, False, True]


def test_metric_parser(spark):
    lines = ["# HELP x y", "", "  ", "a 1", 'b{a="1",b="x=y",c="q\\"z"} 2.5 1700000000', "n NaN", "p +Inf", "m -Inf", "{x=\"1\"} 3", "alone", "bad x", 'open{a="1" 4', "e{} 1e3", 'w{k="a\\nb\\\\"} 7']
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string")
    got = {r["name"]: (r["labels"], r["value"]) for r in T.parse_metrics(t).collect()}
    assert set(got) == {"a", "b", "n", "p", "m", "e", "w"}
    assert got["b"] == ({"a": "1", "b": "x=y", "c": 'q"z'}, 2.5) and got["w"][0] == {"k": "a\nb\\"} and got["e"] == ({}, 1000.0) and got["m"][1] == float("-inf")
    again = T.parse_metrics(T.emit_metrics(T.parse_metrics(t)).withColumn("line_no", F.lit(0))).where("NOT isnan(value)").collect()
    assert {r["name"]: (r["labels"], r["value"]) for r in again} == {k: v for k, v in got.items() if k != "n"}


def test_warm_prefix(spark):
    t = spark.createDataFrame([("/models/a", 10), ("/models/b", 20)], "file_path string, size bigint")
    none, all_ = t.where("false"), t.select("file_path")
    assert [r["outcome"] for r in B.warm_prefix(t, none, all_, 0, 100).collect()] == ["warmed", "warmed"]
    assert [r["outcome"] for r in B.warm_prefix(t, t, all_, 0, 100).collect()] == ["already_local"] * 2
    assert [r["outcome"] for r in B.warm_prefix(t, none, all_, 0, 15).orderBy("file_path").collect()] == ["warmed", "skipped"]


def test_peer_rotation(spark):
    t = spark.createDataFrame([(f"/f_chunk_{i}", f"p{j}") for i in range(3) for j in range(3)], "path string, id string")
    got = P.rotate(t, "id", P.rotation_start(c("path"))).where("rank = 0").orderBy("path").collect()
    assert [r["id"] for r in got] == ["p0", "p1", "p2"]


def test_ranges(spark):
    data = bytes(range(200)) * 10
    o = spark.createDataFrame([("/a", bytearray(data)), ("/empty", bytearray())], "path string, data binary")
    ranges = [(0, "/a", 0, 64), (1, "/a", 60, 10), (2, "/a", 1990, 100), (3, "/a", 2000, 5), (4, "/a", 5, 0), (5, "/empty", 0, 4), (6, "/a", 0, 5000)]
    r = spark.createDataFrame(ranges, "seq int, path string, offset bigint, size bigint")
    sizes = o.select("path", F.octet_length("data").cast("bigint").alias("length"))
    got = {x["seq"]: bytes(x["data"]) for x in B.read_ranges(r, B.split_objects(o, 64), sizes, 64).collect()}
    assert got == {i: data[a : a + n] for i, p, a, n in ranges if p == "/a" and data[a : a + n]}
    assert bytes(B.assemble(B.split_objects(o, 64)).first()["data"]) == data
    assert [x["path"] for x in B.size_mismatches(o, spark.createDataFrame([("/a", 2001)], "path string, size bigint")).collect()] == ["/a"]


def test_plans(spark, sf):
    """Rollups shuffle once a level, range reads join on equal keys, prefixes reach the scan."""
    from quayside.plans.registry import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan(QUERIES["k3_read_ranges"](spark, sf)) and "Cartesian" not in plan(QUERIES["k3_read_ranges"](spark, sf))
    spark.createDataFrame([("/a/b",), ("/c",)], "file_path string").write.mode("overwrite").parquet("/tmp/quayside-plan-test")
    assert "StringStartsWith(file_path,/a)" in plan(K.under_prefix(spark.read.parquet("/tmp/quayside-plan-test"), "/a"))


def test_human_bytes_round_as_python(spark):
    """Exact ties go to the even tenth."""
    import random

    rng, units = random.Random(7), ("B", "KiB", "MiB", "GiB", "TiB", "PiB")

    def human(n):
        x, unit = next((abs(n) / 1024**p, u) for p, u in enumerate(units) if abs(n) < 1024 ** (p + 1) or u == "PiB")
        return ("-" if n < 0 else "") + (f"{x:.0f} {unit}" if unit == "B" else f"{x:.1f} {unit}")

    ns = [57600, 1280, 1792, -1280, 0, 1023, 1024, 1048575, 2**50 * 5 // 4, round(1.15 * 2**50), round(1.35 * 2**50)] + [rng.randrange(-(2 ** rng.randint(1, 60)), 2 ** rng.randint(1, 60)) for _ in range(3000)]
    ns += [k * 256 * 1024**p for k in range(300) for p in range(4)]
    got = {r["n"]: r["h"] for r in spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", S.human_bytes(c("n")).alias("h")).collect()}
    assert got[57600] == "56.2 KiB" and {n: h for n, h in got.items() if h != human(n)} == {}
