"""Round trips of sources and sinks."""

import json

from pyspark.sql import functions as F

from quayside.operators import catalog as K
from quayside.operators import telemetry as T
from quayside.sources import snapshots as N
from quayside.sources.adapters import logical


def test_state_round_trip(spark, sf, tmp_path):
    peers, files = logical(spark, sf, "peers"), logical(spark, sf, "replicas").drop("last_accessed", "l_linenumber")
    N.write_state(peers.drop("last_heartbeat", "pool", "zone"), files, str(tmp_path))
    part = next((tmp_path / "files").glob("part*"))
    (part.parent / f".{part.name}.crc").unlink()
    with part.open("a") as f:
        f.write("this is no json\n")
    p, r, bad = N.read_state(spark, str(tmp_path))
    assert p.count() == peers.count() and r.count() == files.count() and bad.count() == 1
    cols = ["file_path", "peer_id", "storage_tier", "file_size", "seq"]
    assert r.select(*cols).exceptAll(files.select(*cols)).isEmpty()


def test_saved_state_is_small(spark, sf, tmp_path, monkeypatch):
    """The query's JSON takes less than a fifth of its plain text."""
    from quayside.plans import queries_sources as Q

    monkeypatch.setattr(Q, "folder", lambda _: str(tmp_path / "q"))
    Q.QUERIES["a14_state_round_trip"](spark, sf)
    N.write_state(logical(spark, sf, "peers").drop("last_heartbeat", "pool", "zone"), logical(spark, sf, "replicas").drop("last_accessed", "l_linenumber"), str(tmp_path / "p"))
    size = lambda x: sum(f.stat().st_size for f in (tmp_path / x / "files").glob("part*"))
    assert 0 < size("q") * 5 < size("p")


def test_nested_state(spark, tmp_path):
    doc = {"peers": {"a": {"id": "a", "status": "active", "labels": {"x": "y"}}}, "files": {"/f": [{"peer_id": "a", "storage_tier": "nvme", "file_size": 5, "is_chunked": False}, {"peer_id": "b", "storage_tier": "peer", "file_size": 6}]}}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    p, f = N.read_nested_state(spark, str(tmp_path / "s.json"))
    assert p.first()["labels"] == {"x": "y"} and [(r["seq"], r["file_size"]) for r in f.orderBy("seq").collect()] == [(0, 5), (1, 6)]


def test_manifest_and_metrics(spark, sf, tmp_path):
    m = K.manifest(logical(spark, sf, "replicas"))
    N.write_manifest(m, f"{tmp_path}/m")
    assert N.read_manifest(spark, f"{tmp_path}/m").exceptAll(m).isEmpty()
    samples = T.parse_metrics(logical(spark, sf, "metric_lines"))
    N.write_metrics(T.emit_metrics(samples), f"{tmp_path}/t")
    assert T.parse_metrics(N.read_metrics(spark, f"{tmp_path}/t", "n")).count() == samples.count()


def test_snapshot_restore(spark):
    o = spark.createDataFrame([("/a/1", bytearray(b"\x00\xff")), ("/a/2", bytearray(b"")), ("/b", bytearray(b"x"))], "path string, data binary")
    s = N.fs_snapshot(o, "/a/", 5)
    assert [r["file_path"] for r in s.collect()] == ["/a/1", "/a/2"]
    bad = s.unionByName(spark.createDataFrame([("/a/3", 1, "!!!")], "file_path string, size bigint, content_b64 string"))
    got = {r["path"]: r for r in N.fs_restore(bad, o.where("path = '/a/2'")).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"/a/1": "restored", "/a/2": "skipped", "/a/3": "failed"} and bytes(got["/a/1"]["data"]) == b"\x00\xff"
    assert {r["outcome"] for r in N.fs_restore(s, o, overwrite=True).collect()} == {"restored"}


def test_benchmark_table(spark, tmp_path):
    row = spark.createDataFrame([(1, 'a "quoted", one', 2.5, 10.0, 20.0, 70.0)], N.schema.BENCHMARK)
    for _ in range(2):
        N.append_benchmark(row, f"{tmp_path}/b")
    assert [tuple(r) for r in N.read_benchmark(spark, f"{tmp_path}/b").collect()] == [tuple(row.first())] * 2


def test_mounts_and_labels(spark, tmp_path):
    (tmp_path / "mounts").write_text("/dev/nvme0n1p1 /mnt/a\\040b ext4 rw 0 0\nshort line\nproc /proc proc rw 0 0\n")
    assert [tuple(r) for r in N.read_mounts(spark, str(tmp_path / "mounts")).collect()] == [("/dev/nvme0n1p1", "/mnt/a b", "ext4"), ("proc", "/proc", "proc")]
    (tmp_path / "n.json").write_text(json.dumps({"metadata": {"name": "n1", "labels": {"zone": "z", "other": "o"}}}))
    assert N.read_node_labels(spark, str(tmp_path / "n.json"), {"zone": "topology"}).first()["labels"] == {"topology": "z"}


def test_objects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"abc")
    (tmp_path / "d/b.tmp").write_bytes(b"x")
    (tmp_path / "c.bin").write_bytes(b"y")
    got = N.read_objects(spark, f"file://{tmp_path}", "*.bin").select(F.regexp_extract("path", "[^/]*$", 0).alias("n"), "length", "data").orderBy("n").collect()
    assert [(r["n"], r["length"], bytes(r["data"])) for r in got] == [("a.bin", 3, b"abc"), ("c.bin", 1, b"y")]
    known = spark.createDataFrame([(f"{tmp_path}/c.bin",)], "file_path string")
    assert [(r["file_path"], r["size"], r["tier"]) for r in N.rehydrate(spark, f"file://{tmp_path}", known).collect()] == [(f"{tmp_path}/d/a.bin", 3, "nvme")]
    keys = spark.createDataFrame([("/x",), ("y",), ("z",)], "path string")
    objects = spark.createDataFrame([("x", 1), ("/y", 2)], "key string, length bigint")
    assert [tuple(r) for r in N.key_candidates(keys, objects).orderBy("path").collect()] == [("/x", "x", 1), ("y", "/y", 2), ("z", None, None)]
    assert N.no_tier(spark).count() == 0
    N.write_objects(spark.createDataFrame([("p", bytearray(b"1"))], "path string, data binary"), f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 1
    N.write_node_config(spark.createDataFrame([("/mnt/a", 5, "nvme")], "cache_dir string, cache_bytes bigint, disk_class string"), f"{tmp_path}/cfg")
    assert N.read_node_config(spark, f"{tmp_path}/cfg").first()["cache_bytes"] == 5
