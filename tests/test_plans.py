"""What the physical plans of queries must and must not hold."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import catalog as K
from quayside.operators import ordered as O
from quayside.plans.registry import QUERIES
from quayside.streaming import state


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["g17_hot_under_replicated", "d4_manifest", "d5_warm_targets", "d7_holder_counts", "g2_prefix_scan", "l8_reconcile"])
def test_replicas_are_summed_before_the_shuffle(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "SortAggregate" not in p and p.count("lineitem.parquet") == 1
    assert "l_extendedprice" not in p and "l_returnflag" not in p
    assert name == "l8_reconcile" or "Window" not in p


def test_upserts_need_no_sort(spark, sf):
    p = plan(QUERIES["j3_upsert_replicas"](spark, sf))
    assert "SortAggregate" not in p and "Window" not in p and p.count("Exchange hashpartitioning") == 1


def test_filters_on_groups_pass_the_aggregate(spark, sf):
    p = plan(QUERIES["g2_prefix_scan"](spark, sf))
    assert p.index("StartsWith") if "StartsWith" in p else "startswith" in p.lower()
    assert "Filter" in p[p.index("Exchange hashpartitioning") :]


@pytest.mark.parametrize("name", ["c1_holder_partition", "j14_seed_plan", "f4_rotation", "a9_placements"])
def test_no_cross_joins_of_paths_and_peers(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p


@pytest.mark.parametrize("name", ["j14_seed_plan", "j14_seed_plan_of_all_paths"])
def test_listed_targets_are_not_shuffled(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hash" not in p[: p.index("Generate explode")] and "SortMergeJoin" not in p[: p.index("Generate explode")] and p.count("lineitem.parquet") == 1


def test_rows_without_a_parent_are_not_gathered(spark, sf):
    """4000 files and 40 chunks over 4 tasks: none gets most of the rows."""
    rows = [(f"/f{i}", i, "nvme", i % 2 == 0) for i in range(4000)] + [(f"/f{i}_chunk_0", i, "peer", False) for i in range(40)]
    out = K.without_cached_parents(spark.createDataFrame(rows, "file_path string, size int, tier string, is_chunked boolean").repartition(4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 2000
    assert sorted(r["file_path"] for r in got) == sorted([r[0] for r in rows[:4000]] + [f"/f{i}_chunk_0" for i in range(1, 40, 2)])


def test_metric_lines_are_cut_once(spark, sf):
    p = plan(QUERIES["a18_parse_metrics"](spark, sf))
    assert p.count("Generate explode") >= 2 and p.count("regexp_replace(") <= 6


def test_range_sums_by_brute_force(spark):
    rows = [(i * 7919 % 1000, i, 1 + i % 5) for i in range(300)] + [(5, 1000 + i, 2) for i in range(20)]
    t = spark.createDataFrame(rows, "at int, id int, n int")
    got = O.running_in_ranges(t, F.col("n"), F.expr("at div 100"), F.expr("at div 10"), [F.col("at"), F.col("id")])
    want, total = {}, 0
    for at, i, n in sorted(rows):
        want[at, i] = total
        total += n
    assert {(r["at"], r["id"]): r["__before"] for r in got.collect()} == want


def test_a_bucket_is_one_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"/f{i}", f"p{i % 3}", "nvme", i, i) for i in range(2000)], "file_path string, peer_id string, storage_tier string, file_size bigint, seq bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        state.upsert_replicas_batch(f"file://{tmp_path}/c")(rows, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "c/v0").glob("bucket=*"))) == len(list((tmp_path / "c/v0").glob("bucket=*/*.parquet"))) == state.BUCKETS


def test_peers_are_kept_without_python(spark, tmp_path):
    """Probes of earlier batches stay where later ones are not positive; a row a peer and batch."""
    kind = "peer_id string, ts timestamp_ntz, ts_us bigint, seq bigint, status string, network_speed_mbps double, network_latency_ms double"
    (tmp_path / "in").mkdir()
    stream, seen = state.peer_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")), []
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
    for rows in ([("a", 1, "active", 5.0, 7.0), ("a", 2, "active", 0.0, 8.0), ("b", 3, "active", 0.0, 0.0)], [("a", 4, "inactive", 0.0, 0.0)]):
        t = spark.createDataFrame(rows, "peer_id string, seq bigint, status string, network_speed_mbps double, network_latency_ms double")
        t.select("peer_id", F.expr("TIMESTAMP_NTZ '2024-01-01'").alias("ts"), F.lit(0).cast("bigint").alias("ts_us"), "seq", *t.columns[2:]).write.mode("append").parquet(f"{tmp_path}/in")
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.append(sorted(tuple(r) for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == [[("a", 2, "active", 5.0, 8.0), ("b", 3, "active", 0.0, 0.0)], [("a", 4, "inactive", 5.0, 8.0)]]


def test_a_batch_rewrites_touched_buckets_only(spark, tmp_path):
    kind = "file_path string, peer_id string, storage_tier string, file_size bigint, seq bigint"
    first = spark.createDataFrame([(f"/f{i}", "p", "nvme", i, i) for i in range(400)], kind)
    second = spark.createDataFrame([("/f7", "p", "nvme", 70, 1000), ("/f7", "q", "nvme", 71, 1001)], kind)
    merge = state.upsert_replicas_batch(f"file://{tmp_path}/c")
    merge(first, 0)
    merge(second, 1)
    merge(second, 1)  # a batch that runs again
    assert len(list((tmp_path / "c/v1").glob("bucket=*"))) == 1 and len(list((tmp_path / "c/v0").glob("bucket=*"))) > 50
    got = state.read_catalog(spark, f"file://{tmp_path}/c").select("file_path", "peer_id", "storage_tier", "file_size", "seq")
    want = K.upsert_replicas(first.union(second)).select("file_path", "peer_id", "storage_tier", "file_size", "seq")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 401
