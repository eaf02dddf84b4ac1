"""Queries over whole tables."""

import math

from quayside.operators import telemetry as T
from quayside.plans.registry import QUERIES
from quayside.sources.adapters import logical


def test_retention_sees_the_newest_jobs(spark, sf):
    newest = logical(spark, sf, "warm_jobs").orderBy("updated_at", "id", ascending=False).first()["id"]
    got = {r["id"] for r in QUERIES["w14_retained_of_all_jobs"](spark, sf).collect()}
    assert newest in got and len(got) == 120


def test_delta_covers_the_last_lines(spark, sf):
    rows = sorted((r["line_no"], r["labels"].get("type") or r["name"], r["value"]) for r in T.parse_metrics(logical(spark, sf, "metric_lines")).collect() if math.isfinite(r["value"]))
    lines = [r["line_no"] for r in logical(spark, sf, "metric_lines").select("line_no").collect()]
    before, after = ({n: v for i, n, v in rows if (i > (min(lines) + max(lines)) // 2) == late} for late in (False, True))
    got = {r["name"]: r["delta"] for r in QUERIES["c12_scrape_delta_of_halves"](spark, sf).collect()}
    assert got == {n: after.get(n, 0) - before.get(n, 0) for n in before.keys() | after.keys()}


def test_all_paths_and_peers(spark, sf):
    held = {r["file_path"] for r in logical(spark, sf, "replicas").where("storage_tier <> 'cloud'").select("file_path").distinct().collect()}
    assert {r["file_path"] for r in QUERIES["c1_holder_flags"](spark, sf).collect()} == held
    assert {r["path"] for r in QUERIES["f4_rotation_of_all_paths"](spark, sf).collect()} == held


def test_plan_by_brute_force(spark, sf):
    """All lacking peers of each path listed, the lowest 5 % of them taken."""
    live = sorted(r["id"] for r in logical(spark, sf, "peers").where("status = 'active'").collect())
    held, first = {}, {}
    for r in logical(spark, sf, "replicas").where("storage_tier <> 'cloud'").collect():
        held.setdefault(r["file_path"], set()).add(r["peer_id"])
        if r["peer_id"] in live:
            first[r["file_path"]] = min(first.get(r["file_path"], (1 << 62, "")), (r["seq"], r["peer_id"]))
    want = []
    for path, own in held.items():
        lack = [p for p in live if p not in own]
        if path in first and lack:
            want += [(path, first[path][1], p) for p in lack[: max(1, math.ceil(len(lack) * 5 / 100))]]
    assert sorted(map(tuple, QUERIES["j14_seed_plan"](spark, sf).collect())) == sorted(want)
