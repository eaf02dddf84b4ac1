"""Queries of the scalar functions (survey section 2.H) over the logical tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions import scalars as S
from quayside.sources.adapters import logical, oracle

c = F.col


def h_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk names, parents and indexes, keys, strides and chunk counts of all replicas."""
    t = logical(spark, sf, "replicas")
    stride = S.stride_of(c("chunk_size"), 4 * S.MIB)
    return t.select(
        "file_path", "peer_id", "storage_tier", S.parent_path(c("file_path")).alias("parent"), S.chunk_index(c("file_path")).alias("chunk_index"),
        S.chunk_path(c("file_path"), F.lit(3)).alias("next_chunk"), S.is_chunk_name_s3(c("file_path")).alias("s3_chunk"), S.is_chunk_name_azure(c("file_path")).alias("azure_chunk"),
        S.object_key(c("file_path")).alias("object_key"), stride.alias("stride"), S.chunk_count(c("file_size"), stride).alias("chunk_count"),
    )


def h_clean_path(spark: SparkSession, sf: str) -> DataFrame:
    """H5, H6: paths with .., . and doubled slashes cleaned, and escaped for a URL."""
    t = logical(spark, sf, "read_events")
    raw = F.concat(c("path"), F.when(c("seq") % 3 == 0, "/../x y").when(c("seq") % 3 == 1, "//./a+b~").otherwise("/../../../.."))
    return t.select("seq", S.clean_path(raw).alias("clean"), S.escape_path(S.clean_path(raw)).alias("escaped"))


def h_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels parsed from text (malformed entries skipped), selected and renamed, and written in order."""
    t = logical(spark, sf, "peers")
    spec = F.concat(F.lit("zone="), c("zone"), F.lit(", pool = "), c("pool"), F.lit(",bad,=x,zone=z,extra=a=b"))
    labels = S.parse_labels(spec)
    return t.select("id", S.label_string(labels).alias("labels"), S.label_string(S.select_labels(labels, {"zone": "topology", "extra": ""})).alias("chosen"), S.label_string(c("labels")).alias("own"))


def h_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """FNV-1a of 32 and 64 bits, SHA-256 and base64."""
    t = logical(spark, sf, "peers")
    return t.select("id", S.fnv1a_32(c("id")).alias("fnv32"), S.fnv1a_64(c("id")).alias("inode"), S.checksum(c("address")).alias("sha256"), S.to_base64(F.encode("address", "UTF-8")).alias("b64"))


def h_times(spark: SparkSession, sf: str) -> DataFrame:
    """RFC 3339 times of nine digits, bad ones null; heartbeat ages; forgiving numbers."""
    t = logical(spark, sf, "peers")
    text = F.when(F.length("pool") == 2, "junk").otherwise(F.concat(F.lit("2024-01-30T23:59:"), F.substring("id", 9, 2), F.lit(".123456789Z")))
    text = F.when(F.substring("id", 9, 2).cast("int") > 59, F.lit("2024-13-01T00:00:00Z")).otherwise(text)
    age = F.timestamp_diff("MICROSECOND", "last_heartbeat", F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")) / 1e6
    return t.select("id", S.instant(text).alias("parsed_us"), age.alias("age_s"), F.coalesce(age, F.lit(0.0)).alias("age_or_0"), S.whole(F.substring("id", 6, 5)).alias("n"), S.whole(c("zone")).alias("bad"), S.real(F.concat(F.substring("id", 9, 2), F.lit(".5"))).alias("x"))


def h_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes for people, slices, parts, tiers, rates, pressure, targets, budgets and workers."""
    t = logical(spark, sf, "disks")
    k, cap, used = c("seq"), c("total_bytes"), c("total_bytes") - c("free_bytes")
    a, b = S.clamp_slice(k % 7 - 2, k % 11 - 3, k % 5)
    return t.select(
        "seq", S.human_bytes(c("total_bytes") * (k % 300) + k).alias("human"), a.alias("slice_from"), b.alias("slice_to"),
        S.part_size(F.lit(8 * S.MIB).cast("bigint"), c("total_bytes")).alias("part_size"), S.tier_name(k % 5).alias("tier"), S.tier_number(S.tier_name(k % 5)).alias("tier_number"),
        F.round(S.mib_per_second(c("free_bytes"), k * 1000000), 6).alias("mbps"), S.seconds_of(k).alias("seconds"),
        S.pressure(used, cap, used + 5, cap).alias("pressure"), S.eviction_target(used, cap, c("free_bytes"), cap + k).alias("evict_to"),
        S.range_budget(F.lit(64 * S.MIB).cast("bigint"), c("free_bytes")).alias("range_budget"), S.persist_workers(k % 200).alias("persist_workers"),
        S.cache_budget(c("free_bytes"), (k % 12) / 10.0, F.when(k % 3 == 0, F.lit(10 * S.GIB)).otherwise(F.lit(0)).cast("bigint")).alias("cache_budget"),
    )


def h_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Disk names and classes, lease TTLs, heat targets, label escapes, hosts, hedge delays."""
    t = logical(spark, sf, "disks")
    k, name = c("seq"), S.disk_name(c("device"))
    return t.select(
        "seq", name.alias("disk"), S.disk_class(name, F.when(k % 3 == 0, "0").when(k % 3 == 1, "1")).alias("class"),
        S.lease_ttl_ms((k % 9 - 2) * 10000).alias("ttl_ms"), S.heat_target(k % 11, k % 23).alias("heat_target"),
        S.unescape_label(F.concat(F.lit('a\\"b\\\\n\\n'), c("mount_point"))).alias("label"), S.host_part(F.concat(F.lit("10.0.0.1:"), k.cast("string"))).alias("host"), S.host_part(c("mount_point")).alias("no_port"),
        S.hedge_delay(F.lit(20.0), c("write_mbps") % 7, c("read_mbps") % 5).alias("hedge_ms"),
    )


QUERIES = {f.__name__: f for f in (h_paths, h_clean_path, h_labels, h_hashes, h_times, h_sizes, h_policy)}

_STRIDE = "CASE WHEN chunk_size > 0 THEN chunk_size ELSE 4194304 END"
ORACLES = {
    "h_paths": oracle(
        f"""
SELECT file_path, peer_id, storage_tier, nullif(regexp_extract(file_path, '^(.+)_chunk_([+-]?[0-9]+)$', 1), '') AS parent,
  TRY_CAST(nullif(regexp_extract(file_path, '^(.+)_chunk_([+-]?[0-9]+)$', 2), '') AS BIGINT) AS chunk_index, file_path || '_chunk_3' AS next_chunk,
  contains(file_path, '_chunk_') AS s3_chunk, regexp_matches(file_path, '_chunk_[0-9]+$') AS azure_chunk, ltrim(file_path, '/') AS object_key,
  CAST({_STRIDE} AS BIGINT) AS stride, CAST(CASE WHEN file_size <= 0 THEN 0 ELSE ceil(file_size / ({_STRIDE})) END AS BIGINT) AS chunk_count FROM replicas""",
        "replicas",
    ),
    "h_clean_path": oracle(
        """
SELECT seq, c AS clean, replace(replace(c, ' ', '%20'), '+', '%2B') AS escaped FROM (
  SELECT seq, CASE seq % 3 WHEN 0 THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/x y' WHEN 1 THEN path || '/a+b~' ELSE '/' END AS c FROM read_events)""",
        "read_events",
    ),
    "h_labels": oracle(
        "SELECT id, 'extra=a=b, pool=' || pool || ', zone=z' AS labels, 'extra=a=b, topology=z' AS chosen, 'pool=' || pool || ', zone=' || zone AS own FROM peers", "peers"
    ),
    "h_hashes": oracle(
        """
SELECT id, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS HUGEINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS BIGINT) AS fnv32,
  CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) AS inode, sha256(address) AS sha256, base64(encode(address)) AS b64
FROM (SELECT id, address, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) & 18446744073709551615) AS w FROM peers)""",
        "peers",
    ),
    "h_times": oracle(
        """
SELECT id, CASE WHEN CAST(id[9:10] AS INTEGER) > 59 OR pool = 'io' THEN NULL ELSE epoch_us(TIMESTAMP '2024-01-30 23:59:00') + CAST(id[9:10] AS BIGINT) * 1000000 + 123456 END AS parsed_us,
  date_diff('microsecond', last_heartbeat, TIMESTAMP '2024-01-31 00:00:00') / 1e6 AS age_s, coalesce(date_diff('microsecond', last_heartbeat, TIMESTAMP '2024-01-31 00:00:00') / 1e6, 0) AS age_or_0,
  CAST(id[6:] AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad, CAST(id[9:10] AS DOUBLE) + 0.5 AS x FROM peers""",
        "peers",
    ),
    "h_sizes": oracle(
        """
SELECT seq, CASE WHEN h < 1024 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || ' B' WHEN h < 1048576 THEN printf('%.1f KiB', h / 1024) WHEN h < 1024 ** 4 THEN printf('%.1f GiB', h / 1073741824) ELSE printf('%.1f TiB', h / 1099511627776) END AS human,
  least(greatest(seq % 7 - 2, 0), seq % 5) AS slice_from, greatest(least(greatest(seq % 7 - 2, 0), seq % 5), least(greatest(seq % 11 - 3, 0), seq % 5)) AS slice_to,
  greatest(8388608, CAST(ceil(CAST(total_bytes AS DOUBLE) / 10000) AS BIGINT)) AS part_size, CASE seq % 5 WHEN 1 THEN 'nvme' WHEN 2 THEN 'peer' ELSE 'cloud' END AS tier,
  CASE seq % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS tier_number,
  round(CASE WHEN free_bytes <= 0 OR seq <= 0 THEN 0 ELSE CAST(free_bytes AS DOUBLE) / 1048576 / (CAST(seq * 1000000 AS DOUBLE) / 1e9) END, 6) AS mbps, CAST(seq AS DOUBLE) / 1e9 AS seconds,
  greatest(used * 100 // total_bytes, (used + 5) * 100 // total_bytes) AS pressure,
  CASE WHEN greatest(used * 100 // total_bytes, (used + seq) * 100 // (total_bytes + seq)) < 85 THEN NULL WHEN used > total_bytes * 75 // 100 THEN total_bytes * 75 // 100
    WHEN used * 10 > total_bytes + seq THEN used * 75 // 85 END AS evict_to,
  greatest(67108864, least(268435456, free_bytes // 4)) AS range_budget,
  CASE WHEN seq % 200 > 0 THEN least(least(greatest(4, (seq % 200) // 8), 16), seq % 200) ELSE 4 END AS persist_workers,
  CASE WHEN seq % 3 = 0 AND 10737418240 < o THEN 10737418240 ELSE o END AS cache_budget
FROM (SELECT *, CAST(total_bytes * (seq % 300) + seq AS DOUBLE) AS h, total_bytes - free_bytes AS used,
  CAST(floor(CAST(free_bytes AS DOUBLE) * CASE WHEN seq % 12 BETWEEN 1 AND 9 THEN CAST(seq % 12 AS DOUBLE) / CAST(10 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END) AS BIGINT) AS o FROM disks)""",
        "disks",
    ),
    "h_policy": oracle(
        r"""
SELECT seq, n AS disk, CASE WHEN n LIKE 'nvme%' THEN 'nvme' WHEN seq % 3 = 0 THEN 'ssd' WHEN seq % 3 = 1 THEN 'disk' ELSE 'unknown' END AS class,
  CASE WHEN seq % 9 <= 2 THEN 10000 ELSE least((seq % 9 - 2) * 10000, 60000) END AS ttl_ms,
  CASE WHEN seq % 11 >= 8 THEN seq % 11 ELSE least(seq % 11 + (seq % 23) // 2, 8) END AS heat_target, 'a"b\n' || chr(10) || mount_point AS label, '10.0.0.1' AS host, mount_point AS no_port,
  greatest(CASE WHEN p > 0 AND s > 0 AND p >= s * 1.25 THEN 40 WHEN p > 0 AND s > 0 AND p <= s * 0.75 THEN 10 ELSE CAST(20 AS DOUBLE) END, 2) AS hedge_ms
FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 'nvme' || (seq % 8) || 'n1' WHEN 1 THEN 'sda' WHEN 2 THEN 'mmcblk0' WHEN 3 THEN 'xvdb' ELSE 'tmpfs' END AS n, write_mbps % 7 AS p, read_mbps % 5 AS s FROM disks)""",
        "disks",
    ),
}
