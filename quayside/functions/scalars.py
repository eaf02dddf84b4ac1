"""Scalar functions of the fleet's data: paths, labels, hashes, sizes and policies, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
GIB = 1024 * MIB


def lit(x) -> Column:  # noqa: ANN001
    return x if isinstance(x, Column) else F.lit(x)


def idiv(a: Column, b) -> Column:  # noqa: ANN001
    """Whole division toward zero, of integers."""
    return F.call_function("div", a, lit(b))


# --- paths -------------------------------------------------------------------------------------------------------------


def chunk_path(path: Column, index: Column) -> Column:
    """H1."""
    return F.concat(path, F.lit("_chunk_"), index.cast("string"))


_CHUNK = r"(?s)^(.+)_chunk_([+-]?[0-9]{1,19})$"


def chunk_index(path: Column) -> Column:
    """H3: the number after the last _chunk_, null where there is none, nothing stands before it or it leaves int64."""
    return F.when(F.contains(path, F.lit("_chunk_")), F.regexp_extract(path, _CHUNK, 2).try_cast("bigint"))  # most paths have no mark


def parent_path(path: Column) -> Column:
    """H2: the path of the file that a chunk belongs to; null for what is no chunk."""
    return F.when(chunk_index(path).isNotNull(), F.regexp_extract(path, _CHUNK, 1))


def owner_path(path: Column) -> Column:
    """The parent of a chunk, else the path itself."""
    return F.coalesce(parent_path(path), path)


def is_chunk_name_s3(path: Column) -> Column:
    """H4: an object store that only looks for the mark."""
    return F.contains(path, F.lit("_chunk_"))


def is_chunk_name_azure(path: Column) -> Column:
    """H4: an object store that wants digits after the last mark."""
    return path.rlike(r"(?s)_chunk_[0-9]+$")


def clean_path(path: Column) -> Column:
    """H5: rooted at /, without empty, . and .. segments."""
    steps = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def escape_path(path: Column) -> Column:
    """H6: each segment percent-encoded for a URL; a space is %20."""
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))), "/")


def object_key(path: Column) -> Column:
    """H7: without one leading /."""
    return F.regexp_replace(path, "^/", "")


def host_part(reader: Column) -> Column:
    """Host of host:port, else all."""
    return F.coalesce(F.nullif(F.regexp_extract(reader, r"^(.*):[^:]*$", 1), F.lit("")), reader)


# --- labels ------------------------------------------------------------------------------------------------------------


def parse_labels(spec: Column) -> Column:
    """H8: k=v,k=v to a map; entries without a key or = are skipped, spaces trimmed, the last of equal keys wins."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: F.instr(x, "=") > 1)
    pair = F.transform(parts, lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))
    pair = F.filter(pair, lambda e: e["key"] != "")
    last = F.filter(pair, lambda e, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def select_labels(labels: Column, spec: dict[str, str]) -> Column:
    """H9: the labels named by the keys of spec, under its values' names (empty: the same name)."""
    kept = F.map_filter(labels, lambda k, v: k.isin(*spec))
    names = F.create_map(*[F.lit(x) for k, v in spec.items() for x in (k, v or k)])
    return F.transform_keys(kept, lambda k, v: F.element_at(names, k))


def union_labels(a: Column, b: Column) -> Column:
    """Labels of both, those of b where both have one."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def label_string(labels: Column) -> Column:
    """Sorted 'k=v, k=v'."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def has_labels(labels: Column, want: dict[str, str]) -> Column:
    """All wanted pairs are there; a wanted empty value also fits a missing label."""
    out = F.lit(True)
    for k, v in want.items():
        out = out & (F.coalesce(F.element_at(labels, F.lit(k)), F.lit("")) == F.lit(v))
    return out


# --- hashes and encodings ----------------------------------------------------------------------------------------------


def _bytes(text: Column) -> Column:
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = F.length(hexed) / 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a_32(text: Column) -> Column:
    """H11, as a non-negative bigint."""
    return F.aggregate(_bytes(text), F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def fnv1a_64(text: Column) -> Column:
    """Of the 64-bit hash, as a signed bigint, 0 replaced by 1. The multiplier is 2^40 + 435, so the product is taken
    in halves that stay within int64 whether or not overflow is an error."""
    mask = F.lit(4294967295)
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        lo = s["lo"].bitwiseXOR(b)
        low = lo * 435
        hi = s["hi"] * 435 + F.shiftright(low, 32) + lo * 256
        return F.struct(hi.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    done = F.aggregate(_bytes(text), start, step)
    value = F.shiftleft(done["hi"], 32).bitwiseOR(done["lo"])
    return F.when(value == 0, F.lit(1).cast("bigint")).otherwise(value)


def checksum(data: Column) -> Column:
    """H13."""
    return F.sha2(data, 256)


def to_base64(data: Column) -> Column:
    """Without line ends."""
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


# --- numbers and sizes -------------------------------------------------------------------------------------------------


def chunk_count(size: Column, stride: Column) -> Column:
    """How many strides cover a size; 0 where either is not positive."""
    return F.when((size <= 0) | (stride <= 0), F.lit(0).cast("bigint")).otherwise(idiv(size + stride - 1, stride))


def stride_of(chunk_size: Column, default: int) -> Column:
    """H20."""
    return F.when(chunk_size > 0, chunk_size).otherwise(F.lit(default).cast("bigint"))


def clamp_slice(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """A slice within 0..n with start <= end; an end before the start becomes the start."""
    a = F.least(F.greatest(start, F.lit(0).cast("bigint")), n)
    b = F.least(F.greatest(end, F.lit(0).cast("bigint")), n)
    return F.least(a, n), F.greatest(a, b)


def part_size(configured: Column, size: Column, parts: int = 10_000) -> Column:
    """Large enough that a size fits the number of parts."""
    return F.greatest(configured, idiv(size + parts - 1, parts))


def tier_name(tier: Column) -> Column:
    """Of the number; unknown ones are cloud."""
    return F.when(tier == 1, "nvme").when(tier == 2, "peer").otherwise("cloud")


def tier_number(name: Column) -> Column:
    return F.when(name == "nvme", 1).when(name == "peer", 2).otherwise(3)


def storage_of(tier: Column) -> Column:
    """The store that serves a tier's number; unknown ones are served by the fast one."""
    return F.when(tier == 2, "peer").when(tier == 3, "cloud").otherwise("nvme")


def jittered(x: Column, share: float = 0.5, seed: int = 1) -> Column:
    """X less or more by up to a share, at random."""
    return x * (1.0 - share + 2 * share * F.rand(seed))


def mib_per_second(size: Column, nanos: Column) -> Column:
    """0 where nothing was read or no time passed."""
    return F.when((size <= 0) | (nanos <= 0), F.lit(0.0)).otherwise(size.cast("double") / MIB / (nanos.cast("double") / 1e9))


def seconds_of(nanos: Column) -> Column:
    """H25."""
    return nanos.cast("double") / 1e9


def percent(used: Column, capacity: Column) -> Column:
    return F.when(capacity <= 0, F.lit(0).cast("bigint")).otherwise(idiv(used * 100, capacity))


def pressure(used: Column, capacity: Column, disk_used: Column, disk_total: Column) -> Column:
    """The higher of the cache's own and the device's fill, in whole percent."""
    return F.greatest(percent(used, capacity), percent(disk_used, disk_total))


def eviction_target(used: Column, capacity: Column, disk_free: Column, disk_total: Column, low: int = 75, high: int = 85) -> Column:
    """The size to evict down to, null where nothing is to do: low percent of capacity; where the cache is below that
    and only the device is full, low / high of what the cache holds, if that is over a tenth of the device."""
    fill = pressure(used, capacity, disk_total - disk_free, disk_total)
    own = idiv(capacity * low, 100)
    share = F.when((disk_total > 0) & (used * 10 > disk_total), idiv(used * low, high))
    return F.when(fill < high, F.lit(None).cast("bigint")).when(used > own, own).otherwise(share)


def range_budget(per_file: Column, ram: Column) -> Column:
    """H28."""
    return F.greatest(per_file, F.least(per_file * 4, idiv(ram, 4)))


def persist_workers(chunks: Column, least: int = 4, most: int = 16) -> Column:
    """One for eight chunks, within bounds, and no more than there are chunks."""
    n = F.least(F.greatest(F.lit(least).cast("bigint"), idiv(chunks, 8)), F.lit(most).cast("bigint"))
    return F.when((chunks > 0) & (n > chunks), chunks).otherwise(n)


def cache_budget(free: Column, fraction: Column, cap: Column, default: float = 0.8) -> Column:
    """H30."""
    part = F.when((fraction > 0) & (fraction <= 0.95), fraction).otherwise(F.lit(default))
    own = F.floor(free.cast("double") * part).cast("bigint")
    return F.when((cap > 0) & (cap < own), cap).otherwise(own)


def disk_name(device: Column) -> Column:
    """The disk of a partition, without /dev/."""
    base = F.regexp_replace(device, "^/dev/", "")
    return F.when(base.rlike(r"^(nvme|mmcblk|nbd|loop)"), F.regexp_replace(base, r"(?<=[0-9])p[0-9]+$", "")).otherwise(F.regexp_replace(base, r"(?<=[a-z])[0-9]+$", ""))


def disk_class(name: Column, rotational: Column) -> Column:
    """H31."""
    return F.when(F.startswith(name, F.lit("nvme")), "nvme").when(rotational == "0", "ssd").when(rotational == "1", "disk").otherwise("unknown")


def lease_ttl_ms(ttl: Column, default: int = 10_000, most: int = 60_000) -> Column:
    """H32."""
    return F.when(ttl <= 0, F.lit(default).cast("bigint")).otherwise(F.least(ttl, F.lit(most).cast("bigint")))


def heat_target(base: Column, readers: Column, per: int = 2, most: int = 8) -> Column:
    """A replica more for every few readers, up to most; a base over that stays."""
    return F.when(base >= most, base).otherwise(F.least(base + idiv(readers, per), F.lit(most).cast("bigint")))


def tenths(x: Column) -> Column:
    """x, 0 or more, in whole tenths, exact ties to the even one, as C and Python print them; Spark's formats take ties up. The
    fraction is cut in two, so that ten times each part is exact."""
    r = x - F.floor(x)
    high = F.floor(r * float(1 << 26)) / float(1 << 26)
    whole = F.floor(high * 10)
    rest = (high * 10 - whole) + (r - high) * 10
    return F.floor(x) * 10 + whole + F.when(rest == 0.5, whole % 2).otherwise(F.rint(rest).cast("bigint"))


def human_bytes(n: Column) -> Column:
    """H17."""
    value, out = n.cast("double"), None
    sign = F.when(value < 0, "-").otherwise("")
    for power, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB", "PiB")):
        t = tenths(F.abs(value) / float(1024**power))
        text = F.format_string("%.0f B", F.rint(value)) if power == 0 else F.format_string(f"%s%d.%d {unit}", sign, idiv(t, 10), t % 10)
        fits = F.abs(value) < float(1024 ** (power + 1))
        out = F.when(fits, text) if out is None else (out.when(fits, text) if unit != "PiB" else out.otherwise(text))
    return out


def whole(text: Column) -> Column:
    """A forgiving integer; what can't be read is 0."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def real(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def instant(text: Column) -> Column:
    """Microseconds of an RFC 3339 time with up to nine digits of fraction; null where it is none."""
    ok = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(ok, F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1"))))


def hedge_delay(delay_ms: Column, primary: Column, secondary: Column, least: float = 2.0) -> Column:
    """Twice the wait for a primary of 1.25 times the speed or more, half for one of 0.75 or less; unknown speeds keep it."""
    known = (primary > 0) & (secondary > 0)
    out = F.when(known & (primary >= secondary * 1.25), delay_ms * 2).when(known & (primary <= secondary * 0.75), delay_ms / 2).otherwise(delay_ms)
    return F.greatest(out, F.lit(least))


def unescape_label(text: Column) -> Column:
    """H35: \\n, \\" and \\\\ of a metric label."""
    mark = F.lit("\u0000")
    out = F.replace(text, F.lit("\\\\"), mark)
    return F.replace(F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), mark, F.lit("\\"))
