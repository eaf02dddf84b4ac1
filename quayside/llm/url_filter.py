"""URL filters by a temporal list join. Native: DataFrame functions only.

Dated list events (key, action add or remove, day) become validity intervals [from, to); a capture is held against the
entries active on the day of its fetch. A key is "h:" and a host or a parent domain, or "p:" and a host with a path prefix
that ends at a segment. Keys are matched by an equi-join on one row per key, which holds the key's intervals in order, so
a join never makes more rows than there are keys of captures. Captures of one key are dealt to parts, and its row goes to
each of them.

Edge cases: a null or unparsable URL has no key and is never blocked; an event with a null key, action or day is ignored;
of events of one key on one day the remove counts last; a remove with no add before it does nothing; a capture with a
null fetch day is never blocked; rows that repeat are kept; other columns are ignored; empty tables give no rows or no
blocked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
SALTS = 8  #: parts that the captures of one key are dealt to


def slashed(url: Column) -> Column:
    """Browsers read a backslash as a slash."""
    return F.translate(url, "\\", "/")


def host_of(url: Column) -> Column:
    """Without user and port, percent-decoded, lower case, without a leading www. or a final dot; null if there is none.
    An address in brackets keeps them."""
    authority = F.regexp_extract(slashed(url), SCHEME + r"([^/?#]*)", 1)
    after = F.regexp_replace(authority, r"^.*@", "")  # a user may hold an @ itself
    host = F.regexp_extract(after, r"^(\[[^\]]*\]|[^:]*)", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)
    host = F.regexp_replace(F.lower(F.when(host.contains("%"), plain).otherwise(host)), r"^www\.|\.$", "")
    return F.nullif(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(slashed(url), SCHEME + r"[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The host, its parent domains (not a bare last label), and the host with each path prefix, the whole path last."""
    labels, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, F.coalesce(prefixes, F.array().cast("array<string>")))))


def intervals(events: DataFrame) -> DataFrame:
    """(key, spans): for each key its validity intervals (from, to), to null while it is still on the list."""
    clean = events.select("key", "action", "day").where("key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    clean = clean.groupBy("key", "day").agg(F.max("action").alias("action"))  # remove sorts after add
    w = Window.partitionBy("key").orderBy("day")
    turned = clean.withColumn("was", F.lag("action").over(w)).where("action <> coalesce(was, 'remove')")
    spans = turned.withColumn("till", F.lead("day").over(w)).where("action = 'add'")
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("day").alias("from"), F.col("till").alias("to")))).alias("spans"))


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) with host, n_active (active entries that match), matched (the first of them), blocked."""
    rows = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("times"))  # repeated rows come back below
    rows = rows.withColumn("host", host_of(F.col("url")))
    keyed = rows.withColumn("key", F.explode_outer(keys_of(F.col("host"), path_of(F.col("url")))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(SALTS)).cast("int"))
    spans = intervals(events).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = F.exists("spans", lambda s: (s["from"] <= F.col("fetched")) & (s["to"].isNull() | (F.col("fetched") < s["to"])))
    hit = F.when(F.coalesce(active, F.lit(False)), F.col("key"))
    out = keyed.join(spans, ["key", "salt"], "left").groupBy("page_id", "url", "fetched", "host", "times")
    out = out.agg(F.count(hit).alias("n_active"), F.min(hit).alias("matched"))
    out = out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return out.select("page_id", "url", "host", "fetched", F.col("n_active").cast("bigint").alias("n_active"), "matched", (F.col("n_active") > 0).alias("blocked"))


def fetched_of(page_id: Column) -> Column:
    """The pages table has no fetch day; this gives each page one in 2024."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 37, F.lit(366)).cast("int"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list for the pages table: by md5, about a quarter of the hosts, and of host and first path segment, are
    added on a day of 2024, half of them removed 60 days later, and half of these added again after another 90."""
    host = host_of(F.col("url"))
    first = F.regexp_extract(path_of(F.col("url")), r"^/+([^/]+)", 1)
    keys = pages.select(F.explode(F.array(F.concat(F.lit("h:"), host), F.when(first != "", F.concat(F.lit("p:"), host, F.lit("/"), first)))).alias("key"))
    keys = keys.where("key IS NOT NULL").distinct()
    part = lambda at: F.conv(F.substring(F.md5("key"), at, 2), 16, 10).cast("int")
    keys = keys.withColumn("a", part(1)).withColumn("b", part(3)).withColumn("c", part(5)).where("a < 64")
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("b"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("day")),
        F.when(F.col("c") < 128, F.struct(F.lit("remove").alias("action"), F.date_add(start, 60).alias("day"))),
        F.when(F.col("c") < 64, F.struct(F.lit("add").alias("action"), F.date_add(start, 150).alias("day"))),
    )
    return keys.select("key", F.explode(events).alias("e")).where("e IS NOT NULL").select("key", "e.action", "e.day")
