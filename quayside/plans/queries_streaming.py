"""Streaming queries (survey 2.I): each runs its stream over the data once and gives what came out, with batch oracles.

A stream's rows can't be given as a lazy result, so a query reads the logical table's files as a stream, runs it until all is
read (availableNow) into Parquet of the shared folder, and returns that."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.plans.queries_catalog import at
from quayside.plans.queries_ordered import ORACLES as ORDERED
from quayside.sources.adapters import logical, oracle
from quayside.streaming import state

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/quayside-stream-{uuid.uuid4().hex}"


_WAITING: dict[str, list[DataFrame]] = {}  #: by folder, the steps of time that a stream has still to read


def as_stream(spark: SparkSession, table: DataFrame, base: str, steps: int = 4) -> DataFrame:
    """The table as a stream that reads a few steps of time, one after another."""
    seconds = table.withColumn("__s", F.timestamp_diff("SECOND", at("1970-01-01 00:00:00"), c("ts")))
    ends = [None, *sorted(set(seconds.approxQuantile("__s", [i / steps for i in range(1, steps)], 0.01))), None]
    between = lambda low, high: (seconds if low is None else seconds.where(c("__s") >= low)).where(F.lit(True) if high is None else c("__s") < high)
    _WAITING[base] = [between(low, high).drop("__s") for low, high in zip(ends, ends[1:])]
    _WAITING[base].pop(0).write.parquet(f"{base}/in")
    return spark.readStream.schema(table.schema).parquet(f"{base}/in")


def all_steps(writer, base: str):  # noqa: ANN001, ANN201
    """Runs a stream over each step as it comes in; its state goes on from one run to the next. The last run."""
    while True:
        q = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        if not _WAITING[base]:
            del _WAITING[base]
            return q
        _WAITING[base].pop(0).write.mode("append").parquet(f"{base}/in")


def run(out: DataFrame, base: str) -> DataFrame:
    all_steps(out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out"), base)
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def run_updates(out: DataFrame, base: str) -> DataFrame:
    """What a stream in update mode gave out, batch by batch; a batch that runs again replaces its rows."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/n={number}")
    all_steps(out.writeStream.foreachBatch(write).outputMode("update"), base)
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def _us():  # noqa: ANN202
    return F.timestamp_diff("MICROSECOND", at("1970-01-01 00:00:00"), c("ts"))


def _with_time(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The logical table with its event's time; tables with only ts_us take it from there."""
    t = logical(spark, sf, name)
    if "ts" not in t.columns:
        events = spark.read.parquet(f"{sf}/events.parquet").select(c("event_id").alias("seq"), "ts")
        t = t.join(events, "seq")
    return t if "ts_us" in t.columns else t.withColumn("ts_us", _us())


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(ORDERED["i7_leases"])
def i7_lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    """I7."""
    base = folder(spark)
    return run(state.lease_stream(as_stream(spark, _with_time(spark, sf, "lease_requests"), base)), base)


@query(ORDERED["w10_admitted"])
def i10_admitted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """I10, W10, W11."""
    base = folder(spark)
    return run(state.admitted_stream(as_stream(spark, _with_time(spark, sf, "read_events"), base), "path", 129_600_000_000), base)


@query(
    oracle(
        """, smp AS (SELECT node || '/' || tier AS key, ts, seq, nanos / 1e6 AS ms, CAST(outcome = 'ok' AS DOUBLE) AS ok FROM read_events WHERE tier IN ('peer', 'cloud') AND outcome IN ('ok', 'error'))
SELECT key, round(list_reduce(list(ms ORDER BY ts, seq), lambda a, x: 0.3 * x + 0.7 * a), 6) AS latency_ms, round(list_reduce(list(ok ORDER BY ts, seq), lambda a, x: 0.3 * x + 0.7 * a), 6) AS success, count(*) AS samples FROM smp GROUP BY key""",
        "read_events",
    )
)
def i5_ewma_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The last averages of each tier of a node."""
    base = folder(spark)
    t = _with_time(spark, sf, "read_events").where("tier IN ('peer', 'cloud') AND outcome IN ('ok', 'error')")
    t = t.select(F.concat("node", F.lit("/"), "tier").alias("key"), "ts", "seq", "ts_us", (c("nanos") / 1e6).alias("ms"), (c("outcome") == "ok").alias("ok"))
    out = run(state.ewma_stream(as_stream(spark, t, base), "key"), base)
    last = lambda x: F.round(F.max_by(x, "samples"), 6).alias(x)
    return out.groupBy("key").agg(last("latency_ms"), last("success"), F.max("samples").alias("samples"))


@query(
    oracle(
        """, d AS (SELECT node, seq, CASE WHEN seq % 5 < 3 THEN 1 ELSE -1 END AS delta, row_number() OVER (PARTITION BY node ORDER BY ts, seq) AS i FROM read_events),
f(node, i, now, acc, rej) AS (SELECT node, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT node FROM d)
  UNION ALL SELECT d.node, d.i, CASE WHEN delta < 0 THEN greatest(now - 1, 0) WHEN now < 8 THEN now + 1 ELSE now END, acc + CASE WHEN delta > 0 AND now < 8 THEN 1 ELSE 0 END, rej + CASE WHEN delta > 0 AND now >= 8 THEN 1 ELSE 0 END FROM f JOIN d ON d.node = f.node AND d.i = f.i + 1)
SELECT node, max(acc) AS accepted, max(rej) AS rejected FROM f GROUP BY node""",
        "read_events",
    )
)
def i13_gate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """I13."""
    base = folder(spark)
    t = _with_time(spark, sf, "read_events").select("node", "ts", "seq", "ts_us", F.when(c("seq") % 5 < 3, 1).otherwise(-1).alias("delta"))
    out = run(state.gate_stream(as_stream(spark, t, base), "node", 8), base).join(t.select("seq", "delta"), "seq").where("delta > 0")
    return out.groupBy("node").agg(F.count(F.when(c("accepted"), 1)).alias("accepted"), F.count(F.when(~c("accepted"), 1)).alias("rejected"))


@query(ORDERED["i15_session_counts"])
def i15_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """I15."""
    base = folder(spark)
    out = run(state.session_stream(as_stream(spark, _with_time(spark, sf, "sessions"), base)), base)
    return out.groupBy("volume_id").agg(F.max_by("refs", "seq").alias("refs"), F.count(F.when(c("warm"), 1)).alias("warm_starts"))


@query(
    oracle(
        """SELECT peer_id, arg_max(status, seq) AS status, coalesce(arg_max(network_speed_mbps, seq) FILTER (network_speed_mbps > 0), 0) AS network_speed_mbps, coalesce(arg_max(network_latency_ms, seq) FILTER (network_latency_ms > 0), 0) AS network_latency_ms FROM heartbeats GROUP BY peer_id""",
        "heartbeats",
    )
)
def i1_peer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """I1, I2."""
    base = folder(spark)
    t = logical(spark, sf, "heartbeats").select("peer_id", "ts", "seq", "status", "network_speed_mbps", "network_latency_ms")
    out = run_updates(state.peer_stream(as_stream(spark, t, base)), base)
    last = lambda x: F.max_by(x, "seq").alias(x)
    return out.groupBy("peer_id").agg(last("status"), last("network_speed_mbps"), last("network_latency_ms"))


_CLOSED = "(SELECT max(ts) FROM {t}) - INTERVAL 10 MINUTE"


@query(
    oracle(
        f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, node, tier, count(*) AS reads, CAST(sum(bytes) AS BIGINT) AS bytes FROM read_events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= {_CLOSED.format(t="read_events")}""", "read_events"
    )
)
def i12_tumbling_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Hours that the watermark has closed."""
    base = folder(spark)
    return run(state.tumbling_reads(as_stream(spark, logical(spark, sf, "read_events"), base)), base)


@query(
    oracle(
        f""", w AS (SELECT DISTINCT unnest(range(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, ts + INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS begins, regexp_replace(path, '_chunk_[0-9]+$', '') AS path, split_part(reader, ':', 1) AS host FROM remote_reads)
SELECT begins, path, count(*) AS readers FROM w WHERE begins + INTERVAL 1 DAY <= {_CLOSED.format(t="remote_reads")} GROUP BY begins, path""",
        "remote_reads",
    )
)
def i4_reader_windows(spark: SparkSession, sf: str) -> DataFrame:
    """I4: a day's distinct readers every six hours, closed windows only."""
    base = folder(spark)
    return run(state.reader_windows(as_stream(spark, logical(spark, sf, "remote_reads").select("ts", "path", "reader"), base), "1 day", "6 hours"), base)


@query(
    oracle(
        f""", g AS (SELECT path, ts, seq, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, seq) < 51840000000 THEN 0 ELSE 1 END AS b FROM read_events),
i AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT path, min(ts) AS begins, max(ts) AS last_read, count(*) AS reads FROM i GROUP BY path, i HAVING max(ts) + INTERVAL 51840 SECOND <= {_CLOSED.format(t="read_events")}""",
        "read_events",
    )
)
def i6_idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Closed sessions."""
    base = folder(spark)
    return run(state.idle_sessions(as_stream(spark, logical(spark, sf, "read_events"), base), "51840 seconds"), base)


@query(oracle("SELECT file_path, peer_id, storage_tier, seq, file_size FROM replicas", "replicas"))
def i3_replica_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of locations merged into versions of the catalog."""
    base = folder(spark)
    t = logical(spark, sf, "file_locations").select("file_path", "peer_id", "storage_tier", "file_size", "last_accessed", "seq", F.timestamp_seconds("seq").cast("timestamp_ntz").alias("ts"))
    stream = as_stream(spark, t, base, 3).drop("ts")
    all_steps(stream.writeStream.foreachBatch(state.upsert_replicas_batch(f"{base}/catalog")), base)
    return state.read_catalog(spark, f"{base}/catalog").select("file_path", "peer_id", "storage_tier", "seq", "file_size")
