"""The few spellings in which Spark SQL and the oracle's SQL differ, so that an adapter is one text for both."""

from __future__ import annotations


class Spark:
    text = "STRING"

    @staticmethod
    def table(name: str) -> str:
        return "{" + name + "}"

    @staticmethod
    def seconds(x: str) -> str:
        return f"make_dt_interval(0, 0, 0, {x})"

    @staticmethod
    def micros(ts: str) -> str:
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"

    @staticmethod
    def at(literal: str) -> str:
        return f"TIMESTAMP_NTZ '{literal}'"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def labels(**kv: str) -> str:
        return "map(" + ", ".join(f"'{k}', {v}" for k, v in kv.items()) + ")"

    @staticmethod
    def chunk_list(n: str) -> str:
        return f"CASE WHEN {n} > 0 THEN transform(sequence(0, CAST({n} AS INT) - 1), i -> named_struct('index', i, 'peer_id', peer_id, 'chunk_id', file_path || '_chunk_' || CAST(i AS STRING))) ELSE CAST(array() AS ARRAY<STRUCT<index: INT, peer_id: STRING, chunk_id: STRING>>) END"

    @staticmethod
    def explode(expr: str) -> str:
        return f"explode({expr})"

    @staticmethod
    def last_rows(rows: str, n: str, part: str) -> str:
        """By numbers alone, in buffers of fixed width, so that rows are summed before the shuffle."""
        return f"""(SELECT last div 10 AS l_orderkey, l_partkey, l_suppkey, CAST(last % 10 AS INT) AS l_linenumber, l_shipdate, first_seq, part, tier
  FROM (SELECT l_partkey, l_suppkey, {part} AS part, l_linenumber % 3 AS tier, min({n}) AS first_seq, max({n}) AS last, max_by(l_shipdate, {n}) AS l_shipdate FROM {rows} GROUP BY ALL) g) v"""


class Duck:
    text = "VARCHAR"

    @staticmethod
    def table(name: str) -> str:
        return name

    @staticmethod
    def seconds(x: str) -> str:
        return f"to_seconds({x})"

    @staticmethod
    def micros(ts: str) -> str:
        return f"epoch_us({ts})"

    @staticmethod
    def at(literal: str) -> str:
        return f"TIMESTAMP '{literal}'"

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def labels(**kv: str) -> str:
        return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in kv.items()) + "}"

    @staticmethod
    def chunk_list(n: str) -> str:
        return f"list_transform(range({n}), lambda i: {{'index': CAST(i AS INTEGER), 'peer_id': peer_id, 'chunk_id': file_path || '_chunk_' || i}})"

    @staticmethod
    def explode(expr: str) -> str:
        return f"unnest({expr})"

    @staticmethod
    def last_rows(rows: str, n: str, part: str) -> str:
        w = f"PARTITION BY l_partkey, {part}, l_suppkey, l_linenumber % 3"
        return f"""(SELECT * FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, {part} AS part, l_linenumber % 3 AS tier, min({n}) OVER ({w}) AS first_seq,
  row_number() OVER ({w} ORDER BY {n} DESC, l_shipdate DESC, l_linenumber DESC) AS rn FROM {rows}) u WHERE rn = 1) v"""
