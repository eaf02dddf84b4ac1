"""Pure folds of events whose outcome depends on earlier outcomes: a state and an event (a dict) give the next state and a row
to give out, or None. Batch operators run them over sorted rows, streams over keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

State = tuple
Fold = Callable[[State, dict], tuple[State, dict | None]]


def admit(gap_us: int) -> Fold:
    """W10, W11, I10."""

    def fold(state: State, e: dict) -> tuple[State, dict | None]:
        if state[0] < 0 or e["ts_us"] - state[0] >= gap_us:
            return (e["ts_us"],), {"seq": e["seq"]}
        return state, None

    return fold


def grant(state: State, e: dict) -> tuple[State, dict]:
    """State (holder, until)."""
    holder, until = state
    ttl = 10_000 if e["ttl_ms"] <= 0 else min(e["ttl_ms"], 60_000)
    mine = bool(holder) and holder == e["peer_id"]
    if e["op"] == "acquire" and (not holder or e["ts_us"] >= until or mine):
        return (e["peer_id"], e["ts_us"] + ttl * 1000), {"seq": e["seq"], "granted": True}
    if e["op"] == "release" and mine:
        return ("", 0), {"seq": e["seq"], "granted": True}
    return state, {"seq": e["seq"], "granted": False}


def average(alpha: float = 0.3) -> Fold:
    """State (ms, success, samples)."""

    def fold(state: State, e: dict) -> tuple[State, dict]:
        ms, ok, n = state
        x, y = e["ms"], float(e["ok"])
        ms, ok = (x, y) if n == 0 else (alpha * x + (1 - alpha) * ms, alpha * y + (1 - alpha) * ok)
        return (ms, ok, n + 1), {"seq": e["seq"], "latency_ms": ms, "success": ok, "samples": n + 1}

    return fold


def enter(capacity: int) -> Fold:
    """State (in flight,)."""

    def fold(state: State, e: dict) -> tuple[State, dict]:
        enters, full = e["delta"] > 0, state[0] >= capacity
        n = max(state[0] - 1, 0) if not enters else state[0] if full else state[0] + 1
        return (n,), {"seq": e["seq"], "accepted": not (enters and full), "enters": enters, "inflight": n}

    return fold


def refer(state: State, e: dict) -> tuple[State, dict]:
    """State (references,)."""
    n = state[0] + 1 if e["op"] == "create" else max(state[0] - 1, 0)
    return (n,), {"seq": e["seq"], "refs": n, "warm": e["op"] == "create" and n == 1}


def fold_sorted(events: DataFrame, keys: list[str], order: list[str], fold: Fold, first: State, out_type: str) -> DataFrame:
    """The rows that a fold gives out for each key's events in order. Keys are brought together and sorted by Spark, and pass
    by one row at a time, so a hot key needs no memory."""
    dealt = events.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, first
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, first
                state, given = fold(state, row)
                if given is not None:
                    out.append({**dict(zip(keys, now, strict=True)), **given})
            if out:
                yield pd.DataFrame(out)

    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out_type}")
