"""Admission over a stream of requests: the folds of the batch operator with kept state.

State is at most ``limit`` admitted times (sliding), one window (fixed) or both (failover) per client.  Clients are dealt by
a hash to so many groups that share a row of the state store and a call of the fold, as a call for each client costs
far more than its requests do.  A
client's requests are taken in time order within a micro-batch; a request that arrives
in a later batch than a newer one is judged at the state it meets.  With a watermark,
requests that are later than it are dropped and a client's state goes once the watermark
has passed its window, at the next request of its group or when that of the whole group is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.operators.admission import UNKNOWN_CLIENT, Failover, FixedWindow, SlidingLog

NEVER = -(1 << 62)


#: Groups of clients, fixed for a stream's life: its state is kept by them.
GROUPS = 1024


def _gate(mode: str, limit: int, window: int, kept: list[int]) -> SlidingLog | FixedWindow | Failover:
    if mode == "sliding":
        return SlidingLog(limit, window, kept)
    if mode == "fixed":
        return FixedWindow(limit, window, *(kept or (None, 0)))
    return Failover(limit, window, *(kept[:2] or (None, 0)), kept[2:])


def _kept(gate: SlidingLog | FixedWindow | Failover) -> list[int]:
    if isinstance(gate, SlidingLog):
        return list(gate.admitted)
    if isinstance(gate, FixedWindow):
        return [gate.opened, gate.count]
    # A window that no request has opened is kept as one that is long over.
    return [NEVER if gate.shared.opened is None else gate.shared.opened, gate.shared.count, *gate.local.admitted]


def admit_stream(requests: DataFrame, limit: int = 30, window_seconds: float = 60.0, mode: str = "sliding", delay: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """A stream of (request_id, client, ts, and down for mode failover) to (request_id, client, allowed)."""
    window = int(window_seconds * 1_000_000)
    over_after = int(window_seconds * 1000) + 1

    def fold(_key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[str, tuple[int, list[int]]] = {}
        if state.exists:
            clients, until, sizes, kept = state.get
            at = 0
            for client, end, n in zip(clients, until, sizes, strict=True):
                held[client] = end, list(kept[at : at + n])
                at += n
        rows = pd.concat(list(batches)).sort_values(["client", "at", "request_id"])
        allowed, last, gate = [], None, None
        for client, t, off in zip(rows["client"].tolist(), rows["at"].tolist(), rows["down"].tolist(), strict=True):
            if client != last:
                if gate is not None:
                    held[last] = end, _kept(gate)
                last, gate = client, _gate(mode, limit, window, held[client][1] if client in held else [])
            allowed.append(gate.allow(t, off) if mode == "failover" else gate.allow(t))
            end = t // 1000 + over_after
        held[last] = end, _kept(gate)
        passed = state.getCurrentWatermarkMs()
        held = {c: x for c, x in held.items() if x[0] > passed}
        if held:
            state.update((list(held), [end for end, _ in held.values()], [len(k) for _, k in held.values()], [t for _, k in held.values() for t in k]))
            state.setTimeoutTimestamp(max(end for end, _ in held.values()))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"request_id": rows["request_id"], "client": rows["client"], "allowed": allowed})

    timed = requests.withWatermark("ts", delay).select(
        F.col("request_id").cast("long").alias("request_id"), F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN_CLIENT)).alias("client"), "ts", F.unix_micros("ts").alias("at"),
        (F.coalesce(F.col("down"), F.lit(False)) if mode == "failover" else F.lit(False)).alias("down"),
    )
    dealt = timed.withColumn("dealt", F.pmod(F.xxhash64("client"), F.lit(groups)).cast("int"))
    return dealt.groupBy("dealt").applyInPandasWithState(fold, "request_id long, client string, allowed boolean", "clients array<string>, until array<long>, sizes array<int>, kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)
