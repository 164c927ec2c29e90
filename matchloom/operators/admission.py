"""Per-client admission over a request history (J1 to J4, E12, F4), through outages of the shared counter.

Whether a request is let in depends on earlier decisions, so each client's requests are
folded in time order.  Partitions are sorted by client and time and streamed through the
fold batch by batch; what is held is one client's window state, however long the history.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_CLIENT = "unknown"


class SlidingLog:
    """At most ``limit`` admitted requests in any window; denied ones leave no trace."""

    def __init__(self, limit: int, window: int, admitted: list[int] | None = None) -> None:
        self.limit, self.window, self.admitted = limit, window, deque(admitted or ())

    def allow(self, now: int) -> bool:
        while self.admitted and now - self.admitted[0] >= self.window:
            self.admitted.popleft()
        if len(self.admitted) >= self.limit:
            return False
        self.admitted.append(now)
        return True


class FixedWindow:
    """At most ``limit`` requests in a window that the first one opens; denied ones count too."""

    def __init__(self, limit: int, window: int, opened: int | None = None, count: int = 0) -> None:
        self.limit, self.window, self.opened, self.count = limit, window, opened, count

    def allow(self, now: int) -> bool:
        if self.opened is None or now - self.opened >= self.window:
            self.opened, self.count = now, 0
        self.count += 1
        return self.count <= self.limit


class Failover:
    """The fixed window while the shared counter answers, the local log while it is down.

    Each keeps its own state while the other decides: a window that was open before an outage goes on after it,
    and the log of one outage still counts in the next.
    """

    def __init__(self, limit: int, window: int, opened: int | None = None, count: int = 0, admitted: list[int] | None = None) -> None:
        self.shared, self.local = FixedWindow(limit, window, opened, count), SlidingLog(limit, window, admitted)

    def allow(self, now: int, down: bool = False) -> bool:
        return self.local.allow(now) if down else self.shared.allow(now)


MODES: dict[str, Callable[[int, int], SlidingLog | FixedWindow | Failover]] = {"sliding": SlidingLog, "fixed": FixedWindow, "failover": Failover}


def mark_outages(requests: DataFrame, outages: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """requests with ``down``: whether its time lies in an outage (began, ended: from the first, before the second).

    A time is in one if the latest end of all outages that began until then lies behind it, so outages may overlap.  That end
    is carried along in time order, slice by slice, with what a slice starts with from one row for each slice before it.
    A request without a time is in none.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    begun = outages.select(micros("began").alias("_at"), F.lit(0).alias("_side"), micros("ended").alias("_ended")).where("_at IS NOT NULL")
    asked = requests.select(micros("ts").alias("_at"), F.lit(1).alias("_side"), F.struct(*requests.columns).alias("_row"))
    both = begun.unionByName(asked, allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_at") / (slice_seconds * 1_000_000)))
    ends = both.groupBy("_slice").agg(F.max("_ended").alias("_last"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    carried = ends.select(F.col("_slice").alias("_s"), F.max("_last").over(earlier).alias("_before"))
    here = Window.partitionBy("_slice").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.max("_ended").over(here)).where("_side = 1").join(carried, F.col("_slice") == F.col("_s"), "left")
    down = F.coalesce(F.col("_at") < F.greatest("_last", "_before"), F.lit(False))
    return seen.select("_row.*", down.alias("down"))


def admit(requests: DataFrame, limit: int = 30, window_seconds: float = 60.0, mode: str = "sliding") -> DataFrame:
    """requests (request_id, client, ts, and down for mode failover) with allowed; ties in time go by request_id, a null client is one client, a null down is false."""
    make, window = MODES[mode], int(window_seconds * 1_000_000)
    down = F.coalesce(F.col("down"), F.lit(False)) if mode == "failover" else F.lit(False)
    rows = requests.select(
        F.col("request_id").cast("long").alias("request_id"),
        F.coalesce(F.col("client").cast("string"), F.lit(UNKNOWN_CLIENT)).alias("client"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        down.alias("down"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, state = None, None
        for batch in batches:
            allowed = []
            for who, at, off in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if who != client:
                    client, state = who, make(limit, window)
                allowed.append(state.allow(at, off) if mode == "failover" else state.allow(at))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=["request_id", "client", "allowed"])

    return rows.repartition("client").sortWithinPartitions("client", "at", "request_id").mapInArrow(run, "request_id long, client string, allowed boolean")
