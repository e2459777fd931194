"""Which pages to fetch just now, as a stream with state: addresses that failed a short while ago
are left alone, and a host isn't asked more often than it is meant to be."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which a failed address is left alone.
FAILED_SECONDS = 600
#: Requests of a host in so many seconds.
HOST_REQUESTS, HOST_SECONDS = 10, 60
DECISION_SCHEMA = "url string, at timestamp, decision string"


class _Gate(StatefulProcessor):
    """State of a host: until when its failed addresses are left alone, and its last requests."""

    def __init__(self, failed_seconds: int, requests: int, seconds: int):
        self.failed_ms, self.requests, self.window_ms = 1000 * failed_seconds, requests, 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getMapState("failed", "url string", "until long")
        self.asked = handle.getListState("asked", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        found, asked = [], [at for (at,) in self.asked.get()]
        for url, at, failed in pd.concat(rows).sort_values(["at", "url"], kind="stable")[["url", "at", "failed"]].itertuples(index=False):
            now = at.value // 1_000_000
            if pd.notna(failed):  # how a fetch ended
                if failed:
                    self.failed.updateValue((url,), (now + self.failed_ms,))
                    self.handle.registerTimer(now + self.failed_ms)
                elif self.failed.containsKey((url,)):
                    self.failed.removeKey((url,))
                continue
            until = self.failed.getValue((url,))[0] if self.failed.containsKey((url,)) else 0
            asked = [x for x in asked if x > now - self.window_ms]
            decision = "failed recently" if now < until else "host is busy" if len(asked) >= self.requests else "fetch"
            if decision == "fetch":
                asked.append(now)
            found.append((url, at, decision))
        self.asked.put([(x,) for x in asked])
        yield pd.DataFrame(found, columns=["url", "at", "decision"]).astype({"url": object, "at": "datetime64[ns]", "decision": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (url,), (until,) in list(self.failed.iterator()):
            if until <= now:
                self.failed.removeKey((url,))
        yield pd.DataFrame({"url": pd.Series(dtype=object), "at": pd.Series(dtype="datetime64[ns]"), "decision": pd.Series(dtype=object)})

    def close(self) -> None:
        pass


def gate_fetches(events: DataFrame, *, failed_seconds: int = FAILED_SECONDS, requests: int = HOST_REQUESTS, seconds: int = HOST_SECONDS, late: str = "1 minute") -> DataFrame:
    """(url, at, decision) for each request of a stream ``(url, at, failed)``: fetch, failed recently
    or host is busy.

    A row whose ``failed`` is null is a request, one with a value says how a fetch ended. Time is
    that of the rows; what has run out is forgotten when the watermark passes it. State is of a
    host, in RocksDB. An address without a host is a host of its own; rows without an address or
    a time are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = events.where("url IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    hosts = known.withColumn("host", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.col("url"))).groupBy("host")
    return hosts.transformWithStateInPandas(statefulProcessor=_Gate(failed_seconds, requests, seconds), outputStructType=DECISION_SCHEMA, outputMode="append", timeMode="eventTime")
