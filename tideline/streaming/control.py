"""Polling through a day: a query with a time trigger that is started again after errors and ends at closing time."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds between polls, and before a query is started again.
EVERY = 60.0
RETRY = 5.0
CLOSING = dt.time(15, 0)


class Day(StreamingQueryListener):
    """Keeps one query going until closing time.

    start starts it; it must use one checkpoint, so that a new run goes on where the one before
    failed. A listener's calls only set the next step, which the thread of `run` takes.
    """

    def __init__(self, start: Callable[[], StreamingQuery], closing: dt.time = CLOSING, retry: float = RETRY, attempts: int | None = None, clock: Callable[[], dt.datetime] = dt.datetime.now) -> None:
        self.start, self.closing, self.retry, self.attempts, self.clock = start, closing, retry, attempts, clock
        self.query: StreamingQuery | None = None
        self.errors: list[str] = []
        self.batches = 0
        self._wake = threading.Event()
        self._ended: set[str] = set()

    def is_over(self) -> bool:
        return self.clock().time() >= self.closing

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.query is not None and str(event.progress.runId) == str(self.query.runId):
            self.batches += event.progress.numInputRows > 0
            if self.is_over():
                self._wake.set()

    def onQueryIdle(self, event) -> None:
        if self.is_over():
            self._wake.set()

    def onQueryTerminated(self, event) -> None:
        self._ended.add(str(event.runId))
        self._wake.set()

    def run(self, spark: SparkSession, look: float = 1.0) -> int:
        """Blocks until closing time, or until `attempts` errors, the last of which is raised; returns how often it started.

        Where no event comes, it looks at the clock and the query every `look` seconds.
        """
        spark.streams.addListener(self)
        starts = 0
        try:
            while not self.is_over():
                self._wake.clear()
                starts += 1
                try:
                    self.query = self.start()
                    while self.query.isActive and not self.is_over():
                        self._wake.wait(look)
                        self._wake.clear()
                    if self.is_over():
                        break
                    self.query.awaitTermination()
                    return starts
                except Exception as error:  # whatever a source or sink raises
                    self.errors.append(str(error))
                    if self.attempts is not None and len(self.errors) >= self.attempts:
                        raise
                self._wake.clear()
                self._wake.wait(self.retry)
            return starts
        finally:
            if self.query is not None and self.query.isActive:
                self.query.stop()
            spark.streams.removeListener(self)


def poll(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, every: float = EVERY) -> Callable[[], StreamingQuery]:
    """What starts a query that hands each batch to put every so many seconds."""
    return lambda: df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every:g} seconds").start()
