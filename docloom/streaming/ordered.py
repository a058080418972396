"""Chunks of many documents, in any order and spread over any batches, stepped through a state for each document in the order of their numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from docloom.functions.errors import STATUS
from docloom.schema import ERROR

#: The state store that keeps maps and timers of a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChunkSteps(StatefulProcessor):
    """A chunk whose turn it is steps its key's state at once; one that is early waits in a map by its number, so no batch is held or sorted.

    A timer ends keys that nothing has come for.
    """

    def __init__(self, start: Callable[[], bytes], step: Callable[[bytes, bytes], bytes], finish: Callable[[bytes], bytes], idle_seconds: float, first: int):
        self.start, self.step, self.finish, self.idle, self.first = start, step, finish, int(idle_seconds * 1000), first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next long, held binary")
        self.early = handle.getMapState("early", "seq long", "chunk binary, last boolean")

    @staticmethod
    def _error(key, kind: str, message: str) -> Row:
        return Row(key=key[0], result=None, error=Row(type=kind, message=message, details=None, http_status=STATUS[kind]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at, held = self.now.get() if self.now.exists() else (self.first, None)
        held = None if held is None else bytes(held)
        for row in rows:
            if row.seq is None:
                yield self._error(key, "Validation", "a chunk has no number")
            elif row.seq > at:
                self.early.updateValue((row.seq,), (row.chunk, bool(row.last)))
            elif row.seq == at:  # a smaller number has been there before
                chunk, last = row.chunk, row.last
                while True:
                    held, at = self.step(self.start() if held is None else held, bytes(chunk) if chunk else b""), at + 1
                    if last:
                        yield Row(key=key[0], result=self.finish(held), error=None)
                        held = None
                    if not self.early.containsKey((at,)):
                        break
                    chunk, last = self.early.getValue((at,))
                    self.early.removeKey((at,))
        self.now.update((at, held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at, held = self.now.get() if self.now.exists() else (self.first, None)
        if held is not None or next(iter(self.early.keys()), None) is not None:
            yield self._error(key, "Timeout", f"chunk {at} has not come")
        self.now.clear()
        self.early.clear()


def ordered_chunks(
    stream: DataFrame, start: Callable[[], bytes], step: Callable[[bytes, bytes], bytes], finish: Callable[[bytes], bytes], idle_seconds: float = 3600, first: int = 0
) -> DataFrame:
    """stream(key, seq, chunk, last) to (key, result, error).

    Numbers begin at `first` and go on after a last chunk, with which a state ends and the next one begins; so a key has a result for each last chunk.
    A number that was there is passed over, a null chunk is empty, a null number is a Validation error, a null key is a key. A key for
    which nothing comes for idle_seconds is forgotten, with a Timeout error if a chunk was still to come; its numbers then begin anew.
    The state of a key is what `step` makes of it, and the chunks that came early.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = stream.schema["key"].dataType.simpleString()
    rows = stream.select("key", F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"), "last")
    return rows.groupBy("key").transformWithState(ChunkSteps(start, step, finish, idle_seconds, first), f"key {kind}, result binary, error {ERROR}", "append", "ProcessingTime")
