"""Exception stacks of logs that are still being written: what a micro-batch leaves open waits in state for the next.

Lines are classified as in the batch parser, row by row in the JVM. A stateful operator per file keeps the open stack,
the stamps of the last lines, a blank line whose meaning the next line tells, and the number of stacks so far. However a
log is cut into micro-batches, the stacks are those of the batch parser over the whole log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.exceptions import classified, frame, told

FRAME_FIELDS = "cls: string, method: string, src_file: string, src_line: int, native: boolean, line_no: int"
STACKS = f"snapshot_id string, file string, occ int, chain array<struct<cls: string, message: string, frames: array<struct<{FRAME_FIELDS}>>>>, start_line int, end_line int, first_text string, ts_raw string"
_FRAME, _NODE = Row("cls", "method", "src_file", "src_line", "native", "line_no"), Row("cls", "message", "frames")
#: Lines above a head on which its stamp may stand.
LOOK_BACK = 3


class OpenStacks(StatefulProcessor):
    """Assembles the stacks of one file. The state is one value a file, as JSON; it holds one open stack, however long the log."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "carry string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        carry = json.loads(self.carried.get()[0]) if self.carried.exists() else {"occ": 0, "stamps": [], "blank": None, "open": None, "line": 0}
        for row in sorted(rows, key=lambda r: r.line_no):
            if row.line_no <= carry["line"]:
                continue  # delivered again
            carry["line"] = row.line_no
            if carry["blank"] is not None:
                yield from self._taken(key, carry, {"what": "blank" if row.at_line else "end"})
                carry["blank"] = None
            seen = next((s for s in [row.stamp, *reversed(carry["stamps"])] if s is not None), None)
            carry["stamps"] = [*carry["stamps"], row.stamp][-LOOK_BACK:]
            if row.what == "blank":
                carry["blank"] = row.line_no
            else:
                yield from self._taken(key, carry, {"what": row.what, "line": row.line_no, "text": row.text, "cls": row.cls, "message": row.message or None, "frame": row.frame, "stamp": seen})
        self.carried.update((json.dumps(carry),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if carry["open"]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing came for a while: what is open ends here."""
        carry = json.loads(self.carried.get()[0])
        yield from self._taken(key, carry, {"what": "end"})
        carry["blank"] = None
        self.carried.update((json.dumps(carry),))

    def close(self) -> None:
        pass

    def _taken(self, key, carry: dict, line: dict) -> Iterator[Row]:
        """Take a line into the open stack; yields the stack that it ends."""
        what, stack = line["what"], carry["open"]
        if what in ("head", "end"):
            carry["open"] = None
            if stack and any(link["frames"] for link in stack["chain"]):
                carry["occ"] += 1
                chain = [_NODE(x["cls"], x["message"], [_FRAME(*[f[c] for c in _FRAME]) for f in x["frames"]]) for x in stack["chain"]]
                yield Row(snapshot_id=key[0], file=key[1], occ=carry["occ"], chain=chain, start_line=stack["start"], end_line=stack["end"], first_text=stack["text"], ts_raw=stack["stamp"])
        if what == "head" or what == "cause" and not carry["open"]:  # a cause after an end begins a stack of its own
            carry["open"] = {"start": line["line"], "end": line["line"], "text": line["text"], "stamp": line["stamp"], "chain": [{"cls": line["cls"], "message": line["message"], "frames": []}]}
        elif what == "cause":
            stack["chain"].append({"cls": line["cls"], "message": line["message"], "frames": []})
        elif what == "frame" and stack:
            stack["chain"][-1]["frames"].append(line["frame"])
        if what in ("cause", "frame", "more") and carry["open"]:
            carry["open"]["end"] = line["line"]


def exceptions_of_stream(lines: DataFrame, idle_seconds: float = 60.0) -> DataFrame:
    """A stream of the exceptions table, from a stream of (snapshot_id, file, line_no, text).

    Lines of a file arrive in order, cut anywhere; within a micro-batch any order is right, and lines that come again are passed
    over. A stack is emitted once, when the next line ends it or its file was idle for idle_seconds; lines that would
    have gone on with it after that are no part of it. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), as every operator with timers. With the trigger availableNow, turn
    spark.sql.streaming.noDataMicroBatches.enabled off: a query with timers never runs out of batches otherwise.
    """
    given = classified(lines).withColumn("frame", F.when(F.col("what") == "frame", frame(F.col("text"), F.col("line_no"))))
    stacks = given.groupBy("snapshot_id", "file").transformWithState(statefulProcessor=OpenStacks(int(idle_seconds * 1000)), outputStructType=STACKS, outputMode="Append", timeMode="ProcessingTime")
    return told(stacks)
