"""Answers that leave the stream when they end: events are put in order in state, not held back until a watermark passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from codestrata.sources.events import event_json

# The events that end an answer.
CLOSING = ("verification", "error")
#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ANSWER = "question_id long, answer string, meta string, verification string, error string, closed boolean"
EVENT = "type string, text string, message string, payload string"


def folded(question: int, events: dict[int, tuple], closed: bool) -> dict:
    """One answer of its events by seq: (type, text, message, payload), as `answers.fold_answers` gives it."""
    ordered = [events[seq] for seq in sorted(events)]
    last = lambda kind, place: next((e[place] for e in reversed(ordered) if e[0] == kind), None)
    return {"question_id": question, "answer": "".join(e[1] or "" for e in ordered if e[0] == "delta"), "meta": last("meta", 3),
            "verification": last("verification", 3), "error": last("error", 2), "closed": closed}


def is_whole(seqs: list[int], closing: list[int]) -> bool:
    """Whether an answer has ended and nothing before its end is missing: seq counts from 0."""
    return bool(closing) and len([s for s in seqs if s <= max(closing)]) == max(closing) + 1


class Closing(StatefulProcessor):
    """Holds the events of open answers; emits an answer once when it is whole, or when `patience` seconds pass without an event.

    An answer that has left stays known for as long, so that late and repeated events of it open no new one.
    """

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", EVENT)
        self.left = handle.getValueState("left", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.patience)
        gone = self.left.exists()
        for frame in rows:
            if gone:
                continue
            for seq, *event in frame[["seq", "type", "text", "message", "payload"]].astype(object).itertuples(index=False, name=None):
                if not self.events.containsKey((int(seq),)):  # an event may arrive again
                    self.events.updateValue((int(seq),), tuple(None if pd.isna(x) else x for x in event))
        if gone:
            return
        held = self._held()
        if is_whole(list(held), [s for s, e in held.items() if e[0] in CLOSING]):
            self.left.update((True,))
            self.events.clear()
            yield pd.DataFrame([folded(key[0], held, True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, gone = self._held(), self.left.exists()
        self.events.clear()
        self.left.clear()
        if held and not gone:
            yield pd.DataFrame([folded(key[0], held, False)])

    def _held(self) -> dict[int, tuple]:
        return {seq[0]: tuple(event) for seq, event in self.events.iterator()}

    def close(self) -> None:
        pass


def closing_answers(events: DataFrame, patience: int = 600) -> DataFrame:
    """A stream of answers, each emitted once: (question_id, answer, meta, verification, error, closed).

    events(question_id, seq from 0, type, text, message, payload), in any order and repeated.  An answer is emitted as soon as
    its closing event and all before it are there; if nothing comes for `patience` seconds, with what is there and `closed`
    false.  Rows without a question or a seq are left out.  The session needs the state store named in STATE_STORE.  Timers are looked at
    in every batch, those without data too, so such a stream does not end by itself.
    """
    store, provider = STATE_STORE
    if events.sparkSession.conf.get(store) != provider:
        raise ValueError(f"set {store} to {provider} in the session")
    known = events.where(F.col("question_id").isNotNull() & F.col("seq").isNotNull())
    return known.select("question_id", "seq", "type", "text", "message", "payload").groupBy("question_id").transformWithStateInPandas(
        Closing(patience), ANSWER, "Append", "ProcessingTime")


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for `foreachBatch` that writes rows as NDJSON under path/batch=<id>: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(event_json(*batch.columns).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of rows as NDJSON files; after a failure it goes on where it was, and nothing is written twice."""
    return rows.writeStream.foreachBatch(once_per_batch(path)).option("checkpointLocation", checkpoint)


def read_rows(spark, path: str, schema: str = ANSWER) -> DataFrame:
    """The rows that `write_stream` has written so far."""
    try:
        return spark.read.schema(schema).json(path).drop("batch")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
