"""Folding the events of an answer into one row, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def fold_answers(events: DataFrame, *more_keys: Column) -> DataFrame:
    """Per question: deltas joined in order, and the last meta, verification and error.

    events(question_id, seq, type, text, message, payload). The same aggregate runs on a stream; its state is one answer
    per open question.
    """
    of = lambda kind: F.col("type") == kind
    pieces = F.sort_array(F.collect_list(F.when(of("delta"), F.struct("seq", "text"))))  # one answer's deltas
    last = lambda kind, column: F.max_by(F.when(of(kind), F.col(column)), F.when(of(kind), F.col("seq")))
    return events.groupBy("question_id", *more_keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("answer"),
        last("meta", "payload").alias("meta"), last("verification", "payload").alias("verification"),
        last("error", "message").alias("error"),
    )


def fold_stream(events: DataFrame, mode: str = "update", event_time: str | None = None, gap: str = "10 minutes", delay: str = "1 minute") -> DataStreamWriter:
    """A writer of folded answers; `update` emits only the questions that changed in a batch.

    With `event_time`, a timestamp column, an answer ends when nothing came for `gap`; once the watermark (`delay`
    behind the newest event) has passed that, its state is released, and mode `append` emits it then, whole. Without it,
    answers stay open: for bounded streams only.
    """
    if event_time is None:
        return fold_answers(events).writeStream.outputMode(mode)
    timed = events.withWatermark(event_time, delay)
    return fold_answers(timed, F.session_window(event_time, gap).alias("session")).drop("session").writeStream.outputMode(mode)
