"""Long runs as streams: a watch that halts on repeated failures, late results by the hour, and micro-batches that can resume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HALT = "user_id long, stop_at long, message string"
STATE = "n long, message string, same int, halted boolean"


def halt_stream(events: DataFrame, limit: int = 3) -> DataFrame:
    """user_id, stop_at, message, once a user's log has ``limit`` equal failures in a row.

    ``events`` (user_id, ts, event_id, message; null message: a success) come in order within a user. What a user's log
    has led to is kept in four numbers of state, whatever its length.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, same, halted = state.get if state.exists else (0, None, 0, False)
        out = []
        for rows in frames:
            for message in rows.sort_values(["ts", "event_id"])["message"]:
                n += 1
                message = None if pd.isna(message) else message
                same = 0 if message is None else same + 1 if message == last else 1
                last = message
                if same == limit and not halted:
                    halted = True
                    out.append((key[0], n, message))
        state.update((n, last, same, halted))
        yield pd.DataFrame(out, columns=["user_id", "stop_at", "message"])

    return events.groupBy("user_id").applyInPandasWithState(step, HALT, STATE, "append", GroupStateTimeout.NoTimeout)


def counts_by_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events of each kind by the hour; those later than ``late`` behind the newest are left out."""
    hour = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), "event_type", "n")


def collect_results(lines: DataFrame, table: str, checkpoint: str):
    """Run what has arrived of a stream of result lines through the parser and add it to ``table``; it takes up again
    where ``checkpoint`` says it stopped, so no line counts twice."""
    from ..operators.runs import parse_results

    def put(batch: DataFrame, batch_id: int) -> None:
        parse_results(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unanswered(requests: DataFrame, answers: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests (key, id, ts) without an answer (key, ts) from their time on until ``within`` later.

    Both are streams (or tables): a request is told once the watermark, ``late`` behind the newest of both, has passed
    the time that its answer had.
    """
    r = requests.withWatermark("ts", late).select(F.col("key").alias("r_key"), "id", F.col("ts").alias("asked"))
    a = answers.withWatermark("ts", late).select(F.col("key").alias("a_key"), F.col("ts").alias("answered"))
    met = F.expr(f"r_key = a_key and answered >= asked and answered <= asked + interval {within}")
    return r.join(a, met, "leftOuter").where("a_key is null").select(F.col("r_key").alias("key"), "id", "asked")


OUTCOMES = "key long, id long, outcome string, at timestamp"


class Tickets(StatefulProcessor):
    """What became of each key's tries: retried, given up after ``most`` failures in a row, expired where nothing followed a
    failure for ``seconds``. State is three numbers a key; a timer of event time tells an expiry that no later row would."""

    def __init__(self, most: int = 3, seconds: int = 86400):
        self.most, self.wait = most, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "failures int, id long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["ts", "id"])
        failures, last, due = self.open.get() if self.open.exists() else (0, None, None)
        if due is not None:
            self.handle.deleteTimer(due)
        out = []
        for ts, number, failed in whole[["ts", "id", "failed"]].itertuples(index=False, name=None):
            at = int(pd.Timestamp(ts).timestamp() * 1000)
            if due is not None and at > due:  # the timer's time went by within this batch
                out.append((key[0], last, "expired", pd.Timestamp(due, unit="ms")))
                failures = 0
            failures, last, due = failures + 1 if failed else 0, number, None
            if failures == self.most:
                out.append((key[0], number, "given up", pd.Timestamp(ts)))
                failures = 0
            elif failures:
                out.append((key[0], number, "retried", pd.Timestamp(ts)))
                due = at + self.wait
        if due is None:
            self.open.clear()
        else:
            self.open.update((failures, int(last), due))
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=["key", "id", "outcome", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, last, due = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], last, "expired", pd.Timestamp(due, unit="ms"))], columns=["key", "id", "outcome", "at"])

    def close(self) -> None:
        pass


def ticket_stream(tries: DataFrame, most: int = 3, seconds: int = 86400, late: str = "2 hours") -> DataFrame:
    """key, id, outcome, at of a stream of tries (key, id, ts, failed). Needs RocksDB as the session's state store."""
    return tries.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Tickets(most, seconds), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime"
    )
