"""Logs replayed as streams, up to what they hold now."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.views import table
from ..streaming import watch

QUERIES, ORACLE = {}, {}
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def replayed(spark: SparkSession, sf: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` makes of the event log as a stream.

    The log arrives in two halves of its time, and then an event far behind the last, which lets the watermark pass all
    others; the stream stops after each and takes up again where its checkpoint says.
    """
    root = f"{scratch.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    low, high = log.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        low = high = datetime(2000, 1, 1)
    half = F.col("ts") < F.lit(low + (high - low) / 2)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(high + timedelta(30)).alias("ts"), F.lit("end").alias("event_type"))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for part in (log.where(half), log.where(~half), end):
            part.write.mode("append").parquet(f"{root}/log")
            out = made(spark.readStream.schema(log.schema).parquet(f"{root}/log")).writeStream.format("parquet").outputMode("append")
            out.option("path", f"{root}/out").option("checkpointLocation", f"{root}/place").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.parquet(f"{root}/out")


@query("j15_unanswered_requests", """
with r as (select user_id, event_id, ts from events where event_type = 'view'), a as (select user_id, ts from events where event_type = 'purchase')
select user_id, event_id from r where not exists (select 1 from a where a.user_id = r.user_id and a.ts >= r.ts and a.ts <= r.ts + interval 1 hour)""")
def j15_requests(spark, sf):
    """Views that no purchase of the same user followed within the hour, by a join of two streams."""

    def made(log: DataFrame) -> DataFrame:
        one = log.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "event_type")
        return watch.unanswered(one.where("event_type in ('view', 'end')"), one.where("event_type in ('purchase', 'end')"))

    return replayed(spark, sf, made).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


@query("r06_ticket_outcomes", """
with n as (select user_id, event_id, ts, event_type = 'error' failed, lag(ts) over w before, lead(ts) over w after, lag(event_type = 'error') over w failed_before from events window w as (partition by user_id order by ts, event_id))
, runs as (select *, sum(case when failed and failed_before and ts <= before + interval 1 day then 0 else 1 end) over (partition by user_id order by ts, event_id) run from n)
, tries as (select *, (row_number() over (partition by user_id, run order by ts, event_id) - 1) % 3 + 1 k from runs where failed)
select user_id, event_id, case when k = 3 then 'given up' else 'retried' end outcome, epoch_us(ts) // 1000 "at" from tries
union all select user_id, event_id, 'expired', epoch_us(ts + interval 1 day) // 1000 from tries where k < 3 and (after is null or after > ts + interval 1 day)""")
def r06(spark, sf):
    """What became of each user's failures: state with timers."""

    def made(log: DataFrame) -> DataFrame:
        return watch.ticket_stream(log.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "error").alias("failed")))

    found = replayed(spark, sf, made)
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "outcome", F.unix_millis("at").alias("at"))
