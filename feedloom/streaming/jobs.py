"""Structured Streaming jobs over events, and a runner that lands them in several runs of one checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import discard, scratch

#: Failed fetches in a row that evict a key. A fixed value.
LIMIT = 30


def fixed_windows(stream: DataFrame, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """Events per type and fixed window. A window comes out once, when the watermark has passed its end; then its state goes,
    and rows that are later still are dropped."""
    w = stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.unix_seconds("w.start").alias("bucket"), "n")


def ledger(stream: DataFrame) -> DataFrame:
    """Each (user, chunk) once, whatever is delivered again."""
    keys = stream.select("user_id", (F.col("event_id") % 50).alias("chunk"), "ts")
    return keys.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "chunk"]).select("user_id", "chunk")


def admitted(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Rows that are no more than ``hours`` older than the newest row of earlier runs, each event_id once."""
    return stream.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["event_id"])


def streaks(stream: DataFrame, failed: Column, ttl: int, limit: int = LIMIT, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, streak, evicted) for each event: how many failures in a row end with it, from keyed state that a success,
    or ``ttl`` seconds without an event, resets; state of idle keys lapses with the watermark."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        n, last = state.get if state.exists else (0, 0)
        out = []
        for event, at, bad in zip(rows["event_id"].tolist(), rows["at"].tolist(), rows["bad"].tolist()):
            n = (0 if last and at - last > ttl else n) + 1 if bad else 0
            last = at
            out.append((key[0], event, n, n >= limit))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + ttl + 1, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak", "evicted"])

    rows = stream.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_seconds("ts").alias("at"), failed.alias("bad"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, streak long, evicted boolean", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def replay(job, spark: SparkSession, sf_dir: str, schema: str, run: Column, runs: int) -> DataFrame:
    """All that a job puts out when the event table arrives in ``runs`` runs: those rows whose ``run`` (a column, or an array of
    numbers for rows that are sent more than once) names it, each run started anew from the job's checkpoint and ended when all is
    read. Landing folder, checkpoint and sink (Parquet by batch id, so a repeated batch replaces its own output) are in the
    application's folder; the first two are deleted at the end."""
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    named = rows.withColumn("__run", run)
    named = named.withColumn("__run", F.explode("__run")) if named.schema["__run"].dataType.typeName() == "array" else named

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    for k in range(runs):
        named.where(F.col("__run") == k).drop("__run").write.mode("append").parquet(f"{path}/landed")
        out = job(spark.readStream.schema(rows.schema).parquet(f"{path}/landed"))
        q = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
        q.awaitTermination()
    for name in ("landed", "state"):
        discard(spark, f"{path}/{name}")
    return spark.read.schema(schema).parquet(f"{path}/out/batch=*")
