"""Streams of state rows: latest by key, retries, accumulators, resuming and compaction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.storage import exists


def latest(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key so far (complete or update mode)."""
    row = F.struct(*[c for c in stream.columns if c != key])
    return stream.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("row")).select(key, "row.*")


def available(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its result table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def follow(stream: DataFrame, done: str, key: str, seconds: int = 30) -> StreamingQuery:
    """Appends new keys to a log as the source grows; keys already there are left out."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        old = spark.read.parquet(done).select(key) if exists(spark, done) else rows.select(key).limit(0)
        rows.dropDuplicates([key]).join(old, key, "left_anti").write.mode("append").parquet(done)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", done + ".checkpoint").trigger(processingTime=f"{seconds} seconds").start()


def stop(*queries: StreamingQuery) -> None:
    """Ends streams after the batch at hand; what they have not begun stays for the next start."""
    for q in queries:
        q.stop()
        q.awaitTermination()


def pending(work: DataFrame, log: DataFrame, key: str, complete: Column) -> DataFrame:
    """Work without a complete row in the log."""
    return work.join(log.where(complete).select(key), key, "left_anti")


def compacted(log: DataFrame, key: str, seq: str) -> DataFrame:
    """An append-only log's last row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("row")).select(key, "row.*")


#: Minutes of cool-down after the first and each later global error since a success.
COOL_DOWN = (45, 20)
#: Attempts of a range that is summed by itself.
RANGE = 1 << 16


def retries(attempts: DataFrame, key: str, seq: str, outcome: str, most: int) -> DataFrame:
    """(key, state, tries): downloaded, terminal, transient_exhausted after `most` transient failures, or open; what follows an end is ignored."""
    ends = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(outcome).alias("o")))),
        F.struct(F.lit("open").alias("state"), F.lit(0).alias("tries"), F.lit(0).alias("transient")),
        lambda a, x: F.when(a["state"] != "open", a).otherwise(
            F.struct(
                F.when(x["o"] == "ok", "downloaded").when(x["o"] == "terminal", "terminal").when((x["o"] == "transient") & (a["transient"] + 1 >= most), "transient_exhausted").otherwise("open").alias("state"),
                (a["tries"] + 1).alias("tries"),
                (a["transient"] + (x["o"] == "transient").cast("int")).alias("transient"),
            )
        ),
    )
    return attempts.groupBy(key).agg(ends.alias("e")).select(key, "e.state", "e.tries")


def cool_downs(attempts: DataFrame, seq: str, outcome: str) -> DataFrame:
    """(seq, minutes): the pause after each attempt that met a global error; the first one since the last success waits longest.

    Each range of seq finds its last success by itself; only a row for each range is summed over all.
    """
    rows = attempts.select(F.col(seq).alias("s"), F.col(outcome).alias("o"), F.floor(F.col(seq) / RANGE).alias("part")).where(F.col("o").isin("global", "ok"))
    success = F.when(F.col("o") == "ok", F.col("s"))
    ends = rows.groupBy("part").agg(F.max(success).alias("end"))
    earlier = ends.select("part", F.max("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inner = rows.withColumn("before", F.max(success).over(Window.partitionBy("part").orderBy("s")))
    run = inner.where("o = 'global'").join(F.broadcast(earlier), "part").select("s", F.coalesce("before", "earlier").alias("since"))
    opening = run.groupBy("since").agg(F.min("s").alias("opening"))
    paired = run.join(opening.withColumnRenamed("since", "mark"), F.col("since").eqNullSafe(F.col("mark")))
    return paired.select(F.col("s").alias(seq), F.when(F.col("s") == F.col("opening"), COOL_DOWN[0]).otherwise(COOL_DOWN[1]).alias("minutes"))


def retry_stream(stream: DataFrame, key: str, outcome: str, most: int) -> DataFrame:
    """The same machine over a stream: (key, state, tries) whenever a key's attempts arrive."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, tries, transient = state.get if state.exists else ("open", 0, 0)
        for pdf in batches:
            for o in pdf[outcome]:
                if now != "open":
                    break
                tries += 1
                transient += o == "transient"
                now = {"ok": "downloaded", "terminal": "terminal"}.get(o, "transient_exhausted" if o == "transient" and transient >= most else "open")
        state.update((now, tries, transient))
        yield pd.DataFrame({key: [k[0]], "state": [now], "tries": [tries]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, tries int", "state string, tries int, transient int", "update", "NoTimeout")


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable accumulators: sum, sum of squares, count."""
    return rows.groupBy(*keys).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"), F.count(value).alias("n"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, std) of accumulators, population deviation."""
    m = parts.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    return m.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))


def backoff(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before a repeated request."""
    return min(60.0, math.pow(2, attempt) + jitter)
