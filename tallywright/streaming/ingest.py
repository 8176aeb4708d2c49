"""Streams of entries: fenced by request, appended once, and totals by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import append

STATE = "request_gen long, attempt string, attempt_gen long, in_flight boolean"


def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")


def fenced(entries: DataFrame) -> DataFrame:
    """seq, id, request, verdict: each entry against the generations that the request's last start has set. The state of
    a request is four values, whatever its number of entries."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, None, None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ident, kind, gen, attempt, attempt_gen in zip(rows["seq"], rows["id"], rows["event_kind"], rows["request_gen"], rows["auth_attempt"], rows["attempt_gen"]):
            if kind == "REQUEST_START":
                now = (int(gen), attempt, int(attempt_gen), True)
            good = now[0] is None or (gen, attempt, attempt_gen) == now[:3]
            if good and kind == "REQUEST_END":
                now = (*now[:3], False)
            out.append((seq, ident, key[0], "accept" if good else "stale_generation"))
        state.update(now)
        yield pd.DataFrame(out, columns=["seq", "id", "request", "verdict"])

    slim = entries.select("request", "seq", "id", "event_kind", "request_gen", "auth_attempt", "attempt_gen")
    return slim.groupBy("request").applyInPandasWithState(run, "seq long, id string, request string, verdict string", STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream into a table, which is returned."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_stream(entries: DataFrame, ledger: str, acks: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Micro-batches appended to the table ``ledger``, a status for every entry to ``acks``. A batch that runs again
    replaces what it wrote, so each entry is appended once."""
    spark, schema = entries.sparkSession, entries.schema

    def each(batch: DataFrame, number: int) -> None:
        known = None
        if number:
            known = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*(f"{ledger}/batch={i}" for i in range(number)))
        told = append(batch, known)
        told.select("seq", "id", "status").write.mode("overwrite").parquet(f"{acks}/batch={number}")
        told.filter("status = 'accepted'").select(*batch.columns).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(ledger).drop("batch"), spark.read.parquet(acks).drop("batch")


def totals_by_time(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: entries and value of each type by windows of event time; later events than ``late`` are left out."""
    x = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    x = x.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("window.start").alias("day"), "event_type", "n", "total")
