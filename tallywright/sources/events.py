"""The ``events`` table as a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EVENT_KINDS, hex_id, name_of

_COUNT = (6, 7, 8, 9, 20, 21, 22, 23, 27, 28, 29, 30, 31)
_BYTES = (12, 13, 14, 15, 16, 17, 18, 19, 24, 25, 26)
_TIMED = (3, 4, 5, 6, 9, 10, 11, 18, 19, 24, 25, 34)
_RESOURCES = (
    ("compute", (5, 6, 7, 8, 9, 10, 11)), ("kv", (12, 13, 14)), ("tensor", (15, 16, 17)), ("residency", (18, 19)),
    ("cache", (20, 21, 22, 23, 27, 28)), ("transfer", (24, 25, 26)), ("memory", (29, 30)), ("energy", (36,)), ("cost", (37,)),
)


def to_ledger(events: DataFrame) -> DataFrame:
    """One entry an event: the kind from the number in ``props``, the user as the request, attempts by id modulo 3."""
    c = F.col
    code = (1 + F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 37).cast("int")
    x = events.withColumns({"code": code, "start_ts_ns": F.unix_micros(c("ts").cast("timestamp")) * 1000})
    resource = F.lit("generic")
    for name, kinds in _RESOURCES:
        resource = F.when(c("code").isin(*kinds), name).otherwise(resource)
    unit = F.when(c("code").isin(*_COUNT), "count").when(c("code").isin(*_BYTES), "bytes").when(c("code") == 36, F.when(c("event_id") % 2 == 0, "joules").otherwise("wh")).otherwise("seconds")
    value = F.when(c("code").isin(*_COUNT), F.floor("value").cast("double")).when(c("code").isin(*_BYTES), F.floor(c("value") * 1024).cast("double")).otherwise(c("value"))
    late = F.when(F.dayofmonth("ts") >= 16, 2).otherwise(1).cast("long")
    stale = c("event_id") % 53 == 0
    batch = F.when(c("event_id") % 11 != 0, hex_id(c("user_id") % 8))
    outcome = F.element_at(F.array(F.lit("completed"), F.lit("failed"), F.lit("cancelled")), (c("user_id") % 3 + 1).cast("int"))
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("batch"), batch), F.struct(F.lit("outcome"), outcome)), lambda e: e["col2"].isNotNull()))
    attempt = hex_id(1 + c("event_id") % 3)
    return x.select(
        c("event_id").alias("seq"), hex_id(c("event_id")).alias("id"), hex_id(F.lit(1)).alias("ledger"), hex_id(c("user_id") % 7).alias("tenant"),
        hex_id(F.lit(136)).alias("workload"), hex_id(c("user_id")).alias("request"), hex_id(c("event_type")).alias("model"), hex_id(F.lit(2)).alias("model_revision"),
        F.when(c("event_id") % 5 == 0, hex_id(c("event_id") % 3)).alias("adapter"), attempt.alias("attempt"), hex_id(F.lit(12289)).alias("dispatch"),
        hex_id(c("event_id") % 5).alias("worker"), hex_id(F.lit(1)).alias("node"), hex_id(c("event_id") % 4).alias("device"),
        name_of(c("code"), EVENT_KINDS).alias("event_kind"), resource.alias("resource_kind"), value.alias("value"), unit.alias("unit"), F.lit("measured").alias("provenance"),
        c("start_ts_ns"), F.when(c("code").isin(*_TIMED), c("start_ts_ns") + F.floor(c("value") * 1e6)).alias("end_ts_ns"),
        hex_id(c("event_id") % 5).alias("src_worker"), hex_id(late).alias("src_boot"), late.alias("src_accounting_gen"),
        F.when(stale, late - 1).otherwise(late).alias("epoch"), hex_id(late).alias("auth_worker_boot"), F.lit(1).cast("long").alias("request_gen"), late.alias("accounting_gen"),
        attempt.alias("auth_attempt"), F.lit(1).cast("long").alias("attempt_gen"), hex_id(F.lit(12289)).alias("auth_dispatch"),
        F.lit(None).cast("string").alias("accounting_policy"), F.lit(None).cast("string").alias("pricing_policy"), tags.alias("metadata"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_ledger(spark.read.parquet(f"{sf_dir}/events.parquet"))
