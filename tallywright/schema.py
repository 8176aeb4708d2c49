"""The ledger's columns and the names of its codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Names in the order of their codes, units of measure and limits of the format.
EVENT_KINDS = (
    "REQUEST_START", "REQUEST_END", "QUEUE", "BATCH_WAIT", "PREFILL", "DECODE", "SPECULATION_PROPOSED", "SPECULATION_ACCEPTED",
    "SPECULATION_REJECTED", "GPU_EXECUTION", "CPU_EXECUTION", "KV_ALLOCATE", "KV_RELEASE", "KV_REUSE", "TENSOR_ALLOCATE",
    "TENSOR_RELEASE", "TENSOR_REUSE", "MODEL_RESIDENCY", "ADAPTER_RESIDENCY", "KERNEL_HIT", "KERNEL_MISS", "GRAPH_HIT",
    "GRAPH_MISS", "TRANSFER_H2D", "TRANSFER_D2H", "TRANSFER_INTER_NODE", "CACHE_READ", "CACHE_WRITE", "RESERVE", "RELEASE",
    "RETRY", "FAILURE", "CANCELLATION", "RECOMPUTE", "REUSE_AVOIDED", "ENERGY", "COST_ADJUSTMENT",
)
RESOURCE_KINDS = ("compute", "memory", "kv", "tensor", "transfer", "residency", "cache", "energy", "cost", "generic")
UNITS = ("count", "bytes", "byte-seconds", "seconds", "nanoseconds", "joules", "wh", "currency", "dimensionless")
PROVENANCES = ("measured", "reported", "derived", "estimated", "reconstructed", "unavailable")
PHYSICAL = RESOURCE_KINDS[:8]
GIB = 1073741824.0
JOULES_PER_WH, JOULES_PER_KWH = 3600.0, 3.6e6

NO_ID = "0" * 32

LEDGER_SCHEMA = T.StructType([
    *(T.StructField(c, T.LongType() if c == "seq" else T.StringType()) for c in (
        "seq", "id", "ledger", "tenant", "workload", "request", "model", "model_revision", "adapter", "attempt", "dispatch", "worker", "node", "device", "event_kind", "resource_kind")),
    T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("provenance", T.StringType()),
    T.StructField("start_ts_ns", T.LongType()), T.StructField("end_ts_ns", T.LongType()),
    T.StructField("src_worker", T.StringType()), T.StructField("src_boot", T.StringType()), T.StructField("src_accounting_gen", T.LongType()),
    T.StructField("epoch", T.LongType()), T.StructField("auth_worker_boot", T.StringType()), T.StructField("request_gen", T.LongType()),
    T.StructField("accounting_gen", T.LongType()), T.StructField("auth_attempt", T.StringType()), T.StructField("attempt_gen", T.LongType()),
    T.StructField("auth_dispatch", T.StringType()), T.StructField("accounting_policy", T.StringType()), T.StructField("pricing_policy", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def hex_id(number: Column) -> Column:
    """A number as the text of a 128-bit id."""
    return F.lpad(F.lower(F.hex(number)), 32, "0")


def parsed_id(text: Column) -> Column:
    """32 hexadecimal digits in lower case, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{32}$"), F.lower(text))


def name_of(code: Column, names: tuple[str, ...], first: int = 1) -> Column:
    return F.get(F.array(*map(F.lit, names)), code - first)


def code_of(name: Column, names: tuple[str, ...], first: int = 1, default: int | None = None) -> Column:
    """The code of a name; unknown names have the default code."""
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, at - 1 + first).otherwise(F.lit(default)).cast("int")
