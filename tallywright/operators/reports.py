"""Reports: selections and texts made from accounts and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import hex_id
from .account import provenance

c = F.col


def listing(entries: DataFrame) -> DataFrame:
    return entries.select("id", c("event_kind").alias("event"), c("resource_kind").alias("resource"), "value", "unit", "provenance", "request", "attempt", "epoch", "accounting_gen")


def explain(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "request", "gpu_s", "kv_allocated", (c("h2d_bytes") + c("d2h_bytes")).alias("transfer_bytes"), "wall_latency_s", "prefill_s", "decode_s", "generated_tokens", "spec_accepted", "spec_rejected",
        "failed_work_s", "cancelled_work_s", "kv_reuse", "reuse_credit", "reuse_avoided_s", "entries", "attempt_count",
    )


def waste(accounts: DataFrame) -> DataFrame:
    return accounts.select("request", "failed_work_s", "cancelled_work_s", "spec_rejected", "spec_wasted_s", "waste_ratio")


def reuse(accounts: DataFrame) -> DataFrame:
    return accounts.select("request", "kv_reuse", "tensor_reuse", "reuse_avoided_s", "reused_s", "reuse_credit", "reuse_rate")


COMPARED = ("gpu_s", "generated_tokens", "kv_allocated", "kv_reuse", "retries", "waste_ratio", "reuse_credit")


def compare(accounts: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_a, request_b, measure, a, b for each pair of requests."""
    parts = ", ".join(f"'{m}', cast({m} as double)" for m in COMPARED)
    x = accounts.selectExpr("request", f"stack({len(COMPARED)}, {parts}) as (measure, v)")
    a, b = (x.select(c("request").alias(f"request_{s}"), "measure", c("v").alias(s)) for s in "ab")
    return pairs.join(a, "request_a").join(b, ["request_b", "measure"]).select("request_a", "request_b", "measure", "a", "b")


def number_text(value: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent below 1e-4 and from 1e6 on; halves go to the even
    digit. Beyond 2**53 a half may go up."""
    pattern = lambda v, p: F.call_function("format_number", v, F.lit(p))
    # the pattern rounds halves of whole numbers up, so one that has to go down is moved down by 1 before
    size = F.abs(value)
    step = F.pow(F.lit(10.0), F.length(F.floor(size).cast("string")) - 6)
    down = (size >= 1e6) & (size < 2.0**53) & (size % step == step / 2) & (F.floor(size / step) % 2 == 0)
    parts = F.split(pattern(F.when(down, value - F.signum(value)).otherwise(value), "0.#####E0"), "E")
    power = parts[1].cast("int")
    small = pattern(F.concat_ws("E", parts[0], parts[1]).cast("double"), "0.#########")
    large = F.concat(parts[0], F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return F.when(value == 0, "0").when((power < -4) | (power >= 6), large).otherwise(small)


# The labels and keys of the reports, with the measures that they show.
TEXT_LINES = (
    ("outcome      ", "outcome"), ("wall_latency_s ", "wall_latency_s"), ("queue_s      ", "queue_s"), ("execution_s  ", "execution_s"), ("prefill_s    ", "prefill_s"), ("decode_s     ", "decode_s"),
    ("gpu_active_s ", "gpu_s"), ("cpu_active_s ", "cpu_s"), ("h2d_bytes    ", "h2d_bytes"), ("d2h_bytes    ", "d2h_bytes"), ("inter_node_bytes ", "inter_node_bytes"),
    ("kv_allocated ", "kv_allocated"), ("kv_peak      ", "kv_peak"), ("kv_reuse     ", "kv_reuse"), ("tensor_allocated ", "tensor_allocated"), ("model_byte_seconds ", "model_byte_seconds"),
    ("adapter_byte_seconds ", "adapter_byte_seconds"), ("reservations acquired/released ", "reservations_acquired/reservations_released"), ("allocation_peak ", "allocation_peak"),
    ("spec proposed/accepted/rejected ", "spec_proposed/spec_accepted/spec_rejected"), ("generated_tokens ", "generated_tokens"), ("retries      ", "retries"), ("attempt_count ", "attempt_count"),
    ("failed_work_s ", "failed_work_s"), ("cancelled_work_s ", "cancelled_work_s"), ("recompute_s  ", "recomputed_s"), ("reuse_avoided_s ", "reuse_avoided_s"), ("reused_s     ", "reused_s"),
    ("energy_j     ", "energy_joules"), ("kernel_hits/misses ", "kernel_hits/kernel_misses"), ("graph_hits/misses ", "graph_hits/graph_misses"), ("waste_ratio  ", "waste_ratio"), ("reuse_credit ", "reuse_credit"),
)
JSON_KEYS = (
    ("wall_latency_s", "wall_latency_s"), ("execution_s", "execution_s"), ("prefill_s", "prefill_s"), ("decode_s", "decode_s"), ("gpu_active_s", "gpu_s"), ("kv_allocated", "kv_allocated"), ("kv_reuse", "kv_reuse"),
    ("generated_tokens", "generated_tokens"), ("retries", "retries"), ("attempts", "attempt_count"), ("waste_ratio", "waste_ratio"), ("reuse_credit", "reuse_credit"),
)
CSV_HEADER = "id,event,resource,value,unit,provenance,request,attempt,epoch,accounting_gen"


def _texts(accounts: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``accounts`` and what is shown of each measure: the numbers go through one expression as an array, since one for
    each measure makes code that the JVM doesn't compile."""
    numbers = [m for m in names if accounts.schema[m].dataType.typeName() == "double"]
    x = accounts.withColumn("_shown", F.transform(F.array(*numbers), number_text))
    return x, {m: c("_shown")[numbers.index(m)] if m in numbers else c(m).cast("string") for m in names}


def account_text(accounts: DataFrame) -> DataFrame:
    """request, value: a line for the request and one for each measure that the report shows."""
    x, shown = _texts(accounts, [m for _, names in TEXT_LINES for m in names.split("/")])
    tail = {"wall_latency_s": F.concat(F.lit(" ["), provenance("wall_latency_s"), F.lit("]"))}
    lines = [F.concat(F.lit(f"  {label}"), F.concat_ws("/", *(shown[m] for m in names.split("/"))), tail.get(names, F.lit(""))) for label, names in TEXT_LINES]
    return x.select("request", F.concat_ws("\n", F.concat(F.lit("request "), c("request")), *lines).alias("value"))


def account_json(accounts: DataFrame) -> DataFrame:
    """request, value: an object of the outcome and twelve measures, numbers with six digits."""
    x, shown = _texts(accounts, [m for _, m in JSON_KEYS])
    lines = [F.concat(F.lit(f'  "{key}":'), shown[m]) for key, m in JSON_KEYS]
    head = [F.concat(F.lit(f'  "{k}":"'), c(k), F.lit('"')) for k in ("request", "outcome")]
    return x.select("request", F.concat(F.lit("{\n"), F.concat_ws(",\n", *head, *lines), F.lit("\n}")).alias("value"))


def list_text(entries: DataFrame) -> DataFrame:
    """seq, value: a line for each entry."""
    line = F.concat_ws(" ", "id", "event_kind", "resource_kind", number_text(c("value")), "unit", F.concat(F.lit("req="), c("request")))
    return entries.select("seq", line.alias("value"))


def list_csv(entries: DataFrame) -> DataFrame:
    """seq, value: a line of CSV for each entry, under CSV_HEADER; no field holds a comma."""
    line = F.concat_ws(",", "id", "event_kind", "resource_kind", number_text(c("value")), "unit", "provenance", "request", "attempt", "epoch", "accounting_gen")
    return entries.select("seq", line.alias("value"))


def write_csv(entries: DataFrame, path: str) -> None:
    """The list as CSV files in order of seq, each under its header."""
    x = listing(entries.repartitionByRange("seq").sortWithinPartitions("seq"))
    x.withColumn("value", number_text(c("value"))).write.mode("overwrite").option("header", True).csv(path)


def neighbours(accounts: DataFrame) -> DataFrame:
    """Pairs of each request with the one whose number follows."""
    number = F.conv("request", 16, 10).cast("long")
    return accounts.select(c("request").alias("request_a"), hex_id(number + 1).alias("request_b"))
