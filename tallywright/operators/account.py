"""Accounts: one row a request, folded from its entries in order of ``seq``.

Sums are taken first by (key, block of seq, attempt), so that a request with any share of all entries is spread over
many tasks and only sums are shuffled by request. What depends on order inside a block is taken by one window over the
block; what depends on order across blocks by a window over the blocks' sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import JOULES_PER_WH

#: Entries of a block have seq numbers within a range of this size.
BLOCK = 1 << 20
c = F.col

# measure: kinds whose durations (ns) add up in it, by attempt
_ATTEMPT_TIMES = {
    "execution_ns": ("PREFILL", "DECODE", "GPU_EXECUTION", "CPU_EXECUTION"), "prefill_ns": ("PREFILL",), "decode_ns": ("DECODE",),
    "gpu_ns": ("PREFILL", "DECODE", "GPU_EXECUTION"), "cpu_ns": ("CPU_EXECUTION",), "spec_wasted_ns": ("SPECULATION_REJECTED",),
}
_TIMES = {"queue_ns": ("QUEUE",), "batch_wait_ns": ("BATCH_WAIT",), "transfer_ns": ("TRANSFER_H2D", "TRANSFER_D2H", "TRANSFER_INTER_NODE"), "recomputed_ns": ("RECOMPUTE",)}
_VALUES = {
    "kv_allocated": "KV_ALLOCATE", "kv_reuse": "KV_REUSE", "tensor_allocated": "TENSOR_ALLOCATE", "tensor_reuse": "TENSOR_REUSE",
    "h2d_bytes": "TRANSFER_H2D", "d2h_bytes": "TRANSFER_D2H", "inter_node_bytes": "TRANSFER_INTER_NODE", "reuse_avoided_s": "REUSE_AVOIDED",
}
_COUNTS = {
    "spec_proposed": "SPECULATION_PROPOSED", "spec_accepted": "SPECULATION_ACCEPTED", "spec_rejected": "SPECULATION_REJECTED", "kernel_hits": "KERNEL_HIT",
    "kernel_misses": "KERNEL_MISS", "graph_hits": "GRAPH_HIT", "graph_misses": "GRAPH_MISS", "cache_reads": "CACHE_READ", "cache_writes": "CACHE_WRITE", "retries": "RETRY",
}
_PEAKS = {"kv": ("KV_ALLOCATE", "KV_RELEASE"), "tensor": ("TENSOR_ALLOCATE", "TENSOR_RELEASE")}
_SUMMED = ("entries", "reservations_acquired", "reservations_released", "model_byte_seconds", "adapter_byte_seconds", "energy_joules", *_TIMES, *_VALUES, *_COUNTS)
_FIRST = ("tenant", "workload", "model", "model_revision")
#: Measures of an account that are quantities, by unit.
MEASURES = {
    "seconds": (
        "wall_latency_s", "queue_s", "execution_s", "prefill_s", "decode_s", "gpu_s", "cpu_s", "batch_wait_s", "transfer_s", "failed_work_s", "cancelled_work_s", "recomputed_s",
        "reuse_avoided_s", "reused_s", "spec_wasted_s",
    ),
    "bytes": ("h2d_bytes", "d2h_bytes", "inter_node_bytes", "kv_allocated", "kv_peak", "kv_reuse", "tensor_allocated", "tensor_peak", "tensor_reuse", "allocation_peak"),
    "byte-seconds": ("model_byte_seconds", "adapter_byte_seconds", "tensor_byte_seconds"),
    "joules": ("energy_joules",),
}


def duration_ns() -> Column:
    return F.coalesce(F.greatest(c("end_ts_ns") - c("start_ts_ns"), F.lit(0)), F.lit(0))


def whole(value: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.round(value).cast("long")


def _is(*kinds: str) -> Column:
    return c("event_kind").isin(*kinds) if len(kinds) > 1 else c("event_kind") == kinds[0]


def _sum(condition: Column, value: Column, zero) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(zero)))


def attempts_by_block(entries: DataFrame, key: Sequence[str] = ("request",), block: int = BLOCK) -> DataFrame:
    """Sums of (key, block, attempt)."""
    d, x = duration_ns(), entries.withColumn("_block", F.floor(c("seq") / block))
    order = W.partitionBy(*key, "_block").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    for name, (take, give) in _PEAKS.items():
        x = x.withColumn(f"_{name}_d", F.when(_is(take), c("value")).when(_is(give), -c("value")).otherwise(0.0))
    x = x.withColumns({f"_{name}_s": F.sum(f"_{name}_d").over(order) for name in _PEAKS})
    x = x.withColumns({f"_{name}_m": F.least(F.lit(0.0), F.min(f"_{name}_s").over(order)) for name in _PEAKS})
    aggs = [F.count("*").alias("entries")]
    aggs += [_sum(_is(*kinds), d, 0).alias(name) for name, kinds in {**_ATTEMPT_TIMES, **_TIMES}.items()]
    aggs += [_sum(_is(kind), c("value"), 0.0).alias(name) for name, kind in _VALUES.items()]
    aggs += [_sum(_is(kind), whole(c("value")), 0).alias(name) for name, kind in _COUNTS.items()]
    tokens = F.when(_is("DECODE") & (c("unit") == "count") | _is("SPECULATION_ACCEPTED"), whole(c("value"))).otherwise(F.lit(0))
    aggs += [F.sum(tokens).alias("generated_tokens"), F.count_if(_is("RESERVE")).alias("reservations_acquired"), F.count_if(_is("RELEASE")).alias("reservations_released")]
    aggs += [_sum(_is("MODEL_RESIDENCY"), c("value") * d / 1e9, 0.0).alias("model_byte_seconds"), _sum(_is("ADAPTER_RESIDENCY"), c("value") * d / 1e9, 0.0).alias("adapter_byte_seconds")]
    aggs += [_sum(_is("ENERGY"), F.when(c("unit") == "wh", c("value") * JOULES_PER_WH).otherwise(c("value")), 0.0).alias("energy_joules")]
    aggs += [F.bool_or(_is(kind)).alias(name) for name, kind in (("completed", "REQUEST_END"), ("failed", "FAILURE"), ("cancelled", "CANCELLATION"))]
    aggs += [F.max(F.when(_is("REQUEST_END"), c("start_ts_ns"))).alias("terminal_ns")]
    aggs += [F.max(F.when(_is("REQUEST_START"), F.struct("seq", F.coalesce("end_ts_ns", "start_ts_ns").alias("ts")))).alias("_start")]
    aggs += [F.max(F.when(_is("REQUEST_END"), F.struct("seq", c("start_ts_ns").alias("ts")))).alias("_end")]
    aggs += [F.min(F.struct("seq", *_FIRST)).alias("_first")]
    for name, (take, _) in _PEAKS.items():
        s = c(f"_{name}_s")
        aggs += [F.sum(f"_{name}_d").alias(f"_{name}_d"), F.min(s).alias(f"_{name}_lo"), F.max(F.when(_is(take), s)).alias(f"_{name}_hi")]
        aggs += [F.max(F.when(_is(take), s - c(f"_{name}_m"))).alias(f"_{name}_own")]
    return x.groupBy(*key, "_block", "attempt").agg(*aggs)


def _with_peaks(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The highest balance in each block, where a balance never falls below zero, entering with that of the blocks before."""
    before = W.partitionBy(*key).orderBy("_block").rangeBetween(W.unboundedPreceding, -1)
    x = blocks.withColumns({f"_{n}_base": F.coalesce(F.sum(f"_{n}_d").over(before), F.lit(0.0)) for n in _PEAKS})
    x = x.withColumns({f"_{n}_low": F.least(F.lit(0.0), F.min(c(f"_{n}_base") + c(f"_{n}_lo")).over(before)) for n in _PEAKS})
    return x.withColumns({f"{n}_peak": F.greatest(c(f"_{n}_base") + c(f"_{n}_hi") - c(f"_{n}_low"), c(f"_{n}_own"), F.lit(0.0)) for n in _PEAKS})


def attempts(entries: DataFrame, key: Sequence[str] = ("request",), block: int = BLOCK) -> DataFrame:
    """One row an attempt, with the sums that are the request's as well."""
    # one exchange, of sums, for all that follows: the windows over blocks, the attempts and the accounts
    x = _with_peaks(attempts_by_block(entries, key, block).repartition(*key), key)
    aggs = [F.sum(n).alias(n) for n in (*_SUMMED, *_ATTEMPT_TIMES, "generated_tokens")]
    aggs += [F.bool_or(n).alias(n) for n in ("completed", "failed", "cancelled")]
    aggs += [F.max(n).alias(n) for n in ("terminal_ns", "_start", "_end", "kv_peak", "tensor_peak")] + [F.min("_first").alias("_first")]
    return x.groupBy(*key, "attempt").agg(*aggs)


def winner_key() -> Column:
    """Orders attempts: one that ended and neither failed nor was cancelled, the latest, then the largest id."""
    return F.when(c("completed") & ~c("failed") & ~c("cancelled"), F.struct("terminal_ns", "attempt"))


def reconcile(entries: DataFrame, key: Sequence[str] = ("request",), block: int = BLOCK) -> DataFrame:
    """One account for each key. Times, processor seconds and tokens are the winner's; what losers did is waste."""
    a = attempts(entries, key, block)
    a = a.withColumn("_winner", F.max(winner_key()).over(W.partitionBy(*key))["attempt"])
    won = F.coalesce(c("attempt") == c("_winner"), F.lit(False))
    aggs = [F.sum(n).alias(n) for n in _SUMMED]
    aggs += [_sum(won, c(n), 0).alias(n) for n in (*_ATTEMPT_TIMES, "generated_tokens") if n != "spec_wasted_ns"]
    aggs += [F.sum("spec_wasted_ns").alias("spec_wasted_ns"), _sum(~won & c("failed"), c("execution_ns"), 0).alias("failed_work_ns"), _sum(~won & c("cancelled"), c("execution_ns"), 0).alias("cancelled_work_ns")]
    aggs += [_sum(~won & ~c("failed") & ~c("cancelled"), c("execution_ns"), 0).alias("unattributed_ns")]
    aggs += [F.max(n).alias(n) for n in ("_start", "_end", "kv_peak", "tensor_peak", "_winner")] + [F.min("_first").alias("_first"), F.count("*").alias("attempt_count")]
    aggs += [F.bool_or(c("cancelled") & ~c("failed")).alias("_cancelled")]
    x = a.groupBy(*key).agg(*aggs)
    seconds = lambda n: (c(n) / 1e9).alias(n.removesuffix("_ns") + "_s")
    wall = F.when(c("_end.ts") >= c("_start.ts"), (c("_end.ts") - c("_start.ts")) / 1e9).otherwise(0.0)
    outcome = F.when(c("_winner").isNotNull(), "completed").when(c("_cancelled"), "cancelled").otherwise("failed")
    own = [n for n in _FIRST if n not in key]
    return x.select(
        *key, *(c(f"_first.{n}").alias(n) for n in own), c("_winner").alias("winner"), outcome.alias("outcome"), wall.alias("wall_latency_s"), "attempt_count", "entries", "generated_tokens",
        *(seconds(n) for n in (*_TIMES, *_ATTEMPT_TIMES, "failed_work_ns", "cancelled_work_ns", "unattributed_ns")), *_VALUES, *_COUNTS,
        "reservations_acquired", "reservations_released", "model_byte_seconds", "adapter_byte_seconds", "energy_joules", "kv_peak", "tensor_peak",
        F.greatest("kv_peak", "tensor_peak").alias("allocation_peak"), F.lit(0.0).alias("reused_s"), F.lit(0.0).alias("tensor_byte_seconds"),
    )


def ratio(part: Column, whole_: Column) -> Column:
    return F.when(whole_ > 0, part / whole_).otherwise(0.0)


def with_ratios(accounts: DataFrame) -> DataFrame:
    waste = c("failed_work_s") + c("cancelled_work_s") + c("spec_wasted_s")
    return accounts.withColumns({
        "waste_ratio": ratio(waste, c("execution_s") + waste), "reuse_credit": c("reuse_avoided_s") + c("reused_s"),
        "reuse_rate": ratio(c("reused_s"), c("execution_s") + c("reused_s")), "spec_efficiency": ratio(c("spec_accepted").cast("double"), c("spec_proposed")),
        "cost_per_token": F.lit(0.0), "energy_provenance": provenance("energy_joules"),
    })


def with_requested(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """An account for each requested id; a request without entries has failed, with zeros."""
    x = requests.select("request").join(accounts, "request", "left")
    numbers = [f.name for f in accounts.schema if f.dataType.typeName() in ("double", "long")]
    return x.withColumn("outcome", F.coalesce("outcome", F.lit("failed"))).fillna(0, numbers)


def provenance(measure: str) -> Column:
    """What a measure of an account comes from: tensor residency is never seen, energy not if it is 0, processor time not
    without attempts; all else is derived, zeros as well."""
    seen = {"tensor_byte_seconds": F.lit(False), "energy_joules": c("energy_joules") > 0, "cpu_s": c("attempt_count") > 0}.get(measure, F.lit(True))
    return F.when(seen, "derived").otherwise("unavailable")


def measures(accounts: DataFrame) -> DataFrame:
    """request, measure, value, unit, provenance: a row for each quantity of an account."""
    rows = [F.struct(F.lit(m).alias("measure"), c(m).cast("double").alias("value"), F.lit(unit).alias("unit"), provenance(m).alias("provenance")) for unit, names in MEASURES.items() for m in names]
    return accounts.select("request", F.inline(F.array(*rows)))


def summaries(accounts: DataFrame) -> DataFrame:
    """request, ok, entries, attempts, reason. An account can always be made, from no entries as well."""
    reason = F.format_string("reconciled %d entries across %d attempt(s)", c("entries"), c("attempt_count"))
    return accounts.select("request", F.lit(True).alias("ok"), "entries", c("attempt_count").alias("attempts"), reason.alias("reason"))
