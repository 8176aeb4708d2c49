"""Prices: accounts by rates. Nothing physical changes, so accounts can be priced again under another policy."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import GIB, JOULES_PER_KWH

c = F.col

# Fixed value: the id of policies read from text.
TEXT_POLICY_ID = "000000000000cafe0000000000000001"


@dataclass(frozen=True)
class Policy:
    """Rates; host_memory, pinned_memory, storage_per_gib_second and custom are kept but never billed."""

    id: str
    generation: int = 1
    currency: str = "usd"
    name: str = ""
    gpu_per_second: float = 0.0
    cpu_per_second: float = 0.0
    memory_per_gib_second: float = 0.0
    transfer_per_gib: float = 0.0
    energy_per_kwh: float = 0.0
    persistent_cache_cost: float = 0.0
    host_memory: float = 0.0
    pinned_memory: float = 0.0
    storage_per_gib_second: float = 0.0
    custom: dict[str, float] = field(default_factory=dict)

    def all_finite(self) -> bool:
        rates = [getattr(self, f.name) for f in fields(self)[4:13]] + list(self.custom.values())
        return all(abs(r) < float("inf") for r in rates)


def latest(policies: list[Policy]) -> list[Policy]:
    """One policy an id, the one added last, by id."""
    return [p for _, p in sorted({p.id: p for p in policies}.items())]


def read_policy(spark: SparkSession, path: str) -> Policy:
    """A policy from lines ``key=value``; lines with # and unknown keys are skipped. A policy is a handful of lines."""
    rows = spark.read.text(path).filter(~c("value").startswith("#") & c("value").contains("=")).select(F.split("value", "=", 2).alias("kv")).collect()
    known = {"gpu_per_second", "cpu_per_second", "memory_per_gib_second", "transfer_per_gib", "energy_per_kwh", "persistent_cache_cost", "currency"}
    found = {k: v for k, v in (r["kv"] for r in rows) if k in known}
    return Policy(TEXT_POLICY_ID, **{k: v if k == "currency" else float(v) for k, v in found.items()})


def price(accounts: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row an account and policy."""
    rates = ("gpu_per_second", "cpu_per_second", "memory_per_gib_second", "transfer_per_gib", "energy_per_kwh", "persistent_cache_cost")
    rows = F.array(*(F.struct(F.lit(p.id).alias("id"), F.lit(p.currency).alias("currency"), *(F.lit(float(getattr(p, r))).alias(r) for r in rates)) for p in policies))
    p, gpu = lambda r: c(f"p.{r}"), c("p.gpu_per_second")
    x = accounts.withColumn("p", F.explode(rows)).withColumns({
        "policy": p("id"), "currency": p("currency"), "useful_work": c("execution_s") * gpu, "retry_cost": c("failed_work_s") * gpu, "rejected_spec": c("spec_wasted_s") * gpu,
        "wasted_work": (c("failed_work_s") + c("spec_wasted_s")) * gpu, "cancelled_cost": c("cancelled_work_s") * gpu, "recomputed_cost": c("recomputed_s") * gpu,
        "cpu_compute": c("cpu_s") * p("cpu_per_second"), "residency_cost": (c("model_byte_seconds") + c("adapter_byte_seconds")) / GIB * p("memory_per_gib_second"),
        "transfer_cost": (c("h2d_bytes") + c("d2h_bytes") + c("inter_node_bytes")) / GIB * p("transfer_per_gib"), "storage_cache_cost": c("cache_writes") * p("persistent_cache_cost"),
        "energy_cost": c("energy_joules") / JOULES_PER_KWH * p("energy_per_kwh"), "reuse_credit": (c("reuse_avoided_s") + c("reused_s")) * gpu,
    }).drop("p")
    x = x.withColumn("compute_cost", c("useful_work") + c("wasted_work") + c("cancelled_cost") + c("recomputed_cost") + c("cpu_compute"))
    x = x.withColumn("total_cost", c("compute_cost") + c("residency_cost") + c("transfer_cost") + c("storage_cache_cost") + c("energy_cost"))
    names = ("useful_work", "wasted_work", "retry_cost", "rejected_spec", "cancelled_cost", "recomputed_cost", "cpu_compute", "compute_cost", "residency_cost", "transfer_cost", "storage_cache_cost", "energy_cost", "reuse_credit", "total_cost")
    return x.select("request", "policy", "currency", *names)


def reconciles(costs: DataFrame) -> DataFrame:
    """Whether the parts of each cost make its total, and the useful share of compute."""
    parts = sum((c(k) for k in ("useful_work", "wasted_work", "cancelled_cost", "recomputed_cost", "cpu_compute", "residency_cost", "transfer_cost", "storage_cache_cost", "energy_cost")), F.lit(0.0))
    return costs.select("request", "policy", (F.abs(parts - c("total_cost")) < 1e-9).alias("reconciles"), F.when(c("compute_cost") > 0, c("useful_work") / c("compute_cost")).otherwise(0.0).alias("useful_fraction"))


def fleet(accounts: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row over all accounts, a count of zero as one in its divisors. Without ``costs``, cost figures are 0."""
    n = F.greatest(F.count("*"), F.lit(1))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0.0))
    tokens = F.coalesce(F.sum("generated_tokens"), F.lit(0))
    moved = F.coalesce(F.sum(c("h2d_bytes") + c("d2h_bytes") + c("inter_node_bytes")), F.lit(0.0))
    x = accounts.agg(
        F.count("*").alias("requests"), total("gpu_s").alias("gpu_s"), (total("gpu_s") / n).alias("gpu_s_per_request"), F.when(tokens > 0, total("gpu_s") / tokens).otherwise(0.0).alias("gpu_s_per_token"),
        tokens.alias("tokens"), (moved / n).alias("transfer_bytes_per_request"), (total("kv_allocated") / n).alias("kv_bytes_per_request"), (total("waste_ratio") / n).alias("waste_ratio"),
        (total("reuse_rate") / n).alias("reuse_rate"), (F.coalesce(F.sum("retries"), F.lit(0)) / n).alias("retry_overhead"), total("reuse_avoided_s").alias("avoided_work_s"),
    )
    if costs is None:
        return x.withColumns({k: F.lit(0.0) for k in ("total_cost", "cost_per_request", "cost_per_token")})
    y = costs.agg(F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost")).withColumn("_k", F.lit(1))
    x = x.withColumn("_k", F.lit(1)).join(y, "_k").drop("_k")  # one row and one row
    return x.withColumns({"cost_per_request": c("total_cost") / F.greatest(c("requests"), F.lit(1)), "cost_per_token": F.when(c("tokens") > 0, c("total_cost") / c("tokens")).otherwise(0.0)})
