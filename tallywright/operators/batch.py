"""Batches: accounts of members, totals, and shares of a common cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .account import reconcile

c = F.col


def batch_entries(entries: DataFrame, batches: list[str], untagged: str = "include") -> DataFrame:
    """Entries with the batch they count for. An entry without a tag counts for every batch asked for, or for none with
    ``untagged="exclude"``."""
    tag = c("metadata")["batch"]
    every = F.array(*map(F.lit, batches))
    own = F.when(tag.isNull(), every if untagged == "include" else F.array().cast("array<string>")).when(tag.isin(*batches), F.array(tag))
    return entries.withColumn("batch", F.explode(own))


def member_accounts(entries: DataFrame, batches: list[str], untagged: str = "include") -> DataFrame:
    return reconcile(batch_entries(entries, batches, untagged), ("batch", "request"))


def batch_totals(members: DataFrame) -> DataFrame:
    return members.groupBy("batch").agg(
        F.count("*").alias("members"), F.sum("execution_s").alias("execution_s"), F.sum("generated_tokens").alias("generated_tokens"), F.sum("gpu_s").alias("gpu_s"),
        F.count_if(c("outcome") == "cancelled").alias("cancelled_members"), F.bool_or(c("outcome") != "completed").alias("partial_completion"),
    )




def weight_of(policy: str) -> Column:
    one = F.lit(1.0)
    return {
        "equal_share": one, "weighted": c("weight").cast("double"), "proportional_bytes": c("kv_allocated") + c("tensor_allocated"),
        "proportional_tokens": c("generated_tokens").cast("double"), "proportional_execution": c("execution_s"),
        "proportional_reserved": c("reservations_acquired").cast("double"), "direct_ownership": one,
    }[policy]


def allocate(members: DataFrame, totals: DataFrame, policy: str, owner: DataFrame | None = None) -> DataFrame:
    """batch, member, weight, share. ``members``: batch, member and what the policy weighs; ``totals``: batch, total;
    ``owner``: batch, owner, default the first member. Weights without a positive sum count as equal."""
    x = members.select("batch", "member", weight_of(policy).alias("weight"))
    sums = x.groupBy("batch").agg(F.sum("weight").alias("_sum"), F.count("*").alias("_n"), F.min("member").alias("_first")).join(totals, "batch")
    if policy == "direct_ownership":
        sums = sums.join(owner, "batch", "left") if owner is not None else sums.withColumn("owner", F.lit(None).cast(members.schema["member"].dataType))
        x = x.join(sums, "batch")
        mine = c("member") == F.coalesce("owner", "_first")
        return x.select("batch", "member", mine.cast("double").alias("weight"), F.when(mine, c("total")).otherwise(0.0).alias("share"))
    weight = F.when(c("_sum") > 0, c("weight")).otherwise(1.0)
    share = c("total") * F.when(c("_sum") > 0, c("weight") / c("_sum")).otherwise(F.lit(1.0) / c("_n"))
    return x.join(sums, "batch").select("batch", "member", weight.alias("weight"), share.alias("share"))


def overhead(shares: DataFrame, totals: DataFrame) -> DataFrame:
    """batch, total, member_sum, unallocated, reconciles."""
    x = totals.join(shares.groupBy("batch").agg(F.sum("share").alias("member_sum")), "batch", "left").fillna(0.0, ["member_sum"])
    rest = c("total") - c("member_sum")
    x = x.withColumn("unallocated", F.when((rest < 0) & (rest > -1e-12), 0.0).otherwise(rest))
    return x.withColumn("reconciles", F.abs(c("member_sum") + c("unallocated") - c("total")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("total")))
