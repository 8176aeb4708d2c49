"""Predicates of ledger queries and of entries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import NO_ID, PHYSICAL, PROVENANCES, RESOURCE_KINDS, EVENT_KINDS, UNITS

c = F.col
_EQUAL = ("request", "tenant", "model", "model_revision", "adapter", "attempt", "worker", "device", "event_kind", "resource_kind")


def query(entries: DataFrame, *, start_ns: int | None = None, end_ns: int | None = None, batch: str | None = None, outcome: str | None = None, pricing_policy: str | None = None, strict: bool = False, **equal: str) -> DataFrame:
    """Entries for which every given predicate holds. The time range takes both ends and looks at starts; ``batch`` and
    ``outcome`` are tags; ``pricing_policy`` filters only if ``strict``."""
    if unknown := set(equal) - set(_EQUAL):
        raise TypeError(f"no such predicate: {sorted(unknown)}")
    tests = [c(k) == v for k, v in equal.items() if v is not None]
    tests += [c("start_ts_ns") >= start_ns] if start_ns is not None else []
    tests += [c("start_ts_ns") <= end_ns] if end_ns is not None else []
    tests += [c("metadata")["batch"] == batch] if batch is not None else []
    tests += [c("metadata")["outcome"] == outcome] if outcome is not None else []
    tests += [c("pricing_policy") == pricing_policy] if strict and pricing_policy is not None else []
    return entries.filter(reduce(and_, tests)) if tests else entries


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_physical(resource: Column) -> Column:
    return resource.isin(*PHYSICAL)


def content_valid() -> Column:
    """Finite, not negative if physical, whole if a count."""
    v = c("value")
    return finite(v) & (~is_physical(c("resource_kind")) | (v >= 0)) & ((c("unit") != "count") | (F.floor(v) == v))


def codes_valid() -> Column:
    return c("event_kind").isin(*EVENT_KINDS) & c("resource_kind").isin(*RESOURCE_KINDS) & c("unit").isin(*UNITS) & c("provenance").isin(*PROVENANCES)


def is_available(provenance: Column) -> Column:
    return provenance.isin("measured", "reported")


def is_fresh(generation: Column, current: Column) -> Column:
    return generation == current


def has_id(ident: Column) -> Column:
    return ident != NO_ID


def content(columns: list[str], prefix: str = "") -> Column:
    """What equality of entries looks at: one struct, with maps as sorted entries."""
    return F.struct(*(F.sort_array(F.map_entries(prefix + k)).alias(k) if k == "metadata" else c(prefix + k).alias(k) for k in columns))


def distinct_requests(entries: DataFrame) -> DataFrame:
    """request, first_seq in order of first appearance; entries without a request are left out."""
    return entries.filter(has_id(c("request"))).groupBy("request").agg(F.min("seq").alias("first_seq")).orderBy("first_seq")


def group_by_request(entries: DataFrame) -> DataFrame:
    """request and the number and first and last seq of its entries, by request."""
    return entries.filter(has_id(c("request"))).groupBy("request").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).orderBy("request")


def resource_totals(entries: DataFrame) -> DataFrame:
    return entries.filter(c("unit").isin("bytes", "count")).groupBy("resource_kind").agg(F.sum("value").alias("total"))


def quantity_text() -> Column:
    return F.format_string("%.6f %s [%s]", c("value"), c("unit"), c("provenance"))


#: The base units of each unit: seconds, bytes, joules, money, plain numbers, and the factor to them.
_SIGNATURE = {
    "count": ("1", 1.0), "dimensionless": ("1", 1.0), "bytes": ("byte", 1.0), "byte-seconds": ("byte.second", 1.0), "seconds": ("second", 1.0), "nanoseconds": ("second", 1e-9),
    "joules": ("joule", 1.0), "wh": ("joule", 3600.0), "currency": ("money", 1.0),
}


def unit_signature(unit: Column) -> Column:
    """base and factor of a unit; null for an unknown one."""
    out = F.lit(None)
    for name, (base, factor) in _SIGNATURE.items():
        out = F.when(unit == name, F.struct(F.lit(base).alias("base"), F.lit(factor).alias("factor"))).otherwise(out)
    return out


def same_unit(a: Column, b: Column) -> Column:
    return unit_signature(a)["base"] == unit_signature(b)["base"]
