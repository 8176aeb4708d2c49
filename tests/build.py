"""Small ledgers for tests."""

from tallywright.schema import LEDGER_SCHEMA, RESOURCE_KINDS

_RESOURCE = {"KV": "kv", "TENSOR": "tensor", "TRANSFER": "transfer", "MODEL": "residency", "ADAPTER": "residency", "ENERGY": "energy", "RESERVE": "memory", "RELEASE": "memory"}


def ident(n: int) -> str:
    return f"{n:032x}"


def entry(seq, kind, value=0.0, unit="count", start=1.0, end=None, request=1, attempt=1, **more):
    resource = next((r for k, r in _RESOURCE.items() if kind.startswith(k)), "compute" if unit == "seconds" or kind in ("DECODE", "PREFILL", "GPU_EXECUTION") else "generic")
    assert resource in RESOURCE_KINDS
    row = {f.name: None for f in LEDGER_SCHEMA} | {
        "seq": seq, "id": ident(1000 + seq), "ledger": ident(1), "tenant": ident(99), "workload": ident(88), "request": ident(request), "model": ident(77), "model_revision": ident(78),
        "attempt": ident(attempt), "dispatch": ident(5), "worker": ident(10), "node": ident(6), "device": ident(7), "event_kind": kind, "resource_kind": resource, "value": float(value), "unit": unit,
        "provenance": "measured", "start_ts_ns": round(start * 1e9), "end_ts_ns": None if end is None else round(end * 1e9), "src_worker": ident(10), "src_boot": ident(11), "src_accounting_gen": 1,
        "epoch": 1, "auth_worker_boot": ident(11), "request_gen": 1, "accounting_gen": 1, "auth_attempt": ident(attempt), "attempt_gen": 1, "auth_dispatch": ident(5), "metadata": {},
    }
    return row | more


def ledger(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in LEDGER_SCHEMA) for r in rows], LEDGER_SCHEMA)


def numbered(*rows):
    """(kind, value, unit, start, end[, request, attempt]) as entries in order."""
    return [entry(i, *r) for i, r in enumerate(rows)]
