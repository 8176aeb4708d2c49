"""SQL of the ledger and of its accounts for DuckDB, against which the plans are checked."""

from __future__ import annotations

from ..schema import EVENT_KINDS

_NAMES = ", ".join(f"'{k}'" for k in EVENT_KINDS)
_HEX = lambda x: f"lpad(lower(to_hex({x})), 32, '0')"
_COUNT, _BYTES = "6,7,8,9,20,21,22,23,27,28,29,30,31", "12,13,14,15,16,17,18,19,24,25,26"

LEDGER = f"""
e0 AS (SELECT *, 1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 37 AS code, epoch_us(ts) * 1000 AS s,
         CASE WHEN day(ts) >= 16 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS late FROM events),
ledger AS (SELECT event_id AS seq, {_HEX("event_id")} AS id, {_HEX("user_id % 7")} AS tenant, {_HEX("user_id")} AS request, {_HEX("event_type")} AS model,
  CASE WHEN event_id % 5 = 0 THEN {_HEX("event_id % 3")} END AS adapter, {_HEX("1 + event_id % 3")} AS attempt, {_HEX("event_id % 5")} AS worker, {_HEX("event_id % 4")} AS device,
  [{_NAMES}][code] AS event_kind, code,
  CASE WHEN code BETWEEN 5 AND 11 THEN 'compute' WHEN code BETWEEN 12 AND 14 THEN 'kv' WHEN code BETWEEN 15 AND 17 THEN 'tensor' WHEN code IN (18, 19) THEN 'residency'
    WHEN code IN (20, 21, 22, 23, 27, 28) THEN 'cache' WHEN code IN (24, 25, 26) THEN 'transfer' WHEN code IN (29, 30) THEN 'memory' WHEN code = 36 THEN 'energy' WHEN code = 37 THEN 'cost' ELSE 'generic' END AS resource_kind,
  CASE WHEN code IN ({_COUNT}) THEN floor(value) WHEN code IN ({_BYTES}) THEN floor(value * 1024) ELSE value END AS value,
  CASE WHEN code IN ({_COUNT}) THEN 'count' WHEN code IN ({_BYTES}) THEN 'bytes' WHEN code = 36 THEN CASE WHEN event_id % 2 = 0 THEN 'joules' ELSE 'wh' END ELSE 'seconds' END AS unit,
  s AS start_ts_ns, CASE WHEN code IN (3, 4, 5, 6, 9, 10, 11, 18, 19, 24, 25, 34) THEN s + CAST(floor(value * 1e6) AS BIGINT) END AS end_ts_ns,
  CASE WHEN event_id % 53 = 0 THEN late - 1 ELSE late END AS epoch, late AS accounting_gen, {_HEX("late")} AS boot, late,
  CASE WHEN event_id % 11 <> 0 THEN {_HEX("user_id % 8")} END AS batch, ['completed', 'failed', 'cancelled'][user_id % 3 + 1] AS tag FROM e0)"""


def accounts(key: str = "request", source: str = "ledger", name: str = "acct") -> str:
    """CTEs from ``source`` to one account for each key, as ``name``."""
    n, p = name, key
    dur = "greatest(coalesce(end_ts_ns, start_ts_ns) - start_ts_ns, 0)"
    total = lambda out, kinds, v: f"CAST(coalesce(sum({v}) FILTER (WHERE code IN ({kinds})), 0) AS {'BIGINT' if out.endswith('_ns') else 'DOUBLE'}) AS {out}"
    count = lambda out, kinds: f"CAST(coalesce(sum(CAST(round(value) AS BIGINT)) FILTER (WHERE code IN ({kinds})), 0) AS BIGINT) AS {out}"
    return f"""
{n}_w0 AS (SELECT *, {dur} AS d, CASE code WHEN 12 THEN value WHEN 13 THEN -value ELSE 0 END AS kd, CASE code WHEN 15 THEN value WHEN 16 THEN -value ELSE 0 END AS td FROM {source}),
{n}_w1 AS (SELECT *, sum(kd) OVER w AS ks, sum(td) OVER w AS tsum FROM {n}_w0 WINDOW w AS (PARTITION BY {p} ORDER BY seq ROWS UNBOUNDED PRECEDING)),
{n}_w2 AS (SELECT *, ks - least(0, min(ks) OVER w) AS kl, tsum - least(0, min(tsum) OVER w) AS tl FROM {n}_w1 WINDOW w AS (PARTITION BY {p} ORDER BY seq ROWS UNBOUNDED PRECEDING)),
{n}_a AS (SELECT {p}, attempt, count(*) FILTER (WHERE code = 2) > 0 AS completed, count(*) FILTER (WHERE code = 32) > 0 AS failed, count(*) FILTER (WHERE code = 33) > 0 AS cancelled,
  max(start_ts_ns) FILTER (WHERE code = 2) AS terminal_ns, {total("execution_ns", "5,6,10,11", "d")}, {total("prefill_ns", "5", "d")}, {total("decode_ns", "6", "d")}, {total("gpu_ns", "5,6,10", "d")},
  {total("cpu_ns", "11", "d")}, {total("spec_ns", "9", "d")}, CAST(coalesce(sum(CAST(round(value) AS BIGINT)) FILTER (WHERE code = 8 OR code = 6 AND unit = 'count'), 0) AS BIGINT) AS tokens FROM {n}_w2 GROUP BY {p}, attempt),
{n}_b AS (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY (completed AND NOT failed AND NOT cancelled) DESC, terminal_ns DESC NULLS LAST, attempt DESC) AS rk, completed AND NOT failed AND NOT cancelled AS good FROM {n}_a),
{n}_c AS (SELECT {p}, max(attempt) FILTER (WHERE rk = 1 AND good) AS winner, bool_or(cancelled AND NOT failed) AS canc, CAST(count(*) AS BIGINT) AS attempt_count,
  {", ".join(f"CAST(coalesce(sum({x}) FILTER (WHERE rk = 1 AND good), 0) AS BIGINT) AS {x}" for x in ("execution_ns", "prefill_ns", "decode_ns", "gpu_ns", "cpu_ns", "tokens"))},
  CAST(sum(spec_ns) AS BIGINT) AS spec_ns, CAST(coalesce(sum(execution_ns) FILTER (WHERE failed AND NOT (rk = 1 AND good)), 0) AS BIGINT) AS failed_ns,
  CAST(coalesce(sum(execution_ns) FILTER (WHERE cancelled AND NOT (rk = 1 AND good)), 0) AS BIGINT) AS cancelled_ns FROM {n}_b GROUP BY {p}),
{n}_r AS (SELECT {p}, CAST(count(*) AS BIGINT) AS entries, max_by(coalesce(end_ts_ns, start_ts_ns), seq) FILTER (WHERE code = 1) AS t0, max_by(start_ts_ns, seq) FILTER (WHERE code = 2) AS t1,
  min_by(tenant, seq) AS first_tenant, min_by(model, seq) AS first_model,
  {total("queue_ns", "3", "d")}, {total("batch_wait_ns", "4", "d")}, {total("transfer_ns", "24,25,26", "d")}, {total("recomputed_ns", "34", "d")},
  {total("kv_allocated", "12", "value")}, {total("kv_reuse", "14", "value")}, {total("tensor_allocated", "15", "value")}, {total("tensor_reuse", "17", "value")},
  {total("h2d_bytes", "24", "value")}, {total("d2h_bytes", "25", "value")}, {total("inter_node_bytes", "26", "value")}, {total("reuse_avoided_s", "35", "value")},
  {total("model_byte_seconds", "18", "value * d / 1e9")}, {total("adapter_byte_seconds", "19", "value * d / 1e9")}, {total("energy_joules", "36", "CASE WHEN unit = 'wh' THEN value * 3600.0 ELSE value END")},
  {count("spec_proposed", "7")}, {count("spec_accepted", "8")}, {count("spec_rejected", "9")}, {count("kernel_hits", "20")}, {count("kernel_misses", "21")}, {count("graph_hits", "22")}, {count("graph_misses", "23")},
  {count("cache_reads", "27")}, {count("cache_writes", "28")}, {count("retries", "31")}, count(*) FILTER (WHERE code = 29) AS reservations_acquired, count(*) FILTER (WHERE code = 30) AS reservations_released,
  CAST(greatest(coalesce(max(kl) FILTER (WHERE code = 12), 0), 0) AS DOUBLE) AS kv_peak, CAST(greatest(coalesce(max(tl) FILTER (WHERE code = 15), 0), 0) AS DOUBLE) AS tensor_peak FROM {n}_w2 GROUP BY {p}),
{n}_x AS (SELECT r.*, winner, attempt_count, CASE WHEN winner IS NOT NULL THEN 'completed' WHEN canc THEN 'cancelled' ELSE 'failed' END AS outcome,
  CASE WHEN t1 >= t0 THEN (t1 - t0) / 1e9 ELSE 0.0 END AS wall_latency_s, execution_ns / 1e9 AS execution_s, prefill_ns / 1e9 AS prefill_s, decode_ns / 1e9 AS decode_s, gpu_ns / 1e9 AS gpu_s, cpu_ns / 1e9 AS cpu_s,
  tokens AS generated_tokens, spec_ns / 1e9 AS spec_wasted_s, failed_ns / 1e9 AS failed_work_s, cancelled_ns / 1e9 AS cancelled_work_s, queue_ns / 1e9 AS queue_s, batch_wait_ns / 1e9 AS batch_wait_s,
  transfer_ns / 1e9 AS transfer_s, recomputed_ns / 1e9 AS recomputed_s, greatest(kv_peak, tensor_peak) AS allocation_peak, CAST(0 AS DOUBLE) AS reused_s, CAST(0 AS DOUBLE) AS tensor_byte_seconds
  FROM {n}_r r JOIN {n}_c c USING ({p})),
{n} AS (SELECT *, CASE WHEN execution_s + (failed_work_s + cancelled_work_s + spec_wasted_s) > 0 THEN (failed_work_s + cancelled_work_s + spec_wasted_s) / (execution_s + (failed_work_s + cancelled_work_s + spec_wasted_s)) ELSE 0.0 END AS waste_ratio,
  reuse_avoided_s + reused_s AS reuse_credit, CAST(0 AS DOUBLE) AS reuse_rate, CASE WHEN spec_proposed > 0 THEN CAST(spec_accepted AS DOUBLE) / spec_proposed ELSE 0.0 END AS spec_efficiency,
  CAST(0 AS DOUBLE) AS cost_per_token, CASE WHEN energy_joules > 0 THEN 'derived' ELSE 'unavailable' END AS energy_provenance FROM {n}_x)"""
