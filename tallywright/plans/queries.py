"""The registered queries and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import batch as B, filters as Q, ingest as I, pricing as P, reports as R
from ..operators.account import MEASURES, attempts, duration_ns, measures, reconcile, summaries, whole, with_ratios, with_requested
from ..schema import hex_id
from ..scratch import new_path, written
from ..sources import frames
from ..sources.events import read_events
from ..streaming import ingest as S
from .oracle import LEDGER, accounts as accounts_sql

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

POLICIES = [P.Policy("0" * 31 + "1", gpu_per_second=2.0, cpu_per_second=0.5, memory_per_gib_second=0.01, transfer_per_gib=0.5, energy_per_kwh=0.2, persistent_cache_cost=0.001),
            P.Policy("0" * 31 + "2", gpu_per_second=4.0, cpu_per_second=0.5, memory_per_gib_second=0.02, transfer_per_gib=1.5, energy_per_kwh=0.3, persistent_cache_cost=0.002)]
BATCHES = [f"{i:032x}" for i in range(8)]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def with_ledger(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((LEDGER, *ctes)) + "\n" + body


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ratios(reconcile(read_events(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(k, digits).alias(k) if t == "double" else k for k, t in df.dtypes))


def _account_query(name: str, doubles: str = "", others: str = "") -> None:
    """A query of some measures of every account."""
    d, o = doubles.split(), others.split()
    body = ", ".join(["request", *(f"round({k}, 6) AS {k}" for k in d), *o])
    query(name, with_ledger(f"SELECT {body} FROM acct", accounts_sql()))(lambda spark, sf: rounded(accounts(spark, sf).select("request", *d, *o)))


_account_query("account_core", "wall_latency_s queue_s batch_wait_s execution_s prefill_s decode_s gpu_s cpu_s failed_work_s cancelled_work_s spec_wasted_s recomputed_s", "outcome generated_tokens attempt_count entries")
_account_query("account_transfers", "h2d_bytes d2h_bytes inter_node_bytes transfer_s")
_account_query("account_kv_tensor_peaks", "kv_allocated kv_reuse tensor_allocated tensor_reuse kv_peak tensor_peak allocation_peak")
_account_query("account_residency", "model_byte_seconds adapter_byte_seconds")
_account_query("account_energy", "energy_joules", "energy_provenance")
_account_query("account_speculation", "spec_wasted_s spec_efficiency", "spec_proposed spec_accepted spec_rejected")
_account_query("account_cache_counts", "", "kernel_hits kernel_misses graph_hits graph_misses cache_reads cache_writes")
_account_query("account_reservations_retries", "", "reservations_acquired reservations_released retries")
_account_query("account_outcome", "", "outcome attempt_count")
_account_query("winner_attempt", "execution_s", "winner generated_tokens")
_account_query("waste_report", "failed_work_s cancelled_work_s spec_wasted_s waste_ratio", "spec_rejected")
_account_query("reuse_report", "kv_reuse tensor_reuse reuse_avoided_s reused_s reuse_credit reuse_rate")


QUERIES["waste_report"] = lambda spark, sf: rounded(R.waste(accounts(spark, sf)))
QUERIES["reuse_report"] = lambda spark, sf: rounded(R.reuse(accounts(spark, sf)))


@query("explain_report", with_ledger("""SELECT request, round(gpu_s, 6) AS gpu_s, round(kv_allocated, 6) AS kv_allocated, round(h2d_bytes + d2h_bytes, 6) AS transfer_bytes, round(wall_latency_s, 6) AS wall_latency_s,
  round(prefill_s, 6) AS prefill_s, round(decode_s, 6) AS decode_s, generated_tokens, spec_accepted, spec_rejected, round(failed_work_s, 6) AS failed_work_s, round(cancelled_work_s, 6) AS cancelled_work_s,
  round(kv_reuse, 6) AS kv_reuse, round(reuse_credit, 6) AS reuse_credit, round(reuse_avoided_s, 6) AS reuse_avoided_s, entries, attempt_count FROM acct""", accounts_sql()))
def explain_report(spark, sf_dir):
    return rounded(R.explain(accounts(spark, sf_dir)))


_MEASURES = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in R.COMPARED)
_COMPARED = " UNION ALL ".join(f"SELECT a AS request_a, b AS request_b, '{m}' AS measure, round(a_{m}, 6) AS a, round(b_{m}, 6) AS b FROM p" for m in R.COMPARED)


@query("compare_requests", with_ledger(_COMPARED, accounts_sql(), f"m AS MATERIALIZED (SELECT CAST('0x' || request AS BIGINT) AS k, CAST('0x' || request AS BIGINT) + 1 AS next, request, {_MEASURES} FROM acct)",
    f"p AS MATERIALIZED (SELECT x.request AS a, y.request AS b, {', '.join(f'x.{m} AS a_{m}, y.{m} AS b_{m}' for m in R.COMPARED)} FROM m x JOIN m y ON x.next = y.k)"))
def compare_requests(spark, sf_dir):
    x = written(accounts(spark, sf_dir), "accounts")
    return rounded(R.compare(x, R.neighbours(x)))


@query("attempt_detail", with_ledger("""SELECT request, attempt, completed, failed, cancelled, terminal_ns, round(execution_ns / 1e9, 6) AS execution_s, round(gpu_ns / 1e9, 6) AS gpu_s, round(cpu_ns / 1e9, 6) AS cpu_s,
  round(spec_ns / 1e9, 6) AS spec_wasted_s, tokens AS generated_tokens FROM acct_a""", accounts_sql()))
def attempt_detail(spark, sf_dir):
    a = attempts(read_events(spark, sf_dir))
    seconds = [F.round(c(f"{k}_ns") / 1e9, 6).alias(f"{k}_s") for k in ("execution", "gpu", "cpu", "spec_wasted")]
    return a.select("request", "attempt", "completed", "failed", "cancelled", "terminal_ns", *seconds, "generated_tokens")


@query("scan_list", with_ledger("SELECT id, event_kind AS event, resource_kind AS resource, round(value, 6) AS value, unit, 'measured' AS provenance, request, attempt, epoch, accounting_gen FROM ledger"))
def scan_list(spark, sf_dir):
    return rounded(R.listing(read_events(spark, sf_dir)))


_BRIEF = "seq, id, request, event_kind, round(value, 6) AS value"


def _filter_query(name: str, where: str, **predicates) -> None:
    query(name, with_ledger(f"SELECT {_BRIEF} FROM ledger WHERE {where}"))(lambda spark, sf: rounded(Q.query(read_events(spark, sf), **predicates).select("seq", "id", "request", "event_kind", "value")))


_ID = lambda n: f"{n:032x}"
_MODEL = b"purchase".hex().rjust(32, "0")
_filter_query("filter_eq_all", f"request = '{_ID(3)}' AND tenant = '{_ID(3)}' AND model = '{_MODEL}' AND device = '{_ID(1)}'", request=_ID(3), tenant=_ID(3), model=_MODEL, device=_ID(1))
_filter_query("filter_attempt_worker", f"attempt = '{_ID(2)}' AND worker = '{_ID(4)}'", attempt=_ID(2), worker=_ID(4))
_filter_query("filter_kind_resource", "event_kind = 'DECODE' AND resource_kind = 'compute'", event_kind="DECODE", resource_kind="compute")
_filter_query("filter_time_range", "start_ts_ns BETWEEN 1704499200000000000 AND 1705190400000000000", start_ns=1704499200000000000, end_ns=1705190400000000000)
_filter_query("filter_batch", f"batch = '{_ID(3)}'", batch=_ID(3))
_filter_query("filter_outcome", "tag = 'failed'", outcome="failed")
_filter_query("filter_adapter", f"adapter = '{_ID(2)}'", adapter=_ID(2))
_filter_query("point_lookup", f"id = '{_ID(77)}'")
QUERIES["point_lookup"] = lambda spark, sf: rounded(read_events(spark, sf).filter(c("seq") == 77).select("seq", "id", "request", "event_kind", "value"))


@query("row_count", with_ledger("SELECT count(*) AS entries FROM ledger"))
def row_count(spark, sf_dir):
    return read_events(spark, sf_dir).agg(F.count("*").alias("entries"))


@query("content_validity", with_ledger("""SELECT seq, resource_kind IN ('compute', 'memory', 'kv', 'tensor', 'transfer', 'residency', 'cache', 'energy') AS physical,
  isfinite(v) AND (resource_kind IN ('generic', 'cost') OR v >= 0) AND (unit <> 'count' OR floor(v) = v) AS valid
  FROM (SELECT *, CASE WHEN seq % 17 = 0 THEN -value WHEN seq % 19 = 0 THEN value + 0.5 ELSE value END AS v FROM ledger)"""))
def content_validity(spark, sf_dir):
    v = F.when(c("seq") % 17 == 0, -c("value")).when(c("seq") % 19 == 0, c("value") + 0.5).otherwise(c("value"))
    return read_events(spark, sf_dir).withColumn("value", v).select("seq", Q.is_physical(c("resource_kind")).alias("physical"), Q.content_valid().alias("valid"))


@query("distinct_requests", with_ledger("SELECT request, min(seq) AS first_seq FROM ledger WHERE request <> repeat('0', 32) GROUP BY request"))
def distinct_requests(spark, sf_dir):
    return Q.distinct_requests(read_events(spark, sf_dir))


@query("group_by_request", with_ledger("SELECT request, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM ledger WHERE request <> repeat('0', 32) GROUP BY request"))
def group_by_request(spark, sf_dir):
    return Q.group_by_request(read_events(spark, sf_dir))


@query("resource_totals", with_ledger("SELECT resource_kind, round(sum(value), 6) AS total FROM ledger WHERE unit IN ('bytes', 'count') GROUP BY resource_kind"))
def resource_totals(spark, sf_dir):
    return rounded(Q.resource_totals(read_events(spark, sf_dir)))


def _rollup(key: str) -> None:
    sql = with_ledger(f"SELECT {key}, request, entries, round(gpu_s, 6) AS gpu_s, generated_tokens FROM k", accounts_sql(f"{key}, request", name="k").replace(f"USING ({key}, request)", f"USING ({key}, request)"))
    query(f"{key}_rollup", sql)(lambda spark, sf: rounded(reconcile(read_events(spark, sf), (key, "request")).select(key, "request", "entries", "gpu_s", "generated_tokens")))


for _key in ("tenant", "model", "device"):
    _rollup(_key)


@query("fleet_aggregate", with_ledger("""SELECT count(*) AS requests, round(sum(gpu_s), 6) AS gpu_s, round(sum(gpu_s) / count(*), 6) AS gpu_s_per_request, round(CASE WHEN sum(generated_tokens) > 0 THEN sum(gpu_s) / sum(generated_tokens) ELSE 0.0 END, 6) AS gpu_s_per_token,
  CAST(sum(generated_tokens) AS BIGINT) AS tokens, round(sum(h2d_bytes + d2h_bytes + inter_node_bytes) / count(*), 6) AS transfer_bytes_per_request, round(sum(kv_allocated) / count(*), 6) AS kv_bytes_per_request, round(sum(waste_ratio) / count(*), 6) AS waste_ratio,
  CAST(0 AS DOUBLE) AS reuse_rate, round(CAST(sum(retries) AS DOUBLE) / count(*), 6) AS retry_overhead, round(sum(reuse_avoided_s), 6) AS avoided_work_s, CAST(0 AS DOUBLE) AS total_cost, CAST(0 AS DOUBLE) AS cost_per_request, CAST(0 AS DOUBLE) AS cost_per_token FROM acct""", accounts_sql()))
def fleet_aggregate(spark, sf_dir):
    return rounded(P.fleet(accounts(spark, sf_dir)))


_BATCH_ROWS = "tagged AS (SELECT l.*, b.batch AS batch_id FROM (SELECT * EXCLUDE (batch), batch AS own FROM ledger) l JOIN (SELECT lpad(lower(to_hex(range)), 32, '0') AS batch FROM range(8)) b ON l.own = b.batch OR l.own IS NULL)"
_MEMBERS = accounts_sql("batch_id, request", "tagged", "m")


def members(spark, sf_dir):
    return B.member_accounts(read_events(spark, sf_dir), BATCHES)


@query("batch_reconcile_all", with_ledger("""SELECT batch_id AS batch, count(*) AS members, round(sum(execution_s), 6) AS execution_s, CAST(sum(generated_tokens) AS BIGINT) AS generated_tokens, round(sum(gpu_s), 6) AS gpu_s,
  count(*) FILTER (WHERE outcome = 'cancelled') AS cancelled_members, bool_or(outcome <> 'completed') AS partial_completion FROM m GROUP BY batch_id""", _BATCH_ROWS, _MEMBERS))
def batch_reconcile_all(spark, sf_dir):
    return rounded(B.batch_totals(members(spark, sf_dir)))


def _allocation(policy: str, weight: str) -> None:
    """A cost of 2 for each second of GPU work of a batch, shared by its members."""
    name = "alloc_" + {"equal_share": "equal", "direct_ownership": "direct"}.get(policy, policy.removeprefix("proportional_"))
    if policy == "direct_ownership":
        share, w = "CASE WHEN request = first THEN total ELSE 0.0 END", "CASE WHEN request = first THEN 1.0 ELSE 0.0 END"
    else:
        share, w = "total * CASE WHEN s > 0 THEN w / s ELSE 1.0 / n END", "CASE WHEN s > 0 THEN w ELSE 1.0 END"
    sql = with_ledger(f"SELECT batch_id AS batch, request AS member, CAST(round({w}, 6) AS DOUBLE) AS weight, CAST(floor(({share}) * 1000000 + 0.5) / 1000000 AS DOUBLE) AS share FROM x JOIN (SELECT batch_id, sum(w) AS s, count(*) AS n, 2 * (CAST(sum(CAST(round(gpu_s * 1e9) AS BIGINT)) AS BIGINT) / CAST(1e9 AS DOUBLE)) AS total, min(request) AS first FROM x GROUP BY 1) t USING (batch_id)",
                      _BATCH_ROWS, _MEMBERS, f"x AS (SELECT batch_id, request, gpu_s, CAST({weight} AS DOUBLE) AS w FROM m)")

    def run(spark, sf_dir):
        m = written(members(spark, sf_dir).withColumn("member", c("request")), "members")
        # whole nanoseconds add up the same in any order, and a share at a half is rounded as the SQL does it
        totals = m.groupBy("batch").agg((2 * (F.sum(F.round(c("gpu_s") * 1e9).cast("long")) / 1e9)).alias("total"))
        return B.allocate(m, totals, policy).select("batch", "member", F.round("weight", 6).alias("weight"), (F.floor(c("share") * 1000000 + 0.5) / 1000000).alias("share"))

    query(name, sql)(run)


for _policy, _weight in (("equal_share", "1"), ("direct_ownership", "1"), ("proportional_bytes", "kv_allocated + tensor_allocated"), ("proportional_tokens", "generated_tokens"), ("proportional_execution", "execution_s"), ("proportional_reserved", "reservations_acquired")):
    _allocation(_policy, _weight)


def _line_shares(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(c("l_orderkey").alias("batch"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("member"), c("l_quantity").alias("weight"), "l_extendedprice")
    cents = F.round(c("l_extendedprice") * 100).cast("long")  # whole numbers add up the same in any order
    totals = x.groupBy("batch").agg((F.sum(cents) / 100.0).cast("double").alias("total"))
    return B.allocate(x, totals, "weighted"), totals


@query("alloc_weighted", """SELECT l_orderkey AS batch, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CAST(round(l_quantity, 6) AS DOUBLE) AS weight, floor(total * (l_quantity / s) * 10000 + 0.5) / 10000 AS share
  FROM lineitem JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / CAST(100 AS DOUBLE) AS total, sum(l_quantity) AS s FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def alloc_weighted(spark, sf_dir):
    m = c("member")
    return _line_shares(spark, sf_dir)[0].select("batch", m["l_linenumber"].alias("line"), m["l_partkey"].alias("part"), m["l_suppkey"].alias("supplier"), F.round("weight", 6).alias("weight"), (F.floor(c("share") * 10000 + 0.5) / 10000).alias("share"))


@query("alloc_overhead", "SELECT l_orderkey AS batch, round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / CAST(100 AS DOUBLE), 4) AS total, CAST(0 AS DOUBLE) AS unallocated, true AS reconciles FROM lineitem GROUP BY 1")
def alloc_overhead(spark, sf_dir):
    shares, totals = _line_shares(spark, sf_dir)
    return B.overhead(shares, totals).select("batch", F.round("total", 4).alias("total"), (F.round("unallocated", 4) + 0.0).alias("unallocated"), "reconciles")


_COSTS = """costs AS (SELECT request, policy, 'usd' AS currency, execution_s * g AS useful_work, (failed_work_s + spec_wasted_s) * g AS wasted_work, failed_work_s * g AS retry_cost, spec_wasted_s * g AS rejected_spec, cancelled_work_s * g AS cancelled_cost,
  recomputed_s * g AS recomputed_cost, cpu_s * cpu AS cpu_compute, (model_byte_seconds + adapter_byte_seconds) / 1073741824.0 * mem AS residency_cost, (h2d_bytes + d2h_bytes + inter_node_bytes) / 1073741824.0 * tr AS transfer_cost,
  cache_writes * pc AS storage_cache_cost, energy_joules / 3.6e6 * en AS energy_cost, reuse_credit * g AS reuse_credit
  FROM acct, (VALUES (repeat('0', 31) || '1', CAST(2.0 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.01 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.001 AS DOUBLE)), (repeat('0', 31) || '2', 4.0, 0.5, 0.02, 1.5, 0.3, 0.002)) p(policy, g, cpu, mem, tr, en, pc))"""
_PARTS = ("useful_work", "wasted_work", "retry_cost", "rejected_spec", "cancelled_cost", "recomputed_cost", "cpu_compute", "residency_cost", "transfer_cost", "storage_cache_cost", "energy_cost", "reuse_credit")
_COMPUTE = "useful_work + wasted_work + cancelled_cost + recomputed_cost + cpu_compute"


@query("cost_by_policy", with_ledger(f"SELECT request, policy, currency, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)}, round({_COMPUTE}, 6) AS compute_cost, round({_COMPUTE} + residency_cost + transfer_cost + storage_cache_cost + energy_cost, 6) AS total_cost FROM costs", accounts_sql(), _COSTS))
def cost_by_policy(spark, sf_dir):
    return rounded(P.price(accounts(spark, sf_dir), POLICIES))


@query("cost_reconciles", with_ledger(f"SELECT request, policy, true AS reconciles, round(CASE WHEN {_COMPUTE} > 0 THEN useful_work / ({_COMPUTE}) ELSE 0.0 END, 6) AS useful_fraction FROM costs", accounts_sql(), _COSTS))
def cost_reconciles(spark, sf_dir):
    return rounded(P.reconciles(P.price(accounts(spark, sf_dir), POLICIES)))


@query("fleet_cost", with_ledger(f"SELECT count(*) AS requests, round(sum({_COMPUTE} + residency_cost + transfer_cost + storage_cache_cost + energy_cost), 4) AS total_cost, round(sum({_COMPUTE} + residency_cost + transfer_cost + storage_cache_cost + energy_cost) / count(*), 4) AS cost_per_request FROM costs WHERE policy LIKE '%1'", accounts_sql(), _COSTS))
def fleet_cost(spark, sf_dir):
    x = written(accounts(spark, sf_dir), "accounts")
    return rounded(P.fleet(x, P.price(x, POLICIES[:1])).select("requests", "total_cost", "cost_per_request"), 4)


_LINE = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("append_status", f"""WITH x AS (SELECT *, ({_LINE}) AS content, first_value(({_LINE})) OVER w AS one, row_number() OVER w AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}))
  SELECT l_returnflag, CASE WHEN place = 1 THEN 'accepted' WHEN content = one THEN 'duplicate' ELSE 'duplicate_conflict' END AS status, count(*) AS n FROM x GROUP BY ALL""")
def append_status(spark, sf_dir):
    """Lines under their order and number as ids; the first in order of content is accepted."""
    line = [k.strip() for k in _LINE.split(",")]
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("_c", F.struct(*line))
    first = x.groupBy("l_orderkey", "l_linenumber").agg(F.min("_c").alias("_one"))
    same = x.groupBy("l_orderkey", "l_linenumber", "_c").agg(F.count("*").alias("n")).join(first, ["l_orderkey", "l_linenumber"])
    parts = F.when(c("_c") == c("_one"), F.array(F.struct(F.lit("accepted").alias("status"), F.lit(1).cast("long").alias("k")), F.struct(F.lit("duplicate").alias("status"), (c("n") - 1).alias("k"))))
    out = same.select(c("_c.l_returnflag").alias("l_returnflag"), F.explode(parts.otherwise(F.array(F.struct(F.lit("duplicate_conflict").alias("status"), c("n").alias("k"))))).alias("s"))
    return out.filter("s.k > 0").groupBy("l_returnflag", c("s.status").alias("status")).agg(F.sum("s.k").alias("n"))


def repeated_entries(entries: DataFrame) -> DataFrame:
    """Entries with those of every fifth id once more, a tenth of them changed, some invalid."""
    n = 1 << 40
    again = entries.filter(c("seq") % 5 == 0).withColumns({"value": F.when(c("seq") % 50 == 0, c("value") + 1).otherwise(c("value")), "seq": c("seq") + n})
    return entries.withColumn("value", F.when(c("seq") % 97 == 0, -1.0).otherwise(c("value"))).unionByName(again)


@query("append_ledger", with_ledger("""SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN bad THEN 'invalid' ELSE 'accepted' END AS status FROM (SELECT seq % 97 = 0 AND (resource_kind NOT IN ('generic', 'cost')) AS bad FROM ledger)
  UNION ALL SELECT CASE WHEN seq % 97 = 0 AND resource_kind NOT IN ('generic', 'cost') THEN 'accepted' WHEN (CASE WHEN seq % 97 = 0 THEN -1.0 ELSE value END) = (CASE WHEN seq % 50 = 0 THEN value + 1 ELSE value END) THEN 'duplicate' ELSE 'duplicate_conflict' END FROM ledger WHERE seq % 5 = 0) GROUP BY 1"""))
def append_ledger(spark, sf_dir):
    return I.append(repeated_entries(read_events(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n"))


def control_log(entries: DataFrame) -> DataFrame:
    """Workers registered with boot 1 before all entries; from the first entry of the second half month on, epoch 2 and boot 2."""
    turn = entries.filter(c("src_accounting_gen") == 2).agg(F.min("seq").alias("t")).first()["t"]
    rows = [(-1, "REGISTER", f"{w:032x}", f"{1:032x}") for w in range(4)]  # the last worker never registers
    if turn is not None:
        rows += [(turn - 1, "ROLL", None, None)] + [(turn - 1, "REGISTER", f"{w:032x}", f"{2:032x}") for w in range(3)]  # the fourth keeps its old boot
    return entries.sparkSession.createDataFrame(rows, "seq long, kind string, worker string, boot string")


_FENCED = """t AS (SELECT min(seq) AS t FROM ledger WHERE late = 2),
f AS (SELECT *, CASE WHEN seq >= t THEN 2 ELSE 1 END AS cur, last_value(CASE WHEN code = 1 THEN attempt END IGNORE NULLS) OVER (PARTITION BY request ORDER BY seq ROWS UNBOUNDED PRECEDING) AS started FROM ledger, t),
v AS (SELECT seq, CASE WHEN epoch <> cur THEN 'stale_epoch' WHEN accounting_gen <> cur THEN 'stale_generation' WHEN worker = lpad('4', 32, '0') THEN 'unknown_worker'
  WHEN boot <> lpad(CASE WHEN seq >= t AND worker <> lpad('3', 32, '0') THEN '2' ELSE '1' END, 32, '0') THEN 'stale_worker' WHEN started IS NOT NULL AND attempt <> started THEN 'stale_generation' ELSE 'accept' END AS verdict FROM f)"""


@query("fence_verdict", with_ledger("SELECT seq, verdict FROM v", _FENCED))
def fence_verdict(spark, sf_dir):
    e = read_events(spark, sf_dir)
    return I.fence(e, control_log(e)).select("seq", "verdict")


@query("coordinator_status", with_ledger("SELECT verdict, CASE WHEN verdict = 'accept' THEN 'accepted' ELSE 'stale' END AS status, count(*) AS n FROM v GROUP BY ALL", _FENCED))
def coordinator_status(spark, sf_dir):
    e = read_events(spark, sf_dir)
    return I.coordinate(e, control_log(e)).groupBy("verdict", "status").agg(F.count("*").alias("n"))


@query("coordinator_with_losses")
def coordinator_with_losses(spark, sf_dir):
    """With a worker lost in the middle of the log: requests in flight are rolled until they start anew."""
    e = read_events(spark, sf_dir)
    middle = (e.agg(F.max("seq")).first()[0] or 0) // 2
    lost = spark.createDataFrame([(middle, "WORKER_LOST", None, None)], "seq long, kind string, worker string, boot string")
    now = I.coordinate(e.withColumns({"epoch": F.when(c("seq") > middle, 2).otherwise(1).cast("long"), "accounting_gen": F.when(c("seq") > middle, 2).otherwise(1).cast("long"), "auth_worker_boot": hex_id(F.lit(1))}), lost.unionByName(control_log(e).filter("seq = -1")))
    return now.groupBy("verdict", "status").agg(F.count("*").alias("n"))


@query("authority_snapshot", with_ledger("SELECT 1 + count(*) FILTER (WHERE late = 2 AND seq = t) AS epoch, 1 + count(*) FILTER (WHERE late = 2 AND seq = t) AS accounting_gen, CAST(4 AS BIGINT) AS workers FROM ledger, (SELECT min(seq) AS t FROM ledger WHERE late = 2)"))
def authority_snapshot(spark, sf_dir):
    return I.authority_snapshot(control_log(read_events(spark, sf_dir)))


@query("connected_workers", with_ledger("SELECT DISTINCT worker, CASE WHEN (SELECT max(late) FROM ledger) = 2 AND worker <> lpad('3', 32, '0') THEN lpad('2', 32, '0') ELSE lpad('1', 32, '0') END AS boot FROM ledger WHERE worker <> lpad('4', 32, '0')"))
def connected_workers(spark, sf_dir):
    return I.connected_workers(control_log(read_events(spark, sf_dir)))


@query("request_authority", with_ledger("SELECT request, CAST(1 AS BIGINT) AS request_gen, max_by(attempt, seq) AS attempt, CAST(1 AS BIGINT) AS attempt_gen FROM ledger WHERE code = 1 GROUP BY request"))
def request_authority(spark, sf_dir):
    return I.request_authority(read_events(spark, sf_dir))


@query("entry_checks", with_ledger("SELECT event_kind, true AS known, true AS available, epoch = late AS fresh, count(*) AS n FROM ledger GROUP BY ALL"))
def entry_checks(spark, sf_dir):
    x = read_events(spark, sf_dir).select("event_kind", Q.codes_valid().alias("known"), Q.is_available(c("provenance")).alias("available"), Q.is_fresh(c("epoch"), c("src_accounting_gen")).alias("fresh"))
    return x.groupBy("event_kind", "known", "available", "fresh").agg(F.count("*").alias("n"))


@query("unit_signatures", with_ledger("""SELECT unit, CASE unit WHEN 'count' THEN '1' WHEN 'bytes' THEN 'byte' WHEN 'seconds' THEN 'second' ELSE 'joule' END AS base, round(sum(value * CASE unit WHEN 'wh' THEN 3600.0 ELSE 1.0 END), 4) AS total, count(*) AS n
  FROM ledger GROUP BY unit"""))
def unit_signatures(spark, sf_dir):
    """Values in base units by unit."""
    x = read_events(spark, sf_dir).withColumn("s", Q.unit_signature(c("unit")))
    return x.groupBy("unit", c("s.base").alias("base")).agg(F.round(F.sum(c("value") * c("s.factor")), 4).alias("total"), F.count("*").alias("n"))


@query("account_identity", with_ledger("SELECT request, first_tenant AS tenant, first_model AS model, round(cost_per_token, 6) AS cost_per_token FROM acct", accounts_sql()))
def account_identity(spark, sf_dir):
    return rounded(accounts(spark, sf_dir).select("request", "tenant", "model", "cost_per_token"))


@query("id_hex", "SELECT o_orderkey, lpad(lower(to_hex(o_orderkey)), 32, '0') AS id FROM orders")
def id_hex(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", hex_id(c("o_orderkey")).alias("id"))


@query("duration", with_ledger("SELECT seq, CAST(greatest(coalesce(end_ts_ns - start_ts_ns, 0), 0) AS BIGINT) AS duration_ns, CAST(round(value) AS BIGINT) AS whole FROM ledger"))
def duration(spark, sf_dir):
    return read_events(spark, sf_dir).select("seq", duration_ns().alias("duration_ns"), whole(c("value")).alias("whole"))


@query("enum_names", with_ledger("SELECT event_kind, code AS kind, resource_kind, count(*) AS n FROM ledger GROUP BY ALL"))
def enum_names(spark, sf_dir):
    from ..schema import EVENT_KINDS, code_of

    return read_events(spark, sf_dir).groupBy("event_kind", code_of(c("event_kind"), EVENT_KINDS).alias("kind"), "resource_kind").agg(F.count("*").alias("n"))


@query("quantity_text", with_ledger("SELECT seq, printf('%.6f', value) || ' ' || unit || ' [measured]' AS quantity FROM ledger"))
def quantity_text(spark, sf_dir):
    return read_events(spark, sf_dir).select("seq", Q.quantity_text().alias("quantity"))


_UNIT_OF = {m: unit for unit, names in MEASURES.items() for m in names}
_SEEN = {"tensor_byte_seconds": "false", "energy_joules": "energy_joules > 0", "cpu_s": "attempt_count > 0"}


@query("account_measures", with_ledger(" UNION ALL ".join(f"SELECT request, '{m}' AS measure, round({m}, 6) AS value, '{unit}' AS unit, CASE WHEN {_SEEN.get(m, 'true')} THEN 'derived' ELSE 'unavailable' END AS provenance FROM kept" for m, unit in _UNIT_OF.items()),
    accounts_sql(), "kept AS MATERIALIZED (SELECT * FROM acct)"))
def account_measures(spark, sf_dir):
    return rounded(measures(accounts(spark, sf_dir)))


@query("reconcile_summary", with_ledger("SELECT request, true AS ok, entries, attempt_count AS attempts, 'reconciled ' || entries || ' entries across ' || attempt_count || ' attempt(s)' AS reason FROM acct", accounts_sql()))
def reconcile_summary(spark, sf_dir):
    return summaries(accounts(spark, sf_dir))


_WHOLE = {"outcome", "generated_tokens", "retries", "attempt_count", "reservations_acquired", "reservations_released", "spec_proposed", "spec_accepted", "spec_rejected", "kernel_hits", "kernel_misses", "graph_hits", "graph_misses"}
_SHOWN = lambda m: m if m in _WHOLE else f"printf('%.6g', {m})"
_SUMS = "SELECT * REPLACE (" + ", ".join(f"round({m}, 6) AS {m}" for m in ("model_byte_seconds", "adapter_byte_seconds", "energy_joules", "reuse_avoided_s", "reuse_credit")) + ") FROM acct"


def _texts(spark, sf_dir) -> DataFrame:
    """Accounts whose sums of doubles don't depend on their order any more."""
    return accounts(spark, sf_dir).withColumns({m: F.round(m, 6) for m in ("model_byte_seconds", "adapter_byte_seconds", "energy_joules", "reuse_avoided_s", "reuse_credit")})


@query("account_json", with_ledger("""SELECT request, '{' || chr(10) || '  "request":"' || request || '",' || chr(10) || '  "outcome":"' || outcome || '"' || """
    + " || ".join(f"""',' || chr(10) || '  "{key}":' || {_SHOWN(m)}""" for key, m in R.JSON_KEYS) + " || chr(10) || '}' AS value FROM kept", accounts_sql(), f"kept AS ({_SUMS})"))
def account_json(spark, sf_dir):
    return R.account_json(_texts(spark, sf_dir))


@query("account_text", with_ledger("SELECT request, 'request ' || request || " + " || ".join("chr(10) || '  " + label + "' || " + " || '/' || ".join(_SHOWN(m) for m in names.split("/")) + (" || ' [derived]'" if names == "wall_latency_s" else "")
    for label, names in R.TEXT_LINES) + " AS value FROM kept", accounts_sql(), f"kept AS ({_SUMS})"))
def account_text(spark, sf_dir):
    return R.account_text(_texts(spark, sf_dir))


@query("list_text", with_ledger("SELECT seq, id || ' ' || event_kind || ' ' || resource_kind || ' ' || printf('%.6g', value) || ' ' || unit || ' req=' || request AS value FROM ledger"))
def list_text(spark, sf_dir):
    return R.list_text(read_events(spark, sf_dir))


@query("list_csv", with_ledger("SELECT seq, concat_ws(',', id, event_kind, resource_kind, printf('%.6g', value), unit, 'measured', request, attempt, epoch, accounting_gen) AS value FROM ledger"))
def list_csv(spark, sf_dir):
    return R.list_csv(read_events(spark, sf_dir))


@query("requested_accounts", with_ledger("SELECT r.request, coalesce(outcome, 'failed') AS outcome, coalesce(entries, 0) AS entries, coalesce(generated_tokens, 0) AS generated_tokens FROM (SELECT DISTINCT lpad(lower(to_hex(c_custkey)), 32, '0') AS request FROM customer) r LEFT JOIN acct USING (request)", accounts_sql()))
def requested_accounts(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(hex_id(c("c_custkey")).alias("request")).distinct()
    return with_requested(accounts(spark, sf_dir), asked).select("request", "outcome", "entries", "generated_tokens")


_TOTALS = "SELECT event_kind, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(end_ts_ns - start_ts_ns) AS BIGINT) AS ns FROM ledger GROUP BY event_kind"


def _totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("event_kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(c("end_ts_ns") - c("start_ts_ns")).alias("ns"))


@query("roundtrip_parquet", with_ledger(_TOTALS))
def roundtrip_parquet(spark, sf_dir):
    return _totals(written(read_events(spark, sf_dir), "ledger"))


def _framed(spark, sf_dir) -> str:
    """Four files at least, so that the order through files is seen on small tables too."""
    path, e = new_path(spark, "framed"), read_events(spark, sf_dir)
    written(frames.write(e, path, files=max(4, frames.files_for(e))), "files").count()
    return path


@query("roundtrip_binary", with_ledger(_TOTALS))
def roundtrip_binary(spark, sf_dir):
    return _totals(frames.load(spark, _framed(spark, sf_dir)))


_KEPT = "kv_peak tensor_peak wall_latency_s kv_allocated gpu_s"


@query("roundtrip_accounts", with_ledger(f"SELECT request, {', '.join(f'round({k}, 6) AS {k}' for k in _KEPT.split())}, outcome, generated_tokens, entries FROM acct", accounts_sql()))
def roundtrip_accounts(spark, sf_dir):
    """Accounts that depend on the order of entries, from a ledger written to several files and read again."""
    back = frames.load(spark, _framed(spark, sf_dir))
    return rounded(with_ratios(reconcile(back)).select("request", *_KEPT.split(), "outcome", "generated_tokens", "entries"))


@query("recover_report", "SELECT true AS ok, '' AS reason, count(*) AS frames FROM events")
def recover_report(spark, sf_dir):
    return frames.recover(spark, _framed(spark, sf_dir)).groupBy("ok", "reason").agg(F.sum("frames").alias("frames"))


@query("replay_totals", with_ledger("SELECT 'accepted' AS status, event_kind, count(*) AS n, round(sum(value), 4) AS total FROM ledger GROUP BY event_kind"))
def replay_totals(spark, sf_dir):
    back = I.replay(frames.load(spark, _framed(spark, sf_dir)))
    return back.groupBy(F.lit("accepted").alias("status"), "event_kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ledger_digest")
def ledger_digest(spark, sf_dir):
    return frames.digest(read_events(spark, sf_dir))


@query("derived_ids", with_ledger("""SELECT seq, md5(concat_ws('|', lpad('1', 32, '0'), tenant, lpad('88', 32, '0'), request, model, lpad('2', 32, '0'), event_kind, resource_kind, worker, boot, late, epoch, accounting_gen, 1, 1,
  attempt, start_ts_ns, printf('%.6f', value))) AS derived FROM ledger"""))
def derived_ids(spark, sf_dir):
    return read_events(spark, sf_dir).select("seq", frames.derived_id().alias("derived"))


@query("crc_of_text")
def crc_of_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.crc32(c("props").cast("binary")).alias("crc"))


@query("stream_fence", with_ledger("SELECT CASE WHEN started IS NOT NULL AND attempt <> started THEN 'stale_generation' ELSE 'accept' END AS verdict, count(*) AS n FROM f GROUP BY 1", _FENCED))
def stream_fence(spark, sf_dir):
    from ..sources.events import to_ledger

    out = S.run_once(S.fenced(to_ledger(S.read_stream(spark, sf_dir))), new_path(spark, "fenced"), new_path(spark, "state"))
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


@query("stream_equals_batch", SQL["append_ledger"])
def stream_equals_batch(spark, sf_dir):
    from ..sources.events import to_ledger

    _, acks = S.append_stream(repeated_entries(to_ledger(S.read_stream(spark, sf_dir))), new_path(spark, "ledger"), new_path(spark, "acks"), new_path(spark, "state"))
    return acks.groupBy("status").agg(F.count("*").alias("n"))


@query("stream_dedupe", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    x = S.read_stream(spark, sf_dir).withColumn("at", c("ts").cast("timestamp"))
    twice = x.unionByName(x).withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return S.run_once(twice, new_path(spark, "once"), new_path(spark, "state")).groupBy("event_type").agg(F.count("*").alias("n"))
