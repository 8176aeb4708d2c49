import random

import pytest

from tallywright.operators.account import reconcile, with_ratios, with_requested
from tallywright.operators.batch import allocate, batch_totals, member_accounts, overhead
from tallywright.operators.pricing import Policy, fleet, latest, price, read_policy, reconciles

from .build import entry, ident, ledger, numbered

BASIC = numbered(
    ("REQUEST_START", 0, "count", 1.0), ("RESERVE", 1, "count", 1.1), ("KV_ALLOCATE", 4096, "bytes", 1.2), ("TRANSFER_H2D", 1024, "bytes", 1.3, 1.35), ("PREFILL", 0.5, "seconds", 1.4, 1.9),
    ("DECODE", 32, "count", 2.0, 2.4), ("MODEL_RESIDENCY", 1048576, "bytes", 1.4, 2.4), ("TRANSFER_D2H", 256, "bytes", 2.5), ("RELEASE", 1, "count", 2.6), ("REQUEST_END", 0, "count", 2.7),
)


def account(spark, rows, **kw):
    return with_ratios(reconcile(ledger(spark, rows), **kw)).collect()[0]


def test_basic_request(spark):
    a = account(spark, BASIC)
    assert a["outcome"] == "completed" and a["generated_tokens"] == 32 and a["attempt_count"] == 1 and a["entries"] == 10
    assert [a[k] for k in ("wall_latency_s", "prefill_s", "decode_s", "kv_allocated", "kv_peak", "h2d_bytes", "d2h_bytes")] == pytest.approx([1.7, 0.5, 0.4, 4096, 4096, 1024, 256])
    assert (a["reservations_acquired"], a["reservations_released"]) == (1, 1)
    assert a["model_byte_seconds"] == pytest.approx(1048576, abs=1e-3)


def test_retry(spark):
    rows = numbered(
        ("REQUEST_START", 0, "count", 1.0), ("PREFILL", 0.1, "seconds", 1.1, 1.2), ("FAILURE", 0, "count", 1.3), ("RETRY", 1, "count", 1.4), ("REQUEST_START", 0, "count", 1.5, None, 1, 2),
        ("PREFILL", 0.1, "seconds", 1.6, 1.7, 1, 2), ("DECODE", 16, "count", 1.8, 1.9, 1, 2), ("REQUEST_END", 0, "count", 2.0, None, 1, 2),
    )
    a = account(spark, rows)
    assert (a["outcome"], a["retries"], a["attempt_count"], a["generated_tokens"], a["winner"]) == ("completed", 1, 2, 16, ident(2))
    assert (a["failed_work_s"], a["execution_s"], a["wall_latency_s"]) == pytest.approx((0.1, 0.2, 0.5))
    assert a["waste_ratio"] == pytest.approx(1 / 3)


def test_speculation_and_reuse(spark):
    rows = numbered(
        ("REQUEST_START", 0, "count", 1.0), ("SPECULATION_PROPOSED", 12, "count", 1.1), ("SPECULATION_ACCEPTED", 8, "count", 1.2), ("SPECULATION_REJECTED", 4, "count", 1.3, 1.4), ("DECODE", 24, "count", 1.5, 1.7),
        ("KV_REUSE", 8192, "bytes", 1.7), ("REUSE_AVOIDED", 0.2, "seconds", 1.7), ("ENERGY", 2, "wh", 1.7), ("ENERGY", 5, "joules", 1.7), ("REQUEST_END", 0, "count", 1.8),
    )
    a = account(spark, rows)
    assert (a["spec_proposed"], a["spec_accepted"], a["spec_rejected"], a["generated_tokens"]) == (12, 8, 4, 32)
    assert (a["spec_wasted_s"], a["spec_efficiency"], a["kv_reuse"], a["reuse_credit"], a["energy_joules"]) == pytest.approx((0.1, 8 / 12, 8192, 0.2, 7205))


def test_outcomes_and_ties(spark):
    rows = numbered(
        ("REQUEST_START", 0, "count", 1.0, None, 1, 1), ("CANCELLATION", 0, "count", 1.1, None, 1, 1), ("REQUEST_START", 0, "count", 1.0, None, 2, 1), ("DECODE", 4, "count", 1.0, 1.5, 2, 1),
        ("REQUEST_END", 0, "count", 2.0, None, 3, 1), ("REQUEST_END", 0, "count", 2.0, None, 3, 2), ("DECODE", 3, "count", 1.0, 1.5, 3, 2), ("DECODE", 7, "count", 1.0, 1.5, 3, 1),
    )
    got = {r["request"]: r for r in reconcile(ledger(spark, rows)).collect()}
    assert [got[ident(i)]["outcome"] for i in (1, 2, 3)] == ["cancelled", "failed", "completed"]
    assert got[ident(2)]["generated_tokens"] == 0 and got[ident(2)]["unattributed_s"] == pytest.approx(0.5)
    assert got[ident(3)]["winner"] == ident(2) and got[ident(3)]["generated_tokens"] == 3  # the larger id wins a tie


def fold(rows):
    """The same, entry by entry."""
    out = {}
    for kind in ("KV", "TENSOR"):
        live = peak = 0.0
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["event_kind"] == f"{kind}_ALLOCATE":
                live += r["value"]
                peak = max(peak, live)
            elif r["event_kind"] == f"{kind}_RELEASE":
                live = max(0.0, live - r["value"])
        out[f"{kind.lower()}_peak"] = peak
    return out


@pytest.mark.parametrize("block", [1 << 20, 7, 1])
def test_peaks_do_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    kinds = ["KV_ALLOCATE", "KV_RELEASE", "TENSOR_ALLOCATE", "TENSOR_RELEASE", "DECODE"]
    rows = [entry(i, rng.choice(kinds), rng.randint(0, 50), "bytes", 1.0 + i, None, rng.randint(1, 5), rng.randint(1, 3)) for i in range(400)]
    got = {r["request"]: r for r in reconcile(ledger(spark, rows), block=block).collect()}
    for n in range(1, 6):
        want = fold([r for r in rows if r["request"] == ident(n)])
        assert {k: got[ident(n)][k] for k in want} == want


def test_unknown_request_is_a_failed_account(spark):
    asked = spark.createDataFrame([(ident(1),), (ident(9),)], "request string")
    got = {r["request"]: r for r in with_requested(reconcile(ledger(spark, BASIC)), asked).collect()}
    assert (got[ident(9)]["outcome"], got[ident(9)]["attempt_count"], got[ident(9)]["execution_s"]) == ("failed", 0, 0.0)
    assert reconcile(ledger(spark, [])).count() == 0


def test_pricing_keeps_the_account(spark, tmp_path):
    a = with_ratios(reconcile(ledger(spark, BASIC)))
    two = [Policy(ident(1), gpu_per_second=2.0, transfer_per_gib=0.5), Policy(ident(2), gpu_per_second=4.0, transfer_per_gib=1.5)]
    c = {r["policy"]: r for r in price(a, two).collect()}
    assert c[ident(2)]["compute_cost"] == pytest.approx(2 * c[ident(1)]["compute_cost"]) and c[ident(1)]["compute_cost"] == pytest.approx(1.8)
    assert c[ident(2)]["transfer_cost"] == pytest.approx(3 * c[ident(1)]["transfer_cost"])
    assert all(r["reconciles"] for r in reconciles(price(a, two)).collect())
    (tmp_path / "p").write_text("# rates\ngpu_per_second=2.5\ncurrency=eur\nother=1\n\nenergy_per_kwh=0.3\n")
    p = read_policy(spark, str(tmp_path / "p"))
    assert (p.gpu_per_second, p.currency, p.energy_per_kwh, p.cpu_per_second) == (2.5, "eur", 0.3, 0.0) and p.all_finite()
    assert latest([two[1], two[0], Policy(ident(1), name="new")])[0].name == "new"
    f = fleet(a, price(a, two[:1])).collect()[0]
    assert f["requests"] == 1 and f["tokens"] == 32 and f["total_cost"] == pytest.approx(c[ident(1)]["total_cost"])
    assert fleet(a.limit(0)).collect()[0]["requests"] == 0


@pytest.mark.parametrize("policy, column, weights, want", [
    ("equal_share", "generated_tokens", [1, 2, 3], [100 / 3] * 3), ("proportional_tokens", "generated_tokens", [10, 20, 30], [100 / 6, 100 / 3, 50]),
    ("weighted", "weight", [3, 1, 0], [75, 25, 0]), ("proportional_execution", "execution_s", [0, 0, 0], [100 / 3] * 3), ("direct_ownership", "weight", [1, 1, 1], [100, 0, 0]),
])
def test_allocation(spark, policy, column, weights, want):
    m = spark.createDataFrame([("b", i, float(w)) for i, w in enumerate(weights)], f"batch string, member int, {column} double")
    t = spark.createDataFrame([("b", 100.0), ("empty", 5.0)], "batch string, total double")
    s = allocate(m, t, policy)
    assert [r["share"] for r in s.orderBy("member").collect()] == pytest.approx(want)
    o = {r["batch"]: r for r in overhead(s, t).collect()}
    assert o["b"]["reconciles"] and abs(o["b"]["unallocated"]) < 1e-9 and o["empty"]["unallocated"] == 5.0


def test_batches(spark):
    rows = []
    for m, tokens in ((1, 10), (2, 20), (3, 30)):
        for kind, v, s, e in (("REQUEST_START", 0, 1.0, None), ("DECODE", tokens, 1.4, 1.5), ("GPU_EXECUTION", 0, 1.4, 1.6), ("REQUEST_END", 0, 2.0, None)):
            rows.append(entry(len(rows), kind, v, "count", s, e, m, 1, metadata={"batch": ident(11)}))
    rows.append(entry(99, "DECODE", 5, "count", 1.0, 1.1, 4, 1))  # without a tag: in every batch
    e = ledger(spark, rows)
    got = batch_totals(member_accounts(e, [ident(11)], "exclude")).collect()[0]
    assert (got["members"], got["generated_tokens"], got["partial_completion"]) == (3, 60, False) and got["gpu_s"] == pytest.approx(0.9)
    both = {r["batch"]: r for r in batch_totals(member_accounts(e, [ident(11), ident(12)])).collect()}
    assert both[ident(11)]["members"] == 4 and both[ident(11)]["partial_completion"] and both[ident(12)]["members"] == 1
