import glob
import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import filters, ingest, reports
from tallywright.operators.reports import account_json, account_text, compare
from tallywright.operators.account import measures, reconcile, summaries, with_ratios, with_requested
from tallywright.schema import EVENT_KINDS, code_of, hex_id, parsed_id
from tallywright.sources import frames

from .build import entry, ident, ledger


def statuses(df):
    return [r["status"] for r in df.orderBy("seq").collect()]


def test_append_statuses(spark):
    one = entry(0, "DECODE", 1)
    rows = [one, one | {"seq": 1}, one | {"seq": 2, "value": 7.0}, entry(3, "PREFILL", -1, "seconds"), entry(4, "DECODE", 1.5), entry(5, "COST_ADJUSTMENT", -2, "currency", resource_kind="cost"), entry(6, "DECODE", float("nan"))]
    assert statuses(ingest.append(ledger(spark, rows))) == ["accepted", "duplicate", "duplicate_conflict", "invalid", "invalid", "accepted", "invalid"]
    known = ledger(spark, [one | {"metadata": {"a": "b"}}])
    again = ledger(spark, [one | {"seq": 9}, one | {"seq": 10, "metadata": {"a": "b"}}, entry(11, "DECODE", 2)])
    assert statuses(ingest.append(again, known)) == ["duplicate_conflict", "duplicate", "accepted"]
    assert ingest.append(ledger(spark, [])).count() == 0


def control(spark, *rows):
    return spark.createDataFrame([(-1, "REGISTER", ident(10), ident(11)), *rows], "seq long, kind string, worker string, boot string")


def test_fence_order(spark):
    start = entry(0, "REQUEST_START")
    bad = [dict(epoch=0, auth_worker_boot=ident(13)), dict(accounting_gen=3), dict(src_worker=ident(55)), dict(auth_worker_boot=ident(13)), dict(request_gen=4), dict(auth_attempt=ident(9)), dict(attempt_gen=2), {}]
    rows = [start] + [entry(i + 1, "DECODE", 1) | b for i, b in enumerate(bad)]
    got = [r["verdict"] for r in ingest.fence(ledger(spark, rows), control(spark)).orderBy("seq").collect()]
    assert got == ["accept", "stale_epoch", "stale_generation", "unknown_worker", "stale_worker", "stale_generation", "stale_generation", "stale_generation", "accept"]
    stale = ingest.append(ingest.fence(ledger(spark, [start, start | {"seq": 1, "epoch": 0}]), control(spark)))
    assert statuses(stale) == ["accepted", "stale"]  # a duplicate with stale authority is stale


def test_lost_worker_rolls_requests_in_flight(spark):
    new = dict(epoch=2, accounting_gen=2)
    rows = [entry(0, "REQUEST_START"), entry(1, "DECODE", 1), entry(3, "REQUEST_START", request=2), entry(4, "REQUEST_END", request=2), entry(6, "DECODE", 1), entry(7, "DECODE", 1) | new,
            entry(8, "DECODE", 1, request=2) | new, entry(9, "REQUEST_START", attempt=2) | new, entry(10, "DECODE", 2, attempt=2) | new, entry(11, "DECODE", 2, attempt=1) | new]
    got = ingest.fence(ledger(spark, rows), control(spark, (5, "WORKER_LOST", None, None)))
    assert [r["verdict"] for r in got.orderBy("seq").collect()] == ["accept"] * 4 + ["stale_epoch", "stale_generation", "accept", "accept", "accept", "stale_generation"]


def test_filters(spark):
    rows = [entry(i, k, 1, "count", 1.0 + i, adapter=a, metadata=m) for i, (k, a, m) in enumerate([("DECODE", None, {"batch": "x"}), ("DECODE", ident(3), {}), ("RETRY", ident(3), {"outcome": "failed"})])]
    e = ledger(spark, rows)
    seqs = lambda **kw: [r["seq"] for r in filters.query(e, **kw).orderBy("seq").collect()]
    assert seqs() == [0, 1, 2] and seqs(event_kind="DECODE", adapter=ident(3)) == [1] and seqs(adapter=ident(3)) == [1, 2]
    assert seqs(start_ns=2_000_000_000, end_ns=3_000_000_000) == [1, 2] and seqs(batch="x") == [0] and seqs(outcome="failed") == [2]
    assert seqs(pricing_policy="p") == [0, 1, 2] and seqs(pricing_policy="p", strict=True) == []
    with pytest.raises(TypeError):
        filters.query(e, color="red")


def test_ids_and_names(spark):
    r = spark.range(1).select(hex_id(F.lit(255)).alias("h"), parsed_id(F.lit("AB" * 16)).alias("p"), parsed_id(F.lit("zz")).alias("bad"), code_of(F.lit("ENERGY"), EVENT_KINDS).alias("k"), code_of(F.lit("?"), EVENT_KINDS, default=1).alias("d")).first()
    assert tuple(r) == (ident(255), "ab" * 16, None, 36, 1)


def test_frames_round_trip_and_rejections(spark, tmp_path):
    rows = [entry(0, "REQUEST_START", adapter=ident(4), metadata={"batch": "é", "a": ""}), entry(1, "DECODE", 8, "count", 1.4, 1.6), entry(2, "REQUEST_END")]
    path = str(tmp_path / "l")
    assert frames.write(ledger(spark, rows).coalesce(1), path).first()["frames"] == 3
    back = frames.read(spark, path)
    drop = lambda r: {k: v for k, v in r.asDict().items() if k != "seq"}
    assert [drop(r) for r in back.orderBy("seq").collect()] == [{k: v for k, v in r.items() if k != "seq"} for r in rows]
    assert len(frames.encode(entry(1, "DECODE", 8))) == 361
    data = open(f"{path}/part-00000.frames", "rb").read()
    first = data[28 : 28 + 8 + int.from_bytes(data[28:32], "big")]
    for bad, why in ((b"X" + data[1:], "magic"), (data + b"abc", "truncated"), (data[:40] + bytes([data[40] ^ 1]) + data[41:], "corrupt"), (data + first, "duplicate"), (data[:10], "short"), (data[:8] + b"\0\0\0\7" + data[12:], "version")):
        with pytest.raises(frames.Rejected, match=why):
            list(frames.frames_of(bad))
    with pytest.raises(frames.Rejected, match="negative"):
        frames.encode(entry(1, "KV_ALLOCATE", -5, "bytes"))
    with pytest.raises(frames.Rejected, match="whole"):
        frames.encode(entry(1, "DECODE", 1.5))
    (tmp_path / "l" / "bad.frames").write_bytes(data + b"abc")
    got = {r["ok"]: (r["reason"], r["frames"]) for r in frames.recover(spark, path).collect()}
    assert got[True] == ("", 3) and "truncated" in got[False][0]


def test_digest_is_bound_to_order_and_content(spark):
    rows = [entry(i, "DECODE", i) for i in range(50)]
    d = lambda rows, n: frames.digest(ledger(spark, rows).repartition(n)).first()["digest"]
    assert d(rows, 1) == d(rows, 7) != d([r | {"seq": 49 - r["seq"]} for r in rows], 3)
    assert ledger(spark, rows).select(frames.derived_id().alias("d")).distinct().count() == 50


def test_reports(spark):
    rows = [entry(0, "REQUEST_START"), entry(1, "DECODE", 5, "count", 1.0, 1.5), entry(2, "REQUEST_END", start=2.0), entry(3, "REQUEST_START", request=2)]
    a = with_ratios(reconcile(ledger(spark, rows)))
    assert '"generated_tokens":5' in account_json(a).filter(F.col("request") == ident(1)).first()["value"]
    text = account_text(a).filter(F.col("request") == ident(1)).first()["value"].split("\n")
    assert len(text) == 34 and text[1:3] == ["  outcome      completed", "  wall_latency_s 1 [derived]"] and "  decode_s     0.5" in text
    pairs = spark.createDataFrame([(ident(1), ident(2))], "request_a string, request_b string")
    got = {r["measure"]: (r["a"], r["b"]) for r in compare(a, pairs).collect()}
    assert got["generated_tokens"] == (5.0, 0.0)


def test_order_of_a_ledger_through_several_files(spark, tmp_path):
    rows = [entry(i, "KV_ALLOCATE" if i % 3 else "KV_RELEASE", 1 + i % 7, "bytes", 1.0 + i) for i in range(200)]
    path = str(tmp_path / "many")
    assert frames.write(ledger(spark, rows).repartition(5, "id"), path, files=6).count() == 6
    ids = lambda df: [r["id"] for r in df.orderBy("seq").collect()]
    assert ids(frames.load(spark, path)) == [r["id"] for r in rows]
    more = [entry(i, "DECODE", 1) for i in range(1000, 1030)]
    assert frames.add(ledger(spark, more), path, files=2).count() == 2
    assert ids(frames.load(spark, path)) == [r["id"] for r in rows + more] and len({r["seq"] for r in frames.load(spark, path).collect()}) == 230
    with pytest.raises(frames.Rejected, match="duplicate"):
        frames.add(ledger(spark, more[:1]), path)
    frames.write(ledger(spark, more[:1]), path, after=50).count()
    with pytest.raises(frames.Rejected, match="duplicate"):
        frames.load(spark, path)


def test_replay_refuses_rejected_entries(spark):
    one = entry(0, "DECODE", 5)
    assert ingest.replay(ledger(spark, [one, entry(1, "DECODE", 6)])).count() == 2
    for bad in (one | {"seq": 1}, one | {"seq": 1, "value": 7.0}, entry(1, "KV_ALLOCATE", -1, "bytes")):
        with pytest.raises(ValueError, match="refused: 1"):
            ingest.replay(ledger(spark, [one, bad]))


def test_known_entries_without_metadata(spark):
    x = ledger(spark, [entry(i, "DECODE", 1 + i) for i in range(5)]).drop("metadata")
    assert {r["status"] for r in ingest.append(x, x).collect()} == {"duplicate"}
    changed = x.withColumns({"adapter": F.lit(None).cast("string"), "pricing_policy": F.lit("p")})
    other = x.withColumns({"adapter": F.lit("p"), "pricing_policy": F.lit(None).cast("string")})
    assert {r["status"] for r in ingest.append(changed, other).collect()} == {"duplicate_conflict"}


def test_fence_over_blocks(spark, monkeypatch):
    rows = [entry(i, "REQUEST_START" if i % 40 == 0 else "DECODE", 1, request=1 + i % 2, attempt=1 + i // 60 % 2) for i in range(400)]
    whole = {r["seq"]: r["verdict"] for r in ingest.fence(ledger(spark, rows), control(spark)).collect()}
    monkeypatch.setattr(ingest, "BLOCK", 7)
    assert {r["seq"]: r["verdict"] for r in ingest.fence(ledger(spark, rows), control(spark)).collect()} == whole and len(set(whole.values())) == 2
    now, want = {}, {}
    for r in rows:
        if r["event_kind"] == "REQUEST_START":
            now[r["request"]] = r["auth_attempt"]
        want[r["seq"]] = "accept" if now.get(r["request"], r["auth_attempt"]) == r["auth_attempt"] else "stale_generation"
    assert whole == want


def test_stream_of_several_files_knows_earlier_batches(spark, small, tmp_path):
    import shutil

    from tallywright.scratch import new_path
    from tallywright.sources.events import to_ledger
    from tallywright.streaming import ingest as stream

    events = spark.read.parquet(f"{small}/events.parquet")
    parts = {"events": events.filter("event_id % 2 = 0"), "events_2": events.filter("event_id % 2 = 0"), "events_3": events.filter("event_id % 2 = 1")}
    for i, (name, part) in enumerate(parts.items()):
        part.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        shutil.copy(next((tmp_path / f"w{i}").glob("*.parquet")), tmp_path / f"{name}.parquet")
    ledger_, acks = stream.append_stream(to_ledger(stream.read_stream(spark, str(tmp_path))), new_path(spark, "ledger"), new_path(spark, "acks"), new_path(spark, "state"))
    half, n = parts["events"].count(), events.count()
    assert {r["status"]: r["count"] for r in acks.groupBy("status").count().collect()} == {"accepted": n, "duplicate": half}
    assert ledger_.count() == n == ledger_.select("id").distinct().count()


def test_losses_against_a_fold_of_the_whole_log(spark):
    rng = random.Random(17)
    losses = [40, 90]
    rows = []
    for i in (i for i in range(150) if i not in losses):
        epoch = 1 + sum(i > x for x in losses) - (rng.random() < 0.1)
        rows.append(entry(i, rng.choice(["REQUEST_START", "DECODE", "DECODE", "DECODE", "REQUEST_END"]), 1, request=rng.randint(1, 6), attempt=rng.randint(1, 2)) | dict(epoch=epoch, accounting_gen=epoch))
    got = {r["seq"]: r["verdict"] for r in ingest.fence(ledger(spark, rows), control(spark, *((x, "WORKER_LOST", None, None) for x in losses))).collect()}
    started, flying, rolled, want = {}, set(), set(), {}
    for seq in range(150):
        if seq in losses:
            rolled |= flying
            continue
        r = next(r for r in rows if r["seq"] == seq)
        q, now = r["request"], 1 + sum(seq > x for x in losses)
        if r["event_kind"] == "REQUEST_START":
            started[q] = r["auth_attempt"]
            rolled.discard(q)
        want[seq] = "stale_epoch" if r["epoch"] != now else "stale_generation" if q in rolled or started.get(q, r["auth_attempt"]) != r["auth_attempt"] else "accept"
        if want[seq] == "accept":
            flying = flying | {q} if r["event_kind"] == "REQUEST_START" else flying - {q} if r["event_kind"] == "REQUEST_END" else flying
    assert got == want and len(set(want.values())) == 3


def test_number_text(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randrange(10**9) * 1.0, rng.random() * 10 ** rng.randrange(-8, 9), rng.randrange(10**8) / 8, rng.randrange(10**7) / 1000]) for _ in range(5000)]
    values += [0.0, -1.5, 1234565.0, 1234575.0, -1234565.0, 123456.5, 999999.5, 1e20, 1e-5, 0.00009999995, 48128.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(reports.number_text(F.col("v"))).collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_list_as_csv(spark, tmp_path):
    x = ledger(spark, [entry(i, "KV_ALLOCATE", 1234565 + i, "bytes") for i in range(20)])
    reports.write_csv(x.repartition(3), str(tmp_path / "csv"))
    files = [open(f).read().splitlines() for f in sorted(glob.glob(str(tmp_path / "csv" / "*.csv")))]
    assert {f[0] for f in files} == {reports.CSV_HEADER}
    assert [line for f in files for line in f[1:]] == [r["value"] for r in reports.list_csv(x).orderBy("seq").collect()]
    assert files[0][1].startswith(f"{ident(1000)},KV_ALLOCATE,kv,1.23456e+06,bytes,measured,")


def test_measures_have_units_and_provenance(spark):
    a = with_ratios(reconcile(ledger(spark, [entry(0, "ENERGY", 2, "wh"), entry(1, "ENERGY", 0, "wh", request=2)])))
    got = {(r["request"], r["measure"]): (r["value"], r["unit"], r["provenance"]) for r in measures(a).collect()}
    assert len(got) == 2 * 29
    assert got[ident(1), "energy_joules"] == (7200.0, "joules", "derived") and got[ident(2), "energy_joules"] == (0.0, "joules", "unavailable")
    assert got[ident(1), "tensor_byte_seconds"] == (0.0, "byte-seconds", "unavailable") and got[ident(1), "kv_peak"] == (0.0, "bytes", "derived")
    none = with_requested(a, spark.createDataFrame([(ident(9),)], "request string"))
    assert [r["provenance"] for r in measures(none).filter("measure = 'cpu_s'").collect()] == ["unavailable"]
    assert [r["reason"] for r in summaries(none).collect()] == ["reconciled 0 entries across 0 attempt(s)"]


def test_files_are_read_frame_by_frame(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%20c"  # a name that a URI would escape
    assert frames.write(ledger(spark, [entry(i, "DECODE", i) for i in range(20)]), str(folder), files=1).count() == 1
    name, asked = str(folder / "part-00000.frames"), []

    class Counted:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            asked.append(n)
            return self.data.read(n)

    with open(name, "rb") as f:
        size = len(f.read())
        f.seek(0)
        assert [e["value"] for e in frames._frames(Counted(f), size)] == [float(i) for i in range(20)]
    assert max(asked) < 400 < size / 20 * 2  # no read of more than a frame
    assert "content" not in frames._files(spark, str(folder)).columns  # no file is a row
    assert [r["value"] for r in frames.load(spark, str(folder)).orderBy("seq").collect()] == [float(i) for i in range(20)]
    monkeypatch.setattr(frames, "PER_FILE", 7)
    assert frames.write(ledger(spark, [entry(i, "DECODE", i) for i in range(20)]), str(tmp_path / "more")).count() == 3


def test_files_of_the_queries_grow_in_number_with_the_entries(spark, small, monkeypatch):
    from tallywright.plans import queries

    n = spark.read.parquet(f"{small}/events.parquet").count()
    monkeypatch.setattr(frames, "PER_FILE", n // 8)
    assert len(glob.glob(f"{queries._framed(spark, small).removeprefix('file://')}/*.frames")) >= 8


def test_losses_fold_whole_rows_nowhere(spark):
    rng = random.Random(23)
    for losses in ([30], [20, 21, 60, 61, 62, 110]):
        rows = []
        for i in (i for i in range(130) if i not in losses):
            epoch = 1 + sum(i > x for x in losses) - (rng.random() < 0.2)
            rows.append(entry(i, rng.choice(["REQUEST_START", "DECODE", "DECODE", "REQUEST_END"]), 1, request=rng.randint(1, 9), attempt=rng.randint(1, 2)) | dict(epoch=epoch, accounting_gen=epoch))
        x = ingest.fence(ledger(spark, rows), control(spark, *((x, "WORKER_LOST", None, None) for x in losses), (70, "ROLL", None, None)))
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan  # a request with a third of all entries would be folded by one task
        got = {r["seq"]: (r["verdict"], r["rolled"]) for r in x.collect()}
        rolled, flying, started, want, at = set(), set(), {}, {}, 0
        for r in rows:
            seq, q, kind = r["seq"], r["request"], r["event_kind"]
            while at < len(losses) and losses[at] < seq:
                rolled, at = rolled | flying, at + 1
            if kind == "REQUEST_START":
                started[q], rolled = r["auth_attempt"], rolled - {q}
            now = 1 + sum(seq > y for y in (*losses, 70))
            stale = q in rolled or started.get(q, r["auth_attempt"]) != r["auth_attempt"]
            want[seq] = ("stale_epoch" if r["epoch"] != now else "stale_generation" if stale else "accept", q in rolled)
            if want[seq][0] == "accept":
                flying = flying | {q} if kind == "REQUEST_START" else flying - {q} if kind == "REQUEST_END" else flying
        assert got == want and any(r for _, r in want.values())


def test_coordinate_equals_append_of_fence(spark, small):
    from tallywright.plans.queries import control_log
    from tallywright.sources.events import read_events

    e = read_events(spark, small)
    x = e.unionByName(e.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 2000)).unionByName(e.filter("seq % 7 = 0").withColumns({"seq": F.col("seq") + 4000, "tenant": F.lit(ident(3))}))
    log = control_log(e).replace("ROLL", "WORKER_LOST", "kind")
    told = lambda df: sorted((r["seq"], r["id"], r["verdict"], r["status"]) for r in df.collect())
    now = told(ingest.coordinate(x, log))
    assert now == told(ingest.append(ingest.fence(x, log))) and {s for *_, s in now} == {"accepted", "duplicate", "duplicate_conflict", "stale"}


def test_decoding_at_once_equals_decoding_by_field():
    rng, kept = random.Random(4), 0

    def told(f, payload):
        try:
            return f(payload)
        except (frames.Rejected, UnicodeDecodeError) as e:
            return str(e)

    for i in range(1500):
        e = entry(i, "DECODE", i, end=rng.choice([None, 2.0]), adapter=rng.choice([None, ident(4)]), accounting_policy=rng.choice([None, ident(8)]), pricing_policy=rng.choice([None, ident(3)]), metadata=rng.choice([{}, {"b": "é", "a": ""}]))
        payload = bytearray(frames.encode(e)[8:])
        assert {k: v for k, v in frames.decode(bytes(payload)).items()} == {k: v for k, v in e.items() if k != "seq"}
        for _ in range(rng.randint(1, 3)):
            payload[rng.randrange(len(payload))] = rng.choice([0, 1, 2, 255])
        payload = bytes(payload[: rng.choice([len(payload), len(payload), rng.randrange(1, len(payload))])]) + rng.choice([b"", b"", b"x"])
        a, b = told(frames.decode, payload), told(frames._decode_by_field, payload)
        assert repr(a) == repr(b)
        kept += isinstance(a, dict)
    assert 50 < kept < 1450
