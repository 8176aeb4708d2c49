"""Appending to a ledger: content, authority, then duplicates, each with a status.

Control rows (seq, kind, worker, boot) tell what the coordinator has decided: REGISTER sets a worker's boot, ROLL and
WORKER_LOST raise the epoch and the accounting generation, WORKER_LOST also rolls the requests in flight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written
from .filters import content, content_valid

c = F.col
#: Entries are met with the control rows in force by ranges of so many seq numbers.
RANGE = 1 << 20
#: Within blocks of so many seq numbers the last start is found entry by entry.
BLOCK = 1 << 16
#: Control rows are sent to all tasks up to so many.
SENT = 1_000_000
_NOT_CONTENT = ("seq", "verdict", "status", "_valid", "_hash")
_FENCE = ("seq", "id", "request", "event_kind", "epoch", "accounting_gen", "src_worker", "auth_worker_boot", "request_gen", "auth_attempt", "attempt_gen")


def _sent(control: DataFrame) -> DataFrame:
    """Few ranges and workers are keys of all entries: entries dealt out by them would go to few tasks."""
    return F.broadcast(control) if control.count() <= SENT else control


def in_force(control: DataFrame, last_seq: int) -> DataFrame:
    """range, from, to, epoch, losses: the epoch and how many workers were lost so far by intervals of seq, once for each
    range of seq they touch. The control log has one row for each decision of the coordinator, so its window is small."""
    rolls = control.filter(c("kind").isin("ROLL", "WORKER_LOST")).select("seq", "kind").unionByName(control.sparkSession.createDataFrame([(-1, "ROLL")], "seq long, kind string"))
    order = W.orderBy("seq")
    losses = F.count(F.when(c("kind") == "WORKER_LOST", 1)).over(order)  # those at the same seq as well
    x = rolls.select(c("seq").alias("from"), F.row_number().over(order).cast("long").alias("epoch"), losses.alias("losses"), F.coalesce(F.lead("seq").over(order), F.lit(last_seq + 1)).alias("to"))
    return x.filter(c("from") < c("to")).withColumn("range", F.explode(F.sequence(F.floor(F.greatest("from", F.lit(0)) / RANGE), F.floor(c("to") / RANGE))))


def with_authority(entries: DataFrame, control: DataFrame) -> DataFrame:
    """``entries`` with cur_epoch, cur_losses (workers lost so far), cur_boot (of the worker) and cur_request_gen,
    cur_attempt, cur_attempt_gen (set by the request's last start up to the entry, accepted or not), as they were when each
    entry came."""
    last = entries.agg(F.max("seq")).first()[0] or 0
    x = entries.withColumn("range", F.floor(c("seq") / RANGE)).alias("e").join(_sent(in_force(control, last)).alias("f"), "range")
    x = x.filter((c("seq") > c("f.from")) & (c("seq") <= c("f.to"))).select("e.*", c("f.epoch").alias("cur_epoch"), c("f.losses").alias("cur_losses"))
    boots = control.filter("kind = 'REGISTER'").select("worker", "seq", "boot")
    ends = F.coalesce(F.lead("seq").over(W.partitionBy("worker").orderBy("seq")), F.lit(2**62))
    boots = boots.select(c("worker").alias("_w"), c("seq").alias("_from"), ends.alias("_to"), c("boot").alias("cur_boot"))
    x = x.join(_sent(boots), (c("src_worker") == c("_w")) & (c("seq") > c("_from")) & (c("seq") <= c("_to")), "left").drop("_w", "_from", "_to")
    # the last start up to an entry: within its block of seq by a window, from earlier blocks by a window over one row a
    # block, so that a request with a third of all entries is spread over its blocks
    block = F.floor(c("seq") / BLOCK)
    start = F.when(c("event_kind") == "REQUEST_START", F.struct(c("request_gen").alias("g"), c("auth_attempt").alias("a"), c("attempt_gen").alias("n")))
    x = x.withColumns({"_b": block, "_s": start})
    blocks = x.groupBy("request", "_b").agg(F.max(F.when(c("_s").isNotNull(), F.struct("seq", "_s"))).alias("_l"))
    before = W.partitionBy("request").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("request", "_b", F.last("_l", ignorenulls=True).over(before)["_s"].alias("_earlier"))
    upto = W.partitionBy("request", "_b").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_s", F.last("_s", ignorenulls=True).over(upto)).join(blocks, ["request", "_b"]).withColumn("_s", F.coalesce("_s", "_earlier"))
    return x.withColumns({"cur_request_gen": c("_s.g"), "cur_attempt": c("_s.a"), "cur_attempt_gen": c("_s.n")}).drop("_s", "_b", "_earlier")


def verdict(rolled: Column | None = None) -> Column:
    """The first check that fails, in order, or accept. What no start has set is not checked."""
    v = F.when(c("epoch") != c("cur_epoch"), "stale_epoch").when(c("accounting_gen") != c("cur_epoch"), "stale_generation")
    v = v.when(c("cur_boot").isNull(), "unknown_worker").when(c("auth_worker_boot") != c("cur_boot"), "stale_worker")
    if rolled is not None:
        v = v.when(rolled, "stale_generation")
    for own, now in (("request_gen", "cur_request_gen"), ("auth_attempt", "cur_attempt"), ("attempt_gen", "cur_attempt_gen")):
        v = v.when(c(now).isNotNull() & (c(own) != c(now)), "stale_generation")
    return v.otherwise("accept")


def fence(entries: DataFrame, control: DataFrame) -> DataFrame:
    """``entries`` with a verdict. Whether a request was rolled depends on which of its entries were accepted before a
    worker was lost; that is looked for only where a worker was lost at all."""
    x = with_authority(entries, control).withColumn("verdict", verdict())
    if control.filter("kind = 'WORKER_LOST'").head() is None:
        return x.drop("cur_losses")
    x = x.join(_rolled(x), ["request", "cur_losses"], "left")
    rolled = F.coalesce(c("_rolled") & (c("_start").isNull() | (c("seq") < c("_start"))), F.lit(False))
    x = x.select(*(k for k in x.columns if k not in ("cur_losses", "_rolled", "_start")), rolled.alias("rolled"))
    bad = c("rolled") & c("verdict").isin("accept", "stale_generation")
    return x.withColumn("verdict", F.when(bad, "stale_generation").otherwise(c("verdict")))


def _rolled(x: DataFrame) -> DataFrame:
    """request, cur_losses, _rolled, _start: whether a request was in flight at the last loss before the interval between
    losses, which rolls it up to its first start there.

    A rolled request stays in flight: its ends are not accepted until it starts anew, accepted or not. One that is not
    rolled at the first entry of an interval is not in flight either. So before its first start in an interval nothing
    changes, and from there on the last accepted start or end decides, if there is one. These are aggregates that combine on
    the map side, however many entries a request has; the window is over one row for each request and interval."""
    start, end, fine = c("event_kind") == "REQUEST_START", c("event_kind") == "REQUEST_END", c("verdict") == "accept"
    seqs = {"_start": (F.min, start), "_last_start": (F.max, start & fine), "_last_end": (F.max, end & fine)}
    parts = x.groupBy("request", "cur_losses").agg(*(f(F.when(which, c("seq"))).alias(k) for k, (f, which) in seqs.items()))
    began, ended = F.coalesce("_last_start", F.lit(-1)), F.when(c("_last_end") > c("_start"), c("_last_end")).otherwise(-1)
    flying = F.when(F.greatest(began, ended) >= 0, began > ended)
    before = W.partitionBy("request").orderBy("cur_losses").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_rolled", F.last(flying, ignorenulls=True).over(before)).filter("_rolled")
    return parts.select("request", "cur_losses", "_rolled", "_start")


def _digest(entries: DataFrame, keep: tuple[str, ...] = ()) -> Column:
    columns = [k for k in entries.columns if k not in (*_NOT_CONTENT, *keep) and not k.startswith("cur_") and k != "rolled"]
    # a hash passes over nulls, so their places are hashed as well
    return F.xxhash64(F.concat(*(F.when(c(k).isNull(), "0").otherwise("1") for k in columns)), content(columns))


def _looked_at(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return entries.withColumns({"_valid": F.coalesce(content_valid(), F.lit(False)), "_hash": _digest(entries, keep)})


def coordinate(entries: DataFrame, control: DataFrame) -> DataFrame:
    """seq, id, verdict and status of each entry: as ``append`` of ``fence``, but contents are hashed first, so that no
    shuffle moves whole entries, and verdicts are found once. Entries themselves are a join by seq away."""
    x = _looked_at(entries).select(*_FENCE, "_valid", "_hash")
    return append(written(fence(x, control).select("seq", "id", "verdict", "_valid", "_hash"), "fenced"))


def append(entries: DataFrame, known: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` with a status: invalid, stale (by the column verdict, if there is one), duplicate or
    duplicate_conflict of an entry with the same id that was accepted before, else accepted. ``known``: entries of the
    ledger so far. The first valid entry of an id is found by an aggregate, so an id may be repeated any number of times."""
    fresh = c("verdict") == "accept" if "verdict" in entries.columns else F.lit(True)
    x, digest = entries, _digest(entries, keep)
    if "_hash" not in x.columns:
        x = _looked_at(x, keep)
    x = x.withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    # tests inside the aggregates, not before them: a filter would be pushed below, with what the columns are made of in every place
    seq = F.when(c("_valid") & c("_fresh"), c("seq"))
    first = x.groupBy("id").agg(F.min(seq).alias("_seq"), F.min_by("_hash", seq).alias("_one"))
    if known is not None:
        first = first.unionByName(known.select("id", F.lit(-1).cast("long").alias("_seq"), digest.alias("_one")))
        first = first.groupBy("id").agg(F.min("_seq").alias("_seq"), F.min_by("_one", "_seq").alias("_one"))
    x = x.join(first, "id", "left")
    status = F.when(~c("_valid"), "invalid").when(~c("_fresh"), "stale").when(c("seq") == c("_seq"), "accepted")
    return x.withColumn("status", status.when(c("_hash") == c("_one"), "duplicate").otherwise("duplicate_conflict")).drop("_valid", "_fresh", "_hash", "_seq", "_one")


def replay(entries: DataFrame) -> DataFrame:
    """The entries of a ledger in order, each appended anew; a ledger in which one is rejected is refused."""
    told = append(entries)
    bad = told.filter("status <> 'accepted'").groupBy("status").count().collect()  # at most four rows
    if bad:
        raise ValueError("refused: " + ", ".join(f"{r['count']} {r['status']}" for r in sorted(bad)))
    return told.drop("status")


def authority_snapshot(control: DataFrame) -> DataFrame:
    """One row: epoch and accounting_gen after all decisions, and the number of connected workers."""
    rolls = F.count(F.when(c("kind").isin("ROLL", "WORKER_LOST"), 1)) + 1
    return control.agg(rolls.alias("epoch"), rolls.alias("accounting_gen"), F.count_distinct(F.when(c("kind") == "REGISTER", c("worker"))).alias("workers"))


def connected_workers(control: DataFrame) -> DataFrame:
    """worker, boot: what each worker has registered with last."""
    return control.filter("kind = 'REGISTER'").groupBy("worker").agg(F.max(F.struct("seq", "boot"))["boot"].alias("boot"))


def request_authority(entries: DataFrame) -> DataFrame:
    """request, request_gen, attempt, attempt_gen: what each request's last start has set; requests without one are left out."""
    last = F.max(F.when(c("event_kind") == "REQUEST_START", F.struct("seq", "request_gen", c("auth_attempt").alias("attempt"), "attempt_gen"))).alias("s")
    return entries.groupBy("request").agg(last).filter("s IS NOT NULL").select("request", "s.request_gen", "s.attempt", "s.attempt_gen")
