"""N-gram Jaccard join: sets of word shingles that are alike, and the components that their links make.

The join is exact for 64-bit shingle hashes. All sets are ordered by one global order of shingles, rare ones first. If
two sets are alike, the first few shingles of both (their prefixes) meet, so an index of the prefixes finds every pair.
Set relations save most of the work:

1. A shingle that occurs in one document only can't be met. A document whose prefix is made of such shingles is alone;
   that is proven without looking at any pair. Documents' hashes go packed, by ranges of the hash space, to the tasks
   that count them, and a count for each document comes back.
2. Documents with equal sets are one class; only its smallest doc_id goes on.
3. Each list of the index is first met by its hub, the smallest doc_id in it: as many pairs as entries.
4. What a set has in common with its hub answers for it from then on. Entries of a list with the same hub form a block,
   kept with its range of sizes, its largest remainder by position and its largest difference from the hub. Blocks in
   one component need no comparison. Of two other blocks first the hubs are compared; the number of shingles that these share, and
   the differences, bound what any pair of the two blocks can share, and a block that can't reach the threshold by its
   position or by this bound is skipped whole.
5. Only pairs of entries that no bound decides are compared.

So copies and near copies of one text cost what their number is, not its square, and no link between components is lost.

Edge cases: a document without words, or null, has the empty set and is linked with nothing; one with fewer than
``width`` words has its whole sequence as its one shingle; rows that repeat doc_id and text are one document and give
one row; doc_ids are meant to be unique, but texts that share one get a row each and the links of both; a null doc_id is linked with
nothing and has a null component; an empty table gives an empty result; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, buffers, narrow, shingle_sets, slices, wide
from .components import components
from .scratch import drop, small_batches, written

WIDTH, PERCENT = 5, 75
#: Text hashed into one chunk and counted in one task; the part of the hash space that step 1 looks at.
CHUNK, PART, PROBED = 8 << 20, 16 << 20, 0.5
#: At most so many ranges of the hash space, so that a chunk has many numbers for each of them; beyond, ranges hold more.
PARTS = 1 << 16
#: Up to so many class representatives are sent to all executors to pick their texts; beyond, texts are shuffled.
BROADCAST = 1_000_000


def prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Length of the prefix of a set of n: two alike sets share a shingle of both prefixes."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def _pack(reduced: np.ndarray) -> bytes:
    """Ascending numbers as byte planes of their differences."""
    steps = np.diff(reduced, prepend=U64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


class Space:
    """How the hash space is reduced and dealt: enough bits that few of all shingles collide, parts of bounded load."""

    def __init__(self, text_bytes: int):
        self.bits = min(48, max(24, math.ceil(math.log2(max(2, text_bytes))) + 6))
        self.parts = min(PARTS, max(1, math.ceil(text_bytes / PART)))

    def reduce(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U64(64 - self.bits)

    def bounds(self, probed: float) -> np.ndarray:
        top = int(probed * 2**self.bits)
        return np.array([top * p // self.parts for p in range(self.parts + 1)], np.uint64)


_PACKED = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_PACKED_SQL = "part long, chunk long, kind int, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _PACKED)], schema=_PACKED)


def _asked(once: np.ndarray, who: np.ndarray) -> bytes:
    """Which numbers one document of the chunk has, and that document."""
    return np.packbits(once).tobytes() + who[once].tobytes()


def _repeated(tables: list[np.ndarray]) -> np.ndarray:
    """Numbers that occur more than once in all tables, ascending."""
    x = np.sort(np.concatenate(tables)) if tables else np.zeros(0, np.uint64)
    again = x[1:][x[1:] == x[:-1]]
    return again[np.concatenate([[True], again[1:] != again[:-1]])] if len(again) else again


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def profiles(docs: DataFrame, space: Space, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, _text (a hash of the text), n, sig_a, sig_b (of the set), alone: whether step 1 proves that no other
    document is like this one."""
    cut = space.bounds(PROBED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = buffers(batch.column(2))
            for a, b in slices(offsets, CHUNK):
                for a, b in ((x, min(b, x + 60_000)) for x in range(a, b, 60_000)):
                    chunk, number = task << 32 | number, number + 1
                    n, sig_a, sig_b, keys = np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64), []
                    valid = ~np.asarray(batch.column(0).slice(a, b - a).is_null())
                    for c, d, values, bounds in shingle_sets(batch.column(2).slice(a, b - a), width):
                        n[c:d] = np.diff(bounds)
                        total = np.zeros((2, len(values) + 1), np.uint64)
                        np.cumsum(values, out=total[0, 1:])
                        np.cumsum((values ^ (values >> U64(29))) * U64(0x9FB21C651E98DF25), out=total[1, 1:])
                        for sig, t in ((sig_a, total[0]), (sig_b, total[1])):
                            sig[c:d] = t[bounds[1:]] - t[bounds[:-1]]
                        r = space.reduce(values)
                        who = np.repeat(np.arange(c, d), np.diff(bounds))
                        some = (r < cut[-1]) & valid[who]
                        keys.append(r[some] << U64(16) | who[some].astype(np.uint64))
                    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                    r, who = keys >> U64(16), (keys & U64(0xFFFF)).astype(np.uint16)
                    # a number goes once, however many documents of the chunk have it; only of one document is it asked
                    r, first, times = np.unique(r, return_index=True, return_counts=True)
                    who, at = who[first], np.searchsorted(r, cut)
                    rows = [(p, chunk, 1, _pack(r[x:y]), _asked(times[x:y] == 1, who[x:y])) for p, (x, y) in enumerate(zip(at, at[1:])) if y > x]
                    ids = batch.column(0).slice(a, b - a).fill_null(0).to_numpy().astype(np.int64)
                    text = batch.column(1).slice(a, b - a).to_numpy().astype(np.int64)
                    what = np.stack([ids, valid.astype(np.int64), text, n, sig_a.view(np.int64), sig_b.view(np.int64)])
                    rows.append((chunk % space.parts, chunk, 0, what.tobytes(), b""))
                    yield _rows(rows)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, chunks, a, b = (table[c].to_pylist() for c in ("kind", "chunk", "a", "b"))
        numbers = [_unpack(x) if k else None for k, x in zip(kinds, a)]
        again = _repeated([x for x in numbers if x is not None])
        out = []
        for kind, chunk, first, second, x in zip(kinds, chunks, a, b, numbers):
            if kind:
                once = np.unpackbits(np.frombuffer(second, np.uint8), count=len(x)).astype(bool)
                single = np.bincount(np.frombuffer(second, np.uint16, offset=-(-len(x) // 8))[~_among(x[once], again)])
                who = np.flatnonzero(single)
                out.append((0, chunk, 1, who.astype(np.uint16).tobytes(), single[who].astype(np.uint32).tobytes()))
            else:
                out.append((0, chunk, 0, first, second))
        return pa.Table.from_batches([_rows(out)])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds, a, b = (table[c].to_pylist() for c in ("kind", "a", "b"))
        what = np.frombuffer(a[kinds.index(0)], np.int64).reshape(6, -1)
        single = np.zeros(what.shape[1], np.int64)
        for kind, first, second in zip(kinds, a, b):
            if kind:
                single[np.frombuffer(first, np.uint16)] += np.frombuffer(second, np.uint32)
        n = what[3]
        alone = (single >= prefix(n, percent)) | (what[1] == 0)
        ids = pa.array(what[0], pa.int64(), mask=what[1] == 0)
        return pa.table([ids, *(pa.array(x) for x in what[2:6]), pa.array(alone)], names=["doc_id", "_text", "n", "sig_a", "sig_b", "alone"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text")
    counted = x.mapInArrow(run, _PACKED_SQL).groupBy("part").applyInArrow(count, _PACKED_SQL)
    return counted.groupBy("chunk").applyInArrow(gather, "doc_id long, _text long, n long, sig_a long, sig_b long, alone boolean")


def entries(sets: DataFrame, space: Space, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """token, doc_id, n, pos of the prefixes of ``sets`` (chunk, doc_id, _text, text), without the shingles that occur
    in one set only."""
    cut = space.bounds(1.0)

    def distinct(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = list(zip(table["doc_id"].to_pylist(), table["_text"].to_pylist()))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        return table.take(pa.array([i for k, i in enumerate(order) if not k or keys[i] != keys[order[k - 1]]], pa.int64()))

    def hashed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        for _, _, values, bounds in shingle_sets(table["text"], width):
            parts.append(values)
            sizes.append(np.diff(bounds))
        return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        r, times = np.unique(space.reduce(hashed(distinct(table))[0]), return_counts=True)
        at = np.searchsorted(r, cut)
        chunk = key[0].as_py()
        return pa.Table.from_batches([_rows([(p, chunk, 1, _pack(r[x:y]), narrow(times[x:y])) for p, (x, y) in enumerate(zip(at, at[1:])) if y > x])])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        numbers = [_unpack(x) for x in table["a"].to_pylist()]
        values, which = np.unique(np.concatenate(numbers), return_inverse=True)
        how_many = np.bincount(which, np.concatenate([wide(b, len(x))[0] for b, x in zip(table["b"].to_pylist(), numbers)]))
        part = key[0].as_py()
        rows = [(part, c, 1, np.minimum(how_many[np.searchsorted(values, x)], 255).astype(np.uint8).tobytes(), b"") for c, x in zip(table["chunk"].to_pylist(), numbers)]
        return pa.Table.from_batches([_rows(rows)])

    def index(key: tuple[pa.Scalar, ...], table: pa.Table, counts: pa.Table) -> pa.Table:
        table = distinct(table)
        values, sizes = hashed(table)
        order = np.argsort(space.reduce(values), kind="stable")
        parts = dict(zip(counts["part"].to_pylist(), counts["a"].to_pylist()))
        reduced = space.reduce(values)[order]
        number = np.cumsum(np.concatenate([[0], reduced[1:] != reduced[:-1]]))[: len(values)]  # of the chunk's distinct ones
        often = np.zeros(len(values), np.uint8)
        often[order] = np.frombuffer(b"".join(parts[p] for p in sorted(parts)), np.uint8)[number]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        first = prefix(sizes, percent)
        tokens, who, place = [], [], []
        for i in range(len(sizes)):
            x, f = values[begin[i] : begin[i + 1]], often[begin[i] : begin[i + 1]]
            single = int((f == 1).sum())
            if single < first[i]:
                rare = np.lexsort((x, f))[single : first[i]]
                tokens.append(x[rare])
                place.append(np.arange(single, first[i]))
                who.append(np.full(len(rare), i))
        who = np.concatenate(who or [np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({
            "token": pa.array(np.concatenate(tokens or [np.zeros(0, np.uint64)]).view(np.int64)),
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(who)),
            "n": pa.array(sizes[who] if len(who) else who, pa.int32()),
            "pos": pa.array(np.concatenate(place or [who]), pa.int32()),
        })

    back = sets.groupBy("chunk").applyInArrow(send, _PACKED_SQL).groupBy("part").applyInArrow(count, _PACKED_SQL)
    return sets.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(index, "token long, doc_id long, n int, pos int")


def overlaps(pairs: DataFrame, sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, n_a, n_b, both (shingles that both have) of pairs a, b of doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sizes, keys = [], []
                for c in (2, 3):
                    found = [(v, np.repeat(np.arange(x, y), np.diff(bounds))) for x, y, v, bounds in shingle_sets(part.column(c), width)]
                    values, row = np.concatenate([v for v, _ in found]), np.concatenate([r for _, r in found])
                    sizes.append(np.bincount(row, minlength=len(part)))
                    keys.append((values, row))
                values, row = (np.concatenate(x) for x in zip(*keys))
                order = np.lexsort((values, row))
                values, row = values[order], row[order]
                same = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
                both = np.bincount(row[1:][same], minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (*sizes, both))], names=["a", "b", "n_a", "n_b", "both"])

    texts = sets.select("doc_id", "text")
    x = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    x = x.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    return x.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n_a long, n_b long, both long")


def _alike(percent: int):
    return (F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))


def _needed(n_a, n_b, percent: int):
    """Shingles that two sets of these sizes must share."""
    return F.ceil(percent * (n_a + n_b) / F.lit(100.0 + percent) - 1e-9)


def links(index: DataFrame, sets: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """a, b, n_a, n_b, both: links between documents of the index that make the same components as all links do."""
    c = F.col

    def sized(n_a, n_b):
        return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)

    hubs = index.groupBy("token").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "n", "pos")).alias("hub")).filter("k > 1").select("token", "hub")
    rest = F.least(c("n") - c("pos"), c("hub.n") - c("hub.pos"))
    near = index.join(hubs, "token").filter((c("doc_id") != c("hub.doc_id")) & sized(c("n"), c("hub.n")) & (rest >= _needed(c("n"), c("hub.n"), percent)))
    first = written(overlaps(near.select(c("hub.doc_id").alias("a"), c("doc_id").alias("b")).distinct(), sets, width), "overlaps")
    good = first.filter(_alike(percent))
    known = components(good)

    # lists that still hold several components, in blocks by hub
    own = good.groupBy("b").agg(F.min(F.struct((c("n_b") - c("both")).alias("extra"), c("a").alias("anchor"))).alias("hub"))
    x = index.join(known, c("doc_id") == c("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
    mixed = x.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    x = x.join(mixed, "token").join(own, c("doc_id") == c("b"), "left")
    x = written(x.select("token", "doc_id", "n", "pos", "component", F.coalesce("hub.anchor", "doc_id").alias("anchor"), F.coalesce("hub.extra", F.lit(0)).cast("long").alias("extra")), "blocks")
    if x.isEmpty():
        return good
    block = x.groupBy("token", "anchor", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(c("n") - c("pos")).alias("rest"), F.max("extra").alias("extra"))
    l, r = (block.withColumnsRenamed({k: f"{k}_{s}" for k in block.columns if k != "token"}) for s in "ab")
    met = l.join(r, "token").filter((c("anchor_a") < c("anchor_b")) & (c("component_a") != c("component_b")))
    met = met.filter((100 * c("most_a") >= percent * c("least_b")) & (100 * c("most_b") >= percent * c("least_a")))
    met = met.filter(F.least("rest_a", "rest_b") >= _needed(c("least_a"), c("least_b"), percent))
    met = written(met, "met")
    pairs = met.select(c("anchor_a").alias("a"), c("anchor_b").alias("b")).distinct()
    both_ways = first.select("a", "b", "n_a", "n_b", "both").unionByName(first.select(c("b").alias("a"), c("a").alias("b"), c("n_b").alias("n_a"), c("n_a").alias("n_b"), "both"))
    fresh = pairs.join(both_ways.select("a", "b").distinct(), ["a", "b"], "left_anti")
    second = written(overlaps(fresh, sets, width), "overlaps")
    shared = both_ways.unionByName(second).groupBy("a", "b").agg(F.max("both").alias("both"))
    good = good.unionByName(second.filter(_alike(percent)))

    # pairs inside two blocks, where the hubs' answer leaves them open
    left = met.join(shared, (c("anchor_a") == c("a")) & (c("anchor_b") == c("b"))).drop("a", "b")
    left = left.filter(c("both") + c("extra_a") + c("extra_b") >= _needed(c("least_a"), c("least_b"), percent))
    # the bounds are tests of the joins themselves: an entry that can't reach any of the other block is not made a row
    kept = ("token", "anchor_a", "anchor_b", "component_a", "component_b", "both", "least_b", "rest_b", c("extra_b").alias("most_b"))
    left = left.select(*kept)
    a, b = (x.select(*(c(k).alias(f"{k}_{s}") for k in ("token", "anchor", "component", "doc_id", "n", "pos", "extra"))) for s in ("x", "y"))
    same = (c("token") == c("token_x")) & (c("anchor_a") == c("anchor_x")) & (c("component_a") == c("component_x"))
    open_ = left.join(a, same & (F.least(c("n_x") - c("pos_x"), "rest_b", c("both") + c("extra_x") + c("most_b")) >= _needed(c("n_x"), c("least_b"), percent)))
    same = (c("token") == c("token_y")) & (c("anchor_b") == c("anchor_y")) & (c("component_b") == c("component_y"))
    same &= ((c("doc_id_x") != c("anchor_a")) | (c("doc_id_y") != c("anchor_b"))) & sized(c("n_x"), c("n_y"))
    open_ = open_.join(b, same & (F.least(c("n_x") - c("pos_x"), c("n_y") - c("pos_y"), c("both") + c("extra_x") + c("extra_y")) >= _needed(c("n_x"), c("n_y"), percent)))
    pairs = open_.select(c("doc_id_x").alias("a"), c("doc_id_y").alias("b")).distinct().join(both_ways.select("a", "b").distinct(), ["a", "b"], "left_anti")
    third = written(overlaps(pairs, sets, width), "overlaps")
    return good.unionByName(third.filter(_alike(percent)))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, _text, n_shingles, class_id (smallest doc_id with an equal set), component_id and the number of rows of
    each document."""
    size = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 1
    space = Space(size)
    profile = profiles(docs, space, width, percent)
    profile = written(profile.groupBy(*profile.columns).agg(F.count("*").alias("rows")), "profiles")
    some = profile.filter(~F.col("alone"))
    classes = written(some.groupBy("n", "sig_a", "sig_b").agg(F.min(F.struct("doc_id", "_text")).alias("first")).select("n", "sig_a", "sig_b", "first.*"), "classes")
    picked = classes.select("doc_id", "_text")
    if (n := classes.count()) <= BROADCAST:
        picked = F.broadcast(picked)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), "text").join(picked, ["doc_id", "_text"])
    chunks = max(1, math.ceil(size * n / max(1, profile.count()) / CHUNK))
    sets = written(texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))), "sets")
    index = written(entries(sets, Space(sets.agg(F.sum(F.octet_length("text"))).first()[0] or 1), width, percent), "index")
    found = written(components(links(index, sets, width, percent)), "components")
    drop(index, sets)
    of = classes.select("n", "sig_a", "sig_b", F.col("doc_id").alias("class_id")).join(found, F.col("class_id") == F.col("node"), "left")
    out = profile.join(of, ["n", "sig_a", "sig_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "_text", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), "rows")


def first_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, rows that repeat doc_id and text once.
    Rows with a null doc_id stay. Only ids of rows that go are joined with ``docs``."""
    groups = join(docs, width, percent).filter(F.col("doc_id").isNotNull())
    groups = written(groups.select("doc_id", "_text", (F.col("component_id") != F.col("doc_id")).alias("goes"), "rows"), "groups")

    def ids(condition) -> DataFrame:
        some = groups.filter(condition).select("doc_id", "_text")
        return F.broadcast(some) if some.count() <= BROADCAST else some

    # the documents go along as one column, so their names clash with none
    left = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*docs.columns).alias("_doc")).join(ids(F.col("goes")), ["doc_id", "_text"], "left_anti")
    again = groups.filter(~F.col("goes") & (F.col("rows") > 1))
    if not again.isEmpty():
        again = ids(~F.col("goes") & (F.col("rows") > 1))
        one = left.join(again, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
        left = left.join(again, ["doc_id", "_text"], "left_anti").unionByName(one)
    return left.select("_doc.*")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).select("doc_id", "n_shingles", "component_id", "class_id")


#: Every pair that shares a shingle: for small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id WHERE r.c < g.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(s.s)) END AS class_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
