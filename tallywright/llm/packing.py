"""Packing documents into sequences of a fixed number of tokens.

Each document becomes its token ids and an end id. Only a document longer than a sequence is cut, into full pieces
after a shorter first one. Pieces are dealt by their rows' numbers into groups of bounded size; each group is packed best
fit, longest first, and improved by a swap-based local search over its underfull bins: the emptiest bin gives a document
to a fuller one that has room for it, or exchanges it for one or for two shorter documents of that bin. Each step raises
the sum of squared fills. A bin from which no step leads goes back as it is and the next emptiest one gives; the search
ends when a whole round of bins finds no step or no bin can be saved. What is left in underfull bins is then dealt into
new groups and packed again, so that the split into groups costs next to nothing.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; null doc_ids are packed like
others; an empty table gives an empty result; a very long text is cut into as many pieces as it takes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import buffers, slices
from .scratch import small_batches, written

SEQUENCE, END, GROUP = 1024, 2, 8_192
VOCABULARY = "byte_bpe_50k.json"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, size: int, end: int) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    from .tokens import encoder

    enc = encoder(path or public_tokenizers.path(VOCABULARY))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for a, b in slices(buffers(texts)[1]):
            ids, bounds = enc.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            ids, at, rows = ids.astype("<u4"), [], []
            for i in range(b - a):
                x = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end))
                cuts = [0, *range(len(x) % size or size, len(x) + 1, size)]
                at += [i] * (len(cuts) - 1)
                rows += [(k, c, d - c, zlib.crc32(x[c:d].tobytes())) for k, (c, d) in enumerate(zip(cuts, cuts[1:]))]
            columns = [keys.slice(a, b - a).take(pa.array(at)), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document. ``path``: a vocabulary of tokenizers."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_pieces, path=path, size=size, end=end), PIECE)


def fill(lengths: np.ndarray, size: int, search: bool = True) -> np.ndarray:
    """The bin of each item: best fit, longest first, then the local search."""
    order = np.argsort(-lengths, kind="stable")
    room, items = [], []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    have = 0  # bit r: there is a bin with room r
    for i in order.tolist():
        n = int(lengths[i])
        fits = have >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                have &= ~(1 << r)
        else:
            b, r = len(room), size
            room.append(size)
            items.append([])
        items[b].append(i)
        room[b] = r - n
        if r > n:
            by_room[r - n].append(b)
            have |= 1 << (r - n)
    bins = np.zeros(len(lengths), np.int64)
    for b, x in enumerate(items):
        bins[x] = b
    return improve(lengths, size, bins)[0] if search else bins


class _Offers:
    """What each underfull bin can give for a document: nothing, one document, or two, as sums of lengths. Documents of
    one length are alike, and a bin has few different lengths, as they add up to no more than a sequence."""

    def __init__(self, lengths: list[int], items: list[int]):
        self.by_length: dict[int, list[int]] = {}
        for i in items:
            self.by_length.setdefault(lengths[i], []).append(i)
        one = np.array(sorted(self.by_length), np.int64)
        i, j = np.triu_indices(len(one))
        twice = (i != j) | np.array([len(self.by_length[n]) > 1 for n in one.tolist()], bool)[i]
        zero = np.zeros(1, np.int64)
        self.first = np.concatenate([zero, one, one[i[twice]]])
        self.second = np.concatenate([zero, zero.repeat(len(one)), one[j[twice]]])
        self.total = self.first + self.second


def improve(lengths: np.ndarray, size: int, bins: np.ndarray) -> tuple[np.ndarray, int]:
    """A packing made better by moves and exchanges between underfull bins, and how many were made."""
    n = lengths.tolist()
    least, steps = -(-sum(n) // size), 0
    items: list[list[int]] = [[] for _ in range(int(bins.max(initial=-1)) + 1)]
    for i, b in enumerate(bins.tolist()):
        items[b].append(i)
    fills = [sum(n[i] for i in x) for x in items]
    used = sum(map(bool, items))
    before = -1
    while before < steps and used > least:
        before = steps
        open_ = sorted((b for b in range(len(items)) if 0 < fills[b] < size), key=lambda b: (fills[b], b))
        offers = {b: _Offers(n, items[b]) for b in open_}
        stuck: set[int] = set()
        while used > least and (donor := min((b for b in offers if b not in stuck), key=lambda b: (fills[b], b), default=None)) is not None:
            others = [b for b in offers if b != donor and fills[b] >= fills[donor]]
            step = None
            if others:
                total = np.concatenate([offers[b].total for b in others])
                which = np.repeat(np.arange(len(others)), [len(offers[b].total) for b in others])
                room = size - np.array([fills[b] for b in others])[which]
                for length in sorted(offers[donor].by_length, reverse=True):
                    gain = length - total
                    fits = np.flatnonzero((gain > 0) & (gain <= room))
                    if len(fits):  # the largest rise of the sum of squares
                        rise = gain[fits] * (np.array(fills)[others][which[fits]] - fills[donor] + gain[fits])
                        at = fits[rise.argmax()]
                        step = (length, others[which[at]], int(at - np.searchsorted(which, which[at])))
                        break
            if step is None:
                stuck.add(donor)
                continue
            length, b, k = step
            i = offers[donor].by_length[length][0]
            back = [offers[b].by_length[x][-1 - (second and offers[b].first[k] == offers[b].second[k])] for second, x in enumerate((int(offers[b].first[k]), int(offers[b].second[k]))) if x]
            items[donor] = [x for x in items[donor] if x != i] + back
            items[b] = [x for x in items[b] if x not in back] + [i]
            for x in (donor, b):
                fills[x] = sum(n[y] for y in items[x])
                if 0 < fills[x] < size:
                    offers[x] = _Offers(n, items[x])
                else:
                    offers.pop(x, None)
            stuck.discard(b)
            steps += 1
            if not items[donor]:
                used, stuck = used - 1, set()
    for b, x in enumerate(items):
        bins[x] = b
    return bins, steps


def _pack(key: tuple, table: pa.Table, size: int, base: int) -> pa.Table:
    lengths = table["length"].to_numpy().astype(np.int64)
    # the order of rows must not depend on how they came
    order = np.lexsort([table[c].fill_null(-1).to_numpy() for c in ("ids_crc32", "piece", "doc_id")] + [-lengths])
    table, lengths = table.take(pa.array(order)), lengths[order]
    bins = fill(lengths, size)
    by_bin = np.argsort(bins, kind="stable")
    ordered, sizes = bins[by_bin], lengths[by_bin]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(ordered, ordered)
    offsets = np.zeros(len(bins), np.int64)
    offsets[by_bin] = before - before[first]
    total = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
    base += int(key[0].as_py()) << 32
    for name, values in (("sequence_id", bins + base), ("offset", offsets), ("_filled", total)):
        if name in table.column_names:
            table = table.drop_columns([name])
        table = table.append_column(name, pa.array(values, pa.int64()))
    return table.drop_columns(["_group"])


def packed(pieces_table: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``pieces_table`` with sequence_id and offset. Read it from a table: it is read more than once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_table.schema) + ", sequence_id long, offset long, _filled long"

    def into(base: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return _pack(key, table, size, base)

        return run

    def dealt(df: DataFrame, seed: int) -> DataFrame:
        n = max(1, -(-df.count() // group))
        # by the rows' numbers, so that equal rows are not one group; the table is written, so they stay the same
        return df.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n)))

    first = dealt(pieces_table, 1).groupBy("_group").applyInArrow(into(0), schema)
    first = written(first, "packed")
    left = first.filter(F.col("_filled") < size).drop("sequence_id", "offset", "_filled")
    second = dealt(left, 2).groupBy("_group").applyInArrow(into(1 << 62), schema)
    return first.filter(F.col("_filled") == size).unionByName(second).drop("_filled")


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of ``docs``."""
    return packed(written(pieces(docs, path, size, end), "pieces"), size, group)


def op5_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
