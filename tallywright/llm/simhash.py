"""Document fingerprints by SimHash, and the search for all fingerprints within a Hamming radius.

A text's terms are its shingles of ``WIDTH`` words, with a weight that grows with the logarithm of their number. Each
term's hash votes with its weight for or against each of ``BITS`` bits; the signs of the sums are the fingerprint. Two
fingerprints that differ in at most r of b + r blocks' bits agree in some b blocks: each choice of b blocks is a table,
whose key is the bits of those blocks moved to the front, and what agrees in a key is compared. Equal fingerprints are
one entry in the tables, so that copies cost nothing.

Edge cases: a text without words, or null, has the zero fingerprint; texts of fewer than WIDTH words have one term;
votes that balance give a 0; a null doc_id comes last in order; rows that repeat a doc_id follow each other by a hash of
their texts; a lone document is its own next; an empty table gives an empty result; texts are taken whole.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, buffers, mix, shingles, slices, word_hashes
from .scratch import small_batches, written

BITS, WIDTH = 128, 3
RADIUS = 3
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)


def fingerprints(column) -> np.ndarray:
    """BITS / 8 bytes for each text of a string column."""
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, BITS // 8), np.uint8)
    for a, b in slices(offsets):
        hashes, rows, _, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        values, rows = shingles(hashes, rows, b - a, WIDTH)
        bounds = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            values[bounds[i] : bounds[i + 1]].sort()
        first = np.ones(len(values), bool)
        first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(first)
        weight = 1 + np.log(np.diff(np.append(at, len(values))))
        values, rows = values[at], rows[at]
        total = np.bincount(rows, weight, b - a)
        for word in range(BITS // 64):
            h = mix(values + U64(word * 0x632BE59BD9B4E019))
            for byte in range(8):
                what = ((h >> U64(56 - 8 * byte)) & U64(255)).astype(np.int64)
                votes = np.bincount(rows * 256 + what, weight, (b - a) * 256).reshape(b - a, 256) @ _OF_BYTE
                out[a:b, word * 8 + byte] = np.packbits(2 * votes > total[:, None] + 1e-9, axis=1)[:, 0]
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal bits of fingerprints."""
    return 1 - np.bitwise_count(x ^ y).sum(1) / BITS


def blocks_for(prints: int, radius: int) -> int:
    """Blocks so that a table's key, blocks - radius of them, has as many bits as the number of fingerprints: a key then
    holds a few of them by chance, however many there are."""
    need = max(16, math.ceil(math.log2(max(2, prints))))
    return next(b for b in range(radius + 1, BITS // 4 + 1) if (BITS // 4 // b) * 4 * (b - radius) >= need or b == BITS // 4)


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """query, fingerprint, distance: for each distinct fingerprint of ``queries`` all distinct ones of ``index`` at most
    ``radius`` bits away. Both inputs have a column ``fingerprint`` (hexadecimal). ``blocks``: see ``blocks_for``."""
    blocks = blocks or blocks_for(index.select("fingerprint").distinct().count(), radius)
    digits, size = BITS // 4, BITS // 4 // blocks
    tables = list(itertools.combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        block = lambda i: F.substring("fingerprint", 1 + i * size, size if i < blocks - 1 else digits)
        keys = F.array(*(F.concat(F.lit(f"{t}:"), *(block(i) for i in table)) for t, table in enumerate(tables)))
        return df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), F.explode(keys).alias("key"))

    parts = range(0, digits, 8)
    number = lambda c, i: F.conv(F.substring(c, 1 + i, 8), 16, 10).cast("long")
    distance = sum(F.bit_count(number("query", i).bitwiseXOR(number("fingerprint", i))) for i in parts)
    met = keyed(queries, "query").join(keyed(index, "fingerprint"), "key").select("query", "fingerprint", distance.alias("distance"))
    return met.filter(F.col("distance") <= radius).distinct()


def followed(docs: DataFrame) -> DataFrame:
    """_bucket, _own, doc_id, text in partitions sorted by descending doc_id within a bucket, each bucket followed by
    the first document of the next one (the last by the first of all), for which _own is false."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, docs.rdd.getNumPartitions())
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, k.to_numpy(), "left")).astype(np.int32))

    # one number for each bucket: as many as there are partitions
    first = {r["b"]: r["k"] for r in docs.select(bucket(key).alias("b"), key.alias("k")).groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        own = len(cuts) - np.searchsorted(cuts, k.to_numpy(), "left")
        return pd.Series([[b, before[x]] if x in before else [b] for b, x in zip(own.tolist(), k.tolist())])

    x = docs.select("doc_id", "text", F.posexplode(places(key)).alias("_copy", "_bucket"))
    x = x.select("_bucket", (F.col("_copy") == 0).alias("_own"), "doc_id", "text", F.xxhash64("text").alias("_text"))
    return x.repartitionById(n, "_bucket").sortWithinPartitions("_bucket", F.desc("_own"), F.col("doc_id").desc_nulls_last(), "_text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced by the start of the next document's,
    and their likeness; the next document is the one with the next smaller doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, offsets = buffers(batch.column(3))
            for a, b in slices(offsets, 8 << 20):
                part = batch.slice(a, b - a)
                prints = fingerprints(part.column(3))
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), [t or "" for t in part.column(3).to_pylist()], prints))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[1] and x[0] == y[0]]
                if not pairs:
                    continue
                edited = []
                for x, y in pairs:
                    half = len(x[3]) // 2
                    edited.append(x[3][: len(x[3]) - half] + y[3][:half])
                own, after = (np.stack([z[k][4] for z in pairs]) for k in (0, 1))
                changed = fingerprints(pa.array(edited, pa.large_string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([p.tobytes().hex() for p in own]), pa.array([p.tobytes().hex() for p in changed]),
                    pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
                ], names=[c.split()[0] for c in _OUT.split(", ")])

    return small_batches(followed(docs)).drop("_text").mapInArrow(run, _OUT)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """near_within: for every document whose id is divisible by 100, how many documents have a fingerprint within
    RADIUS bits of its own, itself included; null for the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = written(edits(docs), "fingerprints")
    queries = out.filter(F.col("doc_id") % 100 == 0)
    sizes = out.groupBy("fingerprint").agg(F.count("*").alias("k"))
    near = within(queries, out).join(sizes, "fingerprint").groupBy("query").agg(F.sum("k").alias("near_within"))
    asked = F.when(F.col("doc_id") % 100 == 0, F.col("near_within")).alias("near_within")
    return out.join(near, F.col("fingerprint") == F.col("query"), "left").select(*out.columns, asked)
