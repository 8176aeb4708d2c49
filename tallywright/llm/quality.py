"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

Statistics of a text are scaled by the training rows' means and deviations and mapped to ``DIM`` cosines, whose inner
products approximate a Gaussian kernel. Each partition sums its rows' normal equations, the sums are added in two
levels, and the driver solves one DIM x DIM system. Two halves of the training rows score each other for the isotonic
fit, which is made on at most ``BINS`` bins of scores. All labelled rows that may be learned from are used.

Edge cases: null and empty texts have zero statistics and get a score like any others; several labels of one document
count as their mean, null labels as none; without any label every score is 0.5; repeated documents are scored each;
a null doc_id is never held out and has no label; other columns are carried along by ``keep_good``. No label, lang,
source or doc_id is an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import buffers, slices, word_hashes, mix, U64
from .scratch import small_batches, written

DIM, RIDGE, WIDTH, BINS = 256, 1e-3, 3.0, 512
FEATURES = (
    "log_bytes", "log_words", "mean_word", "dev_word", "upper", "digits", "symbols", "stops", "blank", "other_bytes",
    "distinct_words", "same_next", "distinct_pairs", "bare_words", "lines", "symbol_ends", "top_word", "upper_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
_STOP, _SPACE, _HIGH = _table(b".,;:?'-\""), _table(b" \t\n\v\f\r"), _table(bytes(range(128, 256)))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _STOP | _SPACE | _HIGH)
_LETTER = _UPPER | _LOWER | _HIGH


def statistics(column) -> np.ndarray:
    """One row of FEATURES for each text of a string column."""
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, b in slices(offsets):
        out[a:b] = _statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets)

    def counts(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]], total

    upper, upper_at = counts(_UPPER)
    letters, letters_at = counts(_LETTER)
    digits, symbols, stops, blank, high = (counts(t)[0] for t in (_DIGIT, _SYMBOL, _STOP, _SPACE, _HIGH))
    lines = counts(_table(b"\n"))[0]
    hashes, row, starts, ends = word_hashes(data, offsets)
    words = np.bincount(row, minlength=rows)
    length = (ends - starts).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(row, length, rows) / per
    dev = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / per - mean**2, 0))
    in_word = letters_at[ends] - letters_at[starts]
    bare = np.bincount(row, in_word == 0, rows) / per
    shout = np.bincount(row, (upper_at[ends] - upper_at[starts] == in_word) & (in_word > 1), rows) / per
    tail = np.bincount(row, _SYMBOL[data[ends - 1]] if len(ends) else None, rows) / per
    pair = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    same = np.bincount(row[1:][pair], (hashes[1:] == hashes[:-1])[pair], rows) / per if len(row) else np.zeros(rows)
    pairs = mix(hashes[:-1] * U64(3) + hashes[1:]) if len(row) else hashes
    begin = np.searchsorted(row, np.arange(rows + 1))
    distinct, distinct_pairs, top = np.ones(rows), np.ones(rows), np.zeros(rows)
    for i in np.flatnonzero(words > 1):
        x = np.sort(hashes[begin[i] : begin[i + 1]])
        steps = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        distinct[i] = (len(steps) - 1) / len(x)
        top[i] = np.diff(steps).max() / len(x)
        y = np.sort(pairs[begin[i] : begin[i + 1] - 1])
        distinct_pairs[i] = (1 + (y[1:] != y[:-1]).sum()) / len(y)
    n = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, dev, upper / np.maximum(letters, 1), digits / n, symbols / n, stops / n, blank / n, high / n,
        distinct, same, distinct_pairs, bare, lines / per, tail, top, shout,
    ])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``f``, an array of the text's FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(len(keep)))
            bounds = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            f = pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], f], names=[*keep, "f"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", f array<double>"
    return small_batches(docs).select(*keep, "text").mapInArrow(run, schema)


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


class Model:
    """Scales, cosines, weights and the calibration: a few hundred kB, whatever the input."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        self.w = rng.standard_normal((len(mean), DIM)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, DIM)
        self.beta = np.zeros(DIM + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / DIM) * np.cos(np.clip((x - self.mean) / self.dev, -6, 6) @ self.w + self.b)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, x: np.ndarray, beta: np.ndarray | None = None) -> np.ndarray:
        return self.map(x) @ (self.beta if beta is None else beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.beta.any():  # nothing was learned
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        p = np.interp(raw, *self.knots)
        return np.clip(p * (1 - 1e-6) + 1e-6 * np.clip(raw, 0, 1), 0, 1)  # keeps the order within a level


def _listed(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _solve(a: np.ndarray, c: np.ndarray, n: float) -> np.ndarray:
    penalty = RIDGE * max(n, 1) * np.eye(len(c))
    penalty[-1, -1] = 1e-9 * max(n, 1)
    return np.linalg.solve(a + penalty, c)


def _sums(train: DataFrame, model: Model) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Normal equations of each half: summed by partition, then in two levels of about equal fan-in."""
    size, groups = DIM + 1, max(1, math.isqrt(train.rdd.getNumPartitions()))

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table["sums"].to_pylist())
        return pa.table({"half": table["half"][:1], "task": pa.array([0], pa.int32()), "sums": [total.tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = {h: np.zeros((size + 2, size)) for h in (0, 1)}
        for batch in batches:
            z, y, half = model.map(_listed(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for h in (0, 1):
                k = half == h
                sums[h][:size] += z[k].T @ z[k]
                sums[h][size] += z[k].T @ y[k]
                sums[h][size + 1, 0] += k.sum()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"half": pa.array([0, 1], pa.int32()), "task": pa.array([task % groups] * 2, pa.int32()), "sums": [sums[h].tobytes() for h in (0, 1)]})

    schema = "half int, task int, sums binary"
    parts = train.select("f", "y", "half").mapInArrow(run, schema).groupBy("half", "task").applyInArrow(add, schema)
    out = {h: (np.zeros((size, size)), np.zeros(size), 0.0) for h in (0, 1)}
    for r in parts.groupBy("half").applyInArrow(add, schema).collect():  # two rows
        x = np.frombuffer(r["sums"], float).reshape(size + 2, size)
        out[r["half"]] = (x[:size], x[size], float(x[size + 1, 0]))
    return out


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to means y with weights n at ascending x (pool adjacent violators). Half a row of
    either label is added to each block; since that can make neighbours fall, they are pooled once more."""
    blocks = _pooled(zip(x * n, y * n, n))
    blocks = _pooled((a * (c + 1) / c, b + 0.5, c + 1) for a, b, c in blocks)
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _pooled(rows) -> list[list[float]]:
    """Sums of x, sums of y and weights of blocks with rising means."""
    blocks: list[list[float]] = []
    for row in rows:
        blocks.append(list(row))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return blocks


def fit(feature_table: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """``feature_table``: doc_id, f; ``labels``: doc_id, y (0 or 1) of the rows that may be learned from."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)).cast("int").alias("half")
    train = written(feature_table.join(labels, "doc_id").select("f", "y", half), "train")
    k = range(len(FEATURES))
    row = train.agg(*(F.avg(F.col("f")[i]).alias(f"m{i}") for i in k), *(F.stddev_pop(F.col("f")[i]).alias(f"d{i}") for i in k)).first()
    if row["m0"] is None:
        return Model(np.zeros(len(k)), np.ones(len(k)), seed)
    model = Model(np.array([row[f"m{i}"] for i in k]), np.array([row[f"d{i}"] for i in k]), seed)
    sums = _sums(train, model)
    model.beta = _solve(sums[0][0] + sums[1][0], sums[0][1] + sums[1][1], sums[0][2] + sums[1][2])
    other = [_solve(*sums[1]), _solve(*sums[0])]  # a half is scored by what the other half has taught

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, half = _listed(batch.column(0)), batch.column(2).to_numpy()
            raw = np.where(half == 0, model.raw(x, other[0]), model.raw(x, other[1]))
            at = np.clip(raw * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at), "y": batch.column(1)})

    bins = train.select("f", "y", "half").mapInArrow(run, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    bins = sorted((r["bin"], r["y"], r["n"]) for r in bins)  # at most BINS rows
    x, y, n = (np.array(c, float) for c in zip(*bins))
    model.knots = isotonic((x + 0.5) / BINS, y, n)
    return model


def scored(feature_table: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(model.score(_listed(batch.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], s], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {feature_table.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return feature_table.select(*keep, "f").mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("y"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, their columns as they are."""
    table = written(features(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"]), "features")
    model = fit(table, learnable(labels))
    score = "_score" + "_" * max(map(len, docs.columns))  # a name that no column has
    return judged(docs, model, score).filter(F.col(score) >= 0.5).drop(score)


def judged(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array(model.score(statistics(batch.column(names.index("text")))))
            yield pa.RecordBatch.from_arrays([*batch.columns, s], names=[*names, score])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    table = written(features(docs, ["doc_id"]), "features")
    out = scored(table, fit(table, learnable(labels)), ["doc_id"])
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
