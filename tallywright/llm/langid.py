"""Language identification with language-bitmask n-gram filters.

N-grams are runs of ``GRAM`` bytes of a text, A-Z folded, white space and signs folded to one blank. An n-gram belongs to
a language when it makes up at least ``SHARE`` of the language's n-grams in the rows learned from, and at least ``PART``
of its usual share, the mean over languages. So a language has at most 1/SHARE n-grams, the filters have a fixed size, and
the stray foreign words of a large corpus fill no filter. Each language has a Bloom filter; the filters are kept
bit-sliced, one mask of languages in each slot, so that the masks of an n-gram's slots, anded, are all languages that
contain it. A text's popcount for a language, corrected for the filter's rate of false positives, is an estimate of the
share of its n-grams that the language contains; the language with the highest wins.

Counts and slot masks are summed and or-ed by Spark; only the slots that are set, at most 2**BITS, reach the driver.

Edge cases: a text that is null or has no letter is `und` with score 0; a text shorter than an n-gram is padded by
blanks; rows with null lang, text or doc_id teach nothing; with no language learned every text is `und`; ties go to the
language first in order; repeated rows are judged each; very long texts are worked through in slices of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, buffers, mix, slices
from .quality import fold
from .scratch import small_batches, written

GRAM, SHARE, PART, BITS, HASHES = 4, 2e-6, 0.5, 22, 3
WORD = 63  # languages in one array of masks
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of texts, and each text's bounds in them. A text is taken with a blank before and after; of
    n-grams only those with a letter in their second place count, once for each letter."""
    n = np.diff(offsets)
    begin = offsets[:-1] + GRAM * np.arange(len(n))
    out = np.full(int(offsets[-1]) + GRAM * len(n) + GRAM, 32, np.uint8)
    out[np.arange(int(offsets[-1])) + np.repeat(GRAM * np.arange(len(n)), n) + 1] = _FOLD[data]
    code = np.zeros(len(out) - GRAM, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | out[k : len(out) - GRAM + k]
    good = out[1 : len(out) - GRAM + 1] != 32
    total = np.concatenate([[0], np.cumsum(good)])
    return code[good], total[np.append(begin, len(code))]


def slots(codes: np.ndarray) -> np.ndarray:
    """HASHES slots of each code."""
    h = mix(codes.astype(np.uint64) * U64(0xD1342543DE82EF95) + U64(1))
    return np.stack([((h >> U64(21 * k)) & U64((1 << BITS) - 1)).astype(np.int64) for k in range(HASHES)])


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, code, n of ``rows`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b in slices(offsets):
                codes, bounds = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for lang in sorted(set(langs[a:b])):
                    own = np.repeat(langs[a:b] == lang, np.diff(bounds))
                    x = np.sort(codes[own])
                    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                    parts = kept.setdefault(lang, [])
                    parts.append((x[first], np.diff(np.append(first, len(x)))))
                    if len(parts) >= 16:
                        kept[lang] = [merged(parts)]
        for lang, parts in kept.items():
            code, n = merged(parts)
            for a in range(0, len(code), 100_000):
                k = len(code[a : a + 100_000])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * k), "code": pa.array(code[a : a + k].astype(np.int64)), "n": pa.array(n[a : a + k])})

    return small_batches(rows).select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters: bit l of ``masks[w][slot]`` is set when language WORD * w + l has an n-gram there."""

    def __init__(self, langs: list[str], masks: list[np.ndarray]):
        self.langs, self.masks = langs, masks
        full = np.array([self._bit(masks[i // WORD], i % WORD).mean() for i in range(len(langs))])
        self.false = full**HASHES

    @staticmethod
    def _bit(mask: np.ndarray, i: int) -> np.ndarray:
        return (mask >> mask.dtype.type(i)) & mask.dtype.type(1)

    def shares(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language, the corrected share of the text's n-grams that the language contains."""
        at = slots(codes)
        n = np.maximum(np.diff(bounds), 1)
        out = np.zeros((len(n), len(self.langs)))
        for w, masks in enumerate(self.masks):
            mask = masks[at[0]]
            for k in range(1, HASHES):
                mask &= masks[at[k]]
            for i in range(WORD * w, min(WORD * (w + 1), len(self.langs))):
                total = np.concatenate([[0], np.cumsum(self._bit(mask, i % WORD), dtype=np.int64)])
                hits = (total[bounds[1:]] - total[bounds[:-1]]) / n
                out[:, i] = np.clip((hits - self.false[i]) / (1 - min(self.false[i], 0.999)), 0, 1)
        return out


def learn(rows: DataFrame) -> Filters:
    """``rows``: text, lang. Every language is learned, WORD of them in one array of masks."""
    counts = written(gram_counts(rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).collect()  # one row for each language
    langs = sorted(r["lang"] for r in totals)
    if not langs:
        return Filters([], [])
    place = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))
    every = F.create_map(*(F.lit(x) for r in totals for x in (r["lang"], r["all"])))
    share = counts.withColumn("share", F.col("n") / every[F.col("lang")])
    usual = share.groupBy("code").agg((F.sum("share") / len(langs)).alias("usual"))
    own = share.filter(F.col("share") >= SHARE).join(usual, "code").filter(F.col("share") >= PART * F.col("usual"))
    own = own.select("code", place[F.col("lang")].alias("place")).select("code", (F.col("place") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, place % {WORD})").alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch.column(0).to_numpy())
            columns = {"slot": at.ravel(), **{c: np.tile(batch.column(i).to_numpy(), HASHES) for i, c in ((1, "word"), (2, "mask"))}}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    set_slots = own.mapInArrow(run, "slot long, word int, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask"))
    masks = []
    got = set_slots.toArrow()  # at most 2**BITS slots for WORD languages
    for w in range(-(-len(langs) // WORD)):
        here = got.filter(pc.equal(got["word"], w))
        size = min(WORD, len(langs) - WORD * w)
        kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if size <= n)
        masks.append(np.zeros(1 << BITS, kind))
        masks[w][here["slot"].to_numpy()] = here["mask"].to_numpy().astype(np.uint64).astype(kind)
    return Filters(langs, masks)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**BITS masks: 4 to 32 MB for WORD languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            best, score = np.full(len(batch), -1), np.zeros(len(batch))
            for a, b in slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
                letter = total[own[1:]] > total[own[:-1]]
                for i in np.flatnonzero(~letter):
                    letter[i] = any(c.isalpha() for c in bytes(part[own[i] : own[i + 1]]).decode("utf-8", "replace"))
                if f.langs and letter.any():
                    shares = f.shares(*grams(part, own))
                    k = shares.argmax(1)
                    top = shares.max(1)
                    best[a:b] = np.where(letter, k, -1)
                    score[a:b] = np.where(letter, top / np.maximum(shares.sum(1), 1e-12), 0)
            names = np.array([*f.langs, "und"], object)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(np.clip(score, 0, 1))})

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, learn(docs.filter(fold(F.col("doc_id"), 5) != 0)))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "lang_pred", "score")
