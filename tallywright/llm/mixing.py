"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies, target / size of its source. The running sum of the
expected copies within a source, in a fixed order, plus one offset of the source, crosses integers; a document is taken
once for each integer that its part of the sum crosses. The order goes by size first, so that every stretch of the sum
holds documents of all sizes in proportion and the words taken come near the target.

Nothing is gathered in one task: the place of a document in its source is found from counts per (source, size) and per
(source, size, salt), and a window over rows of one such cell. The salt is a hash of doc_id, or of the text where that is
null; there are SALTS of them for each SALTED rows. Only the table with one row per source goes through one window.

Edge cases: a null or empty text has size 0; null is a source of its own, the last; a null doc_id sorts first in its
cell, by its text; repeated rows are documents of their own; sources without words get a target of 0 and take nothing; an empty
table gives an empty result. Columns other than doc_id, text and source are carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import written

WEIGHTS, MOST = (1, 2, 3), 3
SALTS, SALTED = 64, 1_000_000_000
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_source, source_size) -> with target: shares of all sizes by weight; a source stops at ``most`` times its size
    and the excess is shared again by weight until no source is above. Sources by code point, null last."""
    by_place = W.orderBy(F.col("_source").asc_nulls_last())
    full = W.orderBy(F.col("_room"), F.col("_place"))
    x = sizes.withColumn("_place", F.row_number().over(by_place).cast("long"))
    x = x.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    x = x.withColumn("_room", (most * F.col("source_size")).cast("double") / F.col("_weight"))
    # with sources in order of the level at which they are full: what is left, and whose weight shares it
    x = x.withColumn("_before", F.coalesce(F.sum(most * F.col("source_size")).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_after", F.sum("_weight").over(full.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("_level", (F.sum("source_size").over(W.partitionBy()) - F.col("_before")).cast("double") / F.col("_after"))
    level = F.min(F.when(F.col("_level") < F.col("_room"), F.struct("_room", "_place", "_level"))).over(W.partitionBy())["_level"]
    x = x.withColumn("_level", level)
    return x.select("_source", "source_size", F.when(F.col("_level").isNull() | (F.col("_room") <= F.col("_level")), (most * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("_weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source and seed, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with _size and _mark, a 32-bit hash of doc_id or, where that is null, of the text."""
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return docs.withColumns({"_size": word_count(F.col("text")), "_mark": F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")})


def copies(docs: DataFrame, seed: int = 17, ready: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...; or, if ``ready``, as ``measured`` gives them) with _size, _source_size, _target
    and _copies, one row per input row."""
    docs = docs if ready else measured(docs)
    salts = SALTS * (1 + docs.count() // SALTED)
    # a key without nulls, so that the window and the join below share one exchange of the documents
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    d = docs.withColumns({"_salt": (F.col("_mark") % salts).cast("int"), "_key": key})
    cells = d.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("_n"))
    by_size = cells.groupBy("_key", "_size").agg(F.sum("_n").alias("_all"))
    sizes = by_size.groupBy("_key").agg(F.sum(F.col("_all") * F.col("_size")).alias("source_size"))
    sizes = sizes.withColumn("_source", F.when(F.col("_key") != "", F.substring("_key", 2, 2**31 - 1)))
    t = targets(sizes).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
    t = t.select("_key", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    smaller = W.partitionBy("_key").orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    by_size = by_size.withColumn("_smaller", F.coalesce(F.sum("_all").over(smaller), F.lit(0))).join(t, "_key").drop("_all")
    lower = W.partitionBy("_key", "_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0))).join(by_size, ["_key", "_size"]).drop("_n")
    d = d.withColumn("_row", F.row_number().over(W.partitionBy("_key", "_size", "_salt").orderBy("doc_id", "_mark")))
    d = d.join(cells, ["_key", "_size", "_salt"]).withColumn("_first", F.col("_smaller") + F.col("_lower"))
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    place = (F.col("_first") + F.col("_row")).cast("double")
    start = offset(F.when(F.col("_key") != "", F.substring("_key", 2, 2**31 - 1)), seed)
    crossed = F.floor(place * each + start) - F.floor((place - 1) * each + start)
    return d.withColumn("_copies", F.least(F.lit(MOST), crossed).cast("long")).drop("_key", "_smaller", "_lower", "_first", "_row", "_salt", "_mark")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: the columns of ``docs``, each document as often as it is taken."""
    # the documents go along as one column, so their names clash with none
    d = copies(measured(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))).drop("text"), seed, ready=True)
    return d.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # words are counted once, and the texts go no further
    d = copies(written(measured(docs).drop("text"), "sizes"), ready=True)
    return d.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) / ((place - 1) % 3 + 1) AS room FROM p),
f AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY room, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own_level FROM w),
l AS (SELECT arg_min(own_level, struct_pack(a := room, b := place)) FILTER (WHERE own_level < room) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR room <= level THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM f, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.mark % 64, d.doc_id NULLS FIRST, d.mark) AS DOUBLE) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(3, CAST(floor(place * each + u) - floor((place - 1) * each + u) AS BIGINT)) * size AS BIGINT) AS taken FROM r
"""
