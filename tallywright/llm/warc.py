"""WARC archives: write, read, and revisit resolution.

Archives are written by Spark's text writer, compressed, one record a row, with the two line breaks that end a record
as the row separator; so they go to any file system that Spark reaches. They are read in file order, split at the same
separator: the first part is a record's head, then parts are taken until its Content-Length is met, so payloads may
hold anything. No file and no archive is held in memory, only a record. A record's id names the page and the row, so no
two records share one.

``resolve`` finds records with equal payloads by their digests: heads are counted by digest, and the records are joined
with the digests that several have. The smallest page_id of each is the response, the others become revisit records
that name it and have no payload; ``deduplicate`` writes them to archives with fresh heads. ``originals`` joins revisit
records, read back, with the responses whose ids they name.

Edge cases: a null html is the empty payload; payloads of fewer than ``least`` bytes are all responses; rows that repeat a
page_id are records of their own, of equal ones one is the response and the others revisit it; a null page_id is written as an empty one, is
read back as null and never is what others refer to unless all are null; a null url is written without a target; an empty table gives empty
archives and an empty result; very long payloads are one record each; line breaks in a url are percent-encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import new_path

LEAST = 100
END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"  # archives of the same pages are the same
_ID = "urn:tallywright:page:"


def heads(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, payload_bytes, payload_digest and record_id. ``pages`` is read more than once and must give
    its rows in the same partitions each time, as a table does."""
    payload = F.coalesce("html", F.lit(""))
    uri = F.concat(F.lit(_ID), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    return pages.withColumns({"record_id": uri, "payload": payload, "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload.cast("binary"), 256)})


def resolve(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` (page_id, url, record_id, payload_bytes, payload_digest, ...) with record_type, refers_to and refers_id.

    The table of first records has one row a digest with several records; a digest that a third of all rows share is
    aggregated where its rows are, and met by a join, whose skewed partitions Spark splits."""
    key = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.coalesce("url", F.lit("")), F.col("record_id"))
    many = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    many = many.filter("_n > 1").select("payload_digest", F.col("_first.page_id").alias("_page"), F.col("_first.record_id").alias("_id"))
    x = records.join(many, "payload_digest", "left")
    other = F.col("_id").isNotNull() & (F.col("record_id") != F.col("_id")) & (F.col("payload_bytes") >= least)
    return x.withColumns({"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("_page")), "refers_id": F.when(other, F.col("_id"))}).drop("_id", "_page")


def record(r: DataFrame) -> Column:
    """The text of a record: head, empty line, payload. Revisits have no payload and name the response."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", name("record_id")),
        line("WARC-Date", F.lit(_DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name("refers_id")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write(records: DataFrame, path: str) -> str:
    """Archives of ``records``: record_id, url, payload, payload_digest, record_type, refers_id."""
    records.select(record(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return path


_READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string, record_id string, refers_id string"


def _page(uri: str | None) -> int | None:
    """The page that a record's id names."""
    number = uri.removeprefix(_ID).partition(":")[0] if uri else ""
    return int(number) if number else None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives. payload_bytes is what the record itself holds; without ``payloads`` only heads."""
    names = tuple(c.split()[0] for c in _READ.split(", "))
    kinds = tuple(pa.int64() if c.endswith("long") else pa.string() for c in _READ.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts, have, want = None, [], -len(END), 0
        for batch in batches:
            out = []
            for part in batch.column(0).to_pylist():
                if head is None:
                    part = part.removeprefix("\r\n")  # of the separator, see below
                    if not part:
                        continue
                    head = dict(x.split(": ", 1) for x in part.split("\r\n")[1:] if ": " in x)
                    parts, have, want = [], -len(END), int(head["Content-Length"])
                    continue
                parts.append(part)
                have += len(END) + len(part.encode())
                if want - have == 2:  # the payload ends in a line break, with which the split began: its own end opens the next part
                    parts[-1] += "\r\n"
                    have = want
                if have > want:
                    raise ValueError(f"a record of {want} bytes doesn't end where its head says")
                if have == want:
                    digest = head["WARC-Payload-Digest"].partition(":")[2]
                    own, refers = (head[k].strip("<>") if k in head else None for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    out.append((_page(own), head.get("WARC-Target-URI"), head["WARC-Type"], _page(refers), digest, want, END.join(parts) if payloads else None, own, refers))
                    head = None
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=list(names))
        if head is not None:
            raise ValueError("an archive ends inside a record")

    # a compressed file is never split, so a partition has whole files in order
    return spark.read.option("lineSep", END).text(path).mapInArrow(run, _READ)


def deduplicate(pages: DataFrame, path: str, least: int = LEAST) -> str:
    """Archives of ``pages`` in which repeated payloads are revisit records."""
    return write(resolve(heads(pages).drop("html"), least), path)


def originals(records: DataFrame) -> DataFrame:
    """Records read back, revisits with the payload_bytes of the response whose id they name (null if there is none)."""
    full = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("payload_bytes").alias("_full"))
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes").join(full, "refers_id", "left").withColumnRenamed("_full", "payload_bytes")
    return records.filter("record_type <> 'revisit'").unionByName(revisits.select(*records.columns))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = deduplicate(pages, new_path(spark, "warc"))
    return originals(read(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""
