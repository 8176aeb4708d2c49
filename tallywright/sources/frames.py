"""The framed binary format of a ledger, listed by Spark's file source, read and written by tasks, a file each and frame by
frame, so that a task holds a batch of entries and the ids of a file, never a file.

A file is a header and frames; a frame is a length, a CRC-32 and a payload of fixed fields, optional ones with a flag in
front. All numbers are big-endian.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice, product
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import written
from ..schema import EVENT_KINDS, LEDGER_SCHEMA, NO_ID, PHYSICAL, PROVENANCES, RESOURCE_KINDS, UNITS

# The format's marks, version, limit and order of fields.
MAGIC, VERSION, ENDIAN, MOST = 0x494C45444745524B, 1, 0xBE, 16 << 20
LAYOUT = (
    ("id", "id"), ("ledger", "id"), ("tenant", "id"), ("workload", "id"), ("request", "id"), ("model", "id"), ("model_revision", "id"), ("adapter", "id?"),
    ("attempt", "id"), ("dispatch", "id"), ("worker", "id"), ("node", "id"), ("device", "id"), ("event_kind", EVENT_KINDS), ("resource_kind", RESOURCE_KINDS),
    ("value", "f64"), ("unit", UNITS), ("provenance", PROVENANCES), ("start_ts_ns", "u64"), ("end_ts_ns", "u64"), ("has_end", "bool"),
    ("src_worker", "id"), ("src_boot", "id"), ("src_accounting_gen", "u64"), ("epoch", "u64"), ("auth_worker_boot", "id"), ("request_gen", "u64"),
    ("accounting_gen", "u64"), ("auth_attempt", "id"), ("attempt_gen", "u64"), ("auth_dispatch", "id"), ("accounting_policy", "id?"), ("pricing_policy", "id?"),
)
PER_FILE = 50_000  # entries of some 400 bytes; the files are dealt to tasks
BATCH = 10_000  # entries of an Arrow batch
HEADER = ">QI16s"
HEADER_SIZE = struct.calcsize(HEADER)
_FIRST_CODE = {EVENT_KINDS: 1, RESOURCE_KINDS: 1, UNITS: 0, PROVENANCES: 0}


class Rejected(ValueError):
    """Why a file or an entry is not accepted."""


def _check(e: dict, counts: bool) -> None:
    v = e["value"]
    if v is None or v != v or abs(v) == float("inf"):
        raise Rejected("value is not finite")
    if e["resource_kind"] in PHYSICAL and v < 0:
        raise Rejected("a physical value is negative")
    if counts and e["unit"] == "count" and v != int(v):
        raise Rejected("a count is not whole")


_OPTIONAL = tuple(k for k, kind in LAYOUT if kind == "id?")
_SIZES = {"id": "16s", "f64": "d", "u64": "Q", "bool": "?"}


def _shape(present: tuple[bool, ...]) -> struct.Struct:
    """Mark, version, fields and number of tags of a payload that has these of the optional ids: each has a flag in front."""
    have = dict(zip(_OPTIONAL, present))
    return struct.Struct(">BI" + "".join(("B16s" if have[k] else "B") if kind == "id?" else _SIZES.get(kind, "B") for k, kind in LAYOUT) + "I")


def _gaps() -> list[int]:
    """Bytes from the end of an optional id (or the start) to the flag of the next one."""
    out, size = [], struct.calcsize(">BI")
    for _, kind in LAYOUT:
        if kind == "id?":
            out.append(size)
            size = 0
        else:
            size += struct.calcsize(">" + _SIZES.get(kind, "B"))
    return out


_GAPS, _CODED = _gaps(), [k for k, kind in LAYOUT if not isinstance(kind, str)]
_NAMES = {kinds: dict(enumerate(kinds, first)) for kinds, first in _FIRST_CODE.items()}
_SHAPES = {present: _shape(present) for present in product((False, True), repeat=len(_OPTIONAL))}


def encode(e: dict) -> bytes:
    """The frame of an entry."""
    _check(e, counts=True)
    out = [struct.pack(">BI", ENDIAN, VERSION)]
    for name, kind in LAYOUT:
        value = e.get(name)
        if kind == "id":
            out.append(bytes.fromhex(value or NO_ID))
        elif kind == "id?":
            out.append(b"\x01" + bytes.fromhex(value) if value else b"\x00")
        elif kind == "f64":
            out.append(struct.pack(">d", value))
        elif kind == "u64":
            out.append(struct.pack(">Q", value or 0))
        elif kind == "bool":
            out.append(bytes([e.get("end_ts_ns") is not None]))
        else:
            out.append(bytes([kind.index(value) + _FIRST_CODE[kind]]))
    tags = sorted((e.get("metadata") or {}).items())
    out.append(struct.pack(">I", len(tags)))
    for text in (t for pair in tags for t in pair):
        raw = text.encode()
        out += [struct.pack(">I", len(raw)), raw]
    payload = b"".join(out)
    return struct.pack(">II", len(payload), zlib.crc32(payload)) + payload


def decode(payload: bytes) -> dict:
    """The entry of a payload. Counts need not be whole here."""
    present, at = [], 0
    for gap in _GAPS:
        at += gap
        if at >= len(payload):
            return _decode_by_field(payload)
        present.append(payload[at] != 0)
        at += 17 if present[-1] else 1
    shape = _SHAPES[tuple(present)]
    if len(payload) < shape.size:
        return _decode_by_field(payload)
    mark, version, *values, tags = shape.unpack_from(payload)
    at, values, e, texts = shape.size, iter(values), {}, []
    for name, kind in LAYOUT:
        value = next(values)
        if kind == "id":
            e[name] = value.hex()
        elif kind == "id?":
            e[name] = next(values).hex() if value else None
        elif isinstance(kind, str):
            e[name] = value
        else:
            e[name] = _NAMES[kind].get(value)
    for _ in range(2 * tags):
        if at + 4 > len(payload):
            return _decode_by_field(payload)
        length = int.from_bytes(payload[at : at + 4])
        if at + 4 + length > len(payload):
            return _decode_by_field(payload)
        texts.append(payload[at + 4 : at + 4 + length])
        at += 4 + length
    if (mark, version) != (ENDIAN, VERSION) or at != len(payload) or any(e[k] is None for k in _CODED):
        return _decode_by_field(payload)
    texts = [t.decode() for t in texts]
    e["metadata"] = dict(zip(texts[::2], texts[1::2]))
    if not e.pop("has_end"):
        e["end_ts_ns"] = None
    _check(e, counts=False)
    return e


def _decode_by_field(payload: bytes) -> dict:
    """As ``decode``, a field after the other: the first one that is wrong is the reason to reject."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(payload):
            raise Rejected("corrupt frame: too short")
        at += n
        return payload[at - n : at]

    if struct.unpack(">BI", take(5)) != (ENDIAN, VERSION):
        raise Rejected("corrupt frame: mark or version")
    e: dict = {}
    for name, kind in LAYOUT:
        if kind == "id":
            e[name] = take(16).hex()
        elif kind == "id?":
            e[name] = take(16).hex() if take(1) != b"\x00" else None
        elif kind == "f64":
            e[name] = struct.unpack(">d", take(8))[0]
        elif kind == "u64":
            e[name] = struct.unpack(">Q", take(8))[0]
        elif kind == "bool":
            e[name] = take(1) != b"\x00"
        else:
            code = take(1)[0] - _FIRST_CODE[kind]
            if not 0 <= code < len(kind):
                raise Rejected(f"corrupt frame: {name}")
            e[name] = kind[code]
    text = lambda: take(struct.unpack(">I", take(4))[0]).decode()
    e["metadata"] = {text(): text() for _ in range(struct.unpack(">I", take(4))[0])}
    if at != len(payload):
        raise Rejected("corrupt frame: more than its fields")
    if not e.pop("has_end"):
        e["end_ts_ns"] = None
    _check(e, counts=False)
    return e


def frames_of(data: bytes, header: bool = True) -> Iterator[dict]:
    """The entries of a file's bytes, or the reason why it is rejected."""
    return _frames(io.BytesIO(data), len(data), header)


def _frames(data: BinaryIO, size: int, header: bool = True) -> Iterator[dict]:
    """The entries of ``size`` bytes, one frame in memory at a time; ids are kept as 16 bytes."""
    at = 0
    if header:
        if size < HEADER_SIZE:
            raise Rejected("file too short")
        magic, version, _ = struct.unpack(HEADER, data.read(HEADER_SIZE))
        if magic != MAGIC:
            raise Rejected("bad magic")
        if version != VERSION:
            raise Rejected("unsupported version")
        at = HEADER_SIZE
    seen: set[bytes] = set()
    while at < size:
        if at + 8 > size:
            raise Rejected("truncated frame header")
        length, crc = struct.unpack(">II", data.read(8))
        if at + 8 + length > size:
            raise Rejected("truncated frame payload")
        if not 0 < length <= MOST:
            raise Rejected("length mismatch")
        payload = data.read(length)
        if zlib.crc32(payload) != crc:
            raise Rejected("corrupt frame: checksum")
        e = decode(payload)
        key = bytes.fromhex(e["id"])
        if key in seen:
            raise Rejected(f"duplicate id {e['id']}")
        seen.add(key)
        yield e
        at += 8 + length


def _place(path: str) -> tuple:
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):  # as Spark names it, with no escapes
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _stored(path: str, header: bool = True) -> Iterator[dict]:
    where, name = _place(path)
    with where.open_input_stream(name, buffer_size=1 << 20) as data:
        yield from _frames(data, where.get_file_info(name).size, header)


def files_for(entries: DataFrame) -> int:
    """How many files of about PER_FILE entries hold ``entries``."""
    return 1 + entries.count() // PER_FILE


def write(entries: DataFrame, path: str, ledger: str = "0" * 31 + "1", files: int | None = None, after: int = 0) -> DataFrame:
    """Framed files under ``path`` that hold the entries in order of seq, file after file: ranges of seq, numbered from
    ``after`` on, each of about PER_FILE entries unless ``files`` says how many. Returns file, frames of each. A task that
    runs again writes the same name, and a file appears only when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, folder = _place(path)
        where.create_dir(folder)
        task = TaskContext.get()
        name = f"{folder}/part-{after + task.partitionId():05d}.frames"
        n = 0
        with where.open_output_stream(f"{name}.{task.attemptNumber()}.tmp") as out:
            out.write(struct.pack(HEADER, MAGIC, VERSION, bytes.fromhex(ledger)))
            for batch in batches:
                columns = (x.to_pylist() if pa.types.is_map(x.type) or pa.types.is_floating(x.type) else x.to_pandas(integer_object_nulls=True).tolist() for x in batch.columns)
                for row in zip(*columns):
                    e = dict(zip(batch.schema.names, row))
                    e["metadata"] = dict(e["metadata"] or ())
                    out.write(encode(e))
                n += len(batch)
        where.move(f"{name}.{task.attemptNumber()}.tmp", name)
        yield pa.RecordBatch.from_pydict({"file": [name], "frames": [n]})

    files = files or files_for(entries)
    return entries.repartitionByRange(files, "seq").sortWithinPartitions("seq").mapInArrow(run, "file string, frames long")


def _numbers(spark: SparkSession, path: str) -> dict[str, int]:
    """The files of a ledger in order: by the number in their names, others last by name."""
    names = [r["path"] for r in _files(spark, path).collect()]  # one row a file
    number = {n: re.search(r"part-(\d+)\.frames$", n) for n in names}
    return {n: i for i, n in enumerate(sorted(names, key=lambda n: (number[n] is None, int(number[n][1]) if number[n] else 0, n)))}


def read(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The entries of all files under ``path``; any reason to reject a file fails the read. seq numbers entries in the
    order of the ledger: by file, then by place. Ids are looked at within each file; ``load`` looks at all."""
    shape, numbers = to_arrow_schema(LEDGER_SCHEMA), _numbers(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                at, entries = numbers[name] << 32, _stored(name, header)
                while rows := list(islice(entries, BATCH)):
                    columns = [range(at, at + len(rows)), *([e[f.name] for e in rows] for f in list(shape)[1:-1]), [list(e["metadata"].items()) for e in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, shape)], schema=shape)
                    at += len(rows)

    return _files(spark, path).mapInArrow(run, LEDGER_SCHEMA)


def _once(entries: DataFrame) -> DataFrame:
    again = entries.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id").head()
    if again is not None:
        raise Rejected(f"duplicate id {again['id']}")
    return entries


def load(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger as a table, decoded once; an id that two files have rejects it."""
    return _once(written(read(spark, path), "ledger"))


def add(entries: DataFrame, path: str, ledger: str = "0" * 31 + "1", files: int | None = None) -> DataFrame:
    """Files of ``entries`` behind those of the ledger under ``path``. Ids that the ledger has, or that repeat, reject all."""
    stored = read(entries.sparkSession, path)
    _once(stored.select("id").unionByName(entries.select("id")))
    numbers = [int(m[1]) for n in _numbers(entries.sparkSession, path) if (m := re.search(r"part-(\d+)\.frames$", n))]
    return write(entries, path, ledger, files, after=max(numbers, default=-1) + 1)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files' names. Contents are not asked for: a file would be one row, held whole and several times over."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.frames").load(path).select("path")


def recover(spark: SparkSession, path: str) -> DataFrame:
    """file, ok, reason, frames: whether each file would be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["path"]:
                n, reason = 0, ""
                try:
                    for _ in _stored(name):
                        n += 1
                except Rejected as e:
                    reason = str(e)
                out.append((name, not reason, reason, n))
            yield pd.DataFrame(out, columns=["file", "ok", "reason", "frames"])

    return _files(spark, path).mapInPandas(run, "file string, ok boolean, reason string, frames long")


def digest(entries: DataFrame) -> DataFrame:
    """One row: an order-bound digest of the entries that any number of tasks can add up."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) if c == "metadata" else F.col(c) for c in entries.columns))
    return entries.agg(F.count("*").alias("entries"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def derived_id() -> Column:
    """An id from what an entry says: 128 bits of its identifying fields."""
    fields = ("ledger", "tenant", "workload", "request", "model", "model_revision", "event_kind", "resource_kind", "src_worker", "src_boot", "src_accounting_gen", "epoch", "accounting_gen", "request_gen", "attempt_gen", "auth_attempt", "start_ts_ns", "value")
    text = lambda f: F.format_string("%.6f", f) if f == "value" else F.col(f).cast("string")
    return F.md5(F.concat_ws("|", *(F.coalesce(text(f), F.lit("")) for f in fields)))
