"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary made from text needs few tokens for words and many for random strings. Runs of ``LEAST`` or more letters,
digits and the signs of encoded keys, with at least a letter and a digit or both cases inside, are cut into tokens;
those with fewer than ``RATIO`` characters a token are spans of kind ``random``. Known digests and identifiers are left
out first: hexadecimal strings, UUIDs, dotted or dashed version and host names, paths, e-mail addresses and numbers.
Spans of the patterns stay whatever the test says, and a random string inside one of them is not told twice.

Edge cases: a null text counts as empty and has no span; repeated rows are scanned each; texts are scanned whole,
whatever their length; an empty table gives an empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .scratch import small_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the greedy runs of 24 or more are the matches of [0-9a-f]+ that pass
LEAST, RATIO = 20, 2.2
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_DIGIT, _LETTER, _LOWER, _UPPER = (re.compile(x) for x in ("[0-9]", "[A-Za-z]", "[a-z]", "[A-Z]"))
_KNOWN = re.compile(
    r"(?:[0-9A-Fa-f]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # digests, UUIDs
    r"|[0-9+/_=-]+)"  # numbers
)
_SIGNS = re.compile(r"[-_/=+]+")
_WORD = re.compile(r"[a-z]{1,12}[0-9]{0,2}|[A-Z]{1,12}[0-9]{0,2}|[A-Z][a-z]{1,11}[0-9]{0,2}|[0-9]{1,8}")
VOCABULARY = "byte_bpe_50k.tiktoken"
_encodings: dict = {}


def encoding(path: str | None):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def mixed(run: str) -> bool:
    """A letter and a digit, or two capitals and a lower-case letter before and after a capital. Each search goes on where
    the last one ended, so the time grows with the length."""
    if _DIGIT.search(run) and _LETTER.search(run):
        return True
    upper = _UPPER.search(run)
    if not upper or not _UPPER.search(run, upper.end()):
        return False
    lower = _LOWER.search(run)
    upper = lower and _UPPER.search(run, lower.end())
    return bool(upper and _LOWER.search(run, upper.end()))


def named(run: str, encode) -> bool:
    """A path or a name: every part between signs is a short word or number, or passes the token test itself. The signs
    are letters of base64 as well, so they alone say nothing."""
    return all(_WORD.fullmatch(x) or len(x) >= RATIO * len(encode(x)) for x in _SIGNS.split(run) if x)


def random_spans(text: str, found: list[tuple[int, int, str]], encode) -> list[tuple[int, int, str]]:
    out, at, reach = [], 0, -1  # reach: the farthest end of the found spans that start before the run's end
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        while at < len(found) and found[at][0] < b:
            reach = max(reach, found[at][1])
            at += 1
        if reach > a or not mixed(run) or _KNOWN.fullmatch(run):
            continue
        if len(run) < RATIO * len(encode(run)) and not named(run, encode):
            out.append((a, b, KINDS[3]))
    return out


def spans(text: str, encode) -> tuple[list, list]:
    base = base_spans(text)
    extra = random_spans(text, base, encode)
    return base, sorted(base + extra, key=lambda x: (x[0], KINDS.index(x[2]))) if extra else base


def _join(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


#: What a text must have for any span; only texts with it are looked at one by one.
_SOME = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"
SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``docs`` and base_spans, all_spans: arrays of (start, end, kind). Columns of ``docs`` that have such
    a name already are kept, with ``_`` behind it."""
    clear, own = docs, ("base_spans", "all_spans")
    for name in [c for c in docs.columns if c in own]:
        other = name + "_"
        while other in clear.columns:
            other += "_"
        clear = clear.withColumnRenamed(name, other)
    names = clear.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(names.index("text"))
            some = pc.match_substring_regex(texts, _SOME)
            base, every = [], []
            for i, hit in enumerate(some.to_pylist()):
                b, e = spans(texts[i].as_py(), encode) if hit else ([], [])
                base.append([{"start": x, "end": y, "kind": k} for x, y, k in b])
                every.append([{"start": x, "end": y, "kind": k} for x, y, k in e])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(every, kind)], names=[*names, "base_spans", "all_spans"])

    array = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    return small_batches(clear).mapInArrow(run, T.StructType([*clear.schema.fields, T.StructField("base_spans", array), T.StructField("all_spans", array)]))


def redact(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in its text; overlapping spans are replaced by one. n_chars, where
    there is such a column, is set anew for the changed texts; rows without a span stay as they are."""
    names, where = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts, columns = batch.column(where), list(batch.columns)
            hits = {}
            for i, hit in enumerate(pc.match_substring_regex(texts, _SOME).to_pylist()):
                found = spans(texts[i].as_py(), encode)[1] if hit else []
                if found:
                    t, out, at = texts[i].as_py(), [], 0
                    for a, b, _ in found:
                        if a >= at:
                            out += [t[at:a], mark]
                        at = max(at, b)
                    hits[i] = "".join(out) + t[at:]
            if hits:
                columns[where] = pa.array([hits.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(hits[i]) if i in hits else n for i, n in enumerate(columns[k].to_pylist())], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).drop("text")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
