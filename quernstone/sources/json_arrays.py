"""Elements of JSON array files, without a whole file in one row.

A file is read in its byte ranges as pieces between commas, whatever its lines, and
written as chunks of about a megabyte to the shared folder. Of each chunk it is counted
how it changes the state of a parser, for a start within a string and one outside; the
driver adds these counts up, so all chunks are then cut into elements side by side.
Only parts of an element, and so of one record, come together in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared

CHUNK = 1 << 20
NO_ARRAY = "Failed to parse JSON: no array"
CODECS = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int32)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True

_CHUNKS = "file bigint, block bigint, n bigint, size bigint, text binary, blank boolean, turns boolean, rises array<bigint>, commas array<array<bigint>>"
_PARTS = "file bigint, block bigint, n bigint, at bigint, alone boolean, part binary"
_CHUNKS_ARROW = pa.schema([*((c, pa.int64()) for c in ("file", "block", "n", "size")), ("text", pa.binary()), ("blank", pa.bool_()), ("turns", pa.bool_()), ("rises", pa.list_(pa.int64())), ("commas", pa.list_(pa.list_(pa.int64())))])
_PARTS_ARROW = pa.schema([*((c, pa.int64()) for c in ("file", "block", "n", "at")), ("alone", pa.bool_()), ("part", pa.binary())])


def structure(text: bytes, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of each byte: code, escaped ones masked; change of depth; whether it is a comma outside strings. Whether the end is within one."""
    code = np.frombuffer(_ESCAPED.sub(b"__", text), np.uint8)
    quotes = np.cumsum(code == ord('"'), dtype=np.int32)
    outside = (quotes + within) & 1 == 0
    return code, np.where(outside, _STEP[code], 0), outside & (code == ord(",")), bool(len(code) and not outside[-1])


def _end(text: bytearray, size: int) -> int:
    """Where a chunk of at least `size` bytes ends: not behind a backslash that escapes, nor within a character."""
    slashes = 0
    while slashes < size and text[size - 1 - slashes] == ord("\\"):
        slashes += 1
    size += slashes % 2
    while size < len(text) and text[size] & 0xC0 == 0x80:
        size += 1
    return size


def _chunk(key: tuple[int, int, int], n: int, text: bytes) -> tuple:
    rises, commas, turns = [], [], False
    for within in (False, True):
        code, step, comma, end = structure(text, within)
        depth = np.cumsum(step, dtype=np.int32)
        turns = turns if within else end
        rises.append(int(depth[-1]))
        levels, counts = np.unique(depth[comma], return_counts=True)
        commas.append(np.stack([levels, counts], axis=1).ravel().tolist())
    return (*key[:2], n, key[2], text, bool(_BLANK[code].all()), turns, rises, commas)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each block from its pieces; every piece but a file's first follows a comma."""
    key, text, n = None, bytearray(), 0
    for b in batches:
        keys = np.stack([c.to_numpy() for c in b.columns[:3]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            new = tuple(keys[low].tolist())
            opens = new != key
            if opens:
                if text:
                    yield _batch([_chunk(key, n, bytes(text))], _CHUNKS_ARROW)
                key, text, n = new, bytearray(), 0
            text += b" " if opens and key[1] == 0 else b","
            text += b",".join(b.column(3).slice(low, high - low).to_pylist())
            while len(text) > 2 * CHUNK:
                end = _end(text, CHUNK)
                yield _batch([_chunk(key, n, bytes(text[:end]))], _CHUNKS_ARROW)
                del text[:end]
                n += 1
    if text:
        yield _batch([_chunk(key, n, bytes(text))], _CHUNKS_ARROW)


def _states(rows: list) -> dict[tuple[int, int, int], tuple[bool, int, bool, int, bool]]:
    """Of each chunk's start: within a string, depth, whether the array is open, the element's place, whether the file has one at most."""
    files: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.file, r.block, r.n)):
        files.setdefault(r.file, []).append(r)
    out = {}
    for chunks in files.values():
        within, depth, opened, at, total, found = False, 0, False, 0, 0, {}
        for r in chunks:
            found[r.file, r.block, r.n] = (within, depth, opened, at)
            at += dict(zip(r.commas[within][::2], r.commas[within][1::2], strict=True)).get(1 - depth, 0)
            depth += r.rises[within]
            within ^= r.turns
            opened |= not r.blank
            total += r.bytes
        # A comma at a file's very end closes a piece, but none follows: a byte is missing.
        if not opened or within or depth != 0 or chunks[0].size == total:
            raise ValueError(NO_ARRAY)
        out |= {k: (*v, at == 0) for k, v in found.items()}
    return out


def _parts(text: bytes, within: bool, depth: int, opened: bool) -> list[bytes]:
    """The parts of elements in a chunk, one after the other; a text that is no array is an error."""
    code, step, comma, _ = structure(text, within)
    after = np.cumsum(step, dtype=np.int32) + depth
    bare = np.flatnonzero((after - step == 0) & ~_BLANK[code])  # outside the array, but for its start
    closed = np.flatnonzero((after == 0) & (step < 0))
    if len(bare) > (not opened) or (len(bare) and code[bare[0]] != ord("[")) or (len(closed) and code[closed[0]] != ord("]")):
        raise ValueError(NO_ARRAY)
    if depth == 0 and not len(bare):
        return []
    low, high = int(bare[0]) + 1 if len(bare) else 0, int(closed[0]) if len(closed) else len(text)
    cuts = [low - 1, *np.flatnonzero(comma & (after == 1)).tolist(), high]
    return [text[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]


def elements(spark: SparkSession, path: str) -> DataFrame:
    """at (from 0) and text of every element of the JSON array in each file of `path`; a file that is none is an error."""
    plain = F.lit(True)
    for ending in CODECS:
        plain &= ~F.col("_metadata.file_path").endswith(ending)
    pieces = spark.read.text(path, lineSep=",").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.when(plain, F.col("_metadata.file_size")).otherwise(-1).alias("size"), F.col("value").cast("binary").alias("value")
    )
    folder = shared(spark, "json-chunks")
    pieces.mapInArrow(_chunked, _CHUNKS).write.parquet(folder)
    chunks = spark.read.schema(_CHUNKS).parquet(folder)
    states = _states(chunks.select("file", "block", "n", "size", F.octet_length("text").alias("bytes"), "blank", "turns", "rises", "commas").collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(c[i].as_py() for c in b.columns[:3])
                within, depth, opened, at, alone = states[key]
                if rows := [(*key, at + k, alone, p) for k, p in enumerate(_parts(b.column(3)[i].as_py(), within, depth, opened))]:
                    yield _batch(rows, _PARTS_ARROW)

    parts = chunks.select("file", "block", "n", "text").mapInArrow(cut, _PARTS)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", F.col("part").cast("string").alias("part")))), lambda p: p["part"]), "")
    # An array of nothing but white space has no element.
    return parts.groupBy("file", "at").agg(whole.alias("text"), F.first("alone").alias("alone")).where(~F.col("alone") | F.col("text").rlike(r"[^ \t\r\n]")).select("at", "text")
