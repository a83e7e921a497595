"""TIFF columns: directories walked, strips and tiles decoded, one row per page.

The reader takes classic and big files of either byte order, strips or tiles, chunky
or separate planes, uncompressed, PackBits, LZW or deflate data, samples of 1, 2, 4, 8, 16,
32 or 64 bits in either fill order, and the horizontal and the floating-point predictor.
Samples below 8 bits come out as one byte each. Directories that a directory has as
children (reduced copies, masks) follow it as pages of their own, marked `child`. The
writer makes classic little-endian files with the same codecs, 8-bit samples and predictor 2.

Defined cases: null or empty content gives one row with the error `no content`; a page
that cannot be read (a codec not named above, missing data) is a row with its error, and
the walk goes on; damage to the chain of directories ends it with one row with an error;
a chain that returns to itself ends there. A page of more than `MAX_PAGE_BYTES` is an error. An empty table gives an empty result.
The page is a struct, so other columns keep their names; a column that is itself
called `page` is replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

# Fixed values of the TIFF 6.0 format: field types with their struct codes, tags, compressions.
FIELD_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, CHILDREN, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 330, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODEC_NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END, FIRST, MOST_CODES = 256, 257, 258, 4096

#: What a binary cell holds: a page with more decoded bytes is an error, not an allocation.
MAX_PAGE_BYTES = (1 << 31) - (1 << 16)

PAGE = T.StructType(
    [
        T.StructField("number", T.IntegerType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("codec", T.StringType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("child", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, all else as literals of up to 128 bytes."""
    out, a = bytearray(), np.frombuffer(data, np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1)) if len(a) else np.empty(0, int)
    lengths = np.diff(np.append(starts, len(a)))
    at = 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        literal(start)
        for i in range(0, length, 128):
            n = min(128, length - i)
            out.extend((257 - n, data[start]) if n > 1 else (0, data[start]))
        at = start + length
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
                i += 1
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    out, bits, held = bytearray(), CLEAR, 9
    table: dict = {}
    code, width, word = FIRST, 9, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        known = table.get(key)
        if known is not None:
            word = known
            continue
        bits = bits << width | word
        held += width
        table[key] = code
        code += 1
        if code == 1 << width and width < 12:
            width += 1
        elif code == MOST_CODES - 2:
            bits, held = bits << width | CLEAR, held + width
            table, code, width = {}, FIRST, 9
        word = byte
        if held >= 512:
            rest = held & 7
            out += (bits >> rest).to_bytes((held - rest) // 8, "big")
            bits, held = bits & (1 << rest) - 1, rest
    if word >= 0:
        bits, held, code = bits << width | word, held + width, code + 1
        if code == 1 << width and width < 12:
            width += 1
    bits, held = bits << width | END, held + width
    pad = -held % 8
    return bytes(out + (bits << pad).to_bytes((held + pad) // 8, "big"))


def lzw_decode(data: bytes, size: int) -> bytes:
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, last = [], start[:], b""
    width, bits, held, made, i, n = 9, 0, 0, 0, 0, len(data)
    while made < size:
        if held < width:
            step = data[i : i + 8]
            if not step:
                break
            bits = (bits & (1 << held) - 1) << 8 * len(step) | int.from_bytes(step, "big")
            held += 8 * len(step)
            i += 8
            if held < width:
                break
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == CLEAR:
            table, width, last = start[:], 9, b""
            continue
        if code == END:
            break
        if not last:
            word = table[code]
        else:
            known = len(table)
            if code > known:
                raise ValueError("LZW code beyond the table")
            word = table[code] if code < known else last + last[:1]
            table.append(last + word[:1])
            if known + 2 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        made += len(word)
        last = word
    return b"".join(out)


def _encode(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    return {LZW: lzw_encode, PACKBITS: packbits_encode, NONE: bytes}[compression](data)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == NONE:
        return data[:size]
    raise ValueError(f"compression {compression} is not known")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 128) -> bytes:
    """A file of 8-bit pages (height, width[, samples]); `tile`: the tiles' side, 0 for strips."""
    body, chain, link = bytearray(b"II*\0\0\0\0\0"), [], 4
    for page in pages:
        a = np.ascontiguousarray(page, np.uint8)
        a = a[:, :, None] if a.ndim == 2 else a
        h, w, n = a.shape
        if tile:
            down, across = -(-h // tile), -(-w // tile)
            full = np.zeros((down * tile, across * tile, n), np.uint8)
            full[:h, :w] = a
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            parts = [a[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
            data = _encode(part.tobytes(), compression)
            offsets.append(len(body))
            sizes.append(len(data))
            body += data + b"\0" * (len(data) & 1)
        fields = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [8] * n), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1 if n < 3 else 2]), SAMPLES: ("H", [n]), PLANAR: ("H", [1]), PREDICTOR: ("H", [predictor])}
        fields |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_OFFSETS: ("I", offsets), TILE_BYTES: ("I", sizes)} if tile else {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [rows_per_strip]), STRIP_BYTES: ("I", sizes)}
        entries = bytearray()
        for tag, (code, values) in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}{code}", *values)
            if len(data) > 4:
                where = len(body)
                body += data + b"\0" * (len(data) & 1)
                data = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, {"H": 3, "I": 4}[code], len(values)) + data.ljust(4, b"\0")
        chain.append((link, len(body)))
        link = len(body) + 2 + len(entries)
        body += struct.pack("<H", len(entries) // 12) + entries + b"\0\0\0\0"
    for at, target in chain:
        struct.pack_into("<I", body, at, target)
    return bytes(body)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple], bool]]:
    """Byte order, fields and whether it is a child, of every directory of the chain; children follow their parent."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    count, size, offset = ("H", 12, "I") if magic == 42 else ("Q", 20, "Q")
    width, seen = struct.calcsize(offset), set()

    def chain(at: int, child: bool) -> Iterator[tuple[str, dict[int, tuple], bool]]:
        while at and at not in seen:
            seen.add(at)
            entries = struct.unpack_from(order + count, data, at)[0]
            at += struct.calcsize(count)
            fields = {}
            for i in range(entries):
                tag, kind, n = struct.unpack_from(f"{order}HH{offset}", data, at + i * size)
                code = FIELD_CODES.get(kind)
                if not code:
                    continue
                where = at + i * size + 4 + width
                if n * struct.calcsize(code) > width:
                    where = struct.unpack_from(order + offset, data, where)[0]
                if where + n * struct.calcsize(code) > len(data):
                    raise ValueError(f"field {tag} reaches beyond the file")
                fields[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
            yield order, fields, child
            for place in fields.get(CHILDREN, ()):
                yield from chain(place, True)
            at = struct.unpack_from(order + offset, data, at + entries * size)[0]

    yield from chain(struct.unpack_from(order + offset, data, 4 if magic == 42 else 8)[0], False)


def _unpacked(raw: bytes, bits: int, rows: int, row_samples: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits as bytes; each row starts at a byte of its own."""
    stride = -(-row_samples * bits // 8)
    packed = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
    return np.unpackbits(packed, axis=1).reshape(rows, -1, bits).dot(1 << np.arange(bits)[::-1])[:, :row_samples].astype(np.uint8)


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Undoes a predictor over (rows, columns, samples)."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        return np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = np.cumsum(block.view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples)
    raise ValueError(f"predictor {predictor} does not fit the samples")


#: Every byte with its bits in reverse.
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def read_page(data: bytes, order: str, fields: dict[int, tuple], number: int, most: int = MAX_PAGE_BYTES) -> dict:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    w, h, n = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1), "u")
    small = bits in (1, 2, 4) and kind == "u"
    if not small and bits not in (8, 16, 32, 64) or (kind == "f" and bits == 8):
        raise ValueError(f"samples of {bits} bits are not read")
    if small and predictor != 1:
        raise ValueError(f"predictor {predictor} does not fit the samples")
    if len(set(fields.get(BITS, (bits,)))) > 1:
        raise ValueError("samples of different widths are not read")
    dtype = np.dtype(np.uint8) if small else np.dtype(f"{order}{kind}{bits // 8}")
    turned = one(FILL_ORDER, 1) == 2
    if w * h * n * dtype.itemsize > most:
        raise ValueError(f"page of {w} x {h} is beyond {most} bytes")
    tiled = TILE_WIDTH in fields
    offsets, sizes = (fields.get(t, ()) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    if not (w and h and across and down):
        raise ValueError("page without area")
    per_row = -(-w // across)
    grid = per_row * -(-h // down)
    planes, depth = (n, 1) if planar == 2 else (1, n)
    if len(offsets) < grid * planes or len(sizes) < grid * planes:
        raise ValueError("strips or tiles are missing")
    out = np.zeros((h, w, n), dtype.newbyteorder("="))
    for i in range(grid * planes):
        plane, cell = divmod(i, grid)
        y, x = cell // per_row * down, cell % per_row * across
        rows = down if tiled else min(down, h - y)
        size = rows * -(-across * depth * bits // 8)
        stored = data[offsets[i] : offsets[i] + sizes[i]]
        raw = _decode(stored.translate(_TURNED) if turned else stored, compression, size)
        if len(raw) < size:
            raise ValueError("data ends early")
        values = _unpacked(raw, bits, rows, across * depth) if small else np.frombuffer(raw, dtype, rows * across * depth)
        block = _undo(values.reshape(rows, across, depth), predictor, order)
        out[y : y + rows, x : x + across, plane : plane + depth] = block[: h - y, : w - x]
    return {"number": number, "width": w, "height": h, "samples": n, "bits": bits, "codec": CODEC_NAMES[compression], "predictor": predictor, "tiled": tiled, "data": out.astype(out.dtype.newbyteorder("<"), copy=False).tobytes(), "error": None}


def read_tiff(data: bytes | None, most: int = MAX_PAGE_BYTES) -> Iterator[dict]:
    """The pages of a file as rows; a page that cannot be read is a row with an error, and so is a broken chain."""
    number, blank = 0, dict.fromkeys(PAGE.names)
    faults = (ValueError, struct.error, zlib.error, IndexError, OverflowError, MemoryError)
    walk = _directories(data) if data else iter(())
    try:
        if not data:
            raise ValueError("no content")
        for order, fields, child in walk:
            try:
                page = read_page(data, order, fields, number, most) | {"child": child}
            except faults as e:
                page = blank | {"number": number, "child": child, "error": str(e) or type(e).__name__}
            yield page
            number += 1
    except faults as e:
        yield blank | {"number": number, "error": str(e)}


def _flushed(rows: Iterator[tuple[int, dict]], carried: pa.RecordBatch, schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of (row of `carried`, new values), cut at about `most` bytes of values."""

    def batch() -> pa.RecordBatch:
        old = carried.take(pa.array(at, pa.int64()))
        columns = [old.column(f.name) if f.name not in new[0] else pa.array([x[f.name] for x in new], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    at, new, held = [], [], 0
    for i, values in rows:
        at.append(i)
        new.append(values)
        held += sum(len(v) for v in values.values() if isinstance(v, bytes)) + sum(len(x) for v in values.values() if isinstance(v, dict) for x in v.values() if isinstance(x, bytes))
        if held >= most:
            yield batch()
            at, new, held = [], [], 0
    if at:
        yield batch()


def tiff_pages(df: DataFrame, content_col: str) -> DataFrame:
    """The columns of `df` without the content, and `page`, for every page of every file."""
    names = [c for c in df.columns if c not in (content_col, "page")]
    df = df.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{content_col}`").cast("binary").alias("page"))
    out = T.StructType([*df.schema.fields[:-1], T.StructField("page", PAGE)])
    schema = to_arrow_schema(out)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            rows = ((i, {"page": page}) for i in range(batch.num_rows) for page in read_tiff(column[i].as_py()))
            yield from _flushed(rows, batch, schema)

    return df.mapInArrow(pages, out)


def stored_form(payload: bytes) -> bytes:
    """A text's payload as one page, 64 samples wide; its height picks codec and layout."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    turn = len(a) % 8
    if turn == 1:
        return write_tiff([a], LZW, predictor=1)
    if turn == 2:
        return write_tiff([a], PACKBITS, predictor=1)
    return write_tiff([a], DEFLATE, predictor=1 + turn % 2, tile=64 if turn >= 6 else 0)


def texts_as_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a stored page: id, n_bytes, media (null text: empty)."""
    df = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("media"))
    out = T.StructType([df.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    schema = to_arrow_schema(out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)

            def rows(texts: pa.Array = texts) -> Iterator[tuple[int, dict]]:
                for i in range(len(texts)):
                    text = texts[i].as_py()
                    yield i, {"n_bytes": len(text), "media": stored_form(text.ljust(max(64, -(-len(text) // 64) * 64), b"\0"))}

            yield from _flushed(rows(), batch, schema)

    return df.mapInArrow(encode, out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF page and read back."""
    common.arrow_rows(spark)
    stored = texts_as_tiff(common.documents(spark, sf_dir)).withColumn("media_bytes", F.octet_length("media").cast("bigint")).withColumn("media_sha256", F.sha2("media", 256))
    page = F.col("page")
    payload = page["data"]
    return tiff_pages(stored, "media").select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(
            " ",
            F.concat_ws("x", page["width"], page["height"]),
            page["codec"],
            F.concat(F.lit("predictor"), page["predictor"]),
            F.when(page["tiled"], "tiles").otherwise("strips"),
            F.substring(F.sha1(payload), 1, 8),
        ).alias("feature"),
        page["number"].alias("page"),
        page["error"].alias("error"),
    )
