"""TIFF media columns: one row per page of every image.

The reader walks the chain of image directories (classic and BigTIFF, both byte orders, loops
refused), decodes strips or tiles (uncompressed, PackBits, LZW, deflate), undoes the horizontal
and the floating-point predictor and joins planes, so that pixels come out row by row with
interleaved samples in little-endian order. The writer makes files of 8-bit grey pages.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes and struct letters of the field types.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_LEN, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_LEN, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
READ = frozenset((WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_LEN, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_LEN, FORMAT))
#: Field types of whole numbers.
WHOLE = (1, 3, 4, 6, 8, 9, 13, 16, 17, 18)


class TiffError(ValueError):
    pass


# codecs


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(data[at : m.start()])
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc, n, out = 256, 9, bytearray()
    codes: dict[int, int] = {}
    code, width, following = -1, 9, 258
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        known = codes.get(key)
        if known is not None:
            code = known
            continue
        acc, n = acc << width | code, n + width
        codes[key] = following
        following += 1
        code = byte
        if following > (1 << width) - 1:
            width += 1
        if following == 4094:
            acc, n = acc << 12 | 256, n + 12
            codes, width, following = {}, 9, 258
        if n > 4096:
            rest = n & 7
            out += (acc >> rest).to_bytes(n >> 3, "big")
            acc, n = acc & (1 << rest) - 1, rest
    if code >= 0:
        acc, n = acc << width | code, n + width
        following += 1
        if following > (1 << width) - 1 and width < 12:
            width += 1
    acc, n = acc << width | 257, n + width
    pad = -n & 7
    return bytes(out) + (acc << pad).to_bytes((n + pad) >> 3, "big")


_ROOTS = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, size: int) -> bytes:
    out, have, table, width, last = [], 0, list(_ROOTS), 9, None
    acc = n = i = 0
    end = len(data)
    while have < size:
        while n < width:
            if i >= end:
                return b"".join(out)
            acc = (acc & (1 << n) - 1) << 8 | data[i]
            i += 1
            n += 8
        n -= width
        code = acc >> n & (1 << width) - 1
        if code == 256:
            table, width, last = list(_ROOTS), 9, None
            continue
        if code == 257:
            break
        if last is None:
            if code > 255:
                raise TiffError("LZW: first code is not a byte")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise TiffError("LZW: unknown code")
        out.append(entry)
        have += len(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression == PACKBITS:
        raw = packbits_decode(data, size)
    elif compression == LZW:
        raw = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = inflate(data, size)
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(raw) < size:
        raise TiffError(f"a strip or tile has {len(raw)} of {size} bytes")
    return raw[:size]


# reader


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    photometric: int
    tiled: bool
    parts: int
    pixels: bytes


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    head, size, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    if at + struct.calcsize(head) > len(data):
        raise TiffError("a directory lies outside the file")
    try:
        (n,) = struct.unpack_from(order + head, data, at)
        at += struct.calcsize(head)
        if at + n * size > len(data):
            raise TiffError("a directory ends outside the file")
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, data, at + i * size)
            unit, letter = FIELD.get(kind, (0, ""))
            if not unit:
                continue
            if tag not in READ:
                continue
            where = at + i * size + 4 + struct.calcsize(word)
            if unit * count > struct.calcsize(word):
                (where,) = struct.unpack_from(order + word, data, where)
            if where + unit * count > len(data):
                raise TiffError(f"tag {tag} lies outside the file")
            if kind not in WHOLE:
                raise TiffError(f"tag {tag} is not of whole numbers")
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
            if not count or min(tags[tag]) < 0:
                raise TiffError(f"tag {tag} has no value or a negative one")
        (following,) = struct.unpack_from(order + word, data, at + n * size)
    except struct.error:
        raise TiffError("a directory is cut off") from None
    return tags, following


def read_tiff(data: bytes, most_bytes: int = 1 << 28) -> Iterator[Page]:
    """The pages of a file, one after the other. TiffError where it cannot go on; a page may have most_bytes bytes."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43) or magic == 43 and len(data) < 16:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + ("Q" if magic == 43 else "I"), data, 8 if magic == 43 else 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, following = _directory(data, at, order, magic == 43)
        yield _page(data, tags, order, len(seen) - 1, most_bytes)
        at = following


def _page(data: bytes, tags: dict[int, tuple], order: str, number: int, most: int) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not samples:
        raise TiffError("a page has no size")
    bits, form, planar, compression, predictor = one(BITS, 1), one(FORMAT, 1), one(PLANAR, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if len(set(tags.get(BITS, (1,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError("unsupported bits per sample")
    if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and bits < 16:
        raise TiffError(f"predictor {predictor} is not supported for {bits} bits")
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_AT in tags
    if tiled:
        w, h = one(TILE_W), one(TILE_H)
        offsets, lengths = tags[TILE_AT], tags.get(TILE_LEN, ())
    else:
        w, h = width, min(one(ROWS, height) or height, height)
        offsets, lengths = tags.get(STRIP_AT, ()), tags.get(STRIP_LEN, ())
    if not w or not h:
        raise TiffError("a tile has no size")
    across, down = -(-width // w), -(-height // h)
    unit = max(1, bits // 8)
    if max(width * height, across * w * down * h) * samples * unit > most:
        raise TiffError(f"a page has more than {most} bytes")
    if len(offsets) != across * down * planes or len(lengths) != len(offsets):
        raise TiffError("wrong number of strips or tiles")
    if max((form, compression, one(PHOTOMETRIC, 0))) >= 1 << 31:
        raise TiffError("a code is out of range")
    dtype = np.dtype({1: "u1", 2: "u2", 4: "u4", 8: "u8"}[unit]).newbyteorder(order)
    plain = dtype.newbyteorder("<")
    full = np.zeros((planes, down * h, across * w, each), plain)
    for k, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        plane, y, x = k // (across * down), k // across % down, k % across
        rows = h if tiled else min(h, height - y * h)
        stride = -(-w * each * bits // 8)
        if at + n > len(data):
            raise TiffError("a strip or tile lies outside the file")
        raw = np.frombuffer(_decode(data[at : at + n], compression, rows * stride), np.uint8).reshape(rows, stride)
        if predictor == 3:
            part = _undo_float(raw, w, each, unit)
        elif bits < 8:
            ones = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)[:, : w * each]
            part = np.packbits(ones, axis=2).reshape(rows, w, each) >> (8 - bits)
        else:
            part = raw.reshape(-1).view(dtype).reshape(rows, w, each).astype(plain)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=plain)
        full[plane, y * h : y * h + rows, x * w : (x + 1) * w] = part
    image = full[:, :height, :width]
    image = image[0] if planes == 1 else np.moveaxis(image[..., 0], 0, -1)
    return Page(number, width, height, samples, bits, form, compression, predictor, one(PHOTOMETRIC, 0), tiled, len(offsets), image.tobytes())


def _undo_float(raw: np.ndarray, w: int, each: int, unit: int) -> np.ndarray:
    """Bytes were split by significance, highest first, and differenced along the row."""
    rows = len(raw)
    flat = np.cumsum(raw.reshape(rows, -1, each), axis=1, dtype=np.uint8).reshape(rows, unit, w * each)
    return np.ascontiguousarray(flat[:, ::-1].transpose(0, 2, 1)).reshape(-1).view(f"<u{unit}").reshape(rows, w, each)


# writer


def write_tiff(pages: Sequence[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, strip_rows: int = 64, order: str = "<") -> bytes:
    """A file of 8-bit grey pages in strips, or in square tiles if tile (a multiple of 16) is given."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytes(4)
    link = 4
    for image in pages:
        height, width = image.shape
        w, h = (tile, tile) if tile else (width, strip_rows)
        offsets, lengths = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tile and part.shape != (h, w):
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                raw = part.tobytes()
                raw = zlib.compress(raw, 1) if compression in (DEFLATE, OLD_DEFLATE) else lzw_encode(raw) if compression == LZW else packbits_encode(raw) if compression == PACKBITS else raw
                offsets.append(len(out))
                lengths.append(len(raw))
                out += raw
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1])]
        fields += [(TILE_W, [w]), (TILE_H, [h]), (TILE_AT, offsets), (TILE_LEN, lengths)] if tile else [(STRIP_AT, offsets), (ROWS, [h]), (STRIP_LEN, lengths)]
        fields += [(PREDICTOR, [2])] if predictor == 2 else []
        entries = []
        for tag, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                where = len(out)
                out += packed
                packed = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, 4, len(values)) + packed)
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


# DataFrame operators

PAGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "bits", "sample_format", "compression", "predictor", "photometric")] + [T.StructField("tiled", T.BooleanType()), T.StructField("parts", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])
_BATCH = 4 << 20


def tiff_pages(df: DataFrame, media_col: str = "media", keep: Sequence[str] = (), most_bytes: int = 1 << 28) -> DataFrame:
    """One row per page of the TIFF in media_col, with the columns of keep and those of PAGE.

    A file that cannot be read on gives the pages before that and one row with the error and no page, whatever its bytes are;
    so do null and empty values. A page of more than most_bytes, padding of tiles included, is such an error: memory is
    bounded by it. Pages of a file follow each other, repeated rows give their pages each. Other columns of df are dropped.
    """
    names = list(keep)
    out = T.StructType([*[df.schema[n] for n in names], *PAGE.fields])
    arrow, inner = to_arrow_schema(out), PAGE.names

    def pages(data):
        if not data:
            yield {"error": "no media"}
            return
        try:
            for p in read_tiff(data, most_bytes):
                yield vars(p)
        except TiffError as e:
            yield {"error": str(e)}

    def run(batches):
        for b in batches:
            rows, size = [], 0
            others = list(zip(*(b.column(n).to_pylist() for n in names), strict=True)) if names else [()] * b.num_rows
            for other, media in zip(others, b.column(media_col), strict=True):
                for p in pages(media.as_py()):
                    rows.append([*other, *(p.get(n) for n in inner)])
                    size += 200 + len(p.get("pixels") or b"")
                    if size > _BATCH:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return df.select(*names, media_col).mapInArrow(run, out)


def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


#: Ways to store a payload; its CRC picks one, so that equal payloads give equal files and every decoder is used.
STORES = [
    {"compression": DEFLATE, "predictor": 2},
    {"compression": PACKBITS},
    {"compression": LZW, "predictor": 2, "order": ">"},
    {"compression": DEFLATE, "tile": 64},
    {"compression": PACKBITS, "predictor": 2, "tile": 32},
    {"compression": DEFLATE, "order": ">"},
    {"compression": NONE, "tile": 16},
    {"compression": OLD_DEFLATE, "predictor": 2, "tile": 64, "order": ">"},
]


def store_payload(payload: bytes, width: int = 64, page_rows: int = 1024) -> bytes:
    """A payload (a positive multiple of width bytes) as grey pages of so many samples a row."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return write_tiff([image[i : i + page_rows] for i in range(0, len(image), page_rows)], **STORES[zlib.crc32(payload) % len(STORES)])


def texts_to_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """Each whole text (null: empty) as UTF-8, zero bytes up to a positive multiple of width, as a TIFF: id, n_bytes, media."""
    out = T.StructType([df.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                media = store_payload(raw + bytes(-len(raw) % width or (0 if raw else width)), width)
                rows.append((key, len(raw), media))
                size += len(media)
                if size > _BATCH:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return df.select(id_col, text_col).mapInArrow(run, out)
