"""TIFF: image directories, strips and tiles, PackBits, LZW and deflate, horizontal predictors.

decode_pages() walks the directories of a file of either byte order and yields a page each;
encode() writes grey 8-bit pages in any of the layouts that decode_pages() reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: TIFF 6.0 field types' sizes in bytes, compression numbers and tags (fixed values).
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES = 284, 317, 322, 323, 324, 325


@dataclass
class Page:
    number: int
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray  # (height, width, channels) of 8- or 16-bit samples


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first, code 256 clears, 257 ends; widths grow one code early."""
    table: list[bytes] = []
    out, width, held, bits, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    table, width, prefix = {}, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    table = {bytes((k,)): k for k in range(256)}
    size = 258
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer], size, prefix = size, size + 1, data[k : k + 1]
        if size == 4094:
            put(256)
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
        elif size >= (1 << width) and width < 12:
            width += 1
    if prefix:
        put(table[prefix])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


#: More than any of the compressions can give of a byte.
MOST_RATIO = 4096


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(size, 1))
    raise ValueError(f"compression {compression} is not known")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZES.get(kind, 0) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        if form:
            fields[tag] = list(struct.unpack_from(f"{order}{count}{form}", data, place))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def read_pages(data: bytes) -> Iterator[Page | ValueError]:
    """A page for each image directory, or the error of one that can't be read; goes on as long as the next directory's offset can be read. Ends with an error where the data are no TIFF, are cut off or refer back to a directory."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        yield ValueError("no TIFF header")
        return
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            yield ValueError("directories form a circle")
            return
        seen.add(at)
        number, following = len(seen) - 1, 0
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
            yield _page(data, _directory(data, at, order)[0], order, number)
        except (struct.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, TypeError, zlib.error) as error:
            yield ValueError(f"page {number} can't be read: {error}")
        except ValueError as error:
            yield error
        at = following


def decode_pages(data: bytes) -> Iterator[Page]:
    """A page for each image directory. Raises ValueError for what is no TIFF, is cut off, refers back to a directory, or isn't 8- or 16-bit in chunky order."""
    for page in read_pages(data):
        if isinstance(page, ValueError):
            raise page
        yield page


def _page(data: bytes, fields: dict[int, list[int]], order: str, number: int) -> Page:
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height = fields[WIDTH][0], fields[HEIGHT][0]
    channels, compression, predictor, bits = one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(BITS, 1)
    if bits not in (8, 16) or predictor not in (1, 2) or (one(PLANAR, 1) != 1 and channels > 1):
        raise ValueError("sample layout is not known")
    kind = np.dtype("u1") if bits == 8 else np.dtype(order + "u2")
    tiled = TILES in fields
    across, down = (fields[TILE_WIDTH][0], fields[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    places, sizes = fields[TILES if tiled else STRIPS], fields[TILE_SIZES if tiled else STRIP_SIZES]
    if width and height:
        if across < 1 or down < 1 or channels < 1:
            raise ValueError("strips or tiles have no size")
        if width * height * channels * kind.itemsize > MOST_RATIO * len(data):
            raise ValueError("the page is larger than its file can hold")
        if len(places) < -(-width // across) * -(-height // down):
            raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, channels), kind)
    columns = -(-width // across) if width else 1
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - top)
        want = rows * across * channels * kind.itemsize
        raw = _unpack(data[place : place + size], compression, want)
        if len(raw) < want:
            raise ValueError("a strip or tile is cut off")
        block = np.frombuffer(raw, kind, rows * across * channels).reshape(rows, across, channels)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        part = block[: height - top, : width - left]
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return Page(number, width, height, channels, compression, predictor, tiled, out)


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 1024, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """A little-endian TIFF of grey 8-bit pages (height x width arrays) in strips of `rows`, or tiles (width, height; multiples of 16)."""
    out, links = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width = page.shape
        across, down = tile or (width, rows)
        places, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                part = page[top : top + down, left : left + across]
                if tile:
                    full = np.zeros((down, across), np.uint8)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                raw = part.tobytes()
                body = {NONE: lambda x: x, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, level)}[compression](raw)
                places.append(len(out))
                sizes.append(len(body))
                out += body
                out += b"\0" * (len(out) % 2)
        layout = [(TILE_WIDTH, [across]), (TILE_HEIGHT, [down]), (TILES, places), (TILE_SIZES, sizes)] if tile else [(STRIPS, places), (ROWS_PER_STRIP, [down]), (STRIP_SIZES, sizes)]
        fields = sorted([(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *layout])
        entries = b""
        for tag, values in fields:
            body = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                place = len(out)
                out += body
                body = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, 4, len(values)) + body
        struct.pack_into("<I", out, links, len(out))
        out += struct.pack("<H", len(fields)) + entries
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
