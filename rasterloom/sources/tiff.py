"""A small TIFF codec: strips or tiles of numbers, uncompressed, Deflate or LZW, with GeoTIFF placement and nodata.

Reading takes any of these from either byte order, with offsets of 32 or 64 bits; writing makes
little-endian strips, LZW by default, or lays out a file of uncompressed tiles that many tasks can fill.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# TIFF 6.0 and GeoTIFF tags and field sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KIND = {1: "u", 2: "i", 3: "f"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass
class Raster:
    """data is bands x rows x cols; affine is a, b, c, d, e, f."""

    data: np.ndarray
    affine: tuple[float, ...]
    crs: str | None = None
    nodata: float | None = None


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit, 9 to 12 bits, one code early; 256 clears, 257 ends."""
    table: list[bytes] = []
    out, bits, n, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> (n - width) & (1 << width) - 1
            n -= width
            bits &= (1 << n) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last:
                table.append(last + now[:1])
            last = now
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, n = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
        bits &= (1 << n) - 1

    table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    put(256, width)
    held = b""
    for k in range(len(data)):
        now = held + data[k : k + 1]
        if now in table:
            held = now
            continue
        put(table[held], width)
        table[now], size = size, size + 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size == 4094:
            put(256, width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        held = data[k : k + 1]
    if held:
        put(table[held], width)
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if n:
        put(0, 8 - n)
    return bytes(out)


class Ranged:
    """A file read by ranges: data[a:b] fetches these bytes and no others."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file

    def __getitem__(self, part: slice) -> bytes:
        self.file.seek(part.start or 0)
        return self.file.read(part.stop - (part.start or 0))


def tags(data: bytes | Ranged) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's fields."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = struct.unpack(order + "H", data[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    # Version 43 has offsets and counts of 64 bits.
    word, wide, entry, start = ("I", 4, 12, 4) if version == 42 else ("Q", 8, 20, 8)
    (at,) = struct.unpack(order + word, data[start : start + wide])
    many = 2 if version == 42 else 8
    (count,) = struct.unpack(order + ("H" if version == 42 else "Q"), data[at : at + many])
    listed = data[at + many : at + many + entry * count]
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HH" + word, listed, entry * k)
        if kind not in FIELD:
            continue
        form = order + (f"{n}s" if kind == 2 else FIELD[kind] * n)
        size, place = struct.calcsize(form), at + many + entry * (k + 1) - wide
        if size > wide:
            (place,) = struct.unpack_from(order + word, listed, entry * (k + 1) - wide)
        out[tag] = struct.unpack(form, data[place : place + size])
    return order, out


def read(data: bytes | Ranged, bands: list[int] | None = None, rows: tuple[int, int] | None = None) -> Raster:
    """A raster, or the named bands (from 0) and rows (first, end) of it; strips and tiles without any of these are not read."""
    order, t = tags(data)
    w, h, n = t[WIDTH][0], t[LENGTH][0], t.get(SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{KIND[t.get(SAMPLE_FORMAT, (1,))[0]]}{t[BITS][0] // 8}")
    apart = t.get(PLANAR, (1,))[0] == 2 or n == 1
    tiled = TILE_AT in t
    cw, ch = (t[TILE_WIDTH][0], t[TILE_LENGTH][0]) if tiled else (w, min(h, t.get(ROWS_PER_STRIP, (h,))[0]))
    at, sizes = (t[TILE_AT], t[TILE_BYTES]) if tiled else (t[STRIP_AT], t[STRIP_BYTES])
    across, down = -(-w // cw), -(-h // ch)
    wanted = list(range(n)) if bands is None else bands
    top, low = rows or (0, h)
    empty = nodata_of(t)
    out = np.full((len(wanted), low - top, w), 0 if empty is None or 0 not in sizes else empty, kind.newbyteorder("="))
    for k in range(len(at)):
        plane, cell = divmod(k, across * down)
        if apart and n > 1 and plane not in wanted:
            continue
        r, c = cell // across * ch, cell % across * cw
        if r + ch <= top or r >= low or not sizes[k]:  # a block of no bytes was never written
            continue
        raw = data[at[k] : at[k] + sizes[k]]
        method = t.get(COMPRESSION, (1,))[0]
        raw = raw if method == NONE else lzw_decode(raw) if method == LZW else zlib.decompress(raw) if method in (DEFLATE, OLD_DEFLATE) else None
        if raw is None:
            raise ValueError(f"compression {method} is not read")
        held = ch if tiled else min(ch, h - r)
        block = np.frombuffer(raw, kind, held * cw * (1 if apart else n)).reshape(held, cw, -1)
        if t.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[max(0, top - r) : min(h, low) - r, : w - c]
        r = max(r, top) - top
        for i, b in enumerate(wanted):
            if not apart:
                out[i, r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, b]
            elif plane == b:
                out[i, r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, 0]
    return Raster(out, affine_of(t), crs_of(t), nodata_of(t))


def affine_of(t: dict[int, tuple]) -> tuple[float, ...]:
    if TRANSFORM in t:
        m = t[TRANSFORM]
        return (m[0], m[1], m[3], m[4], m[5], m[7])
    if PIXEL_SCALE in t and TIEPOINT in t:
        (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIEPOINT]
        return (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def crs_of(t: dict[int, tuple]) -> str | None:
    keys = t.get(GEO_KEYS, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    code = found.get(3072, found.get(2048))
    return f"EPSG:{code}" if code else None


def nodata_of(t: dict[int, tuple]) -> float | None:
    if NODATA not in t:
        return None
    text = t[NODATA][0].split(b"\0")[0].strip()
    return float(text) if text else None


def tiled_head(bands: int, rows: int, cols: int, size: int, dtype: str, affine: tuple[float, ...], crs: str | None, nodata: float | None, present: np.ndarray | None = None) -> tuple[bytes, int]:
    """Header and directory of a file of uncompressed tiles, a plane a band, and where its first tile starts: tile k starts k tiles' bytes after that.

    Neither depends on which tiles are present (all, if None); absent ones get no bytes.  Offsets are of 64 bits where the file is larger than 4 GB.
    """
    kind = np.dtype(dtype)
    n = bands * -(-rows // size) * -(-cols // size)
    block = size * size * kind.itemsize
    big = n * (block + 16) + 65536 >= 1 << 32
    word, wide, long = ("Q", 8, 16) if big else ("I", 4, 4)
    a, b, c, d, e, f = affine
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (cols,)), (LENGTH, 4, (rows,)), (BITS, 3, (kind.itemsize * 8,) * bands), (COMPRESSION, 3, (NONE,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (bands,)), (PLANAR, 3, (2 if bands > 1 else 1,)),
        (TILE_WIDTH, 4, (size,)), (TILE_LENGTH, 4, (size,)), (TILE_AT, long, (0,) * n), (TILE_BYTES, long, (0,) * n), (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands),
        (TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    fields += [(GEO_KEYS, 3, _geo_keys(crs))] if _geo_keys(crs) else []
    fields += [(NODATA, 2, (repr(float(nodata)).encode() + b"\0",))] if nodata is not None else []
    fields.sort(key=lambda x: x[0])
    packed = {tag: v[0] if k == 2 else struct.pack("<" + FIELD[k] * len(v), *v) for tag, k, v in fields}
    count, entry, start = ("Q", 20, 16) if big else ("H", 12, 8)
    at = start + struct.calcsize(count) + entry * len(fields) + wide
    places = {}
    for tag, raw in packed.items():
        if len(raw) > wide:
            places[tag], at = at, at + -(-len(raw) // 8) * 8
    first = -(-at // 4096) * 4096
    held = np.ones(n, bool) if present is None else present
    for tag, x in ((TILE_AT, first + block * np.arange(n, dtype=np.int64)), (TILE_BYTES, np.full(n, block))):
        packed[tag] = np.where(held, x, 0).astype("<u8" if big else "<u4").tobytes()
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) if big else struct.pack("<2sHI", b"II", 42, start)) + struct.pack("<" + count, len(fields))
    for tag, k, v in fields:
        raw = packed[tag]
        out += struct.pack("<HH" + word, tag, k, len(v[0]) if k == 2 else len(v)) + (struct.pack("<" + word, places[tag]) if tag in places else raw.ljust(wide, b"\0"))
    out += bytes(wide)
    for tag in places:
        out += packed[tag].ljust(-(-len(packed[tag]) // 8) * 8, b"\0")
    return bytes(out.ljust(first, b"\0")), first


def _geo_keys(crs: str | None) -> tuple[int, ...]:
    if not crs or not crs.upper().startswith("EPSG:"):
        return ()
    code = int(crs[5:])
    flat = 4000 <= code < 5000
    return (1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, code)


def write(raster: Raster, compression: int = LZW, rows_per_strip: int = 64) -> bytes:
    """Little-endian strips, a plane a band."""
    data = np.atleast_3d(raster.data) if raster.data.ndim == 3 else raster.data[None]
    if raster.data.ndim not in (2, 3):
        raise ValueError("a raster has two or three dimensions")
    n, h, w = data.shape
    data = np.ascontiguousarray(data, data.dtype.newbyteorder("<"))
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression]
    strips = [pack(data[b, r : r + rows_per_strip].tobytes()) for b in range(n) for r in range(0, h, rows_per_strip)]
    a, b, c, d, e, f = raster.affine
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (w,)), (LENGTH, 4, (h,)), (BITS, 3, (data.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (1,)),
        (STRIP_AT, 4, (0,) * len(strips)), (SAMPLES, 3, (n,)), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (2 if n > 1 else 1,)), (SAMPLE_FORMAT, 3, (kind,) * n), (TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if _geo_keys(raster.crs):
        fields.append((GEO_KEYS, 3, _geo_keys(raster.crs)))
    if raster.nodata is not None:
        fields.append((NODATA, 2, (repr(float(raster.nodata)).encode() + b"\0",)))
    fields.sort()
    head = 8 + 2 + 12 * len(fields) + 4
    sizes = [len(v[0]) if k == 2 else struct.calcsize("<" + FIELD[k] * len(v)) for _, k, v in fields]
    extra_at, at = [], head
    for s in sizes:
        extra_at.append(at)
        at += (s + 1) // 2 * 2 if s > 4 else 0
    places = tuple(at + sum(map(len, strips[:k])) for k in range(len(strips))) if len(strips) < 2 else tuple(int(x) for x in at + np.concatenate([[0], np.cumsum([len(s) for s in strips[:-1]])]))
    out, extra = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(fields))), bytearray()
    for (tag, k, v), s, x in zip(fields, sizes, extra_at):
        v = places if tag == STRIP_AT else v
        raw = v[0] if k == 2 else struct.pack("<" + FIELD[k] * len(v), *v)
        out += struct.pack("<HHI", tag, k, len(v[0]) if k == 2 else len(v))
        out += struct.pack("<I", x) if s > 4 else raw.ljust(4, b"\0")
        extra += raw.ljust((s + 1) // 2 * 2, b"\0") if s > 4 else b""
    return bytes(out + b"\0\0\0\0" + extra + b"".join(strips))
