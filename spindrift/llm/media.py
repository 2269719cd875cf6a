"""Baseline JPEG in a media column: dimensions, a DC-only luminance thumbnail, and hashes of it.

The markers give tables and frame; the scan is Huffman-decoded in full, since every coefficient must be read to reach the
next block, but only the DC values of the first component are kept: each is eight times the mean of its 8 x 8 block, so
the thumbnail has a pixel a block. Restart markers, subsampling and several scans are followed.

Entropy-coded parts of the same make (an image's restart intervals, and the images of a batch) are decoded in step: each
step reads one symbol of every part, by gathers over arrays. Few or single parts are decoded one after the other.

The tables of this corpus hold no images. encode_jpeg is a small baseline encoder of the same format; the query draws a
picture from each row of embeddings with it, so that the decoder has a whole table of real streams to read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tune_arrow

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Parts from which on decoding in step pays.
LANES = 48
HASH_SIDE = 8


class JpegError(ValueError):
    """The bytes aren't a whole baseline JPEG."""


@dataclass
class Thumbnail:
    width: int
    height: int
    components: int
    pixels: np.ndarray  # a row of blocks a row, 0 to 255


@dataclass
class _Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    last: int = 0


def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Of each 16 bits that a code may begin: its symbol and length; length 0 where none does."""
    table, code, k = [(0, 0)] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(lengths[size - 1]):
            first = code << (16 - size)
            if first + (1 << (16 - size)) > 65536:
                raise JpegError("a Huffman table has too many codes")
            table[first : first + (1 << (16 - size))] = [(symbols[k], size)] * (1 << (16 - size))
            code += 1
            k += 1
        code <<= 1
    return table


_KNOWN: dict[bytes, list[tuple[int, int]]] = {}


def _table(data: bytes) -> list[tuple[int, int]]:
    """Tables are kept, as most files share the usual four."""
    if data not in _KNOWN:
        if len(_KNOWN) > 64:
            _KNOWN.clear()
        _KNOWN[data] = _codes(data[:16], data[16:])
    return _KNOWN[data]


def _scan_dc(data: bytes, blocks: list[tuple[_Component, list | None]], dc: dict, ac: dict, units: int) -> None:
    """Decodes so many units of the blocks; each block's DC value goes to its list, if it has one."""
    data = data.replace(b"\xff\x00", b"\xff")
    total = len(data) * 8
    # A sliding window of the stream: shifting one large number for each symbol would take quadratic time.
    window, held, at = 0, 0, 0
    raw = data + b"\xff" * 16

    def need(n: int) -> None:
        nonlocal window, held, at
        while held < n:
            window = (window << 32) | int.from_bytes(raw[at : at + 4].ljust(4, b"\xff"), "big")
            held += 32
            at += 4
        if (at - held // 8) * 8 > total + 64:
            raise JpegError("the scan ends early")

    plan = [(c, out, dc[c.dc], ac[c.ac]) for c, out in blocks]
    for _ in range(units):
        for c, out, dct, act in plan:
            need(32)
            size, n = dct[(window >> (held - 16)) & 0xFFFF]
            if not n or size > 15:
                raise JpegError("no such Huffman code")
            held -= n
            if size:
                value = (window >> (held - size)) & ((1 << size) - 1)
                held -= size
                c.last += value if value >> (size - 1) else value - (1 << size) + 1
            if out is not None:
                out.append(c.last)
            k = 1
            while k < 64:
                if held < 32:
                    window &= (1 << held) - 1
                    need(32)
                rs, n = act[(window >> (held - 16)) & 0xFFFF]
                if not n:
                    raise JpegError("no such Huffman code")
                size = rs & 15
                held -= n + size
                if size:
                    k += (rs >> 4) + 1
                elif rs == 0xF0:
                    k += 16
                else:
                    break
            window &= (1 << held) - 1
    if at * 8 - held > total + 7:
        raise JpegError("the scan ends early")


@dataclass
class _Part:
    """An entropy-coded part: its bytes, how often which blocks come (component, tables, whether DC values are kept)."""

    data: bytes
    plan: tuple[tuple[int, bytes, bytes, bool], ...]
    units: int
    found: np.ndarray | None = None
    error: str | None = None


@dataclass
class _Image:
    width: int
    height: int
    components: int
    parts: list[_Part]
    luminance: list[_Part]  # in order; of the last scan that holds the first component
    shape: tuple[int, int, int, int]
    grid: tuple[int, int]
    quant: int


def _decode_alone(part: _Part) -> None:
    found: list[int] = []
    known = {n: _Component(1, 1, 0) for n, *_ in part.plan}
    dc = {d: _table(d) for _, d, _, _ in part.plan}
    ac = {a: _table(a) for _, _, a, _ in part.plan}
    blocks = []
    for n, d, a, kept in part.plan:
        known[n].dc, known[n].ac = d, a
        blocks.append((known[n], found if kept else None))
    try:
        _scan_dc(part.data, blocks, dc, ac, part.units)
        part.found = np.array(found, np.int64)
    except JpegError as e:
        part.error = str(e)


_ARRAYS: dict[bytes, np.ndarray] = {}


def _array_table(data: bytes) -> np.ndarray:
    """Of each 16 bits: 256 times the length of the code that begins there, plus its symbol."""
    if data not in _ARRAYS:
        if len(_ARRAYS) > 64:
            _ARRAYS.clear()
        _ARRAYS[data] = np.array([n << 8 | s for s, n in _table(data)], np.int64)
    return _ARRAYS[data]


def _decode_in_step(parts: list[_Part]) -> None:
    """Decodes parts of one plan, a symbol of each at a time."""
    plan = parts[0].plan
    raw = [x.data.replace(b"\xff\x00", b"\xff") + b"\xff" * 16 for x in parts]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    words = np.zeros(len(flat), np.uint64)
    for i in range(8):
        words[: len(flat) - i] |= flat[i:] << np.uint64(56 - 8 * i)
    ends = np.cumsum([len(r) for r in raw]) * 8
    pos = ends - np.array([len(r) for r in raw]) * 8
    limit = ends - 128 + 7
    tables = np.concatenate([_array_table(t) for _, d, a, _ in plan for t in (d, a)])
    names = sorted({n for n, *_ in plan})
    component = np.array([names.index(n) for n, *_ in plan])
    keeps = np.array([k for *_, k in plan])
    units = np.array([x.units for x in parts])
    per_unit = int(keeps.sum())
    out = np.zeros(int(units.sum()) * per_unit, np.int64)
    at = (np.cumsum(units) - units) * per_unit
    first = at.copy()
    last = np.zeros((len(parts), len(names)), np.int64)
    lane, k, block, unit = np.arange(len(parts)), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    while len(lane):
        here = pos[lane]
        word = words[here >> 3] << (here & 7).astype(np.uint64)
        dc = k == 0
        coded = tables[(block * 2 + ~dc) * 65536 + (word >> np.uint64(48)).astype(np.int64)]
        n, symbol = coded >> 8, coded & 255
        size = np.where(dc, symbol, symbol & 15)
        bad = (n == 0) | dc & (symbol > 15)
        if dc.any():
            r = np.flatnonzero(dc & ~bad)
            own, z = lane[r], size[r]
            value = ((word[r] << n[r].astype(np.uint64)) >> np.uint64(1) >> (63 - z).astype(np.uint64)).astype(np.int64)
            value = np.where(z == 0, 0, np.where(value >> np.maximum(z - 1, 0) > 0, value, value - (1 << z) + 1))
            c = component[block[r]]
            last[own, c] += value
            kept = keeps[block[r]]
            out[at[own[kept]]] = last[own[kept], c[kept]]
            at[own[kept]] += 1
        pos[lane] = here + n + size
        step = np.where(dc, 1, np.where(size > 0, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, 64)))
        k = k + step
        over = k >= 64
        k[over] = 0
        block = block + over
        wrap = block == len(plan)
        block[wrap] = 0
        unit = unit + wrap
        early = pos[lane] > limit[lane]
        for i in np.flatnonzero(bad | early).tolist():
            parts[lane[i]].error = "no such Huffman code" if bad[i] else "the scan ends early"
        go = ~(bad | early | (unit == units[lane]))
        if not go.all():
            lane, k, block, unit = lane[go], k[go], block[go], unit[go]
    for i, x in enumerate(parts):
        if x.error is None:
            x.found = out[first[i] : at[i]]


def _decode_parts(parts: list[_Part]) -> None:
    """Decodes parts of any plans: those of one plan together, by length, so that they end at about the same step."""
    groups: dict[tuple, list[_Part]] = {}
    for x in parts:
        groups.setdefault(x.plan, []).append(x)
    for own in groups.values():
        own.sort(key=lambda x: len(x.data))
        for s in range(0, len(own), 1024):
            some = own[s : s + 1024]
            # A part that is far longer than the rest would go on alone.
            typical = len(some[len(some) // 2].data) * 4
            alike = [x for x in some if len(x.data) <= typical]
            if len(alike) >= LANES:
                _decode_in_step(alike)
            for x in some:
                if x.found is None and x.error is None:
                    _decode_alone(x)


def decode_thumbnails(found: list[bytes | None]) -> list[Thumbnail | JpegError]:
    """The thumbnail of each, or why there is none: only whole baseline JPEGs of 8-bit samples have one."""
    images: list[_Image | JpegError] = []
    for data in found:
        try:
            if data is None:
                raise JpegError("no bytes")
            images.append(_parse(data))
        except JpegError as e:
            images.append(e)
    _decode_parts([p for x in images if isinstance(x, _Image) for p in x.parts])
    out: list[Thumbnail | JpegError] = []
    for x in images:
        if isinstance(x, JpegError):
            out.append(x)
        elif error := next((p.error for p in x.parts if p.error), None):
            out.append(JpegError(error))
        else:
            down, across, v, h = x.shape
            y = np.concatenate([p.found for p in x.luminance]).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            pixels = np.clip(np.rint(y[: x.grid[1], : x.grid[0]] * x.quant / 8 + 128), 0, 255).astype(np.uint8)
            out.append(Thumbnail(x.width, x.height, x.components, pixels))
    return out


def decode_thumbnail(data: bytes) -> Thumbnail:
    """Raises JpegError for anything but a whole baseline JPEG of 8-bit samples."""
    out = decode_thumbnails([data])[0]
    if isinstance(out, JpegError):
        raise out
    return out


def _parse(data: bytes) -> _Image:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    quants: dict[int, int] = {}
    dc: dict[int, bytes] = {}
    ac: dict[int, bytes] = {}
    every: list[_Part] = []
    frame, components, order, restart = None, {}, [], 0
    luminance: list[_Part] | None = None
    shape, grid = (0, 0, 0, 0), (0, 0)
    at = 2
    try:
        while True:
            if data[at] != 0xFF:
                raise JpegError("a marker is missing")
            while data[at] == 0xFF:
                at += 1
            marker = data[at]
            at += 1
            if marker == 0xD9:
                break
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                continue
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > len(data):
                raise JpegError("a segment ends early")
            body = data[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quants[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")  # only the DC divisor is needed
                    i += 65 + 64 * wide
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    (ac if body[i] >> 4 else dc)[body[i] & 15] = bytes(body[i + 1 : i + 17 + n])
                    i += 17 + n
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise JpegError("samples aren't of 8 bits")
                height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                if not height or not width:
                    raise JpegError("such dimensions can't be")
                frame = (width, height)
                for k in range(body[5]):
                    name, hv, q = body[6 + 3 * k : 9 + 3 * k]
                    components[name] = _Component(hv >> 4, hv & 15, q)
                    order.append(name)
                if not order or any(not c.h or not c.v for c in components.values()):
                    raise JpegError("a component has no samples")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise JpegError("the frame isn't baseline")
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if frame is None:
                    raise JpegError("a scan comes before the frame")
                names = [body[1 + 2 * k] for k in range(body[0])]
                for k, name in enumerate(names):
                    components[name].dc, components[name].ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                end = at
                while True:  # the entropy-coded part goes on to a marker that isn't a restart
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise JpegError("the scan ends early")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                parts, i = [], at
                s = at
                while (i := data.find(b"\xff", i, end)) >= 0:
                    if 0xD0 <= data[i + 1] <= 0xD7:
                        parts.append(data[s:i])
                        s = i + 2
                    i += 2
                parts.append(data[s:end])
                at = end
                hmax, vmax = max(c.h for c in components.values()), max(c.v for c in components.values())
                first = components[order[0]]
                if len(names) == 1:
                    c = components[names[0]]
                    across, down = -(-(-(-frame[0] * c.h // hmax)) // 8), -(-(-(-frame[1] * c.v // vmax)) // 8)
                    blocks = [names[0]]
                else:
                    across, down = -(-frame[0] // (8 * hmax)), -(-frame[1] // (8 * vmax))
                    blocks = [n for n in names for _ in range(components[n].h * components[n].v)]
                plan = tuple((order.index(n), dc[components[n].dc], ac[components[n].ac], n == order[0]) for n in blocks)
                for _, d, a, _ in plan:
                    _table(d), _table(a)
                units = across * down
                each = restart or units
                if len(parts) < -(-units // each):
                    raise JpegError("the scan ends early")
                own = [_Part(parts[k], plan, min(each, units - k * each)) for k in range(-(-units // each))]
                every += own
                if order[0] in names:
                    h, v = (1, 1) if len(names) == 1 else (first.h, first.v)
                    luminance, shape = own, (down, across, v, h)
                    grid = (-(-(-(-frame[0] * first.h // hmax)) // 8), -(-(-(-frame[1] * first.v // vmax)) // 8))
    except (IndexError, KeyError, ValueError) as e:
        raise e if isinstance(e, JpegError) else JpegError("the stream is damaged") from e
    if frame is None or luminance is None:
        raise JpegError("no scan of the first component")
    q = quants.get(components[order[0]].quant)
    if q is None:
        raise JpegError("a quantization table is missing")
    return _Image(frame[0], frame[1], len(order), every, luminance, shape, grid, q)


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than their mean; signed."""
    rows = np.minimum(np.arange(HASH_SIDE) * pixels.shape[0] // HASH_SIDE, pixels.shape[0] - 1)
    cols = np.minimum(np.arange(HASH_SIDE) * pixels.shape[1] // HASH_SIDE, pixels.shape[1] - 1)
    small = np.add.reduceat(np.add.reduceat(pixels.astype(float), rows, axis=0), cols, axis=1)
    count = np.add.reduceat(np.add.reduceat(np.ones(pixels.shape), rows, axis=0), cols, axis=1)
    small /= count
    return int(np.packbits(small > small.mean()).view(">i8")[0])


#: The usual luminance tables: number of codes by length, then symbols.
_DC_TABLE = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))


def _all_ac() -> bytes:
    """A complete AC table made for this encoder: short runs and small sizes get the short codes."""
    symbols = [0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x12, 0x21, 0xF0]
    symbols += [s for s in (r << 4 | n for n in range(1, 11) for r in range(16)) if s not in symbols]
    lengths = bytes([0, 1, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 2, len(symbols) - 19])
    return lengths + bytes(symbols)


_AC_TABLE = _all_ac()
_BASIS = np.array([[(0.5 if k else 0.125**0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def _encoder(table: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            out[table[k]] = (code, size)
            code += 1
            k += 1
        code <<= 1
    return out


_CODES: dict[bytes, np.ndarray] = {}


def _code_array(table: bytes) -> np.ndarray:
    """Of each symbol its code and length; length 0 where it has none."""
    if table not in _CODES:
        _CODES[table] = np.zeros((256, 2), np.int64)
        for symbol, x in _encoder(table).items():
            _CODES[table][symbol] = x
    return _CODES[table]


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(float))[1].astype(np.int64)


def entropy_coded(coded: np.ndarray, component: np.ndarray, tables: list[tuple[bytes, bytes]], restart: int = 0) -> bytes:
    """The scan of blocks in their order, a row of 64 coefficients each in zigzag order, with the tables of the component
    that each belongs to; a restart marker after so many blocks."""
    out = b""
    for turn, s in enumerate(range(0, len(coded), restart or len(coded))):
        x, own = coded[s : s + (restart or len(coded))], component[s : s + (restart or len(coded))]
        diff = x[:, 0].copy()
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            diff[at[1:]] -= x[at[:-1], 0]
        b, k = np.nonzero(x[:, 1:])
        k = k + 1
        before = np.where(np.diff(b, prepend=-1) > 0, 0, np.concatenate([[0], k[:-1]]))[: len(k)]
        run = k - before - 1
        value = x[b, k]
        long = np.repeat(np.arange(len(b)), run // 16)
        ends = np.flatnonzero(x[:, 63] == 0)
        # Of each symbol: place, block, whether it is of a DC value, symbol, value.
        n = len(x)
        place = np.concatenate([np.arange(n) * 200, b[long] * 200 + k[long] * 2, b * 200 + k * 2 + 1, ends * 200 + 199])
        block = np.concatenate([np.arange(n), b[long], b, ends])
        sizes = [_bit_length(diff), np.zeros(len(long), np.int64), _bit_length(value), np.zeros(len(ends), np.int64)]
        symbol = np.concatenate([sizes[0], np.full(len(long), 0xF0), (run % 16) << 4 | sizes[2], np.zeros(len(ends), np.int64)])
        size, signed = np.concatenate(sizes), np.concatenate([diff, np.zeros(len(long), np.int64), value, np.zeros(len(ends), np.int64)])
        is_dc = np.arange(len(place)) < n
        codes = np.stack([np.stack([_code_array(d), _code_array(a)]) for d, a in tables])[own[block], np.where(is_dc, 0, 1), symbol]
        bits = codes[:, 0] << size | np.where(signed > 0, signed, signed + (1 << size) - 1) & ((1 << size) - 1)
        order = np.argsort(place, kind="stable")
        length, bits = (codes[:, 1] + size)[order], bits[order]
        stop = np.cumsum(length)
        shift = np.repeat(stop, length) - np.arange(stop[-1]) - 1
        stream = np.repeat(bits, length) >> shift & 1
        stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.int64)]).astype(np.uint8)
        out += (bytes([0xFF, 0xD0 + (turn - 1) % 8]) if turn else b"") + np.packbits(stream).tobytes().replace(b"\xff", b"\xff\x00")
    return out


def encode_jpeg(pixels: np.ndarray, quant: int = 4, restart: int = 0) -> bytes:
    """A greyscale baseline JPEG of 8-bit pixels, with one divisor for all coefficients."""
    h, w = pixels.shape
    padded = np.pad(pixels.astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coded = np.rint(_BASIS @ blocks @ _BASIS.T / quant).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
    scan = entropy_coded(coded, np.zeros(len(coded), np.int64), [(_DC_TABLE, _AC_TABLE)], restart)
    part = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    return b"".join(
        [
            b"\xff\xd8",
            part(0xDB, bytes([0]) + bytes([quant] * 64)),
            part(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            part(0xC4, bytes([0x00]) + _DC_TABLE),
            part(0xC4, bytes([0x10]) + _AC_TABLE),
            part(0xDD, restart.to_bytes(2, "big")) if restart else b"",
            part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        ]
    )


SCHEMA = "width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, average_hash long, thumbnail_md5 string, error string"


def describe_media(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """The key and, for each row's bytes: dimensions, components, the thumbnail with a byte a pixel, its average hash and
    md5; or an error and nulls.

    Null bytes have an error too, as have empty ones, other formats, and streams that are cut short or damaged. Each row
    is described by itself: repeated rows and null keys stay. An image may have any dimensions that a header can state. An empty table gives an empty result; other columns are
    ignored."""
    kind = media.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in SCHEMA.split(", ")]]
    types = [pa.int32()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in decode_thumbnails(batch.column(1).to_pylist()):
                if isinstance(t, JpegError):
                    rows.append((None,) * 8 + (str(t),))
                else:
                    small = t.pixels.tobytes()
                    rows.append((t.width, t.height, t.components, t.pixels.shape[1], t.pixels.shape[0], small, average_hash(t.pixels), hashlib.md5(small).hexdigest(), None))
            columns = zip(*rows) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    tune_arrow(media.sparkSession)
    return media.select(F.col(key), F.col(column).cast("binary").alias("media")).mapInArrow(describe, f"`{key}` {kind}, {SCHEMA}")


def picture(vector: np.ndarray) -> np.ndarray:
    """A greyscale picture of a vector: 8 x 8 cells of 4 to 8 pixels, by the vector's values, with a slope across."""
    side = 32 + 8 * (int(abs(vector[0]) * 1000) % 5)
    cells = np.resize(vector, 64).reshape(8, 8)
    low, high = cells.min(), cells.max()
    cells = (cells - low) / (high - low or 1) * 200 + 20
    at = np.arange(side) * 8 // side
    return np.clip(cells[np.ix_(at, at)] + np.linspace(0, 30, side)[None, :], 0, 255)


def pictures(embeddings: DataFrame) -> DataFrame:
    """(media_id, media): a JPEG of each row's vector; null where the vector is null, empty or not finite."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.array([np.nan if y is None else y for y in v.as_py() or []], float)
                out.append(encode_jpeg(picture(x)) if len(x) and np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["media_id", "media"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(draw, "media_id long, media binary")


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(pictures(read_table(spark, sf_dir, "embeddings")))
