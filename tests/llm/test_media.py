"""The JPEG decoder: both ways of decoding against each other and against block means; colour, subsampling, several scans,
restart intervals and the usual tables of other encoders."""

import time

import numpy as np
import pytest

from spindrift.llm import media

#: The luminance AC table that most encoders use.
_RUNS = [f"{r:x}{n:x}" for r in range(16) for n in range(1, 11)]
_FIRST = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82".split()
USUAL_AC = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + bytes(int(x, 16) for x in [*_FIRST, *sorted(set(_RUNS) - set(_FIRST))])


def blocks_of(plane):
    h, w = plane.shape
    x = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).astype(float) - 128
    return np.rint(media._BASIS @ x @ media._BASIS.T).astype(np.int64).reshape(h // 8, w // 8, 64)[..., media.ZIGZAG]


def part(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def colour_jpeg(planes, factors, interleaved, restart=0):
    """planes: whole minimum coded units of 8-bit samples each; factors (h, v) of each component."""
    h, w = planes[0].shape
    tables = [(media._DC_TABLE, USUAL_AC), (media._DC_TABLE, media._AC_TABLE)]
    which = [0 if i == 0 else 1 for i in range(len(planes))]
    out = b"\xff\xd8" + part(0xDB, bytes([0]) + bytes([1] * 64)) + part(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(factors)))
    for i, (d, a) in enumerate(tables):
        out += part(0xC4, bytes([i]) + d) + part(0xC4, bytes([0x10 | i]) + a)
    coded = [blocks_of(p) for p in planes]
    hmax, vmax = max(a for a, _ in factors), max(b for _, b in factors)
    if restart:
        per = sum(a * b for a, b in factors) if interleaved else 1
        out += part(0xDD, restart.to_bytes(2, "big"))
        restart *= per
    if interleaved:
        rows, own = [], []
        for y in range(h // (8 * vmax)):
            for x in range(w // (8 * hmax)):
                for i, (a, b) in enumerate(factors):
                    rows += [coded[i][y * b + v, x * a + u] for v in range(b) for u in range(a)]
                    own += [i] * (a * b)
        scan = media.entropy_coded(np.array(rows), np.array(own), [tables[t] for t in which], restart)
        out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, which[i] * 17]) for i in range(len(planes))) + bytes([0, 63, 0])) + scan
    else:
        for i in reversed(range(len(planes))):  # the luminance last
            rows = coded[i].reshape(-1, 64)
            out += part(0xDA, bytes([1, i + 1, which[i] * 17, 0, 63, 0])) + media.entropy_coded(rows, np.zeros(len(rows), np.int64), [tables[which[i]]], restart)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interleaved, restart", [(True, 0), (True, 2), (False, 0), (False, 3)])
def test_colour_streams(factors, interleaved, restart, monkeypatch):
    rng = np.random.default_rng(4)
    hmax, vmax = max(a for a, _ in factors), max(b for _, b in factors)
    images = []
    for _ in range(3):
        planes = [rng.integers(0, 256, (48 * b // vmax, 64 * a // hmax)) for a, b in factors]
        images.append((planes, colour_jpeg(planes, factors, interleaved, restart)))
    want = [p[0].reshape(6, 8, 8, 8).mean(axis=(1, 3)) for p, _ in images]
    for lanes in (1, 10_000):  # all in step, or one after the other
        monkeypatch.setattr(media, "LANES", lanes)
        for t, mean in zip(media.decode_thumbnails([d for _, d in images]), want):
            assert (t.width, t.height, t.components) == (64, 48, len(factors))
            assert np.abs(t.pixels.astype(float) - mean).max() <= 1


def test_both_ways_agree(monkeypatch):
    rng = np.random.default_rng(6)
    streams = [media.encode_jpeg(rng.integers(0, 256, rng.integers(1, 90, 2)), quant=int(rng.integers(1, 30)), restart=int(rng.integers(0, 4))) for _ in range(120)]
    for i in range(0, 60, 2):  # damaged ones
        cut = bytearray(streams[i])
        cut[int(rng.integers(300, len(cut)))] ^= int(rng.integers(1, 256))
        streams[i] = bytes(cut) if i % 4 else bytes(cut[: len(cut) * 2 // 3])

    def shown(lanes):
        monkeypatch.setattr(media, "LANES", lanes)
        return [None if isinstance(t, media.JpegError) else (t.width, t.height, t.pixels.tolist()) for t in media.decode_thumbnails([*streams, None, b""])]

    got = shown(1)
    assert got == shown(10_000) and 60 <= sum(x is not None for x in got) < 120


def test_wide_images_and_time():
    flat = np.full((8, 40_000), 77)
    t = media.decode_thumbnail(media.encode_jpeg(flat))
    assert t.pixels.shape == (1, 5000) and set(t.pixels.ravel().tolist()) == {77}
    head = bytearray(media.encode_jpeg(np.full((8, 8), 9)))
    i = head.index(b"\xff\xc0")
    head[i + 5 : i + 9] = b"\xff\xff\xff\xff"  # a header that claims four thousand million pixels
    start = time.process_time()
    with pytest.raises(media.JpegError):
        media.decode_thumbnail(bytes(head))
    assert time.process_time() - start < 10
