"""AVI motion-JPEG: index parsing, intra decoding and shot detection (operator 2).

``encode_avi`` stores bytes as grey pictures: each byte is the level of one
8 x 8 block, so a decoder gets it back from the pixels without loss (only the
DC coefficient is used, with quantiser 8). ``parse_avi`` follows the RIFF lists to
the stream header and the idx1 index. ``decode_frames`` decodes baseline
JPEG frames (of colour ones the luminance), all frames with the same headers in lockstep: one step reads the
next Huffman symbol of every frame. ``find_shots`` cuts where the histogram difference
of neighbouring frames exceeds the mean and some deviations of the differences around.

Null texts count as empty: one frame of blanks. Equal texts give equal media.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm import batches

WIDTH, HEIGHT, FPS = 16, 12, 25  # blocks, blocks, frames a second
FRAME = WIDTH * HEIGHT
QUANT = 8
#: Payload bytes that are encoded and decoded at one time.
AT_ONCE = 1 << 20
#: Histogram bins, frames on either side, deviations and least share of blocks of a cut.
BINS, AROUND, DEVIATIONS, LEAST = 16, 12, 2.0, 0.25

# Fixed value: order of the 64 coefficients in a JPEG block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Codes of 2..9 bits for the categories of a DC difference, commonest in text first.
DC_LENGTHS = (0, 1, 3, 3, 0, 0, 0, 0, 2)
DC_SYMBOLS = (6, 5, 7, 4, 3, 2, 1, 0, 8)
AC_LENGTHS, AC_SYMBOLS = (1,), (0,)  # only "end of block"
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_body(kind: int, lengths: tuple, symbols: tuple) -> bytes:
    return bytes([kind, *lengths, *[0] * (16 - len(lengths)), *symbols])


def codes(lengths, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a canonical table."""
    out, code, at = [], 0, 0
    for bits, count in enumerate(lengths, 1):
        for symbol in symbols[at: at + count]:
            out.append((symbol, code, bits))
            code += 1
        at += count
        code <<= 1
    return out


def jpeg_head(width: int = WIDTH * 8, height: int = HEIGHT * 8) -> bytes:
    return (b"\xff\xd8" + segment(0xDB, bytes([0] + [QUANT] * 64))
            + segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
            + segment(0xC4, huffman_body(0x00, DC_LENGTHS, DC_SYMBOLS)) + segment(0xC4, huffman_body(0x10, AC_LENGTHS, AC_SYMBOLS))
            + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])))


def difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and code word of "DC difference, end of block" for differences -255..255."""
    table = {s: (c, n) for s, c, n in codes(DC_LENGTHS, DC_SYMBOLS)}
    (_, end, end_bits), = codes(AC_LENGTHS, AC_SYMBOLS)
    words, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        words[d + 255] = (((code << size) | extra) << end_bits) | end
        bits[d + 255] = n + size + end_bits
    return bits, words


CODE_BITS, CODE_WORDS = difference_codes()
HEAD, TAIL = jpeg_head(), b"\xff\xd9"


def scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each row of ``samples`` (frames x blocks, uint8)."""
    levels = samples.astype(np.int16) - 128
    diffs = np.diff(levels, axis=1, prepend=0).astype(np.int64) + 255
    bits, words = CODE_BITS[diffs], CODE_WORDS[diffs]
    ends = np.cumsum(bits, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = (ends - bits + 8 * starts[:-1, None]).ravel()
    # each code word, placed within the four bytes from its first on
    placed = words.ravel() << (32 - bits.ravel() - (at & 7)).astype(np.uint64)
    first, total = at >> 3, int(starts[-1]) + 4
    packed = np.zeros(total, np.int64)
    for k in range(4):
        part = ((placed >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        packed += np.bincount(first + k, weights=part, minlength=total).astype(np.int64)
    spare = (-ends[:, -1]) % 8
    packed[starts[1:] - 1] |= (1 << spare) - 1  # a scan ends in ones
    whole = packed[: starts[-1]].astype(np.uint8).tobytes()
    return [whole[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], width: int = WIDTH * 8, height: int = HEIGHT * 8, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames, with its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    bodies = [chunk(b"00dc", f) for f in frames]
    index, at = np.zeros((len(frames), 4), "<u4"), 4
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10  # every frame is a key frame
    sizes = np.array([len(b) for b in bodies], np.int64)
    index[:, 2] = at + np.cumsum(sizes) - sizes
    index[:, 3] = [len(f) for f in frames]
    movie = chunk(b"LIST", b"movi" + b"".join(bodies))
    return chunk(b"RIFF", b"AVI " + lists + movie + chunk(b"idx1", index.tobytes()))


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload (lengths are multiples of the frame)."""
    counts = [len(p) // FRAME for p in payloads]
    coded = scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    frames, out, at = [HEAD + s + TAIL for s in coded], [], 0
    for n in counts:
        out.append(avi(frames[at: at + n]))
        at += n
    return out


class Movie(NamedTuple):
    frame_s: float
    frames: list[bytes]


def chunks(data: bytes, at: int, end: int):
    """(name, start, end) of the chunks in a list."""
    while at + 8 <= end:
        name, size = data[at: at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> Movie | None:
    """Frames of the first video stream by the idx1 index; None if it is no AVI file.

    Index offsets count from the "movi" name, or from the file's start in some
    files: the first entry tells which. Without an index the frames are those in "movi".
    """
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    frame_s, movie, index, stream, number = 0.0, None, b"", None, 0
    lists = [(12, len(data))]
    while lists:
        at, end = lists.pop(0)
        for name, a, b in chunks(data, at, end):
            if name == b"LIST" and data[a: a + 4] == b"movi":
                movie = (a, b)
            elif name == b"LIST":
                lists.append((a + 4, b))
            elif name == b"avih" and b - a >= 4:
                frame_s = struct.unpack_from("<I", data, a)[0] / 1e6
            elif name == b"strh" and b - a >= 28:
                if stream is None and data[a: a + 4] == b"vids":
                    stream = number
                    scale, rate = struct.unpack_from("<II", data, a + 20)
                    frame_s = scale / rate if scale and rate else frame_s
                number += 1
            elif name == b"idx1":
                index = data[a: b - (b - a) % 16]
    if movie is None or stream is None:
        return None
    names = {b"%02ddc" % stream, b"%02ddb" % stream}
    if not index:
        return Movie(frame_s, [data[a:b] for name, a, b in chunks(data, movie[0] + 4, movie[1]) if name in names])
    entries = np.frombuffer(index, "<u4").reshape(-1, 4)
    base = movie[0] if data[movie[0] + int(entries[0, 2]):][:4] == index[:4] else 0
    wanted = np.isin(entries[:, 0], [struct.unpack("<I", n)[0] for n in names])
    spots = (entries[wanted, 2].astype(np.int64) + base + 8).tolist()
    return Movie(frame_s, [data[a: a + n] for a, n in zip(spots, entries[wanted, 3].tolist())])


class BadFrame(ValueError):
    """A frame that cannot be decoded: no baseline picture, or cut in its head."""


class Tables(NamedTuple):
    width: int
    height: int
    quant: np.ndarray  # of the first component, in zigzag order
    parts: tuple[tuple[int, np.ndarray, np.ndarray], ...]  # (component, dc, ac) of each block of a unit; tables by the next 16 bits: bits * 256 + symbol
    shape: tuple[int, int]  # blocks of the first component in a unit, across and down
    interval: int  # units between restarts, 0 for none

    @property
    def units(self) -> tuple[int, int]:
        """Units across and down."""
        return -(-self.width // (8 * self.shape[0])), -(-self.height // (8 * self.shape[1]))


def lookup(lengths, symbols) -> np.ndarray:
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in codes(lengths, symbols):
        table[code << (16 - bits): (code + 1) << (16 - bits)] = bits * 256 + symbol
    return table


# Lengths and symbols of the usual Huffman tables, which AVI frames may leave out (DC and AC of luminance, then of chrominance).
USUAL = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x10: ("0002010303020403050504040000017d",
           "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
           "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
           "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x11: ("00020102040403040705040400010277",
           "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
           "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
           "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
}


@functools.cache
def usual(number: int) -> np.ndarray:
    return lookup(*map(bytes.fromhex, USUAL[number]))


def read_head(frame: bytes) -> tuple[int, Tables]:
    """Where the scan begins, and what is needed to decode it: baseline pictures of 8 bits, grey or in colour in one scan."""
    try:
        return _read_head(frame)
    except (struct.error, IndexError, KeyError) as error:
        raise BadFrame("the head is cut or lacks a table") from error


def _read_head(frame: bytes) -> tuple[int, Tables]:
    at, quants, tables, size, components, interval = 2, {}, {}, None, {}, 0
    while True:
        marker, length = struct.unpack_from(">HH", frame, at)
        body = frame[at + 4: at + 2 + length]
        if len(body) < length - 2 or length < 2:
            raise BadFrame("the head is cut")
        at += 2 + length
        if marker == 0xFFDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1: 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide:]
        elif marker == 0xFFC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = lookup(body[1:17], body[17: 17 + count])
                body = body[17 + count:]
        elif marker == 0xFFC0:
            bits, height, width, parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not width or not height:
                raise BadFrame("only pictures of 8 bits and some size are decoded")
            size = (width, height)
            components = {body[6 + 3 * i]: (i, body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)}
        elif marker == 0xFFDD:
            interval, = struct.unpack(">H", body[:2])
        elif marker == 0xFFDA:
            if size is None or body[0] != len(components):
                raise BadFrame("no baseline frame in one scan")
            found = [(components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            (_, across, down, quant), _ = found[0]
            if any(h > across or v > down for (_, h, v, _), _ in found):
                raise BadFrame("the first component is not the finest")
            if len(found) == 1:
                across = down = 1  # a single component comes block by block
            blocks = []
            for (i, h, v, _), chosen in found:
                pair = [tables[n] if n in tables else usual(n) for n in (chosen >> 4, 0x10 | chosen & 15)]
                blocks += [(i - found[0][0][0], *pair)] * (h * v if len(found) > 1 else 1)
            return at, Tables(*size, quants[quant], tuple(blocks), (across, down), interval)
        elif marker >> 8 != 0xFF or 0xFFC1 <= marker <= 0xFFCF:
            raise BadFrame("no baseline frame")


def scan_of(frame: bytes, start: int) -> bytes:
    """Entropy-coded data of a frame, up to its end marker or, without one, its end."""
    end = frame.rfind(b"\xff\xd9")
    return frame[start: end if end >= start else len(frame)]


def coefficients(scan: list[bytes], tables: Tables, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients of the first component, whether data was broken) of many scans at once.

    Coefficients are scans x blocks x 64, blocks in the order of the units and coefficients in zigzag order. ``counts`` are the
    units of each scan (default: the whole picture's).
    """
    data = [s.replace(b"\xff\x00", b"\xff") for s in scan]
    buffer = np.frombuffer(b"".join(data) + b"\xff" * 8, np.uint8).astype(np.uint64)
    windows = np.zeros(len(buffer), np.uint64)  # 40 bits from each byte on
    for k in range(5):
        windows[: len(buffer) - k] |= buffer[k:] << np.uint64(32 - 8 * k)
    ends = 8 * np.cumsum([len(d) for d in data]).astype(np.int64)
    place = ends - 8 * np.array([len(d) for d in data], np.int64)
    across, down = tables.units
    counts = np.full(len(scan), across * down) if counts is None else counts
    own = sum(component == 0 for component, _, _ in tables.parts)
    out = np.zeros((len(scan), int(counts.max(initial=0)) * own, 64), np.int16)
    before = np.zeros((1 + max(component for component, _, _ in tables.parts), len(scan)), np.int64)
    broken = np.zeros(len(scan), bool)

    def bits_at(p: np.ndarray) -> np.ndarray:
        return ((windows[p >> 3] >> (8 - (p & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF))

    def value(p: np.ndarray, count: np.ndarray) -> np.ndarray:
        raw = (bits_at(p) >> (32 - count).astype(np.uint64)).astype(np.int64)
        return np.where((count > 0) & (raw < (1 << np.maximum(count - 1, 0))), raw - (1 << count) + 1, raw)

    limit = 8 * (len(buffer) - 8)
    every = np.arange(len(scan))
    for unit in range(int(counts.max(initial=0))):
        live = slice(None) if (counts > unit).all() else np.flatnonzero(counts > unit)
        block = unit * own
        for component, dc, ac in tables.parts:
            found = dc[bits_at(place[live]) >> np.uint64(16)]
            size = found & 255
            broken[live] |= found == 0
            p = np.minimum(place[live] + (found >> 8), limit)
            before[component][live] += value(p, size)
            place[live] = p + size
            if component == 0:
                out[live, block, 0] = before[0][live]
            active = every[live]
            coefficient = np.ones(len(active), np.int64)
            place = np.minimum(place, limit)
            while len(active):
                p = place[active]
                found = ac[bits_at(p) >> np.uint64(16)]
                symbol, p = found & 255, p + (found >> 8)
                broken[active] |= found == 0
                going = (symbol != 0) & (found > 0) & (p < limit)
                place[active] = p
                if not going.any():
                    break
                active, symbol, p = active[going], symbol[going], p[going]
                size, at = symbol & 15, coefficient[going] + (symbol >> 4)
                inside = at < 64
                if component == 0:
                    out[active[inside], block, at[inside]] = value(p, size)[inside]
                place[active] = p + size
                coefficient = at + 1
                more = at < 63
                active, coefficient = active[more], coefficient[more]
            place = np.minimum(place, limit)
            block += component == 0
    return out, broken | (place > ends)


COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def in_rows(coded: np.ndarray, tables: Tables) -> np.ndarray:
    """Blocks of pictures in rows (frames x down x across x 64) from the order of the units."""
    (across, down), (h, v) = tables.units, tables.shape
    rows = coded.reshape(len(coded), down, across, v, h, 64).swapaxes(2, 3).reshape(len(coded), down * v, across * h, 64)
    return rows[:, : -(-tables.height // 8), : -(-tables.width // 8)]


def pixels(coded: np.ndarray, tables: Tables) -> np.ndarray:
    """Pictures (frames x height x width) of the first component from coefficients."""
    rows = in_rows(coded, tables)
    frames, down, across, _ = rows.shape
    full = np.zeros(rows.shape)
    full[..., ZIGZAG] = rows * tables.quant
    blocks = COSINES @ full.reshape(frames, -1, 8, 8) @ COSINES.T
    levels = np.clip(np.rint(blocks) + 128, 0, 255).astype(np.uint8).reshape(frames, down, across, 8, 8).swapaxes(2, 3)
    return levels.reshape(frames, down * 8, across * 8)[:, : tables.height, : tables.width]


def block_levels(coded: np.ndarray, tables: Tables) -> np.ndarray:
    """Level of every block (frames x blocks): its pixels' mean, which the DC holds alone."""
    rows = in_rows(coded, tables)[..., 0]
    return np.clip(np.rint(rows * int(tables.quant[0]) / 8) + 128, 0, 255).astype(np.uint8).reshape(len(rows), -1)


def decode_group(frames: list[bytes], start: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, whether broken) of frames that share one header; restart intervals are scans of their own."""
    scan = [scan_of(f, start) for f in frames]
    if not tables.interval:
        return coefficients(scan, tables)
    across, down = tables.units
    pieces = -(-across * down // tables.interval)
    cut = [RESTART.split(s)[:pieces] for s in scan]
    counts = np.minimum(tables.interval, across * down - np.arange(pieces) * tables.interval)
    coded, broken = coefficients([x for c in cut for x in c + [b""] * (pieces - len(c))], tables, np.tile(counts, len(frames)))
    own = sum(component == 0 for component, _, _ in tables.parts)
    whole = coded.reshape(len(frames), -1, 64)[:, : across * down * own]
    return whole, broken.reshape(len(frames), pieces).any(axis=1) | np.array([len(c) != pieces for c in cut])


_heads: dict[bytes, tuple[int, Tables]] = {}


def decode_levels(frames: list[bytes]) -> tuple[np.ndarray, Tables]:
    """Block levels of frames that share one header."""
    head = frames[0][: len(HEAD)]
    if head not in _heads:
        _heads.clear()
        _heads[head] = read_head(frames[0])
    start, tables = _heads[head]
    if any(not f.startswith(frames[0][:start]) for f in frames):
        raise ValueError("frames with different headers")
    return block_levels(coefficients([f[start:-2] for f in frames], tables)[0], tables), tables


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Pictures of frames that share one header (frames x height x width)."""
    start, tables = read_head(frames[0])
    return pixels(decode_group(frames, start, tables)[0], tables)


OK, EMPTY, DAMAGED, UNREADABLE = "ok", "empty", "damaged", "unreadable"


def movie_levels(frames: list[bytes]) -> tuple[np.ndarray | None, list[str]]:
    """(block levels of all frames, status of each), whatever the frames are.

    Frames are decoded by header. A frame that is empty (dropped), cannot be read or has not the size of the first
    that can, shows the picture before it (or the first one after, at the start); one whose data breaks off shows what there was. None if no frame can be read.
    """
    status, levels, size = [UNREADABLE if f else EMPTY for f in frames], None, None
    by_head: dict[bytes, list[int]] = {}
    tables: dict[bytes, tuple[int, Tables]] = {}
    for i, frame in enumerate(frames):
        try:
            start, found = read_head(frame)
        except BadFrame:
            continue
        size = size or (found.width, found.height)
        if size == (found.width, found.height):
            by_head.setdefault(frame[:start], []).append(i)
            tables[frame[:start]] = start, found
    for head, rows in by_head.items():
        for a, b in groups([tables[head][1].width * tables[head][1].height // 64 + 1] * len(rows)):
            coded, broken = decode_group([frames[i] for i in rows[a:b]], *tables[head])
            part = block_levels(coded, tables[head][1])
            levels = np.zeros((len(frames), part.shape[1]), np.uint8) if levels is None else levels
            levels[rows[a:b]] = part
            for i, bad in zip(rows[a:b], broken.tolist()):
                status[i] = DAMAGED if bad else OK
    if levels is None:
        return None, status
    shown = np.array([i if st in (OK, DAMAGED) else -1 for i, st in enumerate(status)])
    first = int(shown[shown >= 0][0])
    return levels[np.maximum(np.maximum.accumulate(shown), first)], status


def find_shots(levels: np.ndarray) -> list[int]:
    """First frames of the shots (0 is one), from block levels (frames x blocks).

    A cut's histogram difference is above the mean and ``DEVIATIONS`` deviations
    of the differences ``AROUND`` it, itself left out, and moves ``LEAST`` of the blocks.
    """
    frames, blocks = levels.shape
    if frames < 3:
        return [0]
    bins = (levels.astype(np.int64) * BINS >> 8) + np.arange(frames)[:, None] * BINS
    histogram = np.bincount(bins.ravel(), minlength=frames * BINS).reshape(frames, BINS)
    moved = np.abs(np.diff(histogram, axis=0)).sum(axis=1)  # twice the blocks that changed bins
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (moved, moved * moved))
    at = np.arange(len(moved))
    low, high = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(moved))
    n = high - low - 1
    total, square = sums[high] - sums[low] - moved, squares[high] - squares[low] - moved * moved
    # n * moved > total + deviations * sqrt(n * square - total^2), on exact integers
    spread = np.sqrt((n * square - total * total).astype(np.float64))
    cut = (n > 0) & (n * moved > total + DEVIATIONS * spread) & (moved > 2 * LEAST * blocks)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def groups(sizes: list[int], limit: int = AT_ONCE):
    """(start, stop) of consecutive items of about ``limit`` together."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def read_back(media: list[bytes]) -> list[tuple[bytes, float, list[int]]]:
    """(payload, seconds a frame, first frames of shots) of files written by ``encode_many``."""
    movies = [parse_avi(m) for m in media]
    out: list[tuple[bytes, float, list[int]]] = []
    parts: list[list[np.ndarray]] = [[] for _ in movies]
    flat = [(i, f) for i, m in enumerate(movies) for f in m.frames]
    for a, b in groups([FRAME] * len(flat)):
        levels, _ = decode_levels([f for _, f in flat[a:b]])
        owners = np.array([i for i, _ in flat[a:b]])
        firsts = np.flatnonzero(np.diff(owners, prepend=-1))
        for s, e in zip(firsts.tolist(), [*firsts[1:].tolist(), len(owners)]):
            parts[owners[s]].append(levels[s:e])
    for movie, levels in zip(movies, parts):
        whole = np.concatenate(levels)
        out.append((whole.tobytes(), movie.frame_s, find_shots(whole)))
    return out


def _storing(with_media: bool):
    def work(batch):
        data = [t.encode() for t in batches.strings(batch)]
        payloads = [padded(d) for d in data]
        columns: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                                                    "media_bytes", "media_sha256", "feature", *["media"] * with_media)}
        for a, b in groups([len(p) for p in payloads]):
            media = encode_many(payloads[a:b])
            for raw, stored, (payload, _, shots) in zip(data[a:b], media, read_back(media)):
                frames = len(payload) // FRAME
                row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored),
                       hashlib.sha256(stored).hexdigest(), f"{frames} frames, cuts {','.join(map(str, shots[1:]))}", stored)
                for name, value in zip(columns, row):
                    columns[name].append(value)
        return {"doc_id": batch.column("doc_id"), **columns}

    return work


STORED = ("n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
          "media_sha256 string, feature string")


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Every document's text as an AVI file, read back: digests, shots and, if asked for, ``media``."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_texts(batches.id_text(docs), _storing,
                             f"doc_id {ids}, {STORED}" + ", media binary" * with_media, with_media=with_media)


def _clipping(parts):
    for part in parts:
        for piece in batches.slices(part, "media", 16 << 20):
            rows = []
            for doc, data in zip(piece.column("doc_id").to_pylist(), piece.column("media").to_pylist()):
                movie = parse_avi(data) if data else None
                if movie is None or not movie.frames:
                    rows.append((doc, None, None, None, None, None, "no_avi" if movie is None else "no_frames"))
                    continue
                levels, status = movie_levels(movie.frames)
                if levels is None:
                    rows.append((doc, None, None, None, None, None, UNREADABLE))
                    continue
                worst = next((s for s in (UNREADABLE, DAMAGED) if s in status), OK)
                firsts = find_shots(levels)
                for k, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(movie.frames)])):
                    rows.append((doc, k, a, b - 1, a * movie.frame_s, b * movie.frame_s, worst))
            kinds = [part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                             names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "status"])


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of each file (columns doc_id, media), with the file's status.

    ``ok``; ``damaged`` where a frame's data breaks off; ``unreadable`` where a frame cannot be decoded (progressive, 12 bits,
    cut in its head). What gives no clip has one row without: ``no_avi``, ``no_frames``, or ``unreadable`` where no frame can be.
    """
    ids = media.schema["doc_id"].dataType.simpleString()
    return batches.map_arrow(media.select("doc_id", "media"), _clipping,
                             f"doc_id {ids}, clip int, first_frame bigint, last_frame bigint, start_s double, end_s double, status string")
