"""Bytes as AVI motion-JPEG: frames of 24 x 24 8-bit samples in the lossless process of JPEG (SOF3, left predictor).

Each film has a Huffman table made from its own differences. The reader walks the RIFF tree, takes frames by the index, parses
each frame's markers and tables, decodes it on its own (intra), and finds shots where the histogram difference stands out from
its neighbourhood. Lossless frames of any table and predictor are decoded side by side, a sample of each a step; baseline frames
(SOF0) are read too, one by one, to their luminance.
"""

from __future__ import annotations

import heapq
import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SIDE, FRAME, RATE = 24, 576, 25
BINS, AROUND, SIGMAS, FLOOR = 16, 8, 3.0, 0.15


DECODED = 4096  # frames that are decoded side by side
_LONGEST = 16  # bits of a code
# The order in which a block's coefficients are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def code_lengths(counts: list[int]) -> list[int]:
    """The length of each symbol's code in a Huffman code of these counts; a code of ones only is left free. Symbols that
    don't occur have no code. Up to 16 symbols, so no code is longer than 16 bits."""
    heap = [(n, k, (k,)) for k, n in enumerate(counts) if n] + [(0, -1, (-1,))]
    out = dict.fromkeys(range(-1, len(counts)), 0)
    if len(heap) == 2:
        out[heap[0][1]] = 1
    else:
        heapq.heapify(heap)
        while len(heap) > 1:
            (n, a, x), (m, b, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                out[k] += 1
            heapq.heappush(heap, (n + m, min(a, b), x + y))
    return [out[k] for k in range(len(counts))]


class Table:
    """A Huffman table as JPEG writes it: how many codes of each length, and the symbols in order of their codes."""

    def __init__(self, sizes: bytes, symbols: bytes):
        self.sizes, self.symbols = sizes, symbols
        self.limits = np.zeros(_LONGEST, dtype=np.int64)  # the first 16 bits of a code of each length are below this
        self.shift = np.zeros(_LONGEST + 1, dtype=np.int64)  # from a code to its place among the symbols
        self.codes: dict[int, tuple[int, int]] = {}
        code = at = 0
        for k, n in enumerate(sizes):
            self.shift[k + 1] = at - code
            for symbol in symbols[at : at + n]:
                self.codes[symbol] = code, k + 1
                code += 1
            at += n
            self.limits[k] = code << _LONGEST - 1 - k
            code <<= 1

    @classmethod
    def of(cls, counts: list[int]) -> Table:
        length = code_lengths(counts)
        order = sorted((n, k) for k, n in enumerate(length) if n)
        return cls(bytes(sum(n == k for n, _ in order) for k in range(1, _LONGEST + 1)), bytes(k for _, k in order))

    def segment(self) -> bytes:
        return b"\xff\xc4" + struct.pack(">HB", 19 + len(self.symbols), 0) + self.sizes + self.symbols


def differences(grid: np.ndarray) -> np.ndarray:
    """From samples (frames, rows, columns) to what is left of them beside their left neighbours, the upper ones in the first
    column, and half the range at the first."""
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    return diff


_CLASS = np.array([abs(d).bit_length() for d in range(-255, 256)])


def _classes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The differences of rows of samples and the bits that each has."""
    diff = differences(samples.reshape(-1, SIDE, SIDE).astype(np.int64)).reshape(-1, FRAME)
    return diff, _CLASS[diff + 255]


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 576 samples, all with one table made from them."""
    samples = samples.reshape(-1, FRAME)
    slices = [samples[s : s + DECODED] for s in range(0, len(samples), DECODED)]
    table = Table.of(sum(np.bincount(_classes(x)[1].ravel(), minlength=9) for x in slices).tolist())
    head = (
        b"\xff\xd8"
        + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
        + table.segment()
        + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    )
    return [head + scan + b"\xff\xd9" for x in slices for scan in _scans(x, table)]


def _scans(samples: np.ndarray, table: Table) -> list[bytes]:
    """The coded and stuffed bits of each row of samples."""
    diff, kind = _classes(samples)
    code, length = np.zeros(9, dtype=np.int64), np.zeros(9, dtype=np.int64)
    for symbol, (c, n) in table.codes.items():
        code[symbol], length[symbol] = c, n
    bits = length[kind] + kind
    value = code[kind] << kind | np.where(diff >= 0, diff, diff + (1 << kind) - 1)
    ends = np.cumsum(bits, axis=1)
    sizes = -(-ends[:, -1] // 8)
    starts = np.cumsum(sizes) - sizes
    at = (8 * starts[:, None] + ends - bits).ravel()
    placed = value.ravel() << 32 - at % 8 - bits.ravel()
    packed = np.zeros(int(sizes.sum()) + 4, dtype=np.int64)
    for k in range(4):
        packed += np.bincount(at // 8 + k, placed >> 24 - 8 * k & 255, len(packed)).astype(np.int64)
    packed[starts + sizes - 1] |= (1 << 8 * sizes - ends[:, -1]) - 1  # a frame's last byte is filled with ones
    packed = packed[:-4].astype(np.uint8)
    full = packed == 255
    moved = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(len(packed) + int(moved[-1]), dtype=np.uint8)
    stuffed[np.arange(len(packed)) + moved[:-1]] = packed
    data = stuffed.tobytes()
    cuts = [*(starts + moved[starts]).tolist(), len(data)]
    return [data[s:e] for s, e in zip(cuts, cuts[1:])]


class Header:
    """What a frame's markers say before its scan."""

    def __init__(self, frame: bytes):
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.process = self.restart = 0
        self.tables: dict[int, Table] = {}
        self.steps: dict[int, np.ndarray] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # component, horizontal and vertical sampling, quantisation table
        at = 2
        while True:
            while frame[at : at + 2] == b"\xff\xff":
                at += 1
            if frame[at : at + 1] != b"\xff":
                raise ValueError("a marker is missing")
            mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            at += 2 + size
            if mark in (0xC0, 0xC1, 0xC3):
                self.process = mark
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("samples have 8 bits")
                self.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
            elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("neither baseline nor lossless")
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = Table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.steps[body[0] & 15] = np.frombuffer(body[1:], dtype=">u2" if wide else "u1", count=64).astype(float)
                    body = body[65 + 64 * wide :]
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                self.scan = [(body[k], body[k + 1]) for k in range(1, 1 + 2 * body[0], 2)]
                self.predictor, self.low = body[-3], body[-1] & 15
                break
        self.data, self.raw = at, frame[:at]


def _unstuffed(data: np.ndarray) -> np.ndarray:
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[:-1] != 255) | (data[1:] != 0)
    return data[keep]


def _decode_lossless(frames: list[tuple[Header, bytes]]) -> np.ndarray:
    """The samples of frames of one size, one component and no restarts, a row a frame: all frames' next samples at once."""
    first = frames[0][0]
    tables, rows = {}, []
    for head, _ in frames:
        table = head.tables[head.scan[0][1] >> 4]
        rows.append(tables.setdefault(id(table), (len(tables), table))[0])
    kinds = [t for _, t in tables.values()]
    limits = np.array([t.limits for t in kinds])
    shift = np.array([t.shift for t in kinds])
    symbols = np.array([[*t.symbols, *[0] * (256 - len(t.symbols))] for t in kinds])
    longest = max(k + 1 for t in kinds for k, n in enumerate(t.sizes) if n)
    own = np.array(rows)
    raw = [_unstuffed(np.frombuffer(frame, dtype=np.uint8, offset=head.data)) for head, frame in frames]
    begin = np.cumsum([0, *map(len, raw)])
    data = np.concatenate([*raw, np.zeros(8, dtype=np.uint8)]).astype(np.int64)
    words = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]  # 40 bits from each byte on
    at, end = 8 * begin[:-1], 8 * begin[1:]
    limit = limits[own][:, : longest - 1]
    n = first.width * first.height
    diff = np.empty((n, len(frames)), dtype=np.int64)
    for k in range(n):
        word = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7) & 0xFFFFFFFFFF
        length = 1 + (word[:, None] >> 24 >= limit).sum(axis=1)
        size = symbols[own, (word >> 40 - length) + shift[own, length] & 255]
        extra = word >> 40 - length - size & (1 << size) - 1
        diff[k] = np.where(extra >> np.maximum(size - 1, 0), extra, extra - (1 << size) + 1)
        at = at + length + size
    if (at > end).any():
        raise ValueError("a frame ends early")
    grid = diff.T.reshape(len(frames), first.height, first.width)
    if first.predictor == 1:
        grid[:, 0, 0] += 1 << 7 - first.low
        grid[:, :, 0] = np.cumsum(grid[:, :, 0], axis=1)
        grid = np.cumsum(grid, axis=2)
    else:
        _predicted(grid, first.predictor, 1 << 7 - first.low)
    return ((grid << first.low) & 255).astype(np.uint8).reshape(len(frames), n)


def _predicted(grid: np.ndarray, predictor: int, middle: int) -> None:
    """Adds each sample's prediction from its left, upper and upper left neighbours, in place."""
    rules = {2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + (b - c >> 1), 6: lambda a, b, c: b + (a - c >> 1), 7: lambda a, b, c: a + b >> 1}
    rule = rules[predictor]
    for y in range(grid.shape[1]):
        for x in range(grid.shape[2]):
            if x and y:
                grid[:, y, x] += rule(grid[:, y, x - 1], grid[:, y - 1, x], grid[:, y - 1, x - 1])
            else:
                grid[:, y, x] += grid[:, y, x - 1] if x else grid[:, y - 1, x] if y else middle


class _Bits:
    """The bits of a scan in order."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("a frame ends early")
        value = 0
        for bit in self.bits[self.at - n : self.at]:
            value = value << 1 | bit
        return value

    def symbol(self, table: Table) -> int:
        code = 0
        for n in range(1, _LONGEST + 1):
            code = code << 1 | self.take(1)
            if code << _LONGEST - n < table.limits[n - 1]:
                return table.symbols[code + table.shift[n]]
        raise ValueError("no code of the table")

    def signed(self, size: int) -> int:
        bits = self.take(size) if size else 0
        return bits if not size or bits >> size - 1 else bits - (1 << size) + 1


_WAVES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def _decode_baseline(head: Header, frame: bytes) -> np.ndarray:
    """The luminance of a baseline frame, row by row."""
    pieces = [_unstuffed(np.frombuffer(x, dtype=np.uint8)).tobytes() for x in re.split(b"\xff[\xd0-\xd9]", frame[head.data :])]
    most = [max(p[k] for p in head.parts) for k in (1, 2)]
    across, down = -(-head.width // (8 * most[0])), -(-head.height // (8 * most[1]))
    selectors = dict(head.scan)
    luma = head.parts[0]
    plane = np.zeros((down * luma[2] * 8, across * luma[1] * 8))
    bits, before = _Bits(pieces[0]), dict.fromkeys(selectors, 0)
    for unit in range(across * down):
        if head.restart and unit and unit % head.restart == 0:
            bits, before = _Bits(pieces[unit // head.restart]), dict.fromkeys(selectors, 0)
        for name, h, v, steps in head.parts:
            dc, ac = head.tables[selectors[name] >> 4], head.tables[0x10 | selectors[name] & 15]
            for k in range(h * v):
                block = np.zeros(64)
                before[name] += bits.signed(bits.symbol(dc))
                block[0] = before[name]
                at = 1
                while at < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if not size and run < 15:
                        break
                    at += run
                    if size:
                        block[ZIGZAG[at]] = bits.signed(size)
                    at += 1
                if name == luma[0]:
                    scaled = np.zeros(64)
                    scaled[ZIGZAG] = head.steps[steps]
                    y, x = 8 * (unit // across * v + k // h), 8 * (unit % across * h + k % h)
                    plane[y : y + 8, x : x + 8] = _WAVES @ (block * scaled).reshape(8, 8) @ _WAVES.T + 128
    full = np.repeat(np.repeat(plane, most[1] // luma[2], axis=0), most[0] // luma[1], axis=1)
    return np.clip(np.round(full[: head.height, : head.width]), 0, 255).astype(np.uint8).ravel()


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each JPEG, row by row. A film's frames share their parsed markers."""
    out: list = [None] * len(frames)
    alike: dict[tuple, list[int]] = {}
    parsed: list[Header] = []
    for k, frame in enumerate(frames):
        head = parsed[-1] if parsed and frame.startswith(parsed[-1].raw) else Header(frame)
        parsed.append(head)
        if head.process != 0xC3:
            out[k] = _decode_baseline(head, frame)
        elif len(head.parts) > 1 or head.restart:
            raise ValueError("a lossless frame has one component and no restarts")
        else:
            alike.setdefault((head.height, head.width, head.predictor, head.low), []).append(k)
    for group in alike.values():
        for s in range(0, len(group), DECODED):
            part = group[s : s + DECODED]
            for k, row in zip(part, _decode_lossless([(parsed[k], frames[k]) for k in part])):
                out[k] = row
    return out


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """A film of frames of our size. RIFF has sizes of 32 bits, so that a film is below 4 GB (a Spark value below 2)."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> dict:
    """rate, width, height and the frames' bytes, by the RIFF tree and its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"frames": []}
    movi, index = 0, b""
    stack = [(12, 8 + struct.unpack_from("<I", media, 4)[0])]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                stack.append((at + 12, at + 8 + size))
            elif name == b"avih":
                out |= dict(zip(("width", "height"), struct.unpack_from("<2I", media, at + 8 + 32)))
                out["rate"] = 1_000_000 / struct.unpack_from("<I", media, at + 8)[0]
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + size]
            at += 8 + size + size % 2
    for name, _, at, size in struct.iter_unpack("<4sIII", index):
        if name != b"00dc" or media[movi + at : movi + at + 4] != name:
            raise ValueError("the index doesn't point to a frame")
        out["frames"].append(media[movi + at + 8 : movi + at + 8 + size])
    return out


def shots(samples: np.ndarray) -> list[int]:
    """First frames of the shots: where the histogram difference is a local peak, over FLOOR, and over the mean of the
    differences around it by SIGMAS deviations."""
    n = len(samples)
    if n < 2:
        return [0]
    place = (np.arange(n)[:, None] * BINS + (samples >> 4)).ravel()
    histogram = np.bincount(place, minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2.0 * FRAME)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (diff, diff * diff))
    at = np.arange(len(diff))
    low, high = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(diff))
    count = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - diff) / count
    deviation = np.sqrt(np.maximum((squares[high] - squares[low] - diff * diff) / count - mean * mean, 0))
    peak = np.ones(len(diff), dtype=bool)
    peak[1:] &= diff[1:] > diff[:-1]
    peak[:-1] &= diff[:-1] >= diff[1:]
    return [0, *(np.flatnonzero(peak & (diff > FLOOR) & (diff > mean + SIGMAS * deviation)) + 1).tolist()]


def payload_of(data: bytes) -> bytes:
    """The bytes with 255s up to a positive multiple of a frame."""
    return data + b"\xff" * ((-len(data)) % FRAME if data else FRAME)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of each row of `docs`; a null text is empty: one frame of 255s."""

    def make():
        def step(batch):
            sizes, media = [], []
            for s in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(s, 256):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(data))
                    media.append(write_avi(encode_frames(np.frombuffer(payload_of(data), dtype=np.uint8))))
                yield {"doc_id": batch.column(0).slice(s, 256), "n_bytes": sizes, "media": media}
                sizes, media = [], []

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_bytes long, media binary", make)


def read_media(media: DataFrame) -> DataFrame:
    """`media` (doc_id, n_bytes, media) with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and
    clips: an array of (clip, first_frame, frames, start_s, end_s, mean). Rows that repeat are read each; a film of another
    kind than ours or a cut one is an error."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double,mean:double>>"
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")

    def make():
        def told(stored: bytes, film: dict, samples: np.ndarray) -> tuple:
            payload = samples.tobytes()
            starts = shots(samples)
            ends = [*starts[1:], len(samples)]
            clips = [{"clip": k, "first_frame": s, "frames": e - s, "start_s": s / film["rate"], "end_s": e / film["rate"], "mean": float(samples[s:e].mean())} for k, (s, e) in enumerate(zip(starts, ends))]
            share = np.bincount(samples.ravel() >> 4, minlength=BINS) / samples.size
            feature = f"{film['width']}x{film['height']}x{len(samples)};shots={len(starts)};" + ",".join(f"{x:.4f}" for x in share)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, clips

        def step(batch):
            done = 0
            held: list[tuple[bytes, dict]] = []
            count = 0
            for stored in batch.column(2):
                held.append((stored.as_py(), read_avi(stored.as_py())))
                count += len(held[-1][1]["frames"])
                if count >= DECODED or done + len(held) == batch.num_rows:  # the frames of many short films at once
                    rows = np.array(decode_frames([f for _, film in held for f in film["frames"]]))
                    cuts = np.cumsum([0, *(len(film["frames"]) for _, film in held)])
                    out = zip(*(told(data, film, rows[s:e]) for (data, film), s, e in zip(held, cuts, cuts[1:])))
                    yield {"doc_id": batch.column(0).slice(done, len(held)), "n_bytes": batch.column(1).slice(done, len(held)), **dict(zip(names, map(list, out)))}
                    done += len(held)
                    held, count = [], 0

        return step

    return arrow_map(media.select("doc_id", "n_bytes", "media"), kind, make)


def clip_rows(read: DataFrame) -> DataFrame:
    """A timed row for each clip."""
    return read.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
