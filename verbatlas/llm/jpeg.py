"""Progressive JPEG in numpy: a decoder for Huffman-coded progressive scans, and a writer of exact coefficients.

Decoding accumulates the scans into coefficient arrays: spectral selection fills bands of the zigzag order,
successive approximation adds bits to what is there. Then strips of blocks are inverse-transformed by
matrix products, chroma is upsampled to full resolution, and colours become RGB.

Scans whose table has one symbol only have units of a known size and are decoded as arrays; DC scans look up
all bit positions at once and follow them; anything else goes bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural positions (8 * row + column) in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_u = np.arange(8)
#: The orthonormal cosine transform: spectrum = DCT @ block @ DCT.T.
DCT = (np.cos((2 * _u[None, :] + 1) * _u[:, None] * np.pi / 16) * np.where(_u == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row, padded to whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks in a row of a scan of this component alone
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))  # blocks x 64, zigzag order


@dataclass
class Image:
    width: int
    height: int
    parts: dict[int, Component]
    quantizers: dict[int, np.ndarray]
    comment: bytes = b""


class Huffman:
    """Canonical codes: counts of codes by length 1 to 16, and the symbols in order of their codes."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.lengths, self.values = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                low = code << (16 - length)
                self.lengths[low : low + (1 << (16 - length))] = length
                self.values[low : low + (1 << (16 - length))] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


@lru_cache(maxsize=32)
def _huffman(key: bytes) -> Huffman:
    """The table for counts and symbols; foreign files may have many, so few are kept."""
    return Huffman(key[:16], key[16:])


class Bits:
    """The bits of one entropy-coded interval, one after the other."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = 2 * value + b
        value <<= max(0, self.at + n - len(self.bits))
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        code = self.take(16)
        self.at -= 16
        length = int(table.lengths[code])
        if not length:
            raise ValueError("bad code in the scan")
        self.at += length
        return int(table.values[code])


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_values(data: bytes, table: Huffman, n: int) -> list[int]:
    """n differences: every bit position is read as if a code began there, then the real ones are followed."""
    a = np.frombuffer(data + b"\xff" * 5, np.uint8).astype(np.uint64)
    word = (a[:-4] << np.uint64(32)) | (a[1:-3] << np.uint64(24)) | (a[2:-2] << np.uint64(16)) | (a[3:-1] << np.uint64(8)) | a[4:]
    window = ((word[:, None] >> (np.uint64(8) - np.arange(8, dtype=np.uint64))) & np.uint64(0xFFFFFFFF)).reshape(-1)
    head = (window >> np.uint64(16)).astype(np.int64)
    length, size = table.lengths[head].astype(np.int64), table.values[head].astype(np.int64)
    bits = (window.astype(np.int64) >> np.maximum(32 - length - size, 0)) & ((1 << size) - 1)
    value = np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
    step, at, out = (length + size).tolist(), 0, []
    for _ in range(n):
        out.append(at)
        at += step[at]
    return value[out].tolist()


def _scan_blocks(image: Image, names: list[int]) -> list[tuple[int, np.ndarray]]:
    """For each component of the scan, the numbers of its blocks in coding order (by MCU if there are several)."""
    if len(names) == 1:
        p = image.parts[names[0]]
        return [(names[0], (np.arange(p.own_high)[:, None] * p.wide + np.arange(p.own_wide)).ravel())]
    found = []
    for name in names:
        p = image.parts[name]
        grid = np.arange(p.high * p.wide).reshape(p.high // p.v, p.v, p.wide // p.h, p.h)
        found.append((name, grid.transpose(0, 2, 1, 3).reshape(-1)))
    return found


def _dc_scan(image: Image, order: list[tuple[int, np.ndarray]], tables: dict, data: bytes, high: int, low: int, first_mcu: int, mcus: int) -> None:
    per = [(image.parts[n].h * image.parts[n].v if len(order) > 1 else 1) for n, _ in order]
    # the sequence of (component, block) of this interval
    which = np.tile(np.repeat(np.arange(len(order)), per), mcus)
    block = np.concatenate([b[first_mcu * k : (first_mcu + mcus) * k].reshape(mcus, k) for (_, b), k in zip(order, per)], 1).reshape(-1)
    if high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(block)).astype(np.int32)
        for i, (name, _) in enumerate(order):
            own = which == i
            image.parts[name].coefficients[block[own], 0] |= bits[own] << low
        return
    chosen = [tables[0, t] for t in (image.scan_tables[n][0] for n, _ in order)]
    if all(t is chosen[0] for t in chosen):
        values = np.array(_dc_values(data, chosen[0], len(block)), np.int32)
    else:
        reader = Bits(data)
        values = np.array([_extend(reader.take(s), s) for w in which for s in [reader.symbol(chosen[w])]], np.int32)
    for i, (name, _) in enumerate(order):
        own = which == i
        image.parts[name].coefficients[block[own], 0] = np.cumsum(values[own]) << low


def _ac_first(c: np.ndarray, blocks: np.ndarray, table: Huffman, data: bytes, start: int, end: int, low: int) -> None:
    width = end - start + 1
    if table.only is not None and 0 < table.only < 16:
        size = table.only
        if size == 7:
            bits = np.frombuffer(data, np.uint8, len(blocks) * width).astype(np.int32)
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * width * (size + 1)).reshape(-1, size + 1)[:, 1:]
            bits = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        values = np.where(bits >> (size - 1), bits, bits - (1 << size) + 1) * (1 << low)
        c[blocks, start : end + 1] = values.reshape(-1, width)
        return
    reader, run = Bits(data), 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            r, s = divmod(reader.symbol(table), 16)
            if s:
                k += r
                c[b, k] = _extend(reader.take(s), s) * (1 << low)
                k += 1
            elif r < 15:
                run = (1 << r) + reader.take(r) - 1
                break
            else:
                k += 16


def _ac_refine(c: np.ndarray, blocks: np.ndarray, table: Huffman, data: bytes, start: int, end: int, low: int) -> None:
    band = c[blocks, start : end + 1]
    if table.only == 0 and band.all():
        width = end - start + 2
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * width).reshape(-1, width)[:, 1:]
        c[blocks, start : end + 1] = band + np.sign(band) * (bits.astype(np.int32) << low)
        return
    reader, run, step = Bits(data), 0, 1 << low

    def correct(b: int, k: int) -> None:
        if reader.take(1) and not abs(int(c[b, k])) & step:
            c[b, k] += step if c[b, k] > 0 else -step

    for b in blocks.tolist():
        k = start
        while k <= end and not run:
            r, s = divmod(reader.symbol(table), 16)
            new = 0
            if s:
                new = step if reader.take(1) else -step
            elif r < 15:
                run = (1 << r) + reader.take(r)
                break
            while k <= end:
                if c[b, k]:
                    correct(b, k)
                elif r == 0:
                    if new:
                        c[b, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            for j in range(k, end + 1):
                if c[b, j]:
                    correct(b, j)
            run -= 1


def decode(body: bytes) -> Image:
    """Accumulate all scans of a progressive JPEG into coefficient arrays."""
    if body[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, restart, image, comment, quantizers = 2, {}, 0, None, b"", {}
    while at < len(body):
        marker = body[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(body[at + 2 : at + 4], "big")
        x, at = body[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while x:
                wide = x[0] >> 4
                quantizers[x[0] & 15] = np.frombuffer(x[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                x = x[65 + 64 * wide :]
        elif marker == 0xC4:
            while x:
                n = sum(x[1:17])
                key = x[1 : 17 + n]
                tables[x[0] >> 4, x[0] & 15] = _huffman(key)
                x = x[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(x[:2], "big")
        elif marker == 0xFE:
            comment = x
        elif marker == 0xC2:
            image = Image(int.from_bytes(x[3:5], "big"), int.from_bytes(x[1:3], "big"), {}, quantizers, comment)
            for k in range(x[5]):
                n, hv, q = x[6 + 3 * k : 9 + 3 * k]
                image.parts[n] = Component(hv >> 4, hv & 15, q)
            hs, vs = max(p.h for p in image.parts.values()), max(p.v for p in image.parts.values())
            for p in image.parts.values():
                p.wide, p.high = -(-image.width // (8 * hs)) * p.h, -(-image.height // (8 * vs)) * p.v
                p.own_wide, p.own_high = -(-(-(-image.width * p.h // hs)) // 8), -(-(-(-image.height * p.v // vs)) // 8)
                p.coefficients = np.zeros((p.wide * p.high, 64), np.int32)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman frames are read")
        elif marker == 0xDA:
            n = x[0]
            image.scan_tables = {x[1 + 2 * k]: (x[2 + 2 * k] >> 4, x[2 + 2 * k] & 15) for k in range(n)}
            start, end, high, low = x[1 + 2 * n], x[2 + 2 * n], x[3 + 2 * n] >> 4, x[3 + 2 * n] & 15
            names, intervals, begin = list(image.scan_tables), [], at
            while True:  # up to the next marker that is neither a stuffed byte nor a restart
                at = body.find(b"\xff", at)
                if at < 0:
                    raise ValueError("the scan is cut off")
                if body[at + 1] == 0:
                    at += 2
                elif 0xD0 <= body[at + 1] <= 0xD7:
                    intervals.append(body[begin:at])
                    at = begin = at + 2
                else:
                    break
            intervals.append(body[begin:at])
            order, first = _scan_blocks(image, names), 0
            p = image.parts[names[0]]
            mcus = len(order[0][1]) // (p.h * p.v if n > 1 else 1)
            for data in intervals:
                data = data.replace(b"\xff\x00", b"\xff")
                many = min(restart or mcus, mcus - first)
                if start == 0:
                    _dc_scan(image, order, tables, data, high, low, first, many)
                else:
                    blocks, table = order[0][1][first : first + many], tables[1, image.scan_tables[names[0]][1]]
                    (_ac_refine if high else _ac_first)(p.coefficients, blocks, table, data, start, end, low)
                first += many
        if image is not None:
            image.comment = comment
    return image


def samples(image: Image, name: int, rows: slice) -> np.ndarray:
    """Inverse-transformed 8-bit samples of a component, for some of its rows of blocks."""
    p = image.parts[name]
    c = p.coefficients.reshape(p.high, p.wide, 64)[rows]
    spectrum = np.empty((c.shape[0] * c.shape[1], 64), np.float32)
    spectrum[:, ZIGZAG] = c.reshape(-1, 64) * image.quantizers[p.table]
    pixels = DCT.T @ spectrum.reshape(-1, 8, 8) @ DCT + np.float32(128.5)
    pixels = np.clip(pixels, 0, 255).astype(np.uint8)
    return pixels.reshape(c.shape[0], p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.shape[0], 8 * p.wide)


def strips(image: Image, mcu_rows: int = 16) -> Iterator[np.ndarray]:
    """Full-resolution RGB in strips of height x width x 3 bytes: chroma is repeated up to the luma's grid."""
    hs, vs = max(p.h for p in image.parts.values()), max(p.v for p in image.parts.values())
    names = list(image.parts)
    total = image.parts[names[0]].high // image.parts[names[0]].v
    for at in range(0, total, mcu_rows):
        planes = []
        for n in names:
            p = image.parts[n]
            s = samples(image, n, slice(at * p.v, (at + mcu_rows) * p.v))
            planes.append(s.repeat(vs // p.v, 0).repeat(hs // p.h, 1) if (p.h, p.v) != (hs, vs) else s)
        planes = [s[: max(0, image.height - at * 8 * vs), : image.width] for s in planes]
        if len(planes) == 1:
            yield np.repeat(planes[0][..., None], 3, 2)
            continue
        y, cb, cr = planes[0].astype(np.float32), planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
        rgb = np.empty((*y.shape, 3), np.float32)
        rgb[..., 0] = y + 1.402 * cr
        rgb[..., 1] = y - 0.344136 * cb - 0.714136 * cr
        rgb[..., 2] = y + 1.772 * cb
        yield np.clip(rgb + 0.5, 0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(names: list[int], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(names)]) + b"".join(bytes([n, 0x00]) for n in names) + bytes([start, end, 16 * high + low])
    return _segment(0xDA, head) + data


def _table(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([16 * kind]) + bytes(lengths) + bytes(symbols))


def _ones_padded(bits: np.ndarray) -> bytes:
    full = np.ones(-(-len(bits) // 8) * 8, np.uint8)
    full[: len(bits)] = bits
    return np.packbits(full).tobytes().replace(b"\xff", b"\xff\x00")


#: DC differences of 0 to 8 bits, all with codes of 4 bits; one AC symbol at a time, with a code of 1 bit.
_DC = _table(0, [0, 0, 0, 9] + [0] * 12, list(range(9)))
_AC_FIRST = _table(1, [1] + [0] * 15, [0x07])
_AC_REFINE = _table(1, [1] + [0] * 15, [0x00])
_FLAT = _segment(0xDB, b"\x00" + b"\x01" * 64)


def encode_bytes(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose quantized coefficients are the payload's bytes, 64 to a block.

    A byte is the eight magnitude bits of a coefficient of size 8, so no coefficient is 0: 128..255 stand for themselves,
    0..127 for -255..-128. A comment holds the payload's length; blocks beyond it hold bytes 0.
    Scans: all but the last bit of DC; of luma's low, then high frequencies; of both chromas; then the last bits.
    """
    blocks = -(-len(payload) // 64)
    mcus = max(1, -(-blocks // 6))
    across = max(1, int(np.ceil(np.sqrt(mcus))))
    down = -(-mcus // across)
    total = across * down
    grid = np.zeros(total * 6 * 64, np.uint8)
    grid[: len(payload)] = np.frombuffer(payload, np.uint8)
    grid = grid.reshape(-1, 64)
    parts = {1: grid[: 4 * total], 2: grid[4 * total : 5 * total], 3: grid[5 * total :]}
    out = [b"\xff\xd8", _segment(0xFE, b"%d" % len(payload)), _FLAT]
    size = (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big")
    out.append(_segment(0xC2, b"\x08" + size + b"\x03" + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"))

    # DC of all components, by MCU: four luma blocks, then one of each chroma
    luma = np.arange(4 * total).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    y, cb, cr = (np.where(p[:, 0] > 127, p[:, 0], p[:, 0].astype(np.int32) - 255).astype(np.int32) for p in parts.values())
    steps = [np.diff(v >> 1, prepend=0) for v in (y[luma].ravel(), cb, cr)]
    diff = np.concatenate([steps[0].reshape(-1, 4), steps[1][:, None], steps[2][:, None]], 1).ravel()
    width = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    value = (width << width) | np.where(diff < 0, diff + (1 << width) - 1, diff)  # the code of a size is the size
    length = 4 + width
    item = np.repeat(np.arange(len(diff)), length)
    left = np.repeat(np.cumsum(length), length) - 1 - np.arange(len(item))
    out += [_DC, _scan([1, 2, 3], 0, 0, 0, 1, _ones_padded((value[item] >> left) & 1))]

    out.append(_AC_FIRST)
    for name, start, end in ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63)):
        out.append(_scan([name], start, end, 0, 1, (parts[name][:, start : end + 1] >> 1).tobytes()))
    last = np.concatenate([(y[luma] & 1), (cb & 1)[:, None], (cr & 1)[:, None]], 1).ravel()
    out += [_scan([1, 2, 3], 0, 0, 1, 0, _ones_padded(last)), _AC_REFINE]
    for name, p in parts.items():
        bits = np.where(p > 127, p, ~p) & 1  # the last bit of the magnitude; the first place is the code's
        bits[:, 0] = 0
        out.append(_scan([name], 1, 63, 1, 0, np.packbits(bits, axis=1).tobytes().replace(b"\xff", b"\xff\x00")))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The bytes that encode_bytes stored."""
    c = np.concatenate([p.coefficients for p in image.parts.values()])
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()[: int(image.comment)]
