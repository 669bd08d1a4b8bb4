"""Progressive JPEG in numpy: a decoder for spectral selection and successive approximation, and a payload encoder.

Decoding accumulates every scan into coefficient arrays (blocks x 64, zigzag order), then dequantises and transforms
all blocks by one matrix product, upsamples chroma and converts to RGB. The matrix holds integers and the product is
taken in float64, where it is exact, so a stored image gives the same tensor in any batch and on any machine.

Scans whose symbols have a fixed length are read as arrays; all others symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the JPEG standard (ITU-T T.81): the zigzag order of an 8 x 8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
SCALE_BITS = 13
MARKER = re.compile(rb"\xff+[\x01-\xcf\xd8-\xfe]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _inverse_matrix() -> np.ndarray:
    """Zigzag coefficients -> 64 samples, scaled by 2**SCALE_BITS and rounded to integers."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << SCALE_BITS))


INVERSE = _inverse_matrix()
_D = np.arange(256) - 128
RED = ((91881 * _D + 32768) >> 16).astype(np.int16)
GREEN_CB = (-22554 * _D).astype(np.int32)
GREEN_CR = (-46802 * _D + 32768).astype(np.int32)
BLUE = ((116130 * _D + 32768) >> 16).astype(np.int16)


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        table = np.full(1 << 16, -1, np.int32)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                lo = code << (16 - length)
                table[lo : lo + (1 << (16 - length))] = length << 8 | symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.table = table.tolist() if self.only is None else None


@lru_cache(64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def peek(self) -> int:
        p = self.at >> 3
        return int.from_bytes(self.data[p : p + 5], "big") >> (24 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek() >> (16 - n)
        self.at += n
        return out

    def symbol(self, h: Huffman) -> int:
        if h.only is not None:
            self.at += 1
            return h.only
        x = h.table[self.peek()]
        if x < 0:
            raise ValueError("a code that the table doesn't have")
        self.at += x >> 8
        return x & 255

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q


def parse(data: bytes) -> dict:
    """Header fields and the coefficient arrays of a progressive JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, huff, image, restart = 2, {}, {}, None, 0
    while True:
        m = MARKER.search(data, at)
        if not m:
            raise ValueError("no end of image")
        kind, at = data[m.end() - 1], m.end()
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if kind == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(p.h for p in parts), max(p.v for p in parts)
            across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
            for p in parts:
                p.wide, p.high = across * p.h, down * p.v
                p.own_wide, p.own_high = -(-(-(-width * p.h // hm)) // 8), -(-(-(-height * p.v // vm)) // 8)
                p.coef = np.zeros((p.wide * p.high, 64), np.int16)
            image = {"width": width, "height": height, "parts": parts, "across": across, "down": down, "hm": hm, "vm": vm}
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("not a progressive Huffman JPEG")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE and image is not None:
            image["comment"] = body
        elif kind == 0xDA:
            n = body[0]
            chosen = [(next(p for p in image["parts"] if p.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            start, end, approx = body[1 + 2 * n : 4 + 2 * n]
            stop = MARKER.search(data, at).start()
            _scan(image, chosen, huff, start, end, approx >> 4, approx & 15, restart, data[at:stop])
            at = stop
    return image | {"quant": quant}


def _order(image: dict, chosen: list) -> list[np.ndarray]:
    """Block numbers in scan order: one array for each (component, place in the MCU)."""
    if len(chosen) == 1:
        p = chosen[0][0]
        return [(np.arange(p.own_high)[:, None] * p.wide + np.arange(p.own_wide)).ravel()]
    out = []
    for p, _ in chosen:
        for y in range(p.v):
            for x in range(p.h):
                out.append(((np.arange(image["down"])[:, None] * p.v + y) * p.wide + np.arange(image["across"]) * p.h + x).ravel())
    return out


def _scan(image, chosen, huff, start, end, high, low, restart, data) -> None:
    orders = _order(image, chosen)
    units = [p for p, _ in chosen for _ in range(1 if len(chosen) == 1 else p.h * p.v)]
    tables = [t for p, t in chosen for _ in range(1 if len(chosen) == 1 else p.h * p.v)]
    n = len(orders[0])
    pieces = RESTART.split(data) if restart else [data]
    for i, piece in enumerate(pieces):
        a, b = (i * restart, min(n, (i + 1) * restart)) if restart else (0, n)
        piece = piece.replace(b"\xff\x00", b"\xff")
        if start == 0 and high:
            _dc_refine([p.coef for p in units], [o[a:b] for o in orders], low, piece)
        elif start == 0:
            _dc_first(units, [huff[t >> 4] for t in tables], [o[a:b] for o in orders], low, piece)
        elif high:
            _ac_refine(units[0].coef, orders[0][a:b], huff[0x10 | tables[0] & 15], start, end, low, piece)
        else:
            _ac_first(units[0].coef, orders[0][a:b], huff[0x10 | tables[0] & 15], start, end, low, piece)


def _dc_first(units, tables, orders, low, data) -> None:
    bits, last = Bits(data), {}
    symbol, value = bits.symbol, bits.value
    got = [[] for _ in orders]
    for _ in range(len(orders[0])):
        for p, h, out in zip(units, tables, got, strict=True):
            v = last[p.ident] = last.get(p.ident, 0) + value(symbol(h))
            out.append(v)
    for p, o, v in zip(units, orders, got, strict=True):
        p.coef[o, 0] = np.array(v, np.int32) << low


def _dc_refine(coefs, orders, low, data) -> None:
    n = len(orders[0])
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * len(orders)).reshape(n, len(orders))
    for i, (c, o) in enumerate(zip(coefs, orders, strict=True)):
        c[o, 0] |= bits[:, i].astype(np.int16) << low


def _ac_first(coef, order, h, start, end, low, data) -> None:
    width, n = end - start + 1, len(order)
    if h.only and h.only >> 4 == 0 and h.only & 15:  # every coefficient has one length
        size = h.only & 15
        if size == 7:
            v = np.frombuffer(data, np.uint8, n * width).astype(np.int16)
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * (size + 1)).reshape(-1, size + 1)[:, 1:]
            v = (bits @ (1 << np.arange(size)[::-1])).astype(np.int16)
        v = np.where(v >> (size - 1), v, v - ((1 << size) - 1)).astype(np.int16) << low
        coef[order, start : end + 1] = v.reshape(n, width)
        return
    bits, skip = Bits(data), 0
    for block in order.tolist():
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            rs = bits.symbol(h)
            run, size = rs >> 4, rs & 15
            if size:
                k += run
                coef[block, k] = bits.value(size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + bits.take(run)
                break


def _ac_refine(coef, order, h, start, end, low, data) -> None:
    if h.only == 0:  # blocks without new coefficients: a code bit, then a bit for each nonzero coefficient
        band = coef[order, start : end + 1]
        there = band != 0
        marks = np.zeros((len(order), end - start + 2), bool)
        marks[:, 1:] = there
        kept = np.ones_like(marks)
        kept[:, 1:] = there
        stream = np.unpackbits(np.frombuffer(data, np.uint8), count=int(kept.sum()))
        plain = np.zeros(kept.shape, np.int16)
        plain[kept] = stream
        coef[order, start : end + 1] = band + np.sign(band) * ((plain * marks)[:, 1:] << low)
        return
    bits, skip = Bits(data), 0
    one = 1 << low
    for block in order.tolist():
        row = coef[block].tolist()
        k = start

        def correct(k, row=row):
            if bits.take(1) and not abs(row[k]) & one:
                row[k] += one if row[k] > 0 else -one

        if not skip:
            while k <= end:
                rs = bits.symbol(h)
                run, size = rs >> 4, rs & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif run < 15:
                    skip = (1 << run) + bits.take(run)
                    break
                while k <= end:
                    if row[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= end:
                    row[k] = new
                k += 1
        if skip:
            for j in range(k, end + 1):
                if row[j]:
                    correct(j)
            skip -= 1
        coef[block] = row


def samples(image: dict) -> list[np.ndarray]:
    """The planes of all components, as uint8."""
    out = []
    for p in image["parts"]:
        x = p.coef.astype(np.float64)
        q = image["quant"][p.q]
        if (q != 1).any():
            x *= q
        y = np.floor((x @ INVERSE + (1 << (SCALE_BITS - 1))) * 2.0**-SCALE_BITS) + 128
        y = np.clip(y, 0, 255).astype(np.uint8).reshape(p.high, p.wide, 8, 8)
        out.append(y.transpose(0, 2, 1, 3).reshape(p.high * 8, p.wide * 8))
    return out


def rgb(image: dict) -> np.ndarray:
    """Height x width x 3, uint8; chroma is repeated up to full resolution."""
    planes = samples(image)
    h, w = image["height"], image["width"]
    grow = [(image["vm"] // p.v, image["hm"] // p.h) for p in image["parts"]]

    def full(x, by):
        return (x if by == (1, 1) else x.repeat(by[0], 0).repeat(by[1], 1))[:h, :w]

    y = full(planes[0], grow[0])
    if len(planes) == 1:
        return np.repeat(y[:, :, None], 3, 2)
    out = np.empty((h, w, 3), np.uint8)
    cb, cr = planes[1], planes[2]
    y = y.astype(np.int16)
    green = (GREEN_CB[cb] + GREEN_CR[cr] >> 16).astype(np.int16) if cb.shape == cr.shape else None
    if green is None or grow[1] != grow[2]:
        cb, cr = full(cb, grow[1]), full(cr, grow[2])
        parts = (RED[cr], (GREEN_CB[cb] + GREEN_CR[cr] >> 16).astype(np.int16), BLUE[cb])
    else:
        parts = tuple(full(x, grow[1]) for x in (RED[cr], green, BLUE[cb]))
    for i, x in enumerate(parts):
        np.clip(y + x, 0, 255, out=out[:, :, i], casting="unsafe")
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(ident: int, length: int, symbols: bytes) -> bytes:
    counts = bytearray(16)
    counts[length - 1] = len(symbols)
    return bytes([ident]) + bytes(counts) + symbols


_QUANT = _segment(0xDB, b"\0" + b"\1" * 64)
_HUFF = _segment(0xC4, _table(0x00, 4, bytes(range(9))) + _table(0x10, 1, b"\7") + _table(0x11, 1, b"\0"))


def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bit strings one after the other, filled up with ones, with stuffing."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    which = np.repeat(np.arange(len(values)), lengths)
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    bits[:total] = values[which] >> (ends[which] - 1 - np.arange(total)) & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def _dc_bits(v: np.ndarray) -> bytes:
    d = np.diff(v, prepend=0)
    size = np.frexp(np.abs(d).astype(np.float64))[1]
    return _pack(size << size | np.where(d < 0, d + (1 << size) - 1, d), size + 4)


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the payload, which must be a positive multiple of 64 bytes.

    Byte b is the coefficient b if its top bit is set and b - 255 else, so each has a magnitude of 8 bits and the JPEG
    amplitude bits of a coefficient are the byte itself. Scans: of each component the upper 7 bits (DC, two bands of
    AC), then the lowest bit of each. The number of payload blocks stands in a comment.
    """
    n = len(payload) // 64
    units = -(-n // 6)
    across = min(4095, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    m = across * down
    raw = np.zeros((6 * m, 64), np.uint8)
    raw[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    out = [b"\xff\xd8", _QUANT, _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _HUFF, _segment(0xFE, struct.pack(">Q", n))]
    scan = lambda c, tables, a, b, approx, bits: out.extend((_segment(0xDA, bytes([1, c, tables, a, b, approx])), bits))
    for c, (a, b) in enumerate(((0, 4 * m), (4 * m, 5 * m), (5 * m, 6 * m)), 1):
        x = raw[a:b]
        dc = x[:, 0].astype(np.int64)
        dc = np.where(dc > 127, dc, dc - 255)
        scan(c, 0x00, 0, 0, 0x01, _dc_bits(dc >> 1))
        scan(c, 0x00, 1, 5, 0x01, (x[:, 1:6] >> 1).tobytes())
        scan(c, 0x00, 6, 63, 0x01, (x[:, 6:] >> 1).tobytes())
        scan(c, 0x00, 0, 0, 0x10, np.packbits(dc & 1).tobytes().replace(b"\xff", b"\xff\0"))
        low = x & 1 ^ (x < 128)
        low[:, 0] = 0  # the code of "no new coefficients"
        scan(c, 0x01, 1, 63, 0x10, np.packbits(low.astype(np.uint8), axis=1).tobytes().replace(b"\xff", b"\xff\0"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def decode_payload(image: dict) -> bytes:
    """The payload of a parsed image that ``encode_payload`` made."""
    n = struct.unpack(">Q", image["comment"])[0]
    v = np.concatenate([p.coef for p in image["parts"]])[:n]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()
