"""Baseline JPEG to its luma plane. Entropy decoding goes bit by bit; all luma blocks are transformed at once."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.phash import DCT

MOST_SIDE = 8192
MOST_PIXELS = 64 << 20
#: Places of the coefficients in the order of storage, along the anti-diagonals.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
START, END, SCAN, QUANT, HUFFMAN, RESTART, DNL = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xDC


class JpegError(Exception):
    """The image is broken or of a kind that is not read."""


class _Codes:
    """Canonical Huffman codes: symbol and length by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        if sum(counts) > 256 or sum(counts) != len(symbols):
            raise JpegError("Huffman table")
        self.table = [(0, 0)] * (1 << 16)
        code, used = 0, 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[used : used + n]:
                low = code << (16 - length)
                if low >= 1 << 16:
                    raise JpegError("Huffman code too long")
                self.table[low : low + (1 << (16 - length))] = [(symbol, length)] * (1 << (16 - length))
                code += 1
            used += n
            code <<= 1


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0\0\0\0", 0, 8 * len(data)

    def symbol(self, codes: _Codes) -> int:
        p = self.at
        window = int.from_bytes(self.data[p >> 3 : (p >> 3) + 3]) >> (8 - (p & 7)) & 0xFFFF
        symbol, length = codes.table[window]
        self.at += length
        if not length or self.at > self.end:
            raise JpegError("no code" if not length else "data ends")
        return symbol

    def signed(self, n: int) -> int:
        """n bits; those that start with 0 are negative."""
        if not n:
            return 0
        p = self.at
        self.at += n
        if self.at > self.end or n > 16:
            raise JpegError("data ends")
        v = int.from_bytes(self.data[p >> 3 : (p >> 3) + 4]) >> (32 - n - (p & 7)) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1


class _Frame:
    def __init__(self, body: bytes):
        if len(body) < 6:
            raise JpegError("frame header")
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or not 1 <= n <= 4 or len(body) < 6 + 3 * n:
            raise JpegError("frame header")
        if not self.width or not self.height or max(self.width, self.height) > MOST_SIDE or self.width * self.height > MOST_PIXELS:
            raise JpegError("size")
        self.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in self.parts):
            raise JpegError("sampling")
        self.luma = next((k for k, p in enumerate(self.parts) if p[0] == 1), 0)


def _segments(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded data up to the next marker, cut at restarts, without stuffing."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begin:])
            break
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            out.append(data[begin:at])
            at = begin = at + 2
        elif follows == 0xFF:
            at += 1
        else:
            out.append(data[begin:at])
            break
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _block(bits: _Bits, dc: _Codes, ac: _Codes, before: int, out: np.ndarray | None) -> int:
    before += bits.signed(bits.symbol(dc))
    if out is not None:
        out[0] = before
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise JpegError("run over the block")
        value = bits.signed(size)
        if out is not None:
            out[ZIGZAG[k]] = value
        k += 1
    return before


def _scan(frame: _Frame, body: bytes, segments: list[bytes], quant: dict, codes: dict, interval: int) -> np.ndarray:
    n = body[0] if body else 0
    if n != len(frame.parts) or len(body) < 1 + 2 * n:
        raise JpegError("scan of some components only")
    chosen = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)}
    try:
        tables = [(codes[0, chosen[p[0]][0]], codes[1, chosen[p[0]][1]]) for p in frame.parts]
        steps = quant[frame.parts[frame.luma][3]]
    except KeyError as e:
        raise JpegError(f"table {e} is missing") from None
    h_most, v_most = (max(p[i] for p in frame.parts) for i in (1, 2))
    if n == 1:
        h_most = v_most = 1
    columns, rows = -(-frame.width // (8 * h_most)), -(-frame.height // (8 * v_most))
    _, h, v, _ = frame.parts[frame.luma]
    if n == 1:
        h = v = 1
    out = np.zeros((rows * v, columns * h, 64))
    supply, bits, last = iter(segments), None, [0] * n
    for mcu in range(rows * columns):
        if bits is None or interval and mcu % interval == 0:
            data = next(supply, None)
            if data is None:
                raise JpegError("data ends")
            bits, last = _Bits(data), [0] * n
        y, x = divmod(mcu, columns)
        for k, (_, hk, vk, _) in enumerate(frame.parts):
            if n == 1:
                hk = vk = 1
            for b in range(hk * vk):
                own = out[y * v + b // h, x * h + b % h] if k == frame.luma else None
                last[k] = _block(bits, *tables[k], last[k], own)
    blocks = (out * steps).reshape(-1, 8, 8)
    pixels = DCT.T @ blocks @ DCT + 128
    pixels = np.clip(np.trunc(pixels + np.copysign(0.5, pixels)), 0, 255).astype(np.uint8)
    plane = pixels.reshape(rows * v, columns * h, 8, 8).transpose(0, 2, 1, 3).reshape(rows * v * 8, -1)
    height, width = -(-frame.height * v // v_most), -(-frame.width * h // h_most)
    return plane[:height, :width]


def luma(data: bytes) -> np.ndarray:
    """Gray values by row and column."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start")
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], _Codes] = {}
    frame, interval, at = None, 0, 2
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise JpegError("no marker")
            marker = data[at + 1]
            if marker in (END, DNL) or 0xD0 <= marker <= 0xD7:
                raise JpegError("no scan")
            (n,) = struct.unpack(">H", data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + n]
            if n < 2 or len(body) < n - 2:
                raise JpegError("segment ends")
            at += 2 + n
            if marker in (0xC0, 0xC1):
                frame = _Frame(body)
            elif marker == HUFFMAN:
                while body:
                    size = sum(body[1:17])
                    codes[body[0] >> 4, body[0] & 15] = _Codes(body[1:17], body[17 : 17 + size])
                    body = body[17 + size :]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise JpegError("not baseline")
            elif marker == QUANT:
                while body:
                    wide = body[0] >> 4
                    steps = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1")
                    if wide > 1 or len(steps) < 64 or not steps.all():
                        raise JpegError("quantizers")
                    own = np.zeros(64)
                    own[ZIGZAG] = steps
                    quant[body[0] & 15] = own
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == RESTART:
                (interval,) = struct.unpack(">H", body[:2])
            elif marker == SCAN:
                if frame is None:
                    raise JpegError("scan before frame")
                return _scan(frame, body, _segments(data, at), quant, codes, interval)
    except (IndexError, struct.error, ValueError) as e:
        raise JpegError(f"data ends: {e}") from e
