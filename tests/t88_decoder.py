"""A decoder for what the engine writes, from ITU-T T.88, used by the tests alone."""

import struct

import numpy as np

# Fixed values of ITU-T T.88 Table E.1, typed from the standard and not shared with the coder: Qe, NMPS, NLPS, SWITCH.
TABLE = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0),
]

class Decoder:
    """Annex E, software conventions."""

    def __init__(self, data):
        self.data, self.at, self.state = data, 0, {}
        self.c = (self.byte(0) << 16)
        self.fill()
        self.c = self.c << 7 & 0xFFFFFFFF
        self.ct -= 7
        self.a = 0x8000

    def byte(self, i):
        return self.data[i] if i < len(self.data) else 0xFF

    def fill(self):
        if self.byte(self.at) == 0xFF:
            if self.byte(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self.byte(self.at) << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self.byte(self.at) << 8
            self.ct = 8

    def bit(self, context):
        i, mps = self.state.get(context, (0, 0))
        q, after_mps, after_lps, switch = TABLE[i]
        self.a -= q
        if (self.c >> 16) < q:
            likely = self.a < q
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return mps
            likely = self.a >= q
        out = mps if likely else 1 - mps
        self.state[context] = (after_mps, mps) if likely else (after_lps, mps ^ switch)
        while not self.a & 0x8000:
            if not self.ct:
                self.fill()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
        return out

    def integer(self, name):
        at = 1

        def one():
            nonlocal at
            b = self.bit(("int", name, at))
            at = at << 1 | b if at < 256 else (at << 1 | b) & 511 | 256
            return b

        sign = one()
        for offset, bits in ((0, 2), (4, 4), (20, 6), (84, 8), (340, 12)):
            if not one():
                break
        else:
            offset, bits = 4436, 32
        v = 0
        for _ in range(bits):
            v = v << 1 | one()
        v += offset
        return None if sign and not v else -v if sign else v

    def iaid(self, bits):
        at = 1
        for _ in range(bits):
            at = at << 1 | self.bit(("id", at))
        return at - (1 << bits)

    def region(self, width, height, typical=False):
        page = np.zeros((height + 2, width + 8), np.uint8)
        ltp = 0
        for y in range(2, height + 2):
            if typical:
                ltp ^= self.bit(("gb", 0x9B25))
                if ltp:
                    page[y] = page[y - 1] if y > 2 else 0
                    continue
            for x in range(4, width + 4):
                c = 0
                for row, lo, hi in ((y - 2, -2, 3), (y - 1, -3, 4), (y, -4, 0)):
                    for v in page[row, x + lo : x + hi].tolist():
                        c = c << 1 | v
                page[y, x] = self.bit(("gb", c))
        return page[2:, 4 : width + 4].copy()


def segments(data):
    at = 0
    if data[:8] == bytes.fromhex("974a42320d0a1a0a"):
        at = 13
    while at < len(data):
        number, flags, refs = struct.unpack_from(">IBB", data, at)
        at += 6
        size = 1 if number <= 256 else 2 if number <= 65536 else 4
        refers = [int.from_bytes(data[at + i * size : at + (i + 1) * size], "big") for i in range(refs >> 5)]
        at += size * len(refers)
        page = struct.unpack_from(">I", data, at)[0] if flags & 0x40 else data[at]
        at += 4 if flags & 0x40 else 1
        (length,) = struct.unpack_from(">I", data, at)
        at += 4
        yield number, flags & 63, refers, page, data[at : at + length]
        at += length


def dictionary(data):
    count = struct.unpack_from(">I", data, 14)[0]
    d, out, height = Decoder(data[18:]), [], 0
    while len(out) < count:
        height += d.integer("IADH")
        width = 0
        while (step := d.integer("IADW")) is not None:
            width += step
            out.append(d.region(width, height))
    assert d.integer("IAEX") == 0 and d.integer("IAEX") == count
    return out


def text(data, symbols, page):
    count = struct.unpack_from(">I", data, 19)[0]
    bits = max(0, len(symbols) - 1).bit_length()
    d = Decoder(data[23:])
    t, first, done = -d.integer("IADT"), 0, 0
    while done < count:
        t += d.integer("IADT")
        first += d.integer("IAFS")
        s, fresh = first, True
        while True:
            if not fresh:
                step = d.integer("IADS")
                if step is None:
                    break
                s += step
            fresh = False
            bitmap = symbols[d.iaid(bits)]
            h, w = bitmap.shape
            for y in range(h):
                for x in range(w):
                    if bitmap[y, x] and 0 <= t - h + 1 + y < page.shape[0] and 0 <= s + x < page.shape[1]:
                        page[t - h + 1 + y, s + x] = 1
            s += w - 1
            done += 1


def decode(data):
    """All pages of globals and page streams, end to end."""
    pages, symbols, current = [], {}, None
    for number, kind, refers, _, body in segments(data):
        if kind == 48:
            width, height = struct.unpack_from(">II", body)
            current = np.zeros((height, width), np.uint8)
            pages.append(current)
        elif kind == 38:
            width, height = struct.unpack_from(">II", body)
            current |= Decoder(body[26:]).region(width, height, bool(body[17] & 8))
        elif kind == 0:
            symbols[number] = dictionary(body)
        elif kind == 6:
            text(body, [s for r in refers for s in symbols[r]], current)
    return pages
