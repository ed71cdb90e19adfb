"""The MQ arithmetic coder and the decision streams that feed it.

Everything a coded stream says is laid out first as two arrays - context numbers and bits - by vectorised code; only
coder state is then folded over them. The fold works on runs of equal decisions: as long as a likely symbol needs no
renormalisation, any number of them is one multiplication.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of ITU-T T.88 Table E.1: probability estimate, next state after the likely and after the unlikely symbol.
QE = [
    0x5601, 0x3401, 0x1801, 0x0AC1, 0x0521, 0x0221, 0x5601, 0x5401, 0x4801, 0x3801, 0x3001, 0x2401, 0x1C01, 0x1601, 0x5601, 0x5401, 0x5101, 0x4801, 0x3801, 0x3401, 0x3001, 0x2801, 0x2401,
    0x2201, 0x1C01, 0x1801, 0x1601, 0x1401, 0x1201, 0x1101, 0x0AC1, 0x09C1, 0x08A1, 0x0521, 0x0441, 0x02A1, 0x0221, 0x0141, 0x0111, 0x0085, 0x0049, 0x0025, 0x0015, 0x0009, 0x0005, 0x0001,
]
NMPS = [1, 2, 3, 4, 5, 38, 7, 8, 9, 10, 11, 12, 13, 29, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 45]
NLPS = [1, 6, 9, 12, 29, 33, 6, 14, 14, 14, 17, 18, 20, 21, 14, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43]
SWITCH = {0, 6, 14}
TYPICAL = 0x9B25
# Fixed values of T.88 Table A.1: first magnitude, bits of it, and the prefix that tells the range.
RANGES = [(0, 2, (0,)), (4, 4, (1, 0)), (20, 6, (1, 1, 0)), (84, 8, (1, 1, 1, 0)), (340, 12, (1, 1, 1, 1, 0)), (4436, 32, (1, 1, 1, 1, 1))]
PROCEDURES = ["IAAI", "IADH", "IADS", "IADT", "IADW", "IAEX", "IAFS", "IAIT", "IARDH", "IARDW", "IARDX", "IARDY", "IARI"]
MOST_INT = 2_000_000_000

_GENERIC = 1 << 16
_IAID = _GENERIC + 512 * len(PROCEDURES)

# A state is 2 * row of the table + the likely symbol.
_Q = [q for q in QE for _ in (0, 1)]
_AFTER_LIKELY = [2 * n + m for n in NMPS for m in (0, 1)]
_AFTER_OTHER = [2 * NLPS[i] + (m ^ (i in SWITCH)) for i in range(len(QE)) for m in (0, 1)]


def encode(contexts: np.ndarray, bits: np.ndarray) -> bytes:
    """The coded stream of these decisions, ended by FF AC."""
    out = bytearray(1)
    a, c, left = 0x8000, 0, 12
    if len(contexts):
        key = np.asarray(contexts).astype(np.uint32) << 1 | np.asarray(bits).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = key[starts]
        state = bytearray((int(first.max()) >> 1) + 1)
        runs = zip(first.tolist(), np.diff(np.append(starts, len(key))).tolist(), strict=True)
    else:
        state, runs = bytearray(), ()
    q_of, likely_next, other_next = _Q, _AFTER_LIKELY, _AFTER_OTHER
    # per context and bit: the estimate if the bit is the likely one, else 0; states change only where the interval is renormalised
    likely = [_Q[0], 0] * len(state)
    for k, n in runs:
        q = likely[k]
        if q:
            rest = a - n * q
            if rest >= 0x8000:
                c += a - rest
                a = rest
                continue
        x = k >> 1
        while n:
            s = state[x]
            q = likely[k]
            if q:
                free = (a - 0x8000) // q
                if free >= n:
                    a -= n * q
                    c += n * q
                    break
                c += free * q
                a -= (free + 1) * q
                n -= free + 1
                if a < q:
                    a = q
                else:
                    c += q
                s = likely_next[s]
            else:
                n -= 1
                q = q_of[s]
                a -= q
                if a < q:
                    c += q
                else:
                    a = q
                s = other_next[s]
            state[x] = s
            other = k ^ 1
            if s & 1 == k & 1:
                likely[k], likely[other] = q_of[s], 0
            else:
                likely[k], likely[other] = 0, q_of[s]
            shift = 16 - a.bit_length()
            a <<= shift
            while shift >= left:
                shift -= left
                c, left = _byte_out(out, c << left)
            c <<= shift
            left -= shift
    limit = c + a
    c |= 0xFFFF
    if c >= limit:
        c -= 0x8000
    c, left = _byte_out(out, c << left)
    _byte_out(out, c << left)
    if out[-1] != 0xFF:
        out.append(0xFF)
    out.append(0xAC)
    return bytes(out[1:])


def _byte_out(out: bytearray, c: int) -> tuple[int, int]:
    """Moves the top bits of the code register to out; what is left of the register, and the shifts until the next byte."""
    if out[-1] != 0xFF and c >> 27:
        out[-1] += 1
        c &= 0x7FFFFFF
    if out[-1] == 0xFF:
        out.append(c >> 20 & 0xFF)
        return c & 0xFFFFF, 7
    out.append(c >> 19 & 0xFF)
    return c & 0x7FFFF, 8


# --- decisions ----------------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def integer(procedure: str, value: int | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Contexts and bits of an integer, or of out-of-band (None)."""
    if value is None:
        bits = [1, 0, 0, 0]
    else:
        if abs(value) > MOST_INT:
            raise ValueError(f"{value} can't be coded")
        first, size, prefix = next(r for r in reversed(RANGES) if abs(value) >= r[0])
        bits = [int(value < 0), *prefix, *((abs(value) - first) >> i & 1 for i in range(size - 1, -1, -1))]
    base, at, contexts = _GENERIC + 512 * PROCEDURES.index(procedure), 1, []
    for bit in bits:
        contexts.append(base + at)
        at = at << 1 | bit if at < 256 else (at << 1 | bit) & 511 | 256
    return tuple(contexts), tuple(bits)


def symbol_id(length: int, value: int) -> tuple[list[int], list[int]]:
    bits = [value >> i & 1 for i in range(length - 1, -1, -1)]
    return [_IAID + (1 << i | value >> (length - i)) for i in range(length)], bits


def neighbours(page: np.ndarray) -> np.ndarray:
    """Generic region context of every pixel: five of the row two above, seven of the row above, four to the left."""
    wide = np.zeros((page.shape[0] + 2, page.shape[1]), np.uint8)
    wide[2:] = page
    return neighbours_of(wide[:-2], wide[1:-1], page)


def neighbours_of(two_above: np.ndarray, above: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The same for rows with the two that stand above each."""

    def steps(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Single pixels, pairs (x and x + 1) and fours (x to x + 3), from four pixels left of the row on."""
        wide = np.zeros((rows.shape[0], rows.shape[1] + 8), np.uint16)
        wide[:, 4:-4] = rows
        pair = wide[:, :-1] << 1
        pair |= wide[:, 1:]
        four = pair[:, :-2] << 2
        four |= pair[:, 2:]
        return wide, pair, four

    w = page.shape[1]
    wide, _, four = steps(two_above)
    out = four[:, 2 : w + 2] << 12
    out |= wide[:, 6 : w + 6] << 11
    wide, pair, four = steps(above)
    out |= four[:, 1 : w + 1] << 7
    out |= pair[:, 5 : w + 5] << 5
    out |= wide[:, 7 : w + 7] << 4
    out |= steps(page)[2][:, :w]
    return out


def typical(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: whether it equals the row above (never for the first), and the bit that says so."""
    same = np.zeros(len(page), bool)
    same[1:] = (page[1:] == page[:-1]).all(axis=1)
    return same, np.concatenate([same[:1], same[1:] != same[:-1]]).astype(np.uint8)


def region(page: np.ndarray, duplicate_lines: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Decisions of a generic region; page: rows of 0 and 1."""
    contexts = neighbours(page)
    if not duplicate_lines:
        return contexts.reshape(-1), page.reshape(-1)
    same, flag = typical(page)
    contexts = np.concatenate([np.full((len(page), 1), TYPICAL, np.uint16), contexts], axis=1)
    bits = np.concatenate([flag[:, None], page], axis=1)
    coded = np.ones(bits.shape, bool)
    coded[same, 1:] = False
    return contexts[coded], bits[coded]


class Stream:
    """Collects decisions in order and codes them."""

    def __init__(self):
        self.contexts: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []

    def add(self, decisions) -> None:
        self.contexts.append(np.asarray(decisions[0], np.int64))
        self.bits.append(np.asarray(decisions[1], np.int64))

    def integer(self, procedure: str, value: int | None) -> None:
        self.add(integer(procedure, value))

    def coded(self) -> bytes:
        if not self.contexts:
            return encode(np.zeros(0), np.zeros(0))
        return encode(np.concatenate(self.contexts), np.concatenate(self.bits))
