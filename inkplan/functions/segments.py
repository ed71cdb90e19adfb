"""Framing: segment headers and fixed structures, as column expressions and as bytes."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of ITU-T T.88.
MAGIC = bytes.fromhex("974a42320d0a1a0a")
SYMBOLS, TEXT, GENERIC, PAGE, END_OF_PAGE, END_OF_FILE = 0, 6, 38, 48, 49, 51
ADAPTIVE = struct.pack("8b", 3, -1, -3, -1, 2, -2, -2, -2)


def metres(dpi: int) -> int:
    return round(dpi / 0.0254) if dpi > 0 else 0


def file_header(pages: int) -> bytes:
    return MAGIC + struct.pack(">BI", 1, pages)


def segment(number: int, kind: int, page: int, data: bytes = b"", refers: tuple[int, ...] = (), retain: int = 0) -> bytes:
    """A header and its data; references take as many bytes as this segment's own number needs."""
    if len(refers) > 4:
        raise ValueError("a segment may refer to four others at most")
    wide = page > 255
    size = "B" if number <= 256 else "H" if number <= 65536 else "I"
    head = struct.pack(">IBB", number, kind | 0x40 * wide, len(refers) << 5 | retain)
    return head + struct.pack(f">{len(refers)}{size}", *refers) + struct.pack(">I" if wide else ">B", page) + struct.pack(">I", len(data)) + data


def page_information(width: int, height: int, x_dpi: int, y_dpi: int, lossless: bool) -> bytes:
    return struct.pack(">IIIIBH", width, height, metres(x_dpi), metres(y_dpi), lossless, 0)


def region_information(width: int, height: int) -> bytes:
    return struct.pack(">IIIIB", width, height, 0, 0, 0)


def generic_region(width: int, height: int, typical: bool, coded: bytes) -> bytes:
    return region_information(width, height) + struct.pack(">B", 8 * typical) + ADAPTIVE + coded


def symbol_dictionary(count: int, coded: bytes) -> bytes:
    return struct.pack(">H", 0) + ADAPTIVE + struct.pack(">II", count, count) + coded


def text_region(width: int, height: int, count: int, coded: bytes) -> bytes:
    return region_information(width, height) + struct.pack(">HI", 0, count) + coded


# --- the same as columns ------------------------------------------------------------------------------------------


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def header_column(number: Column, kind: Column, page: Column, length: Column, refers: Column, retain: Column) -> Column:
    """A segment header; refers: array of segment numbers, at most four."""
    wide = page > 255
    count = F.size(refers)
    checked = F.when(count <= 4, refers).otherwise(F.raise_error(F.lit("a segment may refer to four others at most")).cast("array<long>"))
    each = F.transform(checked, lambda r: F.when(number <= 256, F.lpad(F.hex(r.cast("long")), 2, "0")).when(number <= 65536, F.lpad(F.hex(r.cast("long")), 4, "0")).otherwise(F.lpad(F.hex(r.cast("long")), 8, "0")))
    flags = kind.bitwiseOR(F.when(wide, 0x40).otherwise(0))
    place = F.when(wide, big_endian(page, 4)).otherwise(big_endian(page, 1))
    return F.concat(big_endian(number, 4), big_endian(flags, 1), big_endian(count * 32 + retain, 1), F.unhex(F.array_join(each, "")), place, big_endian(length, 4))


def page_information_column(width: Column, height: Column, x: Column, y: Column, lossless: Column) -> Column:
    return F.concat(big_endian(width, 4), big_endian(height, 4), big_endian(x, 4), big_endian(y, 4), big_endian(lossless.cast("long"), 1), big_endian(F.lit(0), 2))


def generic_header_column(width: Column, height: Column, typical: Column) -> Column:
    return F.concat(big_endian(width, 4), big_endian(height, 4), F.unhex(F.lit("000000000000000000")), F.when(typical, F.unhex(F.lit("08"))).otherwise(F.unhex(F.lit("00"))), F.lit(bytearray(ADAPTIVE)))


def file_header_column(pages: Column) -> Column:
    return F.concat(F.lit(bytearray(MAGIC)), F.unhex(F.lit("01")), big_endian(pages, 4))
