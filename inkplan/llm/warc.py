"""WARC archives of Zstandard frames: one frame per record, and the dictionary of all in a leading skippable frame.

Writing: each task cuts its pages into archives of a bounded size. Reading: the dictionary comes from the leading
skippable frame (plain or compressed; an archive may do without), frames are found by their own block headers, each is
decoded for itself, whether or not it states its size, and headers, lengths and such digests as a record has are checked;
anything wrong raises with the archive and the place. Records of all types of WARC 1.0 and 1.1 are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, get_file, pieces, put_file, scratch, stored

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes after which an archive is closed, bytes of dictionary, and how much of the first pages it is trained on.
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
_ID = "<urn:x-page:%s>"
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
#: Digests that can be checked; others are taken as they stand.
_DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


# --- one record ---------------------------------------------------------------------------------------------------


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(url: str | None) -> str:
    """The url on one line of ASCII."""
    if not url:
        return "about:blank"
    return "".join(chr(b) if 0x21 <= b < 0x7F and b not in b"<>" else f"%{b:02X}" for b in url.encode())


def record(page_id: str, url: str | None, payload: bytes, first_id: str | None, date: str) -> bytes:
    """A response with its payload or, if first_id has the same payload, a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first_id is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: {_ID % page_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{_b32(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response",
    ]
    if first_id is not None:
        head += [f"WARC-Refers-To: {_ID % first_id}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    return fields


def _number(fields: dict[str, str], where: str) -> int:
    text = fields.get("content-length", "")
    if not text.isascii() or not text.isdigit():
        raise WarcError(f"{where}: Content-Length {text!r}")
    return int(text)


def _checked(digest: str | None, data: bytes, what: str) -> None:
    """Raises where a digest of a known kind, in base 32 or 16, isn't that of data."""
    name, _, value = (digest or "").partition(":")
    if name.lower() in _DIGESTS:
        own = _DIGESTS[name.lower()](data).digest()
        if value.upper().rstrip("=") != _b32(own).rstrip("=") and value.lower() != own.hex():
            raise WarcError(f"{what} digest")


def parse_record(data: bytes) -> dict:
    """A checked record: type, id, url, date, content_type, block, and of records with an HTTP block payload and payload_bytes.

    payload_digest is the record's own or, of a response without one, SHA-1; refers_to is a revisit's. A revisit's payload
    is None, its payload_bytes those of its HTTP header. Other types have no payload (None).
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in _VERSIONS:
        raise WarcError(f"no WARC record: {data[:40]!r}")
    fields = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    own = fields["warc-record-id"]
    size = _number(fields, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{own}: a block of {len(rest) - 4} bytes, {size} declared")
    block, kind, media = rest[:size], fields["warc-type"].lower(), fields.get("content-type", "")
    _checked(fields.get("warc-block-digest"), block, f"{own}: block")
    out = {"type": kind, "id": own, "url": fields.get("warc-target-uri"), "date": fields["warc-date"], "content_type": media, "block": block, "payload": None, "payload_bytes": None, "payload_digest": fields.get("warc-payload-digest"), "refers_to": fields.get("warc-refers-to")}
    if kind in ("response", "revisit") and media.replace(" ", "").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not status.startswith(b"HTTP/") or kind == "response" and not gap:
            raise WarcError(f"{own}: no HTTP header")
        inner = _fields(lines) if gap or kind == "revisit" else {}
        declared = _number(inner, "payload") if "content-length" in inner else None
        # a body that was sent in parts or packed is stored as it was sent or as it was read; only a plain one has to have its length
        if kind == "response" and declared not in (None, len(payload)) and not {"transfer-encoding", "content-encoding"} & set(inner):
            raise WarcError(f"{own}: a payload of {len(payload)} bytes, {declared} declared")
        if kind == "response":
            _checked(out["payload_digest"], payload, f"{own}: payload")
        elif payload:
            raise WarcError(f"{own}: a revisit with a payload")
        out.update(payload=payload if kind == "response" else None, payload_bytes=len(payload) if kind == "response" else declared)
    elif kind in ("response", "resource", "conversion"):
        _checked(out["payload_digest"], block, f"{own}: payload")
        out.update(payload=block, payload_bytes=len(block))
    if kind == "revisit" and out["payload_digest"] is None and out["refers_to"] is None and "warc-refers-to-target-uri" not in fields:
        raise WarcError(f"{own}: a revisit of nothing")
    if out["payload"] is not None and out["payload_digest"] is None:
        out["payload_digest"] = f"sha1:{_b32(hashlib.sha1(out['payload']).digest())}"
    return out


# --- one archive --------------------------------------------------------------------------------------------------


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first samples themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def write_archive(records: list[bytes], words: bytes) -> bytes:
    kind = zstandard.ZstdCompressionDict(words)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=True).compress
    return struct.pack("<II", SKIPPABLE_MAGIC, len(words)) + words + b"".join(map(pack, records))


def _frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame that begins at `at`, by its header and block headers."""
    if bytes(data[at : at + 4]) != ZSTD_MAGIC:
        raise WarcError(f"no frame at {at}")
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    end = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if end + 3 > len(data):
            raise WarcError(f"frame at {at} is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * checksum
    if end > len(data):
        raise WarcError(f"frame at {at} is cut off")
    return end - at


def read_archive(data: bytes):
    """Each record's bytes, one frame at a time. Skippable frames between them are passed over."""
    view, at, words = memoryview(data), 0, b""
    if len(data) >= 8 and (head := struct.unpack_from("<II", data))[0] == SKIPPABLE_MAGIC:
        if 8 + head[1] > len(data):
            raise WarcError("the dictionary frame is cut off")
        at, words = 8 + head[1], data[8 : 8 + head[1]]
        if words[:4] == ZSTD_MAGIC:
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
    elif data[:4] != ZSTD_MAGIC:
        raise WarcError("neither a dictionary frame nor a record")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 <= len(view) and (head := struct.unpack_from("<II", view, at))[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + head[1]
            if at > len(view):
                raise WarcError("a skippable frame is cut off")
            continue
        length = _frame_length(view, at)
        try:
            # such an object needs no stated size
            yield unpack.decompressobj().decompress(view[at : at + length])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        at += length


# --- tables -------------------------------------------------------------------------------------------------------


def _record_id(page_id: int | None, url: str | None, sha1: str, again: int) -> str:
    """Of the page, and told apart from other rows of that page: by url and payload, or by their number if these are equal too."""
    tag = hashlib.sha1(f"{sha1} {url or ''} {again}".encode()).hexdigest()[:20]
    return f"{'null' if page_id is None else page_id}:{tag}"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) to folder; returns a stored table (uri, records).

    Of rows with equal payloads of at least least_bytes bytes, one with the smallest page_id is a response and all others
    revisit it: of rows that tie, that of the smallest url (null first), and of rows that are equal in all three, one. Rows
    with a null page_id come after all others. Null html is an empty payload. Equal payloads are told by SHA-1 and length.
    Only digests are shuffled to find them, and merged before; of texts only those of wholly equal rows. An empty table gives
    no archives; other columns, whatever their names, are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"sha1": F.sha1(html), "size": F.octet_length(html).cast("long")})
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "url")
    same = ["page_id", "url", "sha1", "size"]
    each = stored(rows.groupBy(*same).agg(F.count("*").alias("times")), f"{folder}/rows")
    first = each.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min(order).alias("first"), F.sum("times").alias("all")).where("all > 1")
    first = first.select(F.col("sha1").alias("f_sha1"), F.col("size").alias("f_size"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))
    first = stored(first, f"{folder}/first")
    repeated = stored(each.where("times > 1").select(*(F.col(c).alias(f"r_{c}") for c in same), "times"), f"{folder}/repeated")
    alike = F.expr(" and ".join(f"{c} <=> r_{c}" for c in same))
    several = rows.join(repeated, alike).groupBy(*same, "times").agg(F.first("html").alias("html"))
    several = several.select("page_id", "url", "html", "sha1", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("again"))
    rows = rows.join(repeated, alike, "left_anti").withColumn("again", F.lit(0).cast("long")).unionByName(several)
    full = rows.join(first, (F.col("sha1") == F.col("f_sha1")) & (F.col("size") == F.col("f_size")), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("again") == 0)
    full = full.select("page_id", "url", "html", "sha1", "again", "first_id", "first_url", (F.coalesce("shared", F.lit(False)) & ~is_first).alias("revisit"))

    def write(batches):
        part = TaskContext.get().partitionId()
        held, size, count = [], 0, 0

        def close():
            nonlocal held, size, count
            sample, total = [], 0
            for r in held:
                if total >= SAMPLE_BYTES:
                    break
                sample.append(r[:65536])
                total += len(sample[-1])
            uri = f"{folder}/{part:06d}-{count:05d}.warc.zst"
            put_file(uri, write_archive(held, dictionary(sample)))
            out = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(held)], pa.int64())], ["uri", "records"])
            held, size, count = [], 0, count + 1
            return out

        for batch in batches:
            for piece in pieces(batch, "html"):
                for page_id, url, html, sha1, again, first_id, first_url, revisit in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    payload = (html or "").encode()
                    held.append(record(_record_id(page_id, url, sha1, again), url, payload, _record_id(first_id, first_url, sha1, 0) if revisit else None, date))
                    size += len(payload)
                    if size >= archive_bytes:
                        yield close()
        if held:
            yield close()

    out = stored(full.mapInArrow(write, "uri string, records long"), f"{folder}/archives")
    for name in ("rows", "first", "repeated"):
        discard(pages.sparkSession, f"{folder}/{name}")
    return out


def _page(record_id: str | None) -> int | None:
    """The page of a record that write_archives() wrote; null for others and for pages without a number."""
    number = (record_id or "").removeprefix("<urn:x-page:").partition(":")[0] if (record_id or "").startswith("<urn:x-page:") else ""
    return int(number) if number.lstrip("-").isdigit() else None


_COLUMNS = {
    "page_id": (pa.int64(), lambda r: _page(r["id"])), "payload_bytes": (pa.int64(), lambda r: r["payload_bytes"]), "payload_digest": (pa.string(), lambda r: (r["payload_digest"] or "").rpartition(":")[2] or None),
    "record_type": (pa.string(), lambda r: r["type"]), "refers_to": (pa.int64(), lambda r: _page(r["refers_to"])),
}
_MORE = {
    "record_id": (pa.string(), lambda r: r["id"]), "refers_to_id": (pa.string(), lambda r: r["refers_to"]), "url": (pa.string(), lambda r: r["url"]), "warc_date": (pa.string(), lambda r: r["date"]),
    "content_type": (pa.string(), lambda r: r["content_type"]), "html": (pa.binary(), lambda r: r["payload"]),
}


def read_archives(archives: DataFrame, payload: bool = False, types: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """Per record of these types (none given: of all): page_id, payload_bytes, payload_digest, record_type, refers_to.

    archives: uri, and records where their number is known, which is then checked. page_id and refers_to are null for
    records of other writers. With payload also record_id, refers_to_id, url, warc_date, content_type and html (the payload;
    null for a revisit). One record is held at a time, and a file.
    """
    columns = _COLUMNS | (_MORE if payload else {})
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join(f"{name} {kinds[kind]}" for name, (kind, _) in columns.items())

    def read(batches):
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (kind, _) in columns.items()], list(columns))
        for batch in batches:
            for uri, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                try:
                    for data in read_archive(get_file(uri)):
                        parsed = parse_record(data)
                        seen += 1
                        if not types or parsed["type"] in types:
                            rows.append({c: value(parsed) for c, (_, value) in columns.items()})
                            size += len(parsed["block"]) if payload else 0
                        if len(rows) == 2000 or size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{uri}, record {seen}: {e}") from e
                if count is not None and seen != count:
                    raise WarcError(f"{uri}: {seen} records, {count} written")
                if rows:
                    yield out(rows)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = F.col("records") if "records" in archives.columns else F.lit(None)
    return archives.select("uri", records.cast("long").alias("records")).repartition(parts, "uri").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and reads them back; the files stay in folder; by default it is one of scratch(), which goes with the process."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes))
