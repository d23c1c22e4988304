"""Operator 6, WARC: ZIP-packaged archives, read by byte ranges.

``write_archives`` groups pages into archives of about ``ARCHIVE_BYTES``.  An archive is a ZIP file with stored members:
archive/data.warc.gz (the records, each packed by itself), indexes/index.cdxj (one JSON line per record: offset and length) and datapackage.json.  A task writes its archive under another name
in the shared folder and renames it, so a repeated task replaces equal bytes.

``read_archives`` opens an archive for random access, parses the end record, the ZIP64 records if any, the central directory and the
members' local headers, reads every index below indexes/, and then ranges of neighbouring records of every member below archive/; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.text import partitions, table

ARCHIVE_BYTES, RANGE_BYTES, GZIP_LEVEL = 16 << 20, 4 << 20, 4
ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP header, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {''.join(c if c.isprintable() and c != ' ' else '%20' for c in url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def pack_archive(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP file of stored members; sizes are kept in ZIP64 fields where they need it.  Each record is packed by itself, so that a range can be read alone."""
    index, at, packed = [], 0, []
    for page_id, plain in records:
        data = gzip.compress(plain, GZIP_LEVEL, mtime=0)
        packed.append(data)
        index.append(json.dumps({"page": page_id, "filename": DATA.removeprefix(ARCHIVES), "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((DATA, packed), (INDEX, ["\n".join(index).encode()]), ("datapackage.json", [json.dumps({"profile": "data-package", "resources": [DATA, INDEX]}).encode()])):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()


Ranges = Callable[[int, int], bytes]


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def _zip64(extra: bytes, fields: list[int]) -> list[int]:
    """Replace the fields that hold all ones by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [values.pop(0) if f == 0xFFFFFFFF and values else f for f in fields]
        at += 4 + size
    return fields


def directory(read: Ranges, size: int) -> dict[str, Member]:
    """Members of a ZIP file by name, from its central directory."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == b"PK\6\7":
        where = struct.unpack_from("<Q", locator, 8)[0]
        end = read(where, 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("broken ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    data, at, out = read(offset, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, full, n, m, c = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + n].decode()
        full, packed, header = _zip64(data[at + 46 + n : at + 46 + n + m], [full, packed, header])
        out[name] = Member(name, method, packed, header)
        at += 46 + n + m + c
    return out


def data_start(read: Ranges, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = read(member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the payload of one record."""
    fields = lambda lines: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(lines[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("latin-1").split("\r\n")[1:]), payload


def index_entries(name: str, data: bytes, files: dict[str, Member]) -> Iterator[tuple[str, int, int, dict]]:
    """(member, offset, length, entry) of an index's lines: JSON alone, or key, time and JSON.  An entry names its file, unless there is only one."""
    for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode().split("\n"):
        at = line.find("{")
        if at < 0 or line.startswith("!"):  # blank, or about the index itself
            continue
        e = json.loads(line[at:])
        file = e.get("filename") or (next(iter(files)) if len(files) == 1 else "")
        member = file if file in files else f"{ARCHIVES}{file}"
        if member not in files:
            raise ValueError(f"{name}: no member {file!r}")
        yield member, int(e["offset"]), int(e["length"]), e


def records_of(read: Ranges, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int | None, bytes]]:
    """Every record of a package: all members below archive/ by all indexes below indexes/, in the order of names and places.

    Neighbours of a member are read in one range of up to ``most`` bytes; records of a .gz member are unpacked one by one.  A member that is not
    stored, one without an entry, and an entry without its member end in a ValueError: no record is passed over.
    """
    members = directory(read, size)
    files = {n: m for n, m in members.items() if n.startswith(ARCHIVES) and not n.endswith("/") and m.size}
    entries: set[tuple[str, int, int]] = set()
    pages: dict[tuple[str, int, int], int | None] = {}
    for name, m in members.items():
        if name.startswith(INDEXES) and not name.endswith(("/", ".idx")):  # .idx lists the blocks of another index
            for member, offset, length, e in index_entries(name, read(data_start(read, m), m.size), files):
                entries.add((member, offset, length))
                pages[member, offset, length] = e.get("page")
    for name in files.keys() - {e[0] for e in entries}:
        raise ValueError(f"{name} is in no index")
    base = {n: data_start(read, m) for n, m in files.items()}
    ordered, i = sorted(entries), 0
    while i < len(ordered):
        j, (member, start, _) = i, ordered[i]
        while j + 1 < len(ordered) and ordered[j + 1][0] == member and ordered[j + 1][1] + ordered[j + 1][2] - start <= most:
            j += 1
        data = read(base[member] + start, max(o + n for _, o, n in ordered[i : j + 1]) - start)
        for e in ordered[i : j + 1]:
            one = data[e[1] - start : e[1] - start + e[2]]
            yield pages[e], gzip.decompress(one) if member.endswith(".gz") else one
        i = j + 1


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and return a settled table (archive, path, records).

    Null html is an empty payload, null url an empty one.  Of equal payloads of at least ``least_bytes`` bytes the one of largest page_id is the
    response; the rest are revisits.  A page without page_id, and one that repeats the response's own id with the same payload, is a
    response of its own.  Other columns are ignored; an empty table writes nothing.  ``folder`` is a URI every executor reaches.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    light = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    total = light.agg(F.sum("n")).head()[0] or 0
    n_archives = max(2 * partitions(spark), -(-total // archive_bytes))
    response = light.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "response")
    revisit = light.where(F.col("n") >= least_bytes).select("page_id", "digest").distinct().join(response, "digest").where("page_id <> response").select("page_id", "digest", "response")
    # payloads are shuffled once; which of them are revisits comes beside them, without payload
    archive = F.pmod(F.xxhash64("page_id", "digest"), F.lit(n_archives)).alias("archive")
    none = lambda kind: F.lit(None).cast(kind)
    dealt = rows.select(archive, "page_id", "url", "payload", "digest", none("long").alias("response")).unionByName(
        revisit.select(archive, "page_id", none("string").alias("url"), none("binary").alias("payload"), "digest", "response"))

    def write(t: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        name = f"archive-{t.column('archive')[0].as_py():06d}.wacz"
        out = []
        each = t.to_pylist()
        response = {(r["page_id"], r["digest"]): r["response"] for r in each if r["payload"] is None}
        for r in sorted((r for r in each if r["payload"] is not None), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["digest"], r["url"])):
            digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
            out.append((r["page_id"], record(r["page_id"], r["url"], r["payload"], digest, response.get((r["page_id"], r["digest"])), date)))
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(part) as f:
            f.write(pack_archive(out))
        fs.move(part, f"{root}/{name}")
        return pa.table({"archive": t.column("archive")[:1], "path": pa.array([f"{folder}/{name}"]), "records": pa.array([len(out)], pa.int64())})

    return table(dealt.repartition(n_archives, "archive").groupBy("archive").applyInArrow(write, "archive long, path string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; a revisit's payload is null.

    A response's length and digest are those of the bytes read; a revisit's come from its headers.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda uri: int(x) if (x := uri.strip("<>").rpartition(":")[2]) else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    rows, size = [], 0
                    for _, data in records_of(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        warc, http, payload = parse_record(data)
                        if warc["warc-type"] == "response":
                            rows.append((page(warc["warc-record-id"]), warc["warc-target-uri"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None, payload))
                        else:
                            rows.append((page(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), "revisit", page(warc["warc-refers-to"]), None))
                        size += len(payload)
                        if size > RANGE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
