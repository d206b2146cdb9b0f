"""Operator 9: WARC records in ZIP packages, read back by range and never unpacked.

Writing: each task streams its rows into packages. A package holds two stored members: the records,
each a gzip member of its own, and an index with one line for each record. Packages always have the
ZIP64 directory, so their size has no limit; a package is closed once it holds PACKAGE bytes.

Reading: from the end of the package the reader finds the end record, through its locator the ZIP64
record, and the central directory. That gives the place of each stored member. The index member then
gives the place of each record, which is read as a range. Response payloads are checked against
their digest.

Of rows with equal payloads of REVISIT bytes or more, those with the least id are responses and the
rest revisits of that id; smaller payloads are responses. A null payload is an empty one. Rows that
repeat an id with an equal payload are all responses if the id is the least. A row with a null id
revisits the least id, and is a response if there is none. An empty table makes no package and no rows.
Columns other than id, url and payload are not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm.common import prepared, written
from pressgauge.session import scratch_path

REVISIT = 100
PACKAGE = 256 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ = 4 << 20
#: The profile that says a revisit has the same payload (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is null for responses."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.where(F.length("payload") >= REVISIT).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    )
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"),
    )


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    uri = "".join(c if c.isprintable() else "%20" for c in url) if url else "urn:page"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {uri}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Packer:
    """Writes stored members one after the other; sizes follow each member, as it is streamed."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        wide = struct.pack("<HHQQ", 1, 16, 0, 0)  # says that the sizes that follow have 8 bytes
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name.encode()), len(wide)))
        self._put(name.encode() + wide)

    def add(self, data: bytes) -> None:
        member = self.members[-1]
        member[2] = zlib.crc32(data, member[2])
        member[3] += len(data)
        self._put(data)

    def close_member(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def finish(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            wide = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack(
                "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF,
                len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF,
            ) + name + wide)
        end, n = self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


_PACKED = "path string, bytes bigint, records bigint"


def _write(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    done: list[tuple[str, int, int]] = []
    state: dict = {}

    def close() -> None:
        packer = state["packer"]
        packer.close_member()
        packer.open(INDEX)
        for line in state["index"]:
            packer.add(line)
        packer.close_member()
        packer.finish()
        state["file"].close()
        done.append((state["path"], packer.at, len(state["index"])))
        state.clear()

    for batch in rows:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if not state:
                # a name of its own for each attempt: only listed packages count
                path = f"{base}/{uuid.uuid4().hex}.wacz"
                file = store.open_output_stream(path)
                state.update(path=f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", file=file, packer=Packer(file), index=[], at=0)
                state["packer"].open(RECORDS)
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            data = squeeze.compress(record(*row)) + squeeze.flush()
            line = {"id": row[0], "offset": state["at"], "length": len(data)}
            state["index"].append(json.dumps(line).encode() + b"\n")
            state["packer"].add(data)
            state["at"] += len(data)
            if state["at"] >= PACKAGE:
                close()
    if state:
        close()
    if done:
        paths, sizes, counts = zip(*done)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"]
        )


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``decided`` into packages below ``folder``, a folder that all executors share.

    Returns the list of packages (path, bytes, records), itself a written table: a package that a
    lost or repeated task left behind is in no list.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    prepared(records.sparkSession)
    rows = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return written(rows.mapInArrow(lambda part: _write(part, folder), _PACKED), "warc-packages")


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """(start, length) of each stored member of a package, from its directories."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        sign, _, wide_at, _ = struct.unpack_from("<IIQI", tail, end - 20)
        if sign != 0x07064B50:
            raise ValueError("no locator of a ZIP64 directory")
        wide = file.read_at(56, wide_at)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    listing, at, out = file.read_at(length, start), 0, {}
    for _ in range(count):
        method, = struct.unpack_from("<H", listing, at + 10)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", listing, at + 20)
        place, = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + name_n].decode()
        extra = listing[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 8-byte values for those that didn't fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            extra = extra[4 + n :]
        if method:
            raise ValueError(f"{name} is compressed; members must be stored")
        local = file.read_at(30, place)
        skip = sum(struct.unpack_from("<HH", local, 26))
        out[name] = place + 30 + skip, packed
        at += 46 + name_n + extra_n + note_n
    return out


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, digest, type, refers_to, payload) of a record."""
    top, _, block = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = block[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") else None
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    refers = number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    return number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, payload


def records_of(path: str, size: int) -> Iterator[tuple]:
    """All records of a package; records that lie side by side share a read of READ bytes or so."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as file:
        places = members(file, size)
        index_at, index_n = places[INDEX]
        lines = [json.loads(x) for x in file.read_at(index_n, index_at).splitlines()]
        base = places[RECORDS][0]
        while lines:
            n, total = 0, 0
            while n < len(lines) and (not n or total + lines[n]["length"] <= READ):
                total += lines[n]["length"]
                n += 1
            group, lines = lines[:n], lines[n:]
            first = group[0]["offset"]
            data = file.read_at(group[-1]["offset"] + group[-1]["length"] - first, base + first)
            for x in group:
                yield parsed(zlib.decompress(data[x["offset"] - first : x["offset"] - first + x["length"]], 31))


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def read_packages(packages: DataFrame, payload: bool = False) -> DataFrame:
    """The records of listed packages (path, bytes); with ``payload`` also what each holds."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows, held = [], 0
                for row in records_of(path, size):
                    rows.append(row if payload else row[:5])
                    held += len(row[5]) if payload else 0
                    if len(rows) >= 4096 or held >= READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=schema)

    schema = _READ if payload else pa.schema(list(_READ)[:5])
    told = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    # One package a partition: the list is short and its rows stand for much work.
    many = max(1, packages.count())
    spread = packages.select("path", "bytes").repartitionByRange(many, "path")
    return spread.mapInArrow(read, told + ", payload binary" * payload)


def packages_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
