"""Web archives: a converter from the older ARC format to WARC, and readers and writers of both.

ARC files carry a version block that names their header fields; the parser follows it (version 1 has five
fields in a record's header line, version 2 has ten) and reads each document by its declared length. The
converter makes an equivalent WARC record of each: an identifier from what the record holds, the date in
ISO form, the type, the digests of payload and block. Of records with equal payloads of ``least_bytes`` or
more, the one with the largest key is kept as response and the others become revisits of it.

Archives are gzip members, a record each, in the folder that all machines share. A task writes files under
new names and lists them in its result; only files listed by tasks that ended count, so a lost executor
leaves nothing behind that is read. A file holds ``FILE_BYTES`` of records or a little more.

Special cases: a null page is an empty payload; a null address becomes ``urn:unknown``, spaces in addresses
are escaped. Equal keys with equal payloads are all responses if theirs is the largest key. A null key counts
as the smallest; if no record of a payload has a key, all are responses. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrain.llm.session import shared_folder, stored

FILE_BYTES = 32 << 20
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20200101000000"
KEY = "X-Page-Id"
_NAMES = uuid.UUID("5c8a1c5e-5f0a-5a55-9d0e-3c1f2b7a9d10")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


# --- ARC ---


def arc_head(version: int, name: str, date: str = DATE) -> bytes:
    block = f"{version} 0 tillgrain\n{ARC_FIELDS[version]}\n\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str | None, kind: str, document: bytes, name: str, offset: int, ip: str = "0.0.0.0", date: str = DATE, status: int = 200) -> bytes:
    address = (url or "urn:unknown").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
    more = "" if version == 1 else f"{status} {hashlib.md5(document).hexdigest()} - {offset} {name} "
    return f"{address} {ip} {date} {kind} {more}{len(document)}\n".encode("utf-8", "surrogatepass") + document + b"\n"


def read_arc(file) -> Iterator[dict]:
    """Records of an ARC file (plain or decompressed stream): the header fields by name, and the document."""
    line = file.readline()
    head = line.decode("utf-8", "replace").rstrip("\n").split(" ")
    if not head[0].startswith("filedesc:"):
        raise ValueError("an ARC file begins with a filedesc record")
    block = file.read(int(head[-1])).decode("utf-8", "replace").split("\n")
    version, fields = int(block[0].split(" ")[0]), block[1].split(" ")
    if version not in ARC_FIELDS or fields != ARC_FIELDS[version].split(" "):
        raise ValueError(f"unknown ARC version block: {block[:2]}")
    while line := file.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogatepass").rstrip("\r\n").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"an ARC version {version} header has {len(fields)} fields: {line[:200]!r}")
        record = dict(zip(fields, values, strict=True))
        record["document"] = file.read(int(record["Archive-length"]))
        if len(record["document"]) != int(record["Archive-length"]):
            raise ValueError("the ARC file ends inside a document")
        yield record


# --- HTTP messages, as both formats hold them ---


def http_message(key: int | None, payload: bytes) -> bytes:
    named = "" if key is None else f"{KEY}: {key}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(message: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields by lower-case name, the header bytes, the payload."""
    end = message.find(b"\r\n\r\n")
    head, payload = (message[: end + 4], message[end + 4 :]) if end >= 0 else (b"", message)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return {k.lower(): v for k, v in fields.items()}, head, payload


# --- WARC ---


def record_id(key: int | None, digest: str, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{key} {digest} {url} {date}')}>"


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def convert(record: dict, refers: tuple[int, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record. ``refers``: key, address and date of the record that it revisits."""
    http, head, payload = http_parts(record["document"])
    key = int(http[KEY.lower()]) if KEY.lower() in http else None
    digest, date = base32_sha1(payload), warc_date(record["Archive-date"])
    block = record["document"] if refers is None else head
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest, record["URL"], record["Archive-date"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers[0], digest, refers[1], refers[2])),
            ("WARC-Refers-To-Target-URI", refers[1]),
            ("WARC-Refers-To-Date", warc_date(refers[2])),
            ("X-Refers-To-Page", str(refers[0])),
        ]
    return warc_record(fields, block)


def read_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC stream: header fields by lower-case name, and the block."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            fields[name.lower()] = value
        block = file.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("the WARC file ends inside a record")
        yield fields, block


# --- files in the shared folder ---


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _open(path: str):
    files, at = _store(path)
    return gzip.GzipFile(fileobj=io.BufferedReader(files.open_input_file(at), 1 << 20))


class _Roll:
    """Writes records to files of about FILE_BYTES each, under new names."""

    def __init__(self, folder: str, suffix: str, head=None):
        self.folder, self.suffix, self.head, self.out, self.done = folder, suffix, head, None, []

    def add(self, make) -> None:
        if self.out is None or self.size >= FILE_BYTES:
            self.close()
            self.name = f"{uuid.uuid4().hex}.{self.suffix}"
            files, at = _store(self.folder)
            files.create_dir(at, recursive=True)
            self.out, self.size, self.count, self.at = files.open_output_stream(f"{at}/{self.name}", compression=None), 0, 0, 0
            if self.head:
                self._put(self.head(self.name))
        data = make(self.name, self.at)
        self._put(data)
        self.size += len(data)
        self.count += 1

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.count))
            self.out = None


_LIST = "path string, records long"


def _listed(done: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])


def write_arcs(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> DataFrame:
    """Write ARC files; their paths and record counts. Without a version, tasks take turns at both."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = version or 1 + (TaskContext.get().partitionId() % 2)
        roll = _Roll(folder, "arc.gz", lambda name: arc_head(v, name))
        for batch in batches:
            for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                message = http_message(k, (h or "").encode("utf-8", "surrogatepass"))
                roll.add(lambda name, at: arc_record(v, u, "text/html", message, name, at))
        roll.close()
        if roll.done:
            yield _listed(roll.done)

    return stored(pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html).alias("h")).mapInArrow(write, _LIST))


def _spread(files: DataFrame) -> DataFrame:
    """A task for each file, or for a few."""
    return files.repartition(max(1, min(10_000, files.count())))


def index_arcs(arcs: DataFrame) -> DataFrame:
    """A row for each ARC record: path, number in the file, key, url, date, payload digest (hexadecimal) and bytes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as file:
                    for i, record in enumerate(read_arc(file)):
                        http, _, payload = http_parts(record["document"])
                        k = http.get(KEY.lower())
                        rows.append((path, i, None if k is None else int(k), record["URL"], record["Archive-date"], hashlib.sha1(payload).hexdigest(), len(payload)))
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "number", "k", "url", "date", "sha1", "bytes"), r, strict=True)) for r in rows], _INDEX)

    return _spread(arcs).mapInArrow(index, "path string, number long, k long, url string, date string, sha1 string, bytes long")


_INDEX = pa.schema([("path", pa.string()), ("number", pa.int64()), ("k", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("sha1", pa.string()), ("bytes", pa.int64())])


def convert_arcs(arcs: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Write WARC files of all ARC records; their paths and record counts. No payload is shuffled: what a file's records
    revisit is, and the task of that file reads it again."""
    index = stored(index_arcs(arcs))
    kept = index.where(F.col("k").isNotNull() & (F.col("bytes") >= least_bytes)).groupBy("sha1", "bytes").agg(F.max(F.struct("k", "url", "date")).alias("best"), F.count(F.lit(1)).alias("n"))
    several = index.groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "bytes")
    revisits = index.join(kept.drop("n").join(several, ["sha1", "bytes"], "left_semi"), ["sha1", "bytes"]).where("k IS NULL OR k < best.k")
    plan = arcs.select("path", F.lit(None).cast("long").alias("number"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("date"))
    plan = plan.unionByName(revisits.select("path", "number", F.col("best.k").alias("k"), F.col("best.url").alias("url"), F.col("best.date").alias("date")))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        path = rows["path"].iloc[0]
        rows = rows.dropna(subset=["number"])
        refers = {int(n): (int(k), u, d) for n, k, u, d in zip(rows["number"], rows["k"], rows["url"], rows["date"], strict=True)}
        roll = _Roll(folder, "warc.gz")
        with _open(path) as file:
            for i, record in enumerate(read_arc(file)):
                roll.add(lambda name, at: convert(record, refers.get(i)))
        roll.close()
        return pd.DataFrame(roll.done, columns=["path", "records"])

    # a partition number of our own: these few rows stand for whole files, and small partitions must not be merged
    dealt = plan.repartition(max(1, min(10_000, arcs.count())), "path")
    return stored(dealt.groupBy("path").applyInPandas(write, _LIST))


def read_warcs(warcs: DataFrame) -> DataFrame:
    """A row for each record: key, payload_bytes, payload_digest, record_type, refers_to, url, date. A response whose payload
    doesn't have the digest that its header names is an error."""
    schema = pa.schema([("k", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as file:
                    for fields, block in read_warc(file):
                        http, _, payload = http_parts(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: {fields['warc-record-id']} doesn't have its payload")
                        k, to = http.get(KEY.lower()), fields.get("x-refers-to-page")
                        rows.append((None if k is None else int(k), int(http["content-length"]), digest, fields["warc-type"], None if to is None else int(to), fields["warc-target-uri"], fields["warc-date"]))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return _spread(warcs).mapInArrow(read, "k long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC files and back: what ``read_warcs`` gives."""
    folder = shared_folder(pages.sparkSession)
    arcs = write_arcs(pages, f"{folder}/arc", key=key, url=url, html=html)
    return read_warcs(convert_arcs(arcs, f"{folder}/warc", least_bytes=least_bytes))
