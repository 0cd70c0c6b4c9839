"""WARC archives of pages and a two-level capture index.

Pages become records of gzip-compressed WARC files, equal payloads after the first as revisits. The index sorts captures by
reversed-host key into compressed blocks; a sparse directory holds each block's first key. A lookup searches the directory,
reads one block by its range, searches it, and reads the record by its range.

Files are written and read by the tasks through Arrow's file systems, below the folder all machines share. A task names its
files after itself and a random part and reports them in its rows, so files of lost or repeated attempts are never referred to.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import fresh_folder, written

BLOCK_LINES = 1000
MAX_FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 0  # payloads of at least so many bytes are revisited
CAPTURE = "surt string, page_id bigint, file string, offset bigint, length bigint"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query as they are; blanks percent-encoded."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//)?", "", (url or "").strip()).split("#", 1)[0]
    authority, _, path = rest.partition("/")
    if "?" in authority:
        authority, _, query = authority.partition("?")
        path = f"?{query}"
    host, _, port = authority.rsplit("@", 1)[-1].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")/" + path
    return quote(key, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") if re.search(r"[\x00-\x20\x7f]", key) else key


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 the format's digest


def target(url: str) -> str:
    return quote(url, safe=chr(34) + '!#$%&()*+,-./:;<=>?@[]^_`{|}~' + chr(39) + chr(92))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, compressed as a gzip member of its own. A revisit holds the response's head without the payload.

    A page without an id has a record id of its own, to which nothing refers.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of a compressed record; checks lengths and, for a response, the payload's digest."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("broken record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    whole = kind == "response"
    if whole and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    number = lambda x: None if x.startswith("<urn:uuid:") else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest, "payload_bytes": size,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if whole else None,
    }


class Files:
    """Open files of one folder, the last few kept."""

    def __init__(self, folder: str, most: int = 16) -> None:
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.most = most

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(name)
        return self.open[name].read_at(length, offset)

    def write(self, name: str):
        self.system.create_dir(self.path, recursive=True)
        return self.system.open_output_stream(f"{self.path}/{name}", compression=None)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, sha, refers_to): pages whose payload a page with a smaller id has too, or any with an id for a page without."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    all_ = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= least).select("page_id", "sha").distinct()
    first = all_.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return all_.join(first, "sha").where("not (page_id <=> refers_to)")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``; returns the captures, written as a table."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.col("html"), F.sha1(body.cast("binary")).alias("sha"))
    to = revisits(pages, least).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to")
    rows = rows.join(to, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, out, at = Files(folder), None, None, 0
        for b in batches:
            made = []
            for page, url, text, to in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or at >= max_file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.write(name)
                payload = (text or "").encode()
                raw = record(page, url, payload, payload_digest(payload), to)
                out.write(raw)
                made.append({"surt": surt(url), "page_id": page, "file": name, "offset": at, "length": len(raw)})
                at += len(raw)
            yield pa.RecordBatch.from_pylist(made, schema=CAPTURES)
        if out is not None:
            out.close()

    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, CAPTURE), "captures")


CAPTURES = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PART = pa.schema([("first_surt", pa.string()), ("first_id", pa.int64()), ("blocks", pa.string()), ("directory", pa.string()), ("directory_bytes", pa.int64())])


def _key(surt_: str, page_id: int | None) -> tuple[bytes, int]:
    return surt_.encode(), -(1 << 63) - 1 if page_id is None else page_id  # pages without an id come first


def _id(text: str) -> int | None:
    return int(text) if text else None


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Write the index of ``captures`` below ``folder``; returns its parts in key order, one entry per range of keys."""
    parts = max(1, -(-captures.count() // 500_000))
    order = ["surt", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(min(parts, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = Files(folder), uuid.uuid4().hex
        out, at, lines, directory = None, 0, [], []

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join("\t".join("" if y is None else str(y) for y in x) for x in lines).encode())
            out.write(raw)
            directory.append(f"{lines[0][0]}\t{'' if lines[0][1] is None else lines[0][1]}\t{at}\t{len(raw)}")
            at += len(raw)
            lines.clear()

        for b in batches:
            out = out or files.write(f"index-{name}.blocks")
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(x)
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            raw = "\n".join(directory).encode()
            with files.write(f"index-{name}.directory") as d:
                d.write(raw)
            first = directory[0].split("\t")
            yield pa.RecordBatch.from_pylist([dict(zip(PART.names, (first[0], _id(first[1]), f"index-{name}.blocks", f"index-{name}.directory", len(raw)), strict=True))], schema=PART)

    found = ranged.mapInArrow(run, "first_surt string, first_id bigint, blocks string, directory string, directory_bytes bigint").collect()
    return sorted((tuple(r) for r in found), key=lambda r: _key(r[0], r[1]))  # one row per range of keys


class Index:
    """Lookups in the index files; the last directory and block stay, as sorted requests meet them again."""

    def __init__(self, folder: str, parts: list[tuple]) -> None:
        self.files, self.parts = Files(folder), parts
        self.firsts = [_key(p[0], p[1]) for p in parts]
        self.kept: OrderedDict[tuple, object] = OrderedDict()

    def _once(self, key: tuple, load):
        if key not in self.kept:
            self.kept[key] = load()
            if len(self.kept) > 8:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def _directory(self, p: int):
        def load():
            rows = [x.split("\t") for x in self.files.read(self.parts[p][3], 0, self.parts[p][4]).decode().split("\n")]
            return [_key(r[0], _id(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]

        return self._once(("d", p), load)

    def _block(self, p: int, offset: int, length: int):
        def load():
            rows = [x.split("\t") for x in zlib.decompress(self.files.read(self.parts[p][2], offset, length)).decode().split("\n")]
            return [_key(r[0], _id(r[1])) for r in rows], [(r[2], int(r[3]), int(r[4])) for r in rows]

        return self._once(("b", p, offset), load)

    def find(self, surt_: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; a run of equal keys may span blocks and parts."""
        key, out = _key(surt_, page_id), []
        p = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while p < len(self.parts) and self.firsts[p] <= key:
            firsts, places = self._directory(p)
            d = max(bisect.bisect_left(firsts, key) - 1, 0)
            while d < len(firsts) and firsts[d] <= key:
                keys, rows = self._block(p, *places[d])
                out += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                d += 1
            p += 1
        return out


def read_tasks(captures: DataFrame) -> int:
    """Tasks that read all captures back: 4 MB of archive each, as many as a shuffle has; beyond that 256 MB each."""
    size = captures.agg(F.sum("length")).first()[0] or 0
    usual = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-size // (4 << 20)), max(usual, -(-size // (256 << 20)))))


def read_captures(requests: DataFrame, folder: str, parts: list[tuple], payload: bool = False, tasks: int | None = None) -> DataFrame:
    """The archived records of distinct requests (url, page_id), found through the index and read by range.

    A request with an id is one for the key of its URL and that id, whatever scheme the URL has; pages without an id are told
    apart by their URL. Requests are dealt to ``tasks`` tasks, in key order inside each.
    Columns page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (of responses) where asked for.
    """
    spark = requests.sparkSession
    shared = spark.sparkContext.broadcast(parts)  # one entry per half a million captures
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])])

    wanted = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, ids = (c.to_pylist() for c in b.columns)
            plain = [target(u) if p is None and u is not None else "" for u, p in zip(urls, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in urls], pa.string()), pa.array(ids, pa.int64()), pa.array(plain, pa.string())], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archives = Index(folder, shared.value), Files(folder)
        for b in batches:
            out, size = [], 0
            for key, page, url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                named = page is not None
                for place in index.find(key, page if named else None):
                    found = parse_record(archives.read(*place))
                    if not named and (found["url"] or "") != url:
                        continue
                    out.append(found)
                    size += len(out[-1]["payload"] or b"") if payload else 0
                    if not payload:
                        out[-1]["payload"] = None
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payload else "")
    columns = ("key", "page_id", "url")
    asked = requests.select("url", F.col("page_id").cast("bigint")).mapInArrow(keys, "key string, page_id bigint, url string")
    asked = asked.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).distinct().sortWithinPartitions(*columns)
    return asked.mapInArrow(run, kinds)


def archive(pages: DataFrame, least: int = LEAST_REVISIT, payload: bool = False, block_lines: int = BLOCK_LINES, unnamed: bool = False) -> DataFrame:
    """Write the pages to archives, index them, and read every page back through the index.

    page_id must be an integer; rows without one are archived where ``unnamed`` says so: as revisits of the page that has their payload and
    the smallest id, as responses where no page with an id has it; a null html is an empty payload; a null url is left out of the record. Of equal
    payloads of at least ``least`` bytes the smallest page_id is the response; rows repeated under that id are responses too.
    Repeated rows each have a record. An empty table gives no rows and no files. Other columns are not archived.
    """
    folder = fresh_folder(pages.sparkSession, "warc")
    if not unnamed:
        pages = pages.where("page_id is not null")
    captures = write_archives(pages, folder, least)
    return read_captures(pages, folder, build_index(captures, folder, block_lines), payload, read_tasks(captures))
