"""WARC archives: writing, reading, and revisit resolution by payload digest.

``write`` makes one gzip member per record in files of bounded size.
``headers`` and ``scan`` list the records of archives from the archives themselves. ``resolve`` shuffles headers only:
equal payloads of at least ``least_bytes`` keep one response, that with the
largest id, and the others become revisit records that refer to it. Revisit
records that the input already has are joined to the original responses by
digest, whatever their size. ``rewrite`` then streams every archive through one task, which copies
payloads of responses and writes fresh headers; payloads are never shuffled.

Archives of other writers may be read too (``headers``, ``rewrite``). Their responses are known by their
payload's SHA-1, declared or not; unless they become revisits, their records are copied as they are, as
is every record that is neither response nor revisit (warcinfo, request, ...). A response whose declared
digest is not its payload's, as stored, takes no part and is copied; if it is one of ours, that raises.
A revisit needs no more than a digest; it stays as it is if no response in the archives has that.

Files are written under the session's shared folder (or any folder that
``pyarrow.fs`` opens) under names made anew at each attempt, and only those
in the manifest, which Spark's committer writes, are ever read: a lost
executor leaves an unread file, not a wrong record.

Defined results: null html is an empty payload; null page ids and repeated rows
are records of their own (a null id is the smallest); of equal payloads with equal largest ids
one response stays, that of the greatest record id, which is made anew in every run; the length of a
revisit of another writer is its response's, null without one; empty tables give no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Uncompressed bytes after which a writer begins another file.
FILE_BYTES = 32 << 20
LEAST_BYTES = 1000
#: Tasks that archives are dealt to at most; beyond that a task streams several, one after another.
MAX_TASKS = 100_000
LEVEL = 1
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, record long, page_id long, kind string, payload_bytes long, digest string, record_id string, refers_to string"
#: Fixed value: what a record is dated, as the input has no date.
DATE = "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    clean = [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in fields]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "replace") for k, v in [*clean, ("Content-Length", str(len(block)))])])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def response(page: str, url: str, payload: bytes, digest: str, rid: str) -> bytes:
    head = [
        ("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", base32(digest)),
        ("X-Page-ID", page), ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(head, http(payload) + payload)


def revisit(page: str, url: str, length: int, digest: str, rid: str, to: str, to_page: str, date: str = DATE) -> bytes:
    head = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", base32(digest)),
        ("WARC-Refers-To", to), ("WARC-Profile", PROFILE), ("X-Page-ID", page), ("X-Refers-To-Page-ID", to_page), ("X-Payload-Length", str(length)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names lower-cased), block, and gzip member of each record of an archive, from its bytes or an open file."""
    read = io.BytesIO(source).read if isinstance(source, bytes | memoryview) else source.read
    view, at = memoryview(read(1 << 20)), 0
    while len(view):
        unpack, pieces, own = zlib.decompressobj(31), [], []
        while not unpack.eof:
            if at == len(view):
                view, at = memoryview(read(1 << 20)), 0
                if not len(view):
                    raise ValueError("the archive ends within a record")
            some = view[at : at + 16_384]
            pieces.append(unpack.decompress(some))
            used = len(some) - len(unpack.unused_data)
            own.append(bytes(some[:used]))
            at += used
        raw = b"".join(pieces)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])], b"".join(own)
        if at == len(view):
            view, at = memoryview(read(1 << 20)), 0


def declared(f: dict[str, str]) -> str | None:
    """The payload's SHA-1 in hex, if the header has one."""
    kind, _, value = f.get("warc-payload-digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return bytes.fromhex(value).hex() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def described(where: str, f: dict[str, str], block: bytes) -> tuple[int | None, str, int | None, str | None]:
    """Page id, type, payload bytes and digest of a record; without a digest it takes no part."""
    page, kind, digest = int(f["x-page-id"]) if f.get("x-page-id") else None, f["warc-type"], declared(f)
    if kind == "response":
        body = payload(block)
        real = hashlib.sha1(body).hexdigest()
        if digest not in (None, real):
            if "x-page-id" in f:
                raise ValueError(f"{where}: the payload doesn't match its digest")
            return page, kind, len(body), None
        return page, kind, len(body), real
    if kind == "revisit":
        return page, kind, int(f["x-payload-length"]) if f.get("x-payload-length") else None, digest
    return page, kind, None, None


def payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class _Writer:
    """Appends members to files of bounded size in a folder, which may be in any store pyarrow.fs opens."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.file, self.path, self.size, self.n = folder, None, "", 0, 0

    def add(self, data: bytes, weight: int) -> tuple[str, int]:
        if self.file is None or self.size + weight > FILE_BYTES:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.file = self.fs.open_output_stream(f"{self.base}/{name}", compression=None)
            self.path, self.size, self.n = f"{self.folder}/{name}", 0, 0
        self.file.write(data)
        self.size += weight
        self.n += 1
        return self.path, self.n - 1

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _folder(spark: SparkSession, name: str) -> str:
    from pyarrow import fs

    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return folder


def _manifest(df: DataFrame, folder: str) -> DataFrame:
    """Run the writers once; what their committed tasks list is what exists."""
    df.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/manifest")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in MANIFEST.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives with a response record per row; gives their manifest (a record per row)."""
    spark = pages.sparkSession
    folder = _folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder)
        try:
            for batch in batches:
                found = []
                for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    data = html.as_py() or b""
                    digest = hashlib.sha1(data).hexdigest()
                    rid = record_id("response", uuid.uuid4())
                    path, n = out.add(response("" if page is None else str(page), url.as_py() or "", data, digest, rid), len(data))
                    found.append((path, n, page, "response", len(data), digest, rid, None))
                if found:
                    yield _rows(found)
        finally:
            out.close()

    cols = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).cast("binary").alias("h"))
    return _manifest(cols.mapInArrow(run, MANIFEST), folder)


def _header_rows(path: str, source) -> list[tuple]:
    """The manifest's rows of one archive, from its records."""
    found = []
    for n, (f, block, _) in enumerate(records(source)):
        page, kind, length, digest = described(f"record {n} of {path}", f, block)
        found.append((path, n, page, kind, length, digest, f.get("warc-record-id"), f.get("warc-refers-to")))
    return found


def _file(path: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    return store.open_input_stream(base, compression=None)


def _dealt(paths: DataFrame) -> DataFrame:
    """Distinct paths of archives, about one a task up to MAX_TASKS: dealt by number, which adaptive execution leaves as it is."""
    return paths.repartition(max(1, min(MAX_TASKS, paths.count())))


def headers(archives: DataFrame) -> DataFrame:
    """The manifest of archives given as (path, content) rows, read from the records themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if found := _header_rows(path, content.as_py()):
                    yield _rows(found)

    return archives.mapInArrow(run, MANIFEST)


def scan(manifest: DataFrame) -> DataFrame:
    """The manifest anew, from the headers of the archives that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _file(path) as f:
                    found = _header_rows(path, f)
                if found:
                    yield _rows(found)

    return cut(_dealt(manifest.select("path").distinct()).mapInArrow(run, MANIFEST), "headers")


def resolve(manifest: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(path, record, to_id, to_page, bytes) of the records that become revisits, or refer anew. Only headers move.

    A revisit in the input takes part like a response of its payload, but only a response can be kept;
    a revisit with no response of its digest in the archives stays as it is.
    """
    order = F.struct("page_id", F.col("record_id").alias("id"), F.col("payload_bytes").alias("bytes"))
    best = manifest.where("kind = 'response' and digest is not null").groupBy("digest").agg(F.max(order).alias("best"))
    both = manifest.where((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))).select("path", "record", "record_id", "digest")
    joined = both.join(best, "digest").where(~F.col("record_id").eqNullSafe(F.col("best.id")))
    return joined.select("path", "record", F.col("best.id").alias("to_id"), F.col("best.page_id").alias("to_page"), F.col("best.bytes").alias("bytes"))


def rewrite(manifest: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Deduplicated archives with fresh headers; gives their manifest. One task streams an archive, and holds a record of it."""
    spark = manifest.sparkSession
    folder = _folder(spark, "dedup")
    # per archive, the numbers of its records that turn, at most a file's worth
    turns = resolve(manifest, least_bytes).groupBy("path").agg(F.collect_list(F.struct("record", "to_id", "to_page", "bytes")).alias("turns"))
    paths = manifest.select("path").distinct()
    plan = paths.join(turns, "path", "left").select("path", *[F.col(f"turns.{k}").alias(k) for k in ("record", "to_id", "to_page", "bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder)
        try:
            for batch in batches:
                for path, *listed in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    turn = {n: x for n, *x in zip(*(x or () for x in listed), strict=True)}
                    found = []
                    with _file(path) as f:
                        for n, (f, block, member_bytes) in enumerate(records(f)):
                            page, kind, length, digest = described(f"record {n} of {path}", f, block)
                            named, url, rid, to, to_page = "" if page is None else str(page), f.get("warc-target-uri", ""), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("x-refers-to-page-id")
                            new = member_bytes
                            if n in turn:
                                to, to_page, length = turn[n]
                                to_page, kind = "" if to_page is None else str(to_page), "revisit"
                                new = revisit(named, url, length, digest, rid, to, to_page, f.get("warc-date", DATE))
                            elif "x-page-id" in f and kind == "revisit":
                                new = revisit(named, url, length, digest, rid, to, to_page or "", f.get("warc-date", DATE))
                            elif "x-page-id" in f and kind == "response":
                                new = response(named, url, payload(block), digest, rid)
                            at, k = out.add(new, len(block))
                            found.append((at, k, page, kind, length, digest, rid, to_page or None))
                            if len(found) == 10_000:
                                yield _rows(found)
                                found = []
                    if found:
                        yield _rows(found)
        finally:
            out.close()

    return _manifest(_dealt(plan).mapInArrow(run, MANIFEST), folder)


def read(manifest: DataFrame) -> DataFrame:
    """Every response and revisit of the manifest's archives, read back from the files: page_id, url, kind, payload (null for a revisit), payload_bytes, digest, refers_to page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found, held = [], 0
                with _file(path) as source:
                    for n, (f, block, _) in enumerate(records(source)):
                        page, kind, length, digest = described(f"record {n} of {path}", f, block)
                        if kind not in ("response", "revisit"):
                            continue
                        body = payload(block) if kind == "response" else None
                        to = f.get("x-refers-to-page-id", "")
                        found.append((page, f.get("warc-target-uri", ""), kind, body, length, digest, int(to) if to else None))
                        held += len(body or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return _dealt(manifest.select("path").distinct()).mapInArrow(run, "page_id long, url string, kind string, payload binary, payload_bytes long, digest string, refers_to long")
