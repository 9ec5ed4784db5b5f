"""Recorded message logs: bag files of format 2.0, read chunk by chunk from their index.

A bag ends with an index: its connections (topic, type, definition) and, for
every chunk, where it lies, when it starts and ends and how many messages of
which connection it holds. The data source plans one partition per chunk from
that index alone; filters on topic and time are pushed down to it, so chunks
without a wanted message are never opened. Inside a chunk only the message
headers of unwanted ones are touched.

    spark.dataSource.register(BagSource)
    spark.read.format("bag").option("path", folder).load().where("topic = 'scan'")

Rows are (topic, type, conn, time_ns, data, file, chunk); ``time_ns`` counts
from the epoch. Messages come ordered by time within a chunk; ``in_order`` is
the merge over chunks and files, a sort by range that no single task does.
``subscribe`` reads bags as they come into a folder, as a stream with offsets.
``decoded`` turns data into columns by the definition the bag carries.

Defined results: a bag without messages gives no rows; empty data stays empty;
of messages at one time, order is by file, then place; a file that is no bag, a
bag that was never closed (no index), or an unknown compression raises; null
topics or times can't be written and raise.
"""

from __future__ import annotations

import bz2
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..snapshot import cut, shared_dir

#: Fixed values of the format.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
HEADER_BYTES = 4096
#: Bytes of messages in a chunk, and in a bag that is written: it is closed in memory, for its head comes last.
CHUNK_BYTES, BAG_BYTES = 768 << 10, 64 << 20

SCHEMA = "topic string, type string, conn int, time_ns long, data binary, file string, chunk long"
ARROW = pa.schema([("topic", pa.string()), ("type", pa.string()), ("conn", pa.int32()), ("time_ns", pa.int64()), ("data", pa.binary()), ("file", pa.string()), ("chunk", pa.int64())])


def _fields(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        name, _, value = raw[at + 4 : at + 4 + n].partition(b"=")
        out[name.decode()] = value
        at += 4 + n
    return out


def _record(raw, at: int) -> tuple[dict[str, bytes], int, int]:
    """Fields of the record at an offset, and where its data start and end."""
    (n,) = struct.unpack_from("<I", raw, at)
    (size,) = struct.unpack_from("<I", raw, at + 4 + n)
    start = at + 8 + n
    return _fields(bytes(raw[at + 4 : at + 4 + n])), start, start + size


def _number(value: bytes, kind: str = "<I") -> int:
    return struct.unpack(kind, value)[0]


def _nanos(value: bytes) -> int:
    s, n = struct.unpack("<II", value)
    return s * 1_000_000_000 + n


@dataclass(frozen=True)
class Connection:
    conn: int
    topic: str
    type: str
    definition: str


@dataclass(frozen=True)
class ChunkInfo:
    at: int
    start: int
    end: int
    counts: dict[int, int]


def open_store(path: str):
    """The filesystem of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def bag_files(path: str) -> list[str]:
    """The bags that a path names: itself, or those of a folder in order of name."""
    store, own = open_store(path)
    info = store.get_file_info(own)
    if info.type != pafs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(own)] if path.endswith(own) else ""
    return sorted(head + x.path for x in store.get_file_info(pafs.FileSelector(own)) if x.path.endswith(".bag"))


def read_index(path: str) -> tuple[dict[int, Connection], list[ChunkInfo]]:
    """Connections and chunks of a bag, from its head and its end alone."""
    store, own = open_store(path)
    with store.open_input_file(own) as f:
        head = f.read_at(len(MAGIC) + HEADER_BYTES, 0)
        if not head.startswith(MAGIC):
            raise ValueError(f"{path} is no bag of format 2.0")
        fields, _, _ = _record(head, len(MAGIC))
        start = _number(fields["index_pos"], "<Q")
        if not start:
            raise ValueError(f"{path} was not closed: it has no index")
        raw = f.read_at(f.size() - start, start)
    connections, chunks, at = {}, [], 0
    while at < len(raw):
        fields, data, at = _record(raw, at)
        op = fields["op"][0]
        if op == CONNECTION:
            more, conn = _fields(raw[data:at]), _number(fields["conn"])
            connections[conn] = Connection(conn, fields["topic"].decode(), more["type"].decode(), more["message_definition"].decode())
        elif op == CHUNK_INFO:
            counts = dict(struct.iter_unpack("<II", raw[data:at]))
            chunks.append(ChunkInfo(_number(fields["chunk_pos"], "<Q"), _nanos(fields["start_time"]), _nanos(fields["end_time"]), counts))
    return connections, chunks


class ChunkPartition(InputPartition):
    """A chunk of a file, and what of it is wanted: topics and types by connection, and the span of time."""

    def __init__(self, file: str, at: int, topics: dict[int, tuple[str, str]], low: int, high: int):
        super().__init__((file, at))
        self.file, self.at, self.topics, self.low, self.high = file, at, topics, low, high


class BagReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [x for x in options.get("paths", options.get("path", "")).split("\n") if x]
        self.topics: set[str] | None = None
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("topic",) and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.topics = values if self.topics is None else self.topics & values
            elif name == ("time_ns",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        """One for each chunk that holds a wanted topic and reaches into the wanted time."""
        out = []
        for path in self.paths:
            for file in bag_files(path):
                connections, chunks = read_index(file)
                wanted = {c.conn: (c.topic, c.type) for c in connections.values() if self.topics is None or c.topic in self.topics}
                out += [ChunkPartition(file, c.at, wanted, self.low, self.high) for c in chunks if c.start <= self.high and c.end >= self.low and any(c.counts.get(k) for k in wanted)]
        return out or [ChunkPartition("", 0, {}, 0, 0)]

    def read(self, part: ChunkPartition) -> Iterator[pa.RecordBatch]:
        if part.file:
            yield from chunk_rows(part)


def chunk_rows(part: ChunkPartition) -> Iterator[pa.RecordBatch]:
    """The wanted messages of a chunk in order of time."""
    store, own = open_store(part.file)
    with store.open_input_file(own) as f:
        (n,) = struct.unpack("<I", f.read_at(4, part.at))
        fields = _fields(f.read_at(n, part.at + 4))
        (size,) = struct.unpack("<I", f.read_at(4, part.at + 4 + n))
        raw = f.read_at(size, part.at + 8 + n)
    how = fields["compression"].decode()
    if how == "bz2":
        raw = bz2.decompress(raw)
    elif how == "lz4":
        raw = pa.CompressedInputStream(pa.BufferReader(raw), "lz4").read()
    elif how != "none":
        raise ValueError(f"unknown compression {how}")
    found, at = [], 0
    while at < len(raw):
        fields, data, at = _record(raw, at)
        if fields["op"][0] == MESSAGE:
            conn, when = _number(fields["conn"]), _nanos(fields["time"])
            if conn in part.topics and part.low <= when <= part.high:
                found.append((*part.topics[conn], conn, when, raw[data:at], part.file, part.at))
    found.sort(key=lambda x: x[3])
    for k in range(0, len(found), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found[k : k + 10_000], strict=True), ARROW, strict=True)], schema=ARROW)


class BagSource(DataSource):
    """Options: ``path``, a bag or a folder of bags; or ``paths``, several, one a line."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BagReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BagSubscription(self.options)


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """The messages of bags or folders of bags; filters on topic and time_ns reach their indexes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BagSource)
    return spark.read.format("bag").option("paths", "\n".join(paths)).load()


def in_order(messages: DataFrame) -> DataFrame:
    """All messages merged by time."""
    return messages.orderBy("time_ns", "file", "chunk", "conn")


# writing


def _pack(fields: dict[str, bytes], data: bytes) -> bytes:
    head = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(head)) + head + struct.pack("<I", len(data)) + data


def _stamp(ns: int) -> bytes:
    return struct.pack("<II", *divmod(ns, 1_000_000_000))


def bag_bytes(messages: Iterator[tuple[str, str, int, bytes]], definitions: dict[str, str], compression: str = "none", chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A bag of (topic, type, time_ns, data), piece by piece: the head comes last and belongs at offset 0, where a blank one comes first."""

    def head(index: int, connections: int, chunks: int) -> bytes:
        fields = {"op": bytes([HEADER]), "index_pos": struct.pack("<Q", index), "conn_count": struct.pack("<I", connections), "chunk_count": struct.pack("<I", chunks)}
        bare = len(_pack(fields, b""))
        return MAGIC + _pack(fields, b" " * (HEADER_BYTES - bare))

    known: dict[str, tuple[int, bytes]] = {}
    infos, at = [], len(head(0, 0, 0))
    yield head(0, 0, 0)
    held, index, times, fresh = bytearray(), {}, [], True

    def close() -> bytes:
        body = bz2.compress(bytes(held)) if compression == "bz2" else bytes(held)
        out = _pack({"op": bytes([CHUNK]), "compression": compression.encode(), "size": struct.pack("<I", len(held))}, body)
        infos.append((at, min(times), max(times), {c: len(v) for c, v in index.items()}))
        for conn, entries in sorted(index.items()):
            out += _pack({"op": bytes([INDEX]), "ver": struct.pack("<I", 1), "conn": struct.pack("<I", conn), "count": struct.pack("<I", len(entries))}, b"".join(_stamp(t) + struct.pack("<I", o) for t, o in entries))
        return out

    for topic, kind, when, data in messages:
        if topic not in known:
            conn = len(known)
            more = {"topic": topic.encode(), "type": kind.encode(), "md5sum": b"*", "message_definition": definitions.get(kind, "").encode()}
            body = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in more.items())
            known[topic] = conn, _pack({"op": bytes([CONNECTION]), "conn": struct.pack("<I", conn), "topic": topic.encode()}, body)
            held += known[topic][1]
        conn = known[topic][0]
        index.setdefault(conn, []).append((when, len(held)))
        times.append(when)
        held += _pack({"op": bytes([MESSAGE]), "conn": struct.pack("<I", conn), "time": _stamp(when)}, data)
        fresh = False
        if len(held) >= chunk_bytes:
            piece = close()
            yield piece
            at += len(piece)
            held, index, times, fresh = bytearray(), {}, [], True
    if not fresh:
        piece = close()
        yield piece
        at += len(piece)
    tail = b"".join(raw for _, raw in known.values())
    for where, first, last, counts in infos:
        fields = {"op": bytes([CHUNK_INFO]), "ver": struct.pack("<I", 1), "chunk_pos": struct.pack("<Q", where), "start_time": _stamp(first), "end_time": _stamp(last), "count": struct.pack("<I", len(counts))}
        tail += _pack(fields, b"".join(struct.pack("<II", c, n) for c, n in sorted(counts.items())))
    yield tail
    yield head(at, len(known), len(infos))


def write_log(messages: DataFrame, definitions: dict[str, str], compression: str = "none", chunk_bytes: int = CHUNK_BYTES) -> list[str]:
    """Writes (topic, type, time_ns, data) as bags of about BAG_BYTES, each of one partition in its order, into a new shared folder; the files.

    A file's name is new at every attempt, and only those that the tasks which counted report are returned, so attempts
    that were lost leave nothing behind that is read. Paths go to the driver, one a bag.
    """
    folder = f"{shared_dir(messages.sparkSession)}/bags-{uuid.uuid4().hex}"
    store, own = open_store(folder)
    store.create_dir(own, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, own = open_store(folder)

        def bag(held: list[tuple]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.bag"
            pieces = list(bag_bytes(iter(held), definitions, compression, chunk_bytes))
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(pieces[-1])
                for piece in pieces[1:-1]:
                    f.write(piece)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["file"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("topic", "type", "time_ns", "data")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BAG_BYTES:
                    yield bag(held)
                    held, size = [], 0
        if held:
            yield bag(held)

    return sorted(r.file for r in cut(messages.select("topic", "type", "time_ns", "data").mapInArrow(run, "file string"), "manifest").collect())


# definitions

#: The format's plain types, how they are packed, and what they are in Spark.
PLAIN = {
    "bool": ("?", "boolean"), "int8": ("b", "int"), "uint8": ("B", "int"), "byte": ("b", "int"), "char": ("B", "int"), "int16": ("h", "int"), "uint16": ("H", "int"), "int32": ("i", "int"),
    "uint32": ("I", "long"), "int64": ("q", "long"), "uint64": ("Q", "decimal(20,0)"), "float32": ("f", "double"), "float64": ("d", "double"),
}


def parse_definition(text: str) -> dict[str, list[tuple[str, str]]]:
    """Fields (type, name) of the message ('' in the result) and of those it is made of, by their names; constants are left out."""
    out, now = {"": []}, ""
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line.startswith("MSG:"):
            now = line[4:].strip()
            out[now] = []
        elif line and not line.startswith("=") and "=" not in line:
            kind, name = line.split()[:2]
            out[now].append(("std_msgs/Header" if kind == "Header" else kind, name))
    return out


def _made_of(known: dict, kind: str) -> list[tuple[str, str]]:
    found = known.get(kind) or next((v for k, v in known.items() if k.split("/")[-1] == kind.split("/")[-1] and k), None)
    if found is None:
        raise ValueError(f"the definition has no {kind}")
    return found


def spark_type(known: dict, kind: str) -> str:
    if kind.endswith("]"):
        return "binary" if kind.split("[")[0] in ("uint8", "char") else f"array<{spark_type(known, kind.split('[')[0])}>"
    if kind in PLAIN:
        return PLAIN[kind][1]
    if kind in ("time", "duration", "string"):
        return "string" if kind == "string" else "long"
    return f"struct<{','.join(f'{n}:{spark_type(known, k)}' for k, n in _made_of(known, kind))}>"


def decode(known: dict, kind: str, raw: bytes, at: int):
    """A value of a type at an offset, and where it ends."""
    if kind.endswith("]"):
        base, _, n = kind[:-1].partition("[")
        if n:
            n = int(n)
        else:
            (n,) = struct.unpack_from("<I", raw, at)
            at += 4
        if base in ("uint8", "char"):
            return raw[at : at + n], at + n
        if base in PLAIN:
            code = f"<{n}{PLAIN[base][0]}"
            return list(struct.unpack_from(code, raw, at)), at + struct.calcsize(code)
        out = []
        for _ in range(n):
            x, at = decode(known, base, raw, at)
            out.append(x)
        return out, at
    if kind in PLAIN:
        code = "<" + PLAIN[kind][0]
        return struct.unpack_from(code, raw, at)[0], at + struct.calcsize(code)
    if kind == "string":
        (n,) = struct.unpack_from("<I", raw, at)
        return raw[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n
    if kind in ("time", "duration"):
        s, n = struct.unpack_from("<II" if kind == "time" else "<ii", raw, at)
        return s * 1_000_000_000 + n, at + 8
    out = {}
    for inner, name in known[""] if not kind else _made_of(known, kind):
        out[name], at = decode(known, inner, raw, at)
    return out, at


def decoded(messages: DataFrame, definition: str) -> DataFrame:
    """topic, time_ns and column ``message`` of messages of one type, by its definition (a connection's)."""
    known = parse_definition(definition)
    schema = f"topic string, time_ns long, message struct<{','.join(f'{n}:{spark_type(known, k)}' for k, n in known[''])}>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema)).field("message").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(known, "", x, 0)[0] for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("topic"), batch.column("time_ns"), pa.array(found, arrow)], ["topic", "time_ns", "message"])

    return messages.select("topic", "time_ns", "data").mapInArrow(run, schema)


def connections(*paths: str) -> list[Connection]:
    """What the bags record, each topic once."""
    found = {c.topic: c for path in paths for file in bag_files(path) for c in read_index(file)[0].values()}
    return [found[k] for k in sorted(found)]


# subscriptions


class BagSubscription(DataSourceStreamReader):
    """Bags that come into a folder, in order of their names; an offset is the name of the last one read.

    Between two offsets the same chunks are planned and read whenever they are asked for, so a restart from a
    checkpoint loses and repeats nothing. With ``newest`` a chunk gives of each topic only its newest message.
    """

    def __init__(self, options):
        self.path, self.newest = options["path"], str(options.get("newest", "false")).lower() == "true"
        self.topics = {x for x in options.get("topics", "").split(",") if x}

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = bag_files(self.path)
        return {"after": files[-1].rpartition("/")[2] if files else ""}

    def partitions(self, start: dict, end: dict):
        out = []
        for file in bag_files(self.path):
            if start["after"] < file.rpartition("/")[2] <= end["after"]:
                known, chunks = read_index(file)
                wanted = {c.conn: (c.topic, c.type) for c in known.values() if not self.topics or c.topic in self.topics}
                out += [ChunkPartition(file, c.at, wanted, 0, (1 << 63) - 1) for c in chunks if any(c.counts.get(k) for k in wanted)]
        return out

    def read(self, part: ChunkPartition) -> Iterator[pa.RecordBatch]:
        last: dict[str, pa.RecordBatch] = {}
        for batch in chunk_rows(part):
            if not self.newest:
                yield batch
                continue
            for i, topic in enumerate(batch.column("topic").to_pylist()):
                last[topic] = batch.slice(i, 1)
        yield from last.values()


def subscribe(spark: SparkSession, folder: str, topics: list[str] | None = None, newest: bool = False) -> DataFrame:
    """A stream of the messages of bags that come into a folder. Later ones must have greater names, and come whole."""
    spark.dataSource.register(BagSource)
    return spark.readStream.format("bag").option("path", folder).option("topics", ",".join(topics or ())).option("newest", newest).load()


def conflated(messages: DataFrame) -> DataFrame:
    """Of each topic the newest message: what a queue of depth one holds. For a batch, or each batch of a stream."""
    row = F.struct("time_ns", "file", "chunk", "conn", "type", "data")
    return messages.groupBy("topic").agg(F.max_by(row, F.struct("time_ns", "file", "chunk")).alias("m")).select("topic", "m.*")
