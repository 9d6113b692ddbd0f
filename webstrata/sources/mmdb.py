"""Networks of a MaxMind DB file as a table: a Python data source whose partitions are subtrees of the file's search tree.

The file is a binary tree over address bits, whose leaves point into a data section of typed values that point at each other,
and metadata at the end. The driver reads the metadata and the tree's upper nodes and deals out subtrees; each task walks its
own and decodes each record once (as many records as MEMO at a time), so a large file is read in parallel and no list of
networks exists anywhere. Networks come as CIDR text, IPv4 ones of an IPv6 tree in their own notation and once: aliases of
the IPv4 subtree (mapped, 6to4) lead into the same nodes and are skipped.

The file is opened by path, or by URL in a store that Arrow knows (hdfs, s3, gs), wherever a task runs.
"""

from __future__ import annotations

import ipaddress
import json
import mmap
import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

MARKER = b"\xab\xcd\xefMaxMind.com"
#: Columns with their places in a record, as published for city and network-operator files; fixed values.
FIELDS = {
    "country_code": "country.iso_code", "country_name": "country.names.en", "region": "subdivisions.0.names.en", "city": "city.names.en", "latitude": "location.latitude", "longitude": "location.longitude",
    "postal_code": "postal.code", "timezone": "location.time_zone", "asn": "autonomous_system_number", "asn_org": "autonomous_system_organization",
}
SCHEMA = "network string, country_code string, country_name string, region string, city string, latitude double, longitude double, postal_code string, timezone string, asn long, asn_org string, record string"
BATCH, MEMO, NODES_A_PART, MOST_PARTS = 10_000, 100_000, 1 << 16, 512


def opened(path: str) -> bytes | mmap.mmap:
    """A file's bytes: mapped if it is local, read otherwise."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        from pyarrow.fs import FileSystem

        store, name = FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            return f.read()
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class Section:
    """Values of a data section that begins at `start`; pointers count from there."""

    def __init__(self, data, start: int):
        self.data, self.start = data, start

    def at(self, offset: int, depth: int = 0):
        """The value at an offset from the section's start, and the offset behind it."""
        if depth > 64:
            raise ValueError("a value is nested too deeply")
        data, at = self.data, self.start + offset
        control = data[at]
        at, kind = at + 1, control >> 5
        if kind == 1:  # pointers: 11, 19, 27 or 32 bits, each range beginning where the one before ends
            n = (control >> 3 & 3) + 1
            high = control & 7 if n < 4 else 0
            to = (high << 8 * n) + int.from_bytes(data[at : at + n], "big") + (0, 2048, 526336, 0)[n - 1]
            return self.at(to, depth + 1)[0], at + n - self.start
        if kind == 0:
            kind, at = 7 + data[at], at + 1
        size = control & 31
        if size > 28:
            n = size - 28
            size, at = int.from_bytes(data[at : at + n], "big") + (29, 285, 65821)[n - 1], at + n
        if kind in (7, 11):  # maps and arrays
            return self.many(kind, size, at - self.start, depth)
        if kind == 14:
            return bool(size), at - self.start
        raw, end = bytes(data[at : at + size]), at + size - self.start
        if kind == 2:
            return raw.decode("utf-8", "replace"), end
        if kind == 3:
            return struct.unpack(">d", raw)[0], end
        if kind == 15:
            return struct.unpack(">f", raw)[0], end
        if kind == 4:
            return raw.hex(), end
        if kind == 8:
            return int.from_bytes(raw, "big", signed=size == 4), end
        if kind in (5, 6, 9, 10):
            return int.from_bytes(raw, "big"), end
        raise ValueError(f"no such type of value: {kind}")

    def many(self, kind: int, size: int, offset: int, depth: int):
        out: dict | list = {} if kind == 7 else []
        for _ in range(size):
            if kind == 7:
                key, offset = self.at(offset, depth + 1)
                out[key], offset = self.at(offset, depth + 1)
            else:
                value, offset = self.at(offset, depth + 1)
                out.append(value)
        return out, offset


class Tree:
    """A file's search tree and data."""

    def __init__(self, data):
        self.data = data
        at = data.rfind(MARKER)
        if at < 0:
            raise ValueError("not a MaxMind DB file")
        self.metadata = Section(data, at + len(MARKER)).at(0)[0]
        self.nodes, self.size, self.version = (self.metadata[k] for k in ("node_count", "record_size", "ip_version"))
        if self.size not in (24, 28, 32):
            raise ValueError(f"records of {self.size} bits are not known")
        self.bits = 32 if self.version == 4 else 128
        self.values = Section(data, self.nodes * self.size // 4 + 16)

    def child(self, node: int, right: int) -> int:
        """What a node's side holds: a node's number, the number of nodes (nothing), or more (a record)."""
        width = self.size // 4
        raw = self.data[node * width : (node + 1) * width]
        if self.size == 28:
            middle = raw[3]
            return ((middle & 15) << 24 | int.from_bytes(raw[4:7], "big")) if right else ((middle >> 4) << 24 | int.from_bytes(raw[:3], "big"))
        half = self.size // 8
        return int.from_bytes(raw[half:] if right else raw[:half], "big")

    def four(self) -> int:
        """Where the IPv4 addresses of an IPv6 tree begin."""
        node = 0
        for _ in range(96):
            if node >= self.nodes:
                break
            node = self.child(node, 0)
        return node

    def roots(self) -> list[tuple[int, int, int]]:
        """(node, address bits so far, how many) of the trees that hold every network once."""
        return [(0, 0, 0)] if self.version == 4 else [(self.four(), 0, 96), (0, 0, 0)]

    def step(self, node: int, prefix: int, depth: int, four: int | None) -> Iterator[tuple[int, int, int]]:
        """The children of a node that hold anything, but for the ways into the IPv4 tree."""
        if depth >= self.bits:
            raise ValueError("the tree is deeper than an address")
        for right in (0, 1):
            to = self.child(node, right)
            if to != self.nodes and to != four:
                yield to, prefix | right << (self.bits - 1 - depth), depth + 1

    def split(self, parts: int) -> list[tuple[int, int, int]]:
        """Subtrees and leaves, together all of the tree; at least `parts` from each root, if it has as many."""
        out = []
        for root in self.roots():
            four = self.four() if self.version == 6 and root[2] == 0 else None
            if root[0] == self.nodes or (four is not None and four == 0):
                continue
            queue, leaves = deque([root]), []
            while queue and len(queue) + len(leaves) < parts:
                node = queue.popleft()
                if node[0] > self.nodes:
                    leaves.append(node)
                else:
                    queue.extend(self.step(*node, four))
            out += [*queue, *leaves]
        return out

    def networks(self, start: tuple[int, int, int]) -> Iterator[tuple[str, int]]:
        """(CIDR, offset of its record) of all networks below a node."""
        four = self.four() if self.version == 6 and not (start[1] >> 32 == 0 and start[2] >= 96) else None
        stack = [start]
        while stack:
            node, prefix, depth = stack.pop()
            if node > self.nodes:
                yield self.name(prefix, depth), node - self.nodes - 16
            elif node < self.nodes:
                stack.extend(reversed(list(self.step(node, prefix, depth, four))))

    def name(self, prefix: int, depth: int) -> str:
        if self.version == 4:
            return f"{ipaddress.IPv4Address(prefix)}/{depth}"
        return f"{ipaddress.IPv4Address(prefix)}/{depth - 96}" if depth >= 96 and prefix >> 32 == 0 else f"{ipaddress.IPv6Address(prefix)}/{depth}"


def within(record, path: str):
    for step in path.split("."):
        if isinstance(record, list) and step.isdigit():
            record = record[int(step)] if int(step) < len(record) else None
        else:
            record = record.get(step) if isinstance(record, dict) else None
    return record


@dataclass
class Part(InputPartition):
    starts: list[tuple[int, int, int]]


class MmdbReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        for f in schema:
            if not isinstance(f.dataType, (StringType, DoubleType, LongType, IntegerType)):
                raise ValueError(f"column {f.name} must be a string or a number")

    def path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("no path is given")
        return self.options["path"]

    def partitions(self) -> list[Part]:
        tree = Tree(opened(self.path()))
        wanted = int(self.options.get("partitions") or max(1, min(MOST_PARTS, -(-tree.nodes // NODES_A_PART))))
        starts = tree.split(4 * wanted if wanted > 1 else 1)  # several small ones a task, as subtrees differ
        return [Part(starts[i::wanted]) for i in range(wanted) if starts[i::wanted]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        tree, memo = Tree(opened(self.path())), {}
        kinds = {StringType: pa.string(), DoubleType: pa.float64(), LongType: pa.int64(), IntegerType: pa.int32()}
        target = pa.schema([(f.name, kinds[type(f.dataType)]) for f in self.schema])

        def row(offset: int) -> list:
            record = tree.values.at(offset)[0]
            out = []
            for f in self.schema:
                value = json.dumps(record, ensure_ascii=False, sort_keys=True) if f.name == "record" else within(record, FIELDS.get(f.name, f.name))
                if isinstance(f.dataType, StringType):
                    value = value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
                elif not isinstance(value, (int, float)) or isinstance(value, bool):
                    value = None
                out.append(value)
            return out

        rows: list[tuple[str, list]] = []
        for start in partition.starts:
            for network, offset in tree.networks(start):
                if offset not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[offset] = row(offset)
                rows.append((network, memo[offset]))
                if len(rows) == BATCH:
                    yield self.batch(rows, target)
                    rows = []
        if rows:
            yield self.batch(rows, target)

    def batch(self, rows: list[tuple[str, list]], target: pa.Schema) -> pa.RecordBatch:
        columns = [[n for n, _ in rows] if f.name == "network" else [r[i] for _, r in rows] for i, f in enumerate(self.schema)]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


class MmdbSource(DataSource):
    """spark.read.format("mmdb").load(path). Columns: network, those of FIELDS, record (all of it as JSON), or, by a schema of one's
    own, any place in a record as a column's name (as in `country.names.de`)."""

    @classmethod
    def name(cls) -> str:
        return "mmdb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MmdbReader:
        return MmdbReader(schema, dict(self.options))


def read_mmdb(spark: SparkSession, path: str, schema: str | None = None, partitions: int | None = None) -> DataFrame:
    """The networks of a file; geo.networks() takes them as they are."""
    spark.dataSource.register(MmdbSource)
    reader = spark.read.format("mmdb")
    reader = reader.schema(schema) if schema else reader
    return (reader.option("partitions", partitions) if partitions else reader).load(path)


def metadata(path: str) -> dict:
    """A file's own description: database_type, build_epoch, languages, node_count and more."""
    return Tree(opened(path)).metadata
