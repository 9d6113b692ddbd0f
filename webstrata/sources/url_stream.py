"""A URL list as a stream of bounded batches: a streaming Python data source whose offsets are lines.

Each trigger admits the next `linesPerTrigger` lines at most, so what is in flight is bounded by a number of URLs and not by
files, and a list of any length starts at once. An offset is a line's number and the byte where it begins; the driver only
counts line ends ahead of it, and tasks read byte ranges, each a share of the batch. A query that starts again goes on from
the offset in its checkpoint. A trigger of what is available now takes one batch.

The list is opened by path, or by URL in a store that Arrow knows. A list that is still being written is followed: with
`follow` a last line without an end waits for it; without, it counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from webstrata.sources.urls import described, lines

PER_TRIGGER, PER_TASK, BLOCK = 10_000, 2_500, 1 << 16


def opened(path: str) -> AbstractContextManager:
    """A file that can be read from any byte."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        from pyarrow.fs import FileSystem

        store, name = FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path, "rb")


@dataclass
class Lines(InputPartition):
    """The lines from one byte to another; the first has the number `line`."""

    line: int
    start: int
    end: int


class LineReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ValueError("no path is given")
        self.path, self.follow = options["path"], str(options.get("follow", "false")).lower() == "true"
        self.most, self.share = int(options.get("linesPerTrigger", PER_TRIGGER)), int(options.get("linesPerTask", PER_TASK))
        if self.most < 1 or self.share < 1:
            raise ValueError("at least one line is needed for a trigger and for a task")
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0}

    def marks(self, start: dict, most: int, until: int | None = None) -> Iterator[dict]:
        """Offsets behind each `share` lines from an offset on, and behind the last of at most `most`; bytes from `until` on don't count."""
        line, byte, behind = start["line"], start["byte"], start["byte"]
        marked = line
        with opened(self.path) as f:
            f.seek(byte)
            while line < start["line"] + most and (until is None or byte < until):
                block = f.read(BLOCK if until is None else min(BLOCK, until - byte))
                if not block:
                    if byte > behind and not self.follow:  # a last line without an end
                        line, behind = line + 1, byte
                    break
                at = block.find(b"\n")
                while at >= 0 and line < start["line"] + most:
                    line, behind = line + 1, byte + at + 1
                    if line - marked == self.share:
                        marked = line
                        yield {"line": line, "byte": behind}
                    at = block.find(b"\n", at + 1)
                byte += len(block)
        if line > marked:
            yield {"line": line, "byte": behind}

    def latestOffset(self) -> dict:
        """The end of the next batch; the same one until that batch is planned."""
        end = self.at
        for end in self.marks(self.at, self.most):
            pass
        return end

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        # Spark also calls this with an empty range, to say where a query that starts again has come to
        self.at = end
        out, last = [], start
        if end["byte"] > start["byte"]:
            for mark in self.marks(start, end["line"] - start["line"], end["byte"]):
                out.append(Lines(last["line"], last["byte"], mark["byte"]))
                last = mark
            if last["byte"] < end["byte"]:
                out.append(Lines(last["line"], last["byte"], end["byte"]))
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            f.seek(partition.start)
            raw = f.read(partition.end - partition.start)
        texts = raw.split(b"\n")
        if raw.endswith(b"\n"):
            texts.pop()
        values = [t.removesuffix(b"\r").decode("utf-8", "replace") for t in texts]
        yield pa.record_batch([pa.array(range(partition.line, partition.line + len(values)), pa.int64()), pa.array(values, pa.string())], names=["line_number", "value"])


class LineSource(DataSource):
    """spark.readStream.format("url_lines").option("linesPerTrigger", n).load(path), as (line_number from 0, value)."""

    @classmethod
    def name(cls) -> str:
        return "url_lines"

    def schema(self) -> str:
        return "line_number long, value string"

    def streamReader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)  # whose keys match in any case


def stream_lines(spark: SparkSession, path: str, per_trigger: int = PER_TRIGGER, per_task: int = PER_TASK, follow: bool = False) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.readStream.format("url_lines").option("linesPerTrigger", per_trigger).option("linesPerTask", per_task).option("follow", str(follow).lower()).load(path)


def stream_url_list(spark: SparkSession, path: str, per_trigger: int = PER_TRIGGER, follow: bool = False) -> DataFrame:
    """The URLs of a list as read_urls() describes them, at most `per_trigger` lines in flight."""
    return described(lines(stream_lines(spark, path, per_trigger, follow=follow)))
