"""A push source: a function pushes messages and is told what became of each.

``rows_of`` runs the function against a bounded queue and gives its messages; ``push_frame`` makes a DataFrame of many
such functions, one a partition; ``PushStream`` is the same as a streaming source, a poll a batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "stream string, n long, kind string, pts_ns long, key boolean, payload binary"
DELIVERED, DROPPED, CLOSED = "delivered", "dropped", "closed"


class Push:
    """Takes messages until the end of stream; ``room`` bounds what waits, ``oldest`` says which goes when it is full."""

    def __init__(self, stream: str, room: int = 0, oldest: bool = False):
        self.stream, self.room, self.oldest = stream, room, oldest
        self.waiting: deque = deque()
        self.n, self.ended = 0, False

    def _put(self, kind: str, pts, key, payload) -> str:
        if self.ended:
            return CLOSED
        row = (self.stream, self.n, kind, pts, key, payload)
        self.n += 1
        if self.room and len(self.waiting) >= self.room:
            if not self.oldest:
                return DROPPED
            self.waiting.popleft()
        self.waiting.append(row)
        return DELIVERED

    def packet(self, payload: bytes, pts_ns: int, key: bool = False) -> str:
        return self._put("packet", pts_ns, key, bytes(payload))

    def frame(self, payload: bytes, pts_ns: int) -> str:
        return self._put("frame", pts_ns, None, bytes(payload))

    def event(self, name: str, pts_ns: int | None = None) -> str:
        return self._put("event", pts_ns, None, name.encode())

    def eos(self) -> str:
        told = self._put("eos", None, None, None)
        self.ended = True
        return told

    def taken(self) -> Iterator[tuple]:
        while self.waiting:
            yield self.waiting.popleft()


def rows_of(function: Callable[[Push], object], stream: str, room: int = 0, oldest: bool = False) -> Iterator[tuple]:
    """The rows that a function pushes. A generator yields where its messages may be taken; the end of the function is
    the end of the stream."""
    push = Push(stream, room, oldest)
    for _ in function(push) or ():
        yield from push.taken()
    push.ended or push.eos()
    yield from push.taken()


def push_frame(spark: SparkSession, functions: dict[str, Callable[[Push], object]], room: int = 0, oldest: bool = False) -> DataFrame:
    """Messages of one function a stream; each runs in a task of its own, again if the task is lost."""
    import pyarrow as pa

    names = sorted(functions)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = list(rows_of(functions[names[i]], names[i], room, oldest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, SCHEMA)


class _Polls(SimpleDataSourceStreamReader):
    def __init__(self, function: Callable[[Push, int], object], stream: str, most: int):
        self.function, self.stream, self.most = function, stream, most

    def initialOffset(self):
        return {"poll": 0}

    def _poll(self, k: int) -> list[tuple]:
        push = Push(f"{self.stream}")
        self.function(push, k)
        return list(push.taken())

    def read(self, start):
        k = start["poll"]
        return iter(self._poll(k) if k < self.most else []), {"poll": min(k + 1, self.most)}

    def readBetweenOffsets(self, start, end):
        for k in range(start["poll"], end["poll"]):
            yield from self._poll(k)


def stream_source(name: str, function: Callable[[Push, int], object], polls: int) -> type[DataSource]:
    """A streaming data source of that name: batch k has what function(push, k) pushes, for k below ``polls``; a batch that
    is read again after a failure has the same."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def simpleStreamReader(self, schema):
            return _Polls(function, name, polls)

    return Source
