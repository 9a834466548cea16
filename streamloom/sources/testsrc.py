"""A Python data source of synthetic video and audio frames: ``spark.read.format("testsrc")``.

Options: kind (video or audio), pattern (gradient, bars, solid), frames, width, height. Each partition makes a range of frames; frames are made
from their number alone, so a partition read again gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Luma of the eight bars, from white to black.
BARS = (235, 210, 170, 145, 106, 81, 41, 16)


class _Frames(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.pattern = options.get("kind", "video"), options.get("pattern", "gradient")
        if self.kind not in ("video", "audio") or self.pattern not in ("gradient", "bars", "solid"):
            raise ValueError(f"no test source of kind {self.kind} and pattern {self.pattern}")
        self.frames, self.width, self.height = (int(options.get(k, d)) for k, d in (("frames", 10), ("width", 16), ("height", 9)))
        self.parts = int(options.get("partitions", 4))

    def partitions(self):
        size = max(1, -(-self.frames // self.parts))
        return [_Frames(i, min(self.frames, i + size)) for i in range(0, self.frames, size)]

    def read(self, partition):
        for n in range(partition.start, partition.stop):
            if self.kind == "audio":  # a tone of 440 Hz in frames of 20 ms at 48 kHz
                yield n, n * 960, [int(8000 * math.sin(2 * math.pi * 440 * (n * 960 + i) / 48000)) for i in range(960)]
            else:
                yield n, n, [self._luma(n, x, y) for y in range(self.height) for x in range(self.width)]

    def _luma(self, n, x, y):
        if self.pattern == "bars":
            return BARS[x * 8 // self.width]
        return (x + y + 3 * n if self.pattern == "gradient" else n) % 256


class TestSource(DataSource):
    __test__ = False

    @classmethod
    def name(cls):
        return "testsrc"

    def schema(self):
        return "frame long, pts long, samples array<int>"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TestSource)
