"""Containers as Python data sources: ``spark.read.format("ivf" | "matroska" | "mp4").load(path)``.

``df.write.format("ivf").save(path)`` writes rows (stream, pts, payload) as a file a stream, <stream>.ivf.

Rows are packets: path, track, n (place in the track), pts and dts in nanoseconds, duration, key, codec, payload. A file
is read by one task as a stream (of MP4, its sample tables are in memory); small files share tasks. Paths are read
through Arrow's file systems (local, hdfs, s3, gs), so executors open them as the driver does. A file that is cut off
gives the packets before the cut; one that isn't of the format raises.
"""

from __future__ import annotations

import io
import struct
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, track long, n long, pts_ns long, dts_ns long, duration_ns long, key boolean, codec string, payload binary"
SECOND = 1_000_000_000
#: Bytes of tables that a file may ask for.
TABLES = 1 << 30
#: Bytes of files that a task reads, what opening a file counts as (so at most 256 files a task).
SHARE, OPENING = 32 << 20, 128 << 10
#: Rows, and bytes of payload, from which a task gives a batch out; bytes from which it writes.
ROWS, BATCH = 10_000, 4 << 20
#: Bytes that are read ahead in a file.
PIECE = 64 << 10


class Cut(Exception):
    """The bytes end within an element."""


def exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Cut
    return data


def ivf(f):
    """(track, n, pts, dts, duration, key, codec, payload) of an IVF file."""
    head = exactly(f, 32)
    signature, _, size, codec, _, _, rate, scale = struct.unpack("<4sHH4sHHII", head[:24])
    if signature != b"DKIF" or not rate:
        raise ValueError("not an IVF file")
    exactly(f, max(0, size - 32))
    n = 0
    while True:
        length, pts = struct.unpack("<IQ", exactly(f, 12))
        at = pts * scale * SECOND // rate
        yield 0, n, at, at, None, None, codec.decode("latin-1").strip("\0 ").lower(), exactly(f, length)
        n += 1


# Element identifiers of Matroska.
SEGMENT, CLUSTER, TIME, BLOCK, GROUP, GROUPED, LENGTH, REFERENCE, INFO, SCALE, TRACKS, ENTRY, NUMBER, CODEC, DEFAULT = (
    0x18538067, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x86, 0x23E383,
)
_OPEN = {SEGMENT, CLUSTER, GROUP, INFO, TRACKS, ENTRY}


def vint(f, marked: bool) -> tuple[int, int]:
    """(value, bytes) of a variable-length integer; identifiers keep their mark. Size -1 is unknown."""
    first = exactly(f, 1)[0]
    if not first:
        raise ValueError("a variable-length integer of more than eight bytes")
    width = 9 - first.bit_length()
    value = int.from_bytes(bytes([first]) + exactly(f, width - 1), "big")
    if marked:
        return value, width
    value -= 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), width


def laced(data: bytes) -> list[bytes]:
    """The frames of a block's bytes behind its track, time and flags."""
    flags, rest = data[0], data[1:]
    kind = flags >> 1 & 3
    if not kind:
        return [rest]
    count, f = rest[0] + 1, io.BytesIO(rest[1:])
    sizes = []
    if kind == 1:  # Xiph
        for _ in range(count - 1):
            size = 0
            while (b := exactly(f, 1)[0]) == 255:
                size += 255
            sizes.append(size + b)
    elif kind == 3:  # EBML
        for k in range(count - 1):
            value, width = vint(f, False)
            sizes.append(value if not k else sizes[-1] + value - (1 << 7 * width - 1) + 1)
    else:
        sizes = [(len(rest) - 1) // count] * (count - 1)
    return [exactly(f, s) for s in sizes] + [f.read()]


def matroska(f):
    """The same of a Matroska or WebM file; segments and clusters may be of unknown size."""
    if vint(f, True)[0] != 0x1A45DFA3:
        raise ValueError("not a Matroska file")
    exactly(f, vint(f, False)[0])
    scale, time, tracks, counts, entry, group = 1_000_000, 0, {}, {}, {}, {}

    def block(data, key, duration):
        g = io.BytesIO(data)
        track, _ = vint(g, False)
        at = (time + int.from_bytes(exactly(g, 2), "big", signed=True)) * scale
        rest = g.read()
        frames, own = laced(rest), tracks.get(track, {})
        step = duration // len(frames) if duration is not None else own.get("default")
        for k, payload in enumerate(frames):
            n = counts[track] = counts.get(track, -1) + 1
            pts = at + k * (step or 0)
            yield track, n, pts, pts, step, bool(rest[0] & 0x80) if key is None else key, own.get("codec"), payload

    def closed(name):
        if name == GROUP and group.get("data") is not None:
            yield from block(group["data"], "reference" not in group, group.get("duration"))
        if name == ENTRY and "number" in entry:
            tracks[entry["number"]] = entry

    # open elements as (identifier, place where it ends or -1); one of unknown size ends where its parent's next element starts
    stack: list[tuple[int, int]] = []
    while True:
        here = f.tell()
        while stack and 0 <= stack[-1][1] <= here:
            yield from closed(stack.pop()[0])
        try:
            name, _ = vint(f, True)
        except Cut:
            for open_, _ in reversed(stack):
                yield from closed(open_)
            return
        size, _ = vint(f, False)
        if name in (CLUSTER, TRACKS, INFO):
            while stack and stack[-1][0] != SEGMENT:
                yield from closed(stack.pop()[0])
        if name in _OPEN:
            stack.append((name, f.tell() + size if size >= 0 else -1))
            group, entry = ({} if name == GROUP else group), ({} if name == ENTRY else entry)
            continue
        if size < 0:
            raise ValueError(f"element {name:X} of unknown size")
        data = exactly(f, size)
        number = int.from_bytes(data, "big") if size <= 8 else 0
        if name == TIME:
            time = number
        elif name == SCALE:
            scale = number
        elif name == BLOCK:
            yield from block(data, None, None)
        elif name == GROUPED:
            group["data"] = data
        elif name == LENGTH:
            group["duration"] = number * scale
        elif name == REFERENCE:
            group["reference"] = True
        elif name == NUMBER:
            entry["number"] = number
        elif name == CODEC:
            entry["codec"] = data.decode("latin-1")
        elif name == DEFAULT:
            entry["default"] = number


def boxes(data: bytes, at: int, end: int):
    """(type, start, end) of the boxes within bytes."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif not size:
            size = end - at
        if size < head or at + size > end:
            raise Cut
        yield kind.decode("latin-1"), at + head, at + size
        at += size


def within(data: bytes, path: str, at: int, end: int) -> tuple[int, int] | None:
    for kind in path.split("/"):
        found = next(((a, b) for k, a, b in boxes(data, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


def numbers(data: bytes, place: tuple[int, int] | None, form: str, skip: int = 4):
    """The entries of a table box: behind version and flags, a count and that many of ``form``."""
    if place is None:
        return []
    at, end = place
    count = struct.unpack(">I", data[at + skip : at + skip + 4])[0]
    size = struct.calcsize(">" + form)
    if at + skip + 4 + count * size > end:
        raise Cut
    return list(struct.iter_unpack(">" + form, data[at + skip + 4 : at + skip + 4 + count * size]))


def samples(data: bytes, at: int, end: int):
    """(track, codec, offset, size, pts, dts, duration, key) of a track box, times in nanoseconds."""
    tkhd, mdhd = within(data, "tkhd", at, end), within(data, "mdia/mdhd", at, end)
    table = within(data, "mdia/minf/stbl", at, end)
    if tkhd is None or mdhd is None or table is None:
        return
    track = struct.unpack(">I", data[tkhd[0] + (20 if data[tkhd[0]] else 12) :][:4])[0]
    scale = struct.unpack(">I", data[mdhd[0] + (20 if data[mdhd[0]] else 12) :][:4])[0]
    get = lambda kind: within(data, kind, *table)
    stsd = get("stsd")
    codec = data[stsd[0] + 12 : stsd[0] + 16].decode("latin-1") if stsd else None
    steps = [d for n, d in numbers(data, get("stts"), "II") for _ in range(n)]
    shifts = [d for n, d in numbers(data, get("ctts"), "Ii") for _ in range(n)]
    stsz = get("stsz")
    each, count = struct.unpack(">II", data[stsz[0] + 4 : stsz[0] + 12]) if stsz else (0, 0)
    if count > TABLES or len(steps) > TABLES:
        raise ValueError("sample tables larger than a file may ask for")
    sizes = [each] * count if each else [s for (s,) in numbers(data, stsz, "I", 8)]
    offsets = [o for (o,) in numbers(data, get("stco"), "I")] or [o for (o,) in numbers(data, get("co64"), "Q")]
    keys = {n for (n,) in numbers(data, get("stss"), "I")} if get("stss") else None
    edit = within(data, "edts/elst", at, end)
    start = 0
    if edit:
        start = next((t for _, t, _, _ in numbers(data, edit, "qqhh" if data[edit[0]] else "Iihh") if t >= 0), 0)
    runs = numbers(data, get("stsc"), "III")
    n, dts = 0, 0
    for k, (first, per, _) in enumerate(runs):
        for chunk in range(first, runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1):
            at = offsets[chunk - 1]
            for _ in range(per):
                if n >= len(sizes):
                    return
                step = steps[n] if n < len(steps) else 0
                shift = (shifts[n] if n < len(shifts) else 0) - start
                ns = lambda t: t * SECOND // scale if t >= 0 else -(-t * SECOND // scale)
                yield track, codec, at, sizes[n], ns(dts + shift), ns(dts - start), ns(step), keys is None or n + 1 in keys
                at, dts, n = at + sizes[n], dts + step, n + 1


def mp4(f):
    """The same of an MP4 file with sample tables, packets in the order of their bytes."""
    at, moov = 0, None
    while moov is None:
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            raise ValueError("no movie box: not an MP4 file, or one without sample tables")
        size, kind = struct.unpack(">I4s", head[:8])
        size = struct.unpack(">Q", head[8:16])[0] if size == 1 and len(head) == 16 else size
        if not at and kind not in (b"ftyp", b"moov", b"free", b"mdat", b"wide", b"skip", b"styp"):
            raise ValueError("not an MP4 file")
        if kind == b"moov":
            if size > TABLES:
                raise ValueError("sample tables larger than a file may ask for")
            f.seek(at)
            moov = exactly(f, size)
        at += max(size, 8)
    own = within(moov, "moov", 0, len(moov))
    every = [s for kind, a, b in boxes(moov, *own) if kind == "trak" for s in samples(moov, a, b)]
    counts: dict[int, int] = {}
    for track, codec, offset, size, pts, dts, duration, key in sorted(every, key=lambda s: s[2]):
        f.seek(offset)
        n = counts[track] = counts.get(track, -1) + 1
        yield track, n, pts, dts, duration, key, codec, exactly(f, size)


FORMATS = {"ivf": ivf, "matroska": matroska, "mp4": mp4}


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def shared_out(files: list[tuple[str, int]]) -> list[list[str]]:
    """Paths by task, in order, of (path, bytes); a file larger than a task's share is alone."""
    shares, room = [], 0
    for path, size in files:
        if size + OPENING > room:
            shares.append([])
            room = SHARE
        shares[-1].append(path)
        room -= size + OPENING
    return shares


def batch_of(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*((name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))))
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], list(names))


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path

    def partitions(self):
        from pyarrow import fs

        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)
            files = [(x.path, x.size or 0) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            return [_Files(paths) for paths in shared_out(files)]
        return [_Files([path])]

    def read(self, partition):
        if partition is None:
            return
        system, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with io.BufferedReader(system.open_input_file(path), PIECE) as f:
                try:
                    for row in FORMATS[self.kind](f):
                        rows.append((path, *row))
                        held += len(row[-1])
                        if len(rows) >= ROWS or held >= BATCH:
                            yield batch_of(rows)
                            rows, held = [], 0
                except Cut:
                    pass  # the packets before the cut are given; the next file follows
        if rows:
            yield batch_of(rows)


class _Container(DataSource):
    kind = ""

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.kind, self.options["path"])


@dataclass
class _Muxed(WriterCommitMessage):
    files: list[tuple[str, str]]


class _IvfWriter(DataSourceArrowWriter):
    """Rows of a stream have to come together and in order. Files are written aside and moved by the commit; an abort
    removes them."""

    def __init__(self, path: str, names: list[str], options: dict):
        self.path, self.job = path, uuid.uuid4().hex
        self.at = [names.index(n) for n in ("stream", "pts", "payload")]
        self.rate, self.scale, self.codec = int(options.get("rate", 30)), int(options.get("scale", 1)), options.get("codec", "VP80")

    def write(self, batches):
        system, root = opened(self.path)
        system.create_dir(f"{root}/_staged", recursive=True)
        made, out, own, parts, held = [], None, None, [], 0
        head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, self.codec.encode().ljust(4), 0, 0, self.rate, self.scale, 0, 0)
        try:
            for batch in batches:
                for stream, pts, payload in zip(*(batch.column(i).to_pylist() for i in self.at)):
                    if out is None or stream != own:
                        if out is not None:
                            out.write(b"".join(parts))
                            out.close()
                        own, name, parts, held = stream, f"_staged/{self.job}-{uuid.uuid4().hex}.ivf", [head], 0
                        made.append((name, f"{stream}.ivf"))
                        out = system.open_output_stream(f"{root}/{name}")
                    payload = payload or b""
                    parts += (struct.pack("<IQ", len(payload), pts), payload)
                    held += len(payload)
                    if held >= BATCH:
                        out.write(b"".join(parts))
                        parts, held = [], 0
                if out is not None:
                    out.write(b"".join(parts))
                    parts, held = [], 0
        finally:
            if out is not None:
                out.close()
        return _Muxed(made)

    def commit(self, messages):
        system, root = opened(self.path)
        for staged, name in (f for m in messages if m is not None for f in m.files):
            system.move(f"{root}/{staged}", f"{root}/{name}")

    def abort(self, messages):
        system, root = opened(self.path)
        for staged, _ in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{root}/{staged}")


class Ivf(_Container):
    kind = "ivf"

    def writer(self, schema, overwrite):
        return _IvfWriter(self.options["path"], schema.fieldNames(), dict(self.options))


class Matroska(_Container):
    kind = "matroska"


class Mp4(_Container):
    kind = "mp4"


def register(spark) -> None:
    for source in (Ivf, Matroska, Mp4):
        spark.dataSource.register(source)
