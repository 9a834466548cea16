"""Containers, push sources, destinations, stages and packets, on hand-made bytes and rows."""

import struct

import numpy as np
import pytest

from streamloom.operators import planes, rtp, stages
from streamloom.sources import containers, destination, push


def ivf_file(frames, codec=b"VP80", rate=30, scale=1):
    return b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, codec, 64, 48, rate, scale, len(frames), 0) + b"".join(struct.pack("<IQ", len(p), t) + p for t, p in frames)


def element(name, data, unknown=False):
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if unknown else (len(data) | 1 << 28).to_bytes(4, "big")) + data


def block(track, time, flags, data):
    return bytes([0x80 | track]) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + data


def matroska_file(unknown=False):
    C = containers
    tracks = element(C.TRACKS, element(C.ENTRY, element(C.NUMBER, b"\1") + element(C.CODEC, b"V_VP8")) + element(C.ENTRY, element(C.NUMBER, b"\2") + element(C.CODEC, b"A_OPUS") + element(C.DEFAULT, (20_000_000).to_bytes(4, "big"))))
    one = element(C.CLUSTER, element(C.TIME, b"\0") + element(C.BLOCK, block(1, 0, 0x80, b"key")) + element(C.BLOCK, block(2, 0, 0x86, b"\1\x83" + b"aaa" + b"bb")), unknown)
    xiph = element(C.BLOCK, block(2, 5, 0x02, b"\1\2" + b"xx" + b"yyy"))
    two = element(C.CLUSTER, element(C.TIME, (1000).to_bytes(2, "big")) + element(C.GROUP, element(C.GROUPED, block(1, -10, 0, b"plain")) + element(C.LENGTH, b"\x28") + element(C.REFERENCE, b"\1")) + xiph, unknown)
    return element(0x1A45DFA3, b"") + element(C.SEGMENT, element(C.INFO, element(C.SCALE, (1_000_000).to_bytes(3, "big"))) + tracks + one + two, unknown)


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def mp4_file():
    payloads = [b"aaaa", b"bb", b"cccccc", b"d"]
    ftyp, u = box(b"ftyp", b"isom"), lambda *n: struct.pack(f">{len(n)}I", *n)
    at = len(ftyp) + 8
    table = lambda first: box(
        b"stbl", box(b"stsd", u(0, 1), box(b"avc1", bytes(78))), box(b"stts", u(0, 2, 3, 100, 1, 50)), box(b"ctts", u(0, 2, 1, 200, 3, 100)),
        box(b"stsc", u(0, 2, 1, 3, 1, 2, 1, 1)), box(b"stsz", u(0, 0, 4, *map(len, payloads))), box(b"stco", u(0, 2, first, first + 12)), box(b"stss", u(0, 1, 1)),
    )
    track = lambda first: box(b"trak", box(b"tkhd", u(0, 0, 0, 7, 0)), box(b"edts", box(b"elst", u(0, 1, 0, 100, 0x10000))), box(b"mdia", box(b"mdhd", u(0, 0, 0, 1000, 350)), box(b"minf", table(first))))
    return ftyp + box(b"mdat", *payloads) + box(b"moov", track(at))


def test_containers(spark, tmp_path):
    containers.register(spark)
    frames = [(i, bytes([i]) * (i + 1)) for i in range(5)]
    whole = ivf_file(frames)
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.ivf").write_bytes(whole)
    (tmp_path / "i/b.ivf").write_bytes(whole[:-2])  # cut off
    rows = spark.read.format("ivf").load(f"{tmp_path}/i").collect()
    assert sorted((r.path[-5:], r.n, r.pts_ns, r.codec, bytes(r.payload)) for r in rows) == sorted([(p, t, t * 10**9 // 30, "vp80", b) for p, k in (("a.ivf", 5), ("b.ivf", 4)) for t, b in frames[:k]])
    for unknown in (False, True):
        (tmp_path / f"m{unknown}.webm").write_bytes(matroska_file(unknown))
        rows = spark.read.format("matroska").load(f"{tmp_path}/m{unknown}.webm").collect()
        got = [(r.track, r.n, r.pts_ns // 10**6, r.duration_ns, r.key, r.codec, bytes(r.payload)) for r in rows]
        ms = 10**6
        assert got == [
            (1, 0, 0, None, True, "V_VP8", b"key"), (2, 0, 0, 20 * ms, True, "A_OPUS", b"aaa"), (2, 1, 20, 20 * ms, True, "A_OPUS", b"bb"),
            (1, 1, 990, 40 * ms, False, "V_VP8", b"plain"), (2, 2, 1005, 20 * ms, False, "A_OPUS", b"xx"), (2, 3, 1025, 20 * ms, False, "A_OPUS", b"yyy"),
        ]
    (tmp_path / "v.mp4").write_bytes(mp4_file())
    rows = spark.read.format("mp4").load(f"{tmp_path}/v.mp4").collect()
    got = [(r.track, r.n, r.pts_ns // 10**6, r.dts_ns // 10**6, r.duration_ns // 10**6, r.key, r.codec, bytes(r.payload)) for r in rows]
    assert got == [(7, 0, 100, -100, 100, True, "avc1", b"aaaa"), (7, 1, 100, 0, 100, False, "avc1", b"bb"), (7, 2, 200, 100, 100, False, "avc1", b"cccccc"), (7, 3, 300, 200, 50, False, "avc1", b"d")]
    (tmp_path / "bad").write_bytes(b"no container at all" * 9)
    for kind in containers.FORMATS:
        with pytest.raises(Exception, match="not a"):
            spark.read.format(kind).load(f"{tmp_path}/bad").collect()


def test_many_containers(spark, tmp_path):
    """Small files share tasks; one that is cut off takes no other with it; rows that aren't in the writer's order of columns."""
    containers.register(spark)
    rows = [(bytes([n]) * n if n else None, n, s) for s in range(700) for n in range(3)]
    spark.createDataFrame(rows, "payload binary, pts long, stream long").repartition(4, "stream").sortWithinPartitions("stream", "pts").write.format("ivf").mode("append").save(f"{tmp_path}/many")
    assert len(list((tmp_path / "many").glob("*.ivf"))) == 700
    whole = (tmp_path / "many/17.ivf").read_bytes()
    assert whole == ivf_file([(n, bytes([n]) * n) for n in range(3)])[:24].replace(struct.pack("<HH", 64, 48), bytes(4)) + bytes(8) + whole[32:]
    (tmp_path / "many/17.ivf").write_bytes(whole[:-1])
    df = spark.read.format("ivf").load(f"{tmp_path}/many")
    assert df.rdd.getNumPartitions() < 10
    got = sorted((int(r.path.split("/")[-1][:-4]), r.n, bytes(r.payload)) for r in df.collect())
    assert got == [(s, n, bytes([n]) * n) for s in range(700) for n in range(3) if (s, n) != (17, 2)]


def test_shared_out():
    each, most = containers.OPENING, containers.SHARE
    assert containers.shared_out([]) == []
    assert containers.shared_out([("a", 0), ("b", most), ("c", 5), ("d", 6)]) == [["a"], ["b"], ["c", "d"]]
    assert [len(s) for s in containers.shared_out([(str(i), 0) for i in range(600)])] == [256, 256, 88] and most // each == 256


def test_push(spark):
    told = []

    def function(p):
        told.append([p.packet(b"a", 0, True), p.packet(b"b", 1), p.packet(b"c", 2)])
        yield
        told.append([p.frame(b"d", 3), p.event("discontinuity", 4), p.eos(), p.packet(b"e", 5)])

    rows = list(push.rows_of(function, "s", room=2))
    assert told == [["delivered", "delivered", "dropped"], ["delivered", "delivered", "dropped", "closed"]]
    assert [(r[1], r[2]) for r in rows] == [(0, "packet"), (1, "packet"), (3, "frame"), (4, "event")]
    assert [(r[1], r[2]) for r in push.rows_of(function, "s", room=2, oldest=True)] == [(1, "packet"), (2, "packet"), (4, "event"), (5, "eos")]

    def numbers(p):
        for i in range(5):
            p.packet(bytes([i]), i)

    df = push.push_frame(spark, {"x": numbers, "y": lambda p: p.event("only")})
    assert sorted((r.stream, r.n, r.kind) for r in df.collect()) == [("x", i, "packet") for i in range(5)] + [("x", 5, "eos"), ("y", 0, "event"), ("y", 1, "eos")]


def test_push_stream(spark, tmp_path):
    def poll(p, k):
        p.packet(bytes([k]), k)
        p.event(f"poll {k}")

    spark.dataSource.register(push.stream_source("polled", poll, 3))
    write = lambda: spark.readStream.format("polled").load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
    for _ in range(2):  # a restart neither repeats nor loses
        q = write()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.pts_ns is None, r.pts_ns or 0, bytes(r.payload)) for r in got) == [(False, k, bytes([k])) for k in range(3)] + [(True, 0, f"poll {k}".encode()) for k in range(3)]


def test_destination(spark, tmp_path):
    import os

    destination.register(spark)
    path, schema = f"{tmp_path}/d", "id long, name string"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)], schema).repartition(4)
    df.write.format("records").mode("append").save(path)
    read = lambda: sorted((r.id, r.name) for r in spark.read.format("records").schema(schema).load(path).collect())
    assert read() == [(i, f"n{i}") for i in range(50)]

    def fails(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    before = sorted(x for x in os.listdir(path) if x != "_staged")
    with pytest.raises(Exception, match="lost"):
        df.mapInArrow(fails, schema).write.format("records").mode("append").save(path)
    assert read() == [(i, f"n{i}") for i in range(50)] and sorted(x for x in os.listdir(path) if x != "_staged") == before
    df.limit(3).write.format("records").mode("append").save(path)
    assert len(read()) == 53
    df.where("id < 2").write.format("records").mode("overwrite").save(path)
    assert read() == [(0, "n0"), (1, "n1")]


def test_stages(spark):
    registry = stages.Registry()
    registry.add("stage", "double", lambda df, by=2: df.withColumn("v", df.v * by))
    with pytest.raises(ValueError):
        registry.add("stage", "double", lambda df: df)
    with pytest.raises(KeyError, match="double"):
        registry.get("stage", "dubble")
    df = spark.createDataFrame([(1, "packet", 10), (2, "frame", 20), (3, "event", 30), (4, None, 40)], "id long, kind string, v long")
    out = stages.do(df, registry.get("stage", "double"), (registry.get("stage", "double"), {"by": 5}))
    assert [r.v for r in out.orderBy("id").collect()] == [100, 200, 300, 400]
    out = stages.map_messages(df, on_packet=lambda d: d.withColumn("v", d.v + 1), on_event=lambda d: d.where("v > 99"))
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, 11), (2, 20), (4, 40)]
    import pyarrow as pa

    registry.add("join", "count", lambda a, b: pa.table({"id": pa.array([(a if a.num_rows else b).column("id")[0].as_py()], pa.int64()), "n": pa.array([a.num_rows * 10 + b.num_rows], pa.int64())}))
    joined = stages.join("count", registry, "id", df, df.where("id > 2"), "id long, n long")
    assert sorted((r.id, r.n) for r in joined.collect()) == [(1, 10), (2, 10), (3, 11), (4, 11)]


def test_shapes(spark):
    df = spark.createDataFrame([(1, 2.5, "7")], "a int, b double, c string")
    assert stages.shape(df, "a int, b double")[1] == []
    with pytest.raises(stages.ShapeError, match="wider"):
        stages.shape(df, "a long")
    out, made = stages.shape(df, "a long, b float, c int", "auto", frozenset({"narrow", "text"}))
    assert made == [("a", "int", "bigint"), ("b", "double", "float"), ("c", "string", "int")] and tuple(out.first()) == (1, 2.5, 7)
    with pytest.raises(stages.ShapeError, match="narrow"):
        stages.shape(df, "b float", "auto")
    with pytest.raises(stages.ShapeError, match="no column"):
        stages.shape(df, "z int", "auto")
    assert stages.shape(df, "a long, b float, z int", "prefer")[1] == [("a", "int", "bigint")]


def test_branches(spark, tmp_path):
    own = stages.Branches()
    own.attach("count", lambda d: d.count())
    own.attach("broken", lambda d: d.select("nothing").count())
    told = own.run(spark.range(5))
    assert told["count"] == ("done", 5) and told["broken"][0] == "failed"
    assert own.detach("broken") and not own.detach("broken")
    own.attach("strict", lambda d: d.select("nothing").count(), failure="fail")
    with pytest.raises(Exception, match="nothing"):
        own.run(spark.range(5))


def frames(spark, codec, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k long, i long, seq long, time long, mark boolean, payload binary")
    return [(r.time, r.key, bytes(r.payload)) for r in rtp.depacketize(df, "k", ["i"], ["seq", "time", "mark", "payload"], codec).orderBy("n").collect()]


def test_depacketize(spark):
    code = b"\0\0\0\1"
    assert frames(spark, "opus", [(1, 0, False, b"a"), (2, 960, False, b"b"), (4, 1920, True, b"c"), (5, 2, False, b"")]) == [(0, True, b"a"), (960, True, b"b"), (1920, True, b"c")]
    vp8 = [(1, 0, False, b"\x10\x00key"), (2, 0, True, b"\x00rest"), (3, 9, False, b"\x90\x80\x12\x01x"), (5, 9, True, b"\x00lost"), (6, 12, True, b"\x90\xe0\x80\x01\x02\x03\x01y")]
    assert frames(spark, "vp8", vp8) == [(0, True, b"\x00keyrest"), (12, False, b"\x01y")]
    stap = b"\x78" + b"\x00\x02\x67a" + b"\x00\x02\x68b"
    h264 = [(65535, 0, False, stap), (0, 0, False, b"\x7c\x85one"), (1, 0, True, b"\x7c\x45two"), (2, 3, True, b"\x41plain"), (4, 6, True, b"\x7c\x45two"), (5, 9, True, b"\x65k")]
    assert frames(spark, "h264", h264) == [(0, True, code + b"\x67a" + code + b"\x68b" + code + b"\x65onetwo"), (3, False, code + b"\x41plain"), (9, True, code + b"\x65k")]
    vp9 = [(1, 0, False, b"\x8c\x81\x23start"), (2, 0, True, b"\x84\x05end"), (3, 3, True, b"\xcc\x06delta")]
    assert frames(spark, "vp9", vp9) == [(0, True, b"startend"), (3, False, b"delta")]
    unit = b"\x30abc"  # a frame without its size
    av1 = [(1, 0, False, b"\x68" + b"\x02\x08x" + unit[:2]), (2, 0, True, b"\x90" + unit[2:])]
    assert frames(spark, "av1", av1) == [(0, True, b"\x0a\x01x" + b"\x32\x03abc")]


def test_planes():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (3, 9, 7))
    assert (planes.scaled(p, 7, 9) == p).all()  # the same size is the same plane
    assert (planes.scaled(np.full((1, 6, 6), 200), 4, 13) == 200).all()
    half = planes.scaled(p[:, :8, :6], 3, 4)
    mean = p[:, :8, :6].reshape(3, 4, 2, 3, 2).mean(axis=(2, 4))
    assert np.abs(half - mean).max() <= 1
    for n, m in ((1, 5), (7, 3), (3, 7), (640, 360), (5, 5)):
        assert (planes.weights(n, m).sum(axis=1) == 1 << 14).all()


def test_resize_nulls(spark):
    df = spark.createDataFrame([(1, [10] * 4), (2, None), (3, [1, 2]), (None, [0, 0, None, 0])], "id long, p array<int>")
    got = {r.id: r.plane for r in planes.resize(df, "id", "p", (2, 2), (3, 1)).collect()}
    assert got == {1: [10, 10, 10], 2: None, 3: None, None: None}
