"""Every query with SQL against DuckDB on the smallest tables, and worked examples of operators."""

import duckdb
import pytest

from streamloom.operators import folds
from streamloom.operators.joins import arrival_zip, asof, band, mix
from streamloom.operators.windows import expand_runs, nack_pairs, runs, unwrap
from streamloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    number = lambda v: int(v) if v is not None and not isinstance(v, (str, bool, bytes)) and hasattr(v, "__int__") and v == int(v) else v
    return sorted((tuple(number(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    if name not in registry.SQL:
        assert rows
        return
    got = duck.execute(registry.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    expected = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert plain(rows) == plain(expected)


def test_worked_mix(spark):
    arms = spark.createDataFrame([(1, "a", 1, 100), (1, "a", 2, 200), (1, "b", 1, 50), (1, "b", 2, -50), (1, "b", 3, 40000)], "s long, arm string, n long, v long")
    z = arrival_zip(arms, "s", "arm", "n", "v", ["a", "b"])
    assert sorted((r.step, r.m) for r in z.withColumn("m", mix(z, ["a", "b"])).collect()) == [(1, 150), (2, 150), (3, 32767)]


def numbers(spark, rows):
    """Rows (key, place, sender, number)."""
    return spark.createDataFrame([(k, i, s, n) for i, (k, s, n) in enumerate(rows)], "k long, i long, s long, n long")


def test_sequence(spark):
    """A wrap, a late row that changes nothing, another sender, a second wrap."""
    df = numbers(spark, [(1, 5, n) for n in (65534, 65535, 2, 1, 3)] + [(1, 6, 9), (1, 6, 9), (1, 6, 10), (None, 5, 7), (None, 5, 9)])
    got = {r.i: (r.expected, r.lost, r.late, r.restarted, r.cycles, list(r.missing)) for r in folds.sequence_gaps(df, "k", ["i"], "i", "s", "n").collect()}
    assert got[1] == (0, 0, False, False, 1, []) and got[2] == (3, 2, False, False, 1, [0, 1])
    assert got[3] == (3, 0, True, False, 1, []) and got[4] == (4, 0, False, False, 1, [])
    assert got[5] == (10, 0, False, True, 0, []) and got[6] == (10, 0, True, False, 0, []) and got[7] == (11, 0, False, False, 0, [])
    assert got[9] == (10, 1, False, False, 0, [8])  # a null key is a key
    u = [r.u for r in unwrap(df.where("k = 1 and s = 5"), "k", "i", "n", 16, "u").orderBy("i").collect()]
    assert u == [65534, 65535, 65538, 65537, 65539]


def released(spark, rows, capacity):
    out = folds.jitter(numbers(spark, rows), "k", ["i"], "i", "s", "n", capacity).orderBy("n").collect()
    (stats,) = folds.jitter_stats(numbers(spark, rows), "k", ["i"], "i", "s", "n", capacity).collect()
    return [rows[r.i][2] for r in out], tuple(stats[1:])


def test_jitter(spark):
    row = lambda *ns, s=1: [(1, s, n) for n in ns]
    assert released(spark, row(1, 3, 2, 4), 4) == ([1, 2, 3, 4], (1, 5, 0, 0, 0, 0))
    assert released(spark, row(65535, 1, 0, 2), 3) == ([65535, 0, 1, 2], (1, 3, 0, 0, 0, 0))  # any capacity orders across the wrap
    assert released(spark, row(1, 3, 4, 9, 10), 4) == ([1, 9, 10], (1, 11, 0, 5, 0, 0))  # beyond the window: what waits is discarded, but wasn't lost
    assert released(spark, row(1, 3, 3, 2, 1), 4) == ([1, 2, 3], (1, 4, 1, 0, 1, 0))  # held twice, and late
    assert released(spark, row(1, 4, 6), 8) == ([1, 4, 6], (1, 2, 0, 0, 0, 2))  # drained at the end, gaps and all
    assert released(spark, row(1, 4) + row(50, 52, 51, s=2), 8) == ([1, 50, 51, 52], (2, 53, 0, 0, 0, 0))  # another sender


def test_jitter_apart(spark):
    """Rows of one number and different seq are held side by side: the first goes when its turn comes; all go at the end."""
    rows = [(1, 0, 5, 1), (1, 1, 6, 3), (1, 2, 7, 3), (1, 3, 6, 3), (1, 4, 8, 2), (1, 5, 9, 5), (1, 6, 10, 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, i long, seq long, n long, s long")
    args = (df, "k", ["i"], "seq", "s", "n", 4)
    assert [r.seq for r in folds.jitter(*args, apart=True).orderBy("n").collect()] == [5, 8, 6, 9, 10]
    assert [tuple(r) for r in folds.jitter_stats(*args, apart=True).collect()] == [(1, 1, 4, 0, 0, 1, 2)]


def test_jitter_dense(spark, tmp_path):
    """Rows so dense that the six-bit number comes round within the delay of arrivals."""
    c = duckdb.connect()
    at = "timestamp '2024-01-01' + to_milliseconds(i * 4300 + i * i * 7919 % 100 * 1000)"
    c.execute(f"copy (select i as event_id, {at} as ts, i % 7 as user_id, 'view' as event_type, 1.0::double as value, '{{\"k\": 1}}' as props from range(6000) t(i)) to '{tmp_path}/events.parquet'")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cols = "receiver, sender, expected, late, lost, reordered, buffered"
    expected = c.execute(f"select {cols} from ({registry.SQL['jitter_stats']})").fetchall()
    assert plain(registry.QUERIES["jitter_stats"](spark, str(tmp_path)).select(*cols.split(", ")).collect()) == plain(expected)


def test_nack(spark):
    lists = [[5, 5, 6, 21, 22], [65535, 0, 3], [7], [], [65535, 15, 16]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, x array<long>")
    got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", nack_pairs(df.x).alias("p")).collect()}
    assert got == {0: [(5, 1 | 1 << 15), (22, 0)], 1: [(65535, 1 | 1 << 3)], 2: [(7, 0)], 3: [], 4: [(65535, 1 << 15), (16, 0)]}


def aligned(spark, rows):
    """Steps of rows (arm, time, length) or None for a reset."""
    data = [(1, i, *(r or (None, None, 0)), r is None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, seq long, arm string, t long, length long, reset boolean")
    return [(r.at, list(r.rows), r.dropped) for r in folds.by_pts(df, "k", ["seq"], ["seq", "arm", "t", "length", "reset"], ["a", "b"]).orderBy("step").collect()]


def test_by_pts(spark):
    assert aligned(spark, [("a", 0, 10), ("b", 0, 10), ("a", 10, 10), ("b", 10, 10)]) == [(0, [0, 1], 0), (10, [2, 3], 0)]
    assert aligned(spark, [("a", 0, 10), ("b", 5, 10), ("a", 10, 10), ("b", 16, 10)]) == [(0, [0, 1], 0), (10, [2, None], 0), (16, [None, 3], 0)]
    # a gap of b: a's rows go alone until b's time has come
    assert aligned(spark, [("a", 0, 10), ("b", 20, 10), ("a", 10, 10), ("a", 20, 10)]) == [(0, [0, None], 0), (10, [2, None], 0), (20, [3, 1], 0)]
    # b fell behind: its head is dropped
    assert aligned(spark, [("a", 0, 10), ("b", 0, 10), ("a", 10, 10), ("b", 0, 10), ("b", 10, 10)]) == [(0, [0, 1], 0), (10, [2, 4], 1)]
    # a reset forgets what waits and lets times go back
    assert aligned(spark, [("a", 100, 10), ("b", 100, 10), ("a", 110, 10), None, ("a", 0, 10), ("b", 0, 10)]) == [(100, [0, 1], 0), (0, [4, 5], 1)]
    # no time: it takes part at once
    assert aligned(spark, [("a", None, 10), ("b", 50, 10)]) == [(50, [0, 1], 0)]


def gated(spark, rows, hold):
    data = [(1, i, *(r or (None, 0)), r is None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, seq long, s string, t long, reset boolean")
    return [(r.seq, r.released_by, r.dropped, r.behind) for r in folds.sync_gate(df, "k", ["seq"], ["seq", "s", "t", "reset"], 5, hold).orderBy("seq").collect()]


def test_sync_gate(spark):
    late = gated(spark, [("a", 20), ("b", 14), ("b", 15), ("a", 14), None, ("b", 0)], False)
    assert late == [(0, 0, False, 0), (1, 1, True, 6), (2, 2, False, 0), (3, 3, True, 6), (5, 5, False, 0)]
    # b waits until a has come within the tolerance; rows behind it in its stream wait too
    held = gated(spark, [("a", 0), ("b", 10), ("b", 11), ("a", 4), ("a", 5), ("a", 8)], True)
    assert held == [(0, 0, False, 0), (1, 4, False, 0), (2, 5, False, 0), (3, 3, False, 0), (4, 4, False, 0), (5, 5, False, 0)]
    assert gated(spark, [("a", 0), ("b", 10), None], True) == [(0, 0, False, 0), (1, 2, False, 0)]
    assert gated(spark, [("a", 0), ("b", 10)], True) == [(0, 0, False, 0), (1, None, False, 0)]


def test_runs_round_trip(spark):
    values = [(1, i, v) for i, v in enumerate([5, 5, None, None, 7, 5])]
    r = runs(spark.createDataFrame(values, "k long, i long, v long"), "k", "i", "v")
    back = expand_runs(r.withColumn("n", r.n.cast("long")), "k", "first", "n", "value")
    assert [x.value for x in back.orderBy("at").collect()] == [v for _, _, v in values]


def test_asof_and_band(spark):
    left = spark.createDataFrame([(1, 10), (1, 25), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 10, 100), (1, 20, 200), (2, 9, 300)], "k long, t long, v long")
    assert sorted((r.k, r.t, r.o) for r in asof(left, right, "k", "t", "v", "o").collect() if r.o) == [(1, 10, 100), (1, 25, 200)]
    a = spark.createDataFrame([(1, 10, 1), (1, 30, 2)], "k long, t long, id long")
    b = spark.createDataFrame([(1, 14, 7), (1, 6, 8), (1, 41, 9)], "k long, t long, id long")
    assert sorted((r.l_id, r.r_id) for r in band(a, b, "k", "t", 5).collect()) == [(1, 8)]


def test_folds(spark):
    rows = [(0, True, 4), (3, False, 5), (5, True, 9), (6, True, 1), (20, True, 2)]
    df = spark.createDataFrame([(k, i, t, s, n, False) for k in (1, None) for i, (t, s, n) in enumerate(rows)], "k long, seq long, t long, s boolean, n long, r boolean")
    for k in ("k = 1", "k is null"):
        assert [tuple(r)[1:] for r in folds.segments(df, "k", ["seq"], "t", "s", 4).where(k).orderBy("segment").collect()] == [(0, 0, 3, 2), (1, 5, 6, 2), (2, 20, 20, 1)]
        assert [r.seq for r in folds.byte_budget(df, "k", ["seq"], "seq", "n", "r", 10).where(k).where("not shed").orderBy("seq").collect()] == [0, 1, 3]
        assert [r.seq for r in folds.rate_limit(df, "k", ["seq"], "seq", "t", 4).where(k).orderBy("seq").collect()] == [0, 2, 4]
    assert [r.start for r in folds.segments(df, "k", ["seq"], "t", "s", 7, slack=1).where("k = 1").orderBy("segment").collect()] == [0, 6, 20]
    assert folds.rate_limit(df.limit(0), "k", ["seq"], "seq", "t", 4).collect() == []
    reads = spark.createDataFrame([(1, i, n, r) for i, (n, r) in enumerate([(6, False), (6, False), (0, True), (6, False), (0, True), (0, True)])], "k long, seq long, n long, r boolean")
    assert [(r.seq, r.shed, r.held) for r in folds.byte_budget(reads, "k", ["seq"], "seq", "n", "r", 10).orderBy("seq").collect()] == [(0, False, 6), (1, True, 6), (3, False, 6)]


def test_sources_and_streaming(spark, tmp_path):
    from streamloom.sources.testsrc import register
    from streamloom.streaming.live import drop_late_counts, live_messages, select_branch, write_once

    register(spark)
    rows = spark.read.format("testsrc").option("frames", 3).option("width", 4).option("height", 2).load().collect()
    assert {r.frame: r.samples[5] for r in rows} == {n: (1 + 1 + 3 * n) % 256 for n in range(3)}
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = drop_late_counts(select_branch(live_messages(spark, str(tmp_path / "in"), events.schema), ["click"]), "60 days", "1 day")
    write_once(live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    write_once(select_branch(live_messages(spark, str(tmp_path / "in"), events.schema), ["click"]), str(tmp_path / "copy"), str(tmp_path / "check2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == events.where("event_type = 'click'").count()
