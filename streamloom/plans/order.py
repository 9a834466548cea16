"""Gaps, order, runs, limits and drop policies over one stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import messages, table
from ..operators import folds
from ..operators.graphs import upstream_first
from ..operators.windows import by, epochs, expand_runs, first_n, last_n, open_after, runs, unwrap, upto
from .base import M, RM, q

#: Rows as a receiver sees them: by arrival, every 37th lost, every 29th sent twice, senders of 250 rows, a six-bit number.
_RX = """, rx as (select seq, seq // 500 as receiver, seq // 250 as sender, seq % 64 as number, arrival_us from m where seq % 37 <> 0
  union all select seq, seq // 500, seq // 250, seq % 64, arrival_us + 1000000 from m where seq % 37 <> 0 and seq % 29 = 0),
n as materialized (select *, row_number() over (partition by receiver order by arrival_us, seq) as i from rx)"""
_SEQ = RM + _RX + """, f(receiver, i, seq, sender, expected, lost, late, restarted, cycles, missing) as (
  select receiver, i, seq, sender, (number + 1) % 64, 0::bigint, false, false, 0::bigint, '' from n where i = 1
  union all
  select receiver, i, seq, sender, case when again or ahead < 32 then (number + 1) % 64 else expected end,
    case when not again and ahead < 32 then ahead else 0 end, not again and ahead >= 32, again,
    case when again then 0 when ahead = 0 and number = 63 then cycles + 1 when ahead between 1 and 31 and number < expected then cycles + 1 else cycles end,
    case when not again and ahead < 32 then array_to_string(list_transform(range(ahead), lambda x: (expected + x) % 64), ',') else '' end
  from (select n.receiver, n.i, n.seq, n.sender, n.number, f.expected, f.cycles, n.sender <> f.sender as again, (n.number - f.expected + 64) % 64 as ahead
        from f join n on n.receiver = f.receiver and n.i = f.i + 1)) """


def _received(spark, sf):
    m = messages(spark, sf).where("seq % 37 <> 0").select("seq", "arrival_us")
    again = m.where("seq % 29 = 0").withColumn("arrival_us", F.col("arrival_us") + 1000000)
    return m.unionByName(again).selectExpr("seq", "seq div 500 as receiver", "seq div 250 as sender", "seq % 64 as number", "arrival_us")


@q(_SEQ + "select receiver, i, seq, expected, lost, late, restarted, cycles, missing from f")
def seq_gaps(spark, sf):
    """What each row tells of its sender's counter, in order of arrival: loss with the numbers missing, lateness, restarts."""
    places = _received(spark, sf).withColumn("i", F.row_number().over(by("receiver", ["arrival_us", "seq"])).cast("long"))
    told = folds.sequence_gaps(places, "receiver", ["i"], "i", "sender", "number", 6)
    missing = F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing")
    return told.join(places.select("receiver", "i", "seq"), ["receiver", "i"]).select("receiver", "i", "seq", "expected", "lost", "late", "restarted", "cycles", missing)


@q(_SEQ + "select receiver, count(*) as received, sum(lost)::bigint as lost, count(case when late then 1 end) as late, count(case when restarted then 1 end) as restarts from f group by receiver")
def seq_loss_stats(spark, sf):
    gaps = folds.sequence_gaps(_received(spark, sf), "receiver", ["arrival_us", "seq"], "seq", "sender", "number", 6)
    return gaps.groupBy("receiver").agg(F.count("*").alias("received"), F.sum("lost").alias("lost"), F.count_if("late").alias("late"), F.count_if("restarted").alias("restarts"))


@q(M + ", s as (select seq, seq // 4096 as sender from m where seq % 37 <> 0) select seq, (seq - sender * 4096) // 512 as cycles from s")
def seq_unwrap(spark, sf):
    s = messages(spark, sf).where("seq % 37 <> 0").selectExpr("seq", "seq div 4096 as sender", "seq % 512 as number")
    wrapped = F.coalesce(F.col("number") < F.lag("number").over(by("sender", "seq")), F.lit(False)).cast("long")
    return s.withColumn("w", wrapped).select("seq", F.sum("w").over(upto("sender", "seq")).alias("cycles"))


_RING = RM + _RX + """, f(receiver, i, sender, expected, held, late, lost, reordered, released) as (
  select receiver, i, sender, (number + 1) % 64, []::bigint[], 0::bigint, 0::bigint, 0::bigint, [seq] from n where i = 1
  union all
  select receiver, i, sender, (base + run) % 64, list_filter(now, lambda x: (x - base + 6400) % 64 >= run), late, lost, reordered,
    list_transform(range(run), lambda j: list_filter(now, lambda x: x % 64 = (base + j) % 64)[1])
  from (select *, list_filter(range(6), lambda j: not list_contains(list_transform(now, lambda x: x % 64), (base + j) % 64))[1] as run
    from (select receiver, i, sender, base, late, lost,
        reordered + case when not behind and list_contains(kept, seq) then 1 else 0 end as reordered,
        case when behind or list_contains(kept, seq) then kept else list_append(kept, seq) end as now
      from (select receiver, i, sender, seq, behind, case when again then 0 else reordered end as reordered,
          case when again or beyond then number else expected end as base,
          case when again or beyond then []::bigint[] else held end as kept,
          case when again then 0 else late + behind::int end as late,
          case when again then 0 when beyond then lost + greatest(0, ahead - len(held)) else lost end as lost
        from (select *, not again and ahead >= 32 as behind, not again and ahead < 32 and ahead >= 5 as beyond
          from (select n.receiver, n.i, n.seq, n.sender, n.number, f.expected, f.held, f.late, f.lost, f.reordered,
              n.sender <> f.sender as again, (n.number - f.expected + 64) % 64 as ahead
            from f join n on n.receiver = f.receiver and n.i = f.i + 1)))))),
last as (select * from f where (receiver, i) in (select receiver, max(i) from n group by receiver)) """


@q(_RING + """, o as (select receiver, i, unnest(range(len(released))) as j, unnest(released) as seq from f
  union all select receiver, i + 1, (seq - expected + 6400) % 64, seq from (select receiver, i, expected, unnest(held) as seq from last))
select receiver, seq, row_number() over (partition by receiver order by i, j) - 1 as n from o""")
def jitter_reorder(spark, sf):
    """Rows released in order by a window of five numbers; what is beyond it discards what waits."""
    return folds.jitter(_received(spark, sf), "receiver", ["arrival_us", "seq"], "seq", "sender", "number", 5, 6, apart=True)


@q(_RING + "select receiver, sender, expected, late, lost, reordered, len(held) as buffered from last")
def jitter_stats(spark, sf):
    return folds.jitter_stats(_received(spark, sf), "receiver", ["arrival_us", "seq"], "seq", "sender", "number", 5, 6, apart=True)


@q(M + "select seq, pts_us // 1000 - (min(pts_us // 1000) over (partition by stream_id)) + ((min(pts_us // 1000) over (partition by stream_id)) % 4294967296) as unwrapped from m")
def ts_unwrap(spark, sf):
    m = messages(spark, sf).withColumn("ts32", F.expr("div(pts_us, 1000)") % (1 << 32))
    return unwrap(m, "stream_id", "seq", "ts32", 32, "unwrapped").select("seq", "unwrapped")


@q(M + ", l as (select seq, arrival_us - lag(arrival_us) over (partition by stream_id order by seq) as step from m) select seq, step, case when step < 0 then 'backward' else 'forward' end as way from l where step < 0 or step > 36000000000")
def ts_discontinuity(spark, sf):
    step = F.col("arrival_us") - F.lag("arrival_us").over(by("stream_id", "seq"))
    m = messages(spark, sf).select("seq", step.alias("step")).where("step < 0 or step > 36000000000")
    return m.withColumn("way", F.when(F.col("step") < 0, "backward").otherwise("forward"))


@q(M + "select seq, stream_id, sum(cast(is_disc as bigint)) over (partition by stream_id order by seq) as epoch from m")
def discontinuity_epochs(spark, sf):
    return epochs(messages(spark, sf), "stream_id", "seq", "is_disc").select("seq", "stream_id", F.col("epoch").cast("decimal(38,0)").cast("long").alias("epoch"))


@q(M + "select seq, source, row_number() over (order by t, source, seq) as n from (select seq, kind as source, coalesce(case when k % 4 <> 0 then arrival_us end, case when k % 8 <> 0 then pts_us end, 0) as t from m)")
def interleave_by_time(spark, sf):
    """Offline order of many sources: by decode time, else presentation time, else 0; ties by source. Days are ranges of
    the order: rows are numbered within a day, and days are offset by the counts of those before."""
    dts, pts = F.when(F.col("k") % 4 != 0, F.col("arrival_us")), F.when(F.col("k") % 8 != 0, F.col("pts_us"))
    m = messages(spark, sf).select("seq", F.col("kind").alias("source"), F.coalesce(dts, pts, F.lit(0)).alias("t"))
    m = m.withColumn("day", F.floor(F.col("t") / 86400000000))
    counts = m.groupBy("day").agg(F.count("*").alias("c"))
    first = F.coalesce(F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of days, which are few
    m = m.join(counts.select("day", first.alias("first")), "day")
    return m.select("seq", "source", (F.col("first") + F.row_number().over(by("day", ["t", "source", "seq"]))).alias("n"))


@q(M + ", c as (select *, case when kind is distinct from lag(kind) over (partition by stream_id order by seq) then 1 else 0 end as c from m), r as (select *, sum(c) over (partition by stream_id order by seq) as run from c) select stream_id, min(kind) as value, count(*) as n, min(seq) as first from r group by stream_id, run")
def rle_encode(spark, sf):
    return runs(messages(spark, sf), "stream_id", "seq", "kind").select("stream_id", "value", "n", "first")


@q("with r as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as n, coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0)::bigint as start from lineitem) select l_orderkey, count(*) as samples, sum(pos * l_linenumber)::bigint as checksum from (select l_orderkey, l_linenumber, start + unnest(range(n)) as pos from r) group by l_orderkey")
def rle_expand(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"))
    x = expand_runs(li, "l_orderkey", "l_linenumber", "n", "l_linenumber")
    return x.groupBy("l_orderkey").agg(F.count("*").alias("samples"), F.sum(F.col("at") * F.col("l_linenumber")).alias("checksum"))


@q(M + "select stream_id, max(seq) as seq, max_by(kind, seq) as kind from m group by stream_id")
def latest_per_key(spark, sf):
    return messages(spark, sf).groupBy("stream_id").agg(F.max(F.struct("seq", "kind")).alias("r")).select("stream_id", "r.seq", "r.kind")


@q(M + "select stream_id, seq from (select *, row_number() over (partition by stream_id order by seq desc) as n from m) where n <= 5")
def drop_oldest(spark, sf):
    return last_n(messages(spark, sf), "stream_id", "seq", 5).select("stream_id", "seq")


@q(M + "select stream_id, seq from (select *, row_number() over (partition by stream_id order by seq) as n from m) where n <= 5")
def drop_newest(spark, sf):
    return first_n(messages(spark, sf), "stream_id", "seq", 5).select("stream_id", "seq")


@q(M + ", d as (select stream_id, pts_us // 86400000000 as day, count(*) as n from m group by all) select stream_id, day, n from (select *, row_number() over (partition by stream_id order by day desc) as r from d) where r <= 3")
def live_window(spark, sf):
    d = messages(spark, sf).groupBy("stream_id", F.floor(F.col("pts_us") / 86400000000).alias("day")).agg(F.count("*").alias("n"))
    return last_n(d, "stream_id", "day", 3)


@q(M + ", g as (select *, sum(case when k >= 95 then 1 else 0 end) over (partition by stream_id order by seq) as over, from m), h as (select *, sum(case when is_sync then 1 else 0 end) over (partition by stream_id, over order by seq) as syncs from g) select seq, stream_id from h where over = 0 or syncs > 0")
def drop_until_sync(spark, sf):
    """After an overflow (k >= 95), rows are dropped until the next sync row."""
    g = epochs(messages(spark, sf).withColumn("full", F.col("k") >= 95), "stream_id", "seq", "full", "over")
    synced = F.sum(F.col("is_sync").cast("int")).over(upto(["stream_id", "over"], "seq"))
    return g.withColumn("syncs", synced).where("over = 0 or syncs > 0").select("seq", "stream_id")


@q(RM + """, n as materialized (select *, row_number() over (partition by stream_id order by seq) as i from m),
f(stream_id, i, seq, told, shed, queue) as (
  select stream_id, i, seq, kind <> 'view', kind <> 'view' and cents > 60000, case when kind <> 'view' and cents <= 60000 then [cents] else []::bigint[] end from n where i = 1
  union all
  select n.stream_id, n.i, n.seq, kind <> 'view', kind <> 'view' and coalesce(list_sum(queue), 0) + cents > 60000,
    case when kind = 'view' then queue[2:] when coalesce(list_sum(queue), 0) + cents > 60000 then queue else list_append(queue, cents) end
  from f join n on n.stream_id = f.stream_id and n.i = f.i + 1)
select stream_id, seq, shed, coalesce(list_sum(queue), 0)::bigint as held from f where told""")
def byte_budget(spark, sf):
    """A queue of 60,000 bytes: what doesn't fit is shed, the next may fit; each view takes the head."""
    m = messages(spark, sf).withColumn("read", F.col("kind") == "view")
    return folds.byte_budget(m, "stream_id", ["seq"], "seq", "cents", "read", 60_000)


@q("""with recursive n as materialized (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderkey % 50 + 1 as n, (o_orderkey % 7) as each from orders),
f(o_custkey, i, o_orderkey, claimed, room) as (
  select o_custkey, i, o_orderkey, n <= 120 and n * each <= 200, 120 - case when n <= 120 and n * each <= 200 then n else 0 end from n where i = 1
  union all
  select n.o_custkey, n.i, n.o_orderkey, n <= room and n * each <= 200, room - case when n <= room and n * each <= 200 then n else 0 end
  from f join n on n.o_custkey = f.o_custkey and n.i = f.i + 1)
select o_custkey, o_orderkey, claimed, room::bigint as room from f""")
def sample_budget(spark, sf):
    """Claims on 120 samples of a file of 200 bytes: one that asks for more than is left, or more bytes than the file
    has, reserves nothing."""
    o = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "o_orderkey % 50 + 1 as n", "o_orderkey % 7 as each")
    return folds.claims(o, "o_custkey", ["o_orderkey"], ["o_orderkey", "n", "each"], 120, 200)


@q(M + ", o as (select *, max(case when is_disc then 1 else 0 end) over (partition by stream_id order by seq) as opened from m) select seq, stream_id from o where opened = 1 or kind = 'signup'")
def flush_before_seek(spark, sf):
    return open_after(messages(spark, sf), "stream_id", "seq", F.col("is_disc"), F.col("kind") == "signup").select("seq", "stream_id")


@q(M + ", o as (select *, max(case when is_sync and pts_us >= 1704499200000000 then 1 else 0 end) over (partition by stream_id order by seq) as opened from m) select seq, stream_id from o where opened = 1 or is_disc")
def rebranch_cut(spark, sf):
    """The replacement opens at the first sync row from a time on and stays open; events always pass."""
    m = messages(spark, sf)
    return open_after(m, "stream_id", "seq", F.col("is_sync") & (F.col("pts_us") >= 1704499200000000), F.col("is_disc")).select("seq", "stream_id")


#: Media times up to 200 minutes late, so that streams and arms fall behind.
_MEDIA = "pts_us + ((seq * 7919) % 200) * 60000000"


@q(RM + f""", n as materialized (select *, {_MEDIA} as moment, row_number() over (partition by stream_id order by seq) as i from m),
f(stream_id, i, seq, moment, latest, passed) as (
  select stream_id, i, seq, moment, moment, true from n where i = 1
  union all
  select n.stream_id, n.i, n.seq, n.moment, case when n.moment + 30000000 < latest then latest else n.moment end, n.moment + 30000000 >= latest
  from f join n on n.stream_id = f.stream_id and n.i = f.i + 1)
select stream_id, seq, moment from f where passed""")
def stale_drop(spark, sf):
    """Rows that aren't behind the last row admitted of their stream by more than 30 seconds."""
    m = messages(spark, sf).selectExpr("stream_id", "seq", f"{_MEDIA} as moment", "0 as own", "false as reset")
    gate = folds.sync_gate(m, "stream_id", ["seq"], ["seq", "own", "moment", "reset"], 30_000_000)
    return gate.where("not dropped").select("stream_id", "seq").join(m.select("stream_id", "seq", "moment"), ["stream_id", "seq"])


@q(M + ", h as (select *, row_number() over (partition by stream_id order by seq desc) as n from m) select stream_id, seq, case when n <= 20 then cents end as cents from h")
def history_lookup(spark, sf):
    """Every row asked for again, answered from the last twenty rows of its stream; null: gone from the history."""
    m = messages(spark, sf)
    held = last_n(m, "stream_id", "seq", 20).select("stream_id", "seq", "cents")
    return m.select("stream_id", "seq").join(held, ["stream_id", "seq"], "left")


_BY_STREAM = RM + ", n as materialized (select *, row_number() over (partition by stream_id order by seq) as i from m)"


@q(_BY_STREAM + """, f(stream_id, i, seq, pts_us, let) as (
  select stream_id, i, seq, pts_us, [pts_us] from n where i = 1
  union all
  select n.stream_id, n.i, n.seq, n.pts_us, case when n.pts_us - let[-1] >= 3600000000 then list_append(let, n.pts_us) else let end from f join n on n.stream_id = f.stream_id and n.i = f.i + 1),
g as (select *, len(let) - coalesce(lag(len(let)) over (partition by stream_id order by i), 0) as new from f)
select stream_id, seq, pts_us from g where new = 1""")
def qos_rate_limit(spark, sf):
    return folds.rate_limit(messages(spark, sf), "stream_id", ["seq"], "seq", "pts_us", 3_600_000_000)


@q(_BY_STREAM + """, f(stream_id, i, pts_us, segment, first) as (
  select stream_id, i, pts_us, 0::bigint, pts_us from n where i = 1
  union all
  select n.stream_id, n.i, n.pts_us, segment + cut::int, case when cut then n.pts_us else first end
  from (select f.stream_id, f.i, f.segment, f.first, x.is_sync and x.pts_us - f.first >= 86399999000 as cut from f join n x on x.stream_id = f.stream_id and x.i = f.i + 1) f
  join n on n.stream_id = f.stream_id and n.i = f.i + 1)
select stream_id, segment, first as start, max(pts_us) as stop, count(*) as n from f group by stream_id, segment, first""")
def hls_segments(spark, sf):
    """Segments of a day that end before a sync row; a millisecond short of it will do."""
    return folds.segments(messages(spark, sf), "stream_id", ["seq"], "pts_us", "is_sync", 86_400_000_000, 1000)


@q(_BY_STREAM + """, f(stream_id, i, pts_us, k, fragment, first) as (
  select stream_id, i, pts_us, k, 0::bigint, pts_us from n where i = 1
  union all
  select stream_id, i, now, own, fragment + cut::int, case when cut then now else first end
  from (select x.stream_id, x.i, x.pts_us as now, x.k as own, f.fragment, f.first,
      case when x.stream_id % 2 = 0 and x.is_sync then true
        when x.stream_id % 3 = 0 then x.pts_us + f.k * 1000000 - f.first > 43200000000
        when x.stream_id % 2 = 0 then false
        else x.pts_us - f.first >= 86400000000 end as cut
    from f join n x on x.stream_id = f.stream_id and x.i = f.i + 1))
select stream_id, fragment, first as start, count(*) as n from f group by stream_id, fragment, first""")
def fragment_cut(spark, sf):
    """Even streams are video: a sync row starts a fragment. Every third has a limit of 12 hours, which no fragment passes;
    others without video have a span of a day."""
    m = messages(spark, sf).selectExpr("stream_id", "seq", "pts_us", "k * 1000000L as length", "is_sync", "stream_id % 2 = 0 as video", "if(stream_id % 3 = 0, 43200000000L, 0L) as most")
    return folds.fragments(m, "stream_id", ["seq"], ["pts_us", "length", "is_sync", "video", "most"], 86_400_000_000)


@q(M + ", g as (select *, sum(case when is_sync then 1 else 0 end) over (partition by stream_id order by seq) as segment from m) select stream_id, segment::bigint as segment, row_number() over (partition by stream_id, segment order by seq) as part, seq from g")
def hls_parts(spark, sf):
    g = epochs(messages(spark, sf), "stream_id", "seq", "is_sync", "segment")
    return g.select("stream_id", "segment", F.row_number().over(by(["stream_id", "segment"], "seq")).alias("part"), "seq")


@q("with recursive e as (select distinct l_suppkey % 8 as u, l_suppkey % 8 + l_linenumber as v from lineitem), w(path) as (select distinct [u] from e where u not in (select v from e) union all select list_append(path, e.v) from w join e on e.u = path[-1]), d as (select path[-1] as node, max(len(path)) - 1 as level from w group by node) select node, level, row_number() over (order by level, node) as place from d")
def topo_order(spark, sf):
    """Upstream first: a node's level is the longest path to it, its place the order by level."""
    edges = table(spark, sf, "lineitem").selectExpr("l_suppkey % 8 as u", "l_suppkey % 8 + l_linenumber as v").distinct()
    return spark.createDataFrame(upstream_first(edges), "node long, level long, place long")
