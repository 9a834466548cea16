"""Counters, totals and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import media
from ..functions.rational import up_to
from ..model import messages, table
from ..operators import folds
from ..operators.windows import by, nack_pairs, upto
from .base import M, RM, q


@q(M + ", s as (select kind, pts_us // 86400000000 as day, sum(cents) * 8 as bits from m group by all) select kind as variant, count(*) as segments, cast(ceil(max(bits) / 4 / 10000.0) * 10000 as bigint) as peak, cast(least(ceil(sum(bits) / (count(*) * 4) / 10000.0), ceil(max(bits) / 4 / 10000.0)) * 10000 as bigint) as average from s group by kind")
def ladder_bandwidth(spark, sf):
    """Peak and average bits a second of each variant over segments of four seconds (one a day), rounded up to 10 kb."""
    s = messages(spark, sf).groupBy("kind", F.floor(F.col("pts_us") / 86400000000).alias("day")).agg((F.sum("cents") * 8).alias("bits"))
    peak, average = up_to(F.max("bits") / 4, 10000), up_to(F.sum("bits") / (F.count("*") * 4), 10000)
    return s.groupBy(F.col("kind").alias("variant")).agg(F.count("*").alias("segments"), peak.alias("peak"), F.least(average, peak).alias("average"))


@q(M + "select stream_id, count(*) as n, count(case when kind = 'click' then 1 end) as clicks, count(case when is_disc then 1 end) as errors, sum(cents) as cents from m group by stream_id")
def stats_by_kind(spark, sf):
    return messages(spark, sf).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if("is_disc").alias("errors"), F.sum("cents").alias("cents"))


@q(M + ", x as (select nullif(kind, 'error') as kind, k, stream_id % 5 = 0 as retired from m) select case when grouping(kind) = 1 then 'total' else kind end as node, grouping(kind) = 1 as whole, count(*) as messages, count(case when k >= 90 then 1 end) as dropped, count(case when retired then 1 end) as retired from x group by rollup(kind)")
def stats_rollup(spark, sf):
    """Counts by node and in all; nodes of every fifth stream are removed, and their counts stay in the totals. A node
    without a name is a node of its own, not the total."""
    x = messages(spark, sf).withColumn("kind", F.expr("nullif(kind, 'error')")).withColumn("retired", F.col("stream_id") % 5 == 0)
    whole = F.grouping("kind") == 1
    t = x.rollup("kind").agg(whole.alias("whole"), F.count("*").alias("messages"), F.count_if(F.col("k") >= 90).alias("dropped"), F.count_if("retired").alias("retired"))
    return t.select(F.when(F.col("whole"), "total").otherwise(F.col("kind")).alias("node"), "whole", "messages", "dropped", "retired")


@q(M + "select kind, count(*) as n from m group by kind")
def events_by_type(spark, sf):
    return messages(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@q(M + "select stream_id, max_by(kind, seq) as kind, max(seq) as seq from m group by stream_id")
def last_event(spark, sf):
    return messages(spark, sf).groupBy("stream_id").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


@q(M + "select b.branch, count(*) as n, sum(cents) as cents from m join (values (1, 'x'), (2, 'x'), (3, 'y'), (4, 'y'), (5, 'y')) b(stream_id, branch) using (stream_id) group by b.branch")
def branch_stats(spark, sf):
    nodes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "y")], "stream_id long, branch string")
    return messages(spark, sf).join(F.broadcast(nodes), "stream_id").groupBy("branch").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))  # five literal rows


@q(M + ", s as (select kind, min(pts_us) as first from m where k > 3 group by kind) select max(first) as ready_us, count(*) as sinks from s having count(*) = 5")
def task_ready(spark, sf):
    s = messages(spark, sf).where("k > 3").groupBy("kind").agg(F.min("pts_us").alias("first"))
    return s.agg(F.max("first").alias("ready_us"), F.count("*").alias("sinks")).where("sinks = 5")


@q(M + ", r as (select kind, cents, row_number() over (partition by kind order by cents) - 1 as i, count(*) over (partition by kind) as n from m) select kind, max(case when i = ((n - 1) * 50) // 100 then cents end) as p50, max(case when i = ((n - 1) * 95) // 100 then cents end) as p95, max(case when i = ((n - 1) * 99) // 100 then cents end) as p99 from r group by kind")
def latency_quantiles(spark, sf):
    """Values at rank int((n - 1) * p), without interpolation. Counts by a value's level tell the level of each rank;
    only the distinct values of those levels are put in order, so a kind of any size is no single task's sort."""
    m = messages(spark, sf).select("kind", "cents", F.floor(F.col("cents") / 1024).alias("level"))
    levels = m.groupBy("kind", "level").agg(F.count("*").alias("c"))
    levels = levels.withColumn("stop", F.sum("c").over(upto("kind", "level"))).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    ranks = levels.select("kind", "level", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"div((n - 1) * {p}, 100)").alias("rank")) for p in (50, 95, 99)))).alias("r"), "c", "stop")
    ranks = ranks.where("stop - c <= r.rank and r.rank < stop").select("kind", "level", "r.p", (F.col("r.rank") - F.col("stop") + F.col("c")).alias("left"))
    values = m.join(ranks.select("kind", "level").distinct(), ["kind", "level"], "left_semi").groupBy("kind", "level", "cents").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(upto(["kind", "level"], "cents"))).where("c > 0")
    found = ranks.join(values, ["kind", "level"]).where("upto > left").groupBy("kind", "p").agg(F.min("cents").alias("v"))
    return found.groupBy("kind").agg(*(F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in (50, 95, 99)))


@q(M + ", l as (select seq, last_value(case when kind = 'click' then pts_us end ignore nulls) over w as a, last_value(case when kind = 'view' then pts_us end ignore nulls) over w as v, stream_id from m window w as (partition by stream_id order by seq)) select stream_id, max(abs(a - v)) as drift_us from l group by stream_id")
def av_drift(spark, sf):
    w = upto("stream_id", "seq")
    side = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("pts_us")), True).over(w)
    m = messages(spark, sf).select("stream_id", side("click").alias("a"), side("view").alias("v"))
    return m.groupBy("stream_id").agg(F.max(F.abs(F.col("a") - F.col("v"))).alias("drift_us"))


@q(M + ", d as (select stream_id, pts_us // 86400000000 as day, count(*) as n, sum(cents) as octets from m group by all) select stream_id, day, sum(n) over w as packets, sum(octets) over w as octets from d window w as (partition by stream_id order by day)")
def sender_report(spark, sf):
    d = messages(spark, sf).groupBy("stream_id", F.floor(F.col("pts_us") / 86400000000).alias("day")).agg(F.count("*").alias("n"), F.sum("cents").alias("o"))
    w = upto("stream_id", "day")
    return d.select("stream_id", "day", F.sum("n").over(w).alias("packets"), F.sum("o").over(w).alias("octets"))


_SHARE = "greatest(640, least(cents * 8 // (1 + k % 4), 2000 + 100 * (stream_id % 50)))"


@q(RM + f""", n as materialized (select stream_id, seq, {_SHARE} as share, row_number() over (partition by stream_id order by seq) as i from m where is_sync and cents > 0),
f(stream_id, i, seq, told, news) as (
  select stream_id, i, seq, share, true from n where i = 1
  union all
  select n.stream_id, n.i, n.seq, case when abs(n.share - told) * 10 >= told then n.share else told end, abs(n.share - told) * 10 >= told from f join n on n.stream_id = f.stream_id and n.i = f.i + 1)
select stream_id, seq, told as share from f where news""")
def remb_share(spark, sf):
    """Each sync row is an estimate for 1 to 4 senders in equal shares, held between a floor and the stream's configured
    maximum; told at changes of a tenth."""
    share = F.expr(_SHARE.replace("//", "div"))
    m = messages(spark, sf).where("is_sync and cents > 0").select("stream_id", "seq", share.alias("share"))
    return folds.hysteresis(m, "stream_id", ["seq"], "seq", "share")


@q(M + """, g as (select list(number order by seq) as xs, seq // 400 as report from (select seq, seq % 64 as number from m where seq % 37 = 0 or seq % 41 < 2 union all select seq, seq % 64 from m where seq % 123 = 0) group by seq // 400),
p as (select report, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: case when (x[1] - acc[len(acc) - 1] + 64) % 64 = 0 then acc
    when (x[1] - acc[len(acc) - 1] + 64) % 64 <= 16 then list_concat(acc[1:len(acc) - 1], [acc[len(acc)] | (1 << ((x[1] - acc[len(acc) - 1] + 64) % 64 - 1)::bigint)])
    else list_concat(acc, [x[1], 0::bigint]) end, [xs[1], 0::bigint]) as pairs from g)
select report, i as pair, pairs[2 * i + 1] as first, pairs[2 * i + 2] as mask from (select report, pairs, unnest(range(len(pairs) // 2)) as i from p)""")
def nack_bitmask(spark, sf):
    """Missing numbers of each report packed as a first one and a mask of the sixteen after it; some are told twice."""
    m = messages(spark, sf).select("seq")
    gone = m.where("seq % 37 = 0 or seq % 41 < 2").unionByName(m.where("seq % 123 = 0")).selectExpr("seq", "seq % 64 as number", "seq div 400 as report")
    lists = gone.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("seq", "number"))).alias("x"))  # a report has as many as its rows
    pairs = nack_pairs(F.transform("x", lambda r: r.number), 6)
    return lists.select("report", F.posexplode(pairs)).select("report", F.col("pos").cast("long").alias("pair"), "col.first", "col.mask")


_NODE = "l_suppkey as path, l_linenumber % 3 <> 0 as gated, l_partkey % 50 as tolerance, l_orderkey % 100 as playout, l_linenumber % 2 = 0 as buffered, l_partkey % 70 as max_latency"


@q(f"select path, sum(case when gated then tolerance + playout else 0 end + case when buffered then max_latency else 0 end)::bigint as budget from (select {_NODE} from lineitem) group by path")
def path_latency(spark, sf):
    """What the nodes of a path may add: gates their tolerance and playout delay, buffers the longest wait."""
    t = table(spark, sf, "lineitem").selectExpr(*media.columns_of(_NODE))
    own = F.when(F.col("gated"), F.col("tolerance") + F.col("playout")).otherwise(0) + F.when(F.col("buffered"), F.col("max_latency")).otherwise(0)
    return t.groupBy("path").agg(F.sum(own).alias("budget"))


@q(M + ", s as (select stream_id, k, row_number() over (partition by stream_id order by seq) as n from m) select stream_id, n, greatest(4000, max(ceil(k / 10.0)) over (partition by stream_id order by n) * 1000)::bigint as target_ms from s")
def running_target(spark, sf):
    """Target durations only grow."""
    m = messages(spark, sf).select("stream_id", "k", F.row_number().over(by("stream_id", "seq")).alias("n"))
    return m.select("stream_id", "n", F.greatest(F.lit(4000), F.max(F.ceil(F.col("k") / 10)).over(upto("stream_id", "n")) * 1000).cast("long").alias("target_ms"))
