"""Commands, pauses, injections, admission, end of stream, picture order and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import messages
from ..operators.windows import by, epochs, upto
from .base import M, q

#: Sync rows are commands, by their k: what they set and to what.
_COMMANDS = {"rate": ("k % 6 = 0", "k % 4"), "bitrate": ("k % 6 = 1", "64000 + 1000 * k"), "selected": ("k % 6 = 2", "k % 3"), "paused": ("k % 6 in (3, 4)", "k % 2"), "position": ("k % 6 = 5", "pts_us - 1000000 * k")}


@q(M + "select seq, " + ", ".join(f"last_value(case when is_sync and {on} then {to} end ignore nulls) over w as {name}" for name, (on, to) in _COMMANDS.items()) + ", count(case when is_sync and k % 5 = 0 then 1 end) over w as keyframes_asked from m window w as (partition by stream_id order by seq)")
def control_state(spark, sf):
    """What each message finds set: the last rate, bitrate, arm, pause and seek before it, and the key frames asked for."""
    w = upto("stream_id", "seq")
    state = [F.last(F.expr(f"case when is_sync and {on} then {to} end"), True).over(w).alias(name) for name, (on, to) in _COMMANDS.items()]
    return messages(spark, sf).select("seq", *state, F.count_if(F.expr("is_sync and k % 5 = 0")).over(w).alias("keyframes_asked"))


_PAUSED = "case when is_sync and k % 2 = 1 then 1 when is_sync then 0 end"


@q(M + f""", p as (select *, coalesce(last_value({_PAUSED} ignore nulls) over w, 0) as paused from m window w as (partition by stream_id order by seq)),
r as (select *, min(case when is_sync and k % 2 = 0 then seq end) over (partition by stream_id order by seq rows between 1 following and unbounded following) as resumed from p where not is_sync or true)
select seq, stream_id, case when paused = 1 then resumed else seq end as released_by from r where not is_sync""")
def node_pause(spark, sf):
    """A paused node holds messages until it is resumed; what is held at the end is never released."""
    paused = F.coalesce(F.last(F.expr(_PAUSED), True).over(upto("stream_id", "seq")), F.lit(0))
    resumed = F.min(F.expr("case when is_sync and k % 2 = 0 then seq end")).over(by("stream_id", "seq").rowsBetween(1, Window.unboundedFollowing))
    m = messages(spark, sf).withColumn("paused", paused).withColumn("resumed", resumed).where("not is_sync")
    return m.select("seq", "stream_id", F.when(F.col("paused") == 1, F.col("resumed")).otherwise(F.col("seq")).alias("released_by"))


@q(M + ", i as (select seq, stream_id, 0 as part, kind, cents from m union all select seq, stream_id, 1, 'injected', 0 from m where is_disc) select stream_id, seq, part, kind, cents, row_number() over (partition by stream_id order by seq, part) as n from i")
def inject_rows(spark, sf):
    """A message injected after every discontinuity, in its place in the stream."""
    m = messages(spark, sf)
    rows = m.select("seq", "stream_id", F.when(F.col("is_disc"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("p"), "kind", "cents")
    rows = rows.select("stream_id", "seq", F.explode("p").alias("part"), "kind", "cents")
    rows = rows.withColumn("kind", F.when(F.col("part") == 1, "injected").otherwise(F.col("kind"))).withColumn("cents", F.when(F.col("part") == 1, 0).otherwise(F.col("cents")))
    return rows.withColumn("n", F.row_number().over(by("stream_id", ["seq", "part"])))


_AHEAD = 3


@q(M + f""", a as (select stream_id, kind, seq, arrival_us, row_number() over (partition by stream_id, kind order by seq) as n from m where kind in ('click', 'view', 'signup')),
s as (select stream_id, n, max(max(arrival_us)) over (partition by stream_id order by n) as step_us from a group by stream_id, n)
select a.seq, a.stream_id, greatest(arrival_us, coalesce(step_us, 0)) as admitted_us, coalesce(step_us > arrival_us, false) as blocked from a left join s on s.stream_id = a.stream_id and s.n = a.n - {_AHEAD}""")
def arm_admission(spark, sf):
    """A producer that is three rows ahead of the join waits until the join has taken the row that many before."""
    a = messages(spark, sf).where(F.col("kind").isin("click", "view", "signup")).withColumn("n", F.row_number().over(by(["stream_id", "kind"], "seq")))
    steps = a.groupBy("stream_id", "n").agg(F.max("arrival_us").alias("last")).withColumn("step_us", F.max("last").over(upto("stream_id", "n")))
    j = a.join(steps.select("stream_id", (F.col("n") + _AHEAD).alias("n"), "step_us"), ["stream_id", "n"], "left")
    return j.select("seq", "stream_id", F.greatest("arrival_us", F.coalesce("step_us", F.lit(0))).alias("admitted_us"), F.coalesce(F.col("step_us") > F.col("arrival_us"), F.lit(False)).alias("blocked"))


@q(M + ", e as (select stream_id, kind, max(seq) as eos from m group by stream_id, kind) select stream_id, kind, eos, eos = max(eos) over (partition by stream_id) as ends_join, count(*) over (partition by stream_id order by eos rows between 1 following and unbounded following) as still_open from e")
def end_of_stream(spark, sf):
    """Where each arm ends; a join ends with its last arm."""
    e = messages(spark, sf).groupBy("stream_id", "kind").agg(F.max("seq").alias("eos"))
    later = by("stream_id", "eos").rowsBetween(1, Window.unboundedFollowing)
    return e.select("stream_id", "kind", "eos", (F.col("eos") == F.max("eos").over(Window.partitionBy("stream_id"))).alias("ends_join"), F.count(F.lit(1)).over(later).alias("still_open"))


@q(M + ", g as (select *, sum(is_sync::int) over (partition by stream_id order by seq) as gop from m) select stream_id, seq, gop::bigint as gop, row_number() over (partition by stream_id, gop order by arrival_us, seq) as shown from g")
def picture_order(spark, sf):
    """Pictures are decoded in one order and shown in that of their times, key frame by key frame."""
    g = epochs(messages(spark, sf), "stream_id", "seq", "is_sync", "gop")
    return g.select("stream_id", "seq", "gop", F.row_number().over(by(["stream_id", "gop"], ["arrival_us", "seq"])).alias("shown"))


@q(M + """, c as (select kind, count(*) as n, count(case when k >= 90 then 1 end) as d, sum(cents) as b from m group by kind)
select kind, 'streamloom_messages_total{node="' || kind || '"} ' || n || chr(10) || 'streamloom_dropped_total{node="' || kind || '"} ' || d || chr(10) || 'streamloom_bytes_total{node="' || kind || '"} ' || b as text from c""")
def metrics_export(spark, sf):
    """Counters of each node in the text format that metric collectors read."""
    c = messages(spark, sf).groupBy("kind").agg(F.count("*").alias("messages"), F.count_if(F.col("k") >= 90).alias("dropped"), F.sum("cents").alias("bytes"))
    line = lambda name: F.format_string('streamloom_%s_total{node="%s"} %d', F.lit(name), "kind", name)
    return c.select("kind", F.concat_ws("\n", line("messages"), line("dropped"), line("bytes")).alias("text"))
