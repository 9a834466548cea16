"""Joins and alignment of several streams or arms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import messages
from ..operators import folds
from ..operators.joins import active_arm, arrival_zip as zip_arms, asof, band, mix
from ..operators.windows import by
from .base import M, RM, q

#: Media times up to 200 minutes late, so that streams and arms fall behind.
_MEDIA = "pts_us + ((seq * 7919) % 200) * 60000000"
_ARMS = ["click", "view", "signup"]
_ZIP = M + ", n as (select *, row_number() over (partition by stream_id, kind order by seq) as step from m), z as (select stream_id, step, max(case when kind = 'click' then cents end) as click, max(case when kind = 'view' then cents end) as view, max(case when kind = 'signup' then cents end) as signup from n where kind in ('click', 'view', 'signup') group by stream_id, step) "


def _zipped(spark, sf):
    return zip_arms(messages(spark, sf), "stream_id", "kind", "seq", "cents", _ARMS)


@q(_ZIP + "select * from z")
def arrival_zip(spark, sf):
    return _zipped(spark, sf)


@q(_ZIP + "select stream_id, step, greatest(-32768, least(32767, coalesce(click, 0) + coalesce(view, 0) + coalesce(signup, 0))) as mixed from z")
def mix_clamp(spark, sf):
    return _zipped(spark, sf).select("stream_id", "step", mix(None, _ARMS).alias("mixed"))


@q(_ZIP + "select stream_id, step, greatest(-32768, least(32767, greatest(-32768, least(32767, coalesce(click, 0) + coalesce(view, 0))) + coalesce(signup, 0))) as mixed from z")
def nested_mix(spark, sf):
    return _zipped(spark, sf).withColumn("inner", mix(None, ["click", "view"])).select("stream_id", "step", mix(None, ["inner", "signup"]).alias("mixed"))


@q(RM + f""", n as materialized (select *, case when k <> 13 then {_MEDIA} end as moment, k::bigint * 60000000 as length, row_number() over (partition by stream_id order by seq) as i from m where kind <> 'purchase'),
z as (select stream_id, max(i) as most from n group by stream_id),
f(stream_id, i, turn, a, b, c, next, ended, live, gone, step, told) as (
  select stream_id, 0::bigint, 0, []::struct(id bigint, moment bigint, length bigint)[], []::struct(id bigint, moment bigint, length bigint)[], []::struct(id bigint, moment bigint, length bigint)[], null::bigint, false, true, 0::bigint, -1::bigint, null::struct(moment bigint, a bigint, b bigint, c bigint) from z
  union all
  select g.stream_id, case when act = 'read' then g.i + 1 else g.i end, turn + 1,
    case when act = 'drop' and sa then a[2:] when act = 'step' and ta then a[2:] when act = 'read' and n.is_disc then a[1:0] when act = 'read' and n.kind = 'click' then list_append(a, x) else a end,
    case when act = 'drop' and not sa and sb then b[2:] when act = 'step' and tb then b[2:] when act = 'read' and n.is_disc then b[1:0] when act = 'read' and n.kind = 'view' then list_append(b, x) else b end,
    case when act = 'drop' and not sa and not sb then c[2:] when act = 'step' and tc then c[2:] when act = 'read' and n.is_disc then c[1:0] when act = 'read' and n.kind = 'signup' then list_append(c, x) else c end,
    case when act = 'step' and t is not null then t + span when act = 'read' and n.is_disc then null else next end,
    ended or act = 'end', act <> 'stop', gone + case when act = 'drop' then 1 when act = 'read' and n.is_disc then len(a) + len(b) + len(c) else 0 end,
    case when act = 'step' then step + 1 else step end,
    case when act = 'step' then struct_pack(moment := t, a := case when ta then a[1].id end, b := case when tb then b[1].id end, c := case when tc then c[1].id end) end
  from (select *, len(a) > 0 and (t is null or a[1].moment is null or a[1].moment <= t + span // 2) as ta,
      len(b) > 0 and (t is null or b[1].moment is null or b[1].moment <= t + span // 2) as tb,
      len(c) > 0 and (t is null or c[1].moment is null or c[1].moment <= t + span // 2) as tc,
      case when sa or sb or sc then 'drop' when ready then 'step' when i < most then 'read' when not ended then 'end' else 'stop' end as act
    from (select *, case when t = a[1].moment then a[1].length when t = b[1].moment then b[1].length else c[1].length end as span,
        case when ended then len(a) + len(b) + len(c) > 0 else len(a) > 0 and len(b) > 0 and len(c) > 0 end as ready
      from (select f.*, z.most, list_min([a[1].moment, b[1].moment, c[1].moment]) as t,
          coalesce(a[1].moment < next - a[1].length // 2, false) as sa, coalesce(b[1].moment < next - b[1].length // 2, false) as sb, coalesce(c[1].moment < next - c[1].length // 2, false) as sc
        from f join z using (stream_id) where f.live))) g
  left join (select *, struct_pack(id := seq, moment := moment, length := length) as x from n) n on g.act = 'read' and n.stream_id = g.stream_id and n.i = g.i + 1)
select stream_id, step, told.moment as moment, told.a as click, told.b as view, told.c as signup, gone as dropped from f where told is not null""")
def pts_join(spark, sf):
    """Three arms of a stream joined by presentation time: a row's length is its tolerance twice over; rows without a time
    take part at once; errors reset the join."""
    m = messages(spark, sf).where("kind <> 'purchase'").selectExpr("stream_id", "seq", "kind", f"if(k <> 13, {_MEDIA}, null) as moment", "k * 60000000L as length", "is_disc")
    j = folds.by_pts(m, "stream_id", ["seq"], ["seq", "kind", "moment", "length", "is_disc"], _ARMS)
    return j.select("stream_id", "step", F.col("at").alias("moment"), *(F.col("rows")[i].alias(a) for i, a in enumerate(_ARMS)), "dropped")


@q(M + ", p as (select l.stream_id, l.pts_us as l_ts, l.seq as l_id, r.pts_us as r_ts, r.seq as r_id, row_number() over (partition by l.seq order by abs(l.pts_us - r.pts_us), r.pts_us, r.seq) as n from m l join m r on l.stream_id = r.stream_id and l.kind = 'click' and r.kind = 'view' and abs(l.pts_us - r.pts_us) <= 7200000000) select stream_id, l_ts, l_id, r_ts, r_id from p where n = 1")
def pts_band_join(spark, sf):
    m = messages(spark, sf).select("stream_id", "kind", "pts_us", F.col("seq").alias("id"))
    return band(m.where("kind = 'click'"), m.where("kind = 'view'"), "stream_id", "pts_us", 7_200_000_000)


@q(M + ", l as (select seq, stream_id, kind, last_value(case when is_sync then case k % 3 when 0 then 'click' when 1 then 'view' else 'signup' end end ignore nulls) over (partition by stream_id order by seq) as active from m) select seq, stream_id, active from l where active = kind")
def select_active(spark, sf):
    """Sync rows are commands that name the arm from then on, in order of arrival."""
    names = F.when(F.col("k") % 3 == 0, "click").when(F.col("k") % 3 == 1, "view").otherwise("signup")
    return active_arm(messages(spark, sf), "stream_id", "seq", F.when(F.col("is_sync"), names), "kind").select("seq", "stream_id", "active")


@q(M + "select c.seq, c.stream_id, (select min(s.pts_us) from m s where s.is_sync and s.stream_id = c.stream_id and s.pts_us >= c.pts_us) as at_us from m c where c.kind = 'click'")
def asof_lookup(spark, sf):
    m = messages(spark, sf)
    keys = m.where("is_sync").select("stream_id", "pts_us").withColumn("v", F.col("pts_us"))
    return asof(m.where("kind = 'click'").select("seq", "stream_id", "pts_us"), keys, "stream_id", "pts_us", "v", "at_us", forward=True).select("seq", "stream_id", "at_us")


@q(M + "select c.seq, c.stream_id, (select max(s.pts_us) from m s where s.is_sync and s.stream_id = c.stream_id and s.pts_us <= c.pts_us) as key_us from m c where c.kind = 'view'")
def seek_keyframe(spark, sf):
    m = messages(spark, sf)
    keys = m.where("is_sync").select("stream_id", "pts_us").withColumn("v", F.col("pts_us"))
    return asof(m.where("kind = 'view'").select("seq", "stream_id", "pts_us"), keys, "stream_id", "pts_us", "v", "key_us").select("seq", "stream_id", "key_us")


_GATE = RM + f""", n as materialized (select *, {_MEDIA} as moment, row_number() over (partition by stream_id order by seq) as i from m where kind <> 'signup') """


def _gate(spark, sf, hold: bool):
    """The kinds of a user as streams that share a timeline; errors reset it."""
    m = messages(spark, sf).where("kind <> 'signup'").selectExpr("stream_id as user", "seq", "kind", f"{_MEDIA} as moment", "is_disc")
    return folds.sync_gate(m, "user", ["seq"], ["seq", "kind", "moment", "is_disc"], 1_800_000_000, hold)


@q(_GATE + """, f(stream_id, i, seq, told, dropped, behind, latest) as (
  select stream_id, i, seq, not is_disc, false, 0::bigint, case when is_disc then map([]::varchar[], []::bigint[]) else map([kind], [moment]) end from n where i = 1
  union all
  select stream_id, i, seq, not is_disc, drop_it, case when drop_it then worst - moment else 0 end,
    case when is_disc then map([]::varchar[], []::bigint[]) when drop_it then latest else map_concat(latest, map([kind], [moment])) end
  from (select *, not is_disc and worst is not null and moment + 1800000000 < worst as drop_it
    from (select n.*, f.latest, case when n.moment + 1800000000 < f.latest[n.kind] then f.latest[n.kind] else list_max(map_values(f.latest)) end as worst
      from f join n on n.stream_id = f.stream_id and n.i = f.i + 1)))
select stream_id as user, seq, dropped, behind from f where told""")
def sync_drop_late(spark, sf):
    """Across streams: rows behind any stream's last admitted time by more than half an hour are dropped."""
    return _gate(spark, sf, False).select("user", "seq", "dropped", "behind")


@q()
def sync_hold(spark, sf):
    """Across streams: a row waits while its stream is more than half an hour ahead of the one furthest behind."""
    return _gate(spark, sf, True)
