"""Scans, filters, sinks and per-row timing."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import media
from ..functions.rational import ntp, whole_div
from ..model import messages, micros, table
from ..operators import folds
from ..operators.windows import by, epochs, upto
from ..sources import store, testsrc
from .base import M, RM, q

START = 1704067200000000  # 2024-01-01 in microseconds


@q("select event_id, user_id, event_type, epoch_us(ts) as pts_us, props from events")
def scan_table(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("pts_us"), "props")


@q(M + "select seq, pts_us, kind from m where stream_id = 7")
def stream_select(spark, sf):
    return messages(spark, sf).where("stream_id = 7").select("seq", "pts_us", "kind")


@q(M + "select seq, stream_id, kind from m where kind in ('error', 'signup')")
def route_by_event(spark, sf):
    return messages(spark, sf).where(F.col("kind").isin("error", "signup")).select("seq", "stream_id", "kind")


@q(M + f", cut as (select stream_id, min(case when pts_us >= {START + 5 * 86400000000} then seq end) as stop from m group by stream_id) select m.seq, m.stream_id, m.pts_us from m join cut using (stream_id) where stop is null or m.seq < stop")
def segment_window(spark, sf):
    over = F.max((F.col("pts_us") >= START + 5 * 86400000000).cast("int")).over(upto("stream_id", "seq"))
    return messages(spark, sf).withColumn("over", over).where("over = 0").select("seq", "stream_id", "pts_us")


@q("select * from orders")
def remux_copy(spark, sf):
    return table(spark, sf, "orders")


#: Selectors: name, id, kind, place among the source's streams; null is any.
_SELECTORS = [("video", None, "view", None), ("second", None, None, 2), ("click 3", None, "click", 3), ("id", "17/error", None, None), ("any", None, None, None), ("gone", None, "nothing", None)]


@q(M + f""", s as (select source, kind, source || '/' || kind as id, row_number() over (partition by source order by first) as place from (select stream_id as source, kind, min(seq) as first from m group by stream_id, kind)),
x as (select source, name, count(case when (x.id is null or x.id = s.id) and (x.kind is null or x.kind = s.kind) and (x.place is null or x.place = s.place) then 1 end) as matches
  from s, (values {", ".join("(" + ", ".join("null" if v is None else "'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _SELECTORS)}) x(name, id, kind, place) group by source, name)
select source, name, matches, case matches when 0 then 'missing' when 1 then 'ok' else 'ambiguous' end as verdict from x""")
def selector_match(spark, sf):
    """How many of a source's streams each selector names: none is missing, several are ambiguous."""
    m = messages(spark, sf).groupBy(F.col("stream_id").alias("source"), "kind").agg(F.min("seq").alias("first"))
    s = m.withColumn("id", F.concat(F.col("source").cast("string"), F.lit("/"), "kind")).withColumn("place", F.row_number().over(by("source", "first")))
    fits = [F.lit(True) if i is None else F.col("id") == i for _, i, _, _ in _SELECTORS]
    fits = [f & (F.lit(True) if k is None else F.col("kind") == k) & (F.lit(True) if p is None else F.col("place") == p) for f, (_, _, k, p) in zip(fits, _SELECTORS)]
    counts = s.groupBy("source").agg(*(F.count_if(f).alias(n) for f, (n, *_) in zip(fits, _SELECTORS)))
    told = counts.select("source", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("matches")) for n, *_ in _SELECTORS))).alias("x")).select("source", "x.*")
    return told.withColumn("verdict", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "ok").otherwise("ambiguous"))


@q(M + f", f as (select *, row_number() over (partition by stream_id order by seq) as n from m where kind = 'click' and pts_us >= {START + 86400000000} and pts_us < {START + 6 * 86400000000}) select seq, stream_id, n from f where n <= 3")
def match_first_within(spark, sf):
    """Time bounds first, then the first n of those inside."""
    first, end = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-07").cast("timestamp_ntz")
    # on the columns as they are stored, so that the scan prunes by them
    events = table(spark, sf, "events").where((F.col("event_type") == "click") & (F.col("ts") >= first) & (F.col("ts") < end))
    inside = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("stream_id"))
    return inside.withColumn("n", F.row_number().over(by("stream_id", "seq"))).where("n <= 3").select("seq", "stream_id", "n")


@q(M + "select seq, stream_id || '@events' as qualified, kind as name from m")
def qualify_ids(spark, sf):
    return messages(spark, sf).select("seq", F.concat(F.col("stream_id").cast("string"), F.lit("@events")).alias("qualified"), F.col("kind").alias("name"))


@q(M + "select seq, arrival_us - pts_us as waited from m where arrival_us - pts_us <= 120000000")
def stale_latency(spark, sf):
    m = messages(spark, sf).withColumn("waited", F.col("arrival_us") - F.col("pts_us"))
    return m.where("waited <= 120000000").select("seq", "waited")


#: Kinds as media: click and purchase are video (purchase a key frame), view is audio, the others events.
_VIDEO = "kind in ('click', 'purchase')"


@q(M + f"select seq, kind, is_sync from m where not ({_VIDEO} and not is_sync)")
def drop_nonkey(spark, sf):
    """Video that isn't a key frame is shed, audio and events aren't."""
    return messages(spark, sf).where(f"not ({_VIDEO} and not is_sync)").select("seq", "kind", "is_sync")


_POLICIES = ["never", "block", "oldest", "newest", "until sync", "non-key video"]
_POLICY = "case stream_id % 6 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_POLICIES)) + " end"
_RESETS = "kind in ('purchase', 'view', 'error')"  # a key frame, audio, a discontinuity


@q(RM + f""", n as materialized (select stream_id, seq, {_POLICY} as policy, stream_id % 4 as capacity, {_RESETS} as sync, {_VIDEO} and not is_sync as plain, k % 3 = 0 as taken, row_number() over (partition by stream_id order by seq) as i from m),
f(stream_id, i, seq, held, closed, action) as (
  select stream_id, 0::bigint, null::bigint, 0::bigint, false, '' from n where i = 1
  union all
  select stream_id, i, seq, case when action in ('admit', 'admit and open') then held + 1 else held end, case when action in ('open', 'admit and open') then false when action = 'close' then true else closed end, action
  from (select *, case when capacity = 0 then 'admit'
        when closed and not sync then 'drop' when closed and brim then 'open' when closed then 'admit and open'
        when not brim then 'admit'
        when policy = 'oldest' then 'evict' when policy = 'newest' then 'drop' when policy = 'block' then 'block'
        when policy = 'until sync' and sync then 'evict' when policy = 'until sync' then 'close'
        when policy = 'non-key video' and plain then 'drop' else 'refuse' end as action
    from (select n.*, f.closed, greatest(0, f.held - n.taken::int) as held, greatest(0, f.held - n.taken::int) >= n.capacity as brim from f join n on n.stream_id = f.stream_id and n.i = f.i + 1)))
select stream_id, seq, case action when 'open' then 'evict' when 'close' then 'drop' when 'admit and open' then 'admit' else action end as action from f where i > 0""")
def drop_decision(spark, sf):
    """What a bounded queue does with each message, by policy, room and whether it waits for a sync point."""
    m = messages(spark, sf).selectExpr("stream_id", "seq", f"{_POLICY} as policy", "stream_id % 4 as capacity", f"{_RESETS} as sync", f"{_VIDEO} and not is_sync as plain", "k % 3 = 0 as taken")
    return folds.queue_actions(m, "stream_id", ["seq"], ["seq", "policy", "capacity", "sync", "plain", "taken"])


@q(M + "select stream_id, count(*) as n from m where cents > 5000 group by stream_id")
def tap_view(spark, sf):
    messages(spark, sf).createOrReplaceTempView("messages_tap")
    return spark.sql("select stream_id, count(*) as n from messages_tap where cents > 5000 group by stream_id")


@q(M + f", e as (select *, sum(cast(is_disc as bigint)) over (partition by stream_id order by seq) as epoch from m), a as (select *, first_value(pts_us) over (partition by stream_id, epoch order by seq) as p0, first_value(arrival_us) over (partition by stream_id, epoch order by seq) as a0 from e) select seq, epoch, a0 + pts_us - p0 + 200000 as due_us, arrival_us > a0 + pts_us - p0 + 200000 + 60000000 as late from a")
def playout_due(spark, sf):
    m = epochs(messages(spark, sf), "stream_id", "seq", "is_disc")
    w = by(["stream_id", "epoch"], "seq")
    due = F.first("arrival_us").over(w) + F.col("pts_us") - F.first("pts_us").over(w) + 200000
    return m.withColumn("due_us", due).select("seq", "epoch", "due_us", (F.col("arrival_us") > F.col("due_us") + 60000000).alias("late"))


@q(M + f", c as (select seq, stream_id, pts_us, case when is_sync then pts_us end as anchor, case when is_sync then k % 3 end as rate from m), r as (select seq, pts_us, last_value(anchor ignore nulls) over w as anchor, last_value(rate ignore nulls) over w as rate from c window w as (partition by stream_id order by seq)) select seq, anchor + (pts_us - anchor) * rate as media_us from r where anchor is not null")
def timeline_reading(spark, sf):
    w = upto("stream_id", "seq")
    m = messages(spark, sf).withColumn("anchor", F.last(F.when(F.col("is_sync"), F.col("pts_us")), True).over(w)).withColumn("rate", F.last(F.when(F.col("is_sync"), F.col("k") % 3), True).over(w))
    return m.where("anchor is not null").select("seq", (F.col("anchor") + (F.col("pts_us") - F.col("anchor")) * F.col("rate")).alias("media_us"))


@q(M + "select seq, pts_us // 1000000 + 2208988800 as ntp_seconds, cast(((pts_us % 1000000) * 4294967296) // 1000000 as bigint) as ntp_fraction from m")
def ntp_time(spark, sf):
    return messages(spark, sf).select("seq", *ntp(F.col("pts_us")))


@q(M + "select seq, coalesce(nullif(k - 40, 0), case when cents > 0 then cents * 1000000000 // 48000 end, 0) as duration_ns from m")
def frame_duration(spark, sf):
    own = F.when(F.col("k") != 40, (F.col("k") - 40).cast("long"))
    return messages(spark, sf).select("seq", F.coalesce(own, F.when(F.col("cents") > 0, whole_div(F.col("cents") * 1000000000, F.lit(48000))), F.lit(0).cast("long")).alias("duration_ns"))


@q("""with g as (select p as pattern, n.r as frame, x.r as x, y.r as y from range(10) n(r), range(16) x(r), range(9) y(r), (values ('gradient'), ('bars'), ('solid')) p(p))
select pattern, frame, x, y, case pattern when 'gradient' then (x + y + 3 * frame) % 256 when 'bars' then [235, 210, 170, 145, 106, 81, 41, 16][x * 8 // 16 + 1] else frame % 256 end as luma from g""")
def testsrc_range(spark, sf):
    """Frames of the test source: a moving gradient, eight bars, a plane of the frame's number."""
    p = spark.range(3 * 10 * 16 * 9).selectExpr("id div 1440 as p", "id div 144 % 10 as frame", "id div 9 % 16 as x", "id % 9 as y")
    bars = F.element_at(F.array(*map(F.lit, testsrc.BARS)), (F.expr("x * 8 div 16") + 1).cast("int"))
    luma = F.when(F.col("p") == 0, (F.col("x") + F.col("y") + 3 * F.col("frame")) % 256).when(F.col("p") == 1, bars).otherwise(F.col("frame") % 256)
    names = F.when(F.col("p") == 0, "gradient").when(F.col("p") == 1, "bars").otherwise("solid")
    return p.select(names.alias("pattern"), "frame", "x", "y", luma.cast("long").alias("luma"))


@q("select cast(r as bigint) as attempt, least(500 * (1::bigint << (r - 1)), 30000) as backoff_ms from range(1, 13) t(r)")
def backoff_schedule(spark, sf):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), F.expr("least(500 * shiftleft(cast(1 as bigint), cast(id - 1 as int)), 30000)").alias("backoff_ms"))


# Formats with extensions, media types, signatures as (offset, hex), score, protocol, in order.
PROBES = [
    ("ogg", ".ogg .opus", "audio/ogg application/ogg audio/opus", [(0, "4F676753")], 100, ""),
    ("ivf", ".ivf", "", [(0, "444B4946")], 100, ""),
    ("flv", ".flv", "video/x-flv", [(0, "464C56")], 100, ""),
    ("matroska", ".webm .mkv .mka", "video/webm audio/webm video/x-matroska audio/x-matroska", [(0, "1A45DFA3")], 100, ""),
    ("mp4", ".mp4 .m4a .m4v .mov", "video/mp4 audio/mp4 video/quicktime", [(4, "66747970")], 100, ""),
    ("annexb", ".h264 .264 .annexb", "", [(0, "000001"), (0, "00000001")], 90, ""),
    ("adts", ".aac .adts", "audio/aac audio/x-aac", [(0, "FFF1"), (0, "FFF9"), (0, "FFF0"), (0, "FFF8")], 100, ""),
    ("mp3", ".mp3", "audio/mpeg audio/mp3", [(0, "494433"), (0, "FFFB"), (0, "FFFA"), (0, "FFF3"), (0, "FFF2"), (0, "FFE3")], 100, ""),
    ("flac", ".flac", "audio/flac audio/x-flac", [(0, "664C6143")], 100, ""),
    ("wav", ".wav", "audio/wav audio/x-wav audio/wave", [(8, "57415645")], 100, ""),
    ("rtp", "", "", [], 80, "rtp"),
    ("webrtc", "", "", [], 80, "webrtc"),
]
_NAMES = ["a.ogg", "b.ivf", "http://h/x.webm?y=1#z.mp4", "c.MKV", "d.txt", "e.mp4", "f.264", "g.aac", "dir.mp3/h", "i.flac", "j.WAV", "k.flv", "", "plain#1.ogg"]
_TYPES = ["", "video/WEBM", "audio/ogg", "video/mp4", "text/html", "audio/x-wav", "", "audio/mp3"]
_HEADS = ["", "4F67675300", "000000186674797069736F6D", "1A45DFA3", "00000001", "FFF150", "52494646000000005741564566", "494433", "664C", "FFE3", "ABCD"]
_ASK = ", ".join("case page_id % {} {} end as {}".format(len(v), " ".join(f"when {i} then '{x}'" for i, x in enumerate(v)), n) for n, v in (("name", _NAMES), ("mime", _TYPES), ("head", _HEADS))) + ", case when page_id % 17 = 0 then 'rtp' else '' end as protocol"
_RULES = ", ".join(f"({i}, '{f}', '{e}', '{m}', '{' '.join(f'{o}:{h}' for o, h in g)}', {s}, '{p}')" for i, (f, e, m, g, s, p) in enumerate(PROBES))


@q(f"""with a as (select page_id, {_ASK} from pages), p as (select *, case when contains(name, '://') then regexp_replace(name, '[?#].*$', '') else name end as path from a),
e as (select *, lower(regexp_extract(path, '[.][^./]*$')) as ext from p), r as (select * from (values {_RULES}) r(nth, format, exts, mimes, magics, score, proto)),
h as (select page_id, nth, format, case when proto <> '' and proto = protocol then score
    when mime <> '' and list_contains(string_split(mimes, ' '), lower(mime)) then score - 10
    when magics <> '' and len(list_filter(string_split(magics, ' '), lambda g: starts_with(substring(head, 2 * split_part(g, ':', 1)::int + 1), split_part(g, ':', 2)))) > 0 then score
    when ext <> '' and list_contains(string_split(exts, ' '), ext) then score - 20 end as score from e, r)
select page_id, format, score from (select *, row_number() over (partition by page_id order by score desc, nth) as n from h where score is not null) where n = 1""")
def probe_rules(spark, sf):
    """Formats by protocol, media type (less 10), signature, extension (less 20); of equal scores the first rule's."""
    a = table(spark, sf, "pages").selectExpr("page_id", *media.columns_of(_ASK))
    path = F.when(F.col("name").contains("://"), F.regexp_replace("name", "[?#].*$", "")).otherwise(F.col("name"))
    a = a.withColumn("ext", F.lower(F.regexp_extract(path, "[.][^./]*$", 0))).withColumn("mime", F.lower("mime"))
    rules = [dict(format=f, exts=e.split(), mimes=m.split(), magics=[dict(at=2 * o + 1, bytes=h) for o, h in g], score=s, protocol=p) for f, e, m, g, s, p in PROBES]
    known = F.from_json(F.lit(json.dumps(rules)), "array<struct<format:string,exts:array<string>,mimes:array<string>,magics:array<struct<at:int,bytes:string>>,score:int,protocol:string>>")

    def score(r):
        magic = F.exists(r.magics, lambda g: F.substring(F.col("head"), g.at, F.length(g.bytes)) == g.bytes)
        own = F.when((r.protocol != "") & (F.col("protocol") == r.protocol), r.score).when(F.array_contains(r.mimes, F.col("mime")), r.score - 10)
        return own.when(magic, r.score).when(F.array_contains(r.exts, F.col("ext")), r.score - 20)

    hits = F.transform(known, lambda r, i: F.struct(score(r).alias("score"), (-i).alias("at"), r["format"].alias("format")))
    best = a.select("page_id", F.array_max(F.filter(hits, lambda h: h.score.isNotNull())).alias("b"))
    return best.where("b is not null").select("page_id", "b.format", "b.score")


@q(M + "select * from (select kind, count(*) as n, sum(cents) as cents from m group by kind)")
def sink_write(spark, sf):
    """Written to the shared folder and read again: what a destination holds is what was sent."""
    path = store.new_folder(spark, "sink")
    messages(spark, sf).select("kind", "cents").write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@q(M + "select stream_id, min_by(case when is_disc then 'failed' when is_sync then 'committed' else 'aborted' end, seq) as outcome from m where is_disc or is_sync or kind = 'signup' group by stream_id")
def commit_outcome(spark, sf):
    """The first finalization of a destination wins."""
    m = messages(spark, sf).where("is_disc or is_sync or kind = 'signup'")
    return m.groupBy("stream_id").agg(F.min_by(F.expr("case when is_disc then 'failed' when is_sync then 'committed' else 'aborted' end"), "seq").alias("outcome"))


@q(M + "select seq, 'a' as branch, cents as v from m where kind = 'click' union all select seq, 'b', k from m where kind = 'view'")
def shared_mux(spark, sf):
    m = messages(spark, sf)
    a, b = m.where("kind = 'click'").select("seq", F.lit("a").alias("branch"), F.col("cents").alias("v")), m.where("kind = 'view'").select("seq", F.lit("b").alias("branch"), F.col("k").cast("long").alias("v"))
    return a.unionByName(b)


@q(M + "select branch, count(*) as n, sum(v) as total from (select 'all' as branch, cents as v from m union all select 'sync', cents from m where is_sync union all select 'small', k from m where k < 10) group by branch")
def fanout_branches(spark, sf):
    """One scan for all branches: each row is dealt to the branches that want it."""
    want = F.array(F.struct(F.lit("all").alias("branch"), F.col("cents").alias("v")), F.when(F.col("is_sync"), F.struct(F.lit("sync").alias("branch"), F.col("cents").alias("v"))), F.when(F.col("k") < 10, F.struct(F.lit("small").alias("branch"), F.col("k").cast("long").alias("v"))))
    d = messages(spark, sf).select(F.explode(F.filter(want, lambda x: x.isNotNull())).alias("d")).select("d.*")
    return d.groupBy("branch").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@q(M + "select stream_id, min(seq) as added, max(seq) as removed, count(*) as n from m group by stream_id")
def on_stream(spark, sf):
    return messages(spark, sf).groupBy("stream_id").agg(F.min("seq").alias("added"), F.max("seq").alias("removed"), F.count("*").alias("n"))
