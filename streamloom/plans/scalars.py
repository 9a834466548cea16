"""Scalar functions, shapes, settings and lookups, over columns of whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import media, spelling
from ..functions.rational import rescale as rescaled
from ..model import table
from .base import q


def _values(rows) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _list(items) -> str:
    """A list of strings or numbers, in the syntax of both engines' array functions."""
    return ", ".join("null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in items)


def pick(items, index) -> str:
    """SQL of both engines: the item at a place that goes round."""
    whens = " ".join(f"when {i} then {_list([x])}" for i, x in enumerate(items))
    return f"case ({index}) % {len(items)} {whens} end"


@q("select o_orderkey, case when total < 0 then -(-total * 48000 // 90000) else total * 48000 // 90000 end as ticks from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) - 15000000 as total from orders)")
def rescale(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long") - 15000000
    return table(spark, sf, "orders").select("o_orderkey", rescaled(cents, 1, 90000, 1, 48000).alias("ticks"))


#: Around a number: what a setting may look like.
_TEXTS = ["~k", "~M", "~G", "-~k", "+~", "~.5k", "~e3", "~.0005k", "~m", "~g", " ~", "~ k", "", "x~", ".5K", "~E-2M", "1e400", "9e18", "1e19", "~K"]
_TEXT = f"replace({pick(_TEXTS, 'o_orderkey')}, '~', cast(o_orderkey % 1000 as varchar(9)))"


@q(f"""with s as (select o_orderkey, {_TEXT} as s from orders),
p as (select *, case when right(s, 1) in ('k', 'K') then 1000.0::double when right(s, 1) = 'M' then 1000000.0::double when right(s, 1) = 'G' then 1000000000.0::double end as unit from s),
n as (select *, case when unit is null then s else left(s, length(s) - 1) end as body from p),
v as (select *, case when regexp_full_match(body, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(body as double) * coalesce(unit, 1) end as v from n)
select o_orderkey, s, case when v = trunc(v) and abs(v) <= 9.2e18 then v::bigint end as n from v""")
def parse_si(spark, sf):
    s = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_TEXT} as s")
    return s.select("o_orderkey", "s", spelling.quantity(F.col("s")).alias("n"))


_BOOL = ["true", "YES", "1", "on", "false", "No", "0", "OFF", "maybe", "", "oN", " true", None]


@q(f"select o_orderkey, case when lower(s) in ('true', 'yes', '1', 'on') then true when lower(s) in ('false', 'no', '0', 'off') then false end as b from (select o_orderkey, {pick(_BOOL, 'o_orderkey')} as s from orders)")
def parse_bool(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{pick(_BOOL, 'o_orderkey')} as s").select("o_orderkey", spelling.boolean(F.col("s")).alias("b"))


_SIZE = ["~x180", "0x~", "~X7", "x~", "~x", "1920x~", "~x~", "-~x2"]
_SIZE_TEXT = f"replace({pick(_SIZE, 'o_orderkey')}, '~', cast(o_orderkey % 2000 as varchar(9)))"


@q(f"select o_orderkey, case when ok then w end as w, case when ok then h end as h from (select *, w > 0 and h > 0 as ok from (select o_orderkey, try_cast(regexp_extract(lower(s), '^([0-9]+)x([0-9]+)$', 1) as int) as w, try_cast(regexp_extract(lower(s), '^([0-9]+)x([0-9]+)$', 2) as int) as h from (select o_orderkey, {_SIZE_TEXT} as s from orders)))")
def parse_size(spark, sf):
    w, h = spelling.size(F.col("s"))
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SIZE_TEXT} as s").select("o_orderkey", w.alias("w"), h.alias("h"))


_RATE = ["~", "~/1001", "29.~", "60/~", "0", "x~", "~/0", "~000/1001"]
_RATE_TEXT = f"replace({pick(_RATE, 'o_orderkey')}, '~', cast(o_orderkey % 97 as varchar(9)))"


@q(f"select o_orderkey, n // gcd(n, d) as num, d // gcd(n, d) as den from (select o_orderkey, case when d > 0 then n end as n, case when n > 0 then nullif(d, 0) end as d from (select o_orderkey, case when regexp_matches(s, '^[0-9]+/[0-9]+$') then nullif(split_part(s, '/', 1)::bigint, 0) when regexp_matches(s, '^[0-9]+([.][0-9]+)?$') then nullif(round(s::decimal(20, 9) * 1000)::bigint, 0) end as n, case when regexp_matches(s, '^[0-9]+/[0-9]+$') then split_part(s, '/', 2)::bigint when regexp_matches(s, '^[0-9]+([.][0-9]+)?$') then 1000 end as d from (select o_orderkey, {_RATE_TEXT} as s from orders)))")
def parse_rate(spark, sf):
    n, d = spelling.rate(F.col("s"))
    r = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_RATE_TEXT} as s").select("o_orderkey", n.alias("n"), d.cast("long").alias("d"))
    g = media.divisor(F.col("n"), F.col("d"))
    return r.withColumn("g", g).select("o_orderkey", F.expr("div(n, g)").alias("num"), F.expr("div(d, g)").alias("den"))


_CHOICES = ["resize", "resample", "select", "mix", "composite"]
_WORDS = ["resise", "MIXX", "selct", "banana", "resample", "mx", "Composit", "rezample", "", "xim"]
_WORD = f"concat({pick(_WORDS, 'p_partkey')}, case when p_partkey % 3 = 0 then 'q' else '' end)"


@q(f"select p_partkey, min_by(c, i * 1.0 + 100 * levenshtein(lower(w), c)) as suggestion from (select p_partkey, {_WORD} as w from part), {_values(list(enumerate(_CHOICES)))} b(i, c) where levenshtein(lower(w), c) <= 2 group by p_partkey")
def did_you_mean(spark, sf):
    found = F.array_min(F.filter(F.array(*(F.struct(F.levenshtein(F.lower("w"), F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(_CHOICES))), lambda x: x.d <= 2))
    return table(spark, sf, "part").selectExpr("p_partkey", f"{_WORD} as w").select("p_partkey", found["c"].alias("suggestion")).where("suggestion is not null")


# Codecs by media type.
_MIME = [("audio/opus", "opus"), ("video/vp8", "vp8"), ("video/vp9", "vp9"), ("video/av1", "av1"), ("video/h264", "h264"), ("text/html", "none")]


@q(f"select page_id, codec from (select page_id, case page_id % 7 when 0 then 'audio/OPUS' when 1 then 'video/VP8' when 2 then 'video/H264' when 3 then 'video/AV1' when 4 then 'text/html' else 'x/y' end as mime from pages) p left join {_values(_MIME)} t(mime, codec) on lower(p.mime) = t.mime")
def mime_lookup(spark, sf):
    mime = F.expr("case page_id % 7 when 0 then 'audio/OPUS' when 1 then 'video/VP8' when 2 then 'video/H264' when 3 then 'video/AV1' when 4 then 'text/html' else 'x/y' end")
    known = F.create_map(*(F.lit(x) for pair in _MIME for x in pair))
    return table(spark, sf, "pages").select("page_id", F.try_element_at(known, F.lower(mime)).alias("codec"))


_DIRS = ["", "es", "es/", "en/hd", "de/sd/low", "fr"]
_TARGET = "concat(" + pick(["es", "en", "en/hd", "de/sd"], "page_id") + ", '/', cast(page_id as varchar(20)), '.m3u8')"


@q(f"""with p as (select page_id, {pick(_DIRS, 'page_id')} as dir, {_TARGET} as target from pages),
s as (select page_id, case when dir = '' then [] else string_split(rtrim(dir, '/'), '/') end as a, string_split(target, '/') as b from p),
c as (select *, coalesce(list_filter(range(1, least(len(a), len(b) - 1) + 1), lambda i: a[i] <> b[i])[1] - 1, least(len(a), len(b) - 1)) as same from s)
select page_id, repeat('../', (len(a) - same)::int) || array_to_string(b[same + 1:], '/') as relative from c""")
def relative_uri(spark, sf):
    """A name of a store as a playlist in a directory of it names it."""
    p = table(spark, sf, "pages").selectExpr("page_id", f"{pick(_DIRS, 'page_id')} as dir", f"{_TARGET} as target")
    return p.select("page_id", media.relative("dir", "target").alias("relative"))


@q("select page_id, regexp_replace(regexp_replace(u, '//[^/@]*@', '//'), '[?#].*$', '') as name, regexp_replace(regexp_replace(u, '//[^/@]*@', '//'), '([?&](?:token|key|ref)=)[^&#]*', '\\1***', 'g') as full_form from (select page_id, replace(url, '://', '://me:pw@') as u from pages)")
def redact_uri(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.replace("url", F.lit("://"), F.lit("://me:pw@")), "//[^/@]*@", "//").alias("u"))
    return p.select("page_id", F.regexp_replace("u", "[?#].*$", "").alias("name"), F.regexp_replace("u", "([?&](?:token|key|ref)=)[^&#]*", "$1***").alias("full_form"))


_NUMBER = "cast(l_orderkey % 300 as bigint) * case l_linenumber % 5 when 0 then 1 when 1 then 997 when 2 then 65536 when 3 then 16777259 else 1099511627776 end - case when l_orderkey % 300 = 128 then 1 else 0 end"


@q(f"""with v as (select l_orderkey, l_linenumber, {_NUMBER} as v from lineitem),
w as (select *, list_filter(range(1, 9), lambda k: v <= (1::bigint << (7 * k)) - 2)[1] as width from v)
select l_orderkey, l_linenumber, width, lpad(lower(to_hex(v + (1::bigint << (7 * width)))), (2 * width)::int, '0') as encoded, v as decoded, lpad(lower(to_hex((1::bigint << (7 * width + 1)) - 1)), (2 * width)::int, '0') as unknown from w where width <= 7""")
def vint_width(spark, sf):
    """Variable-length sizes: the fewest bytes whose value isn't all ones, written, read again, and the unknown size of
    that width."""
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_NUMBER} as v")
    v = v.withColumn("width", media.vint_width(F.col("v"))).withColumn("encoded", media.vint(F.col("v"), F.col("width")))
    read = media.vint_value(F.col("encoded"))
    return v.select("l_orderkey", "l_linenumber", F.col("width").cast("long").alias("width"), "encoded", read["value"].alias("decoded"), media.vint_unknown(F.col("width")).alias("unknown"))


_BOX = "l_partkey % 1920 as w, l_suppkey * 13 % 1080 as h, l_linenumber * 90 as tw, l_orderkey % 9 * 60 as th"


@q(f"""with b as (select l_orderkey, l_linenumber, {_BOX} from lineitem),
r as (select *, w > 0 and h > 0 and tw > 0 and th > 0 as ok, tw * h <= th * w as wide, w * th > h * tw as cut from b),
f as (select *, case when wide then tw else (w * th + h // 2) // nullif(h, 0) end as fw, case when wide then (h * tw + w // 2) // nullif(w, 0) else th end as fh, case when cut then h * tw // nullif(th, 0) else w * th // nullif(tw, 0) end as side from r),
e as (select *, case when side < 2 then 0 else side - side % 2 end as even from f)
select l_orderkey, l_linenumber, case when ok then case when fw < 2 then 0 else fw - fw % 2 end else 0 end as fit_w, case when ok then case when fh < 2 then 0 else fh - fh % 2 end else 0 end as fit_h,
  case when ok then case when cut then even else w end end as crop_w, case when ok then case when cut then h else even end end as crop_h,
  case when ok then case when not cut then 0 when (w - even) // 2 < 2 then 0 else (w - even) // 2 - (w - even) // 2 % 2 end end as crop_x,
  case when ok then case when cut then 0 when (h - even) // 2 < 2 then 0 else (h - even) // 2 - (h - even) // 2 % 2 end end as crop_y from e""")
def fit_dimensions(spark, sf):
    """Inside a box with the aspect kept, and the part of a picture that fills the box; all even."""
    b = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_BOX.split(", "))
    fit, fill = media.fit("w", "h", "tw", "th"), media.fill("w", "h", "tw", "th")
    return b.select("l_orderkey", "l_linenumber", fit[0].alias("fit_w"), fit[1].alias("fit_h"), *(c.alias(f"crop_{n}") for c, n in zip(fill, ("w", "h", "x", "y"))))


_HAS = f"{pick(['audio', 'video', 'audio', None], 'l_orderkey')} as kind, {pick([48000, 44100, None, 16000], 'l_partkey')} as rate, {pick([2, 1, None], 'l_suppkey')} as ch, {pick(['s16', 'f32', None], 'l_linenumber')} as fmt, {pick([640, 320, None], 'l_partkey')} as w"
_WANTS = f"{pick([None, 'audio', 'video'], 'l_linenumber')} as ekind, {pick([None, 48000], 'l_suppkey')} as erate, {pick([None, 2, None, 1], 'l_orderkey')} as ech, {pick([None, 's16'], 'l_partkey')} as efmt, {pick([None, None, 640], 'l_orderkey')} as ew"
_FACTS = ["kind", "rate", "ch", "fmt", "w"]


def _shapes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *media.columns_of(_HAS), *media.columns_of(_WANTS))


_S = f"with s as (select l_orderkey, l_linenumber, {_HAS}, {_WANTS} from lineitem) "


@q(_S + "select l_orderkey, l_linenumber, " + " and ".join(f"(e{f} is null or coalesce({f} = e{f}, false))" for f in _FACTS) + " as accepted from s")
def shape_compatible(spark, sf):
    """Facts that are expected must be there and equal; the others don't matter."""
    ok = F.lit(True)
    for f in _FACTS:
        ok = ok & (F.col(f"e{f}").isNull() | F.coalesce(F.col(f) == F.col(f"e{f}"), F.lit(False)))
    return _shapes(spark, sf).select("l_orderkey", "l_linenumber", ok.alias("accepted"))


@q(_S + "select l_orderkey, l_linenumber, " + ", ".join(f"coalesce(e{f}, {f}) as {f}" for f in _FACTS) + " from s")
def shape_merge(spark, sf):
    return _shapes(spark, sf).select("l_orderkey", "l_linenumber", *(F.coalesce(f"e{f}", f).alias(f) for f in _FACTS))


@q(_S + "select l_orderkey, l_linenumber, (erate is not null and erate is distinct from rate) or (ech is not null and ech is distinct from ch) as resample, ew is not null and ew is distinct from w as resize, efmt is not null and efmt is distinct from fmt as convert from s")
def conversion_classes(spark, sf):
    """What it takes to meet the expected facts; a fact that isn't known meets none."""
    off = lambda f: F.col(f"e{f}").isNotNull() & ~F.col(f"e{f}").eqNullSafe(F.col(f))
    return _shapes(spark, sf).select("l_orderkey", "l_linenumber", (off("rate") | off("ch")).alias("resample"), off("w").alias("resize"), off("fmt").alias("convert"))


@q("select l_orderkey, l_linenumber, a | n as both, (n & ~a) = 0 as covers, n & ~a as missing from (select l_orderkey, l_linenumber, l_partkey % 16 as a, l_suppkey % 8 as n from lineitem)")
def policy_set_ops(spark, sf):
    a, n = F.col("l_partkey") % 16, F.col("l_suppkey") % 8
    missing = n.bitwiseAND(F.bitwise_not(a))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.bitwiseOR(n).alias("both"), (missing == 0).alias("covers"), missing.alias("missing"))


@q("select l_orderkey, string_agg(f, ',' order by pos, f) as flags from (select l_orderkey, l_returnflag as f, min(l_linenumber) as pos from lineitem group by l_orderkey, l_returnflag) group by l_orderkey")
def list_merge(spark, sf):
    """Ordered distinct union of an order's lists."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("at"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "l_returnflag"))).alias("x")).select("l_orderkey", F.array_join(F.transform("x", lambda s: s.l_returnflag), ",").alias("flags"))


@q("select o_orderkey, o_orderpriority as title, case when o_orderkey % 2 = 0 then 'even' else o_orderstatus end as status from orders")
def metadata_map(spark, sf):
    """Maps overlaid, the later winning."""
    base = F.create_map(F.lit("title"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    over = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("even"))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf, "orders").select("o_orderkey", both["title"].alias("title"), both["status"].alias("status"))


@q("""with n as (select l_orderkey, '{"name":"n' || l_linenumber || '","kind":"' || case when l_linenumber = 1 then 'source' else 'stage' end || '","detail":"' || l_shipmode || '"}' as node, l_linenumber as i, l_shipmode from (select l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) as l_shipmode from lineitem group by l_orderkey, l_linenumber)),
g as (select l_orderkey, string_agg(node, ',' order by i) as nodes, string_agg(case when i > 1 then '{"from":"n' || (i - 1) || '","to":"n' || i || '","policy":"' || l_shipmode || '"}' end, ',' order by i) as edges, count(*) as n_nodes from n group by l_orderkey)
select l_orderkey, '{"name":"g' || l_orderkey || '","realtime":' || case when l_orderkey % 2 = 0 then 'true' else 'false' end || ',"nodes":[' || nodes || '],"edges":[' || coalesce(edges, '') || ']}' as spec, n_nodes from g""")
def spec_json(spark, sf):
    """A graph's spec written and read again: name, realtime, nodes (name, kind, detail), edges (from, to, policy)."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("mode"))
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "mode"))).alias("x"))
    nodes = F.transform("x", lambda r: F.struct(name(r.i).alias("name"), F.when(r.i == 1, "source").otherwise("stage").alias("kind"), r["mode"].alias("detail")))
    edges = F.transform(F.filter("x", lambda r: r.i > 1), lambda r: F.struct(name(r.i - 1).alias("from"), name(r.i).alias("to"), r["mode"].alias("policy")))
    spec = F.to_json(F.struct(F.concat(F.lit("g"), F.col("l_orderkey").cast("string")).alias("name"), (F.col("l_orderkey") % 2 == 0).alias("realtime"), nodes.alias("nodes"), edges.alias("edges")))
    read = F.from_json("spec", "name string, realtime boolean, nodes array<struct<name:string,kind:string,detail:string>>, edges array<struct<`from`:string,to:string,policy:string>>")
    return rows.select("l_orderkey", spec.alias("spec")).select("l_orderkey", F.to_json(read).alias("spec"), F.size(read["nodes"]).cast("long").alias("n_nodes"))


#: Settings: type, bounds (both 0: none), choices.
_KNOBS = [("bitrate", "int", 1000, 1000000), ("gop", "int", 0, 0), ("lossy", "bool", 0, 0), ("crf", "float", 0, 63), ("speed", "enum", 0, 0), ("title", "string", 0, 0)]
_SETTINGS = ["96k", "2M", "Yes", "off", "FAST", "warp", "1.5", "-3k", "70", "a b", "1e2", "62.75", "nan"]
_KNOB = f"{pick([k[0] for k in _KNOBS], 'o_orderkey')} as name, {pick(_SETTINGS, 'o_custkey')} as value"


@q(f"""with s as (select o_orderkey, {_KNOB} from orders),
b as (select s.*, kind, low, high, case when right(value, 1) in ('k', 'K') then 1000.0::double when right(value, 1) = 'M' then 1000000.0::double else 1.0::double end as unit from s join {_values(_KNOBS)} k(name, kind, low, high) using (name)),
n as (select *, case when regexp_full_match(rtrim(value, 'kKM'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then rtrim(value, 'kKM')::double * unit end as v from b)
select o_orderkey, name, value, case kind
  when 'int' then case when v = trunc(v) and ((low = 0 and high = 0) or v between low and high) then (v::bigint)::varchar end
  when 'float' then case when unit = 1 and ((low = 0 and high = 0) or v between low and high) then regexp_replace(v::varchar, '[.]0$', '') end
  when 'bool' then case when lower(value) in ('true', 'yes', '1', 'on') then 'true' when lower(value) in ('false', 'no', '0', 'off') then 'false' end
  when 'enum' then case lower(value) when 'slow' then 'Slow' when 'fast' then 'Fast' end
  else value end as parsed from n""")
def knob_parse(spark, sf):
    """Values of settings in canonical form; null where the type or the bounds refuse them."""
    s = table(spark, sf, "orders").selectExpr("o_orderkey", *media.columns_of(_KNOB))
    parsed = F.lit(None).cast("string")
    for name, kind, low, high in _KNOBS:
        parsed = F.when(F.col("name") == name, spelling.setting(F.col("value"), kind, low, high, ["Slow", "Fast"])).otherwise(parsed)
    return s.select("o_orderkey", "name", "value", parsed.alias("parsed"))


_KEYS = ["bitrate", "gop", "speed", "x264.tune", "vpx.tune", "x264-params", "vpx-params"]
_SET = f"l_orderkey, case when l_orderkey % 2 = 0 then 'X264' else 'vpx' end as backend, l_linenumber, {pick(_KEYS, 'l_linenumber + l_partkey')} as key, cast(l_partkey % 7 as varchar(9)) as value"


@q(f"""with s as (select {_SET} from lineitem), k as (select *, case when suffix(key, '-params') then left(key, length(key) - 7) when contains(key, '.') then split_part(key, '.', 1) end as scope from s),
d as (select distinct l_orderkey from s),
n as (select l_orderkey, 0 as stage, '' as at, 'bitrate' as name, '64000' as value, 0 as line from d union all select l_orderkey, 0, '', 'speed', 'Fast', 0 from d
  union all select l_orderkey, case when key in ('bitrate', 'gop') then 1 else 2 end, key, case when scope is null then key when suffix(key, '-params') then 'raw' else split_part(key, '.', 2) end, value, l_linenumber
  from k where (scope is null or lower(scope) = lower(backend)) and not (key in ('bitrate', 'gop') and value = '0'))
select l_orderkey, name, (max({{'s': stage, 'l': line, 'v': value}})).v as value from n group by l_orderkey, name""")
def knob_resolve(spark, sf):
    """Defaults, then typed settings (0 isn't one), then named ones, the later winning; those scoped to another backend
    are skipped, and raw parameters are kept apart."""
    s = table(spark, sf, "lineitem").selectExpr(*media.columns_of(_SET))
    raw, dotted = F.col("key").endswith("-params"), F.col("key").contains(".")
    scope = F.when(raw, F.regexp_replace("key", "-params$", "")).when(dotted, F.substring_index("key", ".", 1))
    typed = F.col("key").isin("bitrate", "gop")
    own = s.withColumn("scope", scope).where((F.col("scope").isNull() | (F.lower("scope") == F.lower("backend"))) & ~(typed & (F.col("value") == "0")))
    name = F.when(raw, "raw").when(dotted, F.substring_index("key", ".", -1)).otherwise(F.col("key"))
    own = own.select("l_orderkey", name.alias("name"), F.when(typed, 1).otherwise(2).alias("stage"), F.col("l_linenumber").alias("line"), "value")
    defaults = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(0).alias("stage"), F.lit(0).alias("line"), F.lit(v).alias("value")) for n, v in (("bitrate", "64000"), ("speed", "Fast"))))
    given = s.select("l_orderkey").distinct().select("l_orderkey", F.explode(defaults).alias("d")).select("l_orderkey", "d.*")
    return own.unionByName(given).groupBy("l_orderkey", "name").agg(F.max(F.struct("stage", "line", "value"))["value"].alias("value"))


# Families of error codes.
FAMILIES = {
    "input": "input_invalid input_duplicate input_unknown input_format_unknown input_demuxer_missing input_scheme_unsupported source_callback_missing source_shape_invalid source_shape_unsupported source_shape_mismatch explicit_graph_source_missing",
    "stream": "stream_missing stream_ambiguous stream_selector_invalid stream_codec_missing stream_step_after_encode stream_invalid stage_missing",
    "transform": "transform_invalid transform_media_mismatch transform_adapter_missing transform_adapter_incompatible transcode_resize_invalid operation_shape_mismatch",
    "shape": "shape_requirement_unmet shape_conversion_refused shape_adapter_missing shape_adapter_ambiguous",
    "codec": "decode_adapter_missing decode_adapter_unavailable decode_adapter_incompatible encode_adapter_missing encode_adapter_unavailable encode_adapter_incompatible",
    "encode": "encode_missing encode_duplicate encode_parameter_invalid encode_auto_unresolved encode_stream_mismatch encode_destination_missing",
    "destination": "output_invalid output_duplicate output_kind_mixed output_writer_missing output_format_missing output_format_unknown output_muxer_missing output_destination_missing output_scheme_unsupported destination_invalid destination_duplicate destination_format_unknown destination_muxer_missing destination_mux_incompatible destination_shape_mismatch",
    "branch": "branch_decode_duplicate branch_isolation_unsafe branch_decode_domain_mismatch branch_transform_media_mismatch branch_operation_chain_unsupported decode_config_conflict",
    "buffer": "branch_buffer_invalid branch_buffer_unsupported",
    "tap": "tap_invalid tap_domain_mismatch",
    "join": "join_name_invalid join_stage_invalid",
    "runtime_branch": "runtime_branch_invalid runtime_branch_anchor_missing runtime_branch_tap_missing runtime_branch_tap_duplicate runtime_branch_node_duplicate runtime_branch_encode_missing runtime_branch_encode_domain_mismatch runtime_branch_decode_domain_mismatch runtime_branch_decode_codec_missing runtime_branch_copy_domain_mismatch runtime_branch_mux_codec_missing runtime_branch_transform_error runtime_branch_graph_error",
    "stream_rule": "stream_rule_invalid",
    "compiler": "runtime_missing compiler_pass_failed recipe_graph_unsupported graph_plan_invalid",
    "diagnostic": "shape_conversion_inserted shape_preference_applied shape_preference_ignored decode_codec_deferred explain_preflight_error packet_copy frame_source event_source decode_required encode_required stream_rule",
}
_CODES = [(code, family) for family, codes in FAMILIES.items() for code in codes.split()]
_CODE = pick([c for c, _ in _CODES] + ["mix_inputs", "overlay_arm", "vendor_thing", "", None], "event_id")


@q(f"select event_id, case when c.code is null then null when f.family is not null then f.family when suffix(c.code, '_inputs') or suffix(c.code, '_arm') then 'join' else 'external' end as family from (select event_id, {_CODE} as code from events) c left join {_values(_CODES)} f(code, family) using (code)")
def error_family(spark, sf):
    """Codes of joins of one's own end in what they are about; any other code is a vendor's."""
    known = F.create_map(*(F.lit(x) for p in _CODES for x in p))
    code = F.col("code")
    family = F.coalesce(F.try_element_at(known, code), F.when(code.endswith("_inputs") | code.endswith("_arm"), "join").otherwise("external"))
    return table(spark, sf, "events").selectExpr("event_id", f"{_CODE} as code").select("event_id", F.when(code.isNotNull(), family).alias("family"))


#: Backends: name, codec, kind, place of registration, realtime, largest width (0: any).
_BACK = [("soft", "vp9", "lib", 1, False, 0), ("nv", "vp9", "hardware", 2, False, 1920), ("pure", "vp9", "go", 3, True, 0), ("soft264", "h264", "lib", 4, False, 4096), ("plain264", "h264", "", 5, False, 640), ("own264", "h264", "lib", 6, True, 4096), ("opus1", "opus", "go", 7, True, 0)]
_NEED = f"c_custkey, {pick(['vp9', 'h264', 'opus', 'av1'], 'c_custkey')} as codec, c_custkey % 3 = 0 as realtime, {pick([None, None, 'NV', 'soft264', None, 'gone', None], 'c_custkey')} as named, {pick(['', 'go', 'own264>lib', 'hardware'], 'c_nationkey')} as prefer, (c_custkey * 37) % 4000 as width"


@q(f"""with n as (select {_NEED} from customer), b as (select * from {_values(_BACK)} b(backend, codec, kind, reg, rt, most)),
j as (select n.*, b.backend, b.kind, b.reg, b.rt, b.backend is not null as there, b.backend is not null and (most = 0 or width <= most) as fits, coalesce(lower(b.backend) = lower(named), false) as own,
  list_position(list_transform(string_split(prefer, '>'), lambda p: p <> '' and (lower(p) = lower(b.backend) or lower(p) = b.kind)), true) as place from n left join b using (codec)),
r as (select *, row_number() over (partition by c_custkey order by fits desc, coalesce(place, 99), case kind when '' then 0 when 'hardware' then 1 when 'lib' then 2 when 'go' then 4 else 3 end, case when realtime and rt then 0 else 1 end, reg desc) as rk from j)
select c_custkey, case when any_value(named) is not null then max(case when own and fits then backend end) else max(case when rk = 1 and fits then backend end) end as backend,
  case when any_value(named) is not null then case when not bool_or(own and there) then 'not found' when not bool_or(own and fits) then 'unsupported' else 'chosen' end when not bool_or(there) then 'not found' when not bool_or(fits) then 'unsupported' else 'chosen' end as verdict,
  count(case when there and not fits then 1 end) as rejected from r group by c_custkey""")
def backend_select(spark, sf):
    """Misfits rejected; a named backend or none; else by preference, kind, realtime if asked for, latest registration."""
    need = table(spark, sf, "customer").selectExpr(*media.columns_of(_NEED))
    back = spark.createDataFrame(_BACK, "backend string, codec string, kind string, reg int, rt boolean, most int")
    j = need.join(F.broadcast(back), "codec", "left")  # as many rows as there are backends
    there = F.col("backend").isNotNull()
    j = j.withColumn("fits", there & ((F.col("most") == 0) | (F.col("width") <= F.col("most")))).withColumn("own", F.coalesce(F.lower("backend") == F.lower("named"), F.lit(False)))
    entries = F.split("prefer", ">")
    place = F.array_position(F.transform(entries, lambda p: (p != "") & ((F.lower(p) == F.lower("backend")) | (F.lower(p) == F.col("kind")))), True)
    kind = F.when(F.col("kind") == "", 0).when(F.col("kind") == "hardware", 1).when(F.col("kind") == "lib", 2).when(F.col("kind") == "go", 4).otherwise(3)
    rank = F.struct(F.when(place > 0, place).otherwise(99).alias("place"), kind.alias("k"), F.when(F.col("realtime") & F.col("rt"), 0).otherwise(1).alias("r"), (-F.col("reg")).alias("reg"), F.col("backend").alias("backend"))
    g = j.groupBy("c_custkey").agg(
        F.first("named").alias("named"), F.min(F.when(F.col("fits"), rank))["backend"].alias("best"), F.max(F.when(F.col("own") & F.col("fits"), F.col("backend"))).alias("asked"),
        F.bool_or(there).alias("some"), F.bool_or(F.col("fits")).alias("fit"), F.bool_or(F.col("own")).alias("found"), F.bool_or(F.col("own") & F.col("fits")).alias("own_fits"), F.count_if(there & ~F.col("fits")).alias("rejected"),
    )
    named = F.col("named").isNotNull()
    exists, fits = F.when(named, F.col("found")).otherwise(F.col("some")), F.when(named, F.col("own_fits")).otherwise(F.col("fit"))
    verdict = F.when(~exists, "not found").when(~fits, "unsupported").otherwise("chosen")
    return g.select("c_custkey", F.when(named, F.col("asked")).otherwise(F.col("best")).alias("backend"), verdict.alias("verdict"), "rejected")


#: Formats: name, least and most streams (0: any), media, codecs (empty: any).
_FORMATS = [("webm", 1, 0, "video,audio", "vp8,vp9,av1,opus"), ("mp4", 1, 4, "video,audio", "h264,aac,av1,opus"), ("ivf", 1, 1, "video", "vp8,vp9,av1"), ("annexb", 1, 1, "video", "h264")]
_STREAM = f"l_orderkey, {pick(['webm', 'mp4', 'ivf', 'annexb', 'raw'], 'l_orderkey')} as format, l_linenumber, {pick(['video', 'audio', 'video', 'video', None, 'data'], 'l_partkey')} as media, {pick(['vp9', 'h264', 'opus', 'av1', None, 'vp8'], 'l_suppkey + l_linenumber')} as codec, {pick([0, 0, 1, 1, 1], 'l_partkey')} as num, {pick([0, 0, 90000, 48000, 1000, 0, 25], 'l_suppkey')} as den"


@q(f"""with s as (select {_STREAM} from lineitem), f as (select * from {_values(_FORMATS)} f(format, least, most, kinds, codecs)),
j as (select s.*, least, most, (num <> 0 or den <> 0) and (num <= 0 or den <= 0) as bad_base,
  kinds is not null and ((media is not null and not list_contains(string_split(kinds, ','), media)) or (codec is not null and not list_contains(string_split(codecs, ','), codec))) as bad from s left join f using (format))
select l_orderkey, any_value(format) as format, case when bool_or(bad_base) then 'time base' when count(*) < any_value(least) or (any_value(most) > 0 and count(*) > any_value(most)) then 'stream count' when bool_or(bad) then 'media or codec' end as issue from j group by l_orderkey""")
def mux_compat(spark, sf):
    """The first objection to the streams of a destination: a time base, their number, media and codecs; facts that aren't
    known pass, and so does a format that isn't."""
    s = table(spark, sf, "lineitem").selectExpr(*media.columns_of(_STREAM))
    f = spark.createDataFrame(_FORMATS, "format string, least int, most int, kinds string, codecs string")
    j = s.join(F.broadcast(f), "format", "left")  # as many rows as there are formats
    base = ((F.col("num") != 0) | (F.col("den") != 0)) & ((F.col("num") <= 0) | (F.col("den") <= 0))
    off = lambda value, allowed: F.coalesce(F.col(value).isNotNull() & ~F.array_contains(F.split(allowed, ","), F.col(value)), F.lit(False))
    g = j.groupBy("l_orderkey").agg(F.first("format").alias("format"), F.bool_or(base).alias("base"), F.count("*").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), F.bool_or(off("media", "kinds") | off("codec", "codecs")).alias("off"))
    count = (F.col("n") < F.col("least")) | ((F.col("most") > 0) & (F.col("n") > F.col("most")))
    return g.select("l_orderkey", "format", F.when(F.col("base"), "time base").when(count, "stream count").when(F.col("off"), "media or codec").alias("issue"))


@q(f"with s as (select {_STREAM} from lineitem) select l_orderkey, greatest(65536, max(case when media = 'video' then 4194304 when media = 'audio' then 4096 else 0 end)) as bytes from s group by l_orderkey")
def buffer_size(spark, sf):
    """Bytes that hold any packet of a source's streams: 64 KiB, 4 MiB with video."""
    s = table(spark, sf, "lineitem").selectExpr(*media.columns_of(_STREAM))
    return s.groupBy("l_orderkey").agg(F.greatest(F.lit(65536), F.max(F.when(F.col("media") == "video", 4194304).when(F.col("media") == "audio", 4096).otherwise(0))).alias("bytes"))


_ENTRY = f"p_partkey, {pick(['avc1', 'avc3', 'av01', 'vp09', 'vp08', 'mp4a', 'Opus', 'fLaC', 'xxxx'], 'p_partkey')} as fourcc, p_partkey * 2654435761 % 4294967296 as bits, {pick([2, 5, 29, None], 'p_partkey')} as object_type"


@q(f"""with e as (select {_ENTRY} from part), b as (select *, bits // 16777216 as b0, bits // 65536 % 256 as b1, bits // 256 % 256 as b2, bits % 256 as b3 from e)
select p_partkey, case when fourcc in ('avc1', 'avc3') then fourcc || '.' || lpad(lower(to_hex(b1)), 2, '0') || lpad(lower(to_hex(b2)), 2, '0') || lpad(lower(to_hex(b3)), 2, '0')
  when fourcc = 'av01' then 'av01.' || (b1 // 32) || '.' || lpad((b1 % 32)::varchar, 2, '0') || case when b2 >= 128 then 'H' else 'M' end || '.' || case when b2 // 64 % 2 = 0 then '08' when b2 // 32 % 2 = 1 then '12' else '10' end
  when fourcc in ('vp08', 'vp09') then fourcc || '.' || case when b0 < 10 then '0' else '' end || b0 || '.' || case when b1 < 10 then '0' else '' end || b1 || '.' || lpad((b2 // 16)::varchar, 2, '0')
  when fourcc = 'mp4a' then 'mp4a.40.' || coalesce(object_type, 2) when fourcc in ('Opus', 'fLaC') then fourcc else '' end as codecs from b""")
def codec_string(spark, sf):
    """RFC 6381 names of sample entries from bytes of their configuration."""
    e = table(spark, sf, "part").selectExpr(*media.columns_of(_ENTRY))
    byte = lambda i: F.shiftright("bits", 8 * (3 - i)).bitwiseAND(255).cast("int")
    b = e.select("p_partkey", "fourcc", "object_type", *(byte(i).alias(f"b{i}") for i in range(4)))
    depth = F.when(F.col("b2").bitwiseAND(64) == 0, 8).when(F.col("b2").bitwiseAND(32) == 32, 12).otherwise(10)
    name = F.when(F.col("fourcc").isin("avc1", "avc3"), F.format_string("%s.%02x%02x%02x", "fourcc", "b1", "b2", "b3"))
    name = name.when(F.col("fourcc") == "av01", F.format_string("av01.%d.%02d%s.%02d", F.shiftright("b1", 5), F.col("b1").bitwiseAND(31), F.when(F.col("b2").bitwiseAND(128) != 0, "H").otherwise("M"), depth))
    name = name.when(F.col("fourcc").isin("vp08", "vp09"), F.format_string("%s.%02d.%02d.%02d", "fourcc", "b0", "b1", F.shiftright("b2", 4)))
    name = name.when(F.col("fourcc") == "mp4a", F.format_string("mp4a.40.%d", F.coalesce("object_type", F.lit(2)))).when(F.col("fourcc").isin("Opus", "fLaC"), F.col("fourcc"))
    return b.select("p_partkey", name.otherwise("").alias("codecs"))


@q("""with n as (select l_orderkey, l_linenumber as i, min(l_returnflag || l_linestatus) as d, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as p from lineitem group by l_orderkey, l_linenumber)
select l_orderkey, 'digraph {' || chr(10) || string_agg('  n' || i || ' [label="n' || i || chr(92) || 'n' || d || '"];' || chr(10), '' order by i) || coalesce(string_agg('  n' || p || ' -> n' || i || ';' || chr(10), '' order by i) filter (p is not null), '') || '}' as dot,
  'flowchart LR' || coalesce(string_agg(chr(10) || '  n' || p || ' --> n' || i, '' order by i) filter (p is not null), '') as mermaid from n group by l_orderkey""")
def graph_render(spark, sf):
    """Graphs as DOT and as a Mermaid flowchart."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("d"))
    p = F.lag("i").over(Window.partitionBy("l_orderkey").orderBy("i"))
    g = li.withColumn("p", p).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "d", "p"))).alias("x"))
    text = lambda s, f, t: F.array_join(F.transform(s, lambda r: F.format_string(f, *t(r))), "")
    edges = F.filter("x", lambda r: r.p.isNotNull())
    dot = F.concat(F.lit("digraph {\n"), text("x", '  n%d [label="n%d\\n%s"];%s', lambda r: (r.i, r.i, r.d, F.lit("\n"))), text(edges, "  n%d -> n%d;%s", lambda r: (r.p, r.i, F.lit("\n"))), F.lit("}"))
    return g.select("l_orderkey", dot.alias("dot"), F.concat(F.lit("flowchart LR"), text(edges, "%s  n%d --> n%d", lambda r: (F.lit("\n"), r.p, r.i))).alias("mermaid"))
