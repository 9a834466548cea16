"""Array kernels and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import table
from ..operators.planes import resize
from .base import q

#: Samples as 16-bit integers.
_PCM = "with e as (select vec_id, list_transform(embedding, lambda x: cast(trunc(x * 32767.0::double) as bigint)) as s from embeddings) "


def resampled(column: str, rate: int, to: int):
    """Samples of a rate at another one; the last is held."""
    s, n = F.col(column), F.size(column).cast("long")

    def sample(k):
        at, f = F.floor(k * rate / to), k * rate % to
        a, b = (F.element_at(s, F.least(n, at + i).cast("int")) for i in (1, 2))
        whole = a * (to - f) + b * f
        return ((whole - whole % to) / to).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n * to / rate) - 1), sample)).otherwise(F.array().cast("array<bigint>"))


def _pcm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * 32767.0).cast("bigint")).alias("s"))


@q(_PCM + ", o as (select vec_id, s, unnest(range((len(s) * 48000 + 44099) // 44100)) as k from e) select vec_id, sum(k * v)::bigint as checksum, count(*) as n from (select vec_id, k, trunc((s[least(len(s), k * 44100 // 48000 + 1)] * (48000 - k * 44100 % 48000) + s[least(len(s), k * 44100 // 48000 + 2)] * (k * 44100 % 48000)) / 48000)::bigint as v from o) group by vec_id")
def resample_linear(spark, sf):
    """44.1 to 48 kHz: output k lies at input k * 44100 / 48000, linear between neighbours in whole numbers."""
    out = F.transform(resampled("s", 44100, 48000), lambda v, k: v * k)
    return _pcm(spark, sf).select("vec_id", F.aggregate(out, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"), F.size(out).cast("long").alias("n"))


@q(_PCM + "select vec_id, list_sum(list_transform(range(1, len(s) // 2 + 1), lambda i: trunc((s[2 * i - 1] + s[2 * i]) / 2)::bigint * i))::bigint as checksum from e")
def channel_remap(spark, sf):
    """Stereo pairs to mono: the mean, truncating."""
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("s") / 2).cast("int")), lambda i: i.cast("long") * ((F.element_at("s", 2 * i - 1) + F.element_at("s", 2 * i)) / 2).cast("long"))
    return _pcm(spark, sf).select("vec_id", F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


#: Vectors as planes of eight by eight bytes.
_PLANE = "with e as (select vec_id, list_transform(embedding, lambda x: (cast(trunc(x * 32767.0::double) as bigint) + 32768) // 256) as s from embeddings where len(embedding) = 64)"
_SIZES = [("smaller", 3, 5), ("larger", 12, 10), ("wide", 16, 6)]


def _planes(spark, sf):
    return _pcm(spark, sf).where(F.size("s") == 64).select("vec_id", F.transform("s", lambda x: F.shiftright(x + 32768, 8).cast("int")).alias("s"))


_SUM = "sum((place + 1) * v)::bigint as checksum"


@q(_PLANE + f""", m(mode, w, h) as (values {", ".join(map(str, _SIZES))}),
a0 as (select distinct n, 8 as src, 8.0::double / n as sc from (select w as n from m union all select h from m)),
a1 as (select n, src, sc, i, j, least(greatest((i + 0.5::double) * sc - 0.5::double, 0), src - 1) as pos from a0, range(16) x(i), range(8) y(j) where i < n),
a2 as (select *, least(floor(pos), src - 2) as first from a1),
a3 as (select n, i, j, case when sc > 1 then round(greatest(0, least((i + 1) * sc, j + 1) - greatest(i * sc, j)) / sc * 16384)
  when j = first then 16384 - round((pos - first) * 16384) when j = first + 1 then round((pos - first) * 16384) else 0 end::bigint as w from a2),
a4 as (select *, sum(w) over (partition by n, i) as total, row_number() over (partition by n, i order by w desc, j) as r from a3),
ax as (select n, i, j, w + case when r = 1 then 16384 - total else 0 end as w from a4),
px as (select vec_id, p % 8 as x, p // 8 as y, s[p + 1] as v from (select vec_id, s, unnest(range(64)) as p from e)),
hz as (select vec_id, mode, m.w as tw, m.h as th, y, ax.i as x, (sum(v * ax.w) + 32) // 64 as t from px, m, ax where ax.n = m.w and ax.j = px.x group by vec_id, mode, m.w, m.h, y, ax.i),
vt as (select vec_id, mode, tw, ax.i * tw + x as place, (sum(t * ax.w) + 2097152) // 4194304 as v from hz join ax on ax.n = hz.th and ax.j = hz.y group by vec_id, mode, tw, ax.i, x)
select vec_id, mode, {_SUM}, count(*) as n from vt group by vec_id, mode""")
def resize_area(spark, sf):
    """Planes shrunk by area, grown by interpolation, and both at once."""
    total = F.aggregate(F.transform("plane", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = None
    for mode, w, h in _SIZES:
        one = resize(_planes(spark, sf), "vec_id", "s", (8, 8), (w, h)).select("vec_id", F.lit(mode).alias("mode"), total.alias("checksum"), F.size("plane").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


#: Places of three layers of eight by eight on a canvas; odd ones are rounded down, what lies outside is clipped.
_AT = [(0, 0), (5, 3), (-4, 7)]


@q(_PLANE + f""", l(layer, x0, y0) as (values {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_AT))}),
f as (select vec_id // 3 as picture, vec_id % 3 as layer, s from e), c as (select picture, max(x0 + 8) as w, max(y0 + 8) as h from f join l using (layer) group by picture),
cells as (select picture, w, unnest(range(w * h)) as place from c),
painted as (select picture, layer, x0 - x0 % 2 + p % 8 as x, y0 - y0 % 2 + p // 8 as y, s[p + 1] as v from (select picture, layer, x0 + case when x0 % 2 < 0 then -2 else 0 end as x0, y0, s, unnest(range(64)) as p from f join l using (layer))),
top as (select cells.picture, place, coalesce(max_by(v, layer), 16) as v from cells left join painted on painted.picture = cells.picture and painted.x = place % w and painted.y = place // w and painted.x >= 0 group by cells.picture, place)
select picture, {_SUM}, count(*) as n from top group by picture""")
def composite_canvas(spark, sf):
    """Layers painted in order on the canvas that holds them all, black where there is none."""
    layers = _planes(spark, sf).groupBy(F.expr("vec_id div 3").alias("picture")).agg(*(F.max(F.when(F.col("vec_id") % 3 == i, F.col("s"))).alias(f"p{i}") for i in range(3)))
    there = [F.col(f"p{i}").isNotNull() for i in range(3)]
    w, h = (F.greatest(*(F.when(t, xy[k] + 8) for t, xy in zip(there, _AT))) for k in (0, 1))
    c = layers.withColumn("w", w).withColumn("h", h)

    def pixel(place):
        x, y, v = place % F.col("w"), F.floor(place / F.col("w")), F.lit(16)
        for i, (x0, y0) in enumerate(_AT):
            dx, dy = x - x0 // 2 * 2, y - y0 // 2 * 2
            inside = F.col(f"p{i}").isNotNull() & dx.between(0, 7) & dy.between(0, 7)
            v = F.when(inside, F.try_element_at(f"p{i}", (dy * 8 + dx + 1).cast("int"))).otherwise(v)
        return v

    canvas = c.select("picture", F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), pixel).alias("v"))
    total = F.aggregate(F.transform("v", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return canvas.select("picture", total.alias("checksum"), F.size("v").cast("long").alias("n"))


@q(_PCM + ", o as (select vec_id, s, unnest(range((len(s) * 48000 + 44099) // 44100)) as k from e), r as (select vec_id, k, trunc((s[least(len(s), k * 44100 // 48000 + 1)] * (48000 - k * 44100 % 48000) + s[least(len(s), k * 44100 // 48000 + 2)] * (k * 44100 % 48000)) / 48000)::bigint as v from o where vec_id % 2 = 1), a as (select vec_id // 2 as pair, unnest(range(len(s))) as k, unnest(s) as v from e where vec_id % 2 = 0) select pair, count(*) as n, sum((a.k + 1) * greatest(-32768, least(32767, a.v + r.v)))::bigint as checksum from a join r on r.vec_id // 2 = pair and r.k = a.k group by pair")
def conform_arms(spark, sf):
    """Every second vector is an arm at 44.1 kHz: it is converted to the first arm's 48 kHz, then mixed as far as the
    shorter goes."""
    e = _pcm(spark, sf)
    pairs = e.groupBy(F.expr("vec_id div 2").alias("pair")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("s"))).alias("s"))
    pairs = pairs.where("a is not null and s is not null").withColumn("b", resampled("s", 44100, 48000))
    both = F.zip_with(F.slice("a", 1, F.size("b")), F.slice("b", 1, F.size("a")), lambda x, y: F.greatest(F.lit(-32768), F.least(F.lit(32767), x + y)))
    total = F.aggregate(F.transform(both, lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.select("pair", F.size(both).cast("long").alias("n"), total.alias("checksum"))


@q(_PCM + "select vec_id, array_to_string(list_transform(s, lambda x: lower(lpad(to_hex((x + 65536) % 256), 2, '0')) || lower(lpad(to_hex((x + 65536) // 256 % 256), 2, '0'))), '') as bytes, s::varchar as samples from e")
def s16_bytes(spark, sf):
    """Samples as little-endian bytes, and read from them again."""
    byte = lambda v: F.lower(F.lpad(F.hex(v.cast("long")), 2, "0"))
    put = F.array_join(F.transform("s", lambda x: F.concat(byte((x + 65536) % 256), byte(F.floor((x + 65536) / 256) % 256))), "")
    e = _pcm(spark, sf).select("vec_id", put.alias("bytes"))
    value = lambda i: F.conv(F.concat(F.substring(F.col("bytes"), i * 4 + 3, F.lit(2)), F.substring(F.col("bytes"), i * 4 + 1, F.lit(2))), 16, 10).cast("long")
    get = F.transform(F.sequence(F.lit(0), F.expr("length(bytes) div 4 - 1").cast("int")), lambda i: F.when(value(i) >= 32768, value(i) - 65536).otherwise(value(i)))
    return e.select("vec_id", "bytes", F.concat(F.lit("["), F.array_join(get, ", "), F.lit("]")).alias("samples"))


@q("select item_id, to_base64(encode(text)) as payload, strlen(text) as n from benchmark")
def encode_payload(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.base64(F.encode("text", "utf-8")).alias("payload"), F.octet_length("text").cast("long").alias("n")).withColumn("payload", F.regexp_replace("payload", r"\s", ""))


@q("select item_id, text from benchmark")
def decode_payload(spark, sf):
    from .base import QUERIES

    return QUERIES["encode_payload"](spark, sf).select("item_id", F.decode(F.unbase64("payload"), "utf-8").alias("text"))


_MTU = "with p as (select doc_id, encode(coalesce(text, '')) as b from documents), f as (select doc_id, b, octet_length(b) as n, greatest(1, (octet_length(b) + 1199) // 1200) as pieces from p), x as (select doc_id, b, pieces, (n + pieces - 1) // pieces as size, n, unnest(range(pieces)) as i from f) "


def _fragments(spark, sf, mtu: int = 1200):
    """Fewest pieces within the MTU, of sizes as even as they can be."""
    d = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b"))
    d = d.withColumn("n", F.octet_length("b")).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / mtu).cast("int")))
    d = d.withColumn("size", F.ceil(F.col("n") / F.col("pieces")).cast("int"))
    return d.select("doc_id", "pieces", F.explode(F.expr("sequence(0, pieces - 1)")).alias("i"), "size", "b").select("doc_id", "pieces", "i", F.expr("substring(b, i * size + 1, size)").alias("data"))


@q(_MTU + "select doc_id, i, greatest(0, least(size, n - i * size)) as n_bytes, i = 0 as start, i = pieces - 1 as marker from x")
def fragment_mtu(spark, sf):
    return _fragments(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), F.octet_length("data").cast("long").alias("n_bytes"), (F.col("i") == 0).alias("start"), (F.col("i") == F.col("pieces") - 1).alias("marker"))


@q("select doc_id, strlen(coalesce(text, '')) as n_bytes, md5(coalesce(text, '')) as md5 from documents")
def reassemble(spark, sf):
    """Units from pieces: those with start and marker and none missing."""
    g = _fragments(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("p"), F.max("pieces").alias("pieces")).where(F.size("p") == F.col("pieces"))
    whole = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x.data)), ""))  # joins in one go, where concat would copy the start for each piece
    return g.select("doc_id", whole.alias("b")).select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.md5("b").alias("md5"))
