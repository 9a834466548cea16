"""Sources, sinks and stages of one's own over whole tables: what goes in comes out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..model import messages, table
from ..operators import rtp, stages
from ..operators.windows import by
from ..sources import containers, destination, push, store
from .base import M, q

REGISTRY = stages.Registry()
REGISTRY.add("stage", "cheap", lambda df, most=5000: df.where(F.col("cents") <= most))
REGISTRY.add("stage", "doubled", lambda df: df.withColumn("cents", F.col("cents") * 2))
REGISTRY.add("filter", "kinds", lambda df, kinds: df.where(F.col("kind").isin(*kinds)))


def _paired(left: pa.Table, right: pa.Table) -> pa.Table:
    """The n-th rows of two arms as far as both go."""
    a, b = (sorted(zip(t.column("seq").to_pylist(), t.column("cents").to_pylist())) for t in (left, right))
    key = (left if left.num_rows else right).column("stream_id")[0].as_py()
    rows = [(key, i, x[1] - y[1]) for i, (x, y) in enumerate(zip(a, b))]
    columns = list(zip(*rows)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["stream_id", "step", "difference"])


REGISTRY.add("join", "paired", _paired)


@q(M + "select seq, stream_id, cents * 2 as cents from m where kind in ('click', 'view') and cents <= 4000")
def custom_stages(spark, sf):
    chain = (REGISTRY.get("filter", "kinds"), {"kinds": ["click", "view"]}), (REGISTRY.get("stage", "cheap"), {"most": 4000}), REGISTRY.get("stage", "doubled")
    return stages.do(messages(spark, sf), *chain).select("seq", "stream_id", "cents")


@q(M + ", n as (select stream_id, kind, cents, row_number() over (partition by stream_id, kind order by seq) - 1 as step from m) select a.stream_id, a.step, a.cents - b.cents as difference from n a join n b on a.stream_id = b.stream_id and a.step = b.step and a.kind = 'click' and b.kind = 'view'")
def custom_join(spark, sf):
    m = messages(spark, sf).select("stream_id", "seq", "kind", "cents")
    return stages.join("paired", REGISTRY, "stream_id", m.where("kind = 'click'"), m.where("kind = 'view'"), "stream_id long, step long, difference long")


@q("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity::bigint as l_quantity, l_returnflag from lineitem")
def shape_conform(spark, sf):
    """Columns converted to the shape that a stage asks for, as far as the policy lets."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return stages.shape(li, "l_orderkey long, l_linenumber long, l_quantity long, l_returnflag string", "auto", frozenset({"narrow"}))[0]


@q(M + "select 'rows' as branch, 'done' as outcome, count(*) as result from m union all select 'late', 'done', count(*) from m where arrival_us - pts_us > 300000000 union all select 'broken', 'failed', null")
def branch_isolation(spark, sf):
    """Branches of one stream: one that fails takes no other with it."""
    own = stages.Branches()
    own.attach("rows", lambda d: d.count())
    own.attach("late", lambda d: d.where("arrival_us - pts_us > 300000000").count())
    own.attach("broken", lambda d: d.select("no_such_column").count())
    told = own.run(messages(spark, sf))
    return spark.createDataFrame([(name, outcome, result if outcome == "done" else None) for name, (outcome, result) in told.items()], "branch string, outcome string, result long")


@q("select o_orderkey, o_custkey, o_orderstatus from orders")
def destination_records(spark, sf):
    """Rows written to a destination that commits, and read again by its manifests."""
    destination.register(spark)
    path, schema = store.new_folder(spark, "records"), "o_orderkey long, o_custkey long, o_orderstatus string"
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.format("records").mode("append").save(path)
    return spark.read.format("records").schema(schema).load(path)


@q("select 'tone' as stream, r as n, 'packet' as kind, r * 20000000 as pts_ns, r % 50 = 0 as key from range(1000) t(r) union all select 'tone', 1000, 'eos', null, null union all select 'marks', r, 'event', r * 1000000000, null from range(30) t(r) union all select 'marks', 30, 'eos', null, null")
def push_rows(spark, sf):
    """Two functions push packets and events; their ends end the streams."""

    def tone(p):
        for i in range(1000):
            p.packet(i.to_bytes(4, "little"), i * 20_000_000, i % 50 == 0)

    def marks(p):
        for i in range(30):
            p.event(f"mark {i}", i * 1_000_000_000)

    return push.push_frame(spark, {"tone": tone, "marks": marks}).select("stream", "n", "kind", "pts_ns", "key")


@q("select stream_id, n, pts_ns, md5 from (select user_id as stream_id, row_number() over (partition by user_id order by event_id) - 1 as n, (row_number() over (partition by user_id order by event_id) - 1) * 33333333 + (row_number() over (partition by user_id order by event_id) - 1) // 3 as pts_ns, md5(props || event_type) as md5 from events)")
def ivf_remux(spark, sf):
    """Each stream's messages muxed as an IVF file and demuxed again; times are in thirtieths of a second."""
    containers.register(spark)
    path = store.new_folder(spark, "ivf")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(by("user_id", "event_id")) - 1).cast("long").alias("pts"), F.concat("props", "event_type").cast("binary").alias("payload"))
    rows.repartition("stream").sortWithinPartitions("stream", "pts").write.format("ivf").option("rate", 30).mode("append").save(path)
    back = spark.read.format("ivf").load(path)
    return back.select(F.regexp_extract("path", r"/(\d+)\.ivf$", 1).cast("long").alias("stream_id"), "n", "pts_ns", F.md5("payload").alias("md5"))


@q("select doc_id, md5(coalesce(text, '')) as md5, strlen(coalesce(text, '')) as n_bytes from documents where strlen(coalesce(text, '')) > 0")
def depacketize_h264(spark, sf):
    """Texts as units in fragments of 1,100 bytes, made whole from their packets."""
    d = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b")).where("octet_length(b) > 0")
    d = d.withColumn("parts", F.ceil(F.octet_length("b") / 1100).cast("int"))
    p = d.select("doc_id", F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), "parts", "b")
    head = F.when(F.col("i") == 0, 0x80).otherwise(0) + F.when(F.col("i") == F.col("parts") - 1, 0x40).otherwise(0) + 5
    packed = F.concat(F.lit(bytes([0x7C])), F.unhex(F.lpad(F.hex(head.cast("long")), 2, "0")), F.expr("substring(b, i * 1100 + 1, 1100)"))
    p = p.select("doc_id", F.col("i").cast("long").alias("number"), F.lit(0).cast("long").alias("time"), (F.col("i") == F.col("parts") - 1).alias("mark"), packed.alias("payload"))
    whole = rtp.depacketize(p, "doc_id", ["number"], ["number", "time", "mark", "payload"], "h264")
    body = F.expr("substring(payload, 6)")  # behind the start code and the unit's own byte
    return whole.select("doc_id", F.md5(body).alias("md5"), F.octet_length(body).cast("long").alias("n_bytes"))
