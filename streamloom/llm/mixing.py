"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate w (copies on average). Of all rates in [0, 3] that give each source its target
of words, those of least relative entropy to w = 1 are w = min(3, exp(t * x)) with x the document's size
over its source's mean, one multiplier t a source: the solution of the convex dual, found by Newton
steps on all sources at once. A rate depends on source and size only, so the steps run on counts of
(source, size), not on documents. Rates are then rounded to whole copies: floor(w), and one copy more
for the documents first in a pseudo-random order weighted by the fraction, as long as they fit into
what the source still lacks. The cut in that order comes from totals of slices of it and the documents
of one slice, so no source is ever sorted whole. Last, what remains is filled in rounds: the documents that still
fit are put in another such order and cut alike, until no document fits into what its source lacks. A round
takes one document of each source at least, and leaves less room than the document that it stopped at.

Documents are told apart by their place in the files (``common.numbered``), never by their ids alone: rows that share an
id, or have none, are drawn one by one, and a rerun on the same files takes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, small, spent, table, word_count, written

CAP = 3.0
#: Slices of the order in which a source's documents get their last copy.
SLICES = 4096


def _keyed(source) -> "F.Column":
    """A key that is never null: empty for a null source."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _running(df: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """df with ``rank`` (from 0 in the given order, which must be total) and, for each of ``sums``, its total over the
    rows before as ``before_...``. Ranges of the order are summed first, so no task has more than a range."""
    dealt = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"all_{c}") for c in sums))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # of ranges, which are as few as partitions
    starts = totals.select("range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"), *(F.coalesce(F.sum(f"all_{c}").over(over), F.lit(0)).alias(f"first_{c}") for c in sums))
    own = Window.partitionBy("range").orderBy(*order)
    rows = dealt.join(starts.hint("merge"), "range").withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    before = [(F.col(f"first_{c}") + F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"before_{c}") for c in sums]
    return rows.select(*df.columns, "rank", *before)


def _targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(src, source_size) with the target: shares by weight, none above CAP times the source's size.

    Sources whose share of what is left would pass their bound are those of least bound per weight, so
    one ordered pass finds them all: the level is set at the first source that its share doesn't fill.
    """
    ranked = _running(sizes, [F.col("src") == "", F.col("src")], [])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("double")
    ranked = written(ranked.select("src", "source_size", w.alias("w"), (CAP * F.col("source_size")).alias("bound")), "weighed")
    words, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    if words is None:
        return ranked.select("src", "source_size", F.lit(0.0).alias("target"))
    s = _running(ranked, [F.col("bound") / F.col("w"), F.col("src")], ["bound", "w"])
    s = s.withColumn("level", (F.lit(float(words)) - F.col("before_bound")) / (F.lit(weight) - F.col("before_w")))
    level = s.where("level * w < bound").agg(F.min(F.struct(F.col("bound") / F.col("w"), "src", "level"))["level"]).first()[0]
    target = F.col("bound") if level is None else F.least("bound", F.col("w") * F.lit(level))
    return ranked.select("src", "source_size", target.alias("target"))


def _multipliers(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with t for each source, null where the rate is CAP for all (or where there is no word).

    Newton steps on log of the words reached, kept within a bracket that every step narrows or, while it has one
    end only, doubles; a source is done when its words are met or its bracket is as narrow as numbers are. So
    the steps end.
    """
    totals = counts.groupBy("src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = targets.join(totals.hint("merge"), "src").withColumn("open", F.expr(f"target > 0 and target < {CAP} * source_size"))
    state = state.withColumn("t", F.when(F.col("open"), F.log(F.col("target") / F.greatest("source_size", F.lit(1)))))
    none = F.lit(None).cast("double")
    state = written(state.withColumn("lo", none).withColumn("hi", none).withColumn("todo", F.col("open")), "newton")
    while state.where("todo").take(1):
        work = counts.join(small(state.where("todo").select("src", "t", "mean")), "src")
        x = F.col("size") / F.col("mean")
        inside = F.col("t") * x < F.log(F.lit(CAP))
        mass = F.col("n") * F.col("size")
        got = work.groupBy("src").agg(F.sum(mass * F.when(inside, F.exp(F.col("t") * x)).otherwise(CAP)).alias("got"), F.sum(mass * F.when(inside, F.exp(F.col("t") * x) * x).otherwise(0.0)).alias("by"))
        s = state.join(got.hint("merge"), "src", "left")
        lo = F.when(F.col("todo") & (F.col("got") < F.col("target")), F.col("t")).otherwise(F.col("lo"))
        hi = F.when(F.col("todo") & (F.col("got") >= F.col("target")), F.col("t")).otherwise(F.col("hi"))
        s = s.withColumn("lo", lo).withColumn("hi", hi)
        far = (F.abs(F.col("got") / F.col("target") - 1) > 1e-9) & F.coalesce(F.col("hi") - F.col("lo") > 1e-15 * (F.abs("hi") + F.abs("lo")), F.lit(True))
        s = s.withColumn("todo", F.col("todo") & far)
        step = F.col("t") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("by")
        within = (F.col("by") > 0) & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        middle = F.when(F.col("lo").isNull(), F.col("t") - 2 * F.abs("t") - 1).when(F.col("hi").isNull(), F.col("t") + 2 * F.abs("t") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        t = F.when(F.col("todo"), F.when(within, step).otherwise(middle)).otherwise(F.col("t"))
        before, state = state, written(s.withColumn("t", t).select(*state.columns), "newton")
        spent(before)
    return state


def _dealt(docs: DataFrame, state: DataFrame) -> DataFrame:
    """docs (src, size, row) with base copies and the key of the order; null key: no further copy."""
    docs = docs.join(small(state), "src", "left")
    e = F.exp(F.least(F.col("t") * F.col("size") / F.col("mean"), F.log(F.lit(CAP))))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("t").isNotNull(), e).when(F.col("target") > 0, CAP).otherwise(0.0)
    u = (F.xxhash64("row", F.lit("mix")).bitwiseAND(2**53 - 1) + F.lit(0.5)) / F.lit(2.0**53)
    docs = docs.withColumn("rate", rate).withColumn("base", F.when(F.col("rate") >= CAP, int(CAP)).otherwise(F.floor("rate")).cast("long"))
    part = F.col("rate") - F.col("base")
    odds = F.when(part > 0, (u / (1 - u)) * (1 - part) / part)  # order sampling (Rosen's Pareto): odds of u by odds of the fraction
    return docs.withColumn("key", odds / (1 + odds))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sized`` (row, src, size): what decides every document's copies."""
    counts = written(sized.groupBy("src", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = written(_multipliers(counts, _targets(sizes, weights)).select("src", "source_size", "target", "t", "mean"), "state")
    dealt = _dealt(sized, state).withColumn("slice", F.least(F.floor(F.col("key") * SLICES), F.lit(SLICES - 1)))
    dealt = written(dealt.select("src", "row", "size", "base", "key", "slice"), "dealt")
    have = dealt.groupBy("src").agg(F.sum(F.col("base") * F.col("size")).alias("have"))
    need = state.join(have.hint("merge"), "src").select("src", F.floor(F.col("target") - F.col("have")).alias("need"))
    totals = dealt.where("key is not null").groupBy("src", "slice").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    cut = totals.withColumn("run", run).join(need.hint("merge"), "src").where("run > need")
    cut = written(cut.groupBy("src").agg(F.min(F.struct("slice", (F.col("need") - F.col("run") + F.col("words")).alias("room"))).alias("c")).select("src", "c.slice", "c.room"), "cut")
    order = Window.partitionBy("src", "slice").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.join(small(cut), ["src", "slice"]).withColumn("run", F.sum("size").over(order))
    last = inside.where("run <= room").groupBy("src").agg(F.max(F.struct("key", "row")).alias("last"))
    plan = state.join(cut.hint("merge"), "src", "left").join(last.hint("merge"), "src", "left")
    # without a cut all fractions fit; with a cut but no last document, what lies below the slice
    plan = written(plan.select("src", "source_size", "target", "t", "mean", "slice", "last", F.array().cast(_ROUNDS).alias("rounds")), "plan")
    took = _copied(dealt.join(small(plan.select("src", F.col("slice").alias("cut"), "last", "rounds", "target")), "src"))
    took = written(took.select("src", "row", "size", "copies", "target"), "took")
    room = written(took.groupBy("src").agg(F.floor(F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("room")), "room")
    fits = written(took.drop("target").join(small(room), "src").where(_FITS), "fits")
    done, n = None, 0
    while fits.take(1):
        ends = _filled(fits, n)
        n += 1
        done = ends if done is None else done.unionByName(ends)
        state = ends.select("src", F.struct("n", "room", "key", "id").alias("round"), F.col("left"))
        grown = fits.drop("room").join(small(state), "src")
        grown = grown.withColumn("copies", F.col("copies") + _given(F.col("round"), F.col("copies")))
        before, fits = fits, written(grown.select("src", "row", "size", "copies", F.col("left").alias("room")).where(_FITS), "fits")
        spent(before)
    if done is not None:
        rounds = done.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("n", "room", "key", "id"))).alias("more"))
        plan = plan.join(rounds.hint("merge"), "src", "left").withColumn("rounds", F.coalesce("more", "rounds")).drop("more")
    return written(plan, "plan")


_ROUNDS = "array<struct<n:int,room:bigint,key:double,id:bigint>>"
#: Documents that can have one copy more.
_FITS = f"size > 0 and size <= room and copies < {CAP}"


def _place(n) -> "F.Column":
    """A document's place in the order of round n, in [0, 1)."""
    return F.xxhash64("row", n).bitwiseAND(2**53 - 1) / F.lit(2.0**53)


def _given(r, copies) -> "F.Column":
    """1 where round r (n, room, key, id) gives a document of so many copies one more, else 0."""
    fits = (F.col("size") > 0) & (F.col("size") <= r["room"]) & (copies < int(CAP))
    place = _place(r["n"])
    return F.when(fits & ((place < r["key"]) | (place == r["key"]) & (F.col("row") <= r["id"])), 1).otherwise(0).cast("long")


def _filled(fits: DataFrame, n: int) -> DataFrame:
    """(src, n, room, key, id, left): where the order of round n is cut, and the room that it leaves."""
    keyed = fits.withColumn("key", _place(F.lit(n))).withColumn("slice", F.floor(F.col("key") * SLICES))
    totals = keyed.groupBy("src", "slice").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    totals = totals.withColumn("run", F.sum("words").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
    over = F.when(F.col("run") > F.col("room"), F.struct("slice", (F.col("room") - F.col("run") + F.col("words")).alias("rest")))
    cut = totals.groupBy("src").agg(F.first("room").alias("room"), F.max("run").alias("all"), F.min(over).alias("c"))
    cut = written(cut.select("src", "room", "all", "c.slice", "c.rest"), "cut")
    order = Window.partitionBy("src", "slice").orderBy("key", "row")
    inside = keyed.drop("room").join(small(cut.where("slice is not null").select("src", "slice", "rest")), ["src", "slice"])
    inside = inside.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where("run <= rest").groupBy("src").agg(F.max(F.struct("key", "row", "run")).alias("last"))
    whole = F.col("slice").isNull()
    key = F.when(whole, 1.0).otherwise(F.coalesce("last.key", F.col("slice") / SLICES))
    left = F.when(whole, F.col("room") - F.col("all")).otherwise(F.col("rest") - F.coalesce("last.run", F.lit(0)))
    ends = cut.join(last.hint("merge"), "src", "left")
    return written(ends.select("src", F.lit(n).alias("n"), "room", key.alias("key"), F.coalesce("last.row", F.lit(-1)).alias("id"), left.alias("left")), "round")


def _copied(dealt: DataFrame) -> DataFrame:
    """copies for rows with base, key, slice and their source's cut, last and rounds."""
    more = F.when(F.col("key").isNull(), False).when(F.col("cut").isNull() | (F.col("slice") < F.col("cut")), True)
    more = more.otherwise(F.coalesce((F.col("slice") == F.col("cut")) & (F.struct("key", "row") <= F.col("last")), F.lit(False)))
    copies = F.least(F.col("base") + more.cast("long"), F.lit(int(CAP))).cast("long")
    return dealt.withColumn("copies", F.coalesce(F.aggregate("rounds", copies, lambda c, r: c + _given(r, c)), copies))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs.

    size is the number of words; sources in code point order (null last) weigh ``weights`` in turn and
    share as many words as there are, none more than three times its own. taken = copies * size, copies
    0 to 3. A null, empty or wordless text has size 0 and is not taken. Rows with equal ids or none are documents of
    their own. An empty table gives an empty table. Other columns, whatever their names, aren't read.
    """
    docs = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), _keyed(F.col(source_col)).alias("src"), F.col(text_col).alias("text")), "row")
    sized = written(docs.select("doc_id", "src", "row", word_count(F.col("text")).alias("size")), "sized")
    return decided(sized, mixing_plan(sized, weights)).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def decided(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (row, src, size and whatever else) with source_size, target and copies."""
    dealt = _dealt(sized, plan.withColumnRenamed("slice", "cut")).withColumn("slice", F.least(F.floor(F.col("key") * SLICES), F.lit(SLICES - 1)))
    return _copied(dealt)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
