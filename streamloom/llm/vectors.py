"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. A rotation keeps distances; the rotated coordinates are
split into blocks, each with the share of the squared distance that its number of coordinates has in all. Of a close
pair at least one block is within its share. Each block is joined on its own, the pairs within the block's share
are verified exactly on whole vectors, and counted only in the first block that admits them, so that the union over
blocks needs no table of pairs: a task returns link counts and a spanning forest, at most some rows per vector.

The rotation is to the principal axes of a sample, dealt to the blocks in turn, so that every block leads with
coordinates in which vectors differ most; the sample decides where vectors are compared, never which are. Rotated
coordinates are rounded to multiples of 2**-20 (the shares are widened by as much), so that block distances are exact
integers and all tasks agree on which block admits a pair.

A block is dealt by a grid over its two leading coordinates, in cells some radii wide; a vector is at home in one
cell and visits the later of the neighbours that its radius reaches. Within a cell, leaves of a k-d tree are compared
whose boxes are within the share: first by a product over a few leading coordinates in single precision, then what is
left by block distance. Vectors travel packed, in the type they came in.

Equal vectors are one vector with a multiplicity. A cell with more vectors than fit into ``TILE`` numbers is dealt to
several tasks as tiles of chunk by chunk; the cell sizes that decide it are few, as the grid is bounded.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import arrow_map, pieces, spent, table, written
from .components import connected_components, forest

BLOCKS = 3
#: Width of a cell in radii; leading coordinates that are compared before a whole block (an eighth of it, if that is more).
WIDE, LEAD = 12, 8
#: Numbers (rows times dimensions) of a chunk: with its copies some 50 MB in a task, twice that for a tile of two.
TILE = 4_000_000
#: Vectors of the sample whose principal axes are taken, and dimensions beyond which axes are drawn instead.
SAMPLE, AXES = 4096, 2048
LEAF = 256
#: Numbers compared at a time when pairs are verified.
SLICE = 3_000_000
_ONE = float(1 << 20)
_NEIGHBOURS = [(0, 1), (1, -1), (1, 0), (1, 1)]
_STAY = "dim int, block int, x long, y long, i int, j int, wide int, rep binary, key binary, mult binary, home binary, chunk binary, vec binary"
_FOUND = "rep long, key long, links long, other long"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x times powers of two, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=1e-300))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def power(n: int) -> int:
    """The power of two from n up."""
    return 1 << (n - 1).bit_length()


def drawn(x: np.ndarray, blocks: int) -> np.ndarray:
    """Rows of x rotated by random signs and a Walsh-Hadamard transform, in as many dimensions as the next power of two."""
    n, d = x.shape
    size = power(max(d, blocks))
    y = np.zeros((n, size))
    y[:, :d] = x * np.random.default_rng(size).choice([-1.0, 1.0], size=size)[:d]
    h = 1
    while h < size:
        z = y.reshape(n, size // (2 * h), 2, h)
        a, b = z[:, :, 0].copy(), z[:, :, 1].copy()
        z[:, :, 0], z[:, :, 1] = a + b, a - b
        h *= 2
    return y / np.sqrt(size)


def axes_of(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """By dimension, the principal axes of the sample's unit vectors, of largest variance first."""
    axes = {}
    for d in {len(v) for v in sample}:
        if 1 < d <= AXES:
            x = unit(np.array([v for v in sample if len(v) == d], float))
            axes[d] = np.ascontiguousarray(np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1])
    return axes


class Space:
    """Rotated, rounded coordinates of vectors, and the blocks with their radii and limits."""

    def __init__(self, dim: int, cosine: float, blocks: int, axes: np.ndarray | None):
        self.axes, self.blocks = axes, blocks
        size = power(max(dim, blocks)) if axes is None else dim
        parts = [np.arange(b, size, blocks) for b in range(blocks)]
        self.parts = [p for p in parts if len(p)]
        self.radius = [((2 - 2 * cosine) * len(p) / size) ** 0.5 + len(p) ** 0.5 / _ONE + 1e-9 for p in self.parts]
        #: The largest squared distance in a block, in squares of the rounding.
        self.limit = [int((r * _ONE) ** 2) + 1 for r in self.radius]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers, by blocks: those of block b are the columns ``part(b)``."""
        y = np.empty((len(x), sum(map(len, self.parts))), np.int32)
        order = np.concatenate(self.parts)
        step = max(1, SLICE // x.shape[1])
        for k in range(0, len(x), step):
            u = unit(x[k : k + step].astype(float))
            u = drawn(u, self.blocks) if self.axes is None else u @ self.axes
            y[k : k + step] = np.rint(u[:, order] * _ONE)
        return y

    def part(self, b: int) -> slice:
        start = sum(map(len, self.parts[:b]))
        return slice(start, start + len(self.parts[b]))

    def stays(self, y: np.ndarray):
        """(block, cells as (x, y), rows, home) of every stay."""
        for b, radius in enumerate(self.radius):
            width = WIDE * radius
            lead = np.zeros((len(y), 2))
            lead[:, : min(2, len(self.parts[b]))] = y[:, self.part(b)][:, :2] / _ONE
            at = np.floor(lead / width + 0.5).astype(np.int64)  # a cell around 0, where most vectors are
            yield b, at, np.arange(len(y)), True
            low = lead - (at - 0.5) * width
            for off in _NEIGHBOURS:
                reach = sum(np.where(o > 0, width - low[:, k], low[:, k]) ** 2 for k, o in enumerate(off) if o)
                rows = np.flatnonzero(reach <= (radius * (1 + 1e-6)) ** 2)
                if len(rows):
                    yield b, at[rows] + np.array(off), rows, False


def _by_dimension(batch: pa.RecordBatch):
    """For each dimension in the batch: it, the rows, and the vectors in the type they came in."""
    lists = batch.column("embedding")
    lengths = np.diff(lists.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


class Spaces(dict):
    def __init__(self, cosine: float, blocks: int, axes: dict[int, np.ndarray]):
        self.cosine, self.blocks, self.axes = cosine, blocks, axes

    def __missing__(self, dim: int) -> Space:
        space = self[dim] = Space(dim, self.cosine, self.blocks, self.axes.get(dim))
        return space


def _counter(shared):
    def count(batches):
        spaces = Spaces(*shared.value)
        for batch in pieces(batches):
            n: Counter = Counter()
            for d, _, x in _by_dimension(batch):
                for b, cell, _, _ in spaces[d].stays(spaces[d].coordinates(x)):
                    for (u, v), c in zip(*(z.tolist() for z in np.unique(cell, axis=0, return_counts=True))):
                        n[d, b, u, v] += c
            columns = list(zip(*((*k, c) for k, c in n.items()))) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["dim", "block", "x", "y", "n"])

    return count


def _dealer(shared, chunks: dict[tuple[int, int, int, int], int]):
    """A row for each tile of each cell that vectors of a batch stay in."""

    def deal(batches):
        spaces = Spaces(*shared.value)
        for batch in pieces(batches):
            reps, keys, mult = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "k1", "mult"))
            for d, rows, x in _by_dimension(batch):
                for b, cell, at, home in spaces[d].stays(spaces[d].coordinates(x)):
                    cells, which = np.unique(cell, axis=0, return_inverse=True)
                    which = which.ravel()
                    for k, (u, v) in enumerate(cells.tolist()):
                        own = at[which == k]
                        parts = chunks.get((d, b, u, v), 1)
                        chunk = ((reps[rows[own]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                        out = []
                        for c in np.unique(chunk).tolist():
                            s = own[chunk == c]
                            packed = [reps[rows[s]].tobytes(), keys[rows[s]].tobytes(), mult[rows[s]].tobytes(), bytes([home]) * len(s), np.full(len(s), c, np.int32).tobytes(), np.ascontiguousarray(x[s]).tobytes()]
                            out += [(d, b, u, v, min(c, o), max(c, o), x.itemsize, *packed) for o in range(parts)]  # its tile with each chunk
                        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6)
                        for row in out:
                            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], [c.split()[0] for c in _STAY.split(", ")])

    return deal


def leaves(z: np.ndarray, size: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """An order of the rows of z and where its leaves start: halves by the widest coordinate, down to ``size`` rows."""
    done, open_ = [], [np.arange(len(z))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = z[rows]
        k = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = np.argpartition(own[:, k], len(rows) // 2)
        open_ += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)]).tolist()


def candidates(z: np.ndarray, limit: int):
    """Pairs (p, q) of rows of the whole numbers z whose squared distance may be at most ``limit``, in some arrays."""
    order, starts = leaves(z)
    near = z[order].astype(np.float32) / np.float32(_ONE)
    budget = limit / _ONE**2
    low = np.array([near[a:b].min(axis=0) for a, b in zip(starts, starts[1:])])
    high = np.array([near[a:b].max(axis=0) for a, b in zip(starts, starts[1:])])
    lead = near[:, : max(LEAD, near.shape[1] // 8)]
    square, one = (lead * lead).sum(axis=1)[:, None], np.ones((len(z), 1), np.float32)
    # the product of these is the squared distance in the leading coordinates, but for rounding
    left, right = np.hstack([lead, square, one]), np.ascontiguousarray(np.hstack([-2 * lead, one, square]).T)
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        gap = np.maximum(np.maximum(low[k:] - high[k], low[k] - high[k:]), 0)
        meet = np.flatnonzero((gap * gap).sum(axis=1) <= budget * (1 + 1e-5) + 1e-5) + k
        for run in np.split(meet, np.flatnonzero(np.diff(meet) > 1) + 1):  # leaves that stand together
            at, end = starts[run[0]], starts[run[-1] + 1]
            for s in range(at, end, 1024):  # a product that fits into a core's cache
                ps, qs = np.divmod(np.flatnonzero(left[a:b] @ right[:, s : min(end, s + 1024)] <= np.float32(budget + 1e-5)), min(end, s + 1024) - s)
                ps, qs = ps + a, qs + s
                fine = ps < qs
                if fine.any():
                    yield order[ps[fine]], order[qs[fine]]


def _joiner(shared):
    cosine = shared.value[0]

    def join(stays: pa.Table) -> pa.Table:
        rows = stays.to_pydict()
        dim, b, kind = rows["dim"][0], rows["block"][0], {4: np.float32, 8: np.float64}[rows["wide"][0]]
        rep, key, mult, home, chunk = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("rep", np.int64), ("key", np.int64), ("mult", np.int64), ("home", np.uint8), ("chunk", np.int32)))
        x = np.frombuffer(b"".join(rows.pop("vec")), kind).reshape(-1, dim)
        whole = rows["i"][0] == rows["j"][0]
        del rows, stays
        if kind is np.float64:
            x = scaled(x)
        space = Spaces(*shared.value)[dim]
        y = space.coordinates(x)
        over = 1 / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))

        def within(p: np.ndarray, q: np.ndarray, block: int) -> np.ndarray:
            diff = y[p, space.part(block)].astype(np.int64) - y[q, space.part(block)]
            return np.einsum("ij,ij->i", diff, diff) <= space.limit[block]

        links, us, vs, held = np.zeros(len(x), np.int64), [], [], 0
        step = max(1, SLICE // dim)
        for ps, qs in candidates(y[:, space.part(b)], space.limit[b]):
            near = (home[ps] | home[qs]) > 0
            if not whole:
                near &= chunk[ps] != chunk[qs]
            ps, qs = ps[near], qs[near]
            for k in range(0, len(ps), step):
                p, q = ps[k : k + step], qs[k : k + step]
                keep = within(p, q, b)
                p, q = p[keep], q[keep]
                for other in range(b):  # counted there
                    keep = ~within(p, q, other)
                    p, q = p[keep], q[keep]
                keep = np.einsum("ij,ij->i", x[p].astype(float), x[q].astype(float)) * over[p] * over[q] >= cosine
                p, q = p[keep], q[keep]
                np.add.at(links, p, mult[q])
                np.add.at(links, q, mult[p])
                us.append(rep[p])
                vs.append(rep[q])
                held += len(p)
                if held > 1_000_000:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (rep[:0], rep[:0])
        s = links > 0
        n, m = int(s.sum()), len(u)
        columns = [pa.array(np.concatenate([rep[s], u])), pa.array(np.concatenate([key[s], np.zeros(m, np.int64)])), pa.array(np.concatenate([links[s], np.zeros(m, np.int64)])), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(v, pa.int64())])]
        return pa.table(columns, [c.split()[0] for c in _FOUND.split(", ")])

    return join


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df.

    Vectors are linked if their cosine in double precision is at least ``cosine`` (from 0 to 1); those
    that are null, empty, zero or hold a null or non-finite component are linked with nothing, and so
    are vectors of different lengths with each other. Equal vectors are linked. Rows with equal ids
    are one node, whose links are counted per row. A row without an id is linked with nothing, its component is
    null and it is kept. An empty table gives an empty table. Other columns, whatever their names, aren't read.
    """
    spark = df.sparkSession
    own = df.schema[vec_col].dataType
    element = "float" if isinstance(own, ArrayType) and isinstance(own.elementType, FloatType) else "double"
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{element}>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    keyed = df.withColumn("fine", fine).select("vec_id", F.when(F.col("fine"), F.col("embedding")).alias("embedding"))
    keyed = keyed.withColumn("k1", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), F.col("embedding"))))
    valid = keyed.where("k1 is not null")
    classes = written(valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    reps = valid.join(classes.hint("merge"), ["k1", "k2"]).where("vec_id = rep").dropDuplicates(["rep", "k1", "k2"]).select("rep", "k1", "mult", "embedding")
    reps = written(reps, "reps")
    most = reps.agg(F.max(F.size("embedding"))).first()[0] or 1
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(min(SAMPLE, TILE // most)).select("embedding").collect()
    shared = spark.sparkContext.broadcast((cosine, blocks, axes_of([r[0] for r in sample])))
    rows = F.floor(F.lit(float(TILE)) / F.col("dim")) + 1
    sizes = arrow_map(reps, _counter(shared), "dim int, block int, x long, y long, n long").groupBy("dim", "block", "x", "y").agg(F.sum("n").alias("n")).withColumn("rows", rows).where("n > rows")
    chunks = {(r.dim, r.block, r.x, r.y): -(-r.n // r.rows) for r in sizes.collect()}  # no more than the grid has cells
    stays = arrow_map(reps, _dealer(shared, chunks), _STAY)
    found = written(stays.groupBy("dim", "block", "x", "y", "i", "j").applyInArrow(_joiner(shared), _FOUND), "found")
    spent(reps)
    parts = connected_components(found.where("links = 0"), "rep", "other")
    counts = found.where("links > 0").groupBy("rep", F.col("key").alias("k1")).agg(F.sum("links").alias("links"))
    facts = classes.join(counts.hint("merge"), ["rep", "k1"], "left").join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    facts = written(facts.select("k1", "k2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "facts")
    out = keyed.select("vec_id", "k1", "k2").join(facts.hint("merge"), ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
