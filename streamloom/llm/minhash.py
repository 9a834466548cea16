"""Near-duplicate texts by SuperMinHash signatures, banding, verification and union-find grouping.

SuperMinHash (Ertl, 2017): every element draws a random permutation of the m slots and offers slot
p(j) the rank j plus a uniform number; a slot keeps its least offer. Ranks within an element are
correlated, which lowers the variance against independent slots. An offer of rank j cannot beat a
value below j, so the ranks are walked in layers and the walk stops at the first layer that no slot
needs: for a set much larger than m, the first.

1. One pass gives each document its shingle count, a digest of its shingle set and its band keys.
2. Documents with equal sets form a class; its smallest id stands for it from here on.
3. Classes that share a band key are candidates. First each is paired with one of its bucket (stars, at
   most as many pairs as rows), the pairs are verified on full sets, and components formed. Then
   every candidate pair whose ends are still in different components is verified too. Pairs within a
   component can't change the result, so nothing is lost and no bucket is expanded into all pairs.
   Sizes and four bits of each slot tell most pairs that can't be similar before texts are moved; what
   is left in unsettled buckets is compared by whole sets within the join, so that a group of texts that
   are all just below the threshold is tested in full and yields no rows.
4. Components by union-find and star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, small, words_of, written
from .components import connected_components

#: 32 bands of 5 slots: a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6; what else is
#: filtered before verification adds 1e-9 to that (``_alike``).
BANDS, ROWS = 32, 5
#: Distinct words whose hash a worker keeps.
MEMO = 250_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], size: int, memo: WordHash) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``size`` make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n < size:
        size = n
        h = np.array([n * 0x9E3779B97F4A7C15 % 2**64], np.uint64)
    else:
        h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + ids[j : n - size + 1 + j])
    return np.unique(h)


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The m least offers of a non-empty set of distinct 64-bit elements."""
    n = len(elements)
    least = np.full(m, float(m))
    order = rows = None
    for j in range(m):
        x = _mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = j + ((_mix(x) >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        if order is None and j:  # the first layer needs no table: its swap is known from its draw
            order, rows = np.tile(np.arange(m, dtype=np.uint16), (n, 1)), np.arange(n)
            order[:, 0], order[rows, first] = first, 0
        if j:
            slot = order[rows, at]
            order[rows, at] = order[:, j]
            order[:, j] = slot
        else:
            slot = first = at
        np.minimum.at(least, slot, j + (x >> _U(11)) * 2.0**-53)
        if least.max() < j + 1:
            break
    return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bits = _mix(signature.view(np.uint64)).reshape(-1, rows)
    h = np.arange(len(bits), dtype=np.uint64)
    for j in range(rows):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + bits[:, j])
    return h.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots a word."""
    bits = (_mix(signature.view(np.uint64)) >> _U(60)).reshape(-1, 16)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=np.uint64) * _U(4)), axis=1).view(np.int64)


def _alike(percent: int, m: int) -> "F.Column":
    """Whether sizes na, nb and sketches allow the similarity. Sizes bound it; of the sketches' slots a
    pair at the threshold differs in more than this many, six deviations, once in some 10**9 pairs."""
    q = (1 - percent / 100) * 15 / 16
    most = int(m * q + 6 * (m * q * (1 - q)) ** 0.5) + 1
    differ = F.lit(0)
    for i in range(m // 16):
        x = F.col("sketcha")[i].bitwiseXOR(F.col("sketchb")[i])
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)") & (differ <= most)


def _signer(size: int, bands: int, rows: int):
    def sign(batches):
        memo = WordHash()
        for batch in pieces(batches):
            ids, counts, k1, k2, keys, bits = batch.column(0), [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(words_of(text), size, memo)
                counts.append(len(s))
                if len(s):
                    d = xxhash.xxh3_128_digest(s.tobytes())
                    k1.append(int.from_bytes(d[:8], "little", signed=True))
                    k2.append(int.from_bytes(d[8:], "little", signed=True))
                    signature = super_minhash(s, bands * rows)
                    keys.append(band_keys(signature, rows))
                    bits.append(sketch(signature))
                else:
                    k1.append(None)
                    k2.append(None)
                    keys.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

    return sign


def _setter(size: int):
    def sets(batches):
        memo = WordHash()
        for batch in pieces(batches):
            own = [shingles(words_of(text), size, memo) for text in batch.column("text").to_pylist()]
            halves = [np.unique(s.astype(np.uint32)).view(np.int32) for s in own]
            sizes, lost = [len(s) for s in own], [len(s) - len(h) for s, h in zip(own, halves)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(halves, pa.list_(pa.int32()))], ["rep", "n", "lost", "elements"])

    return sets


def _verifier(size: int, percent: int):
    def verify(batches):
        memo, last = WordHash(), (None, None)
        for batch in pieces(batches):
            keep = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if last[0] != y:  # the hub of a star comes again and again
                    last = (y, shingles(words_of(y), size, memo))
                p, q = shingles(words_of(x), size, memo), last[1]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both) and len(p) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. Only texts in a pair are moved."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = written(docs.join(small(ids), "doc_id", "left_semi"), "texts")
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
    return written(arrow_map(both, _verifier(size, percent), "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if 100 * |A & B| >= percent * |A | B| over their sets of distinct ``size``-word
    shingles; a component holds what links reach, and its smallest id is kept. A null or wordless text
    has an empty set and is linked with nothing. A row without an id is linked with nothing: its
    component is null and it is kept. Rows with one id are one node: their links are pooled. Other
    columns, whatever their names, are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"
    signed = written(arrow_map(docs, _signer(size, bands, rows), schema), "signed")
    usable = signed.where("doc_id is not null and k1 is not null")
    classes = written(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.hint("merge"), (usable.doc_id == classes.rep) & (usable.k1 == classes.k1) & (usable.k2 == classes.k2), "left_semi")
    rows_ = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    hub = F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep"))["rep"]  # another in each bucket, so that a poor one does no harm
    hubs = rows_.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    members = written(rows_.join(hubs.hint("merge"), "key").select("key", "rep", "hub"), "members")
    facts = usable.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "bands")
    facts = written(facts.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi"), "facts")
    mine, other = (facts.select(*(F.col(c).alias(f"{c}{x}") for c in facts.columns)) for x in "ab")
    alike = _alike(percent, bands * rows)

    pairs = members.where("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
    first = pairs.join(mine.hint("merge"), F.col("a") == F.col("repa")).join(other.hint("merge"), F.col("b") == F.col("repb")).where(alike)
    first = written(first.select("a", "b").distinct(), "star")
    links = _verified(first, docs, size, percent)

    found = connected_components(links)
    placed = members.join(found.hint("merge"), members.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = written(placed, "placed")
    split = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("c", "comp")).alias("major"))
    open_ = placed.join(split.where("parts > 1").select("key", "major").hint("merge"), "key")
    open_ = written(open_.join(facts.hint("merge"), "rep"), "open")
    sets = docs.join(small(written(open_.select(F.col("rep").alias("doc_id")).distinct(), "ids")), "doc_id", "left_semi")
    open_ = open_.join(arrow_map(sets, _setter(size), "rep long, n long, lost long, elements array<int>").hint("merge"), ["rep", "n"])
    mine, other = (written(open_.where(w), "open").select("key", *(F.col(c).alias(f"{c}{x}") for c in ("rep", "comp", "n", "sketch", "bands", "lost", "elements"))) for x, w in (("a", "true"), ("b", "comp <> major")))
    common = F.filter(F.zip_with("bandsa", "bandsb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    # half hashes show what two sets share, but for those that coincide within a set, which are counted: no link is lost
    shared = F.size(F.array_intersect("elementsa", "elementsb")) + F.least("losta", "lostb")
    enough = 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)
    rest = mine.join(other.hint("merge"), (mine.key == other.key) & (F.col("compa") != F.col("compb")) & alike & (common[0] == mine.key) & enough)
    rest = rest.select(F.greatest("repa", "repb").alias("a"), F.least("repa", "repb").alias("b")).distinct()
    rest = written(rest.join(first.hint("merge"), ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        links = links.unionByName(_verified(rest, docs, size, percent))
        found = connected_components(links)
    grouped = classes.join(found.hint("merge"), classes.rep == found.node, "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    grouped = written(grouped, "grouped")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(grouped.hint("merge"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
