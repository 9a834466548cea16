"""Cross-entropy difference between a target and a background n-gram model (Moore and Lewis, 2010).

Both models share order, smoothing and vocabulary: all words of all documents. A text is a chain of words between two
boundaries. P(word | previous word) = (n(previous, word) + MU * P(word)) / (n(previous) + MU), the mean of a Dirichlet
prior around the unigram (MacKay and Peto, 1995), whose counts are smoothed by adding one half.

Every word and every bigram is counted; nothing is capped, so the tables grow with the corpus:

1. ``shards``: each batch of some MB of texts becomes one row: hashes of its distinct words and the texts as numbers
   into them. Texts are read and split once, whatever follows.
2. ``_requests``: each shard sends its distinct words and bigrams, as sorted 64-bit keys with their counts, packed by
   ranges of the key (buckets). A frequent bigram is one key a shard, so no bucket is hot.
3. ``_answers``: a bucket adds up the counts of its keys over all shards and answers each shard in its own order.
   The number of buckets follows the number of keys, so a bucket's memory is bounded.
4. ``_losses``: a shard with its answers has all counts that its texts need.

Answers are a written table, so a lost executor costs one shard or bucket. With many more buckets than keys in a shard
a packed row holds one key; the cost is then that of a plain join, still linear.

A document's score is the mean over its words of target loss minus background loss, in nats: the lower,
the more it is like the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, small, table, words_of, written

#: Weight of the unigram within a bigram's estimate, in counts.
MU = 20.0
#: Keys of a bucket, on average.
BUCKET_KEYS = 1_000_000
#: Distinct words whose hash a worker keeps.
MEMO = 300_000

_U = np.uint64
_BOUNDARY = 0x5851F42D4C957F2D
_SHARD = "shard long, docs array<long>, sizes array<int>, target binary, words binary, tokens binary, n_keys long, n_events long, n_target long"
_REQUEST = "bucket long, shard long, keys binary, size int, n binary, m binary"
_ANSWER = "shard long, bucket long, size int, n binary, m binary, kinds long"
_LOSS = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


class Hashes(dict):
    """Words to 64-bit hashes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the largest needs: codecs then see runs."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


class Grams:
    """The distinct bigrams and words of a shard: ``keys`` in order, words with an odd key, bigrams with an even one."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes[sizes > 0]
        n, self.width = len(tokens), len(words) + 1
        chain = np.full(n + len(self.sizes) + 1, len(words), np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.word_events = np.arange(n) + doc  # event i goes from place i of the chain to the next
        chain[self.word_events + 1] = tokens
        self.chain = chain
        codes, self.at = np.unique(chain[:-1] * self.width + chain[1:], return_inverse=True)
        self.prev, self.word = codes // self.width, codes % self.width
        h = np.append(words, _U(_BOUNDARY))
        two = _mixed(h[self.prev] * _U(0x9E3779B97F4A7C15) + h[self.word]) & _U(2**64 - 2)
        keys = np.concatenate([two, _mixed(h ^ _U(0xD6E8FEB86659FD93)) | _U(1)]) if n else two
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, events: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs, in all events or in those marked."""
        at, word = (self.at, self.chain[1:]) if events is None else (self.at[events], self.chain[1:][events])
        both = np.concatenate([np.bincount(at, minlength=len(self.prev)), np.bincount(word, minlength=self.width)])
        return both[self.order]

    def split(self, in_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the order of the keys as (by bigram, by word)."""
        out = np.empty(len(in_order))
        out[self.order] = in_order
        return out[: len(self.prev)], out[len(self.prev) :]

    def events_of(self, marked: np.ndarray) -> np.ndarray:
        """The events of the texts (those with words) that are marked."""
        return np.repeat(marked, self.sizes + 1)


def _loaded(words: bytes, tokens: bytes, sizes: list[int]) -> Grams:
    sizes = np.array(sizes, np.int64)
    return Grams(np.frombuffer(words, np.uint64), unpacked(tokens, int(sizes.sum())).astype(np.int64), sizes)


def _sharder(batches):
    memo, part, made = Hashes(), TaskContext.get().partitionId(), 0
    for batch in pieces(batches):
        at: dict[int, int] = {}
        tokens, sizes = [], []
        for text in batch.column("text").to_pylist():
            hashes = list(map(memo.__getitem__, words_of(text)))
            tokens += [at.setdefault(h, len(at)) for h in hashes]
            sizes.append(len(hashes))
        if len(memo) > MEMO:
            memo.clear()
        words, tokens, sizes_ = np.fromiter(at, np.uint64, len(at)), np.array(tokens, np.int64), np.array(sizes, np.int64)
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(np.uint8)
        events = sizes_ + (sizes_ > 0)
        # no more keys than this; how many there are is known when they are sorted
        most = len(words) + 1 + min(int(events.sum()), (len(words) + 1) ** 2)
        row = [[(part << 32) + made], [batch.column("doc_id").to_pylist()], [sizes], [target.tobytes()], [words.tobytes()], [packed(tokens)], [most], [int(events.sum())], [int(events[target > 0].sum())]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], [x.split()[0] for x in _SHARD.split(", ")])
        made += 1


def _requests(bits: int):
    """Packed keys and counts of each shard, by the leading ``bits`` of the key."""

    def send(batches):
        for batch in batches:
            for shard, sizes, target, words, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "sizes", "target", "words", "tokens"))):
                grams = _loaded(words, tokens, sizes)
                if not len(grams.keys):
                    continue
                marked = np.frombuffer(target, np.uint8)[np.array(sizes) > 0] > 0
                n, m = grams.counts(), grams.counts(grams.events_of(marked))
                bucket = (grams.keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams.keys), np.int64)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows = []
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
                    base = _U(int(bucket[a]) << (64 - bits)) if bits else _U(0)
                    rows.append((int(bucket[a]), shard, packed(np.diff(grams.keys[a:b] - base, prepend=_U(0))), b - a, packed(n[a:b]), packed(m[a:b])))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _REQUEST.split(", ")])

    return send


def _answers(rows: pa.Table) -> pa.Table:
    """Sums over a bucket's keys, dealt back to the shards that asked; kinds: distinct words, in the first row."""
    bucket, shard, keys, size, n, m = (rows.column(c).to_pylist() for c in ("bucket", "shard", "keys", "size", "n", "m"))
    # differences suffice: all keys of a bucket have one base
    own = np.concatenate([np.cumsum(unpacked(k, s), dtype=np.uint64) for k, s in zip(keys, size)])
    kinds, at = np.unique(own, return_inverse=True)
    sums = []
    for counts in (n, m):
        every = np.concatenate([unpacked(c, s) for c, s in zip(counts, size)])
        sums.append(np.bincount(at, every.astype(float), len(kinds)).astype(np.uint64)[at])
    ends = np.cumsum(size)
    parts = [[packed(x[e - s : e]) for s, e in zip(size, ends.tolist())] for x in sums]
    words = [int((kinds & _U(1)).sum())] + [0] * (len(size) - 1)
    columns = [pa.array(shard, pa.int64()), pa.array(bucket, pa.int64()), pa.array(size, pa.int32()), pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary()), pa.array(words, pa.int64())]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in _ANSWER.split(", ")])


def _losses(events: tuple[int, int], kinds: int):
    """Scores of a shard's texts from its answers; events: of background and target, kinds: words in all."""

    def score(shard: pa.Table, answers: pa.Table) -> pa.Table:
        rows = shard.to_pylist()
        if not rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], [x.split()[0] for x in _LOSS.split(", ")])
        (row,) = rows
        sizes = np.array(row["sizes"], np.int64)
        means = np.zeros((2, len(sizes)))
        if sizes.any():
            grams = _loaded(row["words"], row["tokens"], row["sizes"])
            got = sorted(answers.to_pylist(), key=lambda a: a["bucket"])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for k, name in enumerate("nm"):
                pairs, words = grams.split(np.concatenate([unpacked(a[name], a["size"]) for a in got]))
                one = (words + 0.5) / (events[k] + 0.5 * kinds)
                loss = -np.log((pairs + MU * one[grams.word]) / (words[grams.prev] + MU))
                means[k] = np.bincount(doc, loss[grams.at[grams.word_events]], len(sizes)) / np.maximum(sizes, 1)
        back, goal = means
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(sizes), pa.array(goal), pa.array(back), pa.array(goal - back)], [x.split()[0] for x in _LOSS.split(", ")])

    return score


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of docs, by models of all docs
    (background) and of those whose id is in target_ids (one column, nulls and repeats count for nothing).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A null, empty or wordless text has no words and 0
    everywhere. Repeated rows are counted and scored each; a row without an id is background only. An empty table
    gives an empty table. Other columns, whatever their names, aren't read.
    """
    ids = written(target_ids.toDF("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "target")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(small(ids), "doc_id", "left")
    shards = written(arrow_map(texts.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")), _sharder, _SHARD), "shards")
    total = shards.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_keys", "n_events", "n_target"))).first()
    bits = max(0, int(total[0] - 1) // bucket_keys).bit_length()
    asked = arrow_map(shards.select("shard", "sizes", "target", "words", "tokens"), _requests(bits), _REQUEST)
    answers = written(asked.groupBy("bucket").applyInArrow(_answers, _ANSWER), "answers")
    kinds = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    both = shards.select("shard", "docs", "sizes", "words", "tokens").groupBy("shard").cogroup(answers.select("shard", "bucket", "size", "n", "m").groupBy("shard"))
    return both.applyInArrow(_losses((total[1], total[2]), kinds), _LOSS)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_entropy_difference(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
