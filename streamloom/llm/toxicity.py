"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over subsequences of three characters (word ends count as characters), the
products of their gap weights: GAP to the power of the characters skipped, none over SPAN characters.
So an insult with characters put in or left out stays close to the insult. Landmarks are words of the
training sentences; K_mm^(-1/2) k(word) are the Nystroem features on which a linear machine with squared
hinge loss is trained. Its decision is linear in the subsequences, so it folds into one table over
character triples, and scoring a word is some gathers.

Training is on labelled sentences, as multiple instances: all words of a sentence from a clean text are
negative; a sentence from a toxic text is as toxic as its worst word, its witness. Witnesses start
as the words that best cover the toxic texts at high odds against clean ones, and are chosen again
by the machine, as are the hardest clean words. A text's two worst words decide, by logistic
regression. Runs of single characters count as one more word, so spaced-out insults are seen as well.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free, pieces, table, written

GAP, SPAN = 0.5, 6
#: Places of the folded table. Triples are hashed into it, so that an alphabet may have any number of characters.
PLACES = 1 << 20
#: Characters of a word taken at once; longer words are read in windows that overlap by half.
WIDTH = 24
#: Bounds of the training sample: labelled texts with and without the mark, by hash of the id, and their bytes in all.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_BYTES = 2000, 4000, 32_000_000
#: Bounds of the fit, on words of that sample: landmarks of the kernel, witnesses that it starts from, positive and
#: negative words of the machine, hard negatives that a round adds.
LANDMARKS, SEEDS, POSITIVES, NEGATIVES, HARD = 160, 400, 4000, 12_000, 1000
#: Words whose decision a worker keeps.
MEMO = 300_000
#: Witnesses sought for each toxic text: one that is covered by others may still be the only one elsewhere.
COVER = 2
FLOOR = -3.0
_EDGE = ".,;:!?\"'()[]{}<>-_…“”„»«¿¡"
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"[\n.!?]+")
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def tokens(text: str) -> list[str]:
    low = text.lower()
    found = low.split()
    if sum(len(t) == 1 for t in found) > 2:
        found += ["".join(m.split()) for m in _SPACED.findall(low)]
    return found


class Letters:
    """Characters as numbers: 1 and 2 are a word's start and end, 0 all that training hasn't seen; every character
    of the training words has a number, however many there are."""

    def __init__(self, words: list[str]):
        self.at = {c: i + 3 for i, c in enumerate(sorted(set("".join(words))))}

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of codes, their lengths, and the word of each row."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            w = w.strip(_EDGE)
            for k in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
                c = [self.at.get(x, 0) for x in w[k : k + WIDTH]]
                pieces.append([1] * (k == 0) + c + [2] * (k + WIDTH >= len(w)))
                owner.append(i)
        length = np.array([len(p) for p in pieces])
        out = np.zeros((len(pieces), WIDTH + 2), np.int32)
        for i, p in enumerate(pieces):
            out[i, : len(p)] = p
        return out, length, np.array(owner)


def triples(codes: np.ndarray):
    """(weight, index of the triple per row and place) for every pair of offsets; index 0 for none."""
    for i, j in _OFFSETS:
        a, b, c = codes[:, : -j or None], codes[:, i : codes.shape[1] - j + i], codes[:, j:]
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + c.astype(np.uint64)
        place = ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(44)).astype(np.int64) % (PLACES - 1) + 1
        yield GAP ** (j - 2), np.where((a > 0) & (b > 0) & (c > 0), place, 0)


def norms(length: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(np.maximum(length - j, 0) * GAP ** (2 * (j - 2)) for _, j in _OFFSETS) + 1e-9)


class Model:
    """Letters, the folded table, its bias, and the weights of a text's two worst words."""

    def __init__(self, letters: Letters, weights: np.ndarray, bias: float):
        self.letters, self.weights, self.bias, self.text = letters, weights, bias, np.array([0.0, 0.0, 0.0])
        self.landmarks: list[tuple[str, float]] = []  # with their shares in the decision, which the table sums up

    def decide(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        out = np.full(len(words), FLOOR)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            codes, length, owner = self.letters.codes(part)
            total = np.zeros(len(codes))
            for weight, index in triples(codes):
                total += weight * self.weights[index].sum(axis=1)
            f = np.clip(total / norms(length) + self.bias, FLOOR, 3.0)
            np.maximum.at(out, owner + k, f)
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(worst @ self.text[:2] + self.text[2])))


def worst_two(found: list[str], memo: dict[str, float]) -> tuple[float, float]:
    if not found:
        return FLOOR, FLOOR
    f = np.fromiter(map(memo.__getitem__, found), float, len(found))
    if len(f) == 1:
        return float(f[0]), FLOOR
    top = np.partition(f, len(f) - 2)
    return float(top[-1]), float(top[-2])


def _kernel(letters: Letters, words: list[str], columns: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """k(word, landmark); columns: place of each triple among those of the landmarks, else -1."""
    out = np.zeros((len(words), marks.shape[0]), np.float32)
    for k in range(0, len(words), 1000):
        codes, length, owner = letters.codes(words[k : k + 1000])
        phi = np.zeros((len(codes), marks.shape[1]), np.float32)
        rows = np.arange(len(codes))[:, None]
        for weight, index in triples(codes):
            at = columns[index]
            r, c = np.broadcast_to(rows, at.shape)[at >= 0], at[at >= 0]
            np.add.at(phi, (r, c), weight)
        sim = (phi / norms(length)[:, None].astype(np.float32)) @ marks.T
        np.maximum.at(out, owner + k, sim)
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge loss, by Newton steps on its active set."""
    z1 = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(float)
    w = np.zeros(z1.shape[1])
    penal = np.full(len(w), ridge)
    penal[-1] = ridge / 100
    active = np.ones(len(y), bool)
    for _ in range(30):
        za = z1[active] * weight[active, None]
        w = np.linalg.solve(za.T @ z1[active] + np.diag(penal), za.T @ y[active])
        now = y * (z1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + 0.02 * np.eye(len(w))
        step = np.linalg.solve(h, x1.T @ (p - y) + 0.02 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts; with only one label among them, one that scores the share of it."""
    seen: dict[str, int] = {}
    for t, y in zip(texts, toxic):
        seen[t or ""] = max(int(y), seen.get(t or "", 0))
    docs = sorted(seen.items())
    y = np.array([v for _, v in docs], float)
    if not len(y) or y.min() == y.max():
        model = Model(Letters([]), np.zeros(PLACES, np.float32), 0.0)
        model.text[2] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -5.0
        return model
    # a text's sentences share its label and its words; a run of single characters may cross them
    words = [sorted({w.strip(_EDGE) for s in _SENTENCE.split(t) for w in tokens(s)} - {""}) for t, _ in docs]
    n1, n0 = y.sum(), len(y) - y.sum()
    df1, df0 = Counter(w for ws, v in zip(words, y) if v for w in ws), Counter(w for ws, v in zip(words, y) if not v for w in ws)
    odds = {w: np.log((c + 0.5) / (n1 + 1)) - np.log((df0[w] + 0.5) / (n0 + 1)) for w, c in df1.items()}
    likely = sorted((w for w, c in df1.items() if c >= 2 and len(w) > 2 and odds[w] > 2), key=lambda w: (-df1[w] * odds[w], w))
    where: dict[str, list[int]] = {w: [] for w in likely}
    for i, (ws, v) in enumerate(zip(words, y)):
        if v:
            for w in ws:
                if w in where:
                    where[w].append(i)
    covered, seeds = np.zeros(len(y), int), []
    for w in likely:
        if (covered[where[w]] < COVER).sum() >= 2:
            covered[where[w]] += 1
            seeds.append(w)
            if len(seeds) == SEEDS:
                break
    seeds = seeds or likely[:1] or [max(df1, key=lambda w: (odds[w], w), default="")]
    clean = sorted(df0, key=lambda w: (-df0[w], w))
    rng = np.random.default_rng(7)
    letters = Letters(list(df1) + list(df0))
    marks_ = seeds[: LANDMARKS - 48] + clean[:16] + [clean[int(i)] for i in rng.choice(len(clean), min(32, len(clean)), replace=False)] if clean else seeds[:LANDMARKS]
    marks_ = list(dict.fromkeys(marks_))
    codes, length, owner = letters.codes([m[:WIDTH] for m in marks_])
    used = np.unique(np.concatenate([i.ravel() for _, i in triples(codes)]))
    used = used[used > 0]
    columns = np.full(PLACES, -1, np.int32)
    columns[used] = np.arange(len(used))
    phi = np.zeros((len(codes), len(used)), np.float32)
    for weight, index in triples(codes):
        at = columns[index]
        r = np.broadcast_to(np.arange(len(codes))[:, None], at.shape)[at >= 0]
        np.add.at(phi, (r, at[at >= 0]), weight)
    phi /= norms(length)[:, None].astype(np.float32)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(float))
    inverse = vectors @ np.diag(np.where(values > 1e-4, 1 / np.sqrt(np.maximum(values, 1e-4)), 0)) @ vectors.T

    positive, negative = list(seeds), [clean[int(i)] for i in sorted(rng.choice(len(clean), min(NEGATIVES, len(clean)), replace=False))] if clean else []
    for _ in range(4):
        both = positive + negative
        target = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.where(target > 0, len(both) / 2 / len(positive), len(both) / 2 / max(1, len(negative)))
        w = _svm(_kernel(letters, both, columns, phi) @ inverse, target, weight)
        table_ = np.zeros(PLACES, np.float32)
        shares = inverse @ w[:-1]  # of each landmark in the decision
        table_[used] = shares @ phi
        model = Model(letters, table_, float(w[-1]))
        f0 = model.decide(clean)
        hard = [clean[int(i)] for i in np.argsort(-f0)[:HARD] if f0[i] > -1]
        f1 = model.decide(likely)
        more = [u for u, v in zip(likely, f1) if v > 0 and df0[u] == 0]
        positive, negative = list(dict.fromkeys(seeds + more))[:POSITIVES], list(dict.fromkeys(negative + hard))
    memo = dict(zip(every := sorted({w for t, _ in docs for w in tokens(t)}), model.decide(every)))
    worst = np.array([worst_two(tokens(t), memo) for t, _ in docs])
    model.text = _logistic(worst, y)
    model.landmarks = list(zip([m[:WIDTH] for m in marks_], shares.tolist()))
    return model


def _scorer(model: Model, text_at: int, name: str):
    def score(batches):
        memo: dict[str, float] = {}
        for batch in pieces(batches):
            worst, held, texts = [], [], batch.column(text_at).to_pylist()
            for start in range(0, len(texts), 500):
                held = [tokens(t or "") for t in texts[start : start + 500]]
                if len(memo) > MEMO:
                    memo.clear()
                new = list({w for ws in held for w in ws} - memo.keys())
                memo.update(zip(new, model.decide(new).tolist()))
                worst += [worst_two(ws, memo) for ws in held]
            p = model.probability(np.array(worst).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, name])

    return score


def held_out(doc_id) -> "F.Column":
    """Whether labels of this row are kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out: of each label the
    first by hash of the id, TOXIC_DOCS and CLEAN_DOCS at most, as far as their texts, whole ones, have no more than
    SAMPLE_BYTES together. Null labels and ids are left out; of several labels of one id the largest counts, of
    several texts the least. Without any such row every text gets one score, near 0."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [rows.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in (("toxic > 0", TOXIC_DOCS), ("toxic <= 0", CLEAN_DOCS))]
    wanted = written(first[0].unionByName(first[1]), "wanted")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
    left, chosen = SAMPLE_BYTES, []
    for r in sample.select("doc_id", "bytes").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # no more than the two bounds
        if r.bytes <= left:
            left -= r.bytes
            chosen.append((r.doc_id,))
    ids = docs.sparkSession.createDataFrame(chosen, sample.select("doc_id").schema)
    taken = sample.join(F.broadcast(ids), "doc_id").select("text", "toxic").coalesce(1)
    made = arrow_map(taken, _fitter, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([], [])


def _fitter(batches):
    """The model of a task's rows (the whole sample), pickled: so the fit takes an executor's memory, not the driver's,
    and is made again if the executor is lost."""
    texts, toxic = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        toxic += [int(v > 0) for v in batch.column(1).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, toxic))], pa.binary())], ["model"])


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs, all columns and rows, with the probability of toxicity as ``name``; ValueError if docs has such a column.

    A null text counts as empty; empty texts get the score of a text without any word. Equal texts get
    equal scores. Texts are read whole, whatever their length.
    """
    if free(docs, name) != name:
        raise ValueError(f"docs has a column {name}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, _scorer(model, docs.columns.index(text_col), name), f"{fields}, `{name}` double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    s = scored(docs, fit(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
