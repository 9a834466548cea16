"""Operators against brute force, round trips and edge cases on small tables."""

import hashlib
import json
import math
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from streamloom.llm import bpe, chat, exact, lm, minhash, mixing, registry, toxicity, vectors, warc, wrapper
from streamloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = [
    (1, "a b c d e f g h", "s1"), (2, "A b c d e f g h", "s1"), (3, None, None), (4, "", "s2"), (5, "one", "s2"), (6, "ONE", None), (7, "x y z " * 3000, "s1"),
    (7, "x y z " * 3000, "s1"), (None, "a b c d e f g h", "s1"), (8, " \t\n", "s3"), (9, "naïve ünïcode 　 zé", "s3"), (10, "a b c d e f g z", "s2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "en", 0, "clash", -1) for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n string, size long")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = {k: a if v == b else v for k, v in comp.items()}
    return comp, {i: len(s) for i, s in sets.items()}


def test_minhash(spark, docs):
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    comp, sizes = brute_components(dict(zip(table.doc_id, table.text)), 2, 80)
    got = {r.doc_id: r for r in minhash.query(spark, SF).collect()}
    assert {i: r.component_id for i, r in got.items()} == comp and {i: r.n_shingles for i, r in got.items()} == sizes
    rows = minhash.near_duplicates(docs, size=5).collect()
    assert len(rows) == len(DOCS)
    comp, _ = brute_components({r[0]: r[1] for r in DOCS if r[0] is not None}, 5, 80)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == comp
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_minhash_group_below_threshold(spark):
    """Many texts of which few pairs reach the threshold: all of them are told apart."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(80):
        own = list(base)
        for k in rng.choice(60, int(rng.integers(1, 9)), replace=False):
            own[k] = f"v{i}x{k}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    comp, _ = brute_components(texts, 2, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, size=2).collect()} == comp


def test_minhash_recall(spark):
    """All of 400 pairs that are exactly at the threshold are found."""
    rows = []
    for i in range(400):
        shared = [f"a{i}x{k}" for k in range(41)]  # 40 shingles of 2 words, and 5 more on either side: 40 of 50
        rows += [(2 * i, " ".join([f"l{i}x{k}" for k in range(5)] + shared)), (2 * i + 1, " ".join(shared + [f"r{i}x{k}" for k in range(5)]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 800


def test_minhash_halves_that_coincide():
    """The bound on shared elements holds when 32-bit halves coincide."""
    base = np.arange(1, 400, dtype=np.uint64)
    a = np.unique(np.concatenate([base, base[:150] + np.uint64(2**40)]))
    b = np.unique(np.concatenate([base, base[100:300] + np.uint64(2**41), base[:50] + np.uint64(2**40)]))
    half = lambda s: np.unique(s.astype(np.uint32))
    shared = len(np.intersect1d(half(a), half(b))) + min(len(a) - len(half(a)), len(b) - len(half(b)))
    assert shared >= len(np.intersect1d(a, b)) > len(np.intersect1d(half(a), half(b)))


def test_super_minhash_estimates():
    rng = np.random.default_rng(1)
    err = []
    for j in (0.3, 0.8):
        for _ in range(30):
            common = rng.integers(0, 2**63, int(400 * j), dtype=np.uint64)
            rest = rng.integers(0, 2**63, 400 - len(common), dtype=np.uint64)
            a, b = np.concatenate([common, rest[: len(rest) // 2]]), np.concatenate([common, rest[len(rest) // 2 :]])
            x, y = minhash.super_minhash(np.unique(a), 160), minhash.super_minhash(np.unique(b), 160)
            err.append((x == y).mean() - len(common) / 400)
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.05


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 5), (9, 9), (7, 3), (20, 10), (10, 15), (None, 3)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 4, 10: 10, 15: 10, 20: 10, **{100 + i: 100 for i in range(50)}}


def test_exact_and_index(spark, docs, tmp_path):
    rows = exact.exact_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    assert by[3].keep_id == by[4].keep_id == 4 and by[3].group_size == 2 and not by[3].kept and by[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].keep_id == 1 and not by[None].kept and by[7].group_size == 2 and by[5].kept and by[6].kept
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in DOCS}
    assert sorted(r.text_sha256 for r in rows if r.kept) == sorted(texts)  # exactly one row of a text
    assert exact.exact_duplicates(docs.limit(0)).collect() == []
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    first = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "x"), (4, "y")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact.exact_duplicates(first, index=index).collect()} == {1: 2, 2: 2}
    assert {r.doc_id: r.keep_id for r in exact.exact_duplicates(second, index=index).collect()} == {3: 2, 4: 4}
    index.close()
    again = exact.DigestIndex(spark, f"file://{tmp_path}/index")
    assert again.buckets == 4 and again.entries().count() == 2
    assert {r.doc_id: r.kept for r in exact.exact_duplicates(first, index=again).collect()} == {1: False, 2: True}  # as before
    assert {r.doc_id: r.kept for r in exact.exact_duplicates(second, index=again).collect()} == {3: False, 4: True}
    again.MANY = 1
    assert {r.doc_id: r.kept for r in exact.exact_duplicates(spark.createDataFrame([(i, f"t{i % 30}") for i in range(60)], "doc_id long, text string"), index=again).collect()} == {i: i >= 30 for i in range(60)}
    assert again.generation == 1 and again.entries().count() == 32 and again.buckets == 4
    again.close()
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, f"file://{tmp_path}/index", 5)
    last = exact.DigestIndex(spark, f"file://{tmp_path}/index")
    assert last.generation == 1 and {r.doc_id: r.keep_id for r in exact.exact_duplicates(second, index=last).collect()} == {3: 2, 4: 4}
    last.close()
    tail = "/x" * 50
    names = [exact.DigestIndex(spark, f"file://{tmp_path}/{p}{tail}", 2) for p in "ab"]
    assert names[0].name != names[1].name


def test_mixing(spark, docs):
    rows = mixing.query(spark, SF).collect()
    table = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in rows:
        s = table[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert 0 <= r.taken <= 3 * r.size
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        for s in over or list(free):
            want[s] = 3.0 * sizes[s] if over else left * weight[s] / total
        free -= set(over or free)
        left -= sum(want[s] for s in over)
    assert all(math.isclose(want[s], target[s], rel_tol=1e-9) for s in sizes)
    for r in rows:  # no source is over its target, and none lacks what one of its documents would fill
        lack = target[table[r.doc_id]] - taken[table[r.doc_id]]
        assert lack > -1e-6 and (r.size == 0 or r.copies == 3 or r.size > lack)
    assert sorted(rows) == sorted(mixing.query(spark, SF).collect())
    assert len(mixing.mix(docs).collect()) == len(DOCS)
    assert mixing.mix(docs.limit(0)).collect() == []



def test_mixing_rates(spark):
    """Multipliers against bisection of each source's own equation."""
    rng = np.random.default_rng(11)
    sizes = {s: rng.integers(1, 400, 120) for s in "abcd"} | {"e": np.array([5, 50_000])}
    rows = [(k, s, int(n)) for k, (s, n) in enumerate((s, n) for s, v in sizes.items() for n in v)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "row long, src string, size long")).collect()
    solved = 0
    for r in plan:
        if r.t is None:
            continue
        v = sizes[r.src].astype(float)
        got = lambda t: (v * np.minimum(3.0, np.exp(np.minimum(t * v / v.mean(), 5.0)))).sum()
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if got((lo + hi) / 2) < r.target else (lo, (lo + hi) / 2)
        assert math.isclose(got(r.t), r.target, rel_tol=1e-8) and math.isclose(r.t, lo, rel_tol=1e-5, abs_tol=1e-7)
        solved += 1
    assert solved >= 3


def test_mixing_without_ids(spark):
    """Rows that share an id, or have none, are documents of their own."""
    rows = [(None, "w " * 10, "a") for _ in range(50)] + [(1, "w " * 10, "b") for _ in range(50)] + [(2, "w " * 10, None)] * 10
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        k = (r.doc_id, r.source_size)
        taken[k], target[k] = taken.get(k, 0) + r.taken, r.target
    assert len(got) == len(rows) and all(target[k] - 10 < taken[k] <= target[k] for k in taken)
    assert math.isclose(sum(target.values()), 1100)


def test_numbers_of_rows(spark, tmp_path):
    from streamloom.llm import common

    spark.range(5000).selectExpr("id as doc_id", "id % 3 as _metadata", "cast(id as string) as path").repartition(3).write.parquet(f"{tmp_path}/t")
    for cut in (1000, 10_000_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        df = spark.read.parquet(f"{tmp_path}/t")
        own = {r.n: r.doc_id for r in common.numbered(df.where("doc_id % 2 = 0"), "n").collect()}
        assert len(own) == 2500 and (cut == 1000 or own == seen)
        seen = own
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert common.numbered(spark.range(7), "n").select("n").distinct().count() == 7 and common.numbered(df.limit(0), "n").count() == 0


def test_mixing_fills_the_gap(spark):
    """However long the document that the order stops at, no document is left that fits."""
    sizes = [40_000, 20_000, 10_000] + [1 + i % 7 for i in range(400)]
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(1000 + i, "w " * 50, "c") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1, 2)).collect()
    source, taken, target = {i: s for i, _, s in rows}, {}, {}
    for r in got:
        s = source[r.doc_id]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    for r in got:
        lack = target[source[r.doc_id]] - taken[source[r.doc_id]]
        assert lack > -1e-6 and r.taken == r.copies * r.size and (r.size == 0 or r.copies == 3 or r.size > lack)


def test_bpe(spark, docs):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, P.PATTERN)
    for text in ["a" * 5000, " " * 9000 + "x", "x " * 40000, "é" * 3000, "!?" * 4000, "　\x1c \n" * 3000, "it's 12 <|endoftext|>", ""]:
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    ids = bpe.encode(docs, path, P.PATTERN)
    rows = ids.collect()
    assert len(rows) == len(DOCS) and all(r.n_tokens == len(r.ids) for r in rows)
    assert sorted(r.decoded for r in bpe.decode(ids.select("doc_id", "ids"), path).collect()) == sorted((t or "").encode() for _, t, _ in DOCS)


def test_bpe_query(spark):
    """The query's rows against the library on its whole table."""
    import public_tokenizers as P

    encoding = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encoding
    got = {r.doc_id: r for r in bpe.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = encoding.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_chat_edges(spark):
    """Null ids, turns, roles and texts, repeated rows, long texts, clashing names, no rows."""
    long = "ab [INST] </s> \\" * 60_000
    rows = [(None, 1, "user", "u"), (None, 2, "assistant", "a"), (1, None, "user", None), (1, 1, None, "x"), (1, 2, "assistant", long), (2, 1, "user", "r"), (2, 1, "user", "r"), (3, 5, "system", "only")]
    df = spark.createDataFrame([(*r, 7, "clash", "log") for r in rows], "conv_id long, turn long, role string, text string, n long, shown string, log string")
    told = lambda d: {r.conv_id: r for r in chat.digests(chat.render(chat.reconstruct(chat.turn_events(d)))).collect()}
    got = told(df)
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[None].turns_sha256 == digest(("user", "u"), ("assistant", "a")) and got[None].loss_chars == 1
    assert got[1].turns_sha256 == digest(("user", ""), ("", "x"), ("assistant", long)) and got[1].loss_chars == len(long)
    assert got[2].n_turns == 2 and got[2].turns_sha256 == digest(("user", "r"), ("user", "r")) and got[2].loss_chars == 0
    assert got[3].n_turns == 1 and len(got) == 4 and told(df.limit(0)) == {}


def test_chat_folds_events(spark):
    events = [(1, 1, "message", 1, "user", "hi </s>"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "wro"), (1, 4, "regenerate", 2, None, ""), (1, 5, "delta", 2, None, "go"), (1, 6, "delta", 2, None, "od <\\s>"), (1, 7, "edit", 1, None, "edited [INST]"), (1, 8, "message", 3, None, "odd"), (1, 9, "message", 4, "tool ✓", "")]
    m = chat.reconstruct(spark.createDataFrame(events, "conv_id long, seq long, kind string, message_id long, role string, text string"))
    shown = chat.render(m)
    back = shown.select("formatted", chat.read_back("formatted").alias("t")).first()
    assert [(t.role, t.text) for t in back.t] == [("user", "edited [INST]"), ("assistant", "good <\\s>"), ("", "odd"), ("tool ✓", "")]
    r = chat.digests(shown).first()
    assert r.loss_sha256 == hashlib.sha256(b"good <\\s>").hexdigest() and r.loss_chars == 9


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = duck.execute(registry.SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*cols).collect()), key=str) == sorted(got.fetchall(), key=str)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 12))
    for i in range(40, 80):
        x[i] = x[i % 7] + rng.normal(size=12) * 0.2
    x[100] = x[99]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [None] * 12, [1.0] * 3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200 + i, b) for i, b in enumerate(bad)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    assert {i: got[i].n_links for i in range(120)} == {i: int(near[i].sum()) - 1 for i in range(120)}
    comp = list(range(120))
    for _ in range(120):
        comp = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(120)]
    assert [got[i].component_id for i in range(120)] == comp
    assert all(got[200 + i].n_links == 0 and got[200 + i].component_id == 200 + i and got[200 + i].kept for i in range(len(bad)))


def test_vectors_of_any_length(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (5, [1.0, 0.0]), (6, [-0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_small_reads_sizes(spark):
    from streamloom.llm import common

    wide = common.written(spark.createDataFrame([(1, "x" * 5000, None)], "id long, `a.b` string, c binary"), "wide")
    hint = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in hint(common.small(wide)) and "merge" in hint(common.small(wide, size=4000)).lower()
    assert "merge" in hint(common.small(wide, rows=0)).lower()


def test_vectors_tiles(spark, monkeypatch):
    """The query against brute force on its whole table; small tiles change nothing."""
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    x = np.array(table.embedding.tolist(), float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    before = {r.vec_id: tuple(r) for r in vectors.query(spark, SF).collect()}
    assert {i: r[1] for i, r in before.items()} == dict(zip(table.vec_id.tolist(), (near.sum(axis=1) - 1).tolist()))
    monkeypatch.setattr(vectors, "TILE", 64 * 40)
    assert {r.vec_id: tuple(r) for r in vectors.query(spark, SF).collect()} == before


def test_vectors_edges(spark):
    """Null and repeated ids, repeated rows, clashing names, no rows."""
    rows = [(None, [1.0, 0.0], 1, 1), (None, [1.0, 0.0], 1, 1), (5, [1.0, 0.01], 2, 2), (5, [1.0, 0.01], 2, 2), (5, [0.0, 1.0], 3, 3), (7, [0.01, 1.0], 3, 3), (8, [1.0], 0, 0), (9, [-1.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, dim long")
    got = sorted(vectors.near_vectors(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.n_links))
    want = [(5, 1, 5, True)] * 3 + [(7, 1, 5, False), (8, 0, 8, True), (9, 0, 9, True)] + [(None, 0, None, True)] * 2
    assert [tuple(r) for r in got] == want, got
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_vectors_prune(spark):
    """On vectors without clusters few pairs are left for block distances, and no close pair is lost."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x[3900:] = x[:100] + rng.normal(size=(100, 64)).astype(np.float32) * rng.uniform(0.1, 0.36, (100, 1)).astype(np.float32)
    u = vectors.unit(x.astype(float))
    close = {(i, j) for i, j in np.argwhere(np.triu(u @ u.T >= 0.95, 1)).tolist()}
    space = vectors.Space(64, 0.95, 3, vectors.axes_of(x[:1000].tolist())[64])
    y, seen, tested = space.coordinates(x), set(), 0
    assert sum(len(rows) for _, _, rows, _ in space.stays(y)) < 4 * len(x)
    for b in range(3):
        for p, q in vectors.candidates(y[:, space.part(b)], space.limit[b]):
            tested += len(p)
            diff = y[p, space.part(b)].astype(np.int64) - y[q, space.part(b)]
            fits = (diff * diff).sum(axis=1) <= space.limit[b]
            seen |= set(zip(np.minimum(p, q)[fits].tolist(), np.maximum(p, q)[fits].tolist()))
    assert 20 < len(close) and close <= seen and tested < 0.1 * len(x) ** 2 / 2


PAGE = "<html><head><title>t</title></head><body><div class=nav>menu</div><div class='wrap'><div class='text'><h1>{0}</h1><p>{0} &amp; body<p>second <b>{0}</b>  line</div><div class='box'>read our terms</div></div><div id=comments><p>me too {0}</div></body></html>"


def test_wrapper(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"word{i} " * (i + 2))) for i in range(6)] + [(10, None, None), (11, "http://[bad", "a &lt; b <p>c"), (12, "http://x/", "<article><p>one<script>no</script><footer>f</footer></article><p>two")]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    w = "word3 word3 word3 word3 word3"
    assert got[3] == f"{w}\n{w} & body\nsecond {w} line"
    assert got[10] == "" and got[11] == "a < b\nc" and got[12] == "one"


def test_wrapper_keeps_varying_siblings(spark):
    """The root holds all varying text, not most of it."""
    page = "<body><div class=top>Site</div><div class=main><h1>title{0}</h1><div class=lead>lead{0}</div><div class=text>{1}</div></div></body>"
    rows = [(i, "http://h.example/", page.format(i, f"word{i} " * 50)) for i in range(6)]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join([f"title{i}", f"lead{i}", " ".join([f"word{i}"] * 50)]) for i in range(6))


def test_wrapper_drops_by_text(spark):
    """A template's path doesn't drop other text, neither in a later container nor on another page."""
    page = "<body><article><div>{1}</div><ul><li>x{0}</ul><div>own text {0}</div></article></body>"
    rows = [(i, "http://h.example/", page.format(i, "Fixed notice")) for i in range(19)] + [(19, "http://h.example/", page.format(19, "other"))]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"x{i}\nown text {i}" for i in range(19)) and got[19] == "other\nx19\nown text 19"


def texts_of(spark, pages, host="http://h.example/"):
    rows = [(i, host, p, "clash", 1) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host string, size int")).collect()}


def test_wrapper_decides(spark):
    """Neutral tags and names: only the wrapper tells template from content, and links from text."""
    page = "<body><div class=a>Welcome to us</div><div class=b><a href=/{0}>to {0}</a> <a href=/x{0}>also {0}</a></div><div class=c><h1>title {0}</h1><p>{1}</p><div class=e>Read our terms</div></div><div class=d>All rights</div></body>"
    pages = [page.format(i, f"word{i} " * 30) for i in range(6)]
    want = {i: f"title {i}\n" + " ".join([f"word{i}"] * 30) for i in range(6)}
    got = texts_of(spark, pages)
    assert got == want and all(wrapper.main_text(p, None, [], []) != want[i] for i, p in enumerate(pages))


def test_wrapper_overrules_names(spark):
    """Most of the host's text is in an element whose name says that it isn't content."""
    page = "<body><div class=top>Site</div><div class='widget main'><h1>title{0}</h1><p>{1}</div><div class=comments>nice {0}</div></body>"
    pages = [page.format(i, f"word{i} " * 40) for i in range(5)]
    got = texts_of(spark, pages)
    assert got == {i: f"title{i}\n" + " ".join([f"word{i}"] * 40) for i in range(5)}
    assert wrapper.main_text(pages[0], None, [], []) == "Site"


def test_wrapper_reference(spark):
    """Empty pages and those of another layout aren't the reference; copies of it are no evidence of a template."""
    page = "<body><div class=top>Site</div><div class=c><div class=x>{0} one</div><section>{0} two</section></div></body>"
    got = texts_of(spark, [None, "<p>odd", *(page.format(f"word{i} " * 9) for i in range(5))])
    assert got[0] == "" and got[1] == "odd" and got[4] == " ".join(["word2"] * 9) + " one\n" + " ".join(["word2"] * 9) + " two"
    same = "<body><article><div>{0}</div><p>{1}</article></body>"
    got = texts_of(spark, [same.format("long text " * 30, f"v{i}") for i in range(2)])
    assert got[1] == " ".join(["long text"] * 30) + "\nv1"


def test_wrapper_tables_and_time(spark):
    assert wrapper.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    import time

    began = time.time()
    for bad in ("<" + "x" * 10**6, "<a " * 300_000, "<a '" * 200_000 + ">", '<a ">" ' * 60_000, "<!--" * 200_000, "<script>x" * 100_000, "<p title='" + "x>" * 300_000):
        wrapper.main_text(bad, ["#"], [], [])
        wrapper.skeleton(bad)
        warc.plain_text(bad)
    assert time.time() - began < 60
    assert wrapper.main_text("a<p title='x>y'>b</p><!-- c", None, [], []) == "a\nb"


def test_simple_tree_matching():
    a, b = ("r", (("x", ()), ("y", (("z", ()),)), ("w", ()))), ("r", (("y", (("z", ()), ("q", ()))), ("w", ())))
    n, pairs = wrapper.match(a, b)
    assert n == 4 and ((1,), (0,)) in pairs and ((1, 0), (0, 0)) in pairs and ((2,), (1,)) in pairs


def test_wrapper_deep_markup(spark):
    deep = ["<body>" + "<div>" * 3000 + "hello" + "</div>" * 3000, "<p>" + "<b>" * 5000 + "x", "<ul>" + "<li>a<ul>" * 900]
    rows = [(i, "http://deep/", h) for i, h in enumerate(deep * 2)]
    got = {r.page_id: r.text for r in wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].replace("\n", "") for i in range(3)] == ["hello", "x", "a" * 900]


def test_warc_round_trip(spark):
    page = "<p>a &amp; b</p><script>x</script>é<br>c"
    (headers, block), = warc.parse(warc.response("http://u/", page, "2024-01-01T00:00:00Z", "1"))
    assert warc.http_parts(block)[2].decode() == page
    pages = spark.createDataFrame([(1, "http://u/", page), (2, None, None)], "page_id long, url string, html string")
    rows = sorted(warc.page_derivatives(pages).collect(), key=lambda r: (r.key, r.warc_type))
    assert [r.warc_type for r in rows] == ["conversion", "metadata"] * 2
    back = list(warc.parse(b"".join(bytes(r.record) for r in rows)))
    assert back[0][1].decode() == "a & b\né\nc" and all(h["warc-refers-to"] == r.refers_to and h["warc-block-digest"] == warc.sha1(b) for (h, b), r in zip(back, rows))
    meta = back[1][1].decode()
    assert f"source-warc-payload-digest: {warc.sha1(page.encode())}" in meta and f"source-warc-record-id: {headers['warc-record-id']}" in meta


def test_warc_codings():
    import gzip
    import zlib

    page = "<p>één</p><p>two</p>".encode()
    packed = gzip.compress(page)
    chunks = b"5;x=1\r\n" + packed[:5] + b"\r\n" + f"{len(packed) - 5:X}\r\n".encode() + packed[5:] + b"\r\n0\r\n\r\n"
    text = lambda head, body: warc.derivatives(warc.Headers([("WARC-Record-ID", "<x>")]), b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)[1][1].decode()
    assert text(b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks) == "één\ntwo"
    assert text(b"Content-Encoding: deflate", zlib.compress(page)) == text(b"Content-Encoding: deflate", zlib.compress(page)[2:-4]) == "één\ntwo"
    assert text(b"Content-Encoding: gzip", page) == text(b"Transfer-Encoding: chunked", page) == "één\ntwo"


def test_warc_sources(spark, tmp_path):
    """Source headers stay as declared; what isn't text has no text; malformed streams have a defined result."""
    import gzip

    def record(kind, block, *more):
        return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{len(block)}>"), *more], block)

    image = record("response", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\x00<p>", ("WARC-Payload-Digest", "md5:abc"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"))
    plain = record("response", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n1 <p> 2\r\n\r\nWARC/1.1 nested")
    info = record("warcinfo", b"x: y")
    cut = info + plain[:-30]
    streams = [(1, image), (2, info + plain), (3, cut), (4, b"junk"), (5, b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, None), (7, b""), (8, gzip.compress(plain)[:-9]), (None, gzip.compress(plain))]
    df = spark.createDataFrame([(*r, "clash") for r in streams], "key long, data binary, record string")
    rows = warc.derive(df, "key", "data").collect()
    kinds = {k: sorted(r.warc_type for r in rows if r.key == k) for k, _ in streams}
    assert kinds == {1: ["metadata"], 2: ["conversion", "metadata"], 3: ["malformed"], 4: ["malformed"], 5: ["malformed"], 6: [], 7: [], 8: ["malformed"], None: ["conversion", "metadata"]}
    meta = {r.key: bytes(r.record).decode() for r in rows if r.warc_type == "metadata"}
    assert all(x in meta[1] for x in ("source-warc-payload-digest: md5:abc", "source-warc-ip-address: 10.0.0.1", "source-warc-concurrent-to: <a>", "source-warc-concurrent-to: <b>", "source-http-content-type: image/png"))
    assert meta[2].count("source-http-set-cookie") == 2 and all(r.error for r in rows if r.warc_type == "malformed")
    assert next(bytes(r.record) for r in rows if r.key == 2 and r.warc_type == "conversion").endswith(b"1 <p> 2\r\n\r\nWARC/1.1 nested\r\n\r\n")
    assert warc.derive(df.limit(0), "key", "data").collect() == []
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, image, plain, image))))
    (tmp_path / "w/b.warc").write_bytes(info + plain + image + info)
    read = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len(read) == 8 and sorted(x for r in read for x in (h["warc-type"] for h, _ in warc.parse(bytes(r.content)))) == ["response"] * 5 + ["warcinfo"] * 3
    assert sorted(len(b) for r in read for _, b in warc.parse(bytes(r.content))) == sorted(len(b) for f in (info, image, plain, image, info, plain, image, info) for _, b in warc.parse(f))


def test_warc_query(spark):
    """The query against a reader of markup of the standard library, on its whole table."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.out.append("\n" if tag in warc.BREAKS else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            self.out.append("\n" if tag in warc.BREAKS else "")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data.replace("\n", " "))

    rows = {(r.page_id, r.warc_type): r for r in warc.query(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == 2 * len(pages)
    for p in pages:
        reader = Reader()
        reader.feed(p.html or "")
        reader.close()
        text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(reader.out).split("\n")) if x)
        own, meta = rows[p.page_id, "conversion"], rows[p.page_id, "metadata"]
        assert own.block_digest == warc.sha1(text.encode()) and own.content_length == len(text.encode()) and own.refers_to == meta.refers_to and own.target_uri == (p.url or "")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len((p.html or '').encode())}\r\n\r\n".encode() + (p.html or "").encode()
        assert own.source_digest == meta.source_digest == warc.sha1(block)


def test_toxicity_learns_and_tolerates():
    rng = np.random.default_rng(2)
    syllables = "ba ko ri tu me sa lo ni pe du".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, marks = [], []
    for i in range(400):
        t = [word() for _ in range(40)]
        if i % 4 == 0:
            t[3], t[20] = ("grumblefink", "snotwhistle")[i % 8 // 4], "vilecrumb"
        texts.append(" ".join(t))
        marks.append(int(i % 4 == 0))
    model = toxicity.train(texts, marks)
    score = lambda t: float(model.probability(np.array([toxicity.worst_two(f := toxicity.tokens(t), dict(zip(f, model.decide(f))))]))[0])
    clean = " ".join(word() for _ in range(30))
    assert score(clean) < 0.5 < score(clean + " grumblefink vilecrumb")
    assert score(clean + " grum*blefink vile-crumb") > 0.5 and score("") < 0.5
    assert score(clean + " v i l e c r u m b and v i l e c r u m b") > 0.5
    assert toxicity.train([], []).decide(["x"]).shape == (1,)


def test_toxicity_table_is_the_kernel():
    """The folded table against the kernel summed directly over landmarks, for an alphabet of any size."""
    rng = np.random.default_rng(8)
    letters = [chr(0x4E00 + i) for i in range(300)] + list("абвгдежзабвгдежз")
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 6)))
    texts = [" ".join([word() for _ in range(30)] + (["злойгад", "一七丁丂"] if i % 3 == 0 else [])) for i in range(150)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(150)])

    def features(w):
        c = ["^", *w, "$"]
        out = {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    out[c[i], c[j], c[k], k - i] = out.get((c[i], c[j], c[k], k - i), 0) + toxicity.GAP ** (k - i - 2)
        norm = math.sqrt(sum(toxicity.GAP ** (2 * (k - i - 2)) for i in range(len(c)) for j in range(i + 1, len(c)) for k in range(j + 1, min(len(c), i + toxicity.SPAN))) + 1e-9)
        flat = {}
        for (a, b, d, _), v in out.items():
            flat[a, b, d] = flat.get((a, b, d), 0) + v
        return flat, norm

    def direct(w):
        f, n = features(w)
        total = model.bias
        for mark, share in model.landmarks:
            g, m = features(mark)
            total += share * sum(v * g.get(k, 0) for k, v in f.items()) / n / m
        return min(3.0, max(toxicity.FLOOR, total))

    tried = ["злойгад", "зл_ойгад".replace("_", "а"), "一七丁丂", word(), word(), texts[0].split()[0]]
    assert np.allclose(model.decide(tried), [direct(w) for w in tried], atol=5e-3)
    assert model.decide(["злойгад"])[0] > 0 > np.median(model.decide([word() for _ in range(50)]))


def test_toxicity_bounds(spark, monkeypatch):
    """The sample's bytes are bounded by whole texts; empty tables have a defined result."""
    docs = spark.createDataFrame([(i, "x" * 100 + " kori") for i in range(30)] + [(30, "y" * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1200)
    seen, original = [], toxicity.arrow_map
    monkeypatch.setattr(toxicity, "arrow_map", lambda df, f, schema: (seen.append([r.text for r in df.collect()]) if f is toxicity._fitter else None) or original(df, f, schema))
    toxicity.fit(docs, labels)
    assert seen[0] and sum(map(len, seen[0])) <= 1200 and set(map(len, seen[0])) == {105}
    empty = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scored(docs.limit(0), empty).collect() == [] and all(0 <= r.score < 0.5 for r in toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).collect())
    with pytest.raises(ValueError):
        toxicity.scored(docs.withColumn("Score", docs.doc_id), empty)


def test_toxicity_words_that_stand_together():
    # each insult stands with another in every text, so a single cover of the texts would leave some out
    rng = np.random.default_rng(4)
    insults = ["grumblefink", "vilecrumb", "snotwhistle", "mudgoblin"]
    texts, marks = [], []
    for i in range(600):
        t = ["".join(rng.choice("ba ko ri tu me sa lo ni pe du".split(), rng.integers(1, 4))) for _ in range(30)]
        if i % 4 == 0:
            a, b = rng.choice(insults, 2, replace=False)
            t[4], t[20] = str(a), str(b)
        texts.append(" ".join(t))
        marks.append(int(i % 4 == 0))
    decided = toxicity.train(texts, marks).decide(insults)
    assert (decided > 0).all(), decided


def test_toxicity_query(spark, docs):
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.scored(docs, toxicity.train(["a b", "bad"], [0, 1])).count() == len(DOCS)


def plain_losses(rows, marked):
    """(n, goal, back, score) of each text by plain counting: every word and bigram, a boundary around each text."""
    texts = [[b"<s>", *lm.words_of(t), b"<s>"] if lm.words_of(t) else [] for t in rows]
    models = []
    for chosen in (texts, [t for t, m in zip(texts, marked) if m]):
        one, two = {}, {}
        for t in chosen:
            for p, w in zip(t, t[1:]):
                one[w], two[p, w] = one.get(w, 0) + 1, two.get((p, w), 0) + 1
        models.append((one, two, sum(one.values())))
    kinds = len(models[0][0])

    def loss(model, t):
        one, two, total = model
        p = lambda a, w: (two.get((a, w), 0) + lm.MU * (one.get(w, 0) + 0.5) / (total + 0.5 * kinds)) / (one.get(a, 0) + lm.MU)
        return -sum(math.log(p(a, w)) for a, w in zip(t, t[1:-1])) / (len(t) - 2) if t else 0.0

    out = [(max(0, len(t) - 2), loss(models[1], t), loss(models[0], t)) for t in texts]
    return [(n, g, b, g - b) for n, g, b in out]


def close(got, want):
    return len(got) == len(want) and all(x[0] == y[0] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(x[1:], y[1:])) for x, y in zip(got, want))


def test_lm(spark, docs, tmp_path):
    """Scores against a plain computation of the same models, in one bucket and in many."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.1, 400) % 1400)) for i in range(40)] + [(40, None), (41, " "), (3, "w1 w2"), (3, "w1 w2"), (None, "w2 w1 w1"), (42, "x " * 30_000)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, target string, shard long").repartition(7)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    goal = spark.createDataFrame([(i,) for i in (*range(1, 30, 2), 1, 42, 3, None)], "doc_id long")
    marked = [i in {*range(1, 30, 2), 42, 3} for i, _ in rows]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_losses([t for _, t in rows], marked)))
    for keys in (1_000_000, 500):
        got = sorted((str(r.doc_id), *r[1:]) for r in lm.cross_entropy_difference(table, goal, bucket_keys=keys).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and close([x[1:] for x in got], [x[1:] for x in want])
    none = lm.cross_entropy_difference(docs, docs.select("doc_id").limit(0)).collect()
    assert len(none) == len(DOCS) and all(r.n_tokens == len(words(dict((i, t) for i, t, _ in DOCS)[r.doc_id])) for r in none)
    assert lm.cross_entropy_difference(docs.limit(0), docs.select("doc_id")).collect() == []


def test_lm_query(spark):
    """The query on its whole tables against plain counting."""
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    want = {r.doc_id: x for r, x in zip(table, plain_losses([r.text for r in table], [r.doc_id in good for r in table]))}
    got = {r.doc_id: tuple(r[1:]) for r in lm.query(spark, SF).collect()}
    assert got.keys() == want.keys() and close([got[i] for i in sorted(got)], [want[i] for i in sorted(want)])


def test_scratch_is_removed(spark, docs):
    import os

    from streamloom.llm import common

    root = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with common.scope():
        assert lm.cross_entropy_difference(docs, docs.select("doc_id").limit(1)).count() == len(DOCS)
    assert set(os.listdir(root)) == before


def test_pipeline_clashes(spark):
    """Null ids, sources and texts, repeated rows, and columns named as the operators name theirs."""
    import corpus_pipeline

    own = ["src", "size", "target", "key", "rate", "base", "slice", "copies", "row", "score", "digest", "kept", "component_id", "last"]
    rows = [(*r[:2], "en", r[2], 0, *(f"{c}{i}" for c in own)) for i, r in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    known = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SF)
            assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= (known if d is docs else set()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(DOCS)


def test_pipeline_rows(spark, tmp_path):
    """Stages drop rows, not ids: of repeated rows one stays, and no text is lost for an id that it shares."""
    import corpus_pipeline

    a, b, x = ("one two three four five six", "seven eight nine ten eleven twelve", "thirteen fourteen")
    rows = [(1, a), (1, b), (2, a), (7, x), (7, x), (None, "alone"), (None, "alone"), (None, b)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{tmp_path}/d")):
        got = [tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()]
        assert sorted(got, key=str) == sorted([(1, b), (2, a), (7, x), (None, "alone")], key=str)
        got = [r.text for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
        assert sorted(got) == sorted([a, b, x, "alone"])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.select("doc_id").distinct().count())
        if name == "exact dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "near dedup":
            comp, _ = brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
            assert all(i == c for i, c in comp.items()) and len(comp) == docs.count()
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == docs.count() and json.dumps(tokens.columns)
