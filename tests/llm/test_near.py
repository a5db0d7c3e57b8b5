"""Near copies of texts and vectors against all pairs."""

import random
import re

import numpy as np
from postlens.llm import minhash, vector_join
from postlens.llm.components import components

LAST = (1 << 63) - 1


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def check_texts(df):
    rows = [(LAST if r.doc_id is None else r.doc_id, shingles(r.text)) for r in df.collect()]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i]
             if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots({k for k, _ in rows}, links)
    want = sorted((k, len(s), root[k]) for k, s in rows)
    got = minhash.near_copies(df).collect()
    fill = lambda x: LAST if x is None else x
    assert sorted((fill(r.doc_id), r.n_shingles, fill(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_odd_rows(corpus):
    # The id 2 has two texts.
    check_texts(corpus.where("doc_id IS NULL OR doc_id != 2"))
    assert minhash.near_copies(corpus).count() == corpus.count()


def test_no_rows(nothing):
    assert minhash.near_copies(nothing).count() == 0
    assert minhash.without_near_copies(nothing).columns == nothing.columns


def test_large_group(spark, prose, monkeypatch):
    """A group whose members are near a base, not all near each other, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(5)
    base = prose(60, 9).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    check_texts(spark.createDataFrame(rows, "doc_id long, text string"))


def test_without_near_copies(corpus):
    kept = minhash.without_near_copies(corpus.where("doc_id != 2"))
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15}


def test_overlaps_two_ways(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 3000, 900).astype(np.uint64)) for _ in range(150)]
    at = np.array([(i, j) for i in range(150) for j in range(150)])
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in at[:200]]
    assert minhash.overlaps(sets, sets, at)[:200].tolist() == want
    assert minhash.overlaps(sets, sets, at[:200]).tolist() == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (103, 101), (7, 7)] \
        + [(500, i) for i in range(501, 540)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    root = roots({n for p in links for n in p}, links)
    assert {r.node: r.component for r in got} == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_vectors(df, **kw):
    rows = [(LAST if r.vec_id is None else r.vec_id, r.label, r.embedding) for r in df.collect()]

    def sound(label, v):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = [0] * len(rows), []
    for i, (a, la, x) in enumerate(rows):
        for j, (b, lb, y) in enumerate(rows[:i]):
            if sound(la, x) and sound(lb, y) and la == lb and len(x) == len(y):
                p, q = np.array(x, float), np.array(y, float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98:
                    links.append((a, b))
                    n[i] += 1
                    n[j] += 1
    root = roots({k for k, *_ in rows}, links)
    fill = lambda x: LAST if x is None else x
    got = vector_join.near_copies(df, **kw).collect()
    assert sorted((fill(r.vec_id), r.n_links, fill(r.component_id)) for r in got) == \
        sorted((k, m, root[k]) for (k, *_), m in zip(rows, n, strict=True))


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + r.normal(size=8) * 0.08).astype(float).tolist(), i % 3)
            for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0),
             (203, [0.0] * 8, 0), (204, [1.0, None] + [0.0] * 6, 0), (205, [float("nan")] * 8, 0),
             (206, rows[0][1], None), (207, [], 0), (208, [float("inf")] + [1.0] * 7, 0),
             (None, rows[1][1], 1), (209, [x * 5 for x in rows[0][1]], 0), (210, [1.0, 2.0], 0),
             (211, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    check_vectors(df)
    check_vectors(df, cell=10)
    check_vectors(df.where("vec_id < 0"))
    assert vector_join.near_copies(df.selectExpr("*", "1 AS rep", "2 AS cell")).count() == len(rows)


def clustered(n, dim, seed, spread):
    """Vectors around few directions, some of them side by side along a chain."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(7, dim))
    x = base[r.integers(0, 7, n)] + r.normal(size=(n, dim)) * spread
    x[:20] = base[0] + np.arange(20)[:, None] * base[1] * 0.1
    return x


def test_vectors_in_many_blocks(spark, monkeypatch):
    """Cells of several blocks, groups of several blocks, and vectors longer than a sketch."""
    monkeypatch.setattr(vector_join, "HELD", 100)
    rows = [(i, v.tolist(), "ab"[i % 5 == 0]) for i, v in enumerate(clustered(240, 9, 4, 0.07))]
    rows += [(1000 + i, v.tolist(), "a") for i, v in enumerate(clustered(40, 300, 5, 0.07))]
    rows += [(2000, rows[3][1], "b"), (2001, rows[3][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    check_vectors(df, cell=4)
    check_vectors(df)


def test_vectors_move_to_few_places(spark):
    """What is staged does not grow with the cells or blocks that a vector's neighbours may lie in."""
    from postlens import session

    n, dim = 20_000, 64
    x = np.random.default_rng(6).normal(size=(n, dim)).astype(np.float32)
    x[1::100] = x[::100] + np.float32(0.01)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())],
                               "vec_id long, embedding array<float>, label int")
    app = spark.sparkContext.applicationId
    before = len(session._STAGED.get(app, []))
    got = vector_join.near_copies(df).agg({"n_links": "sum"}).first()[0]
    staged = sum(sum(session.files_under(spark, p).values()) for p in session._STAGED[app][before:])
    assert got == 2 * n // 100
    assert staged < 1.5 * 4 * n * dim


def test_cells_send_one_way():
    for n in (1, 2, 3, 8, 9):
        sends = vector_join.sends(n)
        assert (sends ^ sends.T == ~np.eye(n, dtype=bool)).all()
        assert sends.sum(axis=0).max() <= n // 2


def test_sketches_in_reach(monkeypatch):
    """Whatever links ends in one tree, among held rows and between them and guests; what is far does not."""
    import pyarrow as pa

    monkeypatch.setattr(vector_join, "LEAF", 4)
    monkeypatch.setattr(vector_join, "CHUNK", 32)
    monkeypatch.setattr(vector_join, "TILE", 8)
    for dim, spread in ((3, 0.3), (40, 0.08), (300, 0.08)):
        x = clustered(300, dim, dim, spread)
        rows = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(300)), pa.array(x.tolist()), pa.array(np.full(300, dim, np.int32))],
            names=["h1", "embedding", "dim"])
        sketches = list(vector_join.sketched(iter([rows])))
        assert sum(map(len, sketches)) == 300
        error = max(b["error"].to_numpy().max() for b in sketches)
        one = pa.Table.from_batches(sketches).combine_chunks().to_batches()[0]
        turned = vector_join.unit(x) @ vector_join.axes(dim)
        scale, q = vector_join.opened(one["sketch"])
        assert np.linalg.norm(turned - q * scale[:, None], axis=1).max() <= error + 1e-6
        near = vector_join.Near(0.2 + 2 * error)
        for i, j, hold in ((0, 90, True), (90, 200, True), (200, 230, False), (230, 300, False)):
            near.add(one.slice(i, j - i), hold)
        found = near.found()
        root = roots(set(range(300)), list(zip(found["u"].to_pylist(), found["v"].to_pylist())))
        y = vector_join.unit(x)
        cosines = y @ y.T
        linked = np.argwhere(cosines[:200] >= 0.98).tolist()
        assert sum(i != j for i, j in linked) > 20
        assert all(root[i] == root[j] for i, j in linked)
        assert dim == 3 or len(set(root.values())) > 5
        # Guests are held against held rows only.
        alone = [i for i in range(200, 300) if cosines[i, :200].max() < 0.8]
        assert dim == 300 or all(root[i] == i for i in alone)


def test_slices_by_bytes():
    """Slices follow the bytes of the texts and need no copy of them; nulls have none."""
    import pyarrow as pa
    from postlens.llm import decontaminate

    texts = ["é" * 300, None, "", "x" * 5000, "y" * 500, "z" * 10] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(18)), pa.array(texts)], names=["key", "text"])
    parts = list(minhash.sliced(iter([batch]), 1000))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) < 6000 for p in parts)
    assert max(minhash.SLICE_BYTES, decontaminate.SLICE_BYTES) <= 1 << 20
