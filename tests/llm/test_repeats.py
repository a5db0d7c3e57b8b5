"""Byte and word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from postlens.llm import chunks, substring_dedup, suffix_dedup

LAST = chunks.LAST_ID


def gone_of(units, width):
    """Which units of each (id, sequence) are covered by a window that a smaller id has as well."""
    first = {}
    for d, x in units:
        for i in range(len(x) - width + 1):
            k = x[i:i + width]
            first[k] = min(first.get(k, LAST), d)
    out = []
    for d, x in units:
        g = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if first[x[i:i + width]] < d:
                g[i:i + width] = True
        out.append(g)
    return out


def spans(g):
    return int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0


def check_bytes(df, width=50, **kw):
    rows = df.collect()
    units = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in rows]
    want = []
    for r, (_, x), g in zip(rows, units, gone_of(units, width), strict=True):
        kept = bytes(np.frombuffer(x, np.uint8)[~g])
        want.append((str(r.doc_id), len(x), int(g.sum()), spans(g), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.dedup(df, width=width, **kw).collect()
    assert all(hashlib.sha256(r.text).hexdigest() == r.kept_sha256 for r in got)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256)
                  for r in got) == sorted(want)
    return got


def check_words(df, width=13, **kw):
    rows = df.collect()
    units = [(LAST if r.doc_id is None else r.doc_id,
              tuple(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()))) for r in rows]
    want = []
    for r, (_, x), g in zip(rows, units, gone_of(units, width), strict=True):
        kept = b" ".join(w for w, gone in zip(x, g, strict=True) if not gone).decode()
        want.append((str(r.doc_id), len(x), int(g.sum()), spans(g), kept))
    got = substring_dedup.dedup(df, width=width, **kw).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, len(r.removed), r.text)
                  for r in got) == sorted(want)
    return got


@pytest.mark.parametrize("check", [check_bytes, check_words])
def test_odd_rows(corpus, check):
    got = check(corpus)
    assert len(got) == corpus.count() and got[0].source == "s" and got[0].score == 9.0


@pytest.mark.parametrize("check", [check_bytes, check_words])
def test_small_chunks(spark, prose, check):
    """Passages shared by many documents, at varied places, over many chunks and ranges."""
    r = random.Random(3)
    shared = [prose(n, n) for n in (9, 14, 20, 60)]
    rows = []
    for i in range(60):
        parts = [prose(r.randint(0, 30), 100 + i), r.choice(shared), prose(r.randint(1, 9), 200 + i),
                 r.choice(shared)]
        rows.append((i * 7 % 61, " ".join(parts)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=500)


@pytest.mark.parametrize("dedup", [suffix_dedup.dedup, substring_dedup.dedup])
def test_no_rows(nothing, dedup):
    out = dedup(nothing)
    assert out.count() == 0 and set(nothing.columns) <= set(out.columns)


def test_other_width(corpus):
    check_bytes(corpus.where("doc_id < 9"), width=30)
    with pytest.raises(ValueError):
        suffix_dedup.dedup(corpus, width=10)


def test_merge_orders_runs():
    r = random.Random(1)
    pool = [bytes(r.choices(b"ab\0", k=r.randint(0, 6))) for _ in range(40)]
    for k in (1, 2, 3, 5, 8):
        runs = [sorted(set(r.sample(pool, r.randint(1, 30)))) for _ in range(k)]
        coded = [suffix_dedup.front_coded(x, 8) for x in runs]
        values, apart = zip(*(suffix_dedup.decoded(chunks.pack(p), chunks.pack(n), t, 8)
                              for p, n, t in coded), strict=True)
        out = [(runs[i][p], same) for i, p, same in suffix_dedup.merged(list(values), list(apart))]
        key = [x.ljust(8, b"\0") + bytes([len(x)]) for x, _ in out]
        assert key == sorted(key) and len(out) == sum(map(len, runs))
        assert [same for _, same in out] == [False, *(a == b for a, b in zip(key, key[1:], strict=False))]


def test_packing_of_keys():
    a = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (chunks.unpack_sorted(chunks.pack_sorted(a)) == a).all()
    assert len(chunks.unpack_sorted(chunks.pack_sorted(a[:0]))) == 0


def test_split_characters(spark):
    df = spark.createDataFrame([("é€".encode()[1:],), (b"ok",), (None,)], "b binary")
    got = [r[0] for r in df.select(suffix_dedup.whole_characters(df.b)).collect()]
    assert got == ["€", "ok", None]
