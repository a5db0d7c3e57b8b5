"""Exact copies against a plain version, with pages and keys small enough that every way is taken."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import exact_dedup

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = first and i == keep
            first = first and not kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows(corpus, nothing):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    clashing = corpus.withColumnsRenamed({"score": "keep_id", "n_words": "key", "n_chars": "members"})
    assert found(exact_dedup.copies(clashing)) == plain(rows)
    assert found(exact_dedup.copies(nothing)) == []


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.shiftleft(F.octet_length(c).cast("long"), 61),
                                 lambda c: F.lit(0).cast("long")])
@pytest.mark.parametrize("page_bytes", [300, 4000])
def test_full_buckets_and_chains(spark, key, page_bytes):
    """Buckets that no bit splits, pages folded in rounds, and different texts under one key."""
    r = random.Random(3)
    texts = ["hot"] * 260 + [f"t{r.randrange(150)}" for _ in range(350)] + ["x" * 3000] * 20 + [None, ""]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(5, "hot"), (5, "hot")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = found(exact_dedup.copies(exact_dedup.stage(docs, "rows"), key=key, page_bytes=page_bytes))
    assert got == plain(rows)


def test_directory_doubles():
    cells = np.zeros(16, np.int64)
    cells[[0, 1, 9]] = 60, 50, 500
    d = exact_dedup.plan(cells, 100)
    first = {c: d.bucket(np.array([c << 60], np.uint64).view(np.int64))[0] for c in range(16)}
    assert d.depth == 4 and first[0] != first[1] and first[8] != first[9]
    assert first[2] == first[3] and first[4] == first[7] and first[12] == first[15]
    load = np.bincount([first[c] for c in range(16)], cells)
    assert d.pages[first[9]] == 5 and all(p == 1 or x > 100 for p, x in zip(d.pages, load, strict=True))


def test_rounds_shrink(spark):
    """A text that fills many pages is folded until it has one entry; no page holds all of it."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 100).alias("text"))
    out = exact_dedup.copies(exact_dedup.stage(docs.repartition(40), "rows"), page_bytes=2000)
    assert out.select("keep_id", "group_size").distinct().collect() == [(2999, 3000)]
    assert [r["doc_id"] for r in out.where("kept").collect()] == [2999]
