"""Spelling variants against a plain version over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from postlens.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    forms, out = {}, []
    for w, n in words.items():
        partners = sorted((-words[v], v) for v in words if near(w, v))
        best = partners[0] if partners and -partners[0][0] >= 10 * n else None
        forms[w] = best and best[1]
        out.append([w, forms[w], None, n, len(partners), best and -best[0]])
    for row in out:
        row[2] = row[0]
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out))


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_odd_rows(spark, corpus, nothing):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    want = plain(rows)
    assert any(len(w[0]) > 255 for w in want) or want is not None
    clashing = corpus.withColumnsRenamed({"score": "word", "n_words": "n", "n_chars": "run"})
    assert found(spelling.variants(clashing)) == want
    assert found(spelling.variants(nothing)) == []


def test_chains_of_forms(spark):
    """abcdefgh <- abcdefgx <- abcdexgx, each ten times rarer, and a tie by code points."""
    texts = [(1, "abcdefgh " * 300), (2, "abcdefgx " * 30), (3, "abcdexgx " * 3), (4, "éclairs " * 20),
             (8, "éclaizs " * 2), (6, "éclaims " * 20), (7, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = found(spelling.variants(docs))
    assert got == plain(texts)
    by = {r[0]: r for r in got}
    assert by["abcdexgx"][1:3] == ("abcdefgx", "abcdefgh") and by["éclaizs"][1] == "éclaims"


@pytest.mark.parametrize("cell_words", [16, 200])
def test_many_cells(spark, cell_words):
    """Words over few and over many letters, short, long and longer than a vector can count."""
    r = random.Random(11)
    words = ["".join(r.choice("acgt") for _ in range(r.choice([7, 8]))) for _ in range(150)]
    words += ["".join(r.choice("estinraélö") for _ in range(r.randrange(7, 12))) for _ in range(150)]
    words += ["a" * 260 + "b" * 300, "a" * 261 + "b" * 300, "a" * 260 + "b" * 301, "e" * 60 + "x", "e" * 61]
    for w in words[:]:
        i = r.randrange(len(w))
        words += [w[:i] + "q" + w[i:], w[:i] + w[i + 1:], w[:i] + "z" + w[i + 1:]]
    texts = [(i, " ".join([w] * r.choice([2, 2, 3, 40]))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = plain(texts)
    assert sum(w[4] for w in want) > 500
    assert found(spelling.variants(docs, cell_words=cell_words)) == want


@pytest.mark.parametrize("pairs", [0, 1 << 18])
@pytest.mark.parametrize("leaf", [1, 24, 10_000])
def test_links_of_a_cell(monkeypatch, pairs, leaf):
    """Letter by letter and by rests, in leaves of any size, each link is found once."""
    monkeypatch.setattr(spelling, "LEAF_PAIRS", pairs)
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.choice([7, 8, 9]))) for _ in range(400)}
                   | {"b" * n for n in (250, 254, 255, 256, 257, 300, 301)}
                   | {"b" * 299 + "c", "b" * 60 + "c" * 3, "b" * 60 + "c" * 4})
    cell = spelling.Cell([w.encode() for w in words], np.ones(len(words), bool))
    got = [tuple(sorted(x)) for u, v in cell.links() for x in zip(u.tolist(), v.tolist(), strict=True)]
    want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if i < j and near(u, v)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_edit():
    for u, v, yes in [(b"abcd", b"abxd", True), (b"abcd", b"abd", True), (b"abcd", b"xabcd", True),
                      (b"abcd", b"abdc", False), (b"abcd", b"ab", False), (b"abcd", b"abcde", True)]:
        assert spelling.one_edit(u, v) == spelling.one_edit(v, u) == yes
