"""Source divergence against a plain version, and the pointer sort against Python's own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlens.llm import source_audit

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least_docs, top=10):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                 for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted((t for t, d in docs[lang].items() if d >= least_docs), key=lambda t: t.encode())
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        each = {s: shares(n[lang, s]) for s in sources}
        p = each[source]

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        pairs = [(sum(gap(p[t], each[o][t]) for t in kept), o) for o in sources if o != source]
        terms = [(gap(p[t], whole[t]), t) for t in kept if n[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i) for i, (v, item) in enumerate(found, 1)
                    if part == "pair" or i <= top]
    return sorted(out)


def found(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least_docs", [1, 2, 50])
def test_odd_rows(corpus, nothing, least_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in corpus.collect()]
    clashing = corpus.withColumnsRenamed({"score": "term", "n_words": "n", "n_chars": "value"})
    assert found(source_audit.audit(clashing, least_docs)) == plain(rows, least_docs)
    assert found(source_audit.audit(nothing, least_docs)) == []


def test_sources(spark):
    """Sources that lack terms, without any text, one that holds most rows, nulls, and ties."""
    r = random.Random(2)
    words = ["Wald", "WALD", "straße", "Größe", "in", "x1y", "zz", "漢字", "İs", "longerthaneight",
             "longerthaneights", "longerthanei"]
    rows = [(" ".join(r.choices(words[i % 5:], k=r.randrange(1, 30))) if i % 9 else None,
             r.choice(["de", "en", None]), "hot" if i % 3 else r.choice("abcd") if i % 4 else None)
            for i in range(300)]
    rows += [("1 2 3", "de", "digits"), ("", "fr", "empty"), (None, "fr", "nothing"), ("one", "it", "alone")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for least_docs in (1, 10):
        assert found(source_audit.audit(docs, least_docs)) == plain(rows, least_docs)


def test_slices(monkeypatch):
    """However the vocabulary is cut, slices add up to the same; checked on one slice against all pairs."""
    import pyarrow as pa

    r = random.Random(4)
    least = {"a": 3, "b": 5, "c": 2}
    rows = [("x", s, None, p) for s, p in least.items()]
    shares = {(t, s): r.randrange(10, 10**6) for t in "tuvw" for s in least if r.random() < 0.6}
    rows += [("x", s, t, p) for (t, s), p in shares.items()]
    lang, source, term, share = zip(*rows, strict=True)
    out = source_audit.slice_gaps(pa.table({
        "lang": lang, "source": source, "term": pa.array(term, pa.string()), "share": share}))
    got = {(x["source"], x["other"]): x["value"] for x in out.to_pylist()}
    for s in least:
        for o in least:
            if s != o:
                there = [t for t in "tuvw" if (t, s) in shares or (t, o) in shares]
                gap = sum((p - q) ** 2 // (p + q) - (least[s] - least[o]) ** 2 // (least[s] + least[o])
                          for t in there for p, q in [(shares.get((t, s), least[s]), shares.get((t, o), least[o]))])
                assert got.get((s, o), 0) == gap


@pytest.mark.parametrize("seed", range(4))
def test_pointer_sort(seed):
    r = random.Random(seed)
    terms = [bytes(r.choice(b"ab\xff") for _ in range(r.choice([1, 7, 8, 9, 16, 17, 40]))) for _ in range(500)]
    terms += [b"a" * 900] * 3 + [b"a" * 901, b"a" * 8, b"a" * 16]
    data = np.frombuffer(b"\0".join([*terms, bytes(8)]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    order, opens = source_audit.multikey_sort(data, ends - [len(t) for t in terms], ends)
    sorted_terms = [terms[i] for i in order]
    assert sorted_terms == sorted(terms)
    assert opens.tolist() == [i == 0 or t != sorted_terms[i - 1] for i, t in enumerate(sorted_terms)]
