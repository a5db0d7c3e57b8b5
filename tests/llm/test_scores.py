"""Language, quality and language-model scores."""

import math
import re
from collections import Counter

import numpy as np
from postlens.llm import language_id, lm_score, quality


def code_length(model_texts, text, order=language_id.ORDER):
    """Prediction by partial matching of one language, spelt out."""
    count = Counter()
    for t in model_texts:
        b = b"\n" * order + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                count[b[i - k:i], b[i:i + 1]] += 1
    after = {}
    for (c, s), n in count.items():
        after.setdefault(c, {})[s] = n

    def cost(c, s):
        known = after.get(c)
        if known is None:
            return cost(c[1:], s) if c else 8.0
        total, kinds = sum(known.values()), len(known)
        if s in known:
            return -math.log2(known[s] / (total + kinds))
        return -math.log2(kinds / (total + kinds)) + (cost(c[1:], s) if c else 8.0)

    b = b"\n" * order + text.encode()
    return sum(cost(b[i - order:i], b[i:i + 1]) for i in range(order, len(b)))


def test_code_lengths(spark, prose):
    train = {"aa": [prose(30, 1), "été 12"], "bb": ["the cat sat on the mat"] * 3 + ["xyz \n q"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in train.items() for t in v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out(docs.doc_id)))
    used = {r.doc_id for r in docs.where(~language_id.held_out(docs.doc_id)).collect()}
    learnt = {k: [t for i, t, x in rows if x == k and i in used] for k in model.langs}
    texts = ["the mat", "", "zz été 漢", prose(8, 1), "q" * 300]
    got = model.lengths(texts)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [code_length(learnt[k], t) for k in model.langs], rtol=1e-5)


def test_no_count_is_cut(spark, prose, monkeypatch):
    # Names that once limited a model; nothing may heed them.
    monkeypatch.setattr(language_id, "NODES", 400, raising=False)
    monkeypatch.setattr(language_id, "LANGUAGES", 3, raising=False)
    monkeypatch.setattr(language_id, "GROUP", 2, raising=False)
    train = {"aa": [prose(300, i) for i in range(9)], "small": ["the cat sat on the mat"] * 4,
             "tiny": ["été à la mer"] * 4, "zz": ["漢字かな交じり文"] * 4, "more": ["zwölf Boxkämpfer"] * 4}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in train.items() for t in v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == sorted(train)
    used = {r.doc_id for r in docs.where(~language_id.held_out(docs.doc_id)).collect()}
    learnt = {k: [t for i, t, x in rows if x == k and i in used] for k in model.langs}
    texts = ["the mat", "", "zz été 漢", prose(8, 1), "la mer zwölf"]
    got = model.lengths(texts)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [code_length(learnt[k], t) for k in model.langs], rtol=1e-5)


def test_languages_of_odd_rows(corpus, nothing):
    model = language_id.train(corpus)
    got = {r.text: r for r in language_id.predicted(corpus, model).collect()}
    assert {got[t].lang_pred for t in (None, "", " \t\n ")} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got["one two"].lang_pred in model.langs
    out = language_id.predicted(corpus, language_id.train(nothing))
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    assert out.columns == [c for c in corpus.columns if c != "score"] + [
        "lang_pred", "score", "bits_per_byte"]
    assert language_id.predicted(nothing, model).count() == 0


def backoff(docs):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in docs.items()}
    c = Counter(tuple(w[i:i + n]) for w in words.values() for n in (1, 2, 3)
                for i in range(len(w) - n + 1))
    total = sum(map(len, words.values()))
    out = {}
    for k, w in words.items():
        s = 0.0
        for i in range(len(w)):
            gram, penalty = tuple(w[max(0, i - 2):i + 1]), 0
            while len(gram) > 1 and c[gram] < 2:
                gram, penalty = gram[1:], penalty + 1
            s += math.log10(c[gram] / (c[gram[:-1]] if len(gram) > 1 else total)) \
                + penalty * math.log10(0.4)
        out[k] = s
    return out


def test_backoff(spark, corpus, nothing):
    rows = [(i, r.text) for i, r in enumerate(corpus.collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = backoff(dict(rows))
    for r in lm_score.scored(docs, chunk_bytes=900).collect():
        assert math.isclose(r.log10_score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9)
        assert r.n_tokens == r.n_trigrams + r.n_bigrams + r.n_unigrams
        assert (r.mean_log10 is None) == (r.n_tokens == 0)
    assert lm_score.scored(corpus).count() == corpus.count()
    assert lm_score.scored(nothing).count() == 0


def test_quality(spark, prose, corpus, nothing):
    good = [(i, prose(60, i, True) + ".", 1) for i in range(120)]
    bad = [(200 + i, " ".join(f"{w}###" for w in prose(50, 500 + i).split()), 0) for i in range(60)]
    bad += [(300 + i, " ".join([prose(1, i)] * 80), 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    out = quality.scored(docs, model)
    right = out.where("predicted = quality").count()
    assert right / docs.count() > 0.97 and model.rules
    assert not any(n in str(out._jdf.queryExecution().executedPlan()) for n in ("Python", "Arrow"))
    odd = quality.scored(corpus, model).collect()
    assert len(odd) == corpus.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.scored(nothing, model).count() == 0
    none = quality.train(docs.select("doc_id", "text"), docs.where("false").select("doc_id", "quality"))
    assert {round(r.score, 3) for r in quality.scored(corpus, none).collect()} == {0.5}
