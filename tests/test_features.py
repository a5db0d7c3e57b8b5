import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postlens.operators import roles, terms
from postlens.plans.clustering import cluster_postings


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    topics = [["data", "model", "train"], ["cloud", "deploy", "pipeline"], ["sales", "call", "lead"]]
    rows = []
    for i in range(n):
        words = rng.choices(topics[i % 3], k=25) + rng.choices(["work", "team", "x", "the"], k=6)
        rng.shuffle(words)
        rows.append((i, " ".join(words) + f" rare{i}"))
    return spark.createDataFrame(rows, "id long, text string"), rows


def brute(rows, stops, max_terms, min_docs, max_share):
    docs = {}
    for i, text in rows:
        w = [x for x in re.findall(r"\b\w\w+\b", text.lower()) if x not in stops]
        docs[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in docs.values() for t in c)
    cf = sum(docs.values(), Counter())
    n = len(docs)
    kept = sorted((t for t in df if min_docs <= df[t] <= max_share * n), key=lambda t: (-cf[t], t))
    kept = set(kept[:max_terms])
    out = {}
    for i, c in docs.items():
        raw = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in c if t in kept}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(i, t): v / norm for t, v in raw.items()})
    return kept, out


@pytest.mark.parametrize("max_terms", [4, 12, 500])
def test_both_forms_agree_with_brute_force(spark, max_terms):
    df, rows = corpus(spark)
    worded = terms.with_words(df, F.col("text"), ["the"])
    kept, want = brute(rows, {"the"}, max_terms, 3, 0.7)
    table = {(r["id"], r["term"]): r["weight"] for r in
             terms.tfidf(worded, "id", max_terms=max_terms).collect()}
    assert table.keys() == want.keys()
    assert all(math.isclose(table[k], want[k], rel_tol=1e-9) for k in want)

    model = terms.fit_terms(worded, "id", max_terms=max_terms)
    assert set(model.vocabulary) == kept
    for r in model.transform(worded).select("id", vector_to_array("features").alias("v")).collect():
        for term, weight in zip(model.vocabulary, r["v"]):
            assert math.isclose(weight, want.get((r["id"], term), 0.0), abs_tol=1e-9)


def test_words_of_one_bit_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(terms, "WORD_BITS", 32)
    df, rows = corpus(spark)
    worded = terms.with_words(df, F.col("text"), ["the"])
    kept, _ = brute(rows, {"the"}, 12, 3, 0.7)
    assert set(terms.fit_terms(worded, "id", max_terms=12).vocabulary) == kept


def test_word_edges(column):
    got = column(lambda c: terms.all_terms(F.array_distinct(F.split(c, " "))), ["a b", "a", ""])
    assert got == [["a", "b", "a b"], ["a"], [""]]


def test_empty_documents_and_no_vocabulary(spark):
    df = spark.createDataFrame([(1, ""), (2, "one two")], "id long, text string")
    worded = terms.with_words(df, F.col("text"), [])
    assert terms.term_counts(worded, "id", F.col("words")).count() == 2
    assert terms.fit_terms(worded, "id").vocabulary == [""]
    assert terms.tfidf(worded, "id").count() == 0


def test_default_stop_words(spark):
    df = spark.createDataFrame([(1, "the cat and a dog")], "id long, text string")
    assert terms.with_words(df, F.col("text")).first()["words"] == ["cat", "dog"]


def test_clusters(spark):
    df, _ = corpus(spark)
    clean = df.select(F.col("id").cast("string").alias("job_id"), F.lit("").alias("title"),
                      F.lit("c").alias("company"), F.lit(None).cast("string").alias("location"),
                      F.array().cast("array<string>").alias("skills_extracted"),
                      F.col("text").alias("description_clean"))
    found = cluster_postings(clean, ks=range(2, 5), restarts=3, stop_words=["the"])
    scores = found.sweep.scores
    assert set(scores) == {2, 3, 4}
    assert found.sweep.best_k == 3 == max(scores, key=scores.get)
    table = found.table().collect()
    assert len(table) == 60 and {r["cluster"] for r in table} == {0, 1, 2}
    by_topic = {(int(r["job_id"]) % 3, r["cluster"]) for r in table}
    assert len(by_topic) == 3
    summary = found.summary(["job_id"]).collect()
    assert [r["postings"] for r in summary] == [20, 20, 20]
    assert all(len(r["titles"]) == 5 and len(r["top_terms"]) == 12 for r in summary)
    points = found.scatter().agg(
        F.avg("pca_x"), F.avg("pca_y"), F.variance("pca_x"), F.variance("pca_y")).first()
    assert abs(points[0]) < 1e-9 and abs(points[1]) < 1e-9 and points[2] >= points[3] > 0
    assert found.scatter().first()["cluster_label"].startswith("Cluster ")


def test_fit_ignores_input_partitions(spark):
    df, _ = corpus(spark)
    worded = terms.with_words(df, F.col("text"), ["the"])
    vectors = terms.fit_terms(worded, "id").transform(worded)

    def labels(partitions):
        sweep = roles.sweep_k(vectors.repartition(partitions), "id", [3, 4], 2)
        rows = roles.assign_clusters(vectors, sweep.best).select("id", "cluster").collect()
        return sweep.scores, sorted(map(tuple, rows))

    assert labels(1) == labels(8)


def test_tie_goes_to_the_smallest_k():
    assert roles.Sweep({}, {7: 0.5, 4: 0.5, 3: 0.1}).best_k == 4


def test_sweep_against_plain_fits(spark):
    """Converged centres are means of their members, costs and silhouettes are those of MLlib's judge,
    and vectors may be dense, repeated, empty or fewer than clusters."""
    import random

    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors

    r = random.Random(1)
    points = [[r.gauss(3 * (i % 4), 1), r.gauss(-2 * (i % 4), 1), 0.0] for i in range(200)] + [[0.0] * 3] * 5
    rows = [(i, Vectors.dense(p) if i % 2 else Vectors.sparse(3, [(j, x) for j, x in enumerate(p) if x]))
            for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(7)
    sweep = roles.sweep_k(df, "id", [2, 4, 6], 4)
    for k, fit in sweep.models.items():
        labelled = roles.assign_clusters(df, fit)
        own = {x["id"]: x["cluster"] for x in labelled.collect()}
        x = np.array(points)
        apart = ((x[:, None] - fit.centres[None]) ** 2).sum(-1)
        assert fit.converged and all(apart[i, c] <= apart[i].min() + 1e-8 for i, c in own.items())
        for c in range(k):
            assert np.allclose(x[[i for i in own if own[i] == c]].mean(axis=0), fit.centres[c], atol=1e-7)
        assert math.isclose(fit.cost, apart.min(axis=1).sum(), rel_tol=1e-6)
        judge = ClusteringEvaluator(predictionCol="cluster").evaluate(labelled)
        assert math.isclose(sweep.scores[k], judge, rel_tol=1e-6)
    few = spark.createDataFrame([(i, Vectors.dense([float(i % 2), 0.0])) for i in range(6)], ["id", "features"])
    sweep = roles.sweep_k(few, "id", [2, 5], 2)
    assert len(sweep.models[5].centres) == 2 and sweep.best_k == 2
    with pytest.raises(ValueError):
        roles.sweep_k(few.where("id < 0"), "id", [2], 1)


def test_word_lines_give_the_same_as_arrays(spark, monkeypatch):
    """Words as one string: the same words, vocabulary, counts and weights, however texts are sliced."""
    _, rows = corpus(spark)
    odd = [None, "", "a", "  ", "É é ÉTÉ the été_2, naïve x٣٤ the the", "İstanbul ΣΑΣ straße", "…", "one one one two"]
    df = spark.createDataFrame([*rows, *((100 + i, t) for i, t in enumerate(odd))], "id long, text string").repartition(3)
    for size in (terms.SLICE_BYTES, 100):
        monkeypatch.setattr(terms, "SLICE_BYTES", size)
        both = [f(df, F.col("text"), ["the"]) for f in (terms.with_words, terms.with_word_line)]
        arrays, lines = ({r["id"]: r["words"] for r in d.collect()} for d in both)
        assert {i: None if w is None else " ".join(w) for i, w in arrays.items()} == lines
        for n in (12, 500):
            a, b = (terms.fit_terms(d, "id", max_terms=n) for d in both)
            assert a.vocabulary == b.vocabulary and (a.weights == b.weights).all()
            x, y = ({r["id"]: (r["f"], r["c"]) for r in a.transform(d, out="f", counts="c").collect()} for d in both)
            assert x == y and x[100][0].numNonzeros() == 0


def test_vectors_are_those_of_mllib(spark):
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import DenseVector

    df, _ = corpus(spark)
    lines = terms.with_word_line(df, F.col("text"), ["the"])
    model = terms.fit_terms(lines, "id", max_terms=40)
    plain = terms.with_words(df, F.col("text"), ["the"]).withColumn("_terms", terms.all_terms(F.col("words")))
    counted = CountVectorizerModel.from_vocabulary(model.vocabulary, inputCol="_terms", outputCol="c").transform(plain)
    scaled = ElementwiseProduct(scalingVec=DenseVector(model.weights), inputCol="c", outputCol="s").transform(counted)
    want = Normalizer(p=2.0, inputCol="s", outputCol="f").transform(scaled).select("id", "c", "f").collect()
    got = model.transform(lines, out="f", counts="c").select("id", "c", "f").collect()
    assert sorted(got) == sorted(want)


def test_null_words_part_pairs(spark):
    df = spark.createDataFrame([(i, ["aa", None, "bb", "cc"]) for i in range(3)], "id long, words array<string>")
    model = terms.fit_terms(df, "id", max_share=1.0)
    assert set(model.vocabulary) == {"aa", "bb", "cc", "bb cc"}
    assert {r["features"].numNonzeros() for r in model.transform(df).collect()} == {4}
    few = terms.fit_terms(df, "id", max_share=1.0, max_terms=3)
    assert set(few.vocabulary) == {"aa", "bb", "bb cc"}


def test_clustering_moves_words_as_strings(spark, tmp_path, monkeypatch):
    """Arrays of words cost about a microsecond a word wherever they are written or read, tests in the plan
    a walk through the text each; neither may come back into the clustering job."""
    from postlens.catalog import text_queries
    from postlens.plans import clustering

    kinds = {}

    def seen(df, name):
        kinds.setdefault(name, dict(df.dtypes))
        return stage(df, name)

    stage = clustering.stage
    monkeypatch.setattr(clustering, "stage", seen)
    spark.createDataFrame([(i, f"title {i % 3}\nthe data model {i % 3} token", "en", "web", 20) for i in range(30)],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    tagged = text_queries.document_tagged(spark, str(tmp_path))
    assert "RLIKE" not in tagged._jdf.queryExecution().executedPlan().toString()
    found = cluster_postings(tagged, "posting_id", ks=[2], restarts=1, stop_words=["the"])
    assert kinds["words"]["words"] == "string" and found.table().count() == 30


def test_slices_are_all_rows_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "SLICE_BYTES", 100)
    texts = pa.array(["a" * 60, None, "", "b" * 250, "c", "d" * 99], pa.string())
    for column in (texts, pa.array([["w"] * 9, None, [], ["x"] * 30, ["y"]], pa.list_(pa.string()))):
        parts = list(terms._slices(column))
        assert len(parts) > 1 and pa.concat_arrays(parts).equals(column)
    assert list(terms._slices(texts.slice(0, 0))) == []


def test_sums_by_cell_and_by_product_agree(spark, monkeypatch):
    df, _ = corpus(spark)
    vectors = terms.fit_terms(terms.with_word_line(df, F.col("text"), ["the"]), "id")
    vectors = vectors.transform(terms.with_word_line(df, F.col("text"), ["the"])).repartition(3)

    def fits(sparse):
        monkeypatch.setattr(roles, "SPARSE", sparse)
        sweep = roles.sweep_k(vectors, "id", [2, 3, 5], 3)
        return sweep.scores, {k: (f.cost, f.centres.tobytes(), f.squares.tolist()) for k, f in sweep.models.items()}

    assert fits(0) == fits(10 ** 9)


def test_blocks_hold_the_vectors():
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([[0, 2], [], [1]], pa.list_(pa.int32())), pa.array([[0.5, 1.0], [], [-2.0]])], names=["places", "values"])
    blocks = list(roles._blocks(iter([batch])))
    assert [b.num_rows for b in blocks] == [1]
    [(x, *_)] = roles._batches(iter(blocks), 3)
    assert np.array_equal(x, [[0.5, 0, 1.0], [0, 0, 0], [0, -2.0, 0]])
