"""TF-IDF and clusters over the documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.catalog import checks, inputs
from postlens.catalog.registry import query
from postlens.catalog.text_queries import document_tagged
from postlens.operators import roles, terms
from postlens.plans.clustering import RoleClusters, cluster_postings
from postlens.session import stage


def documents_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.texts(spark, sf_dir, "documents").select("doc_id", "text")
    return terms.with_words(docs, F.col("text"), inputs.PROSE_STOPS).select("doc_id", "words")


@query(f"""{checks.DOCUMENT_TAGGED} SELECT posting_id, concat_ws(' ', title, title,
  array_to_string(skills_extracted, ' '), description_clean) AS text FROM t""")
def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = terms.corpus_text(F.col("title"), F.col("skills_extracted"), F.col("description_clean"))
    return document_tagged(spark, sf_dir).select("posting_id", text.alias("text"))


def vocab_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in inputs.PROSE_STOPS)
    return f"""WITH words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text),
    '[\\pL\\pN_]{{2,}}'), lambda w: w NOT IN ({stops})) AS w FROM documents),
  grams AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    FROM words),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
  vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term
    HAVING count(*) >= 3 AND count(*) <= 0.7 * (SELECT count(*) FROM documents)
    ORDER BY cf DESC, term LIMIT 500)"""


@query(f"{vocab_sql()} SELECT * FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_with_words(spark, sf_dir)
    return terms.vocabulary(docs, "doc_id", docs.count())


WEIGHTS = f"""{vocab_sql()},
  w AS (SELECT doc_id, term, tf, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1)
    AS raw FROM tf JOIN vocab USING (term))
  SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight
  FROM w"""


@query(WEIGHTS)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tfidf(documents_with_words(spark, sf_dir), "doc_id") \
        .withColumn("weight", F.round("weight", 6))


@query(f"SELECT doc_id, term, weight FROM ({WEIGHTS})")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(documents_with_words(spark, sf_dir), "words")
    model = terms.fit_terms(docs, "doc_id")
    names = F.split(F.lit("|".join(model.vocabulary)), r"\|")
    cells = model.transform(docs).select(
        "doc_id", F.posexplode(vector_to_array("features")).alias("i", "weight"))
    return cells.filter(F.col("weight") > 0) \
        .select("doc_id", F.get(names, "i").alias("term"), F.round("weight", 6).alias("weight"))


def _clusters(spark: SparkSession, sf_dir: str) -> RoleClusters:
    return cluster_postings(document_tagged(spark, sf_dir), "posting_id",
                            stop_words=inputs.PROSE_STOPS)


# Cluster numbers and centres depend on random starts, so the cluster queries return what must hold of
# any fit: facts about each row, which the check SQL states for the rows that it expects.

@query("SELECT k::INTEGER AS k, true AS scored, true AS winner_is_best FROM range(3, 11) AS t(k)")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _clusters(spark, sf_dir).scores()
    top = scores.agg(F.max(F.struct("silhouette", -F.col("k"))).alias("s")).select("s.*").toDF("s", "k")
    won = F.col("is_best") == (F.col("k") == -top.select("k").scalar())
    return scores.select("k", ((F.col("cost") > 0) & F.col("silhouette").between(-1, 1))
                         .alias("scored"), won.alias("winner_is_best"))


@query("""SELECT count(*) AS postings, true AS converged, true AS centres_are_means, true AS cost_is_sum
  FROM documents""")
def cluster_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning fit against its members, by MLlib's means and by distances in plain expressions."""
    fitted = _clusters(spark, sf_dir)
    best = fitted.sweep.best
    rows = fitted.postings.select("cluster", "features", vector_to_array("features").alias("at"))
    centres = F.array(*(F.lit([float(x) for x in c]) for c in best.clusterCenters()))
    apart = F.aggregate(F.zip_with("at", F.get(centres, F.col("cluster")), lambda x, c: (x - c) * (x - c)),
                        F.lit(0.0), lambda a, x: a + x)
    means = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(apart).alias("cost"),
        vector_to_array(Summarizer.mean(F.col("features"))).alias("mean"))
    furthest = F.array_max(F.zip_with("mean", F.get(centres, F.col("cluster")), lambda x, c: F.abs(x - c)))
    return means.agg(
        F.sum("n").alias("postings"), F.lit(best.converged).alias("converged"),
        (F.max(furthest) < 1e-6).alias("centres_are_means"),
        (F.abs(F.sum("cost") / F.lit(best.cost) - 1) < 1e-6).alias("cost_is_sum"))


@query(f"{checks.DOCUMENT_TAGGED} SELECT posting_id, title, company, true AS at_nearest FROM t")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _clusters(spark, sf_dir)
    centres = [F.lit([float(x) for x in c]) for c in fitted.sweep.best.clusterCenters()]
    at = vector_to_array("features")

    def distance(centre: Column) -> Column:
        return F.aggregate(F.zip_with(at, centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0),
                           lambda a, x: a + x)

    apart = F.array(*map(distance, centres))
    own = F.get(apart, F.col("cluster"))
    return fitted.postings.select("posting_id", "title", "company",
                                  (own <= F.array_min(apart) + 1e-9).alias("at_nearest"))


@query("""SELECT place::INTEGER AS place, true AS in_each_cluster, true AS known, true AS falling
  FROM range(1, 13) AS t(place)""")
def cluster_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _clusters(spark, sf_dir)
    before = F.lag("weight").over(Window.partitionBy("cluster").orderBy("place"))
    rows = fitted.top_terms().withColumn("before", before)
    return rows.groupBy("place").agg(
        (F.count_distinct("cluster") == fitted.sweep.best_k).alias("in_each_cluster"),
        F.every(F.col("term").isin(fitted.terms.vocabulary)).alias("known"),
        F.every(F.coalesce(F.col("before") >= F.col("weight"), F.col("place") == 1)).alias("falling"))


@query("""SELECT count(*) AS postings, true AS in_each_cluster, true AS terms_full, true AS titles_full
  FROM documents""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _clusters(spark, sf_dir)
    return fitted.summary(["posting_id"]).agg(
        F.sum("postings").alias("postings"),
        (F.count(F.lit(1)) == fitted.sweep.best_k).alias("in_each_cluster"),
        F.every(F.size("top_terms") == 12).alias("terms_full"),
        F.every(F.size("titles") == F.least("postings", F.lit(5))).alias("titles_full"))


@query("""SELECT count(*) AS postings, true AS x_centred, true AS y_centred, true AS x_widest,
  true AS labelled FROM documents""")
def cluster_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _clusters(spark, sf_dir).scatter()
    return points.agg(
        F.count(F.lit(1)).alias("postings"),
        (F.abs(F.avg("pca_x")) < 1e-6).alias("x_centred"),
        (F.abs(F.avg("pca_y")) < 1e-6).alias("y_centred"),
        (F.var_samp("pca_x") >= F.var_samp("pca_y")).alias("x_widest"),
        F.every(F.col("cluster_label").contains(F.col("cluster").cast("string"))).alias("labelled"))


@query("""SELECT lang AS cluster, place, title FROM (SELECT lang,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS place,
  split_part(text, chr(10), 1) AS title FROM documents) WHERE place <= 5""")
def sample_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.document_postings(spark, sf_dir).withColumn("cluster", F.col("location"))
    return roles.sample_titles(docs, ["posting_id"])
