"""Clean table to the clustered table and its summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.roles import (
    K_RANGE,
    RESTARTS,
    Sweep,
    assign_clusters,
    cluster_summary,
    cluster_terms,
    project_2d,
    sweep_k,
)
from postlens.operators.terms import TermModel, corpus_text, fit_terms, with_word_line
from postlens.session import stage


@dataclass
class RoleClusters:
    """Fitted models and the postings with features and cluster."""

    postings: DataFrame
    terms: TermModel
    sweep: Sweep

    def table(self) -> DataFrame:
        return self.postings.drop("features")

    def scores(self) -> DataFrame:
        return self.sweep.table(self.postings.sparkSession)

    def top_terms(self) -> DataFrame:
        return cluster_terms(self.postings.sparkSession, self.sweep.best, self.terms.vocabulary)

    def summary(self, order: list[str]) -> DataFrame:
        return cluster_summary(self.postings, self.top_terms(), order)

    def scatter(self) -> DataFrame:
        return project_2d(self.postings).select(
            "title", "company", "cluster", "cluster_label", "pca_x", "pca_y")


def cluster_postings(clean: DataFrame, doc: str = "job_id", ks: Iterable[int] = K_RANGE,
                     restarts: int = RESTARTS, stop_words: Sequence[str] | None = None,
                     **features: float) -> RoleClusters:
    """Features, sweep over k, and the cluster of every posting under the best k.

    Words and vectors are staged, so that nothing is tagged or tokenised twice. The winning fit of the
    sweep is used as it is: it has converged, so fitting it again would change nothing.
    """
    text = corpus_text(F.col("title"), F.col("skills_extracted"), F.col("description_clean"))
    worded = stage(with_word_line(clean, text, stop_words), "words")
    model = fit_terms(worded, doc, **features)
    vectors = stage(model.transform(worded).drop("words"), "vectors")
    sweep = sweep_k(vectors, doc, ks, restarts)
    return RoleClusters(assign_clusters(vectors, sweep.best), model, sweep)
