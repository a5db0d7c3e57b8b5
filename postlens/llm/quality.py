"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees of a random forest give conjunctions of thresholds; a logistic model with a lasso penalty
weighs them and drops most. What is left is compiled into one column expression, so scoring is a
narrow pass over the texts in generated code, with no model object and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import stage

#: Most labelled rows to learn from, chosen by a hash of the id; with fewer, all are taken.
TRAIN_ROWS = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.0005

SPACE = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
SYMBOLS = "#$%&*@^~_=+<>{}[]\\/"
DIGITS = "0123456789"

#: condition on a statistic: name, at most (True) or above (False), threshold
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def without(text: Column, chars: str) -> Column:
    """Characters of `text` that are among `chars`, counted."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def statistics(df: DataFrame, text: str) -> DataFrame:
    """The columns of `df` by number (c0, c1, ..., so that none clashes) with a struct `stats` of the
    text's statistics; all are 0 for a text without words."""
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    t = F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit(""))
    words = F.expr(f"filter(split(__t, '{SPACE.replace(chr(92), chr(92) * 2)}'), x -> x <> '')")
    chars = F.greatest(F.length("__t"), F.lit(1)).cast("double")
    n = F.size("__w").cast("double")
    each = F.greatest(n, F.lit(1.0))
    lines = F.split(F.col("__t"), "\\n")
    stats = {
        "words": n,
        "word_length": (F.length("__t") - without(F.col("__t"), " \n\t\r")) / each,
        "distinct_words": F.size(F.array_distinct("__w")) / each,
        "repeated_words": F.expr(
            "size(filter(__w, (x, i) -> i > 0 AND x = __w[i - 1]))") / each,
        "capitals": without(F.col("__t"), CAPITALS) / chars,
        "symbols": without(F.col("__t"), SYMBOLS) / chars,
        "shouts": without(F.col("__t"), "!") / chars,
        "bars": without(F.col("__t"), "|") / chars,
        "digits": without(F.col("__t"), DIGITS) / chars,
        "stops": without(F.col("__t"), ".?") / each,
        "commas": without(F.col("__t"), ",;:") / each,
        "lines": F.size(lines) / each,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }
    made = F.struct(*(c.cast("double").alias(k) for k, c in stats.items()))
    # The generator is a barrier: a filter on the score is not pushed below it, where each condition
    # of each rule would make its statistic anew.
    return numbered.withColumn("__t", t).withColumn("__w", words) \
        .select(*numbered.columns, F.explode_outer(F.array(made)).alias("stats"))


NAMES = ["words", "word_length", "distinct_words", "repeated_words", "capitals", "symbols", "shouts",
         "bars", "digits", "stops", "commas", "lines", "distinct_lines"]


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "stats") -> Column:
        """Probability of label 1."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, stats: str) -> Column:
    out = F.lit(True)
    for name, at_most, limit in rule:
        value = F.col(f"{stats}.{name}")
        out = out & ((value <= limit) if at_most else (value > limit))
    return out


def paths(node, above: dict[tuple[str, bool], float]) -> set[Rule]:
    """The conjunctions that lead from the root to each node, the tightest limit of each kind."""
    found = {tuple(sorted((n, m, v) for (n, m), v in above.items()))} if above else set()
    if node.subtreeDepth() > 0:
        name, limit = NAMES[node.split().featureIndex()], float(node.split().threshold())
        for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
            old = above.get((name, at_most))
            tight = limit if old is None else min(old, limit) if at_most else max(old, limit)
            found |= paths(child, above | {(name, at_most): tight})
    return found


def fit(labelled: DataFrame, label: str = "label") -> RuleModel:
    """Learn from rows with `stats` and `label`. Without both labels the score is the share of 1."""
    rows = labelled.select(F.col(label).cast("double").alias("label"), "stats")
    rows = stage(rows.where("label in (0, 1)"), "labelled")
    ones, total = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not total or ones in (0, total):
        import math

        share = min(max((ones or 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(
        rows.select("label", "stats.*"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=11, featureSubsetStrategy="onethird",
        minInstancesPerNode=5).fit(vectors)
    rules = sorted(set().union(*(paths(t._java_obj.rootNode(), {}) for t in forest.trees)))
    if not rules:
        return RuleModel(0.0, ())
    flags = rows.select("label", *(holds(r, "stats").cast("double").alias(f"r{i}")
                                   for i, r in enumerate(rules)))
    flags = stage(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))],
                                  outputCol="features").transform(flags)
                  .select("label", "features"), "rules")
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60,
                               standardization=False).fit(flags)
    return RuleModel(float(lasso.intercept), tuple(
        (r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
          label: str = "quality", most: int = TRAIN_ROWS) -> RuleModel:
    """Learn from labelled documents that are not held out, at most about `most` of them."""
    usable = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))) \
        .select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    share = min(1.0, most / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded by `most`, give or take the chance of the hash.
    found = docs.select(docs[id].alias("id"), docs[text].alias("text")) \
        .join(F.broadcast(chosen), "id").select("label", "text")
    return fit(statistics(found, "text").withColumnRenamed("c0", "label"))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted`; columns so named are replaced. Null and empty
    texts are scored like any other, by statistics of 0."""
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("score", "predicted")]
    return statistics(docs, text).select(*own, model.score().alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
