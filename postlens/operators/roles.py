"""Role clusters: k-means over a range of k, its summary tables, and a 2-D projection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlens.functions.labels import cluster_label

# Clustering settings.
K_RANGE = range(3, 11)
SEED = 42
RESTARTS = 10
TOP_TERMS = 12
SAMPLE_TITLES = 5

# Rows that starts are drawn from, chosen by a hash of the document id; every step covers all rows.
START_ROWS = 4096
# A start stops when its cost falls by less than this share; the best of each k goes on until nothing
# changes any more.
TOLERANCE = 1e-4
# Values are rounded to multiples of this, so that sums are exact whatever the order of the rows, and a
# fit does not depend on how they are partitioned. 8 billion rows fit in 64 bits.
GRID = 2.0 ** -30
# Rows worked on at once.
ROWS = 2048
# Cells are added up one by one where less than one in so many is not zero, else by a product of matrices.
SPARSE = 4
# Tasks whose results are added up in one go.
WIDTH = 64


@dataclass
class Fit:
    """Centres of one k from one start. `sums` and `counts` are those of the members that the last
    step found, in multiples of the grid; `cost` is the sum of squared distances to the centres."""

    k: int
    centres: np.ndarray
    sums: np.ndarray | None = None
    counts: np.ndarray | None = None
    squares: np.ndarray | None = None
    cost: float = float("inf")
    before: float = float("inf")
    steps: int = 0
    converged: bool = False

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802, as in MLlib
        return list(self.centres)


@dataclass
class Sweep:
    """Best fit per k with its silhouette, and the winner (smallest k on a tie)."""

    models: dict[int, Fit]
    scores: dict[int, float]

    @property
    def best_k(self) -> int:
        return max(sorted(self.scores), key=self.scores.__getitem__)

    @property
    def best(self) -> Fit:
        return self.models[self.best_k]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, self.models[k].cost, self.scores[k], k == self.best_k) for k in sorted(self.scores)]
        return spark.createDataFrame(
            rows, "k int, cost double, silhouette double, is_best boolean")


def _cells(features: str) -> list[Column]:
    """Places and values of a vector, sparse or dense."""
    v = F.unwrap_udt(features)
    dense = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return [F.when(F.size(v["values"]) == 0, F.array().cast("array<int>"))
            .otherwise(F.coalesce(v["indices"], dense)).alias("places"), v["values"].alias("values")]


def _matrix(places: pa.Array, values: pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix, on the grid."""
    out = np.zeros((len(places), width))
    rows = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
    out[rows, places.flatten().to_numpy()] = np.rint(values.flatten().to_numpy() / GRID) * GRID
    return out


BLOCKS = "sizes binary, places binary, steps binary"


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Several vectors in one row: how many cells each has, their places, and their values in multiples of
    the grid. A pass then moves them without a look at each cell."""
    for batch in it:
        for at in range(0, len(batch), ROWS):
            places, values = (batch[c].slice(at, ROWS) for c in ("places", "values"))
            sizes = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int32)
            cells = (sizes, places.flatten().to_numpy(), np.rint(values.flatten().to_numpy() / GRID))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                             names=["sizes", "places", "steps"])


def _batches(it: Iterator[pa.RecordBatch], width: int) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows as a matrix on the grid; row, place and multiple of the grid of each cell."""
    for batch in it:
        for row in zip(*batch.columns, strict=True):
            sizes, places, steps = (np.frombuffer(x.as_buffer(), kind) for x, kind in
                                    zip(row, (np.int32, np.int32, np.float64), strict=True))
            out, rows = np.zeros((len(sizes), width)), np.repeat(np.arange(len(sizes)), sizes)
            out[rows, places] = steps * GRID
            yield out, rows, places, steps


def _apart(x: np.ndarray, centres: np.ndarray, square: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, rounded so that ties are ties whatever else is computed along with them.

    They lie in memory centre by centre."""
    apart = (-2 * centres) @ x.T
    apart += (x * x).sum(axis=1) if square is None else square
    apart += (centres * centres).sum(axis=1)[:, None]
    return np.maximum(np.round(apart, 9, out=apart), 0, out=apart).T


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row; the first of those equally near."""
    return _apart(x, centres).argmin(axis=1)


FOUND = "fit int, part int, sums binary, counts binary, squares binary, cost long"


def _added(table: pa.Table) -> pa.Table:
    """One row for several of the same fit."""
    each = {c: sum(np.frombuffer(x, np.int64) for x in table[c].to_pylist()).tobytes()
            for c in ("sums", "counts", "squares")}
    return pa.table({"fit": [table["fit"][0].as_py()], "part": [0], **{c: [v] for c, v in each.items()},
                     "cost": [pc.sum(table["cost"]).as_py()]},
                    schema=pa.schema([("fit", pa.int32()), ("part", pa.int32()), ("sums", pa.binary()),
                                      ("counts", pa.binary()), ("squares", pa.binary()), ("cost", pa.int64())]))


def _step(data: DataFrame, fits: list[Fit], width: int, wide: bool) -> None:
    """Move all centres of all fits to the means of their members, by one pass over the rows."""
    centres = np.vstack([f.centres for f in fits])
    ends = np.cumsum([len(f.centres) for f in fits])
    parts = list(zip((ends - [len(f.centres) for f in fits]).tolist(), ends.tolist(), strict=True))

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape, np.int64)
        counts, squares = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        cost, any_rows = np.zeros(len(parts), np.int64), False
        for x, rows, places, steps in _batches(it, width):
            any_rows, at = True, np.arange(len(x))
            square = (x * x).sum(axis=1)
            apart = _apart(x, centres, square).T
            # fit by fit the nearest centre of every row; the first of those equally near
            own = np.empty((len(parts), len(x)), np.int64)
            for (b, e), to in zip(parts, own, strict=True):
                least = apart[b].copy()
                to[:] = b
                for j in range(b + 1, e):
                    to[apart[j] < least] = j
                    np.minimum(least, apart[j], out=least)
            cost += np.rint(apart[own, at] / GRID).astype(np.int64).sum(axis=1)
            # whole numbers far below 2^53, so these sums are exact, in whatever order
            if len(places) * SPARSE < x.size:
                for (b, e), to in zip(parts, own, strict=True):
                    cells = ((to - b) * width)[rows] + places
                    sums[b:e] += np.bincount(cells, weights=steps, minlength=(e - b) * width) \
                        .reshape(e - b, width).astype(np.int64)
            else:
                members = np.zeros((len(centres), len(x)))
                members[own, at] = 1
                sums += (members @ (x / GRID)).astype(np.int64)
            flat = own.ravel()
            counts += np.bincount(flat, minlength=len(centres))
            squares += np.bincount(flat, weights=np.tile(np.rint(square / GRID), len(parts)),
                                   minlength=len(centres)).astype(np.int64)
        if any_rows:
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId() % WIDTH] * n, pa.int32()),
                 *(pa.array([a[b:e].tobytes() for b, e in parts], pa.binary()) for a in (sums, counts, squares)),
                 pa.array(cost, pa.int64())], names=["fit", "part", "sums", "counts", "squares", "cost"])

    rows = data.mapInArrow(found, FOUND)
    for by in (["fit", "part"], ["fit"]) if wide else (["fit"],):
        rows = rows.groupBy(*by).applyInArrow(lambda table: _added(table), FOUND)
    for r in rows.collect():
        fit = fits[r["fit"]]
        fit.sums, before = np.frombuffer(r["sums"], np.int64).reshape(fit.centres.shape), fit.sums
        fit.counts, fit.squares = (np.frombuffer(r[c], np.int64) for c in ("counts", "squares"))
        fit.before, fit.cost, fit.steps = fit.cost, r["cost"] * GRID, fit.steps + 1
        fit.converged = before is not None and np.array_equal(before, fit.sums)
        if not fit.converged:
            means = fit.sums * GRID / np.maximum(fit.counts, 1)[:, None]
            # a centre without members stays where it is
            fit.centres = np.where(fit.counts[:, None] > 0, means, fit.centres)


def _starts(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows far from each other; fewer if there are not so many different ones."""
    random = np.random.default_rng(seed)
    chosen = [int(random.integers(len(rows)))]
    apart = np.full(len(rows), np.inf)
    while len(chosen) < k:
        apart = np.minimum(apart, np.round(((rows - rows[chosen[-1]]) ** 2).sum(axis=1), 9))
        if not apart.any():
            break
        chosen.append(int(random.choice(len(rows), p=apart / apart.sum())))
    return rows[chosen]


def sweep_k(df: DataFrame, doc: str, ks: Iterable[int] = K_RANGE, restarts: int = RESTARTS,
            seed: int = SEED, max_iter: int = 300, features: str = "features") -> Sweep:
    """Fit every k from several starts, keep the cheapest fit of each k, score it.

    All fits move together: one pass over the rows moves the centres of all of them, and what a task
    sends back grows with the centres and not with its rows. Fits that are done drop out. The best of
    each k goes on until no row changes its cluster, so that each centre is the mean of its members.
    Without rows there is nothing to fit: a ValueError.
    """
    cells = df.select(doc, *_cells(features), F.unwrap_udt(features)["size"].alias("size"))
    data = cells.select("places", "values").mapInArrow(_blocks, BLOCKS).persist()
    try:
        some = cells.orderBy(F.xxhash64(doc), doc).limit(START_ROWS).toArrow()
        if not len(some):
            raise ValueError("no rows to cluster")
        size = some["size"][0].as_py()
        width = size if size is not None else len(some["values"][0])
        rows = _matrix(some["places"].combine_chunks(), some["values"].combine_chunks(), width)
        fits = [Fit(k, _starts(rows, k, seed + i)) for k in ks for i in range(restarts)]
        wide = data.rdd.getNumPartitions() > WIDTH
        left = fits
        while left:
            _step(data, left, width, wide)
            left = [f for f in left if not f.converged and f.steps < max_iter
                    and not f.before - f.cost < TOLERANCE * f.cost]
        best = {}
        for f in fits:
            if f.k not in best or f.cost < best[f.k].cost:
                best[f.k] = f
        left = [f for f in best.values() if not f.converged]
        while left:
            _step(data, left, width, wide)
            left = [f for f in left if not f.converged and f.steps < max_iter]
        scores = _silhouettes(data, best, width)
    finally:
        data.unpersist()
    return Sweep(best, scores)


def _silhouettes(data: DataFrame, fits: dict[int, Fit], width: int) -> dict[int, float]:
    """Mean squared Euclidean silhouette of each fit, by one pass. The mean squared distance to all
    members of a cluster follows from their number, their sum and the sum of their squares."""

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = dict.fromkeys(fits, 0.0), 0
        for x, *_ in _batches(it, width):
            n += len(x)
            for k, f in fits.items():
                held = np.flatnonzero(f.counts)
                own = _nearest(x, f.centres[held])
                size, at = f.counts[held].astype(float), np.arange(len(x))
                square = (x * x).sum(axis=1)
                apart = square[:, None] * size + f.squares[held] * GRID - 2 * x @ (f.sums[held] * GRID).T
                inside = apart[at, own] / np.maximum(size[own] - 1, 1)
                apart /= size
                apart[at, own] = np.inf
                outside = apart.min(axis=1)
                more = np.maximum(inside, outside)
                good = (size[own] > 1) & np.isfinite(outside) & (more > 0)
                total[k] += float(((outside - inside)[good] / more[good]).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values())), pa.array([n] * len(total), pa.int64())],
            names=["k", "total", "n"])

    rows = data.mapInArrow(found, "k int, total double, n long").groupBy("k") \
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    return {r["k"]: round(r["total"] / r["n"], 12) for r in rows}


def assign_clusters(df: DataFrame, model: Fit, features: str = "features") -> DataFrame:
    """Add `cluster`, the number of the nearest centre."""
    centres, width = model.centres, model.centres.shape[1]

    @F.arrow_udf("int")
    def nearest(places: pa.Array, values: pa.Array) -> pa.Array:
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(places), ROWS):
            found.append(_nearest(_matrix(places.slice(at, ROWS), values.slice(at, ROWS), width), centres))
        return pa.array(np.concatenate(found), pa.int32())

    return df.withColumn("cluster", nearest(*_cells(features)))


def cluster_terms(spark: SparkSession, model: Fit, vocabulary: Sequence[str],
                  n: int = TOP_TERMS) -> DataFrame:
    """(cluster, place, term, weight): the n heaviest terms of each centre. k x vocabulary cells."""
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster int, centre array<double>")
    names = spark.createDataFrame(list(enumerate(vocabulary)), "pos int, term string")
    heaviest = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return (
        centres.select("cluster", F.posexplode("centre").alias("pos", "weight"))
        .join(F.broadcast(names), "pos")
        .withColumn("place", F.row_number().over(heaviest)).filter(F.col("place") <= n)
        .select("cluster", "place", "term", "weight")
    )


def sample_titles(df: DataFrame, order: Sequence[str], n: int = SAMPLE_TITLES) -> DataFrame:
    """(cluster, place, title): the first n titles of each cluster in the given order."""
    first = Window.partitionBy("cluster").orderBy(*order)
    return df.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n) \
        .select("cluster", "place", "title")


def cluster_summary(df: DataFrame, terms: DataFrame, order: Sequence[str]) -> DataFrame:
    """(cluster, postings, top_terms, titles). The joined sides hold one row per cluster."""
    sizes = df.groupBy("cluster").agg(F.count("*").alias("postings"))

    def listed(rows: DataFrame, column: str, out: str) -> DataFrame:
        items = F.sort_array(F.collect_list(F.struct("place", column)))
        return rows.groupBy("cluster").agg(F.transform(items, lambda x: x[column]).alias(out))

    return (
        sizes.join(listed(terms, "term", "top_terms"), "cluster", "left")
        .join(listed(sample_titles(df, order), "title", "titles"), "cluster", "left")
        .orderBy("cluster")
    )


def cluster_members(df: DataFrame, cluster: int, order: Sequence[str], n: int = 15) -> DataFrame:
    """The first n postings of one cluster with their skills as text."""
    return (
        df.filter(F.col("cluster") == cluster).orderBy(*order).limit(n)
        .select("title", "company", "location",
                F.array_join("skills_extracted", ", ").alias("skills_extracted"))
    )


def project_2d(df: DataFrame, features: str = "features") -> DataFrame:
    """Add pca_x, pca_y and a cluster label.

    MLlib's PCA does not centre what it projects. Projection is linear, so the projected mean is
    subtracted afterwards and the features stay sparse.
    """
    model = PCA(k=2, inputCol=features, outputCol="_pc").fit(df.select(features))
    mean = df.select(Summarizer.mean(F.col(features)).alias("m")).first()["m"]
    shift = mean.toArray() @ model.pc.toArray()
    at = vector_to_array("_pc")
    return (
        model.transform(df)
        .withColumn("pca_x", at[0] - F.lit(float(shift[0])))
        .withColumn("pca_y", at[1] - F.lit(float(shift[1])))
        .withColumn("cluster_label", cluster_label(F.col("cluster")))
        .drop("_pc")
    )


__all__ = ["K_RANGE", "Sweep", "assign_clusters", "cluster_members", "cluster_summary",
           "cluster_terms", "project_2d", "sample_titles", "sweep_k"]
