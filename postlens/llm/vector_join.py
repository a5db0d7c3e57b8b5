"""Near copies among vectors: an exact range join in metric space.

Unit vectors with cosine c lie sqrt(2 - 2 c) apart, so a bound on the cosine is a radius. Two steps:

1. Each vector is turned onto fixed random axes and rounded to a byte an axis: its sketch, a quarter of
   it or less. How far a sketch lies from its vector is known, so sketches farther apart than the
   radius and twice the largest such error belong to no link. Each label's sketches are dealt to the
   nearest of its pivots. By the triangle inequality a vector can have partners in another pivot's cell
   only if it lies within reach of the plane between the two pivots; only then is it copied there, and
   of two cells one only sends to the other. A task holds the sketches of a block of a cell and lets its
   guests pass by. Groups of sketches in reach of each other come out, as few edges as join them.
2. Only vectors of such groups move whole, once unless their group is very large; in a group cosines
   are compared in double precision.

So what is copied for each cell in reach is the sketch, and whole vectors move to few places however
many there are. Equal vectors are joined once, by one of them that stands for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.components import components
from postlens.session import stage

COSINE = 0.98
#: Vectors of up to `WIDTH` components for which a label gets one pivot more; of longer ones fewer.
CELL = 1 << 18
WIDTH = 64
#: Most pivots over all labels: what is sent to all tasks is bounded by it.
PIVOTS = 2_048
#: Axes of a sketch, at most, and those of them by which pairs are told apart first.
AXES, FIRST = 256, 18
#: Held rows that lie on the same side of all planes, about, and rows that are held against them in one go.
LEAF, CHUNK = 128, 4_096
#: Components of whole vectors that a task holds of a group.
HELD = 1 << 22
#: Rows of two blocks that are compared in one go, and components that are turned into doubles in one go.
TILE, VALUES = 512, 1 << 20
#: Slack for rounding in the bounds on distances; the cosine itself is compared without. `FUZZ` is that of
#: squares in single precision.
SLACK, FUZZ = 1e-6, 1e-4


def unit(rows) -> np.ndarray:
    x = np.array(rows, np.float64)
    with np.errstate(all="ignore"):
        return x / np.linalg.norm(x, axis=1)[:, None]


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


@lru_cache(maxsize=8)
def axes(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, min(dim, AXES))))[0]


def sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches (a scale and a byte for each axis) and how far they lie from what they stand for."""
    for batch in it:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            some, step = np.flatnonzero(dims == dim), max(1, VALUES // dim)
            for at in (some[i:i + step] for i in range(0, len(some), step)):
                taken = batch.take(pa.array(at))
                # What has no finite norm in doubles is at no place of its own, as in the comparison.
                z = np.nan_to_num(unit(matrix(taken["embedding"])), nan=0.0, posinf=0.0, neginf=0.0) \
                    @ axes(dim)
                most = np.abs(z).max(axis=1)
                scale = np.where(most > 0, most / 127, 1).astype(np.float32)
                q = np.clip(np.rint(z / scale[:, None]), -127, 127).astype(np.int8)
                error = np.linalg.norm(z - q * scale[:, None].astype(np.float64), axis=1)
                packed = np.concatenate([scale.view(np.uint8).reshape(-1, 4), q.view(np.uint8)], axis=1)
                offsets = np.arange(len(at) + 1, dtype=np.int32) * packed.shape[1]
                sketch = pa.Array.from_buffers(pa.binary(), len(at), [
                    None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
                names = [k for k in batch.schema.names if k != "embedding"]
                yield pa.RecordBatch.from_arrays(
                    [*(taken[k] for k in names), sketch, pa.array(error)],
                    names=[*names, "sketch", "error"])


def opened(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scales and bytes of sketches of one length."""
    n = len(sketches)
    flat = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(n, -1)
    return np.ascontiguousarray(flat[:, :4]).view(np.float32)[:, 0], flat[:, 4:].view(np.int8)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a label and a finite vector that is not zero. Vectors of a label are of one length;
    others are joined only with those of their length."""
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)


def for_width(vectors: int, dim: Column | int):
    """As many vectors of `dim` components as take the room of `vectors` of `WIDTH`."""
    if isinstance(dim, int):
        return max(1, vectors * WIDTH // max(WIDTH, dim))
    return F.greatest(F.lit(1), F.floor(F.lit(vectors * WIDTH) / F.greatest(F.lit(WIDTH), dim)))


def pivots(classes: DataFrame, counts: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """The pivots of each label that has several: sketches of its vectors with the smallest hashes."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = F.greatest(for_width(cell, F.col("dim")), F.lit(-(-total // PIVOTS)))
    wanted = counts.where(F.col("count") >= 2 * share) \
        .select("label", "dim", F.floor(F.col("count") / share).alias("k"))
    # At most PIVOTS labels with a share each; their candidates are cut by a hash before the shuffle.
    wanted = {(r.label, r.dim): r.k for r in wanted.collect()}
    if not wanted:
        return {}
    dice = F.pmod(F.xxhash64("h1", "h2"), F.ceil(share / 4))
    out: dict[tuple, list] = {}
    for r in classes.where(dice == 0).select("label", "dim", "sketch") \
            .limit(16 * PIVOTS).toLocalIterator():
        if (r.label, r.dim) in wanted:
            scale, q = opened(pa.array([bytes(r.sketch)], pa.binary()))
            if q.any():
                out.setdefault((r.label, r.dim), []).append((q[0] * scale[0].astype(np.float64)))
    return {k: unit(v[:wanted[k]]) for k, v in out.items() if len(v) > 1}


@lru_cache(maxsize=None)
def sends(cells: int) -> np.ndarray:
    """Which cells (rows) send their vectors to which others: of two one to the other, and each to as
    many as it hears from."""
    ahead = (np.arange(cells)[:, None] - np.arange(cells)) % cells
    return (ahead > 0) & ((2 * ahead < cells) | (
        (2 * ahead == cells) & (np.arange(cells)[:, None] > np.arange(cells))))


def dealt(known: dict[tuple, np.ndarray], parts: dict[tuple, int], reach: float):
    """Each sketch in its own block of its own cell, and as a guest in the blocks in reach that its own
    sends to. `parts`: blocks of cells (label, length, cell) that have several."""
    gaps: dict[tuple, np.ndarray] = {}

    def placed(key: tuple, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Rows, cells, blocks and sides."""
        p, rows, own = known.get(key), np.arange(len(part)), len(part)
        cells, blocks = np.zeros(own, np.int64), np.zeros(own, np.int64)
        if p is not None:
            scale, q = opened(part["sketch"])
            cosines = (q * scale[:, None].astype(np.float64)) @ p.T
            home = cosines.argmax(axis=1)
            # Distance to the plane between two pivots; equal pivots have none, so all are near.
            if key not in gaps:
                gaps[key] = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
            near = cosines[rows, home][:, None] - cosines <= (reach + SLACK) * gaps[key][home] + SLACK
            guests, at = np.nonzero(near & sends(len(p))[home])
            rows, cells = np.concatenate([rows, guests]), np.concatenate([home, at])
            blocks = np.zeros(len(rows), np.int64)
        sides = (np.arange(len(rows)) >= own).astype(np.int64)
        split = {c: n for c in np.unique(cells).tolist() if (n := parts.get((*key, c), 1)) > 1}
        whole = ~np.isin(cells, list(split))
        out = [(rows[whole], cells[whole], blocks[whole], sides[whole])]
        for c, n in split.items():
            held, passing = (rows[(cells == c) & (sides == s)] for s in (0, 1))
            mine = (part["h1"].to_numpy()[held].view(np.uint64) % np.uint64(n)).astype(np.int64)
            out.append((held, np.full(len(held), c), mine, np.zeros(len(held), np.int64)))
            for b in range(n):
                # Guests of a cell go by all its blocks.
                guests = np.concatenate([passing, held[sends(n)[mine, b]]])
                out.append((guests, np.full(len(guests), c), np.full(len(guests), b),
                            np.ones(len(guests), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch["label"].to_pylist(), batch["dim"].to_pylist(), strict=True)):
                places.setdefault(key if key in known or (*key, 0) in parts else (), []).append(i)
            for key, at in places.items():
                step = max(1, VALUES // max(AXES, len(known.get(key, ()))))
                for i in range(0, len(at), step):
                    part = batch.take(pa.array(at[i:i + step]))
                    rows, *place = placed(key, part)
                    yield pa.RecordBatch.from_arrays(
                        [*part.take(pa.array(rows)).columns, *(pa.array(x, pa.int32()) for x in place)],
                        names=[*batch.schema.names, "cell", "block", "side"])

    return run


class Forest:
    """Union-find over the numbers of rows, many pairs at a time."""

    def __init__(self):
        self.above = np.zeros(0, np.int64)

    def grow(self, n: int) -> None:
        self.above = np.concatenate([self.above, np.arange(len(self.above), len(self.above) + n)])

    def top(self, x: np.ndarray) -> np.ndarray:
        y = self.above[x]
        while (z := self.above[y]).size and (z != y).any():
            y = z
        self.above[x] = y
        return y

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which of all pairs of `u` and `v` are not joined yet."""
        return self.top(u)[:, None] != self.top(v)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.top(u), self.top(v)
            u, v = u[u != v], v[u != v]
            np.minimum.at(self.above, np.maximum(u, v), np.minimum(u, v))

    def edges(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest name of each tree and the others of it."""
        root, least = self.top(np.arange(len(names))), names.copy()
        np.minimum.at(least, root, names)
        other = names != least[root]
        return names[other], least[root][other]


class Near:
    """Rows of one block: sketches that are held, and the guests that pass by.

    Held rows are sorted into leaves by the sides of a few planes on which they lie. A row is compared
    with the leaves alone that its distances from those planes leave in reach.
    """

    def __init__(self, reach: float):
        # Half the square of the reach, of which products of sketches are short.
        self.least = np.float32(-(reach ** 2) / 2 - FUZZ)
        self.waiting, self.names, self.leaves, self.forest = [], [], None, Forest()

    def add(self, batch: pa.RecordBatch, hold: bool) -> None:
        rows = (batch["h1"].to_numpy(), *opened(batch["sketch"]))
        if hold:
            self.waiting.append(rows)
        else:
            self.settle()
            self.meet(*rows)

    def settle(self) -> None:
        """Sort the held rows and compare them with each other, once all have come."""
        if not self.waiting:
            return
        names, scale, q = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, depth = [], max(0, min(FIRST, q.shape[1], (len(q) // LEAF).bit_length() - 1))
        self.planes = np.median(self.whole(scale, q[:, :depth]), axis=0)
        sides = self.whole(scale, q[:, :depth]) > self.planes
        at = sides @ (1 << np.arange(depth, dtype=np.int64))
        order = np.argsort(at, kind="stable")
        names, self.scale, self.q, at = names[order], scale[order], q[order], at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        self.leaves = [(k, min(k + TILE, j)) for i, j in pairwise([0, *cuts.tolist(), len(at)])
                       for k in range(i, j, TILE)]
        begins = [i for i, _ in self.leaves]
        # Beside the side of each plane the leaf's other one, and for both the square of what lies beyond.
        self.beyond = np.concatenate([~sides[order][begins], sides[order][begins]], axis=1).T.astype(np.float32)
        first = self.first(self.scale, self.q)
        self.columns = [np.ascontiguousarray(first[i:j, [*range(first.shape[1] - 2), -1, -2]].T)
                        for i, j in self.leaves]
        self.meet(names, self.scale, self.q)

    def meet(self, names: np.ndarray, scales: np.ndarray, bytes: np.ndarray) -> None:
        """Join what is in reach: first by a few axes, then by all of them."""
        begin = len(self.forest.above)
        self.forest.grow(len(names))
        self.names.append(names)
        for k in range(0, len(names), CHUNK):
            to, scale, q = begin + k, scales[k:k + CHUNK], bytes[k:k + CHUNK]
            first = self.first(scale, q)
            off = first[:, :len(self.planes)] - self.planes
            off = np.concatenate([np.maximum(off, 0), np.minimum(off, 0)], axis=1) ** 2
            near = np.ascontiguousarray((off @ self.beyond <= -2 * self.least).T)
            for (i, j), columns, some in zip(self.leaves, self.columns, near, strict=True):
                # Of two held rows the one that was sorted behind looks for the other.
                some = np.flatnonzero(some[max(0, i - to):]) + max(0, i - to) if to < len(self.q) \
                    else np.flatnonzero(some)
                if len(some):
                    short = first[some] @ columns
                    if short.max() >= self.least:
                        v, u = np.nonzero((short >= self.least) & self.forest.apart(some + to, np.arange(i, j)))
                        self.join(u + i, some[v], to, scale, q, short.size)

    def join(self, u: np.ndarray, v: np.ndarray, to: int, scale: np.ndarray, q: np.ndarray, of: int) -> None:
        if len(u) > of >> 6:
            at, u = np.unique(u, return_inverse=True)
            by, v = np.unique(v, return_inverse=True)
            x, y = self.whole(self.scale[at], self.q[at]), self.whole(scale[by], q[by])
            some = (x @ y.T - (x ** 2).sum(axis=1)[:, None] / 2 - (y ** 2).sum(axis=1) / 2)[u, v] >= self.least
            self.forest.join(at[u[some]], by[v[some]] + to)
            return
        step = max(1, VALUES // q.shape[1])
        for k in range(0, len(u), step):
            a, b = u[k:k + step], v[k:k + step]
            gap = self.whole(self.scale[a], self.q[a]) - self.whole(scale[b], q[b])
            some = -np.einsum("ij,ij->i", gap, gap) / 2 >= self.least
            self.forest.join(a[some], b[some] + to)

    @staticmethod
    def whole(scale: np.ndarray, q: np.ndarray) -> np.ndarray:
        return q * scale[:, None]

    @staticmethod
    def first(scale: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first axes, half the square of their length below zero, and a one: with the last two
        exchanged on one side, products are half the square of a distance below zero."""
        x = Near.whole(scale, q[:, :FIRST])
        half = -(x ** 2).sum(axis=1, dtype=np.float32)[:, None] / 2
        return np.concatenate([x, half, np.ones_like(half)], axis=1)

    def found(self) -> pa.RecordBatch:
        self.settle()
        u, v = self.forest.edges(np.concatenate(self.names)) if self.names else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


class Links:
    """Rows of one block of a group: links of whole vectors, how many each has, and as many of them as
    hold the block together."""

    def __init__(self, cosine: float):
        self.cosine, self.forest = cosine, Forest()
        self.held, self.reps, self.links = [], [], []

    def add(self, batch: pa.RecordBatch, hold: bool) -> None:
        step = max(1, VALUES // len(batch["embedding"][0]))
        for i in range(0, len(batch), step):
            self.take(batch.slice(i, step), hold)

    def take(self, batch: pa.RecordBatch, hold: bool) -> None:
        x, reps, copies = matrix(batch["embedding"]), batch["rep"].to_numpy(), batch["copies"].to_numpy()
        new = (len(self.forest.above), unit(x), reps, copies, np.zeros(len(x), np.int64))
        self.forest.grow(len(x))
        self.reps.append(reps)
        self.links.append(new[-1])
        if hold:
            self.held.append(new)
        for other in self.held:
            self.meet(other, new)

    def meet(self, left: tuple, right: tuple) -> None:
        (at, x, mine, copies, links), (to, y, others, weight, counts) = left, right
        for i in range(0, len(x), TILE):
            for j in range(0, len(y), TILE):
                near = x[i:i + TILE] @ y[j:j + TILE].T >= self.cosine
                near &= mine[i:i + TILE][:, None] != others[j:j + TILE]
                if not near.any():
                    continue
                links[i:i + TILE] += near @ weight[j:j + TILE]
                if at != to:
                    counts[j:j + TILE] += copies[i:i + TILE] @ near
                rows, columns = at + i + np.arange(near.shape[0]), to + j + np.arange(near.shape[1])
                u, v = np.nonzero(near & self.forest.apart(rows, columns))
                self.forest.join(rows[u], columns[v])

    def found(self) -> pa.RecordBatch:
        reps, links = np.concatenate(self.reps), np.concatenate(self.links)
        us, vs = self.forest.edges(reps)
        some = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([reps[some], us])),
             pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(vs)]),
             pa.array(np.concatenate([links[some], np.zeros(len(us), np.int64)]))],
            names=["u", "v", "n"])


def by_block(make: Callable, place: list[str]):
    """Task over rows sorted by block (`place`), the held ones (`side` 0) before the guests. However many
    pass by a block, only its held rows stay in memory whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in it:
            if not len(batch):
                continue
            at = np.stack([batch[k].to_numpy() for k in [*place, "side"]])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
            for i, j in pairwise([0, *cuts.tolist(), len(batch)]):
                if (here := tuple(at[:-1, i].tolist())) != last:
                    if block:
                        yield block.found()
                    last, block = here, make()
                block.add(batch.slice(i, j - i), not at[-1, i])
        if block:
            yield block.found()

    return run


def near_copies(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` for each row of `vectors` (vec_id, embedding,
    label).

    Rows link if their labels are equal and their cosine is at least `cosine`, in double precision. A
    null label, or a vector that is null, empty, zero, or holds null or non-finite components, links
    with nothing. `n_links` counts other rows, copies each. Ids are expected to be unique: rows that
    repeat one are placed by their own vectors. A null id comes after all others; its component is
    null if it is alone. An empty table gives an empty one.
    """
    last = F.lit((1 << 63) - 1)
    base = vectors.select(F.coalesce(F.col("vec_id").cast("long"), last).alias("key"), "embedding",
                          "label")
    sound = usable(base).select(
        "key", "label", "embedding", F.size("embedding").alias("dim"),
        F.xxhash64("label", "embedding").alias("h1"),
        F.xxhash64(F.lit(1), "embedding", "label").alias("h2"))
    label = sound.schema["label"].dataType.simpleString()
    # Vectors that are equal give equal sketches.
    classes = stage(sound.mapInArrow(
        sketched, f"key long, label {label}, dim int, h1 long, h2 long, sketch binary, error double")
        .groupBy("h1", "h2").agg(
        F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("sketch").alias("sketch"),
        F.max("error").alias("error")), "classes")
    members = stage(sound.select("key", "h1", "h2").join(
        classes.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).drop("h1", "h2"), "members")
    groups = stage(components(stage(grouped(classes, cosine, cell), "near")), "groups")
    found = stage(linked(sound.select("h1", "h2", "embedding"), classes, groups, cosine), "found")
    links = found.where("v IS NOT NULL").select("u", "v").distinct()
    joined = stage(components(links), "components")
    counts = stage(found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n")), "counts")
    placed = members.join(counts, "rep", "left").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    alone = base.join(usable(base).select("key").distinct(), "key", "left_anti") \
        .select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return placed.unionByName(alone).select(
        F.nullif("key", last).alias("vec_id"), "n_links",
        F.nullif("component", last).alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"))


def grouped(classes: DataFrame, cosine: float, cell: int) -> DataFrame:
    """Step 1: edges (`u`, `v`: first hashes) that hold together whatever sketches are in reach."""
    counts = stage(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("count"),
                                                       F.max("error").alias("error")), "sizes")
    error = counts.agg(F.max("error")).first()[0] or 0.0
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 2 * error + SLACK
    known = pivots(classes, counts, cell)
    rows, label = classes.select("label", "dim", "h1", "sketch"), classes.schema["label"].dataType.simpleString()

    def cells(parts: dict[tuple, int]) -> DataFrame:
        return rows.mapInArrow(dealt(known, parts, reach), f"label {label}, dim int, h1 long, "
                               "sketch binary, cell int, block int, side int")

    # A block has half as many more as a cell should have; cells that have more are few.
    most = for_width(cell + cell // 2, F.col("dim"))
    parts = {}
    if counts.where(F.col("count") > most).limit(1).count():
        sizes = cells({}).where("side = 0").groupBy("label", "dim", "cell").count()
        parts = {(r.label, r.dim, r.cell): r.n for r in sizes.where(F.col("count") > most).select(
            "label", "dim", "cell", F.ceil(F.col("count") / most).alias("n")).collect()}
    return cells(parts).select(F.xxhash64("label", "dim", "cell", "block").alias("slot"), "side", "h1",
                               "sketch") \
        .repartition("slot").sortWithinPartitions("slot", "side") \
        .mapInArrow(by_block(partial(Near, reach), ["slot"]), "u long, v long")


def linked(vectors: DataFrame, classes: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """Step 2: `u` (a class) with `n`, its links, and as many links (`u`, `v`) as hold classes together."""
    whole = classes.join(groups.withColumnRenamed("node", "h1"), "h1").select(
        "h1", "h2", "rep", "copies", "label", "dim", "component", F.xxhash64("dim", "label").alias("of"))
    size = whole.groupBy("component", "of").agg(F.count(F.lit(1)).alias("size"), F.max("dim").alias("dim"))
    blocks = F.ceil(F.col("size") * F.col("dim") / HELD).cast("int")
    large = stage(size.where(F.col("size") * F.col("dim") > HELD).select("component", "of", blocks.alias("blocks")),
                  "large")
    # One row of each class is left before vectors move.
    chosen = whole.drop("label", "dim").join(
        vectors.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")), ["h1", "h2"])
    n, own = F.coalesce("blocks", F.lit(1)), F.pmod(F.col("h2"), F.coalesce("blocks", F.lit(1))).cast("int")
    ahead = F.expr("pmod(own - block, n)")
    return chosen.join(F.broadcast(large), ["component", "of"], "left") \
        .select("component", "of", "rep", "copies", "embedding", n.alias("n"), own.alias("own")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))) \
        .where((ahead == 0) | (2 * ahead < F.col("n")) | (
            (2 * ahead == F.col("n")) & (F.col("own") > F.col("block")))) \
        .select("component", "of", "block", (F.col("own") != F.col("block")).cast("int").alias("side"),
                "rep", "copies", "embedding") \
        .repartition("component", "block").sortWithinPartitions("component", "block", "of", "side") \
        .mapInArrow(by_block(partial(Links, cosine), ["component", "block", "of"]), "u long, v long, n long")
