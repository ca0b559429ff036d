"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length one and halved; k-means on a bounded sample gives one codebook for each half, and
the pairs of centroids form the cells of the index. Every vector stands in the cell of its nearest centroids. A
query visits the cells in the order of their distance (the sum of its squared distances to both centroids),
which two sorted lists and a heap yield one by one (multi-sequence traversal), until the cells visited hold the
target share of true neighbours; that many cells are measured on the sample: neighbours at exactly the least
cosine, in random directions, must fall into the visited cells, and the neighbours that the sample itself holds. Pairs
that meet in a cell are verified in double precision.

The number of centroids follows the table: codebooks are doubled as long as that lowers what a query costs, the
vectors of the visited cells and a fixed price for each visit, both measured on the sample.

Equal vectors of one label are one class before the index is built, so a vector that a third of all rows share
is one entry with a weight. Vectors are compared within a label only; each label's cells are apart. A cell with
very many vectors is spread: its vectors are dealt into blocks by hash and its queries into parts, and each part meets
each block in one task. Pairs stay inside the tasks: what leaves them is, for each vector of a block and part that has
a link, the weight of its links and the smallest vector it is tied to there. A vector that finds another one without
being found by it counts the link for both, which the cells of both tell, so each link counts once on either side.

Only vectors without nulls or non-finite components and with a length over zero, under a label, can link; the
others come back with no link, as their own component. Vectors of different dimensions never link. Repeated rows
of one id are one vertex; with several vectors it gathers the links of each. A null id has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stage
from corpuslens.llm.components import components

LEAST_COSINE = 0.98
#: Centroids of each half that the choice starts from; cells are their pairs.
CENTROIDS = 8
#: Vectors that the codebooks are fitted on, at most; a centroid has at least SHARE of them, so that 1,024 centroids
#: (a million cells for each label) are the most that this sample supports.
SAMPLE = 20_000
SHARE = 16
#: Share of the neighbours that the visited cells must hold: those at exactly the least cosine, and the sample's own.
TARGET_RECALL = 0.999
#: Vectors of one cell that one comparison block holds, about; also the comparisons that cost as much as one visit.
BLOCK = 512
#: Queries that meet a block in one task, about.
PART = 8 * BLOCK


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a random start."""
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([distances(some, centroids).argmin(1) for some in np.array_split(points, len(points) // 4096 + 1)])
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def visits(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells in ascending order of left[i] + right[j]: the multi-sequence traversal."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heappush(heap, (left[a[x]] + right[b[y]], x, y))


class MultiIndex:
    """Two codebooks and the number of cells that a query visits."""

    def __init__(self, sample: np.ndarray, centroids: int, least_cosine: float, target: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.left = kmeans(sample[:, : self.half], centroids, rng)
        self.right = kmeans(sample[:, self.half :], centroids, rng)
        # neighbours at exactly the least cosine, in random directions
        picked = rng.choice(len(sample), min(2000, len(sample)), replace=False)
        probes = sample[picked]
        noise = rng.standard_normal(probes.shape)
        noise -= (noise * probes).sum(1)[:, None] * probes
        length = np.linalg.norm(noise, axis=1)
        noise[length > 0] /= length[length > 0, None]
        near = least_cosine * probes + np.sqrt(1 - least_cosine**2) * noise
        cell, within = self.cells(near), self.cells(sample)
        ranks, met = [], []  # of the cells of the made neighbours, and of the sample's own
        for at in range(0, len(probes), 200):
            some = probes[at : at + 200]
            alike = some @ sample.T >= least_cosine
            alike[np.arange(len(some)), picked[at : at + 200]] = False
            for i, (l, r) in enumerate(zip(*self._both(some))):
                order = (l[:, None] + r[None, :]).ravel()
                ranks.append(int((order < order[cell[at + i]]).sum()))
                cells_of = np.unique(within[alike[i]], return_counts=True)
                met += [(int((order < order[c]).sum()), int(n)) for c, n in zip(*cells_of)]
        rank, count = (np.array(x) for x in zip(*sorted(met))) if met else (np.zeros(1, int), np.ones(1, int))
        own = rank[np.searchsorted(np.cumsum(count), target * count.sum())]
        self.visited = max(int(np.quantile(ranks, target, method="higher")), int(own)) + 1
        filled = np.bincount(within, minlength=len(self.left) * len(self.right))
        #: the share of all vectors that stand in the cells a query visits
        self.reach = float(filled[self.visit(probes[:200])].sum(1).mean() / len(sample))

    def _both(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(vectors[:, : self.half], self.left), distances(vectors[:, self.half :], self.right)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        dl, dr = self._both(vectors)
        return dl.argmin(1) * len(self.right) + dr.argmin(1)

    def visit(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest cells of each vector, one row each."""
        dl, dr = self._both(vectors)
        out = np.empty((len(vectors), min(self.visited, len(self.left) * len(self.right))), np.int64)
        for i in range(len(vectors)):
            for k, (x, y) in zip(range(out.shape[1]), visits(dl[i], dr[i])):
                out[i, k] = x * len(self.right) + y
        return out


def unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def valid(vector: str, label: str):
    """Vectors that can link."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray, vectors: float, centroids: int, least_cosine: float, target: float) -> MultiIndex:
    """The index that makes a query among so many vectors cheapest; codebooks double from `centroids` on."""
    def cost(index: MultiIndex) -> float:
        return index.reach * vectors + BLOCK * index.visited

    best = MultiIndex(sample, centroids, least_cosine, target)
    while 2 * centroids * SHARE <= len(sample):
        centroids *= 2
        index = MultiIndex(sample, centroids, least_cosine, target)
        if cost(index) >= cost(best):
            break
        best = index
    return best


def links(classes: DataFrame, least_cosine: float = LEAST_COSINE, centroids: int = CENTROIDS, target: float = TARGET_RECALL) -> DataFrame:
    """id, others, root of classes (id, label, v, n) that link: weights of classes linked, a class tied to, both in part.

    A class has one row for each block and part in which it has a link: the sum of `others` is the number of vectors
    linked, and rows with root != id are ties whose components are those of all links.
    """
    spark = classes.sparkSession
    out = None
    dims = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    for d in dims:
        part = classes.where(F.size("v") == d)
        sizes = part.groupBy("label").agg(F.count("*").cast("double").alias("c"))
        total, squares = sizes.agg(F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
        # the lowest hashes: at most SAMPLE vectors, the same ones whenever this runs
        hashed = part.select("id", "v", F.xxhash64("id", F.lit(7)).alias("h"))
        few = hashed.where(F.pmod("h", F.lit(max(1, int(total) // (2 * SAMPLE)))) == 0)
        chosen = few.orderBy("h", "id").select("v").limit(SAMPLE).toArrow()
        if not chosen.num_rows:
            chosen = hashed.orderBy("h", "id").select("v").limit(SAMPLE).toArrow()
        # the vectors that one of them can meet, on average: those of its own label
        index = fit(unit(chosen.column(0).combine_chunks()), squares / total, centroids, least_cosine, target) if d > 1 else None
        found = _links(part, index, least_cosine)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else classes.select("id", F.lit(0).cast("bigint").alias("others"), F.col("id").alias("root")).limit(0)


def tied(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 .. count - 1 reaches over the pairs (a, b)."""
    root = np.arange(count)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def matches(asks: dict[str, np.ndarray], held: dict[str, np.ndarray], least_cosine: float) -> pa.RecordBatch | None:
    """Rows id, others, root of the links that some queries find in a block."""
    q, s = np.nonzero(asks["v"] @ held["v"].T >= least_cosine - 1e-9)
    other = asks["id"][q] != held["id"][s]
    q, s = q[other], s[other]
    sure, back = np.zeros(len(q), bool), np.zeros(len(q), bool)
    step = max(1, 4_000_000 // (held["v"].shape[1] + held["ask"].shape[1]))
    for at in range(0, len(q), step):
        x, y = q[at : at + step], s[at : at + step]
        # once more by itself: the sum of a product's terms must not depend on the block
        sure[at : at + step] = (asks["v"][x] * held["v"][y]).sum(1) >= least_cosine
        back[at : at + step] = (held["ask"][y] == asks["cell"][x][:, None]).any(1)
    q, s, back = q[sure], s[sure], back[sure]
    if not len(q):
        return None
    ids, vertex = np.unique(np.r_[asks["id"], held["id"]], return_inverse=True)
    a, b = vertex[: len(asks["id"])][q], vertex[len(asks["id"]) :][s]
    others = np.bincount(a, held["n"][s], len(ids)) + np.bincount(b[~back], asks["n"][q[~back]], len(ids))
    touched = np.union1d(a, b)
    root = tied(len(ids), a, b)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[touched]), pa.array(others[touched].astype(np.int64)), pa.array(ids[root[touched]])], names=["id", "others", "root"])


def _links(classes: DataFrame, index: MultiIndex | None, least_cosine: float) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(batch.column(3)) if batch.num_rows else np.zeros((0, 1))
            cell = index.cells(v) if index is not None and len(v) else np.zeros(len(v), np.int64)
            ask = index.visit(v) if index is not None and len(v) else np.zeros((len(v), 1), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ask.size + 1, ask.shape[1] or 1).astype(np.int32)), pa.array(ask.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell), lists], names=["id", "label", "n", "v", "cell", "ask"])

    kind = classes.schema["v"].dataType.simpleString()
    placed = stage(classes.select("id", F.col("label").cast("string").alias("label"), "n", "v").mapInArrow(
        assign, f"id bigint, label string, n bigint, v {kind}, cell bigint, ask array<bigint>"), "cells")
    # a cell's vectors in blocks of about BLOCK rows, its queries in parts of about PART: each part meets each block once
    visits_of = placed.select("label", F.explode("ask").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("q"))
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("m")).join(visits_of, ["label", "cell"])
    last = sizes.select("label", "cell", (F.ceil(F.col("m") / BLOCK) - 1).cast("int").alias("blocks"), (F.ceil(F.col("q") / PART) - 1).cast("int").alias("parts"))
    dealt = lambda most: F.pmod(F.xxhash64("id"), F.col(most) + 1).cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), F.col(most)))
    stored = placed.join(last, ["label", "cell"]).select(
        "label", "cell", dealt("blocks").alias("block"), each("parts").alias("part"), F.lit(False).alias("asks"), "id", "n", "v", F.col("cell").alias("own"), "ask")
    asked = placed.select("id", "n", "v", "label", F.col("cell").alias("own"), F.explode("ask").alias("cell")).join(last, ["label", "cell"]).select(
        "label", "cell", each("blocks").alias("block"), dealt("parts").alias("part"), F.lit(True).alias("asks"), "id", "n", "v", "own",
        F.lit(None).cast("array<bigint>").alias("ask"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # the block that the queries after it meet
        for batch in batches:
            if not batch.num_rows:
                continue
            label, cell, block, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            change = np.flatnonzero((label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])
                                    | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip(np.r_[0, change].tolist(), np.r_[change, len(label)].tolist()):
                now = (label[lo], cell[lo], block[lo], part[lo])
                if asks[lo] and now != key:
                    continue
                rows = batch.slice(lo, hi - lo)
                got = {"id": rows.column(5).to_numpy(), "n": rows.column(6).to_numpy(), "v": unit(rows.column(7)), "cell": rows.column(8).to_numpy()}
                if not asks[lo]:
                    got["ask"] = rows.column(9).flatten().to_numpy().reshape(hi - lo, -1)
                    held = {name: np.concatenate([held[name], got[name]]) for name in got} if now == key else got
                    key = now
                    continue
                for at in range(0, hi - lo, 2048):
                    found = matches({name: column[at : at + 2048] for name, column in got.items()}, held, least_cosine)
                    if found is not None:
                        yield found

    keys = ["label", "cell", "block", "part"]
    met = stored.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asks")
    return met.mapInArrow(compare, "id bigint, others bigint, root bigint")


def near_duplicates(
    df: DataFrame, least_cosine: float = LEAST_COSINE, centroids: int = CENTROIDS, target: float = TARGET_RECALL,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    rows = rows.withColumn("fine", valid("v", "label") & F.col("id").isNotNull())
    # equal vectors under one label: 0.0 and -0.0 are equal, so that their class is one
    signature = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)
    rows = stage(rows.withColumn("class", F.when(F.col("fine"), F.concat_ws(":", F.col("label").cast("string"), signature))), "vectors")
    grouped = rows.where("fine").groupBy("class").agg(F.min_by(F.struct("id", "label", "v"), "id").alias("r"), F.countDistinct("id").alias("n"))
    classes = stage(grouped.select("class", "r.id", "r.label", "r.v", "n"), "classes")
    found = stage(links(classes, least_cosine, centroids, target), "links")
    linked = found.groupBy("id").agg(F.sum("others").alias("others")).withColumnRenamed("id", "a")
    ties = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    place = classes.join(linked, classes["id"] == linked["a"], "left").join(
        components(ties).withColumnRenamed("id", "vertex"), F.col("id") == F.col("vertex"), "left").select(
        "class", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("id", "class").join(place, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
