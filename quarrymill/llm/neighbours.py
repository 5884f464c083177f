"""Operator 2: approximate nearest neighbours of a set of query vectors, by a hierarchical k-means tree over all vectors.

The tree grows level by level until its leaves hold about LEAF vectors, or more where there would be over MOST_LEAVES of
them otherwise: so what the driver and the workers hold of the tree is bounded. Each level clusters, in one task per node,
a sample of that node's vectors whose size depends on the node's children alone; every vector is then put into its leaf. A
query walks the tree best bin first: a priority queue of nodes by the distance of their centroid yields leaves, nearest
first. How many leaves are visited is calibrated: for PROBES of the queries the true neighbours are found by brute force
over all vectors, and visits widen until these queries find RECALL of them; all queries then visit that many.

Leaves in a row of the tree make cells of about CELL vectors; a query goes once to each cell that has any leaf it visits,
with the list of these, in one shuffle by cell. A cell that many queries come to is shared by several tasks.

Distances are cosine distances rounded to six places, so that copies tie; the lesser id wins a tie. Equal vectors are
held once; a leaf holds each vector with its k + 1 least ids, which is all that a list of k neighbours can take.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, LEAF, BRANCH, PER_CHILD, PROBES, RECALL, CELL = 10, 256, 32, 32, 192, 0.96, 8192
#: Queries that one task takes to a cell, about.
ASKED = 50_000
#: Leaves of the largest tree, about.
MOST_LEAVES = 1 << 16


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, seed: int = 0, turns: int = 8) -> np.ndarray:
    """Up to k centroids of the rows of x; none is without a row."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(turns):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        order = np.argsort(of, kind="stable")
        some = np.flatnonzero(n)
        c = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
    return c[np.unique(nearest(x, c))].astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) / 2 - x @ c.T).argmin(1)


class Tree:
    """Nodes in order of creation, children of a node in a row; a node without children is a leaf."""

    def __init__(self, arrays):
        self.centre, self.begin, self.end = (np.asarray(arrays[k]) for k in ("centre", "begin", "end"))
        self.half = (self.centre * self.centre).sum(1) / 2

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at every node."""
        at = np.zeros(len(x), np.int64)
        todo = [0] if len(x) and self.end[0] > self.begin[0] else []
        while todo:
            node = todo.pop()
            rows = np.flatnonzero(at == node) if node else np.arange(len(x))
            if not len(rows):
                continue
            a, b = int(self.begin[node]), int(self.end[node])
            at[rows] = a + (self.half[a:b] - x[rows] @ self.centre[a:b].T).argmin(1)
            todo += [n for n in np.unique(at[rows]).tolist() if self.end[n] > self.begin[n]]
        return at

    def leaves(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            a, b = int(self.begin[node]), int(self.end[node])
            if a == b:
                yield node
                continue
            far = self.half[a:b] - self.centre[a:b] @ q
            for d, n in zip(far.tolist(), range(a, b)):
                heapq.heappush(queue, (d, n))

    def first(self, q: np.ndarray, visits: int) -> list[int]:
        return [leaf for leaf, _ in zip(self.leaves(q), range(visits))]


def length(rows: DataFrame, vector_col: str) -> int:
    """The vectors' most frequent length, of equals the least."""
    v = common.pick(rows, v=vector_col).filter("v IS NOT NULL")
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return size[0] if size and size[0] > 0 else 1


def prepare(rows: DataFrame, id_col: str, vector_col: str, dim: int, ids: str) -> DataFrame:
    """(id, h, vec): unit vectors as bytes, h their hash. Rows without an id or a direction are left out."""

    def unit(batches):
        for batch in batches:
            x = batch.column(1)
            x = (x.flatten() if isinstance(x, pa.ListArray) else pa.array([], pa.float32())).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            vec = (x[good] / norm[good, None]).astype(np.float32) + np.float32(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in vec], pa.binary())], names=["id", "vec"])

    own = common.pick(rows, id=id_col, v=vector_col).select(F.col("id").cast(ids).alias("id"), "v")
    fit = own.filter(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda v: v.isNull()))
    return fit.select("id", F.col("v").cast("array<double>")).mapInArrow(unit, f"id {ids}, vec binary").select("id", F.xxhash64("vec").alias("h"), "vec")


def grow(vectors: DataFrame, total: int, dim: int, leaf: int, branch: int, per_child: int) -> dict[str, np.ndarray]:
    """vectors: (h, vec), `total` distinct ones, cut from their lineage."""
    centre, begin, end, size = [np.zeros((1, dim), np.float32)], [0], [0], {0: total}
    spark = vectors.sparkSession
    while size := {n: s for n, s in size.items() if s > leaf}:
        tree = {"centre": np.concatenate(centre), "begin": np.array(begin), "end": np.array(end)}
        children = {n: min(branch, -(-2 * int(s) // leaf)) for n, s in size.items()}
        share = {n: min(1.0, per_child * children[n] / s) for n, s in size.items()}
        wanted = np.zeros(len(begin))
        wanted[list(share)] = list(share.values())
        model = common.Model(spark, "tree", tree | {"wanted": wanted})

        def sample(batches, model=model):
            t, wanted = Tree(model), np.asarray(model["wanted"])
            for batch in batches:
                if batch.num_rows:
                    node = t.descend(rows_of(batch.column(1), dim))
                    keep = pa.array(batch.column(2).to_numpy() < wanted[node])
                    yield pa.RecordBatch.from_arrays([pa.array(node).filter(keep), batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["node", "h", "vec"])

        def split(table: pa.Table) -> pa.Table:
            node = table.column("node")[0].as_py()
            order = np.argsort(table.column("h").to_numpy())
            x = rows_of(table.column("vec").combine_chunks(), dim)[order]
            c = kmeans(x, children[node], node)
            n = np.bincount(nearest(x, c), minlength=len(c))
            return pa.table({"node": pa.array([node] * len(c), pa.int64()), "n": pa.array(n, pa.int64()), "centre": pa.array([r.tobytes() for r in c], pa.binary())})

        place = (F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("place")
        some = vectors.select("h", "vec", place).filter(F.col("place") < max(share.values())).mapInArrow(sample, "node bigint, h bigint, vec binary")
        found: dict[int, list] = {}
        for r in some.groupBy("node").applyInArrow(split, "node bigint, n bigint, centre binary").collect():
            found.setdefault(r.node, []).append((bytes(r.centre), r.n))
        grown: dict[int, float] = {}
        for node in sorted(found):
            parts = sorted(found[node])
            if len(parts) < 2:  # it can't be told apart
                continue
            begin[node], end[node] = len(begin), len(begin) + len(parts)
            centre.append(np.frombuffer(b"".join(c for c, _ in parts), np.float32).reshape(-1, dim))
            for _, n in parts:
                grown[len(begin)] = n / share[node]
                begin.append(0)
                end.append(0)
        size = grown
    return {"centre": np.concatenate(centre), "begin": np.array(begin), "end": np.array(end)}


def best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by distance and id."""
    if len(d) > 4 * k:
        few = np.flatnonzero(d <= np.partition(d, k)[k])
        return few[np.lexsort((ids[few], d[few]))[:k]]
    return np.lexsort((ids, d))[:k]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(1 - (q @ x.T).astype(np.float64), 6) + 0.0


def calibrate(points: DataFrame, queries: DataFrame, tree: dict[str, np.ndarray], cell: np.ndarray, total: int, dim: int, k: int, probes: int, recall: float) -> tuple[int, float]:
    """Leaves to visit for the wanted recall, and how many cells they are in, in the mean; points: (h, vec, id, leaf);
    queries: (h, vec), `total` distinct ones. Truth is by brute force over all points."""
    asked = queries.filter(common.share(F.col("h"), probes, total)).orderBy("h").collect()
    if not asked:
        return 1, 1.0
    q = np.frombuffer(b"".join(bytes(r.vec) for r in asked), np.float32).reshape(-1, dim)
    own = np.array([r.h for r in asked])
    sent = common.Model(points.sparkSession, "probes", {"q": q, "own": own})

    @common.tidied
    def exact(batches):
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            if not batch.num_rows:
                continue
            h, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            d = distances(np.asarray(sent["q"]), rows_of(batch.column(1), dim))
            for i in range(len(d)):
                other = h != sent["own"][i]
                a, b, c = (np.concatenate(x) for x in zip(held[i], (d[i][other], h[other], leaf[other])))
                at = best(a, b, k)
                held[i] = (a[at], b[at], c[at])
        n = [len(x[0]) for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), *(pa.array(np.concatenate([x[j] for x in held])) for j in range(3))], names=["probe", "d", "h", "leaf"])

    w = Window.partitionBy("probe").orderBy("d", "h")
    truth = points.select("h", "vec", "leaf").mapInArrow(exact, "probe bigint, d double, h bigint, leaf bigint").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("probe", "leaf").collect()
    t = Tree(tree)
    missing = [{} for _ in asked]
    for r in truth:
        missing[r.probe][r.leaf] = missing[r.probe].get(r.leaf, 0) + 1
    found, visits, walks, cells = 0, 0, [t.leaves(x) for x in q], [set() for _ in asked]
    while found < recall * len(truth) or not visits:
        visits += 1
        for i, walk in enumerate(walks):
            if (leaf := next(walk, -1)) >= 0:
                found += missing[i].get(leaf, 0)
                cells[i].add(int(cell[leaf]))
    return visits, float(np.mean([len(c) for c in cells]))


def cells_of(tree: dict[str, np.ndarray], sizes: dict[int, int], most: int) -> np.ndarray:
    """The cell of each leaf (-1 for other nodes): leaves in the tree's order, as many as make about `most` points."""
    out, todo, held = np.full(len(tree["begin"]), -1, np.int64), [0], 0
    total = 0
    while todo:
        node = todo.pop()
        a, b = int(tree["begin"][node]), int(tree["end"][node])
        if a < b:
            todo += range(b - 1, a - 1, -1)
            continue
        if held and held + sizes.get(node, 0) > most:
            total, held = total + 1, 0
        out[node] = total
        held += sizes.get(node, 0)
    return out


def route(queries: DataFrame, model: common.Model, dim: int, visits: int, shares: int) -> DataFrame:
    """(cell, share, h, vec, leaves): every cell that a query of queries(h, vec) has to visit leaves of, and which."""

    @common.tidied
    def walk(batches):
        t, cell = Tree(model), np.asarray(model["cell"])
        for batch in batches:
            row, at, lists = [], [], []
            for i, x in enumerate(rows_of(batch.column(1), dim) if batch.num_rows else []):
                leaves = np.array(t.first(x, visits), np.int32)
                where = cell[leaves]
                for c in np.unique(where):
                    row.append(i)
                    at.append(int(c))
                    lists.append(leaves[where == c].tobytes())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(lists, pa.binary())], names=["cell", "h", "vec", "leaves"])

    sent = queries.mapInArrow(walk, "cell bigint, h bigint, vec binary, leaves binary")
    return sent.withColumn("share", F.pmod("h", F.lit(shares)))


FAR = np.iinfo(np.int64).max


def meet(points: DataFrame, queries: DataFrame, dim: int, k: int, ids: str, shares: int) -> DataFrame:
    """(h, near): for each query and cell the up to k nearest points of the leaves visited, nearest first. A point and its
    distance are one number here, so that numpy's partition also settles ties by id."""
    near = pa.struct([("d", pa.float64()), ("id", pa.int64() if ids != "string" else pa.string())])

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        n = asked.num_rows
        top = np.full((n, k), FAR)
        name = np.array(data.column("id").to_pylist())
        if data.num_rows and n:
            x, leaf = rows_of(data.column("vec").combine_chunks(), dim), data.column("leaf").to_numpy()
            rank = np.empty(len(name), np.int64)
            rank[np.argsort(name, kind="stable")] = np.arange(len(name))
            lists = asked.column("leaves").to_pylist()
            visited = np.frombuffer(b"".join(lists), np.int32)
            who = np.repeat(np.arange(n), [len(v) // 4 for v in lists])
            order = np.argsort(visited, kind="stable")
            visited, who = visited[order], who[order]
            q = rows_of(asked.column("vec").combine_chunks(), dim)
            for one in np.unique(leaf):
                own = np.flatnonzero(leaf == one)
                a, b = np.searchsorted(visited, [one, one + 1])
                for lo in range(a, b, 4096):
                    w = who[lo : min(b, lo + 4096)]
                    far = np.rint((1 - (q[w] @ x[own].T).astype(np.float64)) * 1e6).astype(np.int64) << 32 | rank[own]
                    both = np.concatenate([top[w], far], 1)
                    top[w] = np.partition(both, k - 1, 1)[:, :k]
            top.sort(1)
        good = top < FAR
        flat = top[good]
        back = np.argsort(name, kind="stable")
        values = pa.StructArray.from_arrays([pa.array((flat >> 32) / 1e6), pa.array(name[back[flat & 0xFFFFFFFF]] if len(flat) else [], near.field("id").type)], fields=list(near))
        ends = np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32)
        return pa.table({"h": asked.column("h"), "near": pa.ListArray.from_arrays(pa.array(ends), values)})

    held = points.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return held.groupBy("cell", "share").cogroup(queries.groupBy("cell", "share")).applyInArrow(solve, f"h bigint, near array<struct<d: double, id: {ids}>>")


def nearest_neighbours(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: DataFrame | None = None, k: int = K, leaf: int = LEAF, branch: int = BRANCH, per_child: int = PER_CHILD, probes: int = PROBES, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """(id_col, rank INT, neighbour, distance DOUBLE): for every row of queries, which has the same two columns (all rows
    if it is None), its k nearest others of rows by cosine distance.

    A row whose id or vector is null, whose vector holds a null, NaN or infinity, has no direction (all zeros) or not
    the most frequent length of rows, has no neighbours and is nobody's. A query that occurs twice is answered once; rows
    that share an id are one point each but aren't neighbours of each other. With fewer than k others all are listed. Ids
    are whole numbers or strings. Other columns are not read, whatever their names; where id_col is called as one of the
    results is, that one gets an underscore. An empty table on either side gives none.
    """
    spark = rows.sparkSession
    common.shared_dir(spark)
    ids = "string" if common.kind(rows, id_col) == "string" else "bigint"
    dim = length(rows, vector_col)
    every = prepare(rows, id_col, vector_col, dim, ids).distinct()
    least = Window.partitionBy("h").orderBy("id")
    held = every.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= k + 1).checkpoint()
    vectors = held.filter("place = 1").select("h", "vec")
    total = vectors.count()
    tree = grow(vectors, total, dim, max(leaf, 2 * total // MOST_LEAVES), branch, per_child)
    model = common.Model(spark, "tree", tree)

    def place(batches):
        t = Tree(model)
        for batch in batches:
            at = t.descend(rows_of(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(at)], names=["h", "vec", "id", "leaf"])

    points = held.select("h", "vec", "id").mapInArrow(place, f"h bigint, vec binary, id {ids}, leaf bigint").checkpoint()
    sizes = {r.leaf: r["count"] for r in points.groupBy("leaf").count().collect()}  # a row for each leaf
    tree["cell"] = cells_of(tree, sizes, cell)
    asking = (every if queries is None else prepare(queries, id_col, vector_col, dim, ids).distinct()).checkpoint()
    asked = asking.select("h", "vec").distinct().checkpoint()
    n = asked.count()
    visits, cells = calibrate(points, asked, tree, tree["cell"], n, dim, k, probes, recall)
    model = common.Model(spark, "cells", tree)
    shares = max(1, math.ceil(cells * n / (tree["cell"].max() + 1) / ASKED))
    found = points.join(spark.createDataFrame([(x, int(tree["cell"][x])) for x in sizes], "leaf bigint, cell bigint"), "leaf")
    lists = meet(found, route(asked, model, dim, visits, shares), dim, k + 1, ids, shares)
    merged = lists.groupBy("h").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near")).select("h", F.slice("near", 1, k + 1).alias("near"))
    own = asking.select("id", "h").join(merged, "h").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    flat = own.select("id", F.posexplode("near").alias("rank", "x"))
    return common.named(flat.select("id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.d").alias("distance")), id_col, "rank", "neighbour", "distance")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 50; they are searched for among all rows."""
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, queries=rows.filter(F.col("vec_id") % 50 == 0))
