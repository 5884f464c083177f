"""Operator 8: near duplicates by an LSH forest over MinHash signatures.

Each text gets VALUES MinHash values over its shingles of SHINGLE words. The forest has TREES orders of the texts: a tree's
key is the signature, a byte of each value, begun at another place. What shares a tree's first DEPTH values (of two bytes
each) is a region; a region's rows come sorted by the key, so that those next to each other share the longest prefixes.
A region of up to REGION rows has all its pairs compared. In a larger one depth follows density: it is split a value
deeper, as often as need be, until the parts are that small, and rows next to each other across a split are compared too.
All other pairs of such a region are then settled by the parts' groups: a group stands behind a pivot and a radius,
and by the triangle inequality (bytes that differ are a metric) most pairs of groups are surely not alike; those that may
be are compared row by row. So every pair of a region counts as compared, whatever the region's size, and whether two rows
are found alike doesn't depend on how many others there are.

Texts with the same values are held once, by a hash of 128 bits. Places alone are shuffled at first; signatures follow for
those that are not alone in their region. A region of more than HOT rows goes to several tasks, each with two of its
blocks, so that all its pairs still meet. Compared pairs count when the estimate of their Jaccard similarity reaches
THRESHOLD; classes are connected components of these pairs.

What can be missed is a pair that shares no region: 1-(1-s^DEPTH)^TREES of the pairs of similarity s share one, by the
formula 0.9996 at 0.6 and more above; thresholds under 0.6 find less (0.985 at 0.5). A region of n rows that are alike costs
about n comparisons, one of n rows that are not about n^2/2, by tasks of HOT^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, VALUES, TREES, DEPTH, THRESHOLD = 2, 128, 32, 3, 0.6
#: Rows of a region whose pairs are compared without going deeper; rows of a region from which it is shared by tasks.
REGION, HOT = 64, 1 << 16
#: Rows compared at a time; it bounds memory, not what is compared.
STEP = 4096

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, VALUES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, np.uint32)
_C = _rng.integers(0, 1 << 63, 8, np.uint64) | np.uint64(1)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of `size` lower-case words, and the index of its text. A text of fewer words, but at
    least one, has one shingle of all of them."""
    buf, offsets = common.pack([t and t.lower() for t in texts])
    start, end = common.words(buf)
    h = common.word_hashes(buf, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    n = len(h)
    total, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(size):
        same = np.zeros(n, bool)
        same[: n - j] = doc[j:] == doc[: n - j] if n > j else False
        total[: n - j] += np.where(same[: n - j], h[j:], np.uint64(0)) * _C[j]
        whole = same
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    short = np.bincount(doc, minlength=len(texts))[doc] < size if n else first
    use = whole | (first & short)
    return common.mix(total[use]), doc[use]


def minhashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of VALUES 32-bit values, indices of the texts that they belong to); texts without a word have none."""
    h, doc = shingles(texts)
    if not len(h):
        return np.zeros((0, VALUES), np.uint32), np.zeros(0, np.int64)
    x = (h >> np.uint64(32)).astype(np.uint32)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(begin), VALUES), np.uint32)
    v = np.empty_like(x)
    for k in range(VALUES):
        np.multiply(x, _A[k], out=v)
        v += _B[k]
        out[:, k] = np.minimum.reduceat(v, begin)
    return out, doc[begin]


def mixed(values: np.ndarray) -> np.ndarray:
    """The rows' signatures of 2 * VALUES bytes: one byte of each value, which are compared, then a second one of each."""
    x = values * np.uint32(0x9E3779B1)
    return np.concatenate([(x >> np.uint32(24)).astype(np.uint8), (x >> np.uint32(16)).astype(np.uint8)], 1)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of VALUES bytes, indices of the texts that they belong to); texts without a word have none."""
    values, doc = minhashes(texts)
    return mixed(values)[:, :VALUES], doc


def estimate(matches):
    """Jaccard similarity from the number of equal bytes; 1/256 of the others are equal by chance."""
    return (matches / VALUES - 1 / 256) / (1 - 1 / 256)


def needed(threshold: float) -> int:
    return int(np.ceil(VALUES * (threshold * (1 - 1 / 256) + 1 / 256) - 1e-9))


def equal_bytes(rest: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *((rest[i : i + STEP] == row).sum(1, dtype=np.int32) for i in range(0, len(rest), STEP))])


def spanning(keys: np.ndarray, least: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """A spanning forest of all pairs of rows with at least `least` equal bytes, and its trees' rows."""
    edges: list[tuple[int, int]] = []
    trees: list[list[int]] = []
    left, rest, todo = np.arange(len(keys)), keys, []  # rows that no edge has reached yet, and their keys
    while len(left):
        if not todo:
            todo, left, rest = [int(left[0])], left[1:], rest[1:]
            trees.append(list(todo))
        a = todo.pop()
        near = equal_bytes(rest, keys[a]) >= least
        if near.any():
            found = left[near].tolist()
            edges += [(a, b) for b in found]
            todo += found
            trees[-1] += found
            left, rest = left[~near], rest[~near]
    return edges, [np.array(t) for t in trees]


def any_pair(a: np.ndarray, b: np.ndarray, keys: np.ndarray, least: int, radius: int) -> tuple[int, int] | None:
    """A pair of rows of the groups a and b with `least` equal bytes, if there is one. radius: a's, around its first row."""
    far = VALUES - equal_bytes(keys[b], keys[a[0]])
    for y in b[np.argsort(far, kind="stable")][: int((far <= VALUES - least + radius).sum())].tolist():
        hit = np.flatnonzero(equal_bytes(keys[a], keys[y]) >= least)
        if len(hit):
            return int(a[hit[0]]), y
    return None


def region_edges(keys: np.ndarray, least: int, region: int = REGION) -> list[tuple[int, int]]:
    """Pairs with at least `least` equal bytes that join all rows that such pairs join; keys: sorted rows, of any number."""
    if len(keys) <= region:
        return spanning(keys, least)[0]
    edges: list[tuple[int, int]] = []
    groups: list[np.ndarray] = []
    todo = [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= region or depth == VALUES:
            e, trees = spanning(keys[lo:hi], least)
            edges += [(a + lo, b + lo) for a, b in e]
            groups += [t + lo for t in trees]
        else:
            cut = (np.flatnonzero(np.diff(keys[lo:hi, depth])) + lo + 1).tolist()
            todo += [(a, b, depth + 1) for a, b in zip([lo, *cut], [*cut, hi])]
    of = np.empty(len(keys), np.int64)
    for g, rows in enumerate(groups):
        of[rows] = g
    # Rows next to each other: what they join needs no comparison of groups.
    close = np.flatnonzero(((keys[1:] == keys[:-1]).sum(1, dtype=np.int32) >= least) & (of[1:] != of[:-1]))
    beside: dict[int, list[int]] = {}
    for i in close.tolist():
        a, b = int(of[i]), int(of[i + 1])
        edges.append((i, i + 1))
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    pivot = keys[[int(g[0]) for g in groups]]
    radius = np.array([0 if len(g) == 1 else int((VALUES - equal_bytes(keys[g], keys[g[0]])).max()) for g in groups])
    left, waiting = np.arange(len(groups)), np.ones(len(groups), bool)  # groups that the present class hasn't reached
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue = [int(left[0])]
            waiting[queue[0]] = False
        a = queue.pop()
        for b in beside.get(a, ()):
            if waiting[b]:
                waiting[b] = False
                queue.append(b)
        left = left[waiting[left]]
        far = VALUES - equal_bytes(pivot[left], pivot[a])
        sure = far <= VALUES - least
        for b in left[sure].tolist():
            edges.append((int(groups[a][0]), int(groups[b][0])))
            waiting[b] = False
            queue.append(b)
        for b in left[~sure & (far <= VALUES - least + radius[a] + radius[left])].tolist():
            if e := any_pair(groups[a], groups[b], keys, least, int(radius[a])):
                edges.append(e)
                waiting[b] = False
                queue.append(b)
    return edges


@common.tidied
def edges_of_regions(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of (region, key, id) in order of region and key -> (a, b). Holds back the region that is not complete."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve(region, sig, ids):
        begin = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        size = np.diff(begin, append=len(region))
        two = begin[size == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= least]
        pairs = [np.stack([two, two + 1], 1)]
        for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            if e := region_edges(sig[b : b + n], least):
                pairs.append(np.array(e) + b)
        p = np.concatenate(pairs).astype(np.int64)
        a, b = ids[p[:, 0]], ids[p[:, 1]]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        region, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
        last = int(np.argmax(region == region[-1]))
        if last or held and held[-1][0][-1] != region[-1]:
            held.append((region[:last], sig[:last], ids[:last]))
            yield from solve(*map(np.concatenate, zip(*held)))
            held = []
        held.append((region[last:], sig[last:], ids[last:]))
    if held:
        yield from solve(*map(np.concatenate, zip(*held)))


def row_key(id_col: Column, text_col: Column) -> Column:
    return F.xxhash64(id_col, text_col)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, k1, k2, sig) of every text that has a word; k1 and k2 are the hash of its values."""

    @common.tidied
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in common.chunks(texts):
                values, at = minhashes(texts[a:b])
                take = pa.array(at + a)
                own = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v.tobytes()) for v in values), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array([r.tobytes() for r in mixed(values)], pa.binary())], names=["rid", "id", "k1", "k2", "sig"])

    some = common.pick(docs, id=id_col, text=text_col)
    return some.select(row_key(F.col("id"), F.col("text")).alias("rid"), "id", "text").mapInArrow(run, f"rid bigint, id {common.kind(docs, id_col)}, k1 bigint, k2 bigint, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): every vertex of edges (a, b), a <> b, but the least of its component, and that least one. By turns of
    large stars and small stars, written to the shared folder in every turn. A vertex's least neighbour is found by an
    aggregation with partial sums and joined to its edges, so that a vertex of very many edges is no task of its own."""
    common.shared_dir(edges.sparkSession)

    def with_least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")

    now, was = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint(), None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == was or not state[0]:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        was = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).select("a", "b", F.least("a", "m").alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct().checkpoint()
        low = with_least(large)
        now = low.select("a", F.col("m").alias("b")).union(low.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()


def forest_edges(texts: DataFrame, least: int, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of rids of texts(rid, sig), each with another signature, that join all that the forest's pairs join."""
    step, low = VALUES // TREES, F.substring("sig", 1, VALUES)
    part = lambda begin, n: F.expr(f"substring(sig, {begin} + t * {step}, {n})")
    places = texts.select("rid", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).select("rid", "t", F.xxhash64("t", part(1, DEPTH), part(VALUES + 1, DEPTH)).alias("region"))
    shared = places.join(places.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1"), "region")
    blocks = F.ceil(F.col("n") / hot)
    own = F.pmod(F.xxhash64("rid"), blocks)
    spread = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    task = F.when(F.col("n") <= hot, F.col("region")).otherwise(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
    turned = F.concat(F.expr(f"substring(low, 1 + t * {step})"), F.expr(f"substring(low, 1, t * {step})"))
    rows = spread.select("rid", "t", task.alias("task")).join(texts.select("rid", low.alias("low")), "rid").select("task", turned.alias("key"), "rid")
    ordered = rows.repartition("task").sortWithinPartitions("task", "key", "rid")
    return ordered.mapInArrow(partial(edges_of_regions, least=least), "a bigint, b bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """(rid, id, times, size, first): for every row with a word that is alike to another, how often it occurs, its class'
    rows, and the id and rid of the row to keep: the least id, nulls last."""
    common.shared_dir(docs.sparkSession)
    sketch = sketches(docs, id_col, text_col).checkpoint()
    rows = sketch.groupBy("rid", "id", "k1", "k2").agg(F.count("*").alias("times"))
    reps = rows.groupBy("k1", "k2").agg(F.min("rid").alias("rep")).checkpoint()
    texts = sketch.select("rid", "sig").join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi").distinct()
    star = components(forest_edges(texts, needed(threshold), hot))
    found = rows.join(reps, ["k1", "k2"]).join(star, F.col("rep") == F.col("v"), "left").select("rid", "id", "times", F.coalesce("root", "rep").alias("comp"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    whole = found.groupBy("comp").agg(F.sum("times").alias("size"), F.min(order).alias("first")).filter("size > 1")
    return found.join(whole, "comp").select("rid", "id", "times", "size", "first.id", "first.rid").toDF("rid", "id", "times", "size", "first", "first_rid")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, group_id, links BIGINT, kept BOOLEAN): every row that has a near copy; group_id names its class by the least
    id in it, links is the number of the class' other rows, and the row that has the least id is the one to keep. Rows
    that are alike to none are not in the result: they are classes of their own, without a link.

    Whole texts are read. Null texts and texts without a word are alike to none. A row that occurs twice makes a class
    of itself, of which one is kept. Null ids come last in their class. Other columns are not read, whatever their names;
    where id_col is called as one of the results is, that one gets an underscore. An empty table gives none.
    """
    found = classes(docs, id_col, text_col, threshold).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return common.named(found.select("id", "first", F.col("size") - 1, (F.col("rid") == F.col("first_rid")) & (F.col("turn") == 1)), id_col, "group_id", "links", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that near_duplicates() doesn't keep; of a repeated row one stays. Null texts,
    texts without a word and rows alike to none stay; an empty table stays empty. Columns may have any names."""
    found = classes(docs, id_col, text_col, threshold)
    verdict = found.select("rid", (F.col("rid") == F.col("first_rid")).alias("keep"), "times").checkpoint()
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = row_key(*(F.col(f"c{common.place(docs, c)}") for c in (id_col, text_col)))
    left = flat.withColumn("rid", own).join(verdict, "rid", "left").filter(F.coalesce("keep", F.lit(True)))
    if verdict.filter("keep AND times > 1").isEmpty():
        return left.select(flat.columns).toDF(*docs.columns)
    twice = F.coalesce("times", F.lit(1)) > 1
    return left.filter(~twice).select(flat.columns).union(left.filter(twice).dropDuplicates(["rid"]).select(flat.columns)).toDF(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
