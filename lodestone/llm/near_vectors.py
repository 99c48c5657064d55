"""Near-duplicate vectors: tiles compared dimension by dimension in PCA order, stopping where the cosine cannot be reached."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import groups, materialise, table, with_hot
from lodestone.llm.components import components

#: Vectors of a tile, and tiles at most: beyond so many (their bounds are broadcast, about 300 bytes each) tiles hold more vectors.
TILE, MOST_TILES = 8192, 1 << 16
#: Leading components by whose ranges pairs of tiles are decided, vectors that place the splits of the tree, rows compared at a
#: time, and dimensions after which pairs are dropped.
LEADING, SAMPLE, ROWS, STEPS = 16, 20_000, 512, (16, 32, 48)
#: What single-precision sums of unit vectors' products can be off by.
SLACK = 1e-5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: no square of these overflows or vanishes, and cosines stay the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in a batch: the length, which rows have it, and their matrix."""
    dims = batch.column(batch.schema.get_field_index("dims")).to_numpy()
    for d in np.unique(dims).tolist():
        yield d, dims == d, _matrix(batch.column(batch.schema.get_field_index("embedding")).filter(pa.array(dims == d)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in _by_length(batch):
            y = _unit(x)
            sums[d] = sums.get(d, 0) + y.T @ y
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d)), pa.array(s.ravel())], names=["dims", "at", "value"])


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the eigenvectors of their second moments, largest first: a matrix of that size squared, not of the rows."""
    rows = classes.select("dims", "embedding").mapInArrow(_moments, "dims int, at long, value double").groupBy("dims", "at").agg(F.sum("value").alias("value")).toArrow().sort_by([("dims", "ascending"), ("at", "ascending")])
    dims, value, out = rows.column("dims").to_numpy(), rows.column("value").to_numpy(), {}
    for d in np.unique(dims).tolist():
        out[d] = np.linalg.eigh(value[dims == d].reshape(d, d))[1][:, ::-1].copy()
    return out


class Tree:
    """Splits of space at medians of a sample, each along the leading component that varies most there; leaves hold about `leaf` of the sample."""

    def __init__(self, points: np.ndarray, leaf: float):
        self.axis, self.at, self.below, self.leaves = [], [], [], 0
        self.root = self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: float) -> int:
        """The number of a split, or for a leaf -1 less its number."""
        axis = int(np.argmax(points.var(0))) if len(points) > max(leaf, 1) else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        low = points[:, axis] < at
        if len(points) <= max(leaf, 1) or not low.any():
            self.leaves += 1
            return -self.leaves
        own = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.below.append((0, 0))
        self.below[own] = (self._grow(points[low], leaf), self._grow(points[~low], leaf))
        return own

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(points), self.root)
        axis, at, below = np.array(self.axis, int), np.array(self.at), np.array(self.below, int).reshape(-1, 2)
        while (some := np.flatnonzero(node >= 0)).size:
            n = node[some]
            node[some] = below[n, (points[some, axis[n]] >= at[n]).astype(int)]
        return -1 - node


def suffixes(y: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt(np.maximum((y[:, at:] ** 2).sum(1), 0))


def may_meet(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes (rows of lows, highs: ranges of leading components, then of the suffix norm) can hold a unit vector with this cosine to one in the box low, high."""
    product = np.maximum(np.maximum(low * lows, low * highs), np.maximum(high * lows, high * highs)).sum(1)
    apart = np.maximum(np.maximum(lows - high, low - highs), 0)
    return (product >= threshold - 1e-9) & ((apart**2).sum(1) <= 2 - 2 * threshold + 1e-9)


def near_pairs(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float, steps=STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and u (the same vectors: scaled, and as unit rows in component order) and of y and v whose cosine reaches the threshold.

    The product of the leading dimensions and of the suffix norms bounds every cosine; pairs that it leaves go on to more
    dimensions one by one, or, where many are left, as a block; the last word is a cosine in double precision.
    """
    first = min(steps[0], u.shape[1])
    left, right = (np.hstack([z[:, :first], suffixes(z, first)[:, None]]).astype(np.float32) for z in (u, v))
    a, b = np.nonzero(left @ right.T >= np.float32(threshold - SLACK))
    if len(a) > 0.05 * len(x) * len(y):
        r, c = np.unique(a), np.unique(b)
        exact = np.zeros((len(x), len(y)), bool)
        exact[np.ix_(r, c)] = (x[r] @ y[c].T) / np.outer(np.linalg.norm(x[r], axis=1), np.linalg.norm(y[c], axis=1)) >= threshold
        keep = exact[a, b]
        return a[keep], b[keep]
    parts = []
    for k in range(0, len(a), 1 << 16):
        p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        dot, at = np.einsum("ij,ij->i", u[p, :first], v[q, :first]), first
        for to in (s for s in steps[1:] if s < u.shape[1]):
            dot += np.einsum("ij,ij->i", u[p, at:to], v[q, at:to])
            alive, at = dot + suffixes(u, to)[p] * suffixes(v, to)[q] >= threshold - SLACK, to
            p, q, dot = p[alive], q[alive], dot[alive]
        keep = np.einsum("ij,ij->i", x[p], y[q]) / (np.linalg.norm(x[p], axis=1) * np.linalg.norm(y[q], axis=1)) >= threshold
        parts.append((p[keep], q[keep]))
    return tuple(np.concatenate(z) if parts else np.empty(0, int) for z in (zip(*parts, strict=True) if parts else ((), ())))


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's least known partner) after rows a and b are linked pair by pair."""
    while True:
        p, q = label[a], label[b]
        new = p != q
        if not new.any():
            return label
        a, b = a[new], b[new]
        np.minimum.at(label, np.maximum(p[new], q[new]), np.minimum(p[new], q[new]))
        while not np.array_equal(label, up := label[label]):
            label = up


def _compared(batches: Iterator[pa.RecordBatch], bases, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles: every linked class with its number of partners there and the least class that it reaches."""
    vertex = pa.struct([("first", pa.int64()), ("node", pa.int64())])
    schema = pa.schema([("u", vertex), ("links", pa.int64()), ("v", vertex)])
    for group in groups(batches, ["left", "right"]):
        group = group.sort_by([("first", "ascending"), ("node", "ascending")])
        first, node, weight, own = (group.column(n).to_numpy() for n in ("first", "node", "weight", "own"))
        x = _scaled(_matrix(group.column("embedding")))
        u = _unit(x) @ bases.value[x.shape[1]]
        left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
        rows, columns = np.flatnonzero(own == left), np.flatnonzero(own == right)
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            after = columns[k:] if left == right else columns
            a, b = near_pairs(x[some], x[after], u[some], u[after], threshold)
            a, b = some[a], after[b]
            if left == right:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, weights=weight[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=weight[a], minlength=len(x)).astype(np.int64)
            label = joined(label, a, b)
        some = np.flatnonzero(links)
        name = lambda rows: pa.StructArray.from_arrays([pa.array(first[rows]), pa.array(node[rows])], fields=list(vertex))
        yield pa.RecordBatch.from_arrays([name(some), pa.array(links[some]), name(label[some])], schema=schema)
    yield pa.RecordBatch.from_pylist([], schema=schema)


def tiles(classes: DataFrame, bases, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(classes with their tile, pairs of tiles (own, left, right) that can hold a link, seen from either tile).

    A sample places the splits of a tree over the leading components; the ranges of each leaf are those of all its classes. A
    leaf of more classes than a tile is dealt to several tiles by hash.
    """
    spark, value = classes.sparkSession, bases.value
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    rows = max(tile, -(-sum(sizes.values()) // MOST_TILES))
    drawn = classes.select("dims", "embedding", "node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
    trees = {}
    for d, n in sizes.items():
        own = drawn.filter(pa.compute.equal(drawn.column("dims"), d))
        points = _unit(_matrix(own.column("embedding"))) @ value[d][:, :LEADING] if len(own) else np.zeros((0, 1))
        trees[d] = Tree(points, len(points) * rows / n)
    shared, base = spark.sparkContext.broadcast(trees), dict(zip(sorted(trees), np.cumsum([0, *[trees[d].leaves for d in sorted(trees)]]).tolist(), strict=False))

    def placed(batches):
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int32)
            for d, which, x in _by_length(batch):
                leaf[which] = base[d] + shared.value[d].place(_unit(x) @ bases.value[d][:, :LEADING])
            yield batch.append_column("leaf", pa.array(leaf))

    kind = classes.schema["embedding"].dataType.simpleString()
    cells = materialise(classes.select("node", "embedding", "first", "weight", "dims").mapInArrow(placed, f"node long, embedding {kind}, first long, weight long, dims int, leaf int"), "cells")

    def ranges(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, which, x in _by_length(batch):
                y = _unit(x) @ bases.value[d]
                y = np.hstack([np.pad(y[:, :LEADING], ((0, 0), (0, max(0, LEADING - d)))), suffixes(y, LEADING)[:, None]])
                leaf = batch.column(batch.schema.get_field_index("leaf")).to_numpy()[which]
                for k in np.unique(leaf).tolist():
                    z, old = y[leaf == k], held.get(k)
                    low, high = z.min(0), z.max(0)
                    held[k] = [d, len(z), low, high] if old is None else [d, old[1] + len(z), np.minimum(old[2], low), np.maximum(old[3], high)]
        rows_ = [{"leaf": k, "dims": d, "n": n, "low": low.tolist(), "high": high.tolist()} for k, (d, n, low, high) in held.items()]
        yield pa.RecordBatch.from_pylist(rows_, schema=pa.schema([("leaf", pa.int32()), ("dims", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    parts = cells.mapInArrow(ranges, "leaf int, dims int, n long, low array<double>, high array<double>")
    least = lambda c, f: F.array(*[f(F.col(c)[k]) for k in range(LEADING + 1)]).alias(c)
    boxes = materialise(parts.groupBy("leaf").agg(F.first("dims").alias("dims"), F.sum("n").alias("n"), least("low", F.min), least("high", F.max)).withColumn("parts", F.ceil(F.col("n") / rows).cast("int")), "boxes")
    got = boxes.toArrow()  # one row a leaf, MOST_TILES at most
    every = spark.sparkContext.broadcast((got.column("leaf").to_numpy(), got.column("dims").to_numpy(), got.column("parts").to_numpy(), *(_matrix(got.column(c)) if len(got) else np.zeros((0, LEADING + 1)) for c in ("low", "high"))))

    def meeting(batches):
        leaf, dims, count, low, high = every.value
        for batch in batches:
            for own, d, n, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                some = np.flatnonzero((leaf >= own) & (dims == d))
                some = some[may_meet(np.array(lo), np.array(hi), low[some], high[some], threshold)]
                out = [(own << 20 | i, other << 20 | j) for other, m in zip(leaf[some].tolist(), count[some].tolist(), strict=True) for i in range(n) for j in range(i if other == own else 0, m)]
                a, b = np.array(out, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["left", "right"])

    pairs = materialise(boxes.select("leaf", "dims", "parts", "low", "high").repartition(F.col("leaf")).mapInArrow(meeting, "left long, right long"), "tile-pairs")
    both = pairs.select(F.col("left").alias("own"), "left", "right").union(pairs.where("left <> right").select(F.col("right").alias("own"), "left", "right"))
    own = F.shiftleft(F.col("leaf").cast("long"), 20).bitwiseOR(F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts").cast("long")))
    return cells.join(boxes.select("leaf", "parts"), "leaf").select(own.alias("own"), "node", "first", "weight", "embedding"), both


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: links at this cosine or more, counted for each vector, and the components they make.

    Equal vectors are one class (named by a 64-bit hash and its smallest vec_id) that counts with its size. A tree over the
    leading principal components, whose leaves grow in number with the classes, makes tiles; ranges of components and suffix
    norms decide which pairs of tiles can hold a link, and only these are shuffled. Each pair of tiles is one bounded group
    that gives a count and a root for each linked class, never pairs.

    Null vectors, and those that are empty, zero or hold null, NaN or infinite components, link with nothing; nor do vectors
    of different length. Very small and very large components keep their cosine: rows are scaled by a power of two first.
    Repeated rows, and rows of one vec_id, count as vectors of their own; a null vec_id stays null and names no component
    unless all of it is null. An empty table gives no rows; other columns are ignored.
    """
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x if embeddings.schema["embedding"].dataType.elementType.simpleString() == "float" else x.cast("double")).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    own = own.withColumn("node", F.when(F.coalesce(finite, F.lit(False)), F.xxhash64("embedding")))
    classes = own.where("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.coalesce(F.min("vec_id"), F.lit((1 << 63) - 1)).alias("first"), F.count("*").alias("weight"))
    classes = materialise(classes.withColumn("dims", F.size("embedding")), "classes")
    shared = own.sparkSession.sparkContext.broadcast(principal(classes))
    dealt, meets = tiles(classes, shared, threshold, tile)
    met = dealt.join(meets, "own").select("left", "right", "own", "first", "node", "weight", "embedding")
    pairs = met.repartition("left", "right").sortWithinPartitions("left", "right").mapInArrow(lambda b: _compared(b, shared, threshold), "u struct<first: long, node: long>, links long, v struct<first: long, node: long>")
    found = materialise(pairs, "links")
    roots = components(found.select("u", "v")).select(F.col("node.node").alias("node"), F.col("root.first").alias("component"))
    counts = found.groupBy(F.col("u.node").alias("node")).agg(F.sum("links").alias("links"))
    sized = classes.select("node", "first", "weight").join(counts, "node", "left").join(roots, "node", "left")
    sized = materialise(sized.select("node", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")), "sized")
    named = with_hot(own.select("vec_id", "node").where("node is not null"), sized, "node", "weight").select("vec_id", "n_links", F.nullif("component", F.lit((1 << 63) - 1)).alias("component_id"))
    alone = own.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS raw, list_max(list_transform(raw, lambda x: abs(x))) AS most, list_transform(raw, lambda x: x / most) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e FROM v WHERE raw IS NOT NULL AND len(list_filter(raw, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND most > 0),
link AS (SELECT a.r, b.r AS s, b.vec_id FROM ok a JOIN ok b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, link.s FROM reach JOIN link ON link.r = reach.s),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY 1),
n AS (SELECT r, count(*) AS n_links FROM link GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v LEFT JOIN n USING (r) JOIN least USING (r)
"""
