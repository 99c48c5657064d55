"""Vectors in cells around centres: an index kept on disk whose searches are exact, and a similarity join that leaves out cells too far apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import ranked
from lodestone.sources.scratch import materialise

#: Rows that centres are fitted on at most, rows of a cell on average, the most cells, rounds of fitting, and query vectors sent at a time.
SAMPLE, CELL_ROWS, MOST_CELLS, ROUNDS, QUERIES = 50_000, 2_000, 4_096, 8, 4_096
#: What sums in another order may change in a score.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), float).reshape(len(v), -1)


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k centres of rows: k-means from rows drawn at random. A centre that loses all rows stays where it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    """The nearest centre of each row, the first of equally near ones."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + block] @ c.T - half, axis=1) for a in range(0, len(x), block)] or [np.empty(0, int)])


class VectorIndex:
    """Unit vectors (id long, v) in files by cell, below a folder that driver and executors share.

    Centres are fitted on at most SAMPLE rows; every row is then in the cell of its nearest centre, whose radius is the
    largest distance of its rows. A row's cosine with a query is at most the query's product with the centre plus the
    radius, so a search reads the nearest cells first, and then only cells that can hold a better row than the k-th found:
    answers are exact, however the centres lie. Null vectors are left out, zero vectors have cosine 0.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.read_share = 0.0  # of cells, by the last search

    def build(self, vectors: DataFrame, cell_rows: int = CELL_ROWS) -> VectorIndex:
        own = vectors.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        n = own.count()
        k = int(min(MOST_CELLS, max(1, -(-n // cell_rows))))
        drawn = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas() if n > SAMPLE else own.orderBy("id").toPandas()
        c = self.spark.sparkContext.broadcast(centres(unit(matrix(drawn["v"])), k) if n else np.zeros((1, 1)))

        def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = unit(matrix(b["v"]))
                    cell = nearest(x, c.value)
                    yield pd.DataFrame({"cell": cell.astype(np.int32), "id": b["id"], "v": list(x), "far": np.linalg.norm(x - c.value[cell], axis=1)})

        rows = own.mapInPandas(assigned, "cell int, id long, v array<double>, far double")
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.root}/rows")
        places = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c.value)], "cell int, centre array<double>")
        far = self._rows().groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        places.join(far, "cell").coalesce(1).write.parquet(f"{self.root}/cells")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, far double, cell int").parquet(f"{self.root}/rows")

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """(query, doc, score, rank): exactly the k rows with the largest cosine for each of queries (query long, v), a query's own id left out; equal scores by id.

        Queries are a stated set, which goes to the workers in blocks; the driver sees the centres and each query's k-th
        score.
        """
        cells = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").toPandas()
        own = queries.where("v is not null").select(F.col("query").cast("long").alias("query"), F.col("v").cast("array<double>").alias("v"))
        parts, read, blocks = [], set(), max(1, -(-own.count() // QUERIES))
        for block in range(blocks):
            part = own.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query").toPandas()
            if not len(part) or not len(cells):
                continue
            ids, q = part["query"].to_numpy(), unit(matrix(part["v"]))
            most = q @ matrix(cells["centre"]).T + np.linalg.norm(q, axis=1)[:, None] * cells["radius"].to_numpy()
            order = np.argsort(-(q @ matrix(cells["centre"]).T), axis=1, kind="stable")
            held = np.cumsum(cells["n"].to_numpy()[order], axis=1)
            first = np.zeros(most.shape, bool)  # the nearest cells with k rows besides the query's own
            for i in range(len(ids)):
                first[i, order[i, : int(np.searchsorted(held[i], k + 1)) + 1]] = True
            near = materialise(self._scored(ids, q, cells, first, k, digits), "near")
            kth = {r["query"]: r["kth"] for r in ranked(near, k).groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
            floor = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
            rest = ~first & (most >= floor[:, None] - SLACK)
            parts += [near, self._scored(ids, q, cells, rest, k, digits)]
            read |= set(np.flatnonzero(first.any(0) | rest.any(0)).tolist())
        self.read_share = len(read) / max(1, len(cells))
        if not parts:
            return self.spark.createDataFrame([], "query long, doc long, score double, rank int")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return ranked(every, k)

    def _scored(self, ids: np.ndarray, q: np.ndarray, cells: pd.DataFrame, wanted: np.ndarray, k: int, digits: int) -> DataFrame:
        """Scores of the wanted (query, cell) pairs, the k best of each batch; only these cells are read."""
        chosen = cells["cell"].to_numpy()[wanted.any(0)].tolist()
        by = {int(cell): np.flatnonzero(wanted[:, j]) for j, cell in enumerate(cells["cell"]) if wanted[:, j].any()}
        shared = self.spark.sparkContext.broadcast((ids, q, by))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, by = shared.value
            for b in batches:
                out = []
                for cell, part in b.groupby("cell"):
                    at, doc = by[int(cell)], part["id"].to_numpy()
                    s = np.round(q[at] @ matrix(part["v"]).T, digits)
                    s[ids[at][:, None] == doc[None, :]] = -np.inf
                    for i, row in zip(ids[at].tolist(), s, strict=True):
                        best = np.lexsort((doc, -row))[: k + 1]
                        best = best[row[best] > -np.inf][:k]
                        out.append(pd.DataFrame({"query": i, "doc": doc[best], "score": row[best]}))
                if out:
                    yield pd.concat(out)

        return self._rows().where(F.col("cell").isin(chosen)).select("id", "v", "cell").mapInPandas(scored, "query long, doc long, score double")


#: Representatives of a tile and the most pivots, which every worker holds; with more rows tiles grow instead.
TILE, MOST_PIVOTS = 1024, 20_000


def contrasts(a: str, b: str) -> bool:
    """Whether two names share words and differ by words of one side alone, or by one word each: what functions.text.contrast says, within a task."""
    x, y = Counter(w for w in (a or "").split(" ") if w), Counter(w for w in (b or "").split(" ") if w)
    more, less = (x - y).total(), (y - x).total()
    return bool(x & y) and ((more == 0) != (less == 0) or (more == 1 and less == 1))


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which links (u, v) span the components that all of them make: a link between what is connected already is left out."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    keep = np.zeros(len(u), bool)
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep[k] = True
    return keep


def tiles(rows: DataFrame, threshold: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rows with their tile and part, (block, i, j, p, q): parts of tiles that can hold a similar pair) of rows (id, block, name, v).

    A tile is what is nearest to a pivot, a row drawn by hash; a tile of many rows is dealt to parts by hash. Two tiles are
    compared only if their pivots' distance, less both radii, is within what the threshold allows: decided from pivots
    alone, before any vector is shuffled.
    """
    spark, n = rows.sparkSession, rows.count()
    step = max(tile, -(-n // MOST_PIVOTS))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(step)) == 0).select("block", "id", "v")
    drawn = drawn.unionByName(rows.groupBy("block").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))).dropDuplicates(["block", "id"])
    own = drawn.orderBy("block", "id").toPandas()
    pivots = {block: unit(matrix(part["v"])) for block, part in own.groupby("block", dropna=False)}
    shared = spark.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, part in b.groupby("block"):
                x, c = unit(matrix(part["v"])), shared.value[block]
                near = nearest(x, c)
                yield pd.DataFrame({"id": part["id"], "block": block, "name": part["name"], "v": list(x), "tile": near.astype(np.int32), "far": np.linalg.norm(x - c[near], axis=1)})

    placed = materialise(rows.mapInPandas(assigned, "id long, block string, name string, v array<double>, tile int, far double"), "tiles")
    sizes = placed.groupBy("block", "tile").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / step).cast("int").alias("parts"))
    sizes = materialise(sizes, "tile-sizes")
    known = spark.sparkContext.broadcast({block: (p["tile"].to_numpy(), p["radius"].to_numpy(), p["parts"].to_numpy()) for block, p in sizes.orderBy("block", "tile").toPandas().groupby("block")})
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - SLACK)))) + SLACK

    def meeting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, i, radius, parts in zip(b["block"], b["tile"], b["radius"], b["parts"], strict=True):
                c, (other, far, theirs) = shared.value[block], known.value[block]
                j = np.flatnonzero((other >= i) & (np.linalg.norm(c[other] - c[i], axis=1) - far - radius <= reach))
                for t, m in zip(other[j].tolist(), theirs[j].tolist(), strict=True):
                    out += [(block, i, t, p, q) for p in range(parts) for q in range(p if t == i else 0, m)]
            yield pd.DataFrame(out, columns=["block", "i", "j", "p", "q"])

    meets = sizes.repartition("block", "tile").mapInPandas(meeting, "block string, i int, j int, p int, q int")
    parts = F.pmod(F.xxhash64("id", F.lit(11)), F.col("parts")).cast("int")
    return placed.join(sizes.select("block", "tile", "parts"), ["block", "tile"]).withColumn("part", parts).drop("parts", "far"), materialise(meets, "meets")


def similar_links(reps: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect what all pairs of reps (id, block, name, v) of one block with a cosine of `threshold` or more connect, but for names that are a contrast.

    Pairs of tiles are compared as matrices; of the links in a task only a spanning forest leaves it, so no pair table is
    made and a group of many similar names gives as many links as it has members for each pair of tiles. Null blocks,
    names and vectors: a null block is one of its own, a null name is no contrast, a row without a vector or with a zero one
    links with nothing.
    """
    if threshold <= 0:
        raise ValueError("a threshold above 0 is what lets tiles be left out")
    rows = reps.where("v is not null").select(F.col("id").cast("long").alias("id"), F.coalesce(F.concat(F.lit("b"), F.col("block").cast("string")), F.lit("")).alias("block"), F.col("name").cast("string").alias("name"), F.col("v").cast("array<double>").alias("v"))
    rows = materialise(rows.where(F.exists("v", lambda x: x != 0)), "representatives")
    placed, meets = tiles(rows, threshold, tile)
    one = lambda t, p, side: placed.withColumnsRenamed({"tile": t, "part": p}).join(meets, ["block", t, p]).withColumn("side", F.lit(side))
    dealt = one("i", "p", 0).unionByName(one("j", "q", 1).where("i <> j or p <> q"))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, i, j, p, q = key
        a = part[part["side"] == 0]
        b = a if (i, p) == (j, q) else part[part["side"] == 1]
        x, y, ids, others, names, theirs = matrix(a["v"]), matrix(b["v"]), a["id"].to_numpy(), b["id"].to_numpy(), a["name"].to_numpy(), b["name"].to_numpy()
        us, vs = [], []
        for k in range(0, len(a), 256):
            r, c = np.nonzero(np.round(x[k : k + 256] @ y.T, 6) >= threshold if len(b) else np.zeros((0, 0)))
            r += k
            r, c = r[ids[r] != others[c]], c[ids[r] != others[c]]
            free = np.array([not contrasts(names[m], theirs[n]) for m, n in zip(r.tolist(), c.tolist(), strict=True)], bool)
            u, v = (np.concatenate([held, new]) for held, new in ((us, ids[r[free]]), (vs, others[c[free]])))
            keep = _forest(u, v)
            us, vs = u[keep], v[keep]
        return pd.DataFrame({"u": np.asarray(us, np.int64), "v": np.asarray(vs, np.int64)})

    return dealt.groupBy("block", "i", "j", "p", "q").applyInPandas(compare, "u long, v long")
