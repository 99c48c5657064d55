"""A kept inverted index: postings in files by term, the best each window of documents can give, and exact BM25 top-k that leaves windows out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import K1, B, ranked

#: Documents and tokens of a shard, which one task makes and scores; documents of a window of it, which is scored or left out as a whole; files that terms are dealt to.
SHARD, SHARD_TOKENS, WINDOW, TERM_FILES = 1 << 16, 1 << 21, 256, 64
#: Query terms that are scored in one pass: what is sent to the workers.
QUERY_TERMS = 200_000
POSTINGS = "term string, shard string, n long, docs binary, tfs binary, windows binary, best binary"
DOCUMENTS = "shard string, n long, size long, docs array<long>, sizes binary"


def _impact(tf: np.ndarray, size: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def _inverted(batches: Iterator[pa.RecordBatch], segment: str, mean: float, shard: int, tokens: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """One row for each term of a shard of this task's documents, and one (with a null term) for the shard itself."""
    names = ["term", "shard", "n", "docs", "tfs", "windows", "best", "size", "ids"]
    held, task, k = [], TaskContext.get(), 0

    def rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal k
        table = pa.Table.from_batches(batches)
        name = f"{segment}-{task.partitionId() if task else 0}-{k}"
        k += 1
        tokens = table.column("tokens").combine_chunks()
        sizes = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        words = tokens.flatten().dictionary_encode()
        pair = np.asarray(words.indices, np.int64) * table.num_rows + np.repeat(np.arange(table.num_rows), sizes)
        pair, tf = np.unique(pair, return_counts=True)
        term, doc = pair // table.num_rows, pair % table.num_rows
        best = _impact(tf, sizes[doc], mean, k1, b)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        out = [(None, name, table.num_rows, None, sizes.astype("<i4").tobytes(), None, None, int(sizes.sum()), table.column("doc").to_pylist())]
        for code, a, z in zip(term[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(term)], strict=True):
            window = doc[a:z] // WINDOW
            first = np.flatnonzero(np.diff(window, prepend=-1))
            high = np.maximum.reduceat(best[a:z], first)
            out.append((words.dictionary[code].as_py(), name, z - a, doc[a:z].astype("<i4").tobytes(), tf[a:z].astype("<i4").tobytes(), window[first].astype("<i4").tobytes(), high.astype("<f8").tobytes(), None, None))
        types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    n, size = 0, 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column("tokens").value_lengths().fill_null(0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + tokens - size, side="right"))
            to = min(max(to, at if n else at + 1), at + shard - n)  # a longer document is a shard of its own
            if to > at:
                held.append(batch.slice(at, to - at))
                n, size, at = n + held[-1].num_rows, size + int(ends[min(to, len(ends)) - 1] - before), min(to, batch.num_rows)
            if n == shard or at < batch.num_rows:
                yield rows(held)
                held, n, size = [], 0, 0
    if n:
        yield rows(held)


class InvertedIndex:
    """Postings of documents (doc long, tokens array<string>) below a folder that driver and executors share.

    Every `add` writes one segment: its shards' terms, in files by a hash of the term and sorted by it, and then its
    documents; a segment counts once the latter are there, so an `add` that dies leaves the index as it was. A shard is made
    in one task from the documents it reads, so tokens are never shuffled, only their postings are.
    """

    def __init__(self, spark: SparkSession, root: str, k1: float = K1, b: float = B, shard: int = SHARD, tokens: int = SHARD_TOKENS):
        self.spark, self.root, self.k1, self.b, self.shard, self.tokens = spark, root.rstrip("/"), k1, b, shard, tokens
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        folder = self._path(self.root)
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(n for n in names if self._files.exists(self._path(f"{self.root}/{n}/documents/_SUCCESS")))

    def _read(self, name: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s}/{name}") for s in self.segments()]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)

    def statistics(self) -> tuple[int, float]:
        """(documents, mean size)."""
        n, size = self._read("documents", DOCUMENTS).agg(F.sum("n"), F.sum("size")).first()
        return n or 0, (size or 0) / n if n else 0.0

    def add(self, docs: DataFrame) -> None:
        """Index documents that are not in the index yet; those that are stay as they are. Null ids and null tokens are left out."""
        segment = f"segment-{len(self.segments()):06d}"
        own = docs.where("doc is not null and tokens is not null").select(F.col("doc").cast("long").alias("doc"), "tokens")
        if int(segment[-6:]):
            own = own.join(self._read("documents", DOCUMENTS).select(F.explode("docs").alias("doc")), "doc", "left_anti")
        mean = self.statistics()[1] or 100.0
        made = own.mapInArrow(
            partial(_inverted, segment=segment, mean=mean, shard=self.shard, tokens=self.tokens, k1=self.k1, b=self.b), "term string, shard string, n long, docs binary, tfs binary, windows binary, best binary, size long, ids array<long>"
        )
        raw = f"{self.root}/{segment}/raw"
        made.withColumn("mean", F.lit(mean)).write.mode("overwrite").parquet(raw)
        rows = self.spark.read.parquet(raw)
        file = F.pmod(F.xxhash64("term"), F.lit(TERM_FILES)).cast("int")
        terms = rows.where("term is not null").drop("size", "ids").withColumn("file", file)
        terms.repartition(TERM_FILES, "file").sortWithinPartitions("file", "term").write.mode("overwrite").partitionBy("file").parquet(f"{self.root}/{segment}/postings")
        rows.where("term is null").select("shard", "n", "size", F.col("ids").alias("docs"), F.col("tfs").alias("sizes")).write.mode("overwrite").parquet(f"{self.root}/{segment}/documents")
        self._files.delete(self._path(raw), True)

    def postings(self, terms: list[str]) -> DataFrame:
        """The posting rows of some terms: only the files that they are dealt to are read."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("file", F.pmod(F.xxhash64("term"), F.lit(TERM_FILES)).cast("int"))
        files = [r["file"] for r in wanted.select("file").distinct().collect()]
        rows = self._read("postings", f"{POSTINGS}, mean double, file int").where(F.col("file").isin(files))
        return rows.join(F.broadcast(wanted.select("term")), "term", "left_semi").drop("file")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, doc, score, rank): exactly the k best documents with a score above 0 of queries (query, tokens), by BM25.

        Queries are a stated set; their terms go to the workers in blocks. Each shard's postings of these terms meet in one
        task, which scores windows in the order of the most that they can reach, until no other can be among the k best.
        """
        times = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count("*").cast("double").alias("times"))
        own = times.toPandas()
        n, mean = self.statistics()
        parts, kind = [], dict(times.dtypes)["query"]
        for part in _blocks(own, QUERY_TERMS):
            rows = self.postings(part["term"].unique().tolist())
            df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}
            part = part[part["term"].isin(df.keys())]
            weight = part["times"] * [float(np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1)) for t in part["term"]]
            shared = self.spark.sparkContext.broadcast(list(part.assign(weight=weight).groupby("query")[["term", "weight"]]))
            documents = self._read("documents", DOCUMENTS).select("shard", "docs", "sizes")
            parts.append(rows.groupBy("shard").cogroup(documents.groupBy("shard")).applyInArrow(_scorer(shared, k, mean, self.k1, self.b, kind), f"query {kind}, doc long, score double"))
        if not parts:
            return self.spark.createDataFrame([], f"query {kind}, doc long, score double, rank int")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return ranked(every, k)


def _blocks(terms: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Whole queries, so many terms at a time or one query."""
    held, n = [], 0
    for _, part in terms.groupby("query"):
        if held and n + len(part) > most:
            yield pd.concat(held)
            held, n = [], 0
        held.append(part)
        n += len(part)
    if held:
        yield pd.concat(held)


def _scorer(shared, k: int, mean: float, k1: float, b: float, kind: str):
    types = pa.schema([("query", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("doc", pa.int64()), ("score", pa.float64())])

    def scored(postings: pa.Table, documents: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in types.names}
        if postings.num_rows and documents.num_rows:
            ids, sizes = documents.column("docs")[0].values.to_numpy(), np.frombuffer(documents.column("sizes")[0].as_py(), "<i4")
            shard = Shard(postings, sizes, mean, k1, b)
            for query, part in shared.value:
                at, score = shard.best(part["term"].tolist(), part["weight"].tolist(), ids, k)
                found["query"] += [query] * len(at)
                found["doc"] += ids[at].tolist()
                found["score"] += score.tolist()
        return pa.table(found, schema=types)

    return scored


class Shard:
    """The postings of some terms in one shard."""

    def __init__(self, postings: pa.Table, sizes: np.ndarray, mean: float, k1: float, b: float):
        self.sizes, self.mean, self.k1, self.b, self.looked_at = sizes, mean, k1, b, 0
        self.windows = -(-len(sizes) // WINDOW)
        self.terms = {}
        for term, docs, tfs, windows, best, then in zip(*(postings.column(c).to_pylist() for c in ("term", "docs", "tfs", "windows", "best", "mean")), strict=True):
            # a larger mean size than the index was made with raises an impact by the ratio of the means at most
            high = np.frombuffer(best, "<f8") * max(1.0, mean / then)
            self.terms[term] = np.frombuffer(docs, "<i4"), np.frombuffer(tfs, "<i4"), np.frombuffer(windows, "<i4"), high

    def best(self, terms: list[str], weights: list[float], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents for a query; equal scores by id. Scores are rounded to six digits."""
        own = [(self.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in self.terms]
        bound = np.zeros(self.windows)
        for (_, _, windows, high), w in own:
            bound[windows] += w * high
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        places, scores, done, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while done < len(order):
            now = order[done : done + step]
            if len(scores) >= k:
                now = now[bound[now] >= scores.min() - 2e-6]
                if not len(now):
                    break
            at, got = self._scores(own, np.sort(now))
            places, scores = np.concatenate([places, at]), np.concatenate([scores, got])
            keep = np.lexsort((ids[places], -scores))[:k]
            places, scores = places[keep], scores[keep]
            done, step = done + step, step * 2
            self.looked_at += len(now)
        return places, scores

    def _scores(self, own: list, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores above 0 of the documents of some windows."""
        total = np.zeros((len(windows), WINDOW))
        row = np.full(self.windows, -1)
        row[windows] = np.arange(len(windows))
        for (docs, tfs, _, _), w in own:
            if len(windows) * 8 < self.windows:  # few windows: find their postings by bisection
                a, z = np.searchsorted(docs, windows * WINDOW), np.searchsorted(docs, (windows + 1) * WINDOW)
                at = np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange((z - a).sum())
            else:
                at = np.flatnonzero(row[docs // WINDOW] >= 0)
            d = docs[at]
            total[row[d // WINDOW], d % WINDOW] += w * _impact(tfs[at], self.sizes[d], self.mean, self.k1, self.b)
        r, c = np.nonzero(total > 0)
        score = np.round(total[r, c], 6)
        keep = score > 0
        return (windows[r] * WINDOW + c)[keep], score[keep]
