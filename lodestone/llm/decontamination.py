"""Benchmark decontamination: an FM-index over each shard of documents, searched backwards for the benchmark's windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, bounded, hashed, materialise, slices, table

#: Words of a window; a document is contaminated when 1 in SHARE of its words is hit.
WINDOW, SHARE = 13, 20
#: Benchmark bytes searched in one pass (a worker holds some 20 times as many), text bytes of a shard, and the text distance of sampled suffixes.
BLOCK_BYTES, SHARD_BYTES, SAMPLED = 2_000_000, 2_000_000, 8
RESULT = "doc_id long, text_hash long, n_words long, begins array<long>, ends array<long>, items array<string>"


class FMIndex:
    """Burrows-Wheeler transform of a symbol sequence in a wavelet matrix, with every SAMPLED-th suffix position kept."""

    def __init__(self, symbols: np.ndarray):
        """symbols: non-negative; 0 is in no pattern."""
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        self.n, self.levels = len(text), max(1, int(text.max()).bit_length())
        order = self._suffixes(text)
        bwt = text[order - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.ones, self.zeros = [], []
        now = bwt
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        kept = order % SAMPLED == 0
        self.kept_before, self.positions = np.concatenate([[0], np.cumsum(kept)]), order[kept]
        self.kept = kept

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; the end symbol 0 is unique and least."""
        n, step = len(text), 1
        rank = text.copy()
        while True:
            key = rank * (rank.max() + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ranked = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
            rank = np.empty(n, np.int64)
            rank[order] = ranked
            if ranked[-1] == n - 1:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start = np.zeros(len(at), np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            bit, ones = (symbol >> level) & 1, self.ones[k]
            to = lambda i, bit=bit, ones=ones, k=k: np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
            at, start = to(at), to(start)
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each pattern: patterns is right-aligned, one a row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            alive = alive[(lengths[alive] > k) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = patterns[alive, patterns.shape[1] - 1 - k] + 1
            inside = c < len(self.counts) - 1
            high[alive[~inside]] = low[alive[~inside]] = 0
            alive, c = alive[inside], c[inside]
            low[alive], high[alive] = self.counts[c] + self.rank(c, low[alive]), self.counts[c] + self.rank(c, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back to a sampled one."""
        out, steps, at = np.zeros(len(rows), np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.positions[self.kept_before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.symbol(at)
            at = self.counts[c] + self.rank(c, at)
            steps += 1
        return out


class Windows:
    """The distinct windows of benchmark items: words as numbers from 1, right-aligned patterns, and the items of each (without null ids)."""

    def __init__(self, ids: list[str | None], texts: list[bytes], width: int):
        words, first = hashed(texts, ALNUM)
        self.vocabulary = np.unique(words)
        number = np.searchsorted(self.vocabulary, words) + 1
        found: dict[tuple, set] = {}
        for k, item in enumerate(ids):
            own = number[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[i : i + width]), set()).update(() if item is None else (item,))
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for k, w in enumerate(found):
            self.patterns[k, width - len(w) :] = w
        self.items = [sorted(x) for x in found.values()]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)


def occurrences(words: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every place where a window's words stand, from an index of the shard.

    Runs of benchmark words shorter than the shortest window can hold none, so the index leaves them out.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(windows.lengths) or not len(words):
        return none
    numbers = np.concatenate([[0], windows.numbers(words), [0]])
    edges = np.flatnonzero((numbers[1:] != 0) != (numbers[:-1] != 0))
    starts, ends = edges[0::2], edges[1::2]  # in words
    long = ends - starts >= windows.lengths.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    sizes = ends - starts + 1  # with a 0 behind each run
    begins = np.cumsum(sizes) - sizes
    at = np.repeat(starts - begins, sizes) + np.arange(sizes.sum())
    index = FMIndex(numbers[at + 1])
    low, high = index.search(windows.patterns, windows.lengths)
    many = np.maximum(high - low, 0)
    rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    return at[index.locate(rows)], np.repeat(np.arange(len(many)), many)


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    return edges[0::2].tolist(), edges[1::2].tolist()


def shard_hits(texts: list[bytes], windows: Windows) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
    """For each text of a shard: words, merged removal spans in words, and the items found."""
    words, first = hashed(texts, ALNUM)
    numbered = np.insert(words, first[1:-1], np.uint64(0)) if len(texts) > 1 else words  # no window crosses two texts
    shift = np.arange(len(texts))
    at, which = occurrences(numbered, windows)
    doc = np.searchsorted(first[1:] + shift, at, side="right")
    by = np.argsort(doc, kind="stable")
    at, which, cuts = at[by], which[by], np.searchsorted(doc[by], np.arange(len(texts) + 1))
    for k in range(len(texts)):
        n, (a, b) = int(first[k + 1] - first[k]), cuts[k : k + 2]
        if a == b:
            yield n, [], [], []
            continue
        marks = np.zeros(n + 1, np.int64)
        begin = at[a:b] - first[k] - shift[k]
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + windows.lengths[which[a:b]], -1)
        yield n, *_spans((np.cumsum(marks)[:n] > 0).astype(np.int8)), sorted({i for w in np.unique(which[a:b]) for i in windows.items[w]})


def _searched(batches: Iterator[pa.RecordBatch], windows) -> Iterator[pa.RecordBatch]:
    import xxhash

    names = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    for batch, texts in slices(batches, limit=SHARD_BYTES):
        n, begins, ends, items = zip(*shard_hits(texts, windows.value), strict=True)
        keys = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([batch.column(0).cast(pa.int64()), keys, n, begins, ends, items], names, strict=True)], schema=names)


def benchmark_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Windows]:
    """Windows of the benchmark's items in blocks of a bounded size; null texts and texts without words have none."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // block_bytes)))))
    for k in sorted(r["block"] for r in keyed.select("block").distinct().collect()) or [0]:
        part = keyed.where(F.col("block") == k).toArrow()
        yield Windows(part.column("item_id").to_pylist(), [t.encode() for t in part.column("text").to_pylist()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, begins and ends of merged removal spans (in words), items: what the benchmark's windows hit.

    The benchmark is the stated query set: it goes to the workers in blocks of block_bytes, one pass over the documents
    for each; spans of several passes are merged by id and text. Null and empty texts have no words and no hits; repeated
    rows give a row each (with several passes, equal rows are one row with a count while spans are merged). Windows of items
    with a null id hit like others; items lists no null. An empty benchmark hits nothing, an empty table gives no rows; very
    long texts are one shard; other columns are ignored, whatever their names.
    """
    spark, parts = bounded(docs).sparkSession, []
    for windows in benchmark_blocks(benchmark, width, block_bytes):
        shared = spark.sparkContext.broadcast(windows)
        parts.append(docs.select("doc_id", "text").mapInArrow(lambda batches, shared=shared: _searched(batches, shared), RESULT))
    if len(parts) == 1:
        return parts[0]
    every = parts[0].withColumn("block", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("block", F.lit(k)))
    key = ["doc_id", "text_hash"]
    once = materialise(every.groupBy(*key, "block").agg(*[F.first(c).alias(c) for c in ("n_words", "begins", "ends", "items")], F.count("*").cast("int").alias("copies")), "block-hits")
    marks = F.struct(F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
    names = once.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged_spans(once.select(*key, F.explode(F.arrays_zip("begins", "ends")).alias("s")).select(*key, F.col("s.begins").alias("begin"), F.col("s.ends").alias("end")), key)
    both = names.withColumn("span", marks).unionByName(merged.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("copies", "int"), ("items", "array<string>"))], F.struct("begin", "end").alias("span")))
    spans = F.array_sort(F.collect_list(F.when(F.col("span.begin").isNotNull(), F.col("span"))))
    whole = both.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("items", ignorenulls=True).alias("items"), spans.alias("spans"))
    return whole.select(*key, "n_words", F.transform("spans", lambda x: x["begin"]).alias("begins"), F.transform("spans", lambda x: x["end"]).alias("ends"), "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, begin, end: spans (key, begin, end) of one key that touch or overlap made one, by a sweep: sorted begins and the running largest end."""
    w = W.partitionBy(*key).orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0))
    return apart.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*key, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def _hit(batches: Iterator[pa.RecordBatch], windows, block: int) -> Iterator[pa.RecordBatch]:
    names = pa.schema([("text_md5", pa.string()), ("block", pa.int32()), ("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    for batch, texts in slices(batches, limit=SHARD_BYTES):
        hits = [(k, n, begins, ends) for k, (n, begins, ends, _) in enumerate(shard_hits(texts, windows.value)) if begins]
        keys = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array([block] * len(hits), pa.int32()), *[pa.array([h[c] for h in hits], names[c + 1].type) for c in (1, 2, 3)]], schema=names)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """text_md5 of every contaminated text, once: hits of all blocks of the benchmark are merged by text, so ids play no part.

    Copies of a text are one row for each block before its hits are collected, which bounds a group by the text's own words.
    """
    spark, own, parts = bounded(docs).sparkSession, docs.select(F.md5("text").alias("text_md5"), "text"), []
    for block, windows in enumerate(benchmark_blocks(benchmark, width, block_bytes)):
        shared = spark.sparkContext.broadcast(windows)
        parts.append(own.mapInArrow(lambda batches, shared=shared, block=block: _hit(batches, shared, block), "text_md5 string, block int, n_words long, begins array<long>, ends array<long>"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    once = materialise(every.groupBy("text_md5", "block").agg(*[F.first(c).alias(c) for c in ("n_words", "begins", "ends")]), "block-hits") if len(parts) > 1 else every.dropDuplicates(["text_md5", "block"])
    if len(parts) == 1:
        hit = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)
        merged = once.select("text_md5", "n_words", hit.alias("n_hit"))
    else:
        spans = once.select("text_md5", F.explode(F.arrays_zip("begins", "ends")).alias("s")).select("text_md5", F.col("s.begins").alias("begin"), F.col("s.ends").alias("end"))
        hits = merged_spans(spans, ["text_md5"]).groupBy("text_md5").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"))
        merged = hits.join(once.groupBy("text_md5").agg(F.max("n_words").alias("n_words")), "text_md5")
    return merged.where(f"n_hit > 0 and {SHARE} * n_hit >= n_words").select("text_md5")


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP6_SQL = rf"""
WITH split AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT kind, r, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM split),
windows AS (SELECT DISTINCT id AS item_id, words[i : i + {WINDOW - 1}] AS win FROM (SELECT id, words, unnest(range(1, greatest(len(words) - {WINDOW - 1}, 1) + 1)) AS i FROM w WHERE kind = 1 AND len(words) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
places AS (SELECT r, i, k, words[i : i + k - 1] AS win FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, sizes WHERE kind = 0 AND len(words) >= k)),
found AS (SELECT r, i, k, item_id FROM places JOIN windows USING (win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY r)
SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hits USING (r) LEFT JOIN items USING (r) WHERE kind = 0
"""
