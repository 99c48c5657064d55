"""Importance resampling towards a target: hashed n-gram streams are written once, sorted and run-length encoded for counts, then read again for gains."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, bounded, materialise, slices, table
from lodestone.operators.numbering import numbered

#: Words of the longest feature, hash buckets (at most 65,536), seed of the draw, words a drawable document has, hundredths drawn.
MOST_WORDS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 7, 20, 25
#: Words up to so many bytes are hashed side by side; longer ones one at a time.
SHORT_BYTES = 32


def _byte_table() -> np.ndarray:
    """The CRC-32 of each byte value's remainder, by the rule of the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


_BYTE = _byte_table()


def _apply(four: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, as one table for each byte, on many values."""
    return four[0][c & 255] ^ four[1][(c >> 8) & 255] ^ four[2][(c >> 16) & 255] ^ four[3][c >> 24]


def _zeros(powers: int = 31) -> list[np.ndarray]:
    """The maps that append 1, 2, 4, ... zero bytes to what a CRC covers."""
    c = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [(c >> 8) ^ _BYTE[c & 255]]
    while len(out) < powers:
        out.append(_apply(out[-1], out[-1]))
    return out


_ZEROS = _zeros()
_SPACE = np.uint32(zlib.crc32(b" "))


def joined(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of left + b" " + right, from those of left and right and the bytes of right."""
    c = _apply(_ZEROS[0], left) ^ _SPACE
    for k, zeros in enumerate(_ZEROS):
        if not (sizes >> k).any():
            break
        at = np.flatnonzero((sizes >> k) & 1)
        c[at] = _apply(zeros, c[at])
    return c ^ right


def word_crcs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte for all words together, longest first; very long words by themselves."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -SHORT_BYTES))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    order = order[long:]
    at, left = starts[order], sizes[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # words with a byte at k
        c[:n] = _BYTE[(c[:n] ^ raw[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    out[order] = ~c
    return out


def streams(texts: list[bytes], most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features as uint16, document by document; where each document's begin, and the end)."""
    raw = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(ALNUM), np.uint8)
    gap = raw == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    first = np.searchsorted(starts, 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    words = word_crcs(raw, starts, sizes)
    found, there, now = np.zeros((len(words), most_words), np.uint16), np.zeros((len(words), most_words), bool), words
    for k in range(most_words):
        n = len(words) - k
        if n <= 0:
            break
        if k:
            now = joined(now[:n], words[k:], sizes[k:])
        found[:n, k], there[:n, k] = now % buckets, doc[:n] == doc[k:]
    ends = np.concatenate([[0], np.cumsum(there.sum(1))])
    return found[there], ends[first]


def _streamed(batches: Iterator[pa.RecordBatch], most_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        stream, begins = streams(texts, most_words, buckets)
        packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * begins).astype(np.int32)), pa.py_buffer(stream.astype("<u2"))])
        yield pa.RecordBatch.from_arrays([part.column(0), packed], names=[part.schema.names[0], "stream"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The uint16 stream of a binary column and its rows' offsets there."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u2"), (offsets - offsets[0]) // 2


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        run = np.sort(_unpacked(batch.column(0))[0])
        edges = np.flatnonzero(np.concatenate([[len(run) > 0], run[1:] != run[:-1]]))
        total[run[edges]] += np.diff(np.concatenate([edges, [len(run)]]))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stream, begins = _unpacked(batch.column(1))
        n, weights = np.diff(begins), np.zeros(batch.num_rows, np.int64)
        if some := np.flatnonzero(n).tolist():
            weights[some] = np.add.reduceat(gains[stream], begins[some]) // n[some]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(weights)], names=[batch.schema.names[0], "n_features", "weight"])


def bucket_streams(rows: DataFrame, key: str, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """key and stream of every row of (key, text), written: the row's feature buckets as packed little-endian uint16."""
    kind = dict(rows.dtypes)[key]
    return materialise(bounded(rows).select(key, F.col("text").cast("string").alias("text")).mapInArrow(partial(_streamed, most_words=most_words, buckets=buckets), f"{key} {kind}, stream binary"), "streams")


def bucket_counts(streams_: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows are in each bucket: each task sorts what it reads and keeps run lengths, one sum a bucket follows."""
    out = np.zeros(buckets, np.int64)
    counts = streams_.select("stream").mapInArrow(partial(_counted, buckets=buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target's and the source's features, floored."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: a draw without replacement of percent hundredths, by weight plus Gumbel noise.

    Features are runs of 1 to most_words consecutive words, in hashed buckets; a document's weight is the floored mean of
    its features' gains, log ratios of the bucket in target against docs. Noise depends on the seed and doc_id alone. Of the
    documents with at least least_words words the highest scores are drawn and ranked; the others' rank is null.

    What the driver and each worker hold is one count or gain for each bucket. Null and empty texts and texts without words
    have no features and weigh 0; a null doc_id is drawn as an empty one and ranks last among ties; repeated rows are counted
    and drawn as often as they come; an empty docs gives no rows, and an empty target weighs by rarity alone. Very long texts
    are one row of a stream. Other columns are ignored, whatever their names.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")
    own = bucket_streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", most_words, buckets)
    wanted = bucket_streams(target.select(F.lit(0).alias("item"), "text"), "item", most_words, buckets)
    gains = gains_of(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    weighed = own.mapInArrow(partial(_weighed, gains=gains), "doc_id long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_features") >= sum(max(0, least_words - k) for k in range(most_words))
    able = scored.where(enough)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "rank", first=1)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no CRC-32: the table of byte remainders and the fold over a value's UTF-8 bytes, by the rule of the polynomial.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS t"


def crc_sql(value: str, t: str = "t") -> str:
    byte = lambda i: f"(strpos('0123456789abcdef', hx[2 * {i} + 1]) * 16 + strpos('0123456789abcdef', hx[2 * {i} + 2]) - 17)"
    fold = f"list_reduce(range(len(hx) // 2), lambda c, i: xor({t}[(xor(c, {byte('i')}) & 255) + 1], c >> 8), 4294967295)"
    return f"(SELECT xor({fold}, 4294967295) FROM (SELECT lower(hex(encode({value}))) AS hx))"


OP12_SQL = rf"""
WITH crc AS MATERIALIZED ({CRC_TABLE_SQL}),
texts AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT kind, r, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM texts),
f AS MATERIALIZED (SELECT kind, r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
named AS MATERIALIZED (SELECT feature, {crc_sql('feature')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
b AS MATERIALIZED (SELECT kind, r, bucket FROM f JOIN named USING (feature)),
sums AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM b GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS gain FROM sums),
weights AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM b JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, len(words) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN weights USING (r) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n >= {LEAST_WORDS}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM ranked
"""
