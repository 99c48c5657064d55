"""Bound-certified repacking: each partition packs best fit decreasing, a lower bound says whether that is the least, and what is not goes round again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, table
from lodestone.llm.packing import tokens

CAPACITY = 4096
#: Pieces that one partition packs, on average; what it gives to the exchange is dealt to partitions of that size again.
PARTITION_PIECES = 1 << 14
#: Rounds after which a packing stands, certified or not; a round that saves no sequence ends the exchange sooner.
MOST_ROUNDS = 8
PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = _ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64())).append(pa.field("given", pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    row, coder = (task.partitionId() if task else 0) << 33, tokens(path)
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part, out = batch.slice(a, 200), []
            for doc, ids in zip(part.column(0).to_pylist(), coder.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                raw = ids.tobytes()
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    size = min(capacity, len(ids) - start)
                    out.append((row, doc, piece, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])))
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of counts[i] pieces of sizes[i] (1 to capacity) undercuts.

    The largest of the sums under dual feasible functions: sizes themselves; those that round large sizes up and leave small
    ones out; those that round down to k-ths; those that count what large sizes leave room for. All in whole numbers.
    """
    if not len(sizes):
        return 0
    have = np.zeros(capacity + 1, np.int64)
    np.add.at(have, sizes, counts)
    x = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.concatenate([[0], np.cumsum(have)]), np.concatenate([[0], np.cumsum(have * x)])  # of sizes below each
    best = -(-int(volume[-1]) // capacity)
    cut = np.arange(capacity // 2 + 1)
    rounded = capacity * (number[-1] - number[capacity - cut + 1]) + volume[capacity - cut + 1] - volume[cut]
    best = max(best, -(-int(rounded.max()) // capacity))
    own, many = np.flatnonzero(have), have[have > 0]
    for k in range(1, 101):
        up = (k + 1) * own
        best = max(best, -(-int((np.where(up % capacity == 0, k * own, up // capacity * capacity) * many).sum()) // (k * capacity)))
    large = own > capacity // 2
    room, n_large, small, n_small = capacity - own[large], many[large], own[~large], many[~large]
    left = np.concatenate([np.cumsum(n_small[::-1])[::-1], [0]])  # small pieces from each size up
    for e, from_e in zip(small.tolist(), left.tolist(), strict=False):
        q = capacity // e
        best = max(best, -(-int(((q - room // e) * n_large).sum() + from_e) // q))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin and offset of each piece, fill of each bin): longest first, each into the fullest bin that has room."""
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r left
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fitting := open_ >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = spaces[room].pop()
            if not spaces[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            spaces[room].append(b)
            open_ |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def given_away(lengths: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a partition go to the exchange: with a certified count the emptiest one alone, else all that are not full."""
    away = np.zeros(len(fill), bool)
    sizes, counts = np.unique(lengths, return_counts=True)
    if lower_bound(sizes, counts, capacity) == len(fill):
        away[np.argmin(fill)] = fill.min() < capacity
    else:
        away = fill < capacity
    return away


def _packer(capacity: int, round_: int, last: bool):
    """What packs one partition; bins that it gives away are marked, none in the last round."""

    def packed(pieces: pa.Table) -> pa.Table:
        part = pieces.column("part")[0].as_py()
        pieces = pieces.select(_ARROW.names).sort_by("row")
        lengths = pieces.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        away = np.zeros(len(fill), bool) if last else given_away(lengths, fill, capacity)
        for name, values in (("sequence_id", bins + (round_ << 46) + (part << 22)), ("offset", offsets), ("given", away[bins])):
            pieces = pieces.append_column(_PACKED.field(name), pa.array(values))
        return pieces

    return packed


def repack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pieces of every document's tokens in as few sequences of at most capacity tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than a sequence are cut; full pieces are sequences of their own. The others are dealt to partitions
    of a bounded number of pieces, by a hash of their place in the token table, so neither a hot id nor copies gather. Each
    partition packs best fit decreasing and compares its count with a lower bound. A partition with a gap gives the pieces of
    all bins that are not full to the exchange, a certified one those of its emptiest bin; what is given is dealt anew and
    packed again, until it fits one partition or a round saves no sequence, in which case the packing before it stands.

    Null and empty texts are the end id alone; null ids are kept; repeated rows are packed as often as they come; an empty
    table gives no rows; other columns are ignored, whatever their names. A very long text is one row of ids in a worker,
    cut there. Tokens are written once, so a lost executor costs the tasks it ran.
    """
    rows = materialise(bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity), PIECE), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).select(*names)]
    now, before, spent = rows.where(F.col("length") < capacity), None, 0
    for round_ in range(MOST_ROUNDS):
        n = now.count()
        parts = max(1, -(-n // partition_pieces))
        last = parts == 1 or round_ == MOST_ROUNDS - 1
        dealt = now.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts))).repartition(parts, "part")
        packed = materialise(dealt.groupBy("part").applyInArrow(_packer(capacity, round_, last), PIECE + ", sequence_id long, offset long, given boolean"), "packed")
        first = F.col("offset") == 0
        count, given = packed.agg(F.count_if(first), F.count_if(first & F.col("given"))).first()
        if before is not None and count >= spent:
            done.append(before.select(*names))
            break
        done.append(packed.where("not given").select(*names))
        if not given:
            break
        before, spent = packed.where("given"), given
        now = before.drop("sequence_id", "offset", "given")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, a lower bound of them) of a packing of whole documents; the driver sees one count for each length."""
    sizes = packed.groupBy("length").count().collect()
    bound = lower_bound(np.array([r["length"] for r in sizes], np.int64), np.array([r["count"] for r in sizes], np.int64), capacity)
    return packed.where("offset = 0").count(), bound


def op11_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repack(table(spark, sf_dir, "documents"))
