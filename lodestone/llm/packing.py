"""Harmonic packing: token pieces of reciprocal-capacity classes, a fixed number to a bin, each worker on its own."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import bounded, table

CAPACITY, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: A document's rest is cut into powers of two down to this; what is left is one piece.
LEAST_PIECE = 64
#: Words whose ids a worker remembers before it starts anew, and their longest: text without blanks must not fill its memory.
REMEMBERED, LONGEST = 400_000, 64
SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_STEM = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
_loaded: dict = {}


class Known(dict):
    """Ids by blank-separated word, as bytes, filled as words come.

    The tokenizer lower-cases and parts letters from signs: an ASCII word is its lower-case stem, which is one word of the
    model, and its signs.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.pieces, self.encode = tokenizer.model.tokenize, tokenizer.encode

    def __missing__(self, word: str) -> bytes:
        if m := _STEM.fullmatch(word):
            stem, signs = m[1].lower(), m[2]
            if signs or stem != word:
                out = self[stem] + (self[signs] if signs else b"")
            else:
                ids = [t.id for t in self.pieces(stem)]
                out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            ids = self.encode(word, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            self[word] = out
        return out


class Tokens:
    """Ids of a text, from ids of its blank-separated words, which this tokenizer never joins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = Known(self.tokenizer)
        get, end = self.known.__getitem__, struct.pack("<I", END_ID)
        return [np.frombuffer(b"".join([*map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")), end]), "<u4") for t in texts]


def tokens(path: str | None) -> Tokens:
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST_PIECE) -> list[int]:
    """Piece lengths of a document of n tokens: whole bins, then halves, quarters and so on, then the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= least:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one worker: a piece of class k (longer than capacity/(k+1), at most capacity/k) shares a bin with k - 1 others."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.open = first, capacity, {}

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.close(self.open.pop(k)) if len(bin_) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """Bins that no class has filled: their pieces, longest first, go into common bins."""
        out, held, used = [], [], 0
        for p in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2]):
            if used + p[2] > self.capacity:
                out += self.close(held)
                held, used = [], 0
            held.append(p)
            used += p[2]
        self.open = {}
        return out + (self.close(held) if held else [])


def _packed(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, least: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    bins, coder = Bins((task.partitionId() if task else 0) << 40, capacity), tokens(path)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)

    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part, out = batch.slice(a, 200), []
            for doc, ids in zip(part.column(0).to_pylist(), coder.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                start, raw = 0, ids.tobytes()
                for size in cuts(len(ids), capacity, least):
                    out += bins.add((doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), len(ids)))
                    start += size
            if out:
                yield made(out)
    if out := bins.rest():
        yield made(out)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, least_piece: int = LEAST_PIECE) -> DataFrame:
    """Pieces of every document's tokens in sequences of at most capacity tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; a null doc_id stays null. Repeated rows are packed as often as they come; an
    empty table gives no rows; columns beside doc_id and text are ignored, whatever their names. A very long text is one
    array of ids in a worker, and words of more than LONGEST characters are not remembered there. Ids depend on how the input is partitioned, not on which executor runs a task, so a lost task is run again with
    the same result. A worker holds at most one open bin for each class, and leaves one bin partly filled.
    """
    return bounded(docs).select("doc_id", "text").mapInArrow(partial(_packed, path=tokenizer, capacity=capacity, least=least_piece), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
