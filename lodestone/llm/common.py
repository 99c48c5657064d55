"""What the operators share: scratch tables, Arrow batches cut by bytes, hashed words and streamed groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import materialise, scratch  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that more than one in so many rows has is hot.
MOST_HOT = 1000


def with_hot(rows: DataFrame, dim: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with dim, which has one row a key and says in `weight` how many rows have it.

    Keys of more than one in MOST_HOT rows are joined by a broadcast of fewer than MOST_HOT rows, so no task gathers theirs.
    """
    many = (dim.agg(F.sum(weight)).first()[0] or 0) // MOST_HOT
    hot, rest = F.broadcast(dim.where(F.col(weight) > many)), dim.where(F.col(weight) <= many)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(dim.where(F.col(weight) > many).select(key)), key, "left_anti").join(rest, key))


def bounded(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of so many rows at most: texts are long, and Spark's default of 10,000 is more than workers should hold twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Byte maps that lower-case A-Z and turn what separates words into blanks.
ALNUM = bytes.maketrans(_UPPER, _LOWER)
ALNUM = bytes(32 if b in _SEPARATORS and b not in _UPPER else ALNUM[b] for b in range(256))
SPACED = bytes(32 if b in b"\t\n\x0b\x0c\r" else bytes.maketrans(_UPPER, _LOWER)[b] for b in range(256))
CASED = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two fields and a base in each: a word is named by its polynomials in both.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_001))
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _FIELDS]


def _power(field: int, n: int) -> list[np.ndarray]:
    """Powers of a field's base and of its inverse, n of each at least, by doubling."""
    p, base = _FIELDS[field]
    for k, b in enumerate((base, pow(base, -1, p))):
        while len(x := _powers[field][k]) < n:
            _powers[field][k] = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
    return _powers[field]


def hashed(texts: list[bytes], to: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 62-bit name of each blank-separated word of all texts, in order, mixed, and where each text's words begin and end.

    A word's bytes are coefficients of a polynomial; its values at one point in two prime fields come from one prefix sum
    each. Two different words of n bytes agree in both with a probability below (n / 2**31)**2, whatever their structure.
    """
    raw = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(to), np.uint8)
    gap = raw == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    words = np.zeros(len(starts), np.uint64)
    coefficients = raw.astype(np.uint64) + np.uint64(1)
    for field, (p, _) in enumerate(_FIELDS):
        up, down = _power(field, len(raw))
        terms = coefficients * up[: len(raw)]
        if len(raw) > 1 << 24:  # a prefix sum of more terms of 40 bits would not fit
            terms %= np.uint64(p)
        sums = np.cumsum(terms)
        words = (words << np.uint64(31)) | (((sums[ends - 1] - sums[starts - 1]) % np.uint64(p)) * down[starts] % np.uint64(p))
    begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) if texts else np.ones(1, int)
    return mix(words), np.searchsorted(starts, begins)


def word_hash(words: list[str], to: bytes = ALNUM) -> np.ndarray:
    return hashed([w.encode() for w in words], to)[0]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of about so many bytes of text at most, or one row; with the texts. No text is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, as_bytes(part.column(part.schema.get_field_index(text)))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys from batches in which these are neighbours; one group is in memory at a time.

    Callers bound what a group can hold before they shuffle.
    """
    held: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        new = np.zeros(part.num_rows, bool)
        for k in keys:
            c = part.column(k).combine_chunks()
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        if held:
            new[0] = any(held[-1].column(k)[-1] != part.column(k)[0] for k in keys)
        cuts = [*np.flatnonzero(new), part.num_rows]
        if not new[0]:
            held.append(part.slice(0, cuts[0]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held:
                yield pa.concat_tables(held)
            held = [part.slice(a, b - a)]
    if held:
        yield pa.concat_tables(held)


def hosts_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
