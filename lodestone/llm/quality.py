"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import CASED, bounded, hashed, materialise, mix, slices, table
from lodestone.llm.training import MOST_LABELLED, calibration_fold, held_out, labelled_sample

#: Bytes of text whose words' vectors are in memory at a time, and whose contexts are; distinct tokens that a task adds up at a time.
PART, SUMMED, DISTINCT = 1 << 18, 1 << 20, 2_000_000
#: Width of vectors, nonzero places of an index vector, words to each side, words and shapes with a vector (a bound on the broadcast).
WIDTH, SPARSE, REACH, MOST_WORDS = 64, 6, 2, 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED, THRESHOLD = 32, 40, 128, 3e-3, 1e-4, 11, 0.3
_U = np.uint64
_KINDS = np.zeros(256, np.uint8)
for _b in range(256):
    _KINDS[_b] = 32 if _b in b" \t\n\x0b\x0c\r" else ord("a") if 97 <= _b <= 122 or _b >= 128 else ord("A") if 65 <= _b <= 90 else ord("0") if 48 <= _b <= 57 else _b
#: What a shape's hash is combined with when the word repeats the one before, or any earlier one of its text.
_AGAIN, _BEFORE = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, of their shapes (runs of one kind of character as one) and where texts begin.

    A shape also says whether the word repeats the one before it or stood earlier in its text.
    """
    words, first = hashed(texts, CASED)
    kinds = _KINDS[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    keep = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    shapes, _ = hashed([kinds[keep].tobytes()], CASED)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]) if len(words) else np.zeros(0, bool)
    new = np.zeros(len(words), bool)
    new[np.unique(words ^ mix(doc.astype(_U)), return_index=True)[1]] = True
    shapes = np.where(again, mix(shapes ^ _AGAIN), np.where(new, shapes, mix(shapes ^ _BEFORE)))
    return words, shapes, first


def index_places(tokens: np.ndarray) -> np.ndarray:
    """Where each token's sparse ternary index vector is not zero: twice the place, and one more where it is -1. From the token's hash alone."""
    out = np.empty((len(tokens), SPARSE), np.int64)
    for k in range(SPARSE):
        h = mix(tokens + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        out[:, k] = (h % _U(WIDTH)) * _U(2) + ((h >> _U(40)) & _U(1) ^ _U(1))
    return out


def contexts(tokens: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """For each token of a sorted vocabulary the sum of the index vectors of its neighbours there."""
    if not len(tokens) or not len(vocabulary):
        return np.zeros((len(vocabulary), WIDTH), np.int64)
    known, number = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, known), len(vocabulary) - 1)
    row, places = np.where(vocabulary[at] == known, at, -1)[number], index_places(known)
    cells = []
    for k in range(1, REACH + 1):
        same = doc[k:] == doc[:-k]
        for centre, other in ((row[k:], number[:-k]), (row[:-k], number[k:])):
            use = same & (centre >= 0)
            cells.append((centre[use, None] * (2 * WIDTH) + places[other[use]]).ravel())
    n = np.bincount(np.concatenate(cells), minlength=len(vocabulary) * 2 * WIDTH).reshape(-1, WIDTH, 2)
    return n[:, :, 0] - n[:, :, 1]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of (tokens, counts) pairs with the sums of their counts."""
    known, number = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return known, np.bincount(number, weights=np.concatenate([n for _, n in parts]), minlength=len(known)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n) of a task's texts, added up before it leaves; beyond DISTINCT tokens a task starts a new sum."""
    held: list[list] = [[], []]

    def out(kind: int) -> pa.RecordBatch:
        known, n = _merged(held[kind])
        held[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(known), kind, np.int32)), pa.array(known.view(np.int64)), pa.array(n)], names=["kind", "token", "n"])

    for _, texts in slices(batches):
        for kind, tokens in enumerate(streams(texts)[:2]):
            held[kind].append(np.unique(tokens, return_counts=True))
            if sum(len(t) for t, _ in held[kind]) > DISTINCT:
                held[kind] = [_merged(held[kind])]
                if len(held[kind][0][0]) > DISTINCT // 2:
                    yield out(kind)
    for kind in (0, 1):
        if held[kind]:
            yield out(kind)


def _summed(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """(kind, token, v): a task's context sums of the tokens of the vocabulary that it has."""
    sums = [np.zeros((len(v), WIDTH), np.int64) for v in vocabulary.value]
    for _, texts in slices(batches, limit=SUMMED):
        words, shapes, first = streams(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        for kind, tokens in enumerate((words, shapes)):
            sums[kind] += contexts(tokens, doc, vocabulary.value[kind])
    for kind, total in enumerate(sums):
        some = np.flatnonzero(total.any(1))
        for k in range(0, len(some), 4096):
            part = some[k : k + 4096]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(total[part].ravel()), WIDTH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(vocabulary.value[kind][part].view(np.int64)), flat], names=["kind", "token", "v"])


class Vectors:
    """Unit vectors of the most frequent tokens, sorted by token; a word without one has no share in a pool."""

    def __init__(self, token: np.ndarray, vectors: np.ndarray):
        order = np.argsort(token)
        self.token, self.vectors = token[order], vectors[order]

    def pooled(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The mean vector of each text's tokens; zero where none is known."""
        texts = len(first) - 1
        at = np.minimum(np.searchsorted(self.token, tokens), max(0, len(self.token) - 1))
        known = self.token[at] == tokens if len(self.token) else np.zeros(len(tokens), bool)
        doc = np.repeat(np.arange(texts), np.diff(first))[known]
        sums = np.zeros((texts, WIDTH))
        if len(doc):
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            sums[doc[starts]] = np.add.reduceat(self.vectors[at[known]], starts, axis=0)
        return sums / np.maximum(np.bincount(doc, minlength=texts), 1)[:, None]


def word_vectors(docs: DataFrame, words: int = MOST_WORDS) -> list[Vectors]:
    """Vectors of words and of shapes: the sums of all their neighbours' index vectors over all documents, for the most frequent ones of each kind."""
    texts = bounded(docs).select("text")
    counts = texts.mapInArrow(_counted, "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialise(counts, "token-counts")
    known = [np.sort(counts.where(F.col("kind") == k).orderBy(F.desc("n"), "token").limit(words).toArrow().column("token").to_numpy().view(_U)) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(known)
    sums = texts.mapInArrow(lambda b: _summed(b, shared), "kind int, token long, v array<long>")
    rows = sums.groupBy("kind", "token").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(WIDTH)]).toArrow()
    out = []
    for kind in (0, 1):
        own = rows.filter(pa.compute.equal(rows.column("kind"), kind))
        v = np.column_stack([own.column(f"v{k}").to_numpy() for k in range(WIDTH)]).astype(float) if own.num_rows else np.zeros((0, WIDTH))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        out.append(Vectors(own.column("token").to_numpy().view(_U), v.astype(np.float32)))
    return out


def features(texts: list[bytes], vectors: list[Vectors]) -> np.ndarray:
    words, shapes, first = streams(texts)
    return np.hstack([vectors[0].pooled(words, first), vectors[1].pooled(shapes, first)])


class Network:
    """Two layers with tanh, fitted by Adam on class-weighted cross-entropy; its logits are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, tune: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        fit = np.flatnonzero(~tune)
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for a in range(0, len(fit), BATCH):
                rows = fit[a : a + BATCH]
                hidden = np.tanh(x[rows] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - y[rows]) / len(rows)
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                grads = [x[rows].T @ back + DECAY * self.w[0], back.sum(0), hidden.T @ error + DECAY * self.w[2], error.sum(keepdims=True)]
                step += 1
                for p, g, m_, v_ in zip(self.w, grads, m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.001 * (g * g - v_)
                    p -= RATE * m_ / (1 - 0.9**step) / (np.sqrt(v_ / (1 - 0.999**step)) + 1e-8)
        logits = self._logits(x[tune])
        loss = lambda t: np.mean(np.logaddexp(0, -(2 * y[tune] - 1) * logits / t))
        self.temperature = float(min(np.geomspace(0.25, 8, 200), key=loss)) if tune.any() else 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -50, 50)))


def _featured(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, limit=PART):
        x = features(texts, vectors.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, words: int = MOST_WORDS):
    """Broadcast (vectors, network): vectors of `words` tokens from all documents, a network from at most `most` labelled rows outside the held-out fold.

    Without rows of both classes every text scores the share of good labels (1 without any).
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "quality", most)
    vectors = spark.sparkContext.broadcast(word_vectors(docs, words))
    rows = sample.mapInArrow(lambda b: _featured(b, vectors), "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    y = rows.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return vectors, spark.sparkContext.broadcast(float(y.mean()) if len(y) else 1.0)
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    return vectors, spark.sparkContext.broadcast(Network(x, y, calibration_fold(rows.column("doc_id").to_numpy())))


def _scores(texts: list[bytes], model) -> np.ndarray:
    vectors, network = model[0].value, model[1].value
    return np.full(len(texts), network) if isinstance(network, float) else network.score(features(texts, vectors))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, limit=PART):
        s = _scores(texts, model)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, words: int = MOST_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; a null text is scored as an empty one, each row once, repeated or not.

    Counts and contexts of words come from all documents; words beyond the `words` most frequent have no vector of their own,
    and their shapes stand for them. An empty table gives no rows; a null doc_id stays null and is in no fold; other columns
    are ignored, whatever their names. Very long texts are scored whole.
    """
    model = fit(docs, labels, most, words)
    own = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(lambda b: _scored(b, model), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    model = fit(docs, labels, most)

    def good(batches):
        for batch, texts in slices(batches, limit=PART):
            yield batch.filter(pa.array(_scores(texts, model) >= THRESHOLD))

    return docs.mapInArrow(good, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
