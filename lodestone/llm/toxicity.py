"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ALNUM, CASED, hashed, slices, table, word_hash
from lodestone.llm.training import MOST_LABELLED, calibration_fold, held_out, labelled_sample

#: Insults and slurs' mild forms in four languages, and second-person words.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers clown trash garbage scum worthless pathetic disgusting ugly filth filthy vermin pig rat creep coward liar jerk hate "
    "despise shut kill die dumm dummkopf trottel abschaum ekelhaft versager imbécile stupide crétin ordure minable dégoûtant nul estúpido tonto imbécil basura asqueroso patético inútil"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: Words of the learned lexicon, words between an insult and a second person, and the trees.
LEARNED, NEAR = 150, 5
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2, THRESHOLD = 80, 3, 0.15, 32, 12, 1.0, 0.5
FEATURES = 18
_U = np.uint64
_KNOWN, _SECOND = np.unique(word_hash(INSULTS)), np.unique(word_hash(SECOND_PERSON))


def _kinds() -> np.ndarray:
    """1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other sign, 6 beyond ASCII, 0 blank."""
    out = np.full(256, 5, np.uint8)
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = 1
        elif 65 <= b <= 90:
            out[b] = 2
        elif 48 <= b <= 57:
            out[b] = 3
        elif b in b".,;:'\"-()":
            out[b] = 4
        elif b >= 128:
            out[b] = 6
        elif b <= 32:
            out[b] = 0
    return out


_KIND = _kinds()


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])[first])


def features(texts: list[bytes], learned: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Densities, proximities and rates of each text; zeros for a text without words.

    learned: sorted hashes of the learned lexicon; weight: the log odds of each.
    """
    words, first = hashed(texts, ALNUM)
    n = np.maximum(np.diff(first), 1)
    base, own, second = _among(words, _KNOWN), _among(words, learned), _among(words, _SECOND)
    odds = np.zeros(len(words))
    if len(learned):
        odds[own] = weight[np.searchsorted(learned, words[own])]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    near = np.zeros(len(words), bool)
    bad = base | own
    for k in range(1, NEAR + 1):
        same = doc[k:] == doc[:-k]
        near[k:] |= bad[k:] & second[:-k] & same
        near[:-k] |= bad[:-k] & second[k:] & same
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kinds = _KIND[raw]
    size = np.maximum(np.diff(begins) - 1, 1)
    part = lambda flags: _sums(flags, begins) / size
    letter = (kinds == 1) | (kinds == 2)
    inside = np.zeros(len(raw), bool)  # a digit or sign between letters
    inside[1:-1] = letter[:-2] & letter[2:] & ((kinds[1:-1] == 3) | (kinds[1:-1] == 5))
    same3 = np.zeros(len(raw), bool)
    same3[2:] = (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & letter[2:]
    words_c, first_c = hashed(texts, CASED)
    repeat = np.concatenate([[False], words_c[1:] == words_c[:-1]]) if len(words_c) else np.zeros(0, bool)
    letters, hits = np.maximum(_sums(letter, begins), 1), _sums(bad, first)
    odds_sum = _sums(odds, first)
    return np.column_stack([
        _sums(base, first), _sums(own, first), _sums(base, first) / n, _sums(own, first) / n, odds_sum, odds_sum / n, hits / np.sqrt(n), _sums(near, first), _sums(near, first) / n,
        _sums(second, first) / n, _sums(kinds == 2, begins) / letters, part(kinds == 4), part(raw == 33), part(kinds == 5), part(kinds == 3), _sums(inside, begins) / n, _sums(same3, begins) / n, _sums(repeat, first_c) / n,
    ])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents that have it, toxic documents that have it) for each part of the sample."""
    for batch, texts in slices(batches):
        words, first = hashed(texts, ALNUM)
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        each = [np.unique(words[a:b]) for a, b in zip(first, first[1:], strict=False)]
        if not any(map(len, each)):
            continue
        toxic = np.repeat(label, [len(x) for x in each])
        known, number, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(count.astype(np.int64)), pa.array(np.bincount(number, weights=toxic, minlength=len(known)).astype(np.int64))], names=["word", "n", "toxic"])


def learned_lexicon(sample: DataFrame, fit_only) -> tuple[np.ndarray, np.ndarray]:
    """The words most bound to toxic documents: the LEARNED largest by a lower bound of the log odds, with their log odds."""
    fitted = sample.where(fit_only)
    total = fitted.agg(F.count("*"), F.sum("label")).first()
    every, bad = total[0], total[1] or 0
    counts = fitted.select("text", "label").mapInArrow(_word_counts, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    odds = F.log(a / (bad - F.col("toxic") + 0.5)) - F.log(b / (every - bad - F.col("n") + F.col("toxic") + 0.5))
    bound = odds - 2 * F.sqrt(1 / a + 1 / b)
    rows = counts.where("toxic >= 4").select("word", odds.alias("odds"), bound.alias("bound")).where("bound > 0").orderBy(F.desc("bound"), "word").limit(LEARNED).toArrow()
    words = rows.column("word").to_numpy().view(_U)
    order = np.argsort(words)
    return words[order], rows.column("odds").to_numpy()[order]


class Trees:
    """Boosted regression trees on binned features, by Newton steps of the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = self._bins(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            raw += self._apply(tree, binned)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)])

    def _grow(self, x, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -RATE * total_g / (total_h + L2)
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF:
            return leaf
        best = (1e-3, None, None)
        for k in range(x.shape[1]):
            b = x[rows, k]
            left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=BINS + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = left_g**2 / (left_h + L2) + (total_g - left_g) ** 2 / (total_h - left_h + L2) - total_g**2 / (total_h + L2)
            gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), k, int(gain.argmax()))
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[left], depth + 1), self._grow(x, g, h, rows[~left], depth + 1)

    def _apply(self, tree, x) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        left, out = x[:, tree[0]] <= tree[1], np.empty(len(x))
        out[left], out[~left] = self._apply(tree[2], x[left]), self._apply(tree[3], x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.start + sum(self._apply(t, b) for t in self.trees)


class Isotonic:
    """The monotone step function from raw scores to shares of label 1, by pooling adjacent violators; one row of each label is added at the ends."""

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        order = np.argsort(raw, kind="stable")
        pools: list[list[float]] = []
        for x, t in [(raw[order][0], 0.0), *zip(raw[order], y[order].astype(float), strict=True), (raw[order][-1], 1.0)]:
            pools.append([x, t, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, t1, n1 = pools.pop()
                pools[-1][1] += t1
                pools[-1][2] += n1
        self.at, self.value = np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        # a small share of the raw score keeps the order within a pool
        step = self.value[np.maximum(np.searchsorted(self.at, raw, side="right") - 1, 0)]
        return np.clip(0.999 * step + 0.001 / (1 + np.exp(-np.clip(raw, -50, 50))), 0, 1)


class Model:
    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray], constant: float | None = None):
        self.lexicon, self.constant = lexicon, constant

    def fit(self, x: np.ndarray, y: np.ndarray, tune: np.ndarray) -> Model:
        self.trees = Trees(x[~tune], y[~tune])
        rows = tune if 0 < y[tune].sum() < tune.sum() else np.ones(len(y), bool)
        self.calibrate = Isotonic(self.trees.raw(x[rows]), y[rows])
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.calibrate(self.trees.raw(features(texts, *self.lexicon)))


def _featured(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        x = features(texts, *lexicon)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """A broadcast model, learned from at most `most` labelled rows outside the held-out fold; with one class only, a constant.

    The calibration fold of the sample has no part in the lexicon or the trees.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", most)
    ids = sample.select("doc_id", "label").toArrow().sort_by("doc_id")
    y = ids.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        return spark.sparkContext.broadcast(Model((np.empty(0, _U), np.empty(0)), float(y.mean()) if len(y) else 0.0))
    tuned = [int(d) for d, t in zip(ids.column("doc_id").to_pylist(), calibration_fold(ids.column("doc_id").to_numpy()), strict=True) if t]
    fold = spark.createDataFrame([(d,) for d in tuned] or [(None,)], "doc_id long").withColumn("tune", F.lit(True))
    marked = sample.join(F.broadcast(fold), "doc_id", "left")
    lexicon = learned_lexicon(marked, F.col("tune").isNull())
    rows = sample.mapInArrow(lambda b: _featured(b, lexicon), "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    y = rows.column("label").to_numpy()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    return spark.sparkContext.broadcast(Model(lexicon).fit(x, y, calibration_fold(rows.column("doc_id").to_numpy())))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, each row once.

    A null text is scored as an empty one, a null doc_id is not held out, repeated rows and ids each give a row, and an empty
    table gives none. Labels that are null, of no document, or without any row of either kind are learned from as far as they
    go: without both kinds every text gets one score. Very long texts are one row in a worker; columns beside doc_id and text
    are ignored, whatever their names.
    """
    model = fit(docs, labels, most)

    def scored(batches):
        for batch, texts in slices(batches):
            s = model.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
