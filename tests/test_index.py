"""The kept index and the automaton against brute force."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import automaton as A
from lodestone.operators import index as X
from lodestone.operators.knowledge import longest_matches


def texts(n, seed=1, words=60):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, words + 1)
    return [[f"w{k}" for k in rng.choice(words, rng.integers(0, 40), p=weight / weight.sum())] for _ in range(n)]


def best(docs, query, k, k1=1.2, b=0.75):
    """BM25 by the formula, over all documents."""
    mean = sum(map(len, docs)) / len(docs)
    df = collections.Counter(t for d in docs for t in set(d))
    out = []
    for i, d in enumerate(docs):
        tf = collections.Counter(d)
        s = sum(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / mean)) for t in query if tf[t])
        if round(s, 6) > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def search(index, spark, queries, k):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query long, tokens array<string>")
    got = collections.defaultdict(list)
    for r in sorted(index.search(rows, k).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["doc"], pytest.approx(r["score"], abs=2e-6)))
    return got


def test_index_gives_the_best_and_grows_by_added_documents(spark, tmp_path):
    docs, queries = texts(900), [["w3", "w50", "w3"], ["w59"], ["nowhere"], ["w1", "w2", "nowhere"], []]
    index = X.InvertedIndex(spark, str(tmp_path / "index"), shard=150)
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(None, ["w1"]), (5000, None)], "doc long, tokens array<string>")
    index.add(frame.where("doc < 500 or doc is null or doc = 5000"))
    got = search(index, spark, queries, 7)
    assert {q: got.get(q, []) for q in range(5)} == {q: best(docs[:500], queries[q], 7) for q in range(5)}
    files = set(index._read("postings", X.POSTINGS).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    index.add(frame)  # those that are there already stay as they are
    assert files < set(index._read("postings", X.POSTINGS).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert index.statistics()[0] == 900
    got = search(index, spark, queries, 7)
    assert {q: got.get(q, []) for q in range(5)} == {q: best(docs, queries[q], 7) for q in range(5)}


def test_only_files_of_the_terms_are_read_and_a_dead_add_counts_for_nothing(spark, tmp_path):
    index = X.InvertedIndex(spark, str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([(1, ["a"])], "query long, tokens array<string>"), 3).count() == 0
    index.add(spark.createDataFrame([(i, d) for i, d in enumerate(texts(300, words=500))], "doc long, tokens array<string>"))
    rows = index.postings(["w7"])
    assert rows.count() > 0 and {r["term"] for r in rows.collect()} == {"w7"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file" in plan or "PartitionFilters: [(file" in plan
    (tmp_path / "index" / "segment-000001" / "postings").mkdir(parents=True)
    assert index.segments() == ["segment-000000"]


def test_windows_are_left_out():
    """Documents of one window alone can be among the best: the others are not scored."""
    n = 40 * X.WINDOW
    docs = np.arange(n, dtype="<i4")
    tf = np.where(docs < X.WINDOW, 9, 1).astype("<i4")
    sizes = np.full(n, 10)
    high = np.full(40, X._impact(1, 10, 10.0, 1.2, 0.75))
    high[0] = X._impact(9, 10, 10.0, 1.2, 0.75)
    rows = pa.table({"term": ["t"], "docs": [docs.tobytes()], "tfs": [tf.tobytes()], "windows": [np.arange(40, dtype="<i4").tobytes()], "best": [high.astype("<f8").tobytes()], "mean": [10.0]})
    shard = X.Shard(rows, sizes, 10.0, 1.2, 0.75)
    at, _ = shard.best(["t"], [1.0], np.arange(n), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and shard.looked_at == 4


WORD = st.sampled_from("abc")


@settings(max_examples=200, deadline=None)
@given(st.lists(WORD, max_size=30), st.lists(st.lists(WORD, max_size=5), max_size=6))
def test_automaton_finds_all_places(text, forms):
    machine = A.Automaton(forms)
    number = {t: k for k, t in enumerate(machine.vocabulary.to_pylist())}
    got = sorted(machine.find([number.get(t, -1) for t in text]))
    assert got == sorted((i, i + len(f), k) for k, f in enumerate(forms) if f for i in range(len(text) - len(f) + 1) if text[i : i + len(f)] == f)


def test_links_in_the_row_and_by_blocks_of_forms(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, [f"t{k}" for k in rng.integers(0, 6, rng.integers(0, 30))]) for i in range(200)] + [(900, None), (901, [])], "doc long, tokens array<string>")
    forms = spark.createDataFrame([(k % 9, [f"t{x}" for x in rng.integers(0, 6, rng.integers(1, 6))]) for k in range(30)] + [(77, [])], "concept long, form array<string>")
    spans = A.spans(docs, forms)
    want = sorted(map(tuple, longest_matches(spans).select("doc", "concept", "a").collect()))
    for size in (A.FORM_BYTES, 40):
        assert sorted(map(tuple, A.linked(docs, forms, size).select("doc", "concept", "a").collect())) == want
    text = {r["doc"]: r["tokens"] for r in docs.collect()}
    brute = sorted((d, i, i + len(f["form"]), f["concept"]) for d, t in text.items() for f in forms.distinct().collect() if f["form"] for i in range(len(t or []) - len(f["form"]) + 1) if t[i : i + len(f["form"])] == f["form"])
    assert sorted(map(tuple, A.spans(docs, forms, 40).collect())) == brute
    assert A.linked(docs.limit(0), forms).count() == 0 and A.linked(docs, forms.limit(0)).count() == 0
