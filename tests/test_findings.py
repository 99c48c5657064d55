"""Queries against their SQL on tables that are made to reach what small tables do not."""

import random

import pytest
from oracle import compare, connect

from lodestone.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    def make(**frames):
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def same(spark, d, name):
    return compare(registry.QUERIES[name](spark, d), connect(d), registry.SQL[name])


def test_all_relations_are_training_pairs(spark, tables):
    """More relations than the 4,000 that a training mix draws."""
    parts = [(k, f"w{k % 3989} x", f"B{k % 7}", ("ECONOMY", "SMALL", "LARGE")[k % 3], k % 50, 900.0 + k % 100) for k in range(7500)]
    d = tables(part=spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))
    assert same(spark, d, "build_pairs") == ""


def _searchable(spark, tables, items=130, docs=40):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ane", "obe", "ird")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(k, text(3 + k % 3)) for k in range(items)]
    vectors = []
    for k in range(items + 100):
        v = [rng.gauss(0, 1) for _ in range(6)]
        norm = sum(x * x for x in v) ** 0.5
        vectors.append((k, f"l{k % 3}", [x / norm for x in v]))
    held = [(k, text(30) + " " + bench[rng.randrange(items)][1]) for k in range(docs)]
    return tables(
        benchmark=spark.createDataFrame(bench, "item_id long, text string"), embeddings=spark.createDataFrame(vectors, "vec_id long, label string, embedding array<float>"),
        documents=spark.createDataFrame([(k, t, "s", "en", 1) for k, t in held], "doc_id long, text string, source string, lang string, n_chars int"),
    )


@pytest.mark.parametrize("name", ["gold_graph_search", "hybrid_rrf_seed_bonus"])
def test_a_concept_with_the_number_of_a_query_seeds_it(spark, tables, name):
    """More than a hundred items: a concept's vector has the id of another item's."""
    assert same(spark, _searchable(spark, tables), name) == ""


def test_sources_of_many_users_and_without_a_key(spark, tables):
    """More users than a number has bits; a missing source counts but is not named."""
    rng = random.Random(3)
    parts = spark.createDataFrame([(k, f"p{k}", ("STANDARD", "SMALL")[k % 4 == 0], "b") for k in range(150)], "p_partkey long, p_name string, p_type string, p_brand string")
    orders = spark.createDataFrame([(k, None if k % 5 == 0 else k % 17 + 3) for k in range(300)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(k, rng.randrange(150), n, 0.1, n) for k in range(300) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_discount double, l_suppkey int")
    empty = {"l_shipdate": "timestamp", "l_extendedprice": "double", "l_returnflag": "string"}
    d = tables(part=parts, orders=orders, lineitem=lines.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in empty.items()]))
    assert same(spark, d, "two_hop_uses") == ""


def test_a_shard_is_bounded_by_its_tokens(spark, tmp_path):
    from lodestone.operators.index import InvertedIndex

    docs = spark.createDataFrame([(k, [f"w{(k * 7 + i) % 23}" for i in range(40 if k != 5 else 900)]) for k in range(60)], "doc long, tokens array<string>").coalesce(1)
    asked = spark.createDataFrame([(1, ["w1", "w2", "w3"]), (2, ["w9"])], "query long, tokens array<string>")
    whole, cut = InvertedIndex(spark, f"{tmp_path}/a"), InvertedIndex(spark, f"{tmp_path}/b", tokens=200)
    for index in (whole, cut):
        index.add(docs)
    sizes = [(r["n"], r["size"]) for r in cut._read("documents", "shard string, n long, size long").collect()]
    assert sum(n for n, _ in sizes) == 60 and sorted(sizes)[0] == (1, 900) and all(s <= 200 for n, s in sizes if n > 1)
    assert sorted(map(tuple, cut.search(asked, 20).collect())) == sorted(map(tuple, whole.search(asked, 20).collect()))


def test_texts_are_searched_in_bounded_portions():
    import pyarrow as pa

    from lodestone.operators import automaton

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["a"] * (automaton.TOKENS // 2)] * 3 + [None, [], ["b"] * (automaton.TOKENS + 1), ["c"]])], names=["doc", "tokens"])
    parts = list(automaton._portions(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [2, 3, 1, 1] and [d for p in parts for d in p.column(0).to_pylist()] == list(range(7))


def test_the_best_of_each_query_leave_a_task(spark):
    """No row for each query of each document is made; ties go to the smaller document."""
    from lodestone.operators import search

    rng = random.Random(1)
    mentions = spark.createDataFrame([(c, d, rng.randrange(5)) for d in range(300) for c in rng.sample(range(12), 3)], "concept long, doc long, facts long").repartition(3)
    edges = spark.createDataFrame([(a, (a + 1) % 12) for a in range(12)], "node long, other long")
    seeds = spark.createDataFrame([(q, rng.randrange(12), 1.0 - q / 50) for q in range(20)], "query long, concept long, weight double")
    n = spark.createDataFrame([(300,)], "n long")
    every = search.graph_scores(mentions, edges, seeds, n)
    want = sorted(map(tuple, search.ranked(every, 10).select("query", "doc", "score", "rank").collect()))
    assert sorted(map(tuple, search.graph_topk(mentions, edges, seeds, n, 10).select("query", "doc", "score", "rank").collect())) == want
    pairs = spark.createDataFrame([(3, d) for d in range(40)], "query long, doc long")
    assert sorted(map(tuple, search.graph_scores_of(pairs, mentions, edges, seeds, n).collect())) == sorted(map(tuple, every.join(pairs, ["query", "doc"]).select("query", "doc", "score").collect()))


@pytest.mark.parametrize("name", ["merge_relations", "related_concepts"])
def test_items_and_mentions_are_not_broadcast_by_their_files_size(spark, name):
    """A file of items is a few bytes a row, the table of a broadcast some hundred; every task would hold it."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_regression_is_fitted_by_no_more_tasks_than_cores(spark, monkeypatch):
    """Every task of a round sends a whole gradient, so what is shuffled must not grow with the files of a larger table."""
    from lodestone.operators import classify

    tasks = []

    class Seen(classify.LogisticRegression):
        def fit(self, rows):
            tasks.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(classify, "LogisticRegression", Seen)
    rows = spark.createDataFrame([(k, ("red apple fruit", "blue stone rock")[k % 2], ("a", "b")[k % 2]) for k in range(48)], "id long, text string, label string").repartition(12, "id")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        out = classify.TfidfRegression(rounds=5).fit(rows).predict(rows)
        assert out.where("label = predicted").count() == 48
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism
