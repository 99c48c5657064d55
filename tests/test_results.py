"""What long runs keep, reports, lenient gold matches, and the vector classifier on vectors that part."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import classify, evaluate, training
from lodestone.sources import results


def test_saved_questions_and_what_is_left_to_ask(spark, tmp_path):
    root = str(tmp_path / "questions")
    replies = spark.createDataFrame([("c1", [("fact", "What is a heap?"), ("fact", "What does the lecturer say?")]), ("c2", [])], "chunk string, questions array<struct<type: string, question: string>>")
    results.append_results(replies, root, "b1")
    saved = results.saved_questions(spark, root)
    assert [(r["chunk"], r["pos"], r["question"]) for r in saved.collect()] == [("c1", 0, "What is a heap?")]  # a stricter rule covers older replies
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk string")
    assert [r["chunk"] for r in training.unasked(chunks, spark.read.schema("chunk string").json(root)).collect()] == ["c3"]  # an empty reply is an answer
    results.append_results(replies.limit(1), root, "b1")
    assert spark.read.schema("chunk string").json(root).count() == 1


def test_written_pairs_knowledge_and_scores(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", "fact", "s")], "anchor string, positive string, kind string, source string")
    for _ in range(2):
        results.write_pairs(pairs, str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).count() == 1
    results.write_knowledge({"concepts": pairs, "facts": pairs.limit(0)}, str(tmp_path / "graph"))
    got = results.read_knowledge(spark, str(tmp_path / "graph"), ["concepts", "facts"])
    assert (got["concepts"].count(), got["facts"].count()) == (1, 0)
    for method, value in (("a", 0.5), ("b", 0.7), ("a", 0.6)):
        results.keep_scores(spark.createDataFrame([(value,)], "accuracy double"), str(tmp_path / "scores"), method)
    assert sorted((r["batch"], r["accuracy"]) for r in spark.read.json(str(tmp_path / "scores")).collect()) == [("a", 0.6), ("b", 0.7)]


def test_a_report_of_metrics(spark):
    rows = spark.createDataFrame([("bm25", 0.5, 3), ("graph", None, 4)], "mode string, mrr double, n int").orderBy("mode").fillna(0.0)
    assert evaluate.as_markdown(rows) == "|mode|mrr|n|\n|-|-|-|\n|bm25|0.500|3|\n|graph|0.000|4|"


def test_gold_matches_by_aliases_forms_and_cosine(spark):
    """The first of a concept's name and aliases that is a gold form; what is left, by the most similar form."""
    mentions = spark.createDataFrame([("s", c, k) for k, c in enumerate(["heap", "bst", "sorting", "odd", "heap2"])], "source string, concept string, chunk int")
    concepts = spark.createDataFrame([("heap", "binary heap", ["heaps"]), ("bst", "search tree", ["BSTs", "heap"]), ("sorting", "sorts of things", []), ("odd", "odd", []), ("heap2", "heap", [])], "id string, name string, aliases array<string>")
    gold = spark.createDataFrame([("s", "Heap", [], True), ("s", "Tree", ["BST"], True), ("s", "Sorting", [], False)], "source string, name string, forms array<string>, core boolean")
    none = spark.createDataFrame([], "source string, subject string, predicate string, object string")
    similar = spark.createDataFrame([("s", "sorting", "sorting", 0.9), ("s", "odd", "sorting", 0.5), ("s", "bst", "sorting", 0.99)], "source string, concept string, form string, cos double")
    got = evaluate.score_sources(mentions, concepts, none, gold, none, similar).first()
    assert (got["n_gold"], got["n_core"], got["n_pred"], got["tp"], got["matched"], got["duplicates"], got["tp_core"], got["tp_lenient"]) == (3, 2, 5, 2, 3, 1, 2, 3)
    assert evaluate.score_sources(mentions, concepts, none, gold, none).first()["tp_lenient"] == 2


def test_vectors_that_part_are_told_apart(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(0, 1, (4, 16))
    rows = spark.createDataFrame([(k, f"label {k % 4}", (centre[k % 4] + rng.normal(0, 0.2, 16)).tolist()) for k in range(240)], "id long, label string, embedding array<double>")
    held = F.col("id") % 5 == 0
    assert classify.accuracy(classify.VectorRegression().fit(rows.where(~held)).predict(rows.where(held))) > 0.95
