"""Truth tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.functions import text as T
from lodestone.functions.vectors import cosine


def column(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(f("v")).collect()]


def test_normalized(spark):
    names = ["The AVL-Trees", "Stirling's formula", "insert operation", "binary search trees", "a  Class", "C++", "vertices", "", "radius", "boxes", "queries"]
    want = ["avl tree", "stirling formula", "insert", "binary search tree", "class", "c++", "vertex", "", "radius", "box", "query"]
    assert column(spark, names, T.normalized) == want
    assert column(spark, ["In Order", "!!!", "AVL tree"], T.slug) == ["in-order", "concept", "avl-tree"]
    assert column(spark, ["in order"], T.name_key) == ["inorder"]


def test_tokens_and_keys(spark):
    assert column(spark, ["The Trees' heights!", " "], T.tokens) == [["the", "tree", "height"], []]
    assert column(spark, ["Hello, WORLD 2!"], T.memory_key) == ["hello world 2"]
    assert column(spark, ["a/b:c*?", "...", "x" * 200], T.safe_name) == ["a b c", "untitled", "x" * 120]


@pytest.mark.parametrize(("a", "b", "blocked"), [("binary tree", "binary search tree", True), ("left rotate", "right rotate", True), ("log n", "n log n", True), ("insert", "insertion", False), ("avl property", "avl balance condition", False), ("a b", "a b", False)])
def test_contrast(spark, a, b, blocked):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.contrast("a", "b")).first()[0] is blocked


def test_locator_and_time(spark):
    rows = spark.createDataFrame([(725.0, 820.0, None, None, [], 0), (None, None, 3, 4, [], 1), (None, None, 3, 3, [], 1), (None, None, None, None, ["A", "B"], 2), (None, None, None, None, [], 7)], "start double, end double, page_start int, page_end int, heading array<string>, index int")
    assert [r[0] for r in rows.select(T.locator()).collect()] == ["12:05-13:40", "p. 3-4", "p. 3", "A > B", "chunk 7"]
    assert [r[0] for r in spark.createDataFrame([(75.4,), (3725.0,)], "s double").select(T.timestamp("s")).collect()] == ["01:15", "1:02:05"]
    row = spark.createDataFrame([("https://youtu.be/abc?x=1", 61.9)], "u string, s double")
    assert row.select(T.time_link("u", "s", F.lit("at"))).first()[0] == "[at](https://youtu.be/abc?x=1&t=61s)"


def test_video_id(spark):
    rows = spark.createDataFrame([("https://x.y/watch?v=abcdefghijk&t=1", None), (None, "/a/6006-ABCDEFGHIJK.mp4"), (None, "short.mp4")], "u string, p string")
    assert [r[0] for r in rows.select(T.video_id("u", "p")).collect()] == ["abcdefghijk", "ABCDEFGHIJK", None]


def test_vectors_and_models(spark):
    texts = spark.createDataFrame([(1, "red tree"), (2, None), (3, "tree red")], "k int, t string")
    out = texts.withColumn("v", models.embedder(models.hash_embedding)("t")).orderBy("k").collect()
    assert out[1]["v"] is None and out[0]["v"] == out[2]["v"] and len(out[0]["v"]) == 64
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(cosine("a", "b")).first()[0] == 0.0


def test_retries_only_transient_failures():
    seen = []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise models.Transient
        return x

    assert models.tried(flaky, 5, wait=lambda s: None) == 5 and len(seen) == 3
    with pytest.raises(ValueError, match="no"):
        models.tried(lambda: (_ for _ in ()).throw(ValueError("no")))


def test_llm_errors_are_values(spark):
    def chat(system, user):
        if user == "bad":
            raise RuntimeError("down")
        return {"said": user}

    rows = spark.createDataFrame([("s", "hi"), ("s", "bad")], "s string, u string")
    got = [r[0] for r in rows.select(models.structured_llm(chat)("s", "u")).collect()]
    assert got[0]["reply"] == '{"said": "hi"}' and got[1]["reply"] is None and "down" in got[1]["error"]
