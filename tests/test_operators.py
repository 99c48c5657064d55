"""Operators on small fixtures, against plain re-statements where no SQL can say them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluate, extract, incremental, knowledge, search, training
from lodestone.sources import files


BLOCKS = "source_id string, blocks array<struct<text: string, start: double, end: double, heading: array<string>>>"


def words(n, end=""):
    return " ".join(["w"] * n) + end


def packed(spark, sources, *sizes):
    """Chunks of {source: [(text, start, end, heading), ...]} by source, in order."""
    out = {}
    for r in chunking.chunks(spark.createDataFrame([(k, b) for k, b in sources.items()], BLOCKS), *sizes).orderBy("source_id", "index").collect():
        out.setdefault(r["source_id"], []).append(r)
    return out


def test_chunk_rules(spark):
    got = packed(
        spark,
        {
            "timed": [(words(30), 10.0 * i, 10.0 * i + 9, None) for i in range(10)],
            "long units": [(f"u{k} " + words(59), None, None, None) for k in range(4)],
            "sentences": [(" ".join(words(10, ".") for _ in range(10)), 100.0, 200.0, None)],
            "no stops": [(words(95), None, None, None)],
            "headings": [(words(10), None, None, h) for h in (["Raft"], ["Raft"], ["Paxos"])],
            "blank": [("  ", None, None, None), (None, None, None, None)],
        },
        80, 80, 30,
    )
    assert [(r["n_words"], r["start"]) for r in got["timed"]][:3] == [(60, 0.0), (60, 10.0), (60, 20.0)]
    assert [r["text"].split()[0] for r in got["long units"]] == ["u0", "u1", "u2", "u3"] and {r["n_words"] for r in got["long units"]} == {60}
    assert (got["sentences"][0]["start"], got["sentences"][0]["end"], got["sentences"][-1]["end"]) == (100.0, 180.0, 200.0) and [r["n_words"] for r in got["sentences"]] == [80, 20]
    assert [r["n_words"] for r in got["no stops"]] == [80, 15] and [r["heading"] for r in got["headings"]] == [["Raft"], ["Paxos"]] and "blank" not in got
    with pytest.raises(ValueError, match="target"):
        chunking.chunks(spark.createDataFrame([], BLOCKS), 100, 50)


def test_chunks_lose_no_word_and_overlap_by_whole_units(spark):
    rng = random.Random(9)
    sources = {str(k): [(" ".join(f"{i}.{j}" for j in range(rng.choice((3, 20, 90, 250, 700)))), None, None, None) for i in range(rng.randint(1, 25))] for k in range(30)}
    got = packed(spark, sources)
    for k, blocks in sources.items():
        flat = [w for t, *_ in blocks for w in t.split()]
        at = 0
        for r in got[k]:
            own = r["text"].split()
            first = flat.index(own[0])
            assert first <= at and at - first <= 40 and flat[first : first + len(own)] == own and len(own) == r["n_words"] <= 340
            assert first == at or r["n_words"] - (at - first) > 0
            at = first + len(own)
        assert at == len(flat)


def test_chunks_of_sources(spark):
    rows = spark.createDataFrame([("s", [("a b. c d.", 0.0, 4.0, ["H"])]), ("empty", [])], "source_id string, blocks array<struct<text: string, start: double, end: double, heading: array<string>>>")
    (one,) = chunking.chunks(rows).collect()
    assert (one["chunk_id"], one["n_words"], one["heading"], one["page_start"]) == ("s:0000", 4, ["H"], None)


def test_markdown_and_text(spark, tmp_path):
    note = "---\ntitle: x\n---\n# Top\n\nSome\ntext.\n\n## Sub\n\n```\na\n\nb\n```\n\n### Deep\n\nEnd.\n"
    (tmp_path / "a.md").write_text(note)
    (tmp_path / "b.txt").write_text("One\nline.\n\n\nTwo.\n")
    (tmp_path / "c.xyz").write_text("?")
    found = files.scan(spark, str(tmp_path))
    assert {r["kind"] for r in found.collect()} == {"markdown", "text"}
    assert [r["text"] for r in files.text_blocks(found.where("kind = 'text'")).orderBy("pos").collect()] == ["One line.", "Two."]
    blocks = files.markdown_blocks(found.where("kind = 'markdown'")).orderBy("pos").collect()
    assert [(r["text"], r["heading"], r["title"]) for r in blocks] == [("Some text.", ["Top"], "Top"), ("```\na\n\nb\n```", ["Top", "Sub"], "Top"), ("End.", ["Top", "Sub", "Deep"], "Top")]
    assert [r[0] for r in found.select(files.title_of(F.lit("/x/big-data_101.v2.md"))).limit(1).collect()] == ["big data 101.v2"]
    assert files.unknown_kinds(spark, str(tmp_path)).count() == 1
    done = found.where("kind = 'text'").select("source_id")
    assert files.not_ingested(found, done).count() == 1


def brute_edits(ref, hyp):
    """Least (edits, substitutions) over all alignments, by recursion with memory."""
    import functools

    @functools.cache
    def go(i, j):
        if not i or not j:
            return i + j, 0
        same = ref[i - 1] == hyp[j - 1]
        a, b, c = go(i - 1, j - 1), go(i - 1, j), go(i, j - 1)
        return min((a[0] + (not same), a[1] + (not same)), (b[0] + 1, b[1]), (c[0] + 1, c[1]))

    return go(len(ref), len(hyp))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_edits(ref, hyp):
    s, d, i = evaluate.edits(ref, hyp)
    assert (s + d + i, s) == brute_edits(ref, hyp) and len(ref) - d + i == len(hyp)


def test_spoken_words(spark):
    said = {0: "zero", 13: "thirteen", 20: "twenty", 21: "twenty one", 100: "one hundred", 115: "one hundred fifteen", 1001: "one thousand one", 999_999: "nine hundred ninety nine thousand nine hundred ninety nine", 1_000_000: "1000000"}
    rows = spark.createDataFrame([(k,) for k in said], "n long")
    assert {r["n"]: r["w"] for r in rows.select("n", evaluate.number_words("n").alias("w")).collect()} == said
    pairs = spark.createDataFrame([(1, "a b c d e f", "a x c d e f g"), (2, "It's 7 o'clock -- 'now'", "its SEVEN o'clock now"), (3, "a b", None), (4, "", "")], "id int, reference string, hypothesis string")
    assert {r["id"]: tuple(r)[1:] for r in evaluate.word_error_rate(pairs).collect()} == {1: (2 / 6, 1, 0, 1, 6), 2: (0.25, 1, 0, 0, 4), 3: (1.0, 0, 2, 0, 2), 4: (0.0, 0, 0, 0, 0)}


def test_extraction_cleaning(spark):
    import json

    raw = {"concepts": [{"name": " Binary search tree (BST). "}, {"name": "binary search TREE"}, {"name": " "}, {"name": "AVL", "aliases": ["AVL tree", "avl", "avl TREE"]}],
           "relations": [{"subject": "bst", "predicate": "is_a", "object": "AVL"}, {"subject": "BST", "predicate": "is_a", "object": "avl tree"}, {"subject": "BST", "predicate": "uses", "object": "heap"}, {"subject": "bst", "predicate": "x", "object": "Binary search tree"}],
           "facts": [{"statement": " A  fact ", "concepts": ["bst", "AVL", "none"]}, {"statement": " "}]}
    out = extract.cleaned(spark.createDataFrame([("c", json.dumps(raw)), ("bad", "not json"), ("none", None)], "chunk_id string, reply string"))
    assert [(r["name"], r["aliases"]) for r in out["concepts"].orderBy("pos").collect()] == [("Binary search tree", ["BST"]), ("AVL", ["AVL tree"])]
    assert [(r["subject"], r["predicate"], r["object"]) for r in out["relations"].collect()] == [("Binary search tree", "is_a", "AVL")]
    assert [(r["statement"], r["concepts"]) for r in out["facts"].collect()] == [("A fact", ["Binary search tree", "AVL"])]
    assert {(r["chunk_id"], r["reason"]): r["n"] for r in out["drops"].collect()} == {("c", "empty"): 2, ("c", "duplicate"): 2, ("c", "dangling"): 1, ("c", "self_relation"): 1}


def greedy(spans):
    taken, found = [], {}
    for a, b, c in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if not any(a >= x and b <= y for x, y in taken):
            taken.append((a, b))
            found[c] = min(a, found.get(c, a))
    return found


def test_longest_matches_as_the_greedy_rule(spark):
    rng = random.Random(3)
    cases = {k: [(a, a + rng.randint(1, 4), rng.choice("xyz") + str(i)) for i in range(rng.randint(1, 7)) for a in [rng.randint(0, 6)]] for k in range(200)}
    rows = spark.createDataFrame([(k, *s) for k, spans in cases.items() for s in spans], "doc int, a int, b int, concept string")
    got = {}
    for r in knowledge.longest_matches(rows).collect():
        got.setdefault(r["doc"], {})[r["concept"]] = r["a"]
    # equal spans of two concepts: the first by name stands for the place
    for k, spans in cases.items():
        unique = {}
        for a, b, c in sorted(spans):
            unique.setdefault((a, b), c)
        assert got[k] == greedy([(a, b, c) for (a, b), c in unique.items()])


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200 + k, 201 + k) for k in range(40)]
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["root"] for r in knowledge.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


def test_hybrid_fixture(spark):
    mentions = spark.createDataFrame([("avl", "a0", 0), ("avl", "a1", 2), ("bst", "a1", 5), ("heap", "a2", 0)], "concept string, doc string, facts int")
    edges = spark.createDataFrame([("avl", "bst"), ("bst", "avl")], "node string, other string")
    seeds = spark.createDataFrame([("q", "avl", 1.0)], "query string, concept string, weight double")
    n = spark.createDataFrame([(4,)], "n long")
    import math

    got = {r["doc"]: r["score"] for r in search.graph_scores(mentions, edges, seeds, n).collect()}
    want = {"a0": math.log(3), "a1": math.log(3) * 2 + 0.25 * math.log(5) * 2.5}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    base = spark.createDataFrame([("q", "a0", 0.9), ("q", "a1", 0.88), ("q", "a2", 0.1)], "query string, doc string, score double")
    again = search.rerank(base, search.graph_scores(mentions, edges, seeds, n), 2).orderBy("rank").collect()
    assert [r["doc"] for r in again] == ["a1", "a0"]


def test_metrics_fixture(spark):
    ranking = spark.createDataFrame([("q", d, k + 1) for k, d in enumerate(["a0", "a3", "a2", "a1"])], "query string, doc string, rank int")
    rel = spark.createDataFrame([("q", "a3"), ("q", "a1"), ("p", "a1")], "query string, doc string")
    got = {r["query"]: r for r in evaluate.ir_per_query(ranking, rel).collect()}
    assert got["q"]["rr"] == 0.5 and got["q"]["r5"] == 1.0 and got["q"]["r1"] == 0.0 and got["p"]["rr"] == 0.0


def test_bootstrap_of_equal_values(spark):
    rows = spark.createDataFrame([(k, 1.0, 1) for k in range(50)], "cluster int, value double, size int")
    r = evaluate.bootstrap(rows, 200).first()
    assert (r["mean"], r["low"], r["high"]) == (1.0, 1.0, 1.0)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d"), (1, None)], "id int, v string")
    first = incremental.upsert(old, new, ["id"])
    assert {r["id"]: (r["v"], r["state"]) for r in first.collect()} == {1: ("a", "unchanged"), 2: ("c", "updated"), 3: (None, "unchanged"), 4: ("d", "created")}
    again = incremental.upsert(first.drop("state"), new, ["id"])
    assert {r["state"] for r in again.collect()} == {"unchanged"}


def test_memories(spark):
    kept = spark.createDataFrame([("s", "fact", 1, "Hello there", 1.0)], "scope string, kind string, seq int, text string, created double")
    new = spark.createDataFrame([("s", "fact", "hello, THERE!", 2.0), ("s", "episode", "hello there", 3.0), ("t", "fact", "hello there", 4.0), ("t", "fact", "...", 5.0)], "scope string, kind string, text string, created double")
    out = incremental.remember(kept, new)
    assert sorted((r["scope"], r["kind"], r["seq"]) for r in out.collect()) == [("s", "episode", 2), ("s", "fact", 1), ("t", "fact", 3)]
    assert incremental.forget(out, "s", 1).count() == 2 and incremental.forget(out, "s").count() == 1
    with pytest.raises(ValueError, match="default"):
        incremental.forget(out, "default")


def test_vault(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, content string")
    notes = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, content string")
    assert {r["id"]: r["state"] for r in incremental.reconcile(notes, old).collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "created"}
    note = f"mine\n{incremental.BEGIN}\nold\n{incremental.END}\nmore"
    row = spark.createDataFrame([(note, "new"), ("plain", "new")], "old string, block string")
    a, b = [r[0] for r in row.select(incremental.managed("old", "block")).collect()]
    assert a == note.replace("old", "new") and b.endswith("\n\nplain")


def test_questions(spark):
    rows = [("c", k, t, q) for k, (t, q) in enumerate([("fact", "What is a heap?"), ("fact", "What is a tree here?"), ("definition", "short?"), ("definition", "what is a HEAP?"), ("relation", "What does this lecture say?"), ("procedure", "How are keys inserted?")])]
    more = [("d", 0, "fact", "What is a heap?"), ("d", 1, "fact", "How are keys inserted?"), ("d", 2, "relation", "How are keys inserted?")]
    got = training.clean_questions(spark.createDataFrame(rows, "chunk string, pos int, type string, question string")).orderBy("pos").collect()
    assert [r["question"] for r in got] == ["What is a heap?", "How are keys inserted?"]
    kept = training.clean_questions(spark.createDataFrame(more, "chunk string, pos int, type string, question string"))
    assert sorted((r["pos"], r["type"]) for r in kept.collect()) == [(0, "fact"), (2, "relation")]
    asked = spark.createDataFrame([(*r, ["relation"]) for r in more], "chunk string, pos int, type string, question string, requested array<string>")
    assert [r["pos"] for r in training.clean_questions(asked).collect()] == [2]


def test_stream_upserts(spark, tmp_path):
    from lodestone.streaming.ingest import upsert_stream

    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, at int").write.parquet(source)
    for _ in range(2):
        upsert_stream(spark, source, "id int, v string, at int", root, ["id"], "at", str(tmp_path / "check")).awaitTermination(60)
    out = spark.read.parquet(f"{root}/snapshot=0")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "b"), (2, "c")]
    assert out.where(F.col("id") == 1).count() == 1
