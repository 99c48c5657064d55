"""Loads of a stored graph: idempotence, pruning by load id, models, killed loads, passages."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.models import embedder, hash_embedding
from lodestone.sources import graph_store
from lodestone.sources.graph_store import GraphStore, concept_text

MODEL = ("hashed", lambda text: embedder(hash_embedding)(text))


def graph(spark, concepts=("avl", "bst", "rotation"), facts=True, source="s1"):
    """Three concepts in three chunks of a source, as the rows of a merged graph."""
    chunks = spark.createDataFrame([(f"{source}:{k}", source, k, f"passage {k} of {source}", 60.0 * k) for k in range(3)], "chunk string, source string, index int, text string, start double")
    known = [("avl", "AVL tree", ["AVL"], "A balanced tree.", 3), ("bst", "binary search tree", ["BST"], "", 1), ("rotation", "rotation", [], "Restructures a subtree.", 1)]
    known = [c for c in known if c[0] in concepts]
    m = [(c, f"s1:{k}", 0.9, [w]) for c, k, w in (("avl", 0, "AVL"), ("avl", 2, "AVL tree"), ("bst", 1, "BST"), ("rotation", 2, "rotation"), ("avl", 9, "in no chunk")) if c in concepts]
    r = [(a, p, b, 0.9, 2, ["s1:0"]) for a, p, b in (("avl", "is_a", "bst"), ("avl", "uses", "ghost")) if a in concepts]
    part = [(a, b, 0.8, 1, ["s1:2"]) for a, b in (("rotation", "avl"),) if a in concepts and b in concepts]
    f = [("f1", "s1:0", "AVL trees are flat.", 0.9, "model", ["avl", "ghost"]), ("f1", "s1:0", "AVL trees are flat.", 0.9, "model", ["avl"]), ("f9", "s9:0", "of no loaded chunk", 0.9, "text", [])]
    evidence = "confidence double, n_mentions long, chunks array<string>"
    return {
        "sources": spark.createDataFrame([(source, "Lecture 1")], "id string, title string"), "chunks": chunks,
        "concepts": spark.createDataFrame(known, "id string, name string, aliases array<string>, definition string, n_mentions long"),
        "mentions": spark.createDataFrame(m, "concept string, chunk string, confidence double, surfaces array<string>"),
        "relations": spark.createDataFrame(r, f"subject string, predicate string, object string, {evidence}"),
        "part_of": spark.createDataFrame(part, f"subject string, object string, {evidence}"),
        "facts": spark.createDataFrame(f if facts else [], "id string, chunk string, statement string, confidence double, linked_by string, concepts array<string>"),
    }


def counts(store):
    return {r["kind"]: r["n"] for r in store.counts().collect()}


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, str(tmp_path / "graph"), buckets=4)


def test_a_load_and_its_repetition(spark, store):
    first = store.load(graph(spark), "algorithms", "m1", MODEL)
    before = counts(store)
    assert first["embedded"] == 3 + 3 and store.meta()["dims"] == 64
    assert before == {"Domain": 1, "Source": 1, "Chunk": 3, "Concept": 3, "Fact": 1, "RELATED_TO": 1, "PART_OF": 1 + 3 + 1 + 3, "MENTIONED_IN": 4 + 1, "ABOUT": 1, "embedded Concept": 3, "embedded Chunk": 3}
    again = store.load(graph(spark), "algorithms", "m1", MODEL)
    assert counts(store) == before and again["embedded"] == 0 and again["removed"] == {"concepts": 0, "facts": 0, "edges": 0}
    assert store.find_concept("avl").first()["id"] == "avl" and store.find_concept("bst").first()["name"] == "binary search tree"
    assert [r["t"] for r in store.table("concepts").select(concept_text().alias("t")).orderBy("id").collect()] == ["AVL tree: A balanced tree.", "binary search tree", "rotation: Restructures a subtree."]


def test_what_a_load_does_not_say_is_pruned(spark, store):
    store.load(graph(spark), "d", "m1", MODEL)
    stats = store.load(graph(spark, ("avl", "bst"), facts=False), "d", "m1")
    assert stats["removed"] == {"concepts": 1, "facts": 1, "edges": 0}
    left = counts(store)
    assert left["Concept"] == 2 and "Fact" not in left and "ABOUT" not in left and left["embedded Concept"] == 2 and left["Chunk"] == 3
    fewer = graph(spark, ("avl", "bst"))
    fewer["mentions"] = fewer["mentions"].where("chunk = 's1:0'")
    fewer["relations"] = fewer["relations"].limit(0)
    assert store.load(fewer, "d", "m1")["removed"] == {"concepts": 0, "facts": 0, "edges": 3}


def test_rows_without_a_load_id_and_memories_stay(spark, store):
    store.load(graph(spark), "d", "m1")
    manifest = store._manifest()
    own = store.table("concepts").where("id = 'bst'").withColumns({"id": F.lit("mine"), "load_id": F.lit(None).cast("string")})
    note = store.table("facts").withColumns({"id": F.lit("note"), "memory": F.lit(True), "chunk": F.lit(None).cast("string")})
    about = store.table("about").withColumns({"fact": F.lit("note")})
    edge = store.table("mentions").where("concept = 'bst'").withColumns({"concept": F.lit("mine"), "load_id": F.lit(None).cast("string")})
    for name, rows in (("concepts", own), ("facts", note), ("about", about), ("mentions", edge)):
        store._put(manifest, name, store.table(name).unionByName(rows), "by-hand")
    store._commit(manifest)
    stats = store.load(graph(spark, ("avl",), facts=False), "d", "m1")
    assert stats["removed"]["concepts"] == 2 and stats["removed"]["facts"] == 1
    assert {r["id"] for r in store.table("concepts").collect()} == {"avl", "mine"} and [r["id"] for r in store.table("facts").collect()] == ["note"]
    assert [tuple(r)[:2] for r in store.table("about").collect()] == [("note", "avl")] and "mine" in {r["concept"] for r in store.table("mentions").collect()}
    store.load(graph(spark), "d", "m2", replace=True)
    assert {r["id"] for r in store.table("concepts").collect()} == {"avl", "bst", "rotation"} and {r["id"] for r in store.table("facts").collect()} == {"f1", "note"}


def test_models_are_not_mixed(spark, store):
    store.load(graph(spark), "d", "m1", MODEL)
    with pytest.raises(ValueError, match="model 'm1'"):
        store.load(graph(spark), "d", "m2")
    with pytest.raises(ValueError, match="embed_model 'hashed'"):
        store.load_passages(graph(spark)["sources"], graph(spark)["chunks"], "d", ("other", MODEL[1]))
    assert store.load(graph(spark), "d", "m2", ("other", MODEL[1]), replace=True)["embedded"] == 6
    assert store.meta()["model"] == "m2" and store.meta()["embed_model"] == "other"


def test_a_killed_load_leaves_the_graph_before_it(spark, store, monkeypatch):
    store.load(graph(spark), "d", "m1")
    before = counts(store)

    def dies(self, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(graph_store.GraphStore, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        store.load(graph(spark, ("avl",)), "d", "m1")
    monkeypatch.undo()
    assert counts(store) == before and store.vacuum(0) > 0 and counts(store) == before
    two = GraphStore(spark, store.root)
    stale = two._manifest()
    store.load(graph(spark, ("avl",)), "d", "m1")
    with pytest.raises(RuntimeError, match="another load"):
        two._commit(stale)


def test_passages_are_replaced_by_source_and_embedded_once(spark, store):
    g = graph(spark)
    assert store.load_passages(g["sources"], g["chunks"], "d", MODEL) == 3
    one = store._manifest()["tables"]["chunks"]
    other = graph(spark, source="s2")
    assert store.load_passages(other["sources"], other["chunks"], "d2", MODEL) == 3 and store.table("chunks").count() == 6
    kept = {b: p for b, p in store._manifest()["tables"]["chunks"].items() if one.get(b) == p}
    changed = g["chunks"].withColumn("text", F.when(F.col("index") == 1, F.lit("new")).otherwise(F.col("text")))
    assert store.load_passages(g["sources"], changed, "d", MODEL) == 1 and store.table("chunks").where("text = 'new'").count() == 1
    assert store.load_passages(g["sources"], changed.withColumn("source", F.lit("unknown")), "d", MODEL) == 0
    assert kept or len(one) == 1  # buckets of other sources keep their files
    assert store.load(g, "d", "m1", MODEL)["chunks"] == 3 and store.table("concepts").count() == 3
    store.reset()
    assert counts(store) == {} and store.meta() == {}


def test_concepts_belong_to_the_domains_of_their_sources(spark, store):
    store.load(graph(spark), "one", "m1")
    store.load(graph(spark), "two", "m1")
    assert sorted(tuple(r) for r in store.table("concept_domains").collect()) == sorted((c, d) for c in ("avl", "bst", "rotation") for d in ("one", "two"))


def test_a_load_computes_its_rows_once_or_twice(spark, store):
    """Facts are stored with what they are about in one pass, concepts are not computed again for what is left of earlier loads; mentions and relations are read for their ends as well."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("facts", "concepts", "mentions", "relations")}

    def counting(name, df):
        total = seen[name]

        def passed(rows):
            for r in rows:
                total.add(1)
                yield r

        return spark.createDataFrame(df.rdd.mapPartitions(passed), df.schema)

    store.load(graph(spark), "d", "m1")
    rows = graph(spark)
    given = {n: rows[n].count() for n in seen}
    store.load(rows | {n: counting(n, rows[n]) for n in seen}, "d", "m1")
    assert {n: seen[n].value // given[n] for n in seen} == {"facts": 1, "concepts": 1, "mentions": 2, "relations": 2}


def test_older_chunks_of_a_bucket_stay_beside_new_ones(spark, store):
    """Three loads of sources that share all buckets keep each other's chunks, once each."""
    store = GraphStore(spark, f"{store.root}-one", buckets=1)
    for source in ("s1", "s2", "s1", "s3"):
        rows = graph(spark, source=source)
        store.load_passages(rows["sources"], rows["chunks"], "d", MODEL)
    assert sorted(r["chunk"] for r in store.table("chunks").collect()) == sorted(f"s{k}:{i}" for k in (1, 2, 3) for i in range(3))
    assert store.table("chunk_vectors").count() == 9 and store.vacuum(0) > 0 and store.table("chunks").count() == 9
