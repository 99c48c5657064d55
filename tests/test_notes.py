"""Labelled sets, caches, prompts, notes and classifiers on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.models import structured_llm, transcriber
from lodestone.operators import classify, notes, prompts
from lodestone.sources import gold, results, vault


def test_query_sets_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("source_id: s1\nqueries:\n  - {id: q1, query: 'What?', type: fact, relevant: [0, 2], answer: that}\n")
    (tmp_path / "b.yaml").write_text("sources: {l1: s1, l2: s2}\nqueries:\n  - {id: q2, query: 'How?', type: procedure, relevant: {l1: [1], l2: [0, 1]}}\n")
    labels = gold.query_sets(spark, str(tmp_path))
    chunks = spark.createDataFrame([(s, i, f"{s}:{i}") for s in ("s1", "s2") for i in range(3)], "source string, index int, chunk string")
    out = gold.resolved(labels, chunks)
    assert sorted((r["query"], r.chunk, r.answer) for r in out.collect()) == [("q1", "s1:0", "that"), ("q1", "s1:2", "that"), ("q2", "s1:1", ""), ("q2", "s2:0", ""), ("q2", "s2:1", "")]
    (tmp_path / "c.yaml").write_text("source_id: s1\nqueries:\n  - {id: q1, query: 'Again?', type: fact, relevant: [1]}\n  - {id: q3, query: 'None?', type: fact, relevant: []}\n  - {id: q4, query: 'Lost?', type: fact, relevant: [9]}\n")
    faults = gold.label_faults(gold.query_sets(spark, str(tmp_path)), chunks)
    assert sorted(map(tuple, faults.collect())) == [("q1", "duplicate"), ("q3", "no passages"), ("q4", "no such passage")]
    with pytest.raises(ValueError, match="q1: duplicate"):
        gold.resolved(gold.query_sets(spark, str(tmp_path)), chunks)


def test_gold_sets(spark, tmp_path):
    (tmp_path / "g.yaml").write_text(
        "source_id: s\ntitle: T\nconcepts:\n  - {name: Heap, type: structure, core: true, aliases: [heaps, pile]}\n  - {name: Pile, type: odd}\n  - {name: Sort, type: method}\nrelations:\n  - {subject: Heap, predicate: uses, object: Tree}\n"
    )
    concepts, relations = gold.gold_sets(spark, str(tmp_path))
    assert sorted((r.name, r.core, len(r.aliases)) for r in concepts.collect()) == [("Heap", True, 2), ("Pile", False, 0), ("Sort", False, 0)]
    found = gold.gold_faults(concepts, relations, ["structure", "method"], ["part_of"])
    assert sorted((r.item, r.fault) for r in found.collect()) == [("Tree", "end is no concept"), ("odd", "unknown type"), ("pile", "form of two concepts"), ("uses", "unknown predicate")]


def test_manifest(spark):
    courses = spark.createDataFrame([("a", "maths", None, ["v1", None, "v3"]), ("b", "music", "test", ["v4"])], "course string, domain string, split string, lectures array<string>")
    splits = spark.createDataFrame([(1, "train"), (3, "dev")], "lecture int, split string")
    lectures = gold.manifest_lectures(courses, splits)
    assert sorted((r.video, r.lecture, r.split) for r in lectures.collect()) == [("v1", 1, "train"), ("v3", 3, "dev"), ("v4", 1, "test")]
    sources = spark.createDataFrame([("x", "v1", 1), ("y", "v1", 0), ("z", "v3", 0)], "source string, video string, root int")
    chunks = spark.createDataFrame([("y", 0, "one two three four five"), ("y", 1, "too short"), ("x", 0, "of the second root one two")], "source string, index int, text string")
    assert [tuple(r) for r in gold.corpus(lectures, sources, chunks).collect()] == [("one two three four five", "maths", "a", 1, "train", 0)]
    with pytest.raises(ValueError, match="v4"):
        gold.checked_corpus(lectures, sources, chunks)


def test_transcripts_are_made_once_a_model(spark, tmp_path):
    def transcribe(content, language):
        if content == b"bad":
            raise ValueError("no sound")
        return {"model": "m", "language": "en", "segments": [{"text": content.decode(), "start": 0.0, "end": 1.0}]}

    media = spark.createDataFrame([("a", b"hello"), ("b", b"bad")], "source_id string, content binary")
    made = media.select("source_id", transcriber(transcribe)(F.col("content"), F.lit(None).cast("string")).alias("t")).select("source_id", "t.*")
    assert sorted((r.source_id, r.error) for r in made.collect()) == [("a", None), ("b", "ValueError: no sound")]
    for _ in range(2):
        results.write_transcripts(made.where("error is null").drop("error"), str(tmp_path))
    cached = results.cached_transcripts(spark, str(tmp_path), "m")
    assert [(r.source_id, r.text) for r in results.transcript_blocks(cached).collect()] == [("a", "hello")]
    assert [r.source_id for r in results.to_transcribe(media, cached).collect()] == ["b"]
    assert results.to_transcribe(media, results.cached_transcripts(spark, str(tmp_path), "other")).count() == 2
    assert results.to_transcribe(media, cached, force=True).count() == 2


def test_results_of_a_batch_are_written_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "chunk string, prompt_version int, error string")
    root = str(tmp_path / "r")
    for _ in range(2):
        results.append_results(rows(("c1", 2, None), ("c2", 2, "timeout")), root, "1")
    results.append_results(rows(("c2", 2, None), ("c3", 1, None)), root, "2")
    back = spark.read.schema("chunk string, prompt_version int, error string, batch string").json(root)
    assert back.count() == 4 and sorted(r.chunk for r in results.usable_results(back, 2).collect()) == ["c1", "c2"]


def test_known_names_against_a_list(spark):
    import random

    rng, rows = random.Random(3), []
    for source in ("a", "b"):
        rows += [(source, i, [f"n{rng.randrange(12)}" for _ in range(rng.randrange(4))]) for i in range(12)]
    want, seen = {}, {}
    for source, i, names in rows:
        have = seen.setdefault(source, {})
        want[source, i] = list(have)[-4:]
        have.update(dict.fromkeys(names))
    got = prompts.known_names(spark.createDataFrame(rows, "source string, index int, names array<string>"), 4)
    assert {(r.source, r["index"]): r.known for r in got.collect()} == want


def test_replies(spark):
    r = json.dumps({"concepts": [{"name": str(k)} for k in range(30)], "relations": [], "facts": None})
    out = spark.createDataFrame([(r,), ("no object",)], "reply string").select(prompts.limited("reply").alias("r")).collect()
    assert len(out[0].r.concepts) == 12 and out[0].r.relations == [] and out[0].r.facts is None
    assert out[1].r is None or out[1].r.concepts is None
    ask = structured_llm(lambda system, user: {"domain": "maths" if "sum" in user else "cooking"})
    rows = spark.createDataFrame([("a sum",), ("a soup",), (None,)], "text string")
    assert [x.predicted for x in classify.ZeroShot(ask, {"maths": "numbers", "music": "sound"}).fit(rows).predict(rows).collect()] == ["maths", "<invalid>", "<invalid>"]


def test_notes_keep_what_the_reader_wrote(spark):
    names = notes.note_names(spark.createDataFrame([("c1", "Heap", 5), ("c2", "heap", 9), ("c3", "A/B", 1)], "id string, name string, n int"), "Concepts", [-F.col("n")])
    assert {r.id: r.stem for r in names.collect()} == {"c2": "heap", "c1": "Heap (2)", "c3": "A B"}
    relations = spark.createDataFrame([("c1", "uses", "c2", 1), ("c1", "uses", "c3", 4), ("c2", "contrasts_with", "c1", 1), ("c1", "uses", "gone", 2)], "subject string, predicate string, object string, n int")
    sources = spark.createDataFrame([("s", "Talk", "https://youtu.be/x", "Talk", 61.0)], "id string, name string, url string, stem string, duration double")
    mentions = spark.createDataFrame([("c1", "s", 1, 65.0, "01:05"), ("c1", "s", 0, 5.0, "00:05"), ("c3", "s", 0, None, "chunk 0")], "concept string, source string, chunk int, start double, place string")
    facts = spark.createDataFrame([("c1", "It sorts.", "s", 5.0, "00:05"), ("c1", "It sorts.", "s", 65.0, "01:05")], "concept string, statement string, source string, start double, place string")
    concepts = spark.createDataFrame([("c1", "Heap", "A tree."), ("c2", "heap", None), ("c3", "A/B", "")], "id string, name string, definition string")
    blocks = {r.id: r.block for r in notes.concept_blocks(concepts, names, relations, mentions, facts, sources).collect()}
    assert blocks["c1"] == (
        "# Heap\n\nA tree.\n\n## Related\n\n- **uses:** [[A B|A/B]], [[heap]]\n- **is contrasts with of:** [[heap]]\n\n## Taught in\n\n- [[Talk]]: [00:05](https://youtu.be/x?t=5s), [01:05](https://youtu.be/x?t=65s)"
        "\n\n## Facts\n\n- It sorts. ([[Talk]], 00:05)"
    )
    assert blocks["c2"].startswith("# heap\n\n## Related")
    block = notes.source_blocks(sources, names, mentions).first().block
    assert block == "# Talk\n\n[Watch](https://youtu.be/x) · 01:01\n\n## Concepts, in the order they come up\n\n- chunk 0 [[A B|A/B]]\n- [00:05](https://youtu.be/x?t=5s) [[Heap (2)|Heap]]"
    old = "---\nnote_id: c1\ntags:\n  - old\nmine: 1\nlist:\n  - a\n---\nbefore\n" + notes.BEGIN + "\nold\n" + notes.END + "\nafter\n"
    one = spark.createDataFrame([("c1", "new", old)], "id string, block string, old string")
    pairs = [("note_id", F.col("id")), ("tags", F.array(F.lit("type/x")))]
    out = one.select(notes.note(notes.front_matter(pairs, "old"), "block", "old").alias("n"), notes.note(notes.front_matter(pairs), "block").alias("fresh")).first()
    assert out.n == '---\nnote_id: "c1"\ntags: ["type/x"]\nmine: 1\nlist:\n  - a\n---\nbefore\n' + notes.BEGIN + "\nnew\n" + notes.END + "\nafter\n"
    again = spark.createDataFrame([("c1", "new", out.n)], one.schema).select(notes.note(notes.front_matter(pairs, "old"), "block", "old").alias("n")).first()
    assert again.n == out.n
    assert out.fresh == '---\nnote_id: "c1"\ntags: ["type/x"]\n---\n' + notes.BEGIN + "\nnew\n" + notes.END + "\n"


def test_written_notes(spark, tmp_path):
    vault.write_vault(spark.createDataFrame([("Concepts/a.md", "x"), ("Sources/b.md", "y")], "path string, content string"), str(tmp_path))
    assert (tmp_path / "Concepts" / "a.md").read_text() == "x" and sorted(p.name for p in tmp_path.rglob("*.*")) == ["a.md", "b.md"]


def test_terms_and_the_strongest_penalty(spark):
    row = spark.createDataFrame([("A heap is a Heap tree",)], "text string").select(classify.terms("text").alias("t")).first()
    assert row.t == ["heap", "is", "heap", "tree", "heap is", "is heap", "heap tree"]
    rows = spark.createDataFrame([("red apple pie", "food"), ("green apple cake", "food"), ("loud brass band", "music"), ("loud string band", "music")] * 3, "text string, label string")
    best, scores = classify.strongest(lambda c: classify.TfidfRegression(c, rounds=20), rows, rows, grid=(1.0, 10.0))
    assert best == 1.0 and scores == {1.0: 1.0, 10.0: 1.0}


def test_a_corpus_cleaned_as_asked(spark):
    """Numbers of a document that are no lecture's course numbers stay where white space alone is to be cleaned."""
    lectures = spark.createDataFrame([("v", "a", "maths", 1, "train")], "video string, course string, domain string, lecture int, split string")
    sources = spark.createDataFrame([("y", "v", 0)], "source string, video string, root int")
    chunks = spark.createDataFrame([("y", 0, "call 555-824-1234  or 18.06 now")], "source string, index int, text string")
    assert gold.corpus(lectures, sources, chunks, clean=T.collapse).first()["text"] == "call 555-824-1234 or 18.06 now"
    assert "824" not in gold.corpus(lectures, sources, chunks).first()["text"]
