"""Notes read by id and written in two phases: moves, keys and text of the reader, pruning."""

import os

from pyspark.sql import functions as F

from lodestone.operators import notes as N
from lodestone.sources import vault

KEYS = [("type", "type")]


def rows(spark, *notes):
    return spark.createDataFrame([(i, n, "Concepts", f"# {n}\n\n{b}", "t") for i, n, b in notes], "id string, name string, folder string, block string, type string")


def states(df):
    return {r["id"]: (r["state"], r["path"]) for r in df.collect()}


def read(root, path):
    with open(os.path.join(root, path), encoding="utf-8") as f:
        return f.read()


def test_a_vault_over_several_exports(spark, tmp_path):
    root = str(tmp_path / "vault")
    assert vault.read_vault(spark, root).count() == 0
    got = states(vault.export(spark, rows(spark, ("a", "Heap", "x"), ("b", "heap", "y"), ("c", "Tree/2", "z")), KEYS, root))
    assert got == {"a": ("created", "Concepts/Heap.md"), "b": ("created", "Concepts/heap (2).md"), "c": ("created", "Concepts/Tree 2.md")}
    assert read(root, "Concepts/Heap.md").startswith('---\nnote_id: "a"\ntype: "t"\n---\n') and not os.path.exists(f"{root}/.drafts")

    os.makedirs(f"{root}/Mine/deep")
    os.rename(f"{root}/Concepts/Heap.md", f"{root}/Mine/deep/My heap.md")
    with open(f"{root}/Concepts/heap (2).md", "a", encoding="utf-8") as f:
        f.write("\nmy own words\n")
    text = read(root, "Concepts/Tree 2.md").replace("\n---\n", "\nrating: 5\n---\n", 1)
    with open(f"{root}/Concepts/Tree 2.md", "w", encoding="utf-8") as f:
        f.write(text)
    with open(f"{root}/plain.md", "w", encoding="utf-8") as f:
        f.write("no id")
    os.makedirs(f"{root}/.settings")
    with open(f"{root}/.settings/x.md", "w", encoding="utf-8") as f:
        f.write('---\nnote_id: "zz"\n---\n')

    same = rows(spark, ("a", "Heap", "x"), ("b", "heap", "y"), ("c", "Tree/2", "z"))
    assert {s for s, _ in states(vault.export(spark, same, KEYS, root, prune=True)).values()} == {"unchanged"}
    got = states(vault.export(spark, rows(spark, ("a", "Heap", "new"), ("d", "Heap", "w"), ("c", "Tree/2", "new")), KEYS, root, prune=True))
    assert got == {"a": ("updated", "Mine/deep/My heap.md"), "b": ("removed", "Concepts/heap (2).md"), "c": ("updated", "Concepts/Tree 2.md"), "d": ("created", "Concepts/Heap.md")}
    assert "rating: 5" in read(root, "Concepts/Tree 2.md") and "new" in read(root, "Mine/deep/My heap.md")
    assert "my own words" in read(root, "Concepts/heap (2).md") and 'note_status: "removed"' in read(root, "Concepts/heap (2).md")
    got = states(vault.export(spark, rows(spark, ("c", "Tree/2", "new")), KEYS, root, prune=True))
    assert got["b"][0] == "kept" and got["a"][0] == got["d"][0] == "deleted" and got["c"][0] == "unchanged"
    assert not os.path.exists(f"{root}/Mine/deep/My heap.md") and read(root, "plain.md") == "no id"


def test_removed_notes_stay_without_pruning(spark, tmp_path):
    root = str(tmp_path / "vault")
    vault.export(spark, rows(spark, ("a", "Heap", "x")), KEYS, root)
    assert states(vault.export(spark, rows(spark, ("b", "Tree", "x")), KEYS, root))["a"][0] == "removed"
    assert states(vault.export(spark, rows(spark, ("b", "Tree", "x")), KEYS, root))["a"][0] == "kept"
    assert states(vault.export(spark, rows(spark, ("a", "Heap", "x")), KEYS, root, prune=True)) == {"a": ("updated", "Concepts/Heap.md"), "b": ("deleted", "Concepts/Tree.md")}
    assert "note_status" not in read(root, "Concepts/Heap.md")


def test_drafts_of_a_failed_write_are_not_read(spark, tmp_path):
    root = str(tmp_path / "vault")
    writer = vault.VaultWriter(root)
    message = writer.write(iter([{"path": "Concepts/a.md", "content": "x"}]))
    assert vault.read_vault(spark, root).count() == 0
    writer.abort([message])
    assert not os.path.exists(f"{root}/.drafts")
    vault.write_vault(spark.createDataFrame([("Concepts/a.md", "x"), ("b.md", "y")], "path string, content string"), root)
    assert sorted(map(tuple, vault.read_vault(spark, root).collect())) == [("Concepts/a.md", "x"), ("b.md", "y")]


def test_text_of_the_reader(spark):
    block = f"{N.BEGIN}\nx\n{N.END}"
    rows = [("---\na: 1\n---\n" + block + "\n", False), ("---\na: 1\n---\nmine\n" + block, True), (block + "\nmine", True), ("mine", True), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "old string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", N.has_user_text("old").alias("got")).collect())
