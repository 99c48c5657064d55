"""A vault of notes as a Spark data source: Markdown files read by id, wherever they were moved, and written in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestone.functions import text as T
from lodestone.operators import notes as N
from lodestone.sources.scratch import materialise

#: Files that one task reads.
FILES = 2_000


def _files(uri: str):
    """The file system of a folder, of any store that pyarrow knows, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Paths(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]
    gone: list[str]


class VaultReader(DataSourceReader):
    """(path, content) of the notes below a folder; folders that begin with a dot are the reader's own settings."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(f.path[len(root) + 1 :] for f in found if f.is_file and f.path.endswith(".md") and not any(p.startswith(".") for p in f.path[len(root) + 1 :].split("/")))
        return [_Paths(paths[a : a + FILES]) for a in range(0, len(paths), FILES)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        files, root = _files(self.root)
        for path in partition.paths:
            with files.open_input_stream(f"{root}/{path}") as f:
                yield path, f.read().decode("utf-8", "replace")


class VaultWriter(DataSourceWriter):
    """Notes (path, content): tasks write drafts under names of their own, and the commit moves them into place; a null content deletes the note.

    A task that fails or is run twice leaves drafts that no commit names, and the abort removes those it knows; readers see
    whole notes only.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, iterator) -> _Written:
        files, root = _files(self.root)
        drafts, gone, folder = [], [], f".drafts/{uuid.uuid4().hex}"
        for k, row in enumerate(iterator):
            if row["content"] is None:
                gone.append(row["path"])
                continue
            if not drafts:
                files.create_dir(f"{root}/{folder}")
            with files.open_output_stream(f"{root}/{folder}/{k}.md") as f:
                f.write(row["content"].encode())
            drafts.append((f"{folder}/{k}.md", row["path"]))
        return _Written(drafts, gone)

    def commit(self, messages: list[_Written]) -> None:
        files, root = _files(self.root)
        for folder in sorted({to.rpartition("/")[0] for m in messages if m for _, to in m.drafts}):
            files.create_dir(f"{root}/{folder}" if folder else root)
        for m in messages:
            for draft, to in m.drafts if m else []:
                files.move(f"{root}/{draft}", f"{root}/{to}")
            for path in m.gone if m else []:
                files.delete_file(f"{root}/{path}")
        self._clean(files, root)

    def abort(self, messages: list) -> None:
        self._clean(*_files(self.root))

    def _clean(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/.drafts").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/.drafts")


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options["path"])


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a vault's notes."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").load(root)


def write_vault(changes: DataFrame, root: str) -> None:
    """Write notes (path, content) of a vault and delete those with a null content; other notes stay."""
    changes.sparkSession.dataSource.register(VaultSource)
    changes.select("path", "content").write.format("vault").mode("append").save(root)


def by_id(notes: DataFrame) -> DataFrame:
    """(id, path, content, status) of notes (path, content) whose front matter has an id; of several with one id, the first path."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n", 1)
    value = lambda key: F.regexp_extract(head, rf"(?m)^{key}:\s*['\"]?([^'\"\n]+)", 1)
    found = notes.select(F.trim(value("note_id")).alias("id"), "path", "content", F.trim(value("note_status")).alias("status")).where("id <> ''")
    return found.groupBy("id").agg(F.min_by(F.struct("path", "content", "status"), "path").alias("n")).select("id", "n.*")


def changes(notes: DataFrame, keys: list[tuple[str, Column | str]], existing: DataFrame, prune: bool = False) -> DataFrame:
    """(id, path, state, content): what an export of notes (id, name, folder, block and the columns of keys) makes of a vault (path, content).

    A note with the id of an existing one keeps its place, wherever it was moved, the reader's front-matter keys and the text
    around the managed block; a new one gets a name that no note has. States: created, updated, unchanged; notes without a
    source any more are marked and `removed`, or `deleted` if pruning and the reader wrote nothing there, and `kept` once
    they are marked. Content is null where the note is deleted.
    """
    old = by_id(existing)
    known = notes.join(old.select("id", F.col("path").alias("old_path"), F.col("content").alias("old")), "id", "left")
    fresh = placed(known.where("old_path is null"), existing)
    own = known.where("old_path is not null").withColumn("path", F.col("old_path")).unionByName(fresh.select(*known.columns, "path"))
    pairs = [("note_id", F.col("id")), *[(k, T.col(c)) for k, c in keys]]
    content = F.when(F.col("old").isNull(), N.note(N.front_matter(pairs), "block")).otherwise(N.note(N.front_matter(pairs, "old"), "block", "old"))
    made = own.withColumn("content", content)
    state = F.when(F.col("old").isNull(), "created").when(F.col("content") == F.col("old"), "unchanged").otherwise("updated")
    gone = old.join(notes.select("id"), "id", "left_anti")
    marked = F.regexp_replace("content", r"\A---\n", '---\nnote_status: "removed"\n')
    what = F.when(F.lit(prune) & ~N.has_user_text("content"), "deleted").when(F.col("status") == "removed", "kept").otherwise("removed")
    left = gone.withColumn("state", what).withColumn("content", F.when(F.col("state") == "removed", marked).when(F.col("state") == "kept", F.col("content")))
    return made.select("id", "path", state.alias("state"), "content").unionByName(left.select("id", "path", "state", "content"))


def placed(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """fresh notes with a path of their own in their folder: the safe name, or with the first number that no note, in any case, has in the vault."""
    plain = fresh.withColumn("plain", T.safe_name("name"))
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.md$", 1))
    number = F.expr("coalesce(try_cast(regexp_extract(stem, ' [(]([2-9]|[1-9][0-9]+)[)]$', 1) as int), 1)")
    used = existing.select(stem.alias("stem")).select(F.regexp_replace("stem", r" \(([2-9]|[1-9]\d+)\)$", "").alias("base"), number.alias("number"))
    taken = used.groupBy("base").agg(F.collect_set("number").alias("numbers"))  # of the notes of one name
    k = F.row_number().over(W.partitionBy(F.lower("plain")).orderBy("id"))
    free = F.filter(F.sequence(F.lit(1), F.col("k") + F.size("numbers")), lambda n: ~F.array_contains("numbers", n))
    numbered = plain.withColumn("k", k).join(taken, F.lower("plain") == F.col("base"), "left").withColumn("n", F.when(F.col("numbers").isNull(), F.col("k")).otherwise(F.get(free, F.col("k") - 1)))
    name = F.when(F.col("n") == 1, F.col("plain")).otherwise(F.concat("plain", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    return numbered.withColumn("path", F.concat("folder", F.lit("/"), name, F.lit(".md")))


def export(spark: SparkSession, notes: DataFrame, keys: list[tuple[str, Column | str]], root: str, prune: bool = False) -> DataFrame:
    """Bring a vault in line with notes, and say what became of each (id, path, state). Only notes that change are written."""
    done = materialise(changes(notes, keys, read_vault(spark, root), prune), "vault-changes")
    write_vault(done.where("state in ('created', 'updated', 'removed', 'deleted')"), root)
    return done.select("id", "path", "state")
