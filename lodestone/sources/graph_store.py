"""A concept graph as Parquet tables in a shared folder: loads stamped with an id, pruned to what the last one said, and made current by one rename."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.merge import check_models
from lodestone.sources.scratch import materialise, small

#: Columns of each table. Rows that carry a load_id are pruned when a later load does not say them again.
_EVIDENCE = "confidence double, n_mentions long, chunks array<string>"
SCHEMAS = {
    "domains": "name string",
    "sources": "id string, title string, kind string, path string, duration double, pages int, url string",
    "source_domains": "source string, domain string",
    "chunks": "chunk string, source string, index int, text string, n_words int, start double, end double, page_start int, page_end int, heading string, locator string",
    "concepts": "id string, name string, aliases array<string>, type string, definition string, confidence double, n_mentions long, n_chunks long, load_id string",
    "mentions": "concept string, chunk string, confidence double, surfaces array<string>, start double, end double, locator string, load_id string",
    "relations": f"subject string, predicate string, object string, {_EVIDENCE}, load_id string",
    "part_of": f"subject string, object string, {_EVIDENCE}, load_id string",
    "facts": "id string, chunk string, statement string, confidence double, linked_by string, start double, end double, locator string, memory boolean, load_id string",
    "about": "fact string, concept string, load_id string",
    "concept_domains": "concept string, domain string",
    "concept_vectors": "id string, hash string, v array<float>",
    "chunk_vectors": "id string, source string, hash string, v array<float>",
}
KEYS = {"domains": ["name"], "sources": ["id"], "source_domains": ["source", "domain"], "chunks": ["chunk"], "concepts": ["id"], "mentions": ["concept", "chunk"], "relations": ["subject", "predicate", "object"], "part_of": ["subject", "object"], "facts": ["id"], "about": ["fact", "concept"], "concept_domains": ["concept", "domain"], "concept_vectors": ["id"], "chunk_vectors": ["id"]}
#: Tables that grow with the texts are kept in buckets of their sources; a load writes the buckets of its own sources alone.
BUCKETED, BUCKETS = ("chunks", "chunk_vectors"), 64
#: Rows and bytes up to which the ends that are looked for are broadcast; several tables do so at once.
FEW = 100_000, 8_000_000
Embedder = tuple[str, Callable[[Column], Column]]


def concept_text(name: str = "name", definition: str = "definition") -> Column:
    """What stands for a concept when it is embedded."""
    return F.when(F.coalesce(F.length(definition), F.lit(0)) > 0, F.concat(F.col(name), F.lit(": "), F.col(definition))).otherwise(F.col(name))


def stale(rows: DataFrame, load_id: str) -> DataFrame:
    """Rows that another load wrote. A row without a load id compares as null, so it is neither written anew nor pruned."""
    return rows.where(F.col("load_id") != load_id)


class GraphStore:
    """The tables of a graph below `root`, which driver and executors share.

    A load writes new files beside the old ones and then a manifest, which names the files of every table; the manifest of
    the highest number is the graph. It appears by a rename, so a load that dies leaves the graph before it, and readers of
    that one keep their files until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self) -> dict:
        versions = self._manifests()
        if not versions:
            return {"version": 0, "meta": {}, "tables": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.root}/manifests/{versions[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        folder, number = f"{self.root}/manifests", manifest["version"] + 1
        manifest = manifest | {"version": number}
        final, draft = self._path(f"{folder}/{number}.json"), self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"another load has written version {number}")

    def meta(self) -> dict:
        """Models and size of the vectors of the current graph, and its load id."""
        return self._manifest()["meta"]

    # reading

    def _read(self, manifest: dict, name: str, only: list[int] | None = None) -> DataFrame:
        places = manifest["tables"].get(name, {})
        paths = [p for b, p in places.items() if only is None or _bucket_of(b) in only]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{p}" for p in paths])

    def table(self, name: str) -> DataFrame:
        """A table of the current graph."""
        return self._read(self._manifest(), name)

    def counts(self) -> DataFrame:
        """(kind, n): nodes by label and edges by type, those of none left out; a fact's place is an edge of its own."""
        t = self.table
        one = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        parts = [one(k, t(n)) for k, n in (("Domain", "domains"), ("Source", "sources"), ("Chunk", "chunks"), ("Concept", "concepts"), ("Fact", "facts"), ("RELATED_TO", "relations"), ("ABOUT", "about"), ("embedded Concept", "concept_vectors"), ("embedded Chunk", "chunk_vectors"))]
        parts += [one("PART_OF", t(n)) for n in ("source_domains", "concept_domains", "chunks", "part_of")] + [one("MENTIONED_IN", t("mentions")), one("MENTIONED_IN", t("facts").where("chunk is not null"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")

    def find_concept(self, name: str) -> DataFrame:
        """The concept with this name or alias, in either case, that is mentioned most."""
        low = name.lower()
        hit = (F.lower("name") == low) | F.exists("aliases", lambda a: F.lower(a) == low)
        return self.table("concepts").where(hit).orderBy(F.desc("n_mentions"), "id").limit(1)

    # loading

    def _bucket(self, source: str) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str, load_id: str) -> str:
        path = f"tables/{name}/{load_id}"
        rows.select(*_columns(name)).write.parquet(f"{self.root}/{path}")
        return path

    def _upsert_buckets(self, manifest: dict, name: str, new: DataFrame, load_id: str) -> DataFrame:
        """new rows (with source) replace those of their key; buckets without a new row keep their files. Returns the new rows, written.

        The new rows are written to their buckets at once, older ones of these buckets to files of their own beside them.
        """
        path, old = f"tables/{name}/{load_id}", manifest["tables"].get(name, {})

        def put(rows: DataFrame, path: str) -> tuple[DataFrame, list[int]]:
            _fitted(rows.withColumn("bucket", self._bucket("source")).hint("rebalance", "bucket"), name, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
            written = self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(f"{self.root}/{path}")
            return written, sorted(r["bucket"] for r in written.select("bucket").distinct().collect())

        written, touched = put(new.dropDuplicates(KEYS[name]), path)
        before = {p for p in old if _bucket_of(p) in touched}
        if before:
            _, left = put(self._read(manifest, name, touched).join(_moved(written.select(*KEYS[name])), KEYS[name], "left_anti"), f"{path}-kept")
            old = {p: at for p, at in old.items() if p not in before} | {f"{b}-kept": f"{path}-kept/bucket={b}" for b in left}
        manifest["tables"][name] = old | {str(b): f"{path}/bucket={b}" for b in touched}
        return written

    def _upsert(self, manifest: dict, name: str, new: DataFrame, load_id: str) -> DataFrame:
        """A small unstamped table with new rows in place of those of their key."""
        new = new.select(*_columns(name)).dropDuplicates(KEYS[name])
        kept = self._read(manifest, name).join(_moved(new.select(*KEYS[name])), KEYS[name], "left_anti")
        return self._put(manifest, name, kept.unionByName(new), load_id)

    def _put(self, manifest: dict, name: str, rows: DataFrame, load_id: str) -> DataFrame:
        manifest["tables"][name] = {"0": self._write(rows, name, load_id)}
        return self._read(manifest, name)

    def _renew(self, manifest: dict, name: str, own: DataFrame, rest: DataFrame, load_id: str) -> DataFrame:
        """A stamped table of this load's own rows, and of those of `rest` that it does not say again, in files of their own.

        The own rows are written first and read back, so they are computed once; where `rest` is empty, nothing is compared.
        """
        written = self._put(manifest, name, own, load_id)
        if rest.isEmpty():
            return written
        kept = rest.join(_moved(written.select(*KEYS[name])), KEYS[name], "left_anti")
        manifest["tables"][name]["1"] = self._write(kept, name, f"{load_id}-kept")
        return self._read(manifest, name)

    def _sources(self, manifest: dict, sources: DataFrame, chunks: DataFrame, domain: str, load_id: str) -> DataFrame:
        """Sources of a domain and their chunks upserted; chunks of no known source are left out. Returns the new chunks."""
        sources = _fitted(sources, "sources")
        new = {"sources": sources, "domains": self.spark.range(1).select(F.lit(domain).alias("name")), "source_domains": sources.select(F.col("id").alias("source"), F.lit(domain).alias("domain"))}
        known = _together(lambda name: self._upsert(manifest, name, new[name], load_id), new)["sources"]
        return self._upsert_buckets(manifest, "chunks", _typed(chunks, "chunks").join(_moved(known.select(F.col("id").alias("source"))), "source", "left_semi"), load_id)

    def _embed_chunks(self, manifest: dict, chunks: DataFrame, embed: Embedder, load_id: str) -> int:
        """Vectors of new chunks (chunk, source, text) whose text or model changed."""
        model, vector = embed
        now = chunks.where("text is not null").select(F.col("chunk").alias("id"), "source", "text", T.embedding_hash(model, "text").alias("hash")).dropDuplicates(["id"])
        stored = self._read(manifest, "chunk_vectors").select("id", "hash")
        fresh = now.join(_moved(stored), ["id", "hash"], "left_anti").withColumn("v", vector(F.col("text")))
        return self._upsert_buckets(manifest, "chunk_vectors", fresh, load_id).count()

    def _check(self, meta: dict, model: str | None, embed: Embedder | None, replace: bool) -> int | None:
        """The vectors' size, once the models are allowed; a new embedding model is asked once."""
        check_models(meta, model, embed[0] if embed else None, replace)
        if embed is None:
            return None
        if meta.get("embed_model") == embed[0] and meta.get("dims"):
            return meta["dims"]
        return self.spark.createDataFrame([("dimension probe",)], "t string").select(F.size(embed[1](F.col("t")))).first()[0]

    def load(self, rows: dict[str, DataFrame], domain: str, model: str, embed: Embedder | None = None, replace: bool = False) -> dict:
        """Write the rows of a graph (as of `merge.build_rows`, with sources) and drop what an earlier load said and this one does not.

        Rows replace those of their key as a whole. Concepts, facts and edges get this load's id; those of another load's id
        are pruned, with the edges and vectors of pruned concepts; rows without a load id, memories, and the links of concepts
        and sources to domains stay. Sources and chunks only grow. Edges need both ends. A graph holds the knowledge of one
        model and the vectors of one embedding model; `replace` drops concepts, facts, and vectors of another model first.
        Mentions and relations are read twice, so what is dear to compute is better given as written.
        Returns how many rows of each kind were given, how many texts were embedded, and what was removed.
        """
        manifest = self._manifest()
        self.buckets = manifest["buckets"]
        meta, load_id = manifest["meta"], uuid.uuid4().hex
        dims = self._check(meta, model, embed, replace)
        if replace:
            for name in ("concepts", "mentions", "relations", "part_of", "concept_domains", "concept_vectors"):
                manifest["tables"].pop(name, None)
            memories = self._read(manifest, "facts").where("coalesce(memory, false)")
            self._put(manifest, "about", self.spark.createDataFrame([], SCHEMAS["about"]), f"{load_id}-0")
            self._put(manifest, "facts", memories, f"{load_id}-0")
            if embed is not None and meta.get("embed_model") != embed[0]:
                manifest["tables"].pop("chunk_vectors", None)
        chunks = self._sources(manifest, rows["sources"], rows["chunks"], domain, load_id)
        before = {n: self._read(manifest, n) for n in SCHEMAS}
        # what is the same in every row of a load is added once rows have been moved
        own = lambda name, df: _fitted(df.withColumn("memory", F.lit(False)) if name == "facts" else df, name).withColumn("load_id", F.lit(load_id))
        memory, unstamped = F.coalesce(F.col("memory"), F.lit(False)), F.col("load_id").isNull()
        old = lambda name, new: before[name].join(_moved(new.select(*KEYS[name])), KEYS[name], "left_anti")
        few = lambda df, name: small(_moved(materialise(df, name)), *FEW)  # noqa: E731  computed once, though measured and joined
        placed = _moved(before["chunks"].select("chunk"))

        alive = self._renew(manifest, "concepts", own("concepts", _typed(rows["concepts"], "concepts").dropDuplicates(KEYS["concepts"])), before["concepts"].where(unstamped), load_id)
        # facts of no known chunk say nothing; those that do are kept with what they are about, for both tables
        stated = materialise(rows["facts"].join(placed, "chunk", "left_semi"), "stated-facts")
        facts = self._renew(manifest, "facts", own("facts", _typed(stated, "facts").dropDuplicates(KEYS["facts"])), before["facts"].where(memory | unstamped), load_id)
        concepts = alive.where(F.col("load_id") == load_id)
        dead = few(before["concepts"].select("id").join(_moved(alive.select("id")), "id", "left_anti"), "dead-concepts")
        memories = few(facts.where(memory).select(F.col("id").alias("fact")), "memories")

        new = {"mentions": rows["mentions"], "relations": rows["relations"], "part_of": rows["part_of"], "about": stated.select(F.col("id").alias("fact"), F.explode("concepts").alias("concept"))}
        ends = {"mentions": ["concept"], "relations": ["object", "subject"], "part_of": ["object", "subject"], "about": ["concept"]}

        def edges(name: str) -> DataFrame:
            # rows of a key are moved together once: mentions to their chunk, others to their last end
            said, last = _typed(new[name], name), ends[name][-1:] if name != "mentions" else []
            for end in ends[name]:
                if end not in last:
                    said = said.join(few(said.select(end).distinct().join(_moved(alive.select(F.col("id").alias(end))), end, "left_anti"), "unknown-ends"), end, "left_anti")
            said = said.where(" and ".join(f"{end} is not null" for end in ends[name]))
            said = said.join(placed, "chunk", "left_semi") if name == "mentions" else _with_ends(said, alive, last)
            said = own(name, said.dropDuplicates(KEYS[name]))
            rest = before[name].where(unstamped)
            if name == "about":
                rest = rest.join(_moved(facts.select(F.col("id").alias("fact"))), "fact", "left_semi").unionByName(before[name].where(~unstamped).join(memories, "fact", "left_semi"))
            return self._renew(manifest, name, said, _with_ends(rest, alive, ends[name]), load_id)

        def gone(name: str) -> DataFrame:
            """Edges of earlier loads that are not said again between nodes that are still there. All ends were there before, so only dead ones are looked for."""
            rest = stale(old(name, whole[name]), load_id)
            for end in ends[name]:
                rest = rest.join(dead.select(F.col("id").alias(end)), end, "left_anti")
            return rest.join(_moved(facts.where(~memory).select(F.col("id").alias("fact"))), "fact", "left_semi") if name == "about" else rest

        whole = _together(edges, new)
        of_load = lambda df: df.where(F.col("load_id") == load_id)
        counted = {n: of_load(df) for n, df in (whole | {"concepts": alive, "facts": facts}).items()} | {"chunks": chunks, "sources": rows["sources"]}
        counted["gone concepts"], counted["gone facts"] = stale(old("concepts", alive), load_id), stale(old("facts", facts).where(~memory), load_id)
        for name in new:
            counted[f"gone {name}"] = gone(name)
        n = _counts(counted)
        stats = {k: v for k, v in n.items() if not k.startswith("gone ")}
        stats["removed"] = {"concepts": n["gone concepts"], "facts": n["gone facts"], "edges": sum(n[f"gone {name}"] for name in new)}

        # a concept belongs to the domains of the sources that mention it, by the edges as they were before pruning
        said = before["mentions"].select("concept", "chunk").unionByName(whole["mentions"].select("concept", "chunk"))
        of_source = before["source_domains"].groupBy("source").agg(F.collect_set("domain").alias("domains"))
        of_chunk = before["chunks"].select("chunk", "source").join(_moved(of_source), "source").select("chunk", "domains")
        belongs = said.join(_moved(of_chunk), "chunk").select("concept", F.explode("domains").alias("domain")).distinct().join(_moved(concepts.select(F.col("id").alias("concept"))), "concept", "left_semi")
        stays = before["concept_domains"].join(_moved(alive.select(F.col("id").alias("concept"))), "concept", "left_semi")
        self._put(manifest, "concept_domains", stays.unionByName(belongs).distinct(), load_id)

        stats["embedded"] = 0
        vectors = before["concept_vectors"].join(_moved(alive.select("id")), "id", "left_semi")
        if embed is not None:
            now = concepts.select("id", concept_text().alias("text")).withColumn("hash", T.embedding_hash(embed[0], "text"))
            fresh = materialise(now.join(_moved(vectors.select("id", "hash")), ["id", "hash"], "left_anti").select("id", "hash", embed[1](F.col("text")).alias("v")), "fresh-vectors")
            vectors = vectors.join(_moved(fresh.select("id")), "id", "left_anti").unionByName(fresh)
            stats["embedded"] = fresh.count() + self._embed_chunks(manifest, chunks, embed, load_id)
        self._put(manifest, "concept_vectors", vectors, load_id)
        manifest["meta"] = meta | {"model": model, "load_id": load_id} | ({"embed_model": embed[0], "dims": dims} if embed else {})
        self._commit(manifest)
        return stats

    def load_passages(self, sources: DataFrame, chunks: DataFrame, domain: str, embed: Embedder | None = None) -> int:
        """Add sources and their chunks without touching concepts or facts; only chunks whose text or model changed are embedded. Returns how many."""
        manifest = self._manifest()
        self.buckets = manifest["buckets"]
        dims, load_id = self._check(manifest["meta"], None, embed, False), uuid.uuid4().hex
        own = self._sources(manifest, sources, chunks, domain, load_id)
        n = self._embed_chunks(manifest, own, embed, load_id) if embed else 0
        if embed:
            manifest["meta"] |= {"embed_model": embed[0], "dims": dims}
        self._commit(manifest)
        return n

    def reset(self) -> None:
        """An empty graph; memories go as well. The files stay until `vacuum`."""
        manifest = self._manifest()
        self._commit(manifest | {"tables": {}, "meta": {}})

    def vacuum(self, older_than_seconds: float = 7 * 24 * 3600) -> int:
        """Delete files that the current manifest does not name, once they are so old that no load or reader can need them."""
        manifest, before, n = self._manifest(), time.time() - older_than_seconds, 0
        used = {"/".join(p.split("/")[:3]) for places in manifest["tables"].values() for p in places.values()}
        for name in SCHEMAS:
            folder = self._path(f"{self.root}/tables/{name}")
            for status in self._files.listStatus(folder) if self._files.exists(folder) else []:
                if f"tables/{name}/{status.getPath().getName()}" not in used and status.getModificationTime() / 1000 <= before:
                    n += bool(self._files.delete(status.getPath(), True))
        return n


def _together(write: Callable[[str], DataFrame], names) -> dict[str, DataFrame]:
    """Independent tables written at the same time; each is a job of its own."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(names, pool.map(write, names), strict=True))


def _bucket_of(part: str) -> int:
    """The bucket of a manifest's part: its new rows, or the older ones kept beside them."""
    return int(part.split("-")[0])


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def _counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows each has, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return {r["name"]: r["n"] for r in out.collect()}


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table that df has, in their types."""
    fields = [c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields if c in df.columns])


def _fitted(df: DataFrame, name: str, *more: str) -> DataFrame:
    """df with the columns and types of a table; columns that it lacks are null."""
    fields = [c.split(" ", 1) for c in SCHEMAS[name].split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields], *more)


def _moved(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffles. A file of ids is a few bytes a row, what the driver would broadcast of it more than a hundred."""
    return df.hint("merge")


def _with_ends(edges: DataFrame, nodes: DataFrame, ends: list[str]) -> DataFrame:
    for end in ends:
        edges = edges.join(_moved(nodes.select(F.col("id").alias(end))), end, "left_semi")
    return edges
