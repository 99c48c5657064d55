"""Jaccard join on word shingles: candidates share prefix tokens under several global token orders."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import SPACED, bounded, groups, hashed, materialise, mix, slices, table
from lodestone.llm.components import components

#: Words of a shingle; similarity in hundredths; frequent tokens that come last in each order (a bound on
#: what is broadcast: it decides how tokens are ordered, never which links are found); members and shingles of a block;
#: rows of candidates up to which these are broadcast to the texts (about 60 bytes each), beyond which both are shuffled;
#: a text with more than one in so many of all rows is hot: fewer than that many are, and these are broadcast.
WIDTH, PERCENT, FREQUENT, LEAST_FREQUENT, BLOCK, BLOCK_SHINGLES, MOST_BROADCAST, MOST_HOT = 3, 90, 1_000_000, 6, 1500, 1_000_000, 500_000, 1000
_U = np.uint64
_SALTS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a shorter text's words are one shingle."""
    words, first = hashed(texts, SPACED)
    if len(words) >= width:
        all_ = np.zeros(len(words) - width + 1, _U)
        for k in range(width):
            all_ = mix(all_ * _U(0x9FB21C651E98DF25) + words[k : len(words) - width + 1 + k])
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            yield np.unique(all_[a : b - width + 1])
        elif b > a:
            one = np.full(1, b - a, _U)
            for k in range(a, b):
                one = mix(one * _U(0x9FB21C651E98DF25) + words[k : k + 1])
            yield mix(one ^ _SALTS[1])
        else:
            yield np.empty(0, _U)


def _fingerprint(s: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], _U).view(np.int64)[0])


_NONE = np.empty(0, _U)
_NAMES = ["doc_id", "n", "node", "first1", "first2", "count", "text_hash"]
_SEEN = "doc_id long, n long, node long, first1 binary, first2 binary, count long, text_hash long"


def _short(s: np.ndarray, order: int, percent: int) -> bytes:
    """The sorted distinct keys of a set's first tokens in an order by hash alone, in 32 bits each.

    It is longer than the set's part that a similar set can lack, so similar sets share many of these.
    """
    key = (mix(s ^ _SALTS[order]) >> _U(32)).astype("<u4")
    take = min(len(s), (100 - percent) * len(s) * 7 // 1000 + 8)
    return np.unique(np.partition(key, take - 1)[:take] if take < len(s) else key).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, n, node and their prefixes in two orders) and, with n null, of tokens that several documents of the task share (node, count)."""
    held: list[np.ndarray] = []
    common = np.empty(0, _U), np.empty(0, np.int64)

    def count() -> None:
        nonlocal common
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        every, number = np.unique(np.concatenate([common[0], tokens[n >= 2]]), return_inverse=True)
        common = every, np.bincount(number, weights=np.concatenate([common[1], n[n >= 2]]), minlength=len(every)).astype(np.int64)

    size = 0
    for batch, texts in slices(batches):
        sets = list(shingles(texts, width))
        held += sets
        size += sum(map(len, sets))
        if size > 4_000_000:
            count()
            size = 0
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(_fingerprint, sets), pa.int64()), *[pa.array([_short(x, k, percent) for x in sets], pa.binary()) for k in (1, 2)], pa.nulls(len(sets), pa.int64()), batch.column(2)], names=_NAMES)
    if held:
        count()
    tokens, counts = common[0][common[1] >= least], common[1][common[1] >= least]
    none = pa.nulls(len(tokens), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(tokens.view(np.int64)), pa.nulls(len(tokens), pa.binary()), pa.nulls(len(tokens), pa.binary()), pa.array(counts), none], names=_NAMES)


def prefix(s: np.ndarray, order: int, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set that come first in an order: if two sets are similar enough, they share one of these in every order."""
    n = len(s)
    take = n - (percent * n + 99) // 100 + 1
    if take >= n:
        return s
    key = mix(s ^ _SALTS[order]) >> _U(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        key |= (frequent[at] == s).astype(_U) << _U(63)
    return s[np.argpartition(key, take)[:take]]


def _postings(batches: Iterator[pa.RecordBatch], width: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """(key, node) for each prefix token, under two size classes: sets that can be similar are in the same or in neighbouring ones."""
    last, step = frequent.value, math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1.0
    for _, texts in slices(batches):
        keys, nodes, seen = [], [], set()
        for s in shingles(texts, width):
            if len(s) and (node := _fingerprint(s)) not in seen:
                seen.add(node)
                first, size = prefix(s, 0, last, percent), int(math.log(len(s)) / step)
                keys += [mix(first ^ k) for k in mix(np.array([size, size + 1], _U))]
                nodes.append(np.full(2 * len(first), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])


def _inverted(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each member's tokens as small numbers, and for each number where its members stand and who they are."""
    sizes = np.array([len(p) for p in parts])
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    member = np.repeat(np.arange(len(parts)), sizes)
    by = np.argsort(number, kind="stable")
    return np.split(number, np.cumsum(sizes)[:-1]), np.searchsorted(number[by], np.arange(number.max() + 2)), member[by]


def _shared(tokens: np.ndarray, first: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """How many of these tokens each member has."""
    lengths = first[tokens + 1] - first[tokens]
    at = np.repeat(first[tokens] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return np.bincount(who[at], minlength=n)


def _may_match(sizes: np.ndarray, a: int, percent: int) -> np.ndarray:
    return 100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a])


def candidate_groups(sizes: np.ndarray, firsts: list[list[np.ndarray]], percent: int, side: np.ndarray) -> np.ndarray:
    """For each member the least one that candidate pairs join it to: of fitting sizes, other sides (where there are two), and in every order enough shared first keys.

    Similar sets a and b share at least o = percent * (|a| + |b|) / (100 + percent) tokens. Up to the smaller of their
    last keys both are known in full, so all but |a| - o of a's keys below it are keys of b, and the other way round.
    """
    n, root, two = len(sizes), np.arange(len(sizes)), len(np.unique(side)) > 1
    last = [np.array([f[-1] for f in each]) for each in firsts]
    inverted = [_inverted(f) for f in firsts] if n > 12 else []
    for a in range(n):
        may = _may_match(sizes, a, percent) & (root != root[a])
        may[: a + 1] = False
        if two:
            may &= side != side[a]
        least = -(-percent * (sizes + sizes[a]) // (100 + percent))
        for k, each in enumerate(firsts):
            some = np.flatnonzero(may)
            if not len(some):
                break
            if n > 12:
                tokens, at, members = inverted[k]
                both = _shared(tokens[a], at, members, n)[some]
            else:
                both = np.array([len(np.intersect1d(each[a], each[b], assume_unique=True)) for b in some])
            mine = np.searchsorted(each[a], np.minimum(last[k][a], last[k][some]))
            theirs = np.array([np.searchsorted(each[b], min(last[k][a], last[k][b])) for b in some]) if n <= 12 else np.where(last[k][some] <= last[k][a], [len(each[b]) - 1 for b in some], 0)
            may[some] = (both > 0) & (both >= mine - (sizes[a] - least[some])) & (both >= theirs - (sizes[some] - least[some]))
        for r in np.unique(root[may]):
            root[root == max(r, root[a])] = min(r, root[a])
    return root


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the similarity graph among the sets (between its two sides, if side is given).

    Every pair that is not joined yet has its whole intersection counted.
    """
    n, sizes, out, root = len(sets), np.array([len(s) for s in sets]), [], np.arange(len(sets))
    if n <= 12:
        for a in range(n):
            for b in range(a + 1, n):
                if root[a] != root[b] and (side is None or side[a] != side[b]) and 100 * min(sizes[a], sizes[b]) >= percent * max(sizes[a], sizes[b]):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                        root[root == root[b]] = root[a]
                        out.append((a, b))
        return out
    whole, begins, who = _inverted(sets)
    for a in range(n):
        may = _may_match(sizes, a, percent) & (root != root[a])
        may[: a + 1] = False
        if side is not None:
            may &= side != side[a]
        if may.any():
            both = _shared(whole[a], begins, who, n)
            for b in np.flatnonzero(may & (100 * both >= percent * (sizes + sizes[a] - both))):
                if root[a] != root[b]:
                    root[root == root[b]] = root[a]
                    out.append((a, int(b)))
    return out


def _refined(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From the members of each hub, the groups that candidate pairs hold together: (group, node, side). Groups of the same members have the same name."""
    import xxhash

    schema, made = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("side", pa.int32())]), []

    def out() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*made, strict=True)] if made else [pa.array([], f.type) for f in schema]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for group in groups(batches, ["hub", "i", "j"]):
        if group.num_rows > 1:
            node, side = group.column("node").to_numpy(), group.column("block").to_numpy()
            firsts = [[np.frombuffer(x, "<u4") for x in group.column(f"first{k}").to_pylist()] for k in (1, 2)]
            one = np.unique(node, return_index=True)[1]  # rows that repeat an id and a text
            node, side, firsts = node[one], side[one], [[f[k] for k in one] for f in firsts]
            root = candidate_groups(group.column("n").to_numpy()[one], firsts, percent, side)
            for r in np.flatnonzero(np.bincount(root) > 1):
                own = np.flatnonzero(root == r)
                own = own[np.argsort(node[own])]
                apart = (side[own] != side[own].min()).astype(np.int32)
                name = np.array([xxhash.xxh3_64_intdigest(node[own].tobytes() + apart.tobytes())], _U).view(np.int64)
                made.append((np.repeat(name, len(own)), node[own], apart))
        if len(made) > 2000:
            yield out()
    yield out()


def _verified(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    vertex, links = pa.struct([("first", pa.int64()), ("node", pa.int64())]), []

    def out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([{"first": x[side], "node": x[side + 1]} for x in links], vertex) for side in (0, 2)], names=["u", "v"])
        links.clear()
        return done

    for group in groups(batches, ["group"]):
        sets = [s for a in range(0, group.num_rows, 200) for s in shingles([t.encode() if t else b"" for t in group.column("text").slice(a, 200).to_pylist()], width)]
        nodes, ids, side = group.column("node").to_pylist(), group.column("doc_id").to_pylist(), group.column("side").to_numpy()
        true = [k for k, s in enumerate(sets) if _fingerprint(s) == nodes[k]]  # an id can stand for several texts
        sets, names, side = [sets[k] for k in true], [(ids[k], nodes[k]) for k in true], side[true]
        links += [names[a] + names[b] for a, b in linked(sets, percent, side if len(np.unique(side)) > 1 else None)]
        if len(links) > 5000:
            yield out()
    yield out()


def _undominated(groups_: DataFrame) -> DataFrame:
    """Groups (group, node, side) without those that lie in the largest one-sided group of each of their members, which verifies all their pairs."""
    size = groups_.groupBy("group").agg(F.count("*").alias("size"), F.max("side").alias("sides"))
    rank = F.when(F.col("sides") == 0, F.struct("size", "group"))
    marked = groups_.join(size, "group").withColumn("best", F.max(rank).over(W.partitionBy("node"))["group"])
    inside = marked.groupBy("group").agg(F.min("best").alias("a"), F.max("best").alias("b"), F.count("best").alias("n"), F.count("*").alias("all")).where("n = all and a = b and a <> group")
    return groups_.join(inside.select("group"), "group", "left_anti")


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, node, component_id, component_node and text_hash of every document: the smallest doc_id that links of this similarity reach.

    Texts with the same shingles are one node, named by a 64-bit fingerprint. Nodes that share a prefix token of the first
    order (frequent tokens last) and a size class meet at its hub, their least node, so all pairs that can be similar meet in
    some hub's members; beyond `block` of these, or BLOCK_SHINGLES, they are split into pairs of blocks, which bounds a task.
    There the prefixes in two more orders leave the groups that candidate pairs hold together, each group once and none that
    lies in another; only their texts are read again and verified, and only links that span components leave a task, never all pairs.
    Links name nodes by their smallest doc_id and fingerprint, so a component's root has its id and no join gathers a component's
    rows, and unlike texts of one doc_id stay apart (component_node is the root's fingerprint); texts
    that more than one in MOST_HOT rows repeats get theirs by a broadcast of fewer than MOST_HOT rows.

    Null, empty and blank texts have no shingles, link with nothing and are their own component; so are rows with a null id,
    whose component is null. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    own = bounded(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    seen = materialise(own.mapInArrow(partial(_sets, width=width, percent=percent, least=2), _SEEN), "shingle-sets")
    often = seen.where("n is null").groupBy("node").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST_FREQUENT).orderBy(F.desc("count"), "node").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(often.select("node").toArrow().column("node").to_numpy().view(_U)))
    each = seen.where("n is not null").select("doc_id", "n", "node", "text_hash")
    texted = each.where("n > 0 and doc_id is not null")
    nodes = texted.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"))  # grouped before any join: copies of a text do not meet

    posted = own.select("text").mapInArrow(partial(_postings, width=width, percent=percent, frequent=frequent), "key long, node long")
    stars = materialise(
        posted.selectExpr("node", "min(node) over (partition by key) as hub", "max(node) over (partition by key) as other").where("hub <> other").select("hub", "node").distinct(), "stars"
    )
    reps = materialise(nodes.select("node", F.col("first").alias("doc_id"), "n").join(stars.select("node").distinct(), "node", "left_semi"), "nodes")
    members = stars.join(reps, "node")
    blocks = members.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    number = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    # rows that repeat a text under one doc_id are one member of a hub
    prefixes = seen.select("node", "doc_id", "n", "first1", "first2").join(reps.select("node", "doc_id"), ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"])
    meets = members.join(blocks, "hub").withColumn("block", number).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("hub", "node", "doc_id", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")).join(prefixes, ["node", "doc_id"])
    near = meets.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").select("hub", "i", "j", "block", "node", "n", "first1", "first2").mapInArrow(partial(_refined, percent=percent), "group long, node long, side int")
    near = materialise(_undominated(materialise(near.distinct(), "groups")).join(reps.select("node", "doc_id"), "node"), "candidates")
    wanted = F.broadcast(near) if near.count() <= MOST_BROADCAST else near
    texts = own.join(wanted, "doc_id").select("group", "node", "doc_id", "side", "text")
    links = texts.repartition("group").sortWithinPartitions("group").mapInArrow(partial(_verified, width=width, percent=percent), "u struct<first: long, node: long>, v struct<first: long, node: long>")

    roots = components(links).select(F.col("node.first").alias("first"), F.col("node.node").alias("node"), "root")
    placed = nodes.join(roots, ["first", "node"], "left")
    placed = materialise(placed.select("node", F.coalesce("root.first", "first").alias("component_id"), F.coalesce("root.node", "node").alias("component_node"), "copies"), "places")
    many = (placed.agg(F.sum("copies")).first()[0] or 0) // MOST_HOT
    hot = F.broadcast(placed.where(F.col("copies") > many).drop("copies"))
    rest = texted.join(hot, "node", "left_anti").join(placed.where(F.col("copies") <= many).drop("copies"), "node")
    alone = each.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).withColumn("component_node", F.col("node"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "node", "component_id", "component_node", "text_hash"]
    return texted.join(hot, "node").select(*names).unionByName(rest.select(*names)).unionByName(alone.select(*names))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
