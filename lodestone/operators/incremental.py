"""Keyed upserts, mirror pruning, resume, memories and the reconciliation of an exported vault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.automaton import linked
from lodestone.operators.numbering import numbered


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The merged rows with a state: created, updated, unchanged or kept (only in old). New values win; a null leaves the old one."""
    values = [c for c in new.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    had, has = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    merged = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in values}
    same = reduce(lambda x, y: x & y, (merged[c].eqNullSafe(F.col(f"a.{c}")) for c in values), F.lit(True))
    state = F.when(had & ~has, "kept").when(~had, "created").when(same, "unchanged").otherwise("updated")
    return a.join(b, on, "full").select(*[F.coalesce(F.col(f"b.{k}"), F.col(f"a.{k}")).alias(k) for k in keys], *[v.alias(c) for c, v in merged.items()], state.alias("state"))


def mirror(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what is pruned) when a load replaces the last one: rows whose keys the new load lacks go."""
    return old.join(new.select(*keys).distinct(), keys, "left_semi"), old.join(new.select(*keys).distinct(), keys, "left_anti")


def stale(texts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Ids of texts (id, text) without a stored vector of this model and text; stored (id, hash)."""
    now = texts.select("id", T.embedding_hash(model, "text").alias("now"))
    return now.join(stored.select("id", "hash"), "id", "left").where(~F.col("now").eqNullSafe(F.col("hash"))).select("id", "now")


def pending(work: DataFrame, done: DataFrame, version: str, key: str = "id") -> DataFrame:
    """Work that no result of this version without an error covers."""
    return work.join(done.where((F.col("version") == version) & F.col("error").isNull()).select(key).distinct(), key, "left_anti")


def dedupe_memories(memories: DataFrame) -> DataFrame:
    """The first of the memories (scope, kind, seq, text) whose words are the same within a scope and kind; blank ones go."""
    keyed = memories.withColumn("key", T.memory_key("text")).where("key <> ''")
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("scope", "kind", "key").orderBy("seq"))).where("rank = 1").drop("rank")


def get_memory(memories: DataFrame, scope: str, seq: int) -> DataFrame:
    """The memory of this number in this scope, if there is one."""
    return memories.where((F.col("scope") == scope) & (F.col("seq") == seq))


def concept_links(memories: DataFrame, forms: DataFrame) -> DataFrame:
    """(memory, concept, a): the concepts that memories (memory, text) name, by the longest of the forms (concept, form array of tokens), each at its first place."""
    return linked(memories.select(F.col("memory").alias("doc"), T.tokens("text").alias("tokens")), forms).withColumnRenamed("doc", "memory")


def latest_memories(memories: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The newest n memories of each scope, newest first; of one kind, if it is given."""
    memories = memories if kind is None else memories.where(F.col("kind") == kind)
    return memories.withColumn("rank", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("created"), F.desc("seq")))).where(F.col("rank") <= n)


def recall(memories: DataFrame, scores: DataFrame, k: int, floor: float) -> DataFrame:
    """The k best memories of each scope at or above a score, then newest first: memories (scope, seq, created), scores (scope, seq, score)."""
    best = scores.where(F.col("score") >= floor).withColumn("r", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("score"), "seq"))).where(F.col("r") <= k)
    out = memories.join(best.select("scope", "seq", "score"), ["scope", "seq"])
    return out.withColumn("position", F.row_number().over(W.partitionBy("scope").orderBy(F.desc("created"), "seq")))


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories with new ones (scope, kind, text, created) appended under the next numbers, unless their words are there already."""
    keyed = new.withColumn("key", T.memory_key("text")).where("key <> ''").dropDuplicates(["scope", "kind", "key"])
    fresh = keyed.join(memories.select("scope", "kind", T.memory_key("text").alias("key")), ["scope", "kind", "key"], "left_anti")
    top = memories.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    numbers = numbered(fresh, ["created", "scope", "key"], "seq", first=top + 1)
    return memories.select("scope", "kind", "seq", "text", "created").unionByName(numbers.select("scope", "kind", "seq", "text", "created"))


def forget(memories: DataFrame, scope: str, seq: int | None = None) -> DataFrame:
    """Without one memory of a scope, or without the whole scope; the default scope is never cleared."""
    if seq is None and scope == "default":
        raise ValueError("the default scope cannot be cleared")
    gone = (F.col("scope") == scope) & (F.lit(True) if seq is None else F.col("seq") == seq)
    return memories.where(~gone)


def reconcile(notes: DataFrame, existing: DataFrame, prune: bool = False) -> DataFrame:
    """(id, state, content) of a vault: notes and existing (id, content).

    created, updated, unchanged; notes that have no source any more are removed (marked, content kept), or deleted if pruning
    and the reader wrote nothing in them. What stands outside the managed block of an existing note is kept by `managed`.
    """
    a, b = existing.alias("a"), notes.alias("b")
    gone = F.when(F.lit(prune) & ~has_user_text("a.content"), "deleted").otherwise("removed")
    state = F.when(F.col("b.id").isNull(), gone).when(F.col("a.id").isNull(), "created").when(F.col("a.content").eqNullSafe(F.col("b.content")), "unchanged").otherwise("updated")
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(F.coalesce("a.id", "b.id").alias("id"), state.alias("state"), F.coalesce("b.content", "a.content").alias("content"))


BEGIN, END = "%% managed %%", "%% /managed %%"


def has_user_text(old):
    """Whether a note has text of its reader's around its managed block; a note without a block is all theirs."""
    body = F.regexp_replace(F.coalesce(T.col(old), F.lit("")), r"(?s)\A---\n.*?\n---\n", "")
    at, end = F.instr(body, BEGIN), F.instr(body, END)
    around = F.when((at > 0) & (end > at), F.concat(F.substring(body, F.lit(1), at - 1), F.substring(body, end + len(END), F.length(body)))).otherwise(body)
    return F.btrim(around, F.lit(" \n\t\r")) != ""


def managed(old: str, block: str):
    """A note with its managed block replaced and all else as it was; without a block it is put before the text."""
    whole = F.concat(F.lit(f"{BEGIN}\n"), T.col(block), F.lit(f"\n{END}"))
    cut = F.regexp_replace(T.col(old), rf"(?s)^(.*?){re_quote(BEGIN)}.*?{re_quote(END)}(.*)$", "$1")
    rest = F.regexp_replace(T.col(old), rf"(?s)^(.*?){re_quote(BEGIN)}.*?{re_quote(END)}(.*)$", "$2")
    return F.when(T.col(old).contains(BEGIN) & T.col(old).contains(END), F.concat(cut, whole, rest)).otherwise(F.concat(whole, F.lit("\n\n"), F.coalesce(T.col(old), F.lit(""))))


def re_quote(x: str) -> str:
    import re

    return re.escape(x)
