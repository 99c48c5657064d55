"""Notes of a vault: the lines of each concept and source in their order, and front matter around the managed block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.incremental import BEGIN, END, has_user_text  # noqa: F401  it is asked of notes
from lodestone.operators.merge import both_ends_known

#: Front-matter keys that an export writes; all others are the reader's and stay.
OWNED = ("note_id", "note_kind", "note_status", "domain", "type", "confidence", "aliases", "mentions", "sources", "tags")
FACTS = 12


def note_names(rows: DataFrame, folder: str, order: list) -> DataFrame:
    """(id, name, stem, path): a file name of its own for each note of a folder; of equal ones, whatever their case, later ones are numbered."""
    named = rows.select("id", "name", *[c.alias(f"o{k}") for k, c in enumerate(order)]).withColumn("plain", T.safe_name("name"))
    w = W.partitionBy(F.lower("plain")).orderBy(*[F.col(f"o{k}") for k in range(len(order))], "id")
    stem = F.when(F.col("k") == 1, F.col("plain")).otherwise(F.concat("plain", F.lit(" ("), F.col("k").cast("string"), F.lit(")")))
    out = named.withColumn("k", F.row_number().over(w)).withColumn("stem", stem)
    return out.select("id", "name", "stem", F.concat(F.lit(f"{folder}/"), "stem", F.lit(".md")).alias("path"))


def note_link(name, stem) -> Column:
    name, stem = T.col(name), T.col(stem)
    return F.when(stem == name, F.concat(F.lit("[["), stem, F.lit("]]"))).otherwise(F.concat(F.lit("[["), stem, F.lit("|"), name, F.lit("]]")))


def related_lines(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(concept, dir, predicate, line): links to related concepts, most stated first, then by name; relations need two different kept ends.

    A symmetric predicate that a concept states itself is not listed the other way round.
    """
    kept = both_ends_known(relations.where("subject <> object"), names.select("id"))
    out = kept.select(F.col("subject").alias("concept"), F.lit("out").alias("dir"), "predicate", F.col("object").alias("other"), "n")
    back = kept.select(F.col("object").alias("concept"), F.lit("in").alias("dir"), "predicate", F.col("subject").alias("other"), "n")
    own = out.where("predicate = 'contrasts_with'").select("concept", "predicate").distinct()
    both = out.unionByName(back.join(own, ["concept", "predicate"], "left_anti").select(*out.columns)).withColumn("n", F.coalesce("n", F.lit(1)))
    linked = both.join(names.select(F.col("id").alias("other"), "name", note_link("name", "stem").alias("link")), "other")
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name", "other", "link")))
    return linked.groupBy("concept", "dir", "predicate").agg(F.array_join(F.transform(items, lambda x: x["link"]), ", ").alias("line"))


def taught_lines(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """(concept, source, title, line): the places where each source mentions a concept, by time and chunk, as links where the source is a video."""
    m = mentions.join(sources.select(F.col("id").alias("source"), F.col("name").alias("title"), "url"), "source")
    place = F.struct(F.coalesce("start", F.lit(0)).alias("start"), "chunk", T.time_link("url", "start", "place").alias("shown"))
    return m.groupBy("concept", "source", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["shown"]), ", ").alias("line"))


def fact_lines(facts: DataFrame, sources: DataFrame, most: int = FACTS) -> DataFrame:
    """(concept, rank, statement, source, place): the first `most` facts of each concept by title and time, and of those each statement once."""
    f = facts.join(sources.select(F.col("id").alias("source"), F.col("name").alias("title")), "source").withColumn("at", F.coalesce("start", F.lit(0)))
    ranked = f.withColumn("rank", F.row_number().over(W.partitionBy("concept").orderBy("title", "at", "source", "statement", "place"))).where(F.col("rank") <= most)
    first = ranked.groupBy("concept", "statement").agg(F.min_by(F.struct("rank", "source", "place"), "rank").alias("f"))
    return first.select("concept", "f.rank", "statement", "f.source", "f.place")


def concept_blocks(concepts: DataFrame, names: DataFrame, relations: DataFrame, mentions: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, block): the managed text of each concept's note. sources (id, name, url, stem); names as `note_names` gives them."""
    ordered = lambda rows, key, line: rows.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, line.alias("line")))), lambda x: x["line"]), "\n").alias("part"))
    head = F.when(F.col("dir") == "out", F.col("predicate")).otherwise(F.concat(F.lit("is "), "predicate", F.lit(" of")))
    related = ordered(related_lines(relations, names), [F.when(F.col("dir") == "out", 0).otherwise(1).alias("side"), "predicate"], F.concat(F.lit("- **"), F.translate(head, "_", " "), F.lit(":** "), "line"))
    stems = sources.select(F.col("id").alias("source"), F.concat(F.lit("[["), "stem", F.lit("]]")).alias("slink"))
    taught = ordered(taught_lines(mentions, sources).join(stems, "source"), ["title", "source"], F.concat(F.lit("- "), "slink", F.lit(": "), "line"))
    said = ordered(fact_lines(facts, sources).join(stems, "source"), ["rank"], F.concat(F.lit("- "), "statement", F.lit(" ("), "slink", F.lit(", "), "place", F.lit(")")))
    out = concepts.select("id", "name", "definition")
    for name, part in (("related", related), ("taught", taught), ("said", said)):
        out = out.join(part.select(F.col("concept").alias("id"), F.col("part").alias(name)), "id", "left")
    section = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n\n"), c))
    return out.select("id", F.concat_ws("\n\n", F.concat(F.lit("# "), "name"), F.nullif("definition", F.lit("")), section("Related", "related"), section("Taught in", "taught"), section("Facts", "said")).alias("block"))


def source_blocks(sources: DataFrame, names: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, block): a source's note lists each concept at its first mention there, in the order they come up."""
    w = W.partitionBy("source", "concept").orderBy(F.coalesce("start", F.lit(0)), "chunk")
    first = mentions.withColumn("r", F.row_number().over(w)).where("r = 1").join(names.select(F.col("id").alias("concept"), note_link("name", "stem").alias("link")), "concept")
    first = first.join(sources.select(F.col("id").alias("source"), "url"), "source")
    item = F.struct(F.coalesce("start", F.lit(0)).alias("start"), "chunk", "concept", F.concat(F.lit("- "), T.time_link("url", "start", "place"), F.lit(" "), "link").alias("line"))
    lists = first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("part"))
    about = F.nullif(F.concat_ws(" · ", F.when(F.col("url") != "", F.concat(F.lit("[Watch]("), "url", F.lit(")"))), F.when(F.col("duration") > 0, T.timestamp("duration"))), F.lit(""))
    rows = sources.join(lists.withColumnRenamed("source", "id"), "id", "left")
    return rows.select("id", F.concat_ws("\n\n", F.concat(F.lit("# "), "name"), about, F.when(F.col("part").isNotNull(), F.concat(F.lit("## Concepts, in the order they come up\n\n"), "part"))).alias("block"))


def front_matter(pairs: list[tuple[str, Column]], old=None) -> Column:
    """YAML front matter, one key a line with its value as JSON (which is YAML), and below it the lines of `old` whose keys are not OWNED."""
    value = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)) for k, v in pairs])
    if old is None:
        return F.concat(F.lit("---\n"), value, F.lit("\n---\n"))
    lines = F.split(F.regexp_extract(F.coalesce(T.col(old), F.lit("")), r"(?s)\A---\n(.*?)\n---\n", 1), "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("on"))
    owned = "^(" + "|".join(OWNED) + "):"

    def step(s: Column, line: Column) -> Column:
        """A line that begins a key decides for itself and for the indented lines below it."""
        on = F.when(line.rlike(r"^[^\s#-][^:]*:"), ~line.rlike(owned)).otherwise(s["on"])
        return F.struct(F.when(on & (line != ""), F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"), on.alias("on"))

    extra = F.aggregate(lines, start, step, lambda s: s["kept"])
    return F.concat(F.lit("---\n"), value, F.when(F.size(extra) > 0, F.concat(F.lit("\n"), F.array_join(extra, "\n"))).otherwise(""), F.lit("\n---\n"))


def note(meta: Column, block, old=None) -> Column:
    """A whole note: front matter, the managed block, and what the reader wrote before and after it."""
    whole = F.concat(F.lit(f"{BEGIN}\n"), F.trim(T.col(block)), F.lit(f"\n{END}"))
    if old is None:
        return F.concat(meta, whole, F.lit("\n"))
    body = F.regexp_replace(F.coalesce(T.col(old), F.lit("")), r"(?s)\A---\n.*?\n---\n", "")
    at, end = F.instr(body, BEGIN), F.instr(body, END)
    has = (at > 0) & (end > at)
    before, after = F.when(has, F.substring(body, F.lit(1), at - 1)).otherwise(""), F.when(has, F.substring(body, end + len(END), F.length(body))).otherwise(F.when(F.trim(body) != "", F.concat(F.lit("\n"), F.trim(body), F.lit("\n"))).otherwise(""))
    return F.concat(meta, F.when(F.trim(before) != "", before).otherwise(""), whole, F.when(F.btrim(after, F.lit(" \n\t")) != "", after).otherwise("\n"))
