"""Training pairs, mined negatives and cleaned questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import dot

#: Pairs of question types that passages take in turn, and wording that points at its source.
ROTATION = [("procedure", "relation"), ("definition", "fact"), ("procedure", "definition"), ("relation", "fact"), ("procedure", "fact"), ("relation", "definition")]
META = (
    r"(?i)\b(passage|lecture|lecturer|professor|speaker|this (\w+ )?(course|class|algorithm|example|context|case|method|approach|step|process|procedure|data structure|function|problem|expression|operation)"
    r"|the course|explanation|discussed|described|(the |this )?(given )?example( given)?|mentioned|technical (terms|jargon)|simple terms|without using)\b"
)


def requested_types(index) -> Column:
    """The two types of a passage's turn, and a paraphrase."""
    turns = F.array(*[F.array(F.lit(a), F.lit(b), F.lit("paraphrase")) for a, b in ROTATION])
    return F.element_at(turns, (F.pmod(T.col(index), F.lit(len(ROTATION))) + 1).cast("int"))


def clean_questions(questions: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` of a chunk's questions (chunk, pos, type, question): of a requested type, self-contained, of 10 characters or more, one of each type, none twice.

    A question counts as seen, and its type as used, only once it is kept, so a reply's questions are folded in order. With
    a column `requested` (array of types) others are dropped. A reply holds a handful of questions; it is one row of the fold.
    """
    q = questions.withColumn("question", T.collapse("question")).withColumn("type", F.trim("type")).where((F.length("question") >= 10) & ~F.col("question").rlike(META))
    if "requested" in questions.columns:
        q = q.where(F.array_contains("requested", F.col("type")))
    item = F.struct("pos", "type", "question")
    lists = q.groupBy("chunk").agg(F.array_sort(F.collect_list(item)).alias("all"))
    new = lambda kept, x: ~F.exists(kept, lambda k: (k["type"] == x["type"]) | (F.lower(k["question"]) == F.lower(x["question"])))
    none = F.slice("all", 1, 0)
    kept = lists.select("chunk", F.aggregate("all", none, lambda kept, x: F.when(new(kept, x), F.concat(kept, F.array(x))).otherwise(kept)).alias("kept"))
    return kept.select("chunk", F.inline(F.slice("kept", 1, most)))


def top_passages(facts: DataFrame, per_concept: int = 3) -> DataFrame:
    """The passages with the most facts of each concept: facts (concept, chunk, facts)."""
    return facts.withColumn("rank", F.row_number().over(W.partitionBy("concept").orderBy(F.desc("facts"), "chunk"))).where(F.col("rank") <= per_concept)


def within(evidence: str, allowed: list[str]) -> Column:
    """True where a non-empty array of sources has none but allowed ones."""
    return (F.size(evidence) > 0) & (F.size(F.array_except(evidence, F.array(*map(F.lit, allowed)))) == 0)


def hard_negatives(questions: DataFrame, passages: DataFrame, neighbours: int = 1, skip: int = 2) -> DataFrame:
    """For each question (query, source, index, v) the passage (doc, source, index, v) of its source that is similar but not among the `skip` most similar nor near its own.

    None where too few are left. Joined by source: the questions are the stated set.
    """
    q = questions.select("query", "source", F.col("index").alias("own"), F.col("v").alias("qv"))
    pairs = passages.join(q, "source").where(F.abs(F.col("index") - F.col("own")) > neighbours)
    scored = pairs.select("query", "doc", F.round(dot("qv", "v"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") == skip + 1).select("query", "doc", "score")


def build_pairs(facts: DataFrame, concepts: DataFrame, relations: DataFrame, passages: DataFrame, sources: list, per_concept: int = 3, most_relations: int | None = 4000, seed: int = 0) -> DataFrame:
    """(anchor, positive, kind, source): pairs whose evidence lies in these sources alone.

    facts (chunk, statement, concepts) with their passage, concept names with the passages of most facts about them, and the
    two names of relations all of whose chunks are there. passages (chunk, source, text). Of relations a drawn share of
    `most_relations` is kept (a training mix; None keeps all), in an order that the seed's hash gives.
    """
    inside = passages.where(F.col("source").isin(sources))
    said = facts.join(inside, "chunk")
    first = said.select(F.col("statement").alias("anchor"), F.col("text").alias("positive"), F.lit("fact").alias("kind"), "source")
    counts = facts.select("chunk", F.explode("concepts").alias("concept")).join(inside.select("chunk"), "chunk").groupBy("concept", "chunk").agg(F.count("*").alias("facts"))
    names = concepts.select(F.col("id").alias("concept"), "name")
    second = top_passages(counts, per_concept).join(names, "concept").join(inside, "chunk").select(F.col("name").alias("anchor"), F.col("text").alias("positive"), F.lit("concept").alias("kind"), "source")
    where = relations.select("subject", "object", "predicate", F.explode("chunks").alias("chunk")).join(passages.select("chunk", "source"), "chunk")
    whole = where.groupBy("subject", "object", "predicate").agg(F.min("source").alias("source"), F.bool_and(F.col("source").isin(sources)).alias("inside")).where("inside")
    if most_relations is not None:
        whole = whole.orderBy(F.xxhash64("subject", "predicate", "object", F.lit(seed)), "subject", "predicate", "object").limit(most_relations)
    third = whole.join(names.toDF("subject", "a"), "subject").join(names.toDF("object", "b"), "object").select(F.col("a").alias("anchor"), F.col("b").alias("positive"), F.lit("relation").alias("kind"), "source")
    return first.unionByName(second).unionByName(third)


def question_pairs(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(anchor, positive, kind, source) of questions (chunk, question) and their passages (chunk, source, text)."""
    return questions.join(passages, "chunk").select(F.col("question").alias("anchor"), F.col("text").alias("positive"), F.lit("question").alias("kind"), "source")


def training_sources(sources: DataFrame, test: DataFrame, dev: DataFrame) -> DataFrame:
    """Sources (source) that neither test nor dev holds."""
    return sources.join(test.select("source"), "source", "left_anti").join(dev.select("source"), "source", "left_anti")


def without_meta(questions: DataFrame) -> DataFrame:
    """Saved questions, filtered again, so that a stricter rule covers older ones as well."""
    return questions.where(~F.col("question").rlike(META))


def unasked(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks (chunk, ...) without a recorded reply; a reply without questions is recorded too, so it is not asked for again."""
    return chunks.join(asked.select("chunk").distinct(), "chunk", "left_anti")
