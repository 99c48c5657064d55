"""Licence scan: a positional rare-token index over licence templates, on DataFrame functions alone."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Label, template words, and the key phrase that must stand there word by word.
TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("isc", "released under the isc license", "isc license"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
]
#: Templates of the base contract come first; all their places count in n_base.
BASE = 3


def templates() -> list[tuple[str, int, str, list[str], int, int, int, bool]]:
    """(anchor, place of the anchor, label, words, begin and length of the key phrase, least shared words, is base) of each template.

    The anchor is the key phrase's word with the highest IDF among the templates: a document is looked at only where one stands.
    """
    split = [(label, text.split(), key.split()) for label, text, key in TEMPLATES]
    seen = Counter(w for _, words, _ in split for w in set(words))
    out = []
    for k, (label, words, key) in enumerate(split):
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        anchor = max(key, key=lambda w: (math.log(len(split) / seen[w]), len(w), w))
        out.append((anchor, at + key.index(anchor), label, words, at, len(key), max(len(key), (len(words) + 1) // 2), k < BASE))
    return out


def licence_scan(docs: DataFrame) -> DataFrame:
    """Licence phrases of every whole text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and characters from U+0080 on, A-Z in lower case. Where one of the templates' rarest
    key words stands, the templates that it anchors are laid over the text at the relative position, and the words of each
    that are in place are counted; a place counts when its whole key phrase is there and at least half of the template's
    words. All of this stays within a row, so nothing is shuffled. Null text is empty; texts without words have n_words 0
    and no labels; each input row, repeated or with a null id, gives one row; an empty table gives none. A very long text is
    one array of words in its row. Columns beside doc_id and text are ignored, whatever their names. score is the largest
    share of a template's words found at a place.
    """
    index = templates()
    anchors = F.array(*[F.lit(w) for w in sorted({t[0] for t in index})])
    names = ("word", "at", "label", "words", "key_at", "key_size", "least", "base")
    column = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    postings = F.array(*[F.struct(*[column(v).alias(n) for n, v in zip(names, t, strict=True)]) for t in index])
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.split(F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")
    lists = docs.select("doc_id", words.alias("words")).select(
        "doc_id",
        F.when(F.element_at("words", 1) == "", F.lit(0)).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", anchors), F.col("words")).alias("words"),
    )

    def laid(i, p):
        """Template p at its anchor i: start, how many of its words are in place, and how many of its key phrase's."""
        start = i - p["at"]
        match = lambda first, size: F.size(F.filter(F.sequence(first, first + size - 1), lambda k: F.coalesce(F.get(F.col("words"), start + k) == F.get(p["words"], k), F.lit(False))))
        return F.struct(
            start.cast("long").alias("start"), match(F.lit(0), F.size(p["words"])).alias("shared"), match(p["key_at"], p["key_size"]).alias("keys"),
            p["label"].alias("label"), F.size(p["words"]).alias("size"), p["key_size"].alias("key_size"), p["least"].alias("least"), p["base"].alias("base"),
        )

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(anchors, F.get(F.col("words"), i)))
    over = F.flatten(F.transform(places, lambda i: F.transform(F.filter(postings, lambda p: p["word"] == F.get(F.col("words"), i)), lambda p: laid(i, p))))
    found = F.filter(over, lambda x: (x["keys"] == x["key_size"]) & (x["shared"] >= x["least"]))
    rows = lists.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), found).alias("found")).select("*", F.filter("found", lambda x: x["base"]).alias("base"))
    starts = F.transform("base", lambda x: x["start"])
    labels = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ","), F.lit(""))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["shared"] / x["size"])), F.lit(0.0)).alias("score"),
    ).withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower()
    rows = [(w, k, i, label, len(words), size, least, at <= i < at + size, base) for k, (_, _, label, words, at, size, least, base) in enumerate(templates()) for i, w in enumerate(words)]
    return ", ".join(f"({', '.join(map(q, r))})" for r in rows)


OP1_SQL = rf"""
WITH posting(word, template, place, label, size, key_size, least, is_key, base) AS (VALUES {_values()}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
g AS (SELECT r, template, pos - place AS start, count(*) AS shared, count(*) FILTER (is_key) AS keys, any_value(label) AS label, any_value(size) AS size,
      any_value(key_size) AS key_size, any_value(least) AS least, any_value(base) AS base FROM w JOIN posting USING (word) GROUP BY ALL),
f AS (SELECT * FROM g WHERE keys = key_size AND shared >= least),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(shared / size) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r)
"""
