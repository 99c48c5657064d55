"""Names, tokens, ids and locators as Spark columns. Nothing here runs Python on rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plurals that no rule covers, and the notice and course numbers that lectures carry.
IRREGULAR = {"vertices": "vertex", "indices": "index", "matrices": "matrix", "children": "child"}
NOTICE = r"(?is)The following content is provided under a Creative Commons license\..*?(?:ocw\.mit\.edu\.?|OCW at MIT\.?)"
CUT_NOTICE = r"^\s*MIT OpenCourseWare\b"
COURSE_NUMBER = r"\b(?:(?:6\.)?006|6006|18\.06|(?:6\.)?034|6\.042J?|(?:6\.)?824|6\.046J?)\b"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def named(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(text) -> Column:
    """Blank-separated words; an empty array for blank text."""
    return F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def singular(word) -> Column:
    """One branch for most words: all plurals but one end in s."""
    w = col(word)
    ends = lambda *tails: reduce(or_, (w.endswith(t) for t in tails))
    without = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    plural_s = {p: one for p, one in IRREGULAR.items() if p.endswith("s")}
    out = F.when(~ends("s"), reduce(lambda c, p: c.when(w == p[0], p[1]), ((p, o) for p, o in IRREGULAR.items() if p not in plural_s), F.when(F.lit(False), w)).otherwise(w))
    for plural, one in plural_s.items():
        out = out.when(w == plural, one)
    out = out.when((F.length(w) <= 3) | ends("ss", "us", "is"), w).when(ends("ies") & (F.length(w) > 4), F.concat(without(3), F.lit("y")))
    return out.when(ends("ches", "shes", "xes", "sses"), without(2)).otherwise(without(1))


#: ASCII characters that no word has, and as many blanks.
_SIGNS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum() or chr(c) in "+# \t\n\x0b\x0c\r"))
_BLANKS = " " * len(_SIGNS)


def plain(text) -> Column:
    """Lower case; hyphens and underscores apart, possessives and apostrophes gone, all but a-z 0-9 + # as blanks.

    ASCII signs are translated, which is several times faster than a pattern; only texts with other characters need one.
    """
    s = F.translate(F.lower(col(text)), "-_’", "  '")
    s = F.translate(F.replace(F.replace(s, F.lit("'s "), F.lit(" ")), F.lit("'"), F.lit("")), _SIGNS, _BLANKS)
    return named(s, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, r"[^\x00-\x7F]+", " ")))


def tokens(text) -> Column:
    """Words of the plain text, each in the singular."""
    return F.transform(words(plain(text)), singular)


def normalized(name) -> Column:
    """A concept name's comparable form: no leading article or trailing 'operation', the last word in the singular."""
    all_words = F.filter(F.split(F.regexp_replace(collapse(plain(name)), r"^(the|a|an)\s+", ""), " "), lambda x: x != "")
    closed = lambda w: F.when((F.size(w) > 1) & F.element_at(w, -1).isin("operation", "operations"), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w)
    last = lambda w: F.transform(F.slice(w, F.greatest(F.size(w), F.lit(1)), F.lit(1)), singular)
    whole = lambda w: F.array_join(F.concat(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), last(w)), " ")
    return named(named(all_words, closed), whole)


def name_key(name) -> Column:
    return F.replace(normalized(name), F.lit(" "), F.lit(""))


def slug(name) -> Column:
    s = F.regexp_replace(F.regexp_replace(normalized(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "concept").otherwise(s)


def model_slug(model) -> Column:
    return F.regexp_replace(col(model), "[^A-Za-z0-9._-]+", "-")


def memory_key(text) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def clean_lecture(text) -> Column:
    """Without the licence notice, course numbers masked, white space collapsed."""
    s = F.regexp_replace(F.regexp_replace(col(text), NOTICE, " "), COURSE_NUMBER, "this course")
    return collapse(F.regexp_replace(s, CUT_NOTICE, " "))


def short(text, n: int = 12) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def snippet(text, most: int = 700) -> Column:
    t = col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def sentences(text) -> Column:
    return F.filter(F.split(col(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def timestamp(seconds) -> Column:
    """mm:ss, or h:mm:ss from an hour on; fractions are cut off."""
    s = F.floor(col(seconds)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def locator(start="start", end="end", page_start="page_start", page_end="page_end", heading="heading", index="index") -> Column:
    """Where a chunk is in its source: time range, else pages, else heading path, else its number."""
    a, b, p, q, h = map(col, (start, end, page_start, page_end, heading))
    pages = F.when(q.isNull() | (q == p), F.format_string("p. %d", p)).otherwise(F.format_string("p. %d-%d", p, q))
    return F.coalesce(
        F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", timestamp(a), timestamp(b))), F.when(p.isNotNull(), pages), F.when(F.size(h) > 0, F.array_join(h, " > ")), F.format_string("chunk %d", col(index))
    )


def chunk_id(source, index) -> Column:
    return F.format_string("%s:%04d", col(source), col(index))


def content_id(content) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def fact_id(chunk, statement) -> Column:
    return F.substring(F.sha1(F.concat(col(chunk), F.lit("\n"), col(statement))), 1, 16)


def embedding_hash(model: str, text) -> Column:
    return F.sha1(F.concat(F.lit(model), F.lit("\n"), col(text)))


def query_half(query_id) -> Column:
    """dev or test, by the first byte of the id's sha1."""
    return F.when(F.conv(F.substring(F.sha1(col(query_id)), 1, 2), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def video_id(url, path) -> Column:
    found = F.regexp_extract(F.coalesce(col(url), F.lit("")), r"[?&]v=([\w-]{11})", 1)
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(col(path), F.lit("")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(found, F.lit("")), F.when(F.length(stem) >= 11, F.substring(stem, -11, 11)))


def safe_name(name, most: int = 120) -> Column:
    """A file name that vaults and file systems take."""
    s = F.regexp_replace(F.trim(F.regexp_replace(col(name), r'[\\/:*?"<>|#^\[\]]', " ")), r"^\.+|\.+$", "")
    s = F.rtrim(F.substring(F.regexp_replace(s, r"\s+", " "), 1, most))
    return F.when(s == "", "untitled").otherwise(s)


def time_link(url, start, shown) -> Column:
    """The shown text as a link to that second of a video, where the source is one."""
    u = F.coalesce(col(url), F.lit(""))
    link = F.concat(F.lit("["), col(shown), F.lit("]("), u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("t="), F.floor(col(start)).cast("int").cast("string"), F.lit("s)"))
    return F.when(col(start).isNotNull() & (u.contains("youtube.com/") | u.contains("youtu.be/")), link).otherwise(col(shown))


def embed_text(name, definition) -> Column:
    d = F.coalesce(col(definition), F.lit(""))
    return F.when(d != "", F.concat_ws(": ", col(name), d)).otherwise(col(name))


def contrast(a, b) -> Column:
    """True where two normalized names look alike but mean different things: one adds words to the other, or one word is swapped."""
    count = lambda name: F.filter(F.split(col(name), " "), lambda w: w != "")
    # words with their occurrence number are a set that stands for the multiset
    numbered = lambda ws: F.transform(ws, lambda w, i: F.concat_ws("#", w, F.size(F.filter(F.slice(ws, F.lit(1), i + 1), lambda x: x == w)).cast("string")))
    x, y = numbered(count(a)), numbered(count(b))
    more, less, both = F.size(F.array_except(x, y)), F.size(F.array_except(y, x)), F.size(F.array_intersect(x, y))
    return (both > 0) & ((more > 0) | (less > 0)) & ((more == 0) | (less == 0) | ((more == 1) & (less == 1)))
