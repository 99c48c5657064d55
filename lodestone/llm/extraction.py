"""Main text of web pages: wrappers induced by simple tree matching of all pages of a host with a few of it, then the varying content without furniture."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, hosts_of, materialise, table

#: Pages of a host that all others are aligned with, the longest that is one of them while there are others, and bytes of wrappers up to which they are broadcast.
REFERENCES, LONGEST_REFERENCE, MOST_BROADCAST = 4, 200_000, 16_000_000
#: Pages that a constant is on at least, each of which shares less than half of its text with the page that it was matched with.
LEAST_PAGES = 4
#: Pairs of children that one matching of two pages compares at most, and the deepest element whose children it looks at. Beyond, only equal subtrees match.
WORK, DEEPEST = 100_000, 150
#: Elements and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg title"
FURNITURE = frozenset("nav footer aside form script style noscript template textarea iframe svg title head button select menu dialog".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored promo sidebar comment comments commentlist disqus respond cookie cookies consent gdpr notice banner popup modal overlay menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe pagination pager skip widget".split()
)
#: Words that make a furniture word's compound furniture as well ("share-buttons"), where others make it something else ("share-price").
FURNITURE_PARTS = FURNITURE_WORDS | frozenset("area bar block bottom box button buttons container content empty form group header inner item items left links list message module outer panel popup region right row section slot top unit wrap wrapper".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul option".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(' ', '|')})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS, _DIGITS = re.compile(r"[a-z]+"), re.compile(r"[0-9]+")


class Node:
    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: frozenset = frozenset()):
        self.tag, self.marks, self.children = tag, marks, []


def _furniture_class(token: str) -> bool:
    """Whether a class, id or role is furniture as a whole: a furniture word, or one with words that say no more than what kind of box it is."""
    words = _WORDS.findall(token)
    return not FURNITURE_WORDS.isdisjoint(words) and FURNITURE_PARTS.issuperset(words)


def _marks(attributes: str) -> frozenset:
    """What the attributes say of an element: !hidden, !furniture, role and the whole words of class and id."""
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("hidden", "aria-hidden"):
            if name == "hidden" or value == "true":
                out.add("!hidden")
        else:
            out.add(f"role={value}" if name == "role" else "")
            for token in value.split():
                out.add(token)
                if _furniture_class(token):
                    out.add("!furniture")
    return frozenset(out)


def parse(page: str) -> Node:
    """The element tree; strings are text with references decoded. Paragraphs, list items and cells end where HTML lets them.

    No tag ends behind the last '>', so what follows is text up to a comment's begin; looking for tags there could take
    time that grows with its square.
    """
    root = Node("#root")
    stack, at, last = [root], 0, page.rfind(">") + 1
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
    blocks: list[int] = []

    def close(k: int) -> None:
        for x in stack[k:]:
            where[x.tag].pop()
            if x.tag in BLOCKS:
                blocks.pop()
        del stack[k:]

    def top(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    open_ = False  # whether the last token runs on to the end of the page
    for m in _TOKEN.finditer(page, 0, last):
        open_ = m.end() == last and not m["tag"] and not m[0].endswith("-->" if m[0].startswith("<!--") else ">") or (bool(m["raw"]) and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I))
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["raw"] or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if k := top((tag,)):
                close(k)
            continue
        if tag in BLOCKS and (k := top(("p",))) and k >= (blocks[-1] if blocks else 0):
            close(k)
        if tag in CLOSES and (k := top(CLOSES[tag])) > top(("ul", "ol", "dl", "table", "select")):
            close(k)
        node = Node(tag, _marks(m["attributes"]))
        stack[-1].children.append(node)
        if tag not in VOID and not m["attributes"].endswith("/"):
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    if open_ and at == last:
        return root
    rest = page[at:].partition("<!--")[0] if at >= last else page[at:last] + page[last:].partition("<!--")[0]
    if rest:
        stack[-1].children.append(entities.unescape(rest))
    return root


def _clean(text: str) -> str:
    return " ".join(text.split())


def _name(path: int, text: str) -> int:
    """The name of a text below a path, or of an element's path below its parent's: paths are numbers, however deep they are."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\n{text}") >> 1


class Tree:
    """A page's elements and texts in order: label (of a tag, or of a text), size and hash of the subtree, its shape (0: a text), name of a text (0: element) and its length.

    The shape is the hash of a subtree's elements alone.
    """

    def __init__(self, labels: list[int], sizes: list[int], whole: list[int], shapes: list[int], names: list[int], lengths: list[int]):
        self.labels, self.sizes, self.whole, self.shapes, self.names, self.lengths = labels, sizes, whole, shapes, names, lengths
        self._below: dict[int, tuple[list[int], frozenset, frozenset]] = {}

    @classmethod
    def of(cls, page: str) -> Tree:
        labels, sizes, whole, shapes, names, lengths = [], [], [], [], [], []
        todo: list = [(parse(page), 0)]
        ends: list[int] = []
        while todo:
            x, path = todo.pop()
            if x is None:  # an element's subtree is complete
                i = ends.pop()
                sizes[i] = len(labels) - i
                parts, elements, k = [labels[i]], [labels[i]], i + 1
                while k < len(labels):
                    parts.append(whole[k])
                    if shapes[k]:
                        elements.append(shapes[k])
                    k += sizes[k]
                whole[i], shapes[i] = _name(0, repr(parts)), _name(3, repr(elements))
            elif isinstance(x, str):
                if t := _clean(x):
                    label = _name(1, t)
                    for column, value in ((labels, label), (sizes, 1), (whole, label), (shapes, 0), (names, _name(path, t)), (lengths, len(t))):
                        column.append(value)
            else:
                own = _name(path, x.tag)
                ends.append(len(labels))
                for column, value in ((labels, _name(2, x.tag)), (sizes, 1), (whole, 0), (shapes, 0), (names, 0), (lengths, 0)):
                    column.append(value)
                todo.append((None, 0))
                todo += [(c, own) for c in reversed(x.children)]
        return cls(labels, sizes, whole, shapes, names, lengths)

    def below(self, i: int) -> tuple[list[int], frozenset, frozenset]:
        """A node's children, their labels, and the labels of all texts in its subtree."""
        if i not in self._below:
            out, k, end = [], i + 1, i + self.sizes[i]
            while k < end:
                out.append(k)
                k += self.sizes[k]
            self._below[i] = out, frozenset(self.labels[k] for k in out), frozenset(self.labels[k] for k in range(i, end) if not self.shapes[k])
        return self._below[i]


#: What pairings of subtrees without a text in common weigh, and what work that is, by their shapes.
_shaped: dict[tuple[int, int], tuple[int, int]] = {}


class Matching:
    """Simple tree matching of two pages: a largest pairing of equal nodes that keeps parents and order.

    Equal subtrees match as a whole, and equal children at either end of two lists match each other, which loses nothing; what
    is left between is the usual table over pairs of children. Lists whose table is beyond the bound on work, and elements
    below the deepest level, are paired by equal subtrees alone.
    """

    def __init__(self, a: Tree, b: Tree, work: int = WORK):
        self.a, self.b, self.left, self.known = a, b, work, {}

    def weight(self, i: int, j: int, depth: int = 0) -> int:
        """Nodes that a pairing of two subtrees holds."""
        a, b = self.a, self.b
        if a.labels[i] != b.labels[j]:
            return 0
        if a.whole[i] == b.whole[j]:
            return a.sizes[i]
        if a.sizes[i] == 1 or b.sizes[j] == 1 or depth > DEEPEST:
            return 1
        (_, some, texts), (_, others, theirs) = a.below(i), b.below(j)
        if some.isdisjoint(others):
            return 1
        if texts.isdisjoint(theirs):
            shapes = a.shapes[i], b.shapes[j]
            weight, cost = _shaped.get(shapes, (0, WORK))
            if not weight or cost > self.left:
                left = self.left
                weight = 1 + sum(self._pairs(i, j, depth)[1])
                if self.left > 0 and depth + min(a.sizes[i], b.sizes[j]) <= DEEPEST and len(_shaped) < 200_000:
                    _shaped[shapes] = weight, left - self.left
            else:
                self.left -= cost
            return weight
        if (i, j) not in self.known:
            pairs, weights = self._pairs(i, j, depth)
            self.known[i, j] = 1 + sum(weights), pairs
        return self.known[i, j][0]

    def _pairs(self, i: int, j: int, depth: int) -> tuple[list[tuple[int, int]], list[int]]:
        """The children that are paired, and what each pair weighs."""
        a, b = self.a, self.b
        x, y = a.below(i)[0], b.below(j)[0]
        first = 0
        while first < min(len(x), len(y)) and a.whole[x[first]] == b.whole[y[first]]:
            first += 1
        last = 0
        while last < min(len(x), len(y)) - first and a.whole[x[-1 - last]] == b.whole[y[-1 - last]]:
            last += 1
        ends = [*zip(x[:first], y[:first], strict=True), *zip(x[len(x) - last :], y[len(y) - last :], strict=True)]
        x, y = x[first : len(x) - last], y[first : len(y) - last]
        if len(x) * len(y) > self.left:
            between = _rising(x, y, a.whole, b.whole)
            pairs = ends + between
            return pairs, [a.sizes[p] for p, _ in pairs]
        self.left -= len(x) * len(y)
        w = [[self.weight(p, q, depth + 1) for q in y] for p in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for r in range(len(x)):
            for c in range(len(y)):
                best[r + 1][c + 1] = max(best[r][c + 1], best[r + 1][c], best[r][c] + w[r][c])
        pairs, weights, r, c = ends, [a.sizes[p] for p, _ in ends], len(x), len(y)
        while r and c:
            if best[r][c] == best[r - 1][c]:
                r -= 1
            elif best[r][c] == best[r][c - 1]:
                c -= 1
            else:
                r, c = r - 1, c - 1
                pairs.append((x[r], y[c]))
                weights.append(w[r][c])
        return pairs, weights

    def texts(self) -> list[int]:
        """Text nodes of the first page that are paired with an equal one of the second."""
        a, b, out = self.a, self.b, []
        todo = [(0, 0)] if self.weight(0, 0) else []
        while todo:
            i, j = todo.pop()
            if a.whole[i] == b.whole[j]:
                out += [k for k in range(i, i + a.sizes[i]) if a.names[k]]
            elif (i, j) in self.known:
                todo += self.known[i, j][1]
        return sorted(out)


def _rising(x: list[int], y: list[int], left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """A longest run of pairs with equal values, both rising; the n-th of a value meets the n-th."""
    seen: Counter = Counter()
    place = {}
    for q in y:
        seen[right[q]] += 1
        place[right[q], seen[right[q]]] = q
    seen.clear()
    tails, at, common, before = [], [], [], []
    for p in x:
        seen[left[p]] += 1
        if (q := place.get((left[p], seen[left[p]]))) is None:
            continue
        j = bisect.bisect_left(tails, q)
        before.append(at[j - 1] if j else -1)
        tails[j : j + 1], at[j : j + 1] = [q], [len(common)]
        common.append((p, q))
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(common[k])
        k = before[k]
    return out


def votes(page: Tree, references: list[Tree]) -> set[int] | None:
    """The names of texts that the page has in the same place as a reference which is no near copy of it: one with less than half of its text in common. None without any such."""
    own, found = sum(page.lengths), None
    for r in references:
        if r.whole[0] == page.whole[0]:
            continue
        texts = Matching(page, r).texts()
        if 2 * sum(page.lengths[k] for k in texts) < own:
            found = (found or set()) | {page.names[k] for k in texts}
    return found


def wrapper(pages: list[str], least: int = LEAST_PAGES) -> list[int]:
    """The constant texts of a host's pages: those that `least` pages vote for, and half of the pages that vote."""
    trees = {t.whole[0]: t for t in map(Tree.of, pages)}
    cast = [v for t in trees.values() if (v := votes(t, [*trees.values()][:REFERENCES])) is not None]
    found = Counter(n for v in cast for n in v)
    return sorted(n for n, k in found.items() if k >= least and 2 * k >= len(cast))


def _is_furniture(node: Node, inside: bool) -> bool:
    return node.tag in FURNITURE or not {"!hidden", "!furniture"}.isdisjoint(node.marks) or (not inside and (node.tag == "header" or "header" in node.marks))


def _articles(node: Node) -> list[tuple[Node, int]]:
    """The outermost articles with their parents' paths; without any, the outermost main elements."""
    out, main = [], []
    todo = [(node, 0, False)]
    while todo:
        x, path, within = todo.pop()
        if x.tag == "article":
            out.append((x, path))
            continue
        if not within and (x.tag == "main" or "role=main" in x.marks):
            main.append((x, path))
            within = True
        own = _name(path, x.tag)
        todo += [(c, own, within) for c in reversed(x.children) if not isinstance(c, str) and not _is_furniture(c, False)]
    return out or main


def main_text(page: str, constants: frozenset = frozenset()) -> str:
    """Blocks of the page's slots, joined by blank lines: what is in its articles (or main elements, or else the whole page) but furniture and the host's constants."""
    root = parse(page)
    found = _articles(root)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := _clean("".join(now)):
            blocks.append(text)
        now.clear()

    inside, starts = bool(found), {id(x) for x, _ in found}
    todo: list = list(reversed(found)) or [(root, 0)]
    while todo:
        x, path = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(" " if constants and _name(path, _clean(x)) in constants else x)
        elif x.tag == "br":
            now.append(" ")
        elif not _is_furniture(x, inside) or id(x) in starts:
            if x.tag in BLOCKS:
                flush()
                todo.append((None, 0))
            own = _name(path, x.tag) if constants else 0
            todo += [(c, own) for c in reversed(x.children)]
    flush()
    return "\n\n".join(blocks)


_COLUMNS = ("labels", "sizes", "whole", "shapes", "names", "lengths")
_TREE = ", ".join(f"{c} array<long>" for c in _COLUMNS)


def _treed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            texts = part.column(2).to_pylist()
            trees = [Tree.of(p) for p in texts]
            columns = [pa.array([getattr(t, c) for t in trees], pa.list_(pa.int64())) for c in _COLUMNS]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, pa.array([len(p) > LONGEST_REFERENCE for p in texts])], names=["host", "page", *_COLUMNS, "long"])


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, name, n): votes for each text; those for the name 0 are the pages that vote."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        hosts, names = zip(*held, strict=True) if held else ((), ())
        done = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(held.values(), pa.int64())], names=["host", "name", "n"])
        held.clear()
        return done

    known: dict[str, list[Tree]] = {}
    for batch in batches:
        for k, host in enumerate(batch.column(0).to_pylist()):
            if host not in known:
                if len(known) >= 64:
                    known.clear()
                known[host] = [Tree(r["labels"], r["sizes"], r["whole"], r["shapes"], [], []) for r in batch.column(1)[k].as_py()]
            page = Tree(*(batch.column(c)[k].as_py() for c in range(2, 8)))
            cast = votes(page, known[host])
            if cast is not None:
                held.update((host, n) for n in (*cast, 0))
            if len(held) > 200_000:
                yield out()
    yield out()


def _by_host(left: DataFrame, right: DataFrame, size, most_broadcast: int, how: str = "inner") -> DataFrame:
    """Joined by host: right is broadcast while its measured size is below the limit, else in a shuffle that Spark may split by size."""
    return left.join(F.broadcast(right) if (right.agg(F.sum(size)).first()[0] or 0) <= most_broadcast else right, "host", how)


def wrappers(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(host, constants): texts that LEAST_PAGES pages of the host vote for, and half of those that vote.

    Every page is matched with REFERENCES pages of its host, those with the least hashes (among pages not too long, if there
    are such), and votes for the texts that it has in common with those that are no near copies of it. Repeats of a page
    vote once. Votes are added up within tasks before they are grouped, and no group holds a host's pages.
    """
    own = pages.select(hosts_of("url").alias("host"), F.xxhash64("html").alias("page"), "html").where(F.length("html") > 0)
    each = materialise(own.mapInArrow(_treed, f"host string, page long, {_TREE}, long boolean").dropDuplicates(["host", "page"]), "trees")
    tree = F.struct("labels", "sizes", "whole", "shapes")
    chosen = each.groupBy("host").agg(F.count("*").alias("pages"), *[F.min_by(tree, F.struct("long", F.xxhash64("page", F.lit(k)))).alias(f"p{k}") for k in range(REFERENCES)])
    several = materialise(chosen.where(F.col("pages") >= LEAST_PAGES).select("host", F.array_distinct(F.array(*[f"p{k}" for k in range(REFERENCES)])).alias("references")), "references")
    size = F.aggregate("references", F.lit(0), lambda n, r: n + 32 * F.size(r["labels"])) + F.length("host") + 32
    joined = _by_host(each.select("host", *_COLUMNS), several, size, most_broadcast)
    found = joined.select("host", "references", *_COLUMNS).mapInArrow(_voted, "host string, name long, n long").groupBy("host", "name").agg(F.sum("n").alias("n"))
    found = materialise(found, "votes")
    cast = found.where("name = 0").select("host", F.col("n").alias("cast"))
    counted = found.where((F.col("n") >= LEAST_PAGES) & (F.col("name") != 0)).join(cast, "host").where("2 * n >= cast")
    return counted.groupBy("host").agg(F.sort_array(F.collect_list("name")).alias("constants"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part, known, texts = batch.slice(a, 500), {}, []
            for k, (page, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if host not in known:
                    known[host] = frozenset(part.column(4)[k].as_py() or ())
                texts.append(main_text(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page's main text from its whole html.

    Null and empty html, and pages of furniture alone, give an empty text; a null url counts as a host of its own; repeated
    rows each give a row; an empty table gives none; columns beside page_id, url and html are ignored, whatever their names.
    Very long and very deep pages are parsed in time and memory that grow with their length. Wrappers are joined by host:
    broadcast while their measured size is below most_broadcast, else in a shuffle that Spark may split by size.
    """
    found = materialise(wrappers(bounded(pages), most_broadcast), "wrappers")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", hosts_of("url").alias("host"))
    joined = _by_host(own, found, F.size("constants") * 8 + F.length("host") + 32, most_broadcast, "left")
    return joined.select("page_id", "url", "html", "host", "constants").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
