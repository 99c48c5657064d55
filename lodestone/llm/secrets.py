"""Secret scan: base patterns, and probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, slices, table

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: What the automata score: whole runs of these characters.
_CANDIDATE = rb"[A-Za-z0-9+/_=-]"
KINDS = ("assign", "access", "hex", "grammar")
#: Merging of states: the confidence parameter of the Hoeffding test. Accepting: nats a character over the background.
ALPHA, MARGIN = 0.05, 0.8
#: Classes of characters are symbols of their own: 1 digit, 2 upper, 3 lower.
_DIGIT = bytes(1 if 48 <= b <= 57 else b for b in range(256))
_CLASS = bytes(1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 else b for b in range(256))


def labelled_credentials(each: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) made by rule: the prefixes and lengths that issuers publish, and everyday words as background."""
    rng = random.Random(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    any_ = digits + lower + upper
    forms = {
        "ghp": lambda: "ghp_" + draw(any_, 36), "gho": lambda: "gho_" + draw(any_, 36), "sk_live": lambda: "sk_live_" + draw(any_, 24), "aiza": lambda: "AIza" + draw(any_ + "_-", 35),
        "xoxb": lambda: f"xoxb-{draw(digits, 12)}-{draw(digits, 12)}-{draw(any_, 24)}", "glpat": lambda: "glpat-" + draw(any_ + "_-", 20), "npm": lambda: "npm_" + draw(any_, 36),
        "asia": lambda: "ASIA" + draw(upper + digits, 16), "hexkey": lambda: draw(digits + "abcdef", 40), "uphex": lambda: draw(digits + "ABCDEF", rng.choice((32, 40, 64))), "base64": lambda: draw(any_ + "+/", 40),
    }
    words = lambda: "".join(draw(lower, 1) if rng.random() < 0.5 else rng.choice(("th", "er", "on", "an", "ing", "tion", "re", "ent")) for _ in range(rng.randint(8, 14)))
    plain = [words, lambda: words().upper(), lambda: f"{words()}-{words()}", lambda: f"{words()}_{words()}", lambda: draw(digits, rng.randint(16, 24)), lambda: f"{words()}/{words()}/{rng.randint(1, 9999)}",
             lambda: f"{draw(digits, 4)}-{draw(digits, 2)}-{draw(digits, 2)}-{words()}", lambda: "".join(w.title() for w in (words(), words()[:5], words()))[rng.randint(0, 1) :], lambda: "=" * rng.randint(16, 40), lambda: "-" * rng.randint(16, 40), lambda: words().title() + str(rng.randint(1, 2030))]
    return [(k, f()) for k, f in forms.items() for _ in range(each)] + [("", f()) for f in plain for _ in range(each)]


class Automaton:
    """A probabilistic automaton: a prefix tree of the samples whose statistically compatible states are merged."""

    def __init__(self, samples: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for s in samples:
            state = 0
            self.visits[0] += 1
            for c in s:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.count[state][c] = self.count[state].get(c, 0) + 1
                state = self.next[state][c]
                self.visits[state] += 1
            self.ends[state] += 1
        self._merge(alpha)
        self.symbols = 80
        #: Where an unknown move leads: as the most visited state that knows the symbol moves.
        self.home: dict[int, int] = {}
        for state in sorted(range(len(self.next)), key=lambda k: self.visits[k]):
            self.home |= self.next[state]

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b], alpha):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), self.visits[a], self.count[b].get(c, 0), self.visits[b], alpha):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self, alpha: float) -> None:
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            blue.sort(key=lambda x: -self.visits[self.next[x[0]][x[1]]])
            p, c = blue.pop(0)
            state = self.next[p][c]
            for r in red:
                if self._compatible(r, state, alpha):
                    self.next[p][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = [(r, c) for r in red for c, t in self.next[r].items() if t not in red]
        number = {r: k for k, r in enumerate(red)}
        self.next, self.count, self.ends, self.visits = [{c: number[t] for c, t in self.next[r].items()} for r in red], [self.count[r] for r in red], [self.ends[r] for r in red], [self.visits[r] for r in red]

    def score(self, s: bytes) -> float:
        """Log likelihood with one added count for each symbol; unknown moves lead where they mostly lead."""
        state, out = 0, 0.0
        for c in s:
            out += math.log((self.count[state].get(c, 0) + 0.02) / (self.visits[state] + 0.02 * self.symbols))
            state = self.next[state].get(c, self.home.get(c, state))
        return out + math.log((self.ends[state] + 0.02) / (self.visits[state] + 0.02 * self.symbols))


class Grammars:
    def __init__(self, labelled: list[tuple[str, str]], alpha: float = ALPHA):
        by: dict[str, list[bytes]] = {}
        for label, text in labelled:
            if text:
                by.setdefault(label or "", []).append(self.shape(text.encode()))
        background = by.pop("", [b"\x03" * 12])
        self.background, self.formats = Automaton(background, alpha), {k: Automaton(v, alpha) for k, v in sorted(by.items())}
        self.known: dict[bytes, bool] = {}
        #: Runs that are shorter than every labelled credential have no likelihood under any format.
        least = min((len(s) for samples in by.values() for s in samples), default=1)
        self.candidates = re.compile(_CANDIDATE + b"{%d,}" % least)

    @staticmethod
    def shape(s: bytes) -> bytes:
        """Classes: digit, upper, lower, or the character; of the first four characters, only digits are a class."""
        return s[:4].translate(_DIGIT) + s[4:].translate(_CLASS)

    def is_secret(self, s: bytes) -> bool:
        shape = self.shape(s)
        if shape not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            plain = self.background.score(shape)
            self.known[shape] = max((a.score(shape) for a in self.formats.values()), default=-math.inf) - plain > MARGIN * len(shape)
        return self.known[shape]


def scan(raw: bytes, grammars: Grammars | None) -> list[tuple[str, int, int]]:
    """Spans of one text in bytes: base spans, then those that the automata add, by start and kind."""
    low, out = raw.lower(), []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    if grammars:
        base, at = sorted((x, y) for _, x, y in out), 0
        reached = 0  # the furthest end of base spans that begin before the candidate's end
        for m in grammars.candidates.finditer(raw):
            a, b = m.span()
            while at < len(base) and base[at][0] < b:
                reached = max(reached, base[at][1])
                at += 1
            if reached <= a and grammars.is_secret(m[0]):
                out.append(("grammar", a, b))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def in_characters(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if raw.isascii():
        return spans
    out, at, n = [], 0, 0
    places = {}
    for p in sorted({x for s in spans for x in s[1:]}):
        n += len(raw[at:p].decode())
        at = p
        places[p] = n
    for k, a, b in spans:
        out.append((k, places[a], places[b]))
    return out


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch], grammars) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch, texts in slices(batches):
        rows = [in_characters(t, scan(t, grammars.value)) for t in texts]
        count = lambda kind: pa.array([sum(s[0] == kind for s in r) for r in rows], pa.int64())
        base = [hashlib.sha256(_join(s for s in r if s[0] != "grammar").encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(count, KINDS), pa.array(base), pa.array(map(_join, rows))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"])


def infer(spark: SparkSession, labelled: DataFrame | None = None):
    """Automata from labelled credentials (format, credential; an empty format is background), broadcast. At most 20,000 are used."""
    rows = labelled_credentials() if labelled is None else [tuple(r) for r in labelled.select("format", "credential").orderBy(F.xxhash64("credential")).limit(20_000).collect()]
    return spark.sparkContext.broadcast(Grammars(rows))


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, base_sha256, spans of every whole text.

    Null and empty texts have no spans; every row gives one row, repeated or not, and a null doc_id stays null. An empty
    table gives no rows; other columns are ignored, whatever their names. Spans are kind:start:end in code points. The
    automata score every run of credential characters as long as the shortest labelled credential; time is linear in a text.
    """
    grammars = infer(bounded(docs).sparkSession, labelled)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scanned(b, grammars), "doc_id long, n_assign long, n_access long, n_hex long, n_grammar long, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch], grammars, mark: bytes) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        out = []
        for t in texts:
            parts, at = [], 0
            for _, a, b in scan(t, grammars.value):
                if b > at:
                    parts += [t[at : max(a, at)], mark] if a >= at else []
                    at = b
            out.append(b"".join([*parts, t[at:]]) if at else t)
        k = batch.schema.get_field_index("text")
        fresh = pa.array([o.decode() if ok else None for o, ok in zip(out, batch.column(k).is_valid().to_pylist(), strict=True)], batch.schema.field(k).type)
        columns = [fresh if i == k else c for i, c in enumerate(batch.columns)]
        if (n := batch.schema.get_field_index("n_chars")) >= 0:
            changed = [len(o) != len(t) for o, t in zip(out, texts, strict=True)]
            columns[n] = pa.array([len(f.as_py()) if c else old for f, c, old in zip(fresh, changed, batch.column(n).to_pylist(), strict=True)], batch.schema.field(n).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret's span replaced by a mark; n_chars, where there is one, follows a changed text."""
    grammars, shown = infer(bounded(docs).sparkSession, labelled), mark.encode()
    return docs.mapInArrow(lambda b: _redacted(b, grammars, shown), docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
