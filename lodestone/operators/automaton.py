"""Dictionary forms in token sequences: an automaton over token numbers, one linear pass over each text, whatever the forms' lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of forms that one automaton holds; more forms are searched for by several, one after the other.
FORM_BYTES = 8_000_000
#: Tokens, about, of the texts that are gone through at a time.
TOKENS = 1 << 18


class Automaton:
    """Aho-Corasick over token numbers: `find` gives every place of every form in one pass."""

    def __init__(self, forms: list[list[str]]):
        """Empty forms are nowhere."""
        number: dict[str, int] = {}
        self.next: dict[int, int] = {}  # state * width + token -> state
        self.width = max(1, len({t for f in forms for t in f}))
        self.depth, self.forms, parents = [0], [[]], [(0, 0)]
        for k, form in enumerate(forms):
            state = 0
            for t in form:
                at = state * self.width + number.setdefault(t, len(number))
                if at not in self.next:
                    self.next[at] = len(self.depth)
                    self.depth.append(self.depth[state] + 1)
                    self.forms.append([])
                    parents.append((state, at % self.width))
                state = self.next[at]
            if form:
                self.forms[state].append(k)
        self.vocabulary = pa.array(list(number), pa.string())
        self.fail, self.shorter = [0] * len(self.depth), [0] * len(self.depth)  # shorter: the longest proper suffix that ends a form
        for state in np.argsort(self.depth, kind="stable")[1:].tolist():
            above, token = parents[state]
            if above:
                self.fail[state] = self._step(self.fail[above], token)
            self.shorter[state] = self.fail[state] if self.forms[self.fail[state]] else self.shorter[self.fail[state]]

    def _step(self, state: int, token: int) -> int:
        while True:
            to = self.next.get(state * self.width + token)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.fail[state]

    def find(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(begin, end, form) by end; a negative token is in no form."""
        state, next_, fail, forms, shorter, width = 0, self.next, self.fail, self.forms, self.shorter, self.width
        for i, token in enumerate(tokens, 1):
            if token < 0:
                state = 0
                continue
            while (to := next_.get(state * width + token)) is None and state:
                state = fail[state]
            state = to or 0
            hit = state if forms[state] else shorter[state]
            while hit:
                for k in forms[hit]:
                    yield i - self.depth[hit], i, k
                hit = shorter[hit]


def longest(spans: list[tuple]) -> dict:
    """concept -> begin, from spans (begin, end, concept): those that lie in none before them in the order of begin, longer first, concept; the first of each concept."""
    out, covered = {}, -1
    for a, b, concept in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if b > covered:
            out.setdefault(concept, a)
            covered = b
    return out


_built: dict[int, tuple[Automaton, list]] = {}


def _automaton(shared) -> tuple[Automaton, list]:
    """The broadcast forms' automaton, made once in a worker."""
    if shared.id not in _built:
        while len(_built) > 3:
            _built.pop(next(iter(_built)))
        forms, concepts = shared.value
        _built[shared.id] = Automaton(forms), concepts
    return _built[shared.id]


class _Shared:
    """A broadcast and its number, by which a worker remembers what it made of it."""

    def __init__(self, broadcast):
        self.id, self._broadcast = broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") and broadcast._jbroadcast else id(broadcast), broadcast

    @property
    def value(self):
        return self._broadcast.value


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, TOKENS of them at a time or one row."""
    for batch in batches:
        ends, a = np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64)), 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, side="right")))
            yield batch.slice(a, z - a)
            a = z


def _places(batches: Iterator[pa.RecordBatch], shared, names: list[str], types: list[pa.DataType], whole: bool) -> Iterator[pa.RecordBatch]:
    machine, concepts = _automaton(shared)
    for batch in _portions(batches):
        docs, tokens = batch.column(0), batch.column(1)
        numbers = pc.fill_null(pc.index_in(tokens.flatten(), value_set=machine.vocabulary), -1).to_pylist() if len(machine.vocabulary) else []
        ends = np.cumsum(np.asarray(tokens.value_lengths().fill_null(0), np.int64)).tolist()
        at, out, begin = [], ([], [], []), 0
        for row, end in enumerate(ends if numbers else []):
            found = [(a, b, concepts[k]) for a, b, k in machine.find(numbers[begin:end])]
            if whole:
                found = [(a, None, c) for c, a in longest(found).items()]
            at += [row] * len(found)
            for a, b, c in found:
                out[0].append(a)
                out[1].append(b)
                out[2].append(c)
            begin = end
        columns = {"a": out[0], "b": out[1], "concept": out[2]}
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), *[pa.array(columns[n], t) for n, t in zip(names, types, strict=True)]], names=["doc", *names])


def _blocks(forms: DataFrame, form_bytes: int) -> Iterator:
    """Broadcasts of (forms, concepts), each of form_bytes at most, about."""
    own = forms.where(F.size("form") > 0).select("concept", "form").distinct()
    total = own.agg(F.sum(F.octet_length(F.array_join("form", " ")))).first()[0] or 0
    blocks = max(1, -(-total // form_bytes))
    for k in range(blocks):
        part = own.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == k).orderBy("form", "concept").toArrow()
        yield _Shared(forms.sparkSession.sparkContext.broadcast((part.column("form").to_pylist(), part.column("concept").to_pylist())))


def _search(docs: DataFrame, forms: DataFrame, whole: bool, form_bytes: int) -> tuple[DataFrame, int]:
    concept = forms.schema["concept"].dataType
    doc, kind = docs.schema["doc"].dataType.simpleString(), concept.simpleString()
    names, types = (["concept", "a"], [_arrow(kind), pa.int32()]) if whole else (["a", "b", "concept"], [pa.int32(), pa.int32(), _arrow(kind)])
    schema = f"doc {doc}, concept {kind}, a int" if whole else f"doc {doc}, a int, b int, concept {kind}"
    out, n = None, 0
    for shared in _blocks(forms, form_bytes):
        part = docs.select("doc", "tokens").mapInArrow(lambda batches, shared=shared: _places(batches, shared, names, types, whole), schema)
        out, n = part if out is None else out.unionByName(part), n + 1
    return out, n


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}.get(kind, pa.string())


def spans(docs: DataFrame, forms: DataFrame, form_bytes: int = FORM_BYTES) -> DataFrame:
    """(doc, a, b, concept): where a concept's form (array of tokens) stands among the tokens of docs (doc, tokens).

    Forms are a stated set and go to the workers in blocks of form_bytes; texts are passed over once for each block and never
    shuffled. Empty forms are nowhere, a row without tokens has no place.
    """
    return _search(docs, forms, False, form_bytes)[0]


def linked(docs: DataFrame, forms: DataFrame, form_bytes: int = FORM_BYTES) -> DataFrame:
    """(doc, concept, a): the longest matches of each row's tokens, each concept at its first; rows repeat no doc. One block of forms is decided within the row."""
    from lodestone.operators.knowledge import longest_matches

    out, blocks = _search(docs, forms, True, form_bytes)
    return out if blocks == 1 else longest_matches(spans(docs, forms, form_bytes))
