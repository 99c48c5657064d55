"""Best-fit repacking, its bounds, importance resampling and the Merkle manifest against brute force."""

import collections
import hashlib
import math
import re
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from lodestone.llm import importance, merkle, packing, repacking

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (None, "no id here\nbut lines", "en", "a", 5), (None, "no id", "en", "b", 5), (4, "Same text\n again", "en", "a", 9), (4, "Same text\n again", "en", "a", 9),
    (4, "other text", "en", "a", 9), (5, "  \n\t ", "en", "b", 4), (6, "ünï côdé " * 40, "en", "ä", 1), (7, "w " * 9000, "en", "", 1), (8, "x" * 5000, "en", "a", 1), (9, "A-B_c\x00d\x7fe" * 9, "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumn("key", F.lit(1)).withColumn("idx", F.lit("i")).withColumn("row", F.lit(2.5)).withColumn("part", F.lit(None).cast("string")).withColumn("stream", F.lit(3)).withColumn("rank", F.lit("r")).withColumn("path", F.lit(4))


def least_bins(sizes, capacity):
    """The optimum by exhaustive search."""
    sizes = tuple(sorted(sizes, reverse=True))

    @cache
    def place(k, spaces):
        if k == len(sizes):
            return 0
        best = 1 + place(k + 1, tuple(sorted((*spaces, capacity - sizes[k]))))
        for j, room in enumerate(spaces):
            if room >= sizes[k] and (j == 0 or spaces[j - 1] != room):
                best = min(best, place(k + 1, tuple(sorted((*spaces[:j], room - sizes[k], *spaces[j + 1 :])))))
        return best

    return place(0, ())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_packing_enclose_the_optimum(sizes):
    x = np.array(sizes)
    bins, offsets, fill = repacking.best_fit_decreasing(x, 20)
    best = least_bins(sizes, 20)
    assert repacking.lower_bound(*np.unique(x, return_counts=True), 20) <= best <= len(fill) <= best + 2
    for b in range(len(fill)):
        own = sorted(zip(offsets[bins == b].tolist(), x[bins == b].tolist(), strict=True))
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == fill[b] <= 20


def test_bounds_beyond_the_volume():
    """Pieces of which two do not fit, pieces of which three do not, and large ones with too few small ones."""
    for sizes, capacity, want in (([51] * 8, 100, 8), ([34] * 8, 100, 4), ([70] * 5 + [40] * 4, 100, 7), ([60] * 4 + [30] * 4, 100, 4)):
        assert repacking.lower_bound(*np.unique(sizes, return_counts=True), capacity) == want == len(repacking.best_fit_decreasing(np.array(sizes), capacity)[2])


def check_whole(docs, pieces, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want, got, used = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in docs.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], "<u4")
            want[r["doc_id"], k, start, len(own), zlib.crc32(own.tobytes())] += 1
    for r in pieces:
        got[tuple(r)[:5]] += 1
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(used)


@pytest.mark.parametrize(("capacity", "partition"), [(4096, 1 << 14), (300, 5), (4, 2)])
def test_repacking_odd_rows(odd, spark, capacity, partition):
    out = repacking.repack(odd, capacity=capacity, partition_pieces=partition)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_whole(odd, out.collect(), capacity)
    assert repacking.repack(odd.limit(0), capacity=capacity).count() == 0


def test_exchange_reaches_what_one_partition_would(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = repacking.certificate(repacking.repack(docs))
    split = repacking.repack(docs, partition_pieces=60)
    many = repacking.certificate(split)
    assert one[0] == one[1] == many[1] and many[0] <= one[0] + 1
    assert check_whole(docs, split.collect(), repacking.CAPACITY) == many[0]


TEXTS = st.lists(st.text(alphabet="aAbB é.1\n\t-", max_size=50), max_size=8)


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, most=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_streams_hold_every_feature(texts, most):
    stream, begins = importance.streams([t.encode() for t in texts], most, 997)
    assert begins.tolist() == np.cumsum([0, *(len(features(t, most)) for t in texts)]).tolist()
    for t, a, b in zip(texts, begins, begins[1:], strict=False):
        assert sorted(stream[a:b].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in features(t, most))


def test_checksums_of_long_words():
    rng = np.random.default_rng(1)
    for n in (31, 32, 33, 1000, 70_000):
        a, b = (bytes(rng.integers(97, 123, k).astype(np.uint8)) for k in (n, n + 1))
        stream, _ = importance.streams([a + b" " + b, b], 2, 1 << 16)
        assert stream.tolist() == [zlib.crc32(x) % (1 << 16) for x in (a, a + b" " + b, b, b)]


def brute_resample(docs, items, buckets, least, percent):
    def total(texts):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t))

    own, want = total(t for _, t in docs), total(items)
    s_all, t_all = sum(own.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[k] + 1) * (s_all + buckets) / ((own[k] + 1) * (t_all + buckets)))) for k in range(buckets)]
    out = []
    for i, t in docs:
        f = [gain[zlib.crc32(x.encode()) % buckets] for x in features(t)]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("buckets", "least", "percent"), [(10_000, 20, 25), (50, 1, 50), (65_536, 2, 100)])
def test_resampling_odd_rows(odd, spark, buckets, least, percent):
    items = spark.createDataFrame([("a", "same text again and again"), ("b", None), (None, "ünï"), ("c", "")], "item_id string, text string")
    got = importance.resample(odd, items, buckets=buckets, least_words=least, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample([r[:2] for r in ODD], [r["text"] for r in items.collect()], buckets, least, percent)
    assert importance.resample(odd.limit(0), items).count() == 0
    assert importance.resample(odd, items.limit(0)).count() == len(ODD)


def brute_manifest(rows, fanout):
    """Every leaf's path by plain recursion over lists: rows are (doc_id, text, lang, source, n_chars)."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def tree(hashes):
        """(root, siblings of each leaf from the bottom up as (left, right))."""
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for k, i in enumerate(at):
                run = hashes[i // fanout * fanout :][:fanout]
                paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            hashes = [h("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
            at = [i // fanout for i in at]
        return hashes[0], paths

    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, above, strict=True):
        for (_, _, own, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            fold = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1]:
                fold = leaf(r, r[1].replace("\n", ""))
            for left, right in path + over:
                fold = h(left + fold + right)
            out.append((r[0], own, trees[s][0], root, h("".join(a + b for a, b in path + over)), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_odd_rows(odd, spark, fanout):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    held = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted(map(tuple, merkle.manifest(odd, fanout, held).collect()), key=repr)
    assert got == brute_manifest(ODD, fanout) and {r[6] for r in got} == {True, False}
    assert merkle.manifest(odd.limit(0), fanout).count() == 0
    assert merkle.manifest(odd.where("doc_id = 6"), fanout).first()["verified"]


def test_manifest_of_many_sources(spark):
    rows = [(k, f"line {k}\nend", "en", None if k % 7 == 3 else f"s{k % 11}" if k % 2 else f"own {k}", k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = sorted(map(tuple, merkle.manifest(docs, 3, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).collect()), key=repr)
    assert got == brute_manifest(rows, 3)


def test_sql_of_odd_rows(odd, spark):
    """The queries' SQL takes nulls, ties and repeated rows as the operators do."""
    import duckdb

    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    items = spark.createDataFrame([("a", "same text again and again"), ("b", None)], "item_id string, text string")
    con.register("benchmark", items.toArrow())
    assert compare(importance.resample(odd, items), con, importance.OP12_SQL) == ""
